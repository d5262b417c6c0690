"""The prefix trie, the WARC archives and the Merkle manifest against plain versions, and their edge cases."""

import base64
import glob
import gzip
import hashlib
import os
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from conftest import SMALL, TABLES
from lodegraph.llm import common, merkle, prefix_trie, queries, warc
from test_queries import same_rows

CONV = "conv_id long, turn long, role string, text string, depth long, pos long, k1 string, length int"
NODE = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def crc(number):
    return zlib.crc32(str(number).encode())


@pytest.mark.parametrize("name", ["op11_prefix_trie", "op12_warc", "op13_merkle"])
def test_against_sql(spark, duck, name):
    got = queries.queries()[name](spark, SMALL)
    want = duck.execute(queries.oracle_sql()[name])
    same_rows(got.columns, [tuple(r) for r in got.collect()], [c[0] for c in want.description], want.fetchall())
    assert len(TABLES) == 14


def plain_trie(rows):
    """The trie by paths in a dictionary."""
    own = defaultdict(list)
    for c, turn, role, text, *_ in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(v)] for c, v in own.items()}
    paths = {c: own.get(c - c % 5, [])[: crc(c) % 9] + v[crc(c) % 9 :] for c, v in own.items()}
    members, kids = defaultdict(list), defaultdict(set)
    for c, p in paths.items():
        for d in range(len(p) + 1):
            members[tuple(p[:d])].append(c)
            if d:
                kids[tuple(p[: d - 1])].add(tuple(p[:d]))
    leaves, saved = defaultdict(int), defaultdict(int)
    for n, m in members.items():
        for d in range(len(n) + 1):
            saved[n[:d]] += (len(m) - 1) * len(n[-1][1].encode()) if n else 0
            leaves[n[:d]] += not kids[n]
    return [
        (min(m), len(n), min(members[n[:-1]]) if n else None, len(m), len(kids[n]), leaves[n], saved[n], sha(",".join(str(c) for c in sorted(m) if len(paths[c]) == len(n))))
        for n, m in members.items()
    ]


def conversation_rows(rng, n, turns, words):
    rows = []
    for c in rng.sample(range(0, 3 * n), n):
        for t in range(rng.randint(1, turns)):
            turn = None if rng.random() < 0.05 else t
            rows.append((c, turn, rng.choice(["user", "bot", None]), rng.choice(words), 1, 1, "x", 1))
    return rows


@pytest.mark.parametrize(("seed", "most_cells"), [(1, prefix_trie.MOST_CELLS), (2, 1024), (3, 1024)])
def test_trie_against_a_plain_one(spark, seed, most_cells, monkeypatch):
    monkeypatch.setattr(prefix_trie, "BLOCK", 3)
    monkeypatch.setattr(prefix_trie, "CHUNK", 2)
    rng = random.Random(seed)
    rows = conversation_rows(rng, 120, 14, ["", "a", "b", "é漢", None, "long " * 30, "long " * 30 + "x"])
    # a long conversation, copies of it, and repeated rows of one turn
    rows += [(c, t, "user", f"t{t % 40}", 1, 1, "x", 1) for c in (1000, 1005, 1010, 1011) for t in range(60)] + [(1020, None, "user", "same", 1, 1, "x", 1)] * 25 + [(None, 1, "user", "lost", 1, 1, "x", 1)]
    got = prefix_trie.conversation_trie(spark.createDataFrame(rows, CONV).repartition(5), most_cells=most_cells)
    assert sorted(tuple(r) for r in got.select(NODE).collect() if r[1]) == sorted(r for r in plain_trie(rows) if r[1])
    assert [tuple(r) for r in got.where("depth = 0").select(NODE).collect()] == [r for r in plain_trie(rows) if not r[1]]


def test_trie_of_odd_tables(spark):
    assert prefix_trie.conversation_trie(spark.createDataFrame([], CONV)).count() == 0
    assert prefix_trie.conversation_trie(spark.createDataFrame([(None, 1, "user", "x", 1, 1, "x", 1)], CONV)).count() == 0
    # conversations that lose all their turns: the base isn't there and theirs come before the cut
    lost = [c for c in range(1, 200) if c % 5 and crc(c) % 9 > 1][:7]
    rows = [(c, 0, None, None, 1, 1, "x", 1) for c in lost]
    got = prefix_trie.conversation_trie(spark.createDataFrame(rows, CONV)).select(NODE).collect()
    assert [tuple(r) for r in got] == plain_trie(rows) == [(min(lost), 0, None, 7, 0, 1, 0, sha(",".join(map(str, lost))))]


def test_sketch_never_counts_too_few(spark):
    rows = spark.range(3000).select("id", (F.xxhash64("id") % 700).alias("k1"), F.lit(5).cast("long").alias("k2"), F.lit(0).alias("p1"), F.lit(0).alias("p2"))
    rows = rows.withColumns({"k1": F.abs("k1"), "k2": F.abs(F.xxhash64(F.abs("k1")))})
    found = prefix_trie.screened(rows, 4096)
    often = found.groupBy("k1").agg(F.count("*").alias("n"), F.bool_and("shared").alias("all"), F.bool_or("shared").alias("any"))
    assert often.where("n > 1 and not all").count() == 0
    assert often.where("n > 1").count() > 300


def test_stored_turns_hold_each_prefix_once(spark):
    rows = [(c, t, "user", f"t{t}", 1, 1, "x", 1) for c in (5, 10, 15) for t in range(3)]
    plan, turns = prefix_trie.rebuilt(prefix_trie.ordered(spark.createDataFrame(rows, CONV)))
    assert prefix_trie.stored_turns(prefix_trie.trie(plan, turns), turns).count() == 3


def test_places_of_repeated_and_hot_rows(spark):
    rows = spark.range(9000).select(F.when(F.col("id") < 6000, 1).otherwise(F.col("id") % 50).alias("g"), (F.col("id") % 3).alias("v"))
    got = common.placed(rows, ["g"], ["v"])
    for r in got.groupBy("g").agg(F.count("*").alias("n"), F.countDistinct("place").alias("d"), F.min("place").alias("a"), F.max("place").alias("b"), F.max("members").alias("m")).collect():
        assert (r.d, r.a, r.b, r.m) == (r.n, 0, r.n - 1, r.n)
    pairs = got.where("g = 1").orderBy("place").select("v").collect()
    assert [r.v for r in pairs] == sorted(r.v for r in pairs)


PAGE = "page_id long, url string, html string, path string, at string, digest int"
PAGES = [
    (1, "http://a/1", "same", "p", "a", 1), (2, "http://a/2", "same", "p", "a", 1), (9, "http://a/9 b\r\nX: y", "same", "p", "a", 1), (3, None, None, "p", "a", 1), (4, "u", "", None, None, None),
    (5, "u", "WARC/1.1\r\n\r\n\r\n\r\nWARC/1.1\r\nContent-Length: 4", "p", "a", 1), (6, "u", "é漢\U0001f600" * 40_000, "p", "a", 1), (7, "u", "é漢\U0001f600" * 40_000, "p", "a", 1),
    (None, "u", "nobody", "p", "a", 1), (None, "u", "nobody", "p", "a", 1), (None, None, "alone", "p", "a", 1), (8, "u", "twice", "p", "a", 1), (8, "u", "twice", "p", "a", 1), (0, "u", "<p>\x00\x1f\n\n</p>", "p", "a", 1),
]


def plain_records(rows, least=0):
    groups = defaultdict(list)
    for page, _, html, *_ in rows:
        groups[(html or "").encode()].append(page)
    out = []
    for body, pages in groups.items():
        digest = base64.b32encode(hashlib.sha1(body).digest()).decode()
        first, *rest = sorted(pages, key=lambda p: (p is not None, p or 0), reverse=True)
        out.append((first, len(body), digest, "response", None))
        out += [(p, len(body), digest, "revisit" if len(body) >= least else "response", first if len(body) >= least else None) for p in rest]
    return sorted(out, key=repr)


def test_archives_of_odd_pages(spark):
    got = warc.archived(spark.createDataFrame(PAGES, PAGE).repartition(3))
    assert sorted(map(tuple, got.collect()), key=repr) == plain_records(PAGES)
    assert warc.archived(spark.createDataFrame(PAGES, PAGE), least=5).where("payload_bytes < 5 and record_type = 'revisit'").count() == 0
    assert warc.archived(spark.createDataFrame([], PAGE)).count() == 0


def test_archives_are_whole_gzip_streams_in_a_compressing_session(spark):
    spark.sparkContext._jsc.hadoopConfiguration().set("mapreduce.output.fileoutputformat.compress", "true")
    try:
        first, second = common.shared_dir(spark), common.shared_dir(spark)
        warc.write(spark.createDataFrame(PAGES, PAGE), first)
        warc.deduplicate(spark, first, second)
    finally:
        spark.sparkContext._jsc.hadoopConfiguration().unset("mapreduce.output.fileoutputformat.compress")
    kinds, payloads = [], []
    for path in glob.glob(second.removeprefix("file://") + "/part-*"):
        raw = open(path, "rb").read()
        assert gzip.decompress(raw).startswith(b"WARC/1.1\r\n")
        for at, size, content in warc.members(raw):
            assert gzip.decompress(raw[at : at + size]) == content and content.endswith(b"\r\n\r\n")
            fields, _, payload = warc.parsed(content)
            kinds.append(fields["warc-type"])
            payloads.append(payload)
            assert ("warc-refers-to" in fields) == (fields["warc-type"] == "revisit")
            assert "x" not in fields  # a line break of a url makes no field
    assert kinds.count("response") == len({(p[2] or "") for p in PAGES}) and len(kinds) == len(PAGES)
    assert {x for x in payloads if x} == {(p[2] or "").encode() for p in PAGES if p[2]}


def test_revisits_of_an_archive_are_resolved_anew(spark):
    """A second deduplication keeps all revisits; one whose original is nowhere keeps its header."""
    first, second, third = (common.shared_dir(spark) for _ in range(3))
    warc.write(spark.createDataFrame(PAGES, PAGE), first)
    warc.deduplicate(spark, first, second)
    warc.deduplicate(spark, second, third)
    assert sorted(map(tuple, warc.resolved(warc.read(spark, third)).collect()), key=repr) == plain_records(PAGES)
    lone = f"{third}-lone"
    os.makedirs(lone.removeprefix("file://"))
    fields = {"WARC-Type": "revisit", "WARC-Record-ID": "<urn:x:1>", "WARC-Refers-To": "<urn:x:0>", "WARC-Payload-Digest": "sha1:AAAA", "X-Page-Id": "4"}
    open(lone.removeprefix("file://") + "/a.warc.gz", "wb").write(warc.record(fields, "HTTP/1.1 200 OK\r\nContent-Length: 7\r\n\r\n", b""))
    warc.deduplicate(spark, lone, f"{lone}-2")
    assert [tuple(r) for r in warc.read(spark, f"{lone}-2").select("type", "refers_to", "payload_bytes").collect()] == [("revisit", "<urn:x:0>", 7)]


def test_a_changed_payload_is_seen(spark):
    folder = common.shared_dir(spark).removeprefix("file://")
    os.makedirs(folder)
    open(f"{folder}/a.warc.gz", "wb").write(warc.record({"WARC-Type": "response", "WARC-Record-ID": "<x>", "WARC-Payload-Digest": "sha1:AAAA"}, "HTTP/1.1 200 OK\r\n\r\n", b"other"))
    with pytest.raises(Exception, match="digest"):
        warc.read(spark, f"file://{folder}").collect()


DOC = "doc_id long, text string, lang string, source string, n_chars long, place int, slot int, item string, name string, known string"


def plain_manifest(rows, fanout=16):
    def field(v):
        return "-" if v is None else f"{len(str(v).encode())}:{v}"

    def leaf(r, text):
        return sha("".join(map(field, (r[0], r[3], r[2], r[4], text))))

    def tree(leaves):
        """The root and, for each leaf, its siblings as (left, right) of each level."""
        ways, owners, now = [[] for _ in leaves], [[i] for i in range(len(leaves))], list(leaves)
        while len(now) > 1:
            runs = [range(i, min(i + fanout, len(now))) for i in range(0, len(now), fanout)]
            for run in runs:
                for i in run:
                    for leaf_ in owners[i]:
                        ways[leaf_].append(("".join(now[j] for j in run if j < i), "".join(now[j] for j in run if j > i)))
            owners = [[x for i in run for x in owners[i]] for run in runs]
            now = [sha("".join(now[i] for i in run)) for run in runs]
        return now[0], ways

    groups = defaultdict(list)
    for r in rows:
        groups[r[3]].append(r)
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in order:
        groups[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r, r[1])))
        trees[s] = tree([leaf(r, r[1]) for r in groups[s]])
    root, tops = tree([trees[s][0] for s in order]) if order else (None, [])
    out = []
    for s, top in zip(order, tops, strict=True):
        for r, way in zip(groups[s], trees[s][1], strict=True):
            low = None if r[1] is None else "".join(c.lower() if c.isascii() else c for c in r[1])
            now = leaf(r, low) if r[0] is not None and crc(r[0]) % 5 == 0 else leaf(r, r[1])
            for left, right in way + top:
                now = sha(left + now + right)
            out.append((r[0], leaf(r, r[1]), trees[s][0], root, sha("".join(a + b for a, b in way + top)), now, now == root))
    return sorted(out, key=repr)


@pytest.mark.parametrize("n", [1, 2, 16, 17, 300])
def test_manifest_against_a_plain_one(spark, n):
    rng = random.Random(n)
    texts = ["A b", None, "", "ÀÉ Upper", "low", "x" * 100_000]
    rows = [(rng.choice([None, rng.randrange(10**6), 7]), rng.choice(texts), rng.choice(["en", None]), rng.choice(["hot", "hot", None, "", "é", "a", f"s{rng.randrange(40)}"]), rng.choice([None, 3]), 1, 2, "i", "n", "k") for _ in range(n)]
    rows += rows[: n // 3]
    got = merkle.verified(spark.createDataFrame(rows, DOC).repartition(3)).collect()
    assert sorted(map(tuple, got), key=repr) == plain_manifest(rows)


def test_manifest_of_an_empty_table(spark):
    assert merkle.verified(spark.createDataFrame([], DOC)).count() == 0


def test_one_changed_text_changes_the_root(spark):
    rows = [(i, f"text {i}", "en", "s", 3, 1, 2, "i", "n", "k") for i in range(40)]
    root = lambda r: merkle.manifest(spark.createDataFrame(r, DOC)).first().root
    assert root(rows) == root(rows[::-1]) != root([(*rows[0][:1], "other", *rows[0][2:]), *rows[1:]])

"""The queries of this subpackage over the given tables, and their SQL where SQL can express them."""

from __future__ import annotations

import string
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, bpe, html_text, line_dedup, merkle, packing, prefix_trie, sharding, simhash, token_store, toxicity, warc, weighted_minhash


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_read(spark, sf_dir, "documents"))


def op2_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_store.stored_documents(_read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), 2)


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), 0)


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup.dedup_lines(docs).select(
        "doc_id", F.char_length("text").cast("long").alias("kept_chars"), F.md5("text").alias("kept_md5")
    )


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign(_read(spark, sf_dir, "documents"), 24)


def op6_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(_read(spark, sf_dir, "embeddings"), every=100, k=10)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.scores(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_decode(_read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op9_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(_read(spark, sf_dir, "pages"))


def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weighted_minhash.fingerprints(_read(spark, sf_dir, "documents"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.conversation_trie(_read(spark, sf_dir, "conversations"))


def op12_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archived(_read(spark, sf_dir, "pages"))


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.verified(_read(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (
        op1_simhash, op2_token_store, op3_packing, op4_line_dedup, op5_sharding,
        op6_neighbours, op7_toxicity, op8_bpe, op9_html_text, op10_fingerprints,
        op11_prefix_trie, op12_warc, op13_merkle,
    )
    return {f.__name__: f for f in found}


#: Lines by the definition in line_dedup: equal lines after the first go, and lines one word from an earlier one, also
#: where that one goes itself (a chain keeps its first line only).
_OP4 = r"""
WITH places AS (
  SELECT doc_id, p AS place, list_extract(lines, p) AS line
  FROM (SELECT doc_id, lines, unnest(range(1, len(lines) + 1)) AS p
        FROM (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL))
  WHERE trim(list_extract(lines, p)) <> ''
), firsts AS (
  SELECT line, min({'doc': doc_id, 'place': place}) AS first, string_split(line, ' ') AS w FROM places GROUP BY line
), long AS (
  SELECT line, first, w, len(w) AS n FROM firsts WHERE len(w) >= 5
), cut AS (
  SELECT line, first, n, i, array_to_string(list_concat(w[1:i-1], w[i+1:]), ' ') AS rest
  FROM (SELECT *, unnest(range(1, n + 1)) AS i FROM long)
), replaced AS (
  SELECT line FROM (SELECT line, first, min(first) OVER (PARTITION BY n, i, rest) AS least FROM cut) WHERE least < first
), moved AS (
  SELECT c.line AS longer, c.first AS longer_first, s.line AS shorter, s.first AS shorter_first
  FROM cut c JOIN long s ON c.rest = s.line AND s.n = c.n - 1
), near AS (
  SELECT line FROM replaced
  UNION SELECT longer FROM moved WHERE shorter_first < longer_first
  UNION SELECT shorter FROM moved WHERE longer_first < shorter_first
), gone AS (
  SELECT p.doc_id, p.place FROM places p JOIN firsts f ON p.line = f.line LEFT JOIN near x ON x.line = p.line
  WHERE x.line IS NOT NULL OR f.first <> {'doc': p.doc_id, 'place': p.place}
), kept AS (
  SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(string_agg(list_extract(d.lines, d.p), chr(10) ORDER BY d.p) FILTER (WHERE g.place IS NULL), '') END AS text
  FROM (SELECT doc_id, text, lines, unnest(range(1, greatest(len(lines), 1) + 1)) AS p
        FROM (SELECT doc_id, text, coalesce(string_split(text, chr(10)), ['']) AS lines FROM documents)) d
  LEFT JOIN gone g ON g.doc_id = d.doc_id AND g.place = d.p
  GROUP BY d.doc_id, d.text
)
SELECT doc_id, CAST(length(text) AS BIGINT) AS kept_chars, md5(text) AS kept_md5 FROM kept
"""



def _crc32(text: str) -> str:
    """The unsigned CRC-32 of an ASCII text in DuckDB, bit by bit."""
    codes = f"list_transform(string_split({text}, ''), lambda c: CAST(ascii(c) AS UBIGINT))"
    byte = "list_reduce([xor(s, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, (x & 1) * 3988292384))"
    return f"xor(list_reduce(list_prepend(CAST(4294967295 AS UBIGINT), {codes}), lambda s, b: {byte}), 4294967295)"


_OP11 = f"""
WITH t AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos,
         md5(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS turn_md5, strlen(coalesce(text, '')) AS bytes
  FROM conversations WHERE conv_id IS NOT NULL
), c AS (
  SELECT conv_id, conv_id - conv_id % 5 AS base, {_crc32('CAST(conv_id AS VARCHAR)')} % 9 AS h FROM (SELECT DISTINCT conv_id FROM t)
), r AS (
  SELECT c.conv_id, row_number() OVER (PARTITION BY c.conv_id ORDER BY part, pos) AS d, turn_md5, bytes
  FROM (SELECT c.conv_id, 0 AS part, pos, turn_md5, bytes FROM c JOIN t ON t.conv_id = c.base WHERE pos <= h
        UNION ALL SELECT c.conv_id, 1, pos, turn_md5, bytes FROM c JOIN t ON t.conv_id = c.conv_id WHERE pos > h) x JOIN c USING (conv_id)
), p AS (
  SELECT conv_id, d, bytes, md5(string_agg(turn_md5, '') OVER (PARTITION BY conv_id ORDER BY d ROWS UNBOUNDED PRECEDING)) AS k FROM r
  UNION ALL SELECT conv_id, 0, 0, '' FROM c
), m AS (
  SELECT *, max(d) OVER (PARTITION BY conv_id) AS len, lag(k) OVER (PARTITION BY conv_id ORDER BY d) AS parent FROM p
), n AS (
  SELECT k, any_value(d) AS depth, any_value(parent) AS parent, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(bytes) AS bytes, max(len) AS longest,
         sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE d = len), '')) AS ends_sha256
  FROM m GROUP BY k
), w AS (
  SELECT a.k, sum((n.n_convs - 1) * n.bytes) AS saved, count(*) FILTER (WHERE n.longest = n.depth) AS leaves
  FROM n JOIN m a ON a.conv_id = n.conv_id AND a.d <= n.depth GROUP BY a.k
), f AS (SELECT parent AS k, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY parent)
SELECT n.conv_id, CAST(n.depth AS BIGINT) AS depth, q.conv_id AS parent_conv_id, n.n_convs, coalesce(f.n_children, 0) AS n_children, w.leaves AS n_leaves, CAST(w.saved AS BIGINT) AS saved_tokens, n.ends_sha256
FROM n JOIN w USING (k) LEFT JOIN f USING (k) LEFT JOIN n q ON q.k = n.parent AND n.depth > 0
"""

_FIVE_BITS = ", ".join(f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(CAST('0x' || substr(sha1(body), {5 * i + 1}, 5) AS BIGINT) >> {s} & 31 AS INT) + 1, 1)" for i in range(8) for s in (15, 10, 5, 0))

_OP12 = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
r AS (SELECT *, row_number() OVER (PARTITION BY body ORDER BY page_id DESC NULLS LAST) AS rn, max(page_id) OVER (PARTITION BY body) AS best FROM p)
SELECT page_id, strlen(body) AS payload_bytes, concat({_FIVE_BITS}) AS payload_digest, CASE WHEN rn = 1 THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN rn > 1 THEN best END AS refers_to FROM r
"""


def _op13(levels: int = 7, upper: int = 4) -> str:
    """Trees of up to 16 ** levels documents a source and 16 ** upper sources; a level hands on the only node of a source as it is."""
    field = lambda c: f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')"
    low = f"translate(text, '{string.ascii_uppercase}', '{string.ascii_lowercase}')"
    leaf = lambda text: "sha256(" + " || ".join(map(field, ("doc_id", "source", "lang", "n_chars", text))) + ")"
    parts = [
        f"l AS (SELECT doc_id, source, {leaf('text')} AS leaf, CASE WHEN {_crc32('CAST(doc_id AS VARCHAR)')} % 5 = 0 THEN {leaf(low)} END AS tampered FROM documents)",
        "i AS (SELECT *, row_number() OVER (ORDER BY source NULLS FIRST, doc_id NULLS FIRST, leaf) AS row, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS g FROM l)",
        "t0 AS (SELECT g, place AS idx, count(*) OVER (PARTITION BY g) AS cnt, leaf AS digest FROM i)",
    ]
    sides = "coalesce(string_agg(digest, '') OVER (PARTITION BY g, idx // 16 ORDER BY idx ROWS BETWEEN {} ), '')"

    def level(name: str, k: int) -> None:
        before = f"{name}{k}"
        left, right = (sides.format(x) for x in ("UNBOUNDED PRECEDING AND 1 PRECEDING", "1 FOLLOWING AND UNBOUNDED FOLLOWING"))
        parts.append(f"{before}s AS (SELECT g, idx, CASE WHEN cnt > 1 THEN {left} END AS l, CASE WHEN cnt > 1 THEN {right} END AS r FROM {before})")
        parts.append(f"{name}{k + 1} AS (SELECT g, idx // 16 AS idx, (max(cnt) + 15) // 16 AS cnt, CASE WHEN max(cnt) > 1 THEN sha256(string_agg(digest, '' ORDER BY idx)) ELSE max(digest) END AS digest FROM {before} GROUP BY g, idx // 16)")

    for k in range(levels):
        level("t", k)
    parts.append(f"u0 AS (SELECT 0 AS g, g AS idx, count(*) OVER () AS cnt, digest FROM t{levels})")
    for k in range(upper):
        level("u", k)
    steps = [("t", k, "f.g", f"f.place // {16**k}") for k in range(levels)] + [("u", k, "0", f"f.g // {16**k}") for k in range(upper)]
    now = "SELECT *, coalesce(tampered, leaf) AS folded, '' AS proof FROM i"
    for n, (name, k, g, idx) in enumerate(steps):
        parts.append(f"f{n} AS MATERIALIZED ({now})")
        now = (
            f"SELECT f.* EXCLUDE (folded, proof), CASE WHEN s.l IS NULL THEN folded ELSE sha256(s.l || folded || s.r) END AS folded, proof || coalesce(s.l, '') || coalesce(s.r, '') AS proof "
            f"FROM f{n} f JOIN {name}{k}s s ON s.g = {g} AND s.idx = {idx}"
        )
    parts.append(f"z AS ({now})")
    return "WITH " + ",\n".join(parts) + f"""
SELECT doc_id, leaf, t{levels}.digest AS subroot, u{upper}.digest AS root, sha256(proof) AS proof_sha256, folded AS folded_root, folded = u{upper}.digest AS verified
FROM z JOIN t{levels} ON t{levels}.g = z.g JOIN u{upper} ON true
"""


def oracle_sql() -> dict[str, str]:
    """What SQL can express; the others rest on hashes, models, files or a tree builder, and are tested against
    brute force, round trips and held-out rows."""
    return {"op4_line_dedup": _OP4, "op11_prefix_trie": _OP11, "op12_warc": _OP12, "op13_merkle": _op13()}

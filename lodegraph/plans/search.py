"""Scans, predicates, keyword and vector search, joins and sets over the given tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import search as S
from ..sources.bindings import sql
from ..sources.scratch import stored
from .catalog import query


@query("s01_label_scan", sql("SELECT id, label, name FROM nodes WHERE label IN ('Class', 'Module')", "nodes"))
def s01(t):
    return t.nodes.where(F.col("label").isin("Class", "Module")).select("id", "label", "name")


@query("s02_graph_totals", sql("SELECT (SELECT count(*) FROM nodes) AS nodes, (SELECT count(*) FROM edges) AS edges", "nodes", "edges"))
def s02(t):
    return t.nodes.agg(F.count("*").alias("nodes")).crossJoin(t.edges.agg(F.count("*").alias("edges")))


_BM25 = """
WITH w AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '([a-z0-9_]+)', 1) AS w FROM documents),
c AS (SELECT doc_id, len(w) AS dl, len(list_filter(w, lambda x: x = 'the')) AS f0, len(list_filter(w, lambda x: x = 'license')) AS f1 FROM w),
s AS (SELECT count(*) AS n, avg(dl) AS avgdl, count(*) FILTER (WHERE f0 > 0) AS d0, count(*) FILTER (WHERE f1 > 0) AS d1 FROM c)
SELECT doc_id, round(ln(1 + (n - d0 + 0.5) / (d0 + 0.5)) * f0 * 2.2 / (f0 + 1.2 * (0.25 + 0.75 * dl / avgdl))
                   + ln(1 + (n - d1 + 0.5) / (d1 + 0.5)) * f1 * 2.2 / (f1 + 1.2 * (0.25 + 0.75 * dl / avgdl)), 4) AS score
FROM c, s WHERE f0 > 0 OR f1 > 0
"""


@query("s03_fulltext_scan", _BM25)
def s03(t):
    return t.fulltext.scores(["the", "license"]).select(F.col("key").alias("doc_id"), F.round("score", 4).alias("score"))


_COSINE = "list_sum(list_transform(list_zip(e.embedding, q.embedding), lambda z: CAST(z[1] AS DOUBLE) * z[2])) / (sqrt(list_sum(list_transform(e.embedding, lambda x: CAST(x AS DOUBLE) * x))) * sqrt(list_sum(list_transform(q.embedding, lambda x: CAST(x AS DOUBLE) * x))))"


@query("s04_vector_scan", f"SELECT e.vec_id, e.label, round((1 + {_COSINE}) / 2, 4) AS score FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q WHERE (1 + {_COSINE}) / 2 >= 0.55")
def s04(t):
    found = t.vectors.within(t.vector_of(0), 0.55).select(F.col("key").alias("vec_id"), F.round("score", 4).alias("score"))
    return t.embeddings.select("vec_id", "label").join(found, "vec_id")


@query("s05_recent_log_scan", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events WHERE ts > (SELECT max(ts) FROM events) - INTERVAL 7 DAY AND json_valid(props)")
def s05(t):
    asof = t.events.agg(F.max("ts").alias("asof"))
    parsed = t.events.withColumn("p", F.from_json("props", "k long", {"mode": "PERMISSIVE"}))
    recent = parsed.crossJoin(F.broadcast(asof)).where(F.col("ts") > F.col("asof") - F.expr("interval 7 days"))  # one row
    return recent.where("p is not null").select("event_id", "p.k")


@query("s06_last_lines", "SELECT event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn <= 50")
def s06(t):
    w = Window.partitionBy("event_type").orderBy(F.desc("ts"), F.desc("event_id"))
    return t.events.withColumn("rn", F.row_number().over(w)).where("rn <= 50").select("event_id", "event_type")


@query("s07_json_or_default", "SELECT event_id, coalesce(TRY_CAST(json_extract_string(CASE WHEN json_valid(props) THEN props END, '$.missing') AS BIGINT), -1) AS missing, coalesce(TRY_CAST(json_extract_string(CASE WHEN json_valid(props) THEN props END, '$.k') AS BIGINT), -1) AS k FROM events")
def s07(t):
    p = F.from_json("props", "k long, missing long", {"mode": "PERMISSIVE"})
    return t.events.select("event_id", F.coalesce(p["missing"], F.lit(-1)).alias("missing"), F.coalesce(p["k"], F.lit(-1)).alias("k"))


def optional_filters(rows, **wanted):
    """Keep rows equal in each given column; None asks for nothing."""
    for column, value in wanted.items():
        if value is not None:
            rows = rows.where(F.col(column) == value)
    return rows


@query("s08_optional_predicates", sql("SELECT job_id, owner, priority FROM jobs WHERE status = 'running' AND priority = '2-HIGH'", "jobs"))
def s08(t):
    return optional_filters(t.jobs, status="running", priority="2-HIGH", owner=None).select("job_id", "owner", "priority")


@query("s09_path_scan", r"SELECT page_id, url FROM pages WHERE regexp_matches(url, '\.html?($|[?#])') AND NOT regexp_matches(url, '/(node_modules|dist|\.git)/')")
def s09(t):
    return t.pages.where(F.col("url").rlike(r"\.html?($|[?#])") & ~F.col("url").rlike(r"/(node_modules|dist|\.git)/")).select("page_id", "url")


@query("s10_packet_loader", sql(", packets AS (SELECT p_brand AS repo, p_type AS name, list_sort(list(DISTINCT p_name)) AS items FROM part GROUP BY 1, 2) SELECT CASE WHEN name IN ('PROMO', 'SMALL') THEN 'error' ELSE 'pattern' END AS type, repo, name, unnest(items) AS item FROM packets"))
def s10(t):
    """Packets of two shapes: patterns with their rules, and errors with their solutions."""
    inner = t.part.groupBy("p_brand", "p_type").agg(F.array_sort(F.collect_set("p_name")).alias("items"))
    # a packet per brand and pattern: all names of a brand in one row would have no bound
    error = F.col("p_type").isin("PROMO", "SMALL")
    shape = lambda key: F.array(F.struct(F.col("p_type").alias("name"), F.col("items").alias(key)))
    packet = F.struct(F.when(error, "error").otherwise("pattern").alias("type"), F.col("p_brand").alias("repo"), F.when(~error, shape("rules")).alias("patterns"), F.when(error, shape("solutions")).alias("errors"))
    kind = "type string, repo string, patterns array<struct<name:string,rules:array<string>>>, errors array<struct<name:string,solutions:array<string>>>"
    parsed = inner.select(F.to_json(packet).alias("packet")).select(F.from_json("packet", kind).alias("p"))
    patterns = parsed.where("p.type = 'pattern'").select("p.type", "p.repo", F.explode("p.patterns").alias("q")).select("type", "repo", "q.name", F.explode("q.rules").alias("item"))
    errors = parsed.where("p.type = 'error'").select("p.type", "p.repo", F.explode("p.errors").alias("q")).select("type", "repo", "q.name", F.explode("q.solutions").alias("item"))
    return patterns.unionByName(errors)


@query("s11_artifact_glob", "SELECT 'documents.parquet' AS file, count(*) AS rows FROM documents UNION ALL SELECT 'events.parquet', count(*) FROM events")
def s11(t):
    name = F.regexp_extract(F.input_file_name(), r"([a-z]+\.parquet)", 1)
    each = [getattr(t, x).select(name.alias("file")) for x in ("documents", "events")]
    return each[0].unionAll(each[1]).groupBy("file").agg(F.count("*").alias("rows"))


@query("s12_latest_artifact", "SELECT user_id, arg_max(event_id, ts) AS latest FROM (SELECT user_id, max(ts) AS ts, max(event_id) AS event_id FROM events GROUP BY user_id, ts) GROUP BY user_id")
def s12(t):
    return t.events.groupBy("user_id").agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("latest"))


_Q = "plate"


@query("f01_keyword_search", sql("SELECT id, name, CASE WHEN lower(name) = 'plate' THEN 100 WHEN starts_with(lower(name), 'plate') THEN 80 WHEN contains(lower(name), 'plate') THEN 60 ELSE 40 END AS score FROM nodes WHERE contains(lower(coalesce(name, '')), 'plate') OR contains(lower(coalesce(module, '')), 'plate')", "nodes"))
def f01(t):
    return S.keyword_search(t.nodes, _Q, ["name", "module"]).select("id", "name", "score")


@query("f02_pattern_search", "SELECT item_id AS id, left(text, 40) AS name FROM benchmark WHERE contains(lower(text), 'an')")
def f02(t):
    return t.benchmark.where(X.matches(F.col("text"), "an")).select(F.col("item_id").alias("id"), F.left("text", F.lit(40)).alias("name"))


@query("f03_any_keyword", "SELECT doc_id FROM documents WHERE contains(lower(coalesce(text, '')), 'license') OR contains(lower(coalesce(text, '')), 'idiot')")
def f03(t):
    return t.documents.where(X.any_keyword(F.col("text"), ["license", "idiot"])).select("doc_id")


@query("f04_keyword_hits", "SELECT doc_id, CAST(contains(lower(text), 'the') AS INT) + CAST(contains(lower(text), 'und') AS INT) + CAST(contains(lower(text), 'license') AS INT) AS hits FROM documents")
def f04(t):
    return t.documents.select("doc_id", X.keyword_hits(F.col("text"), ["the", "und", "license"]).alias("hits"))


@query("f05_match_tier", "SELECT p_partkey, CASE WHEN lower(p_name) = 'red' THEN 100 WHEN starts_with(lower(p_name), 'red') THEN 80 WHEN contains(lower(p_name), 'red') THEN 60 ELSE 40 END AS tier FROM part")
def f05(t):
    return t.part.select("p_partkey", X.match_tier(F.col("p_name"), "red").alias("tier"))


@query("f06_scored_fulltext", f"SELECT doc_id, round(score * 10 + CASE WHEN lower(source) = 'src1' THEN 100 WHEN starts_with(lower(source), 'src1') THEN 80 WHEN contains(lower(source), 'src1') THEN 60 ELSE 0 END, 3) AS score FROM ({_BM25}) JOIN documents USING (doc_id)")
def f06(t):
    hits = t.fulltext.scores(["the", "license"]).select(F.col("key").alias("doc_id"), F.round("score", 4).alias("bm25")).join(t.documents.select("doc_id", "source"), "doc_id")
    return hits.select("doc_id", F.round(F.col("bm25") * 10 + X.match_tier(F.col("source"), "src1", 0), 3).alias("score"))


LOCAL_SQL = """, found AS (
  SELECT id, name, CASE WHEN lower(name) = 'plate' THEN 100 WHEN starts_with(lower(name), 'plate') THEN 80 ELSE 60 END AS score
  FROM functions WHERE contains(lower(name), 'plate')),
outs AS (SELECT src AS id, list_sort(list(dst))[1:5] AS callees FROM calls GROUP BY 1),
ins AS (SELECT dst AS id, list_sort(list(src))[1:5] AS callers FROM calls GROUP BY 1)
SELECT f.id, name, score, array_to_string(callees, ',') AS callees, array_to_string(callers, ',') AS callers
FROM found f LEFT JOIN outs USING (id) LEFT JOIN ins USING (id) ORDER BY score DESC, name, f.id LIMIT 20"""


def local_search(t, q: str, limit: int = 20):
    """Functions by name with up to five callees and callers, of the functions that the limit leaves only."""
    found = stored(S.keyword_search(t.functions, q, ["name"], limit).select("id", "name", "score"))
    ids = F.broadcast(found.select("id"))  # ``limit`` rows
    near = lambda by: t.calls.join(ids, F.col(by) == F.col("id"), "left_semi")
    outs = S.capped(near("src"), "src", "dst", 5, "callees").withColumnRenamed("src", "id")
    ins = S.capped(near("dst"), "dst", "src", 5, "callers").withColumnRenamed("dst", "id")
    joined = found.join(outs, "id", "left").join(ins, "id", "left")
    return joined.select("id", "name", "score", "callees", "callers").orderBy(F.desc("score"), "name", "id")


@query("f07_local_search", sql(LOCAL_SQL, "functions", "calls"))
def f07(t):
    return local_search(t, _Q).select("id", "name", "score", F.array_join("callees", ",").alias("callees"), F.array_join("callers", ",").alias("callers"))


@query("f08_semantic_search", f"SELECT vec_id, label, round(raw, 4) AS score FROM (SELECT e.vec_id, e.label, (1 + {_COSINE}) / 2 AS raw FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 3) q) WHERE raw >= 0.5 ORDER BY raw DESC, vec_id LIMIT 10")
def f08(t):
    best, _ = t.vectors.search(t.vector_of(3), 10, 0.5)
    return t.embeddings.select("vec_id", "label").join(F.broadcast(best.select(F.col("key").alias("vec_id"), F.round("score", 4).alias("score"))), "vec_id")  # 10 rows


@query("f09_global_search", sql("""
SELECT 'module' AS kind, module AS name, count(*) AS n FROM functions WHERE contains(lower(name), 'plate') GROUP BY module
UNION ALL SELECT 'pattern', name, count(*) FROM nodes WHERE label = 'Class' AND contains(lower(name), '1') GROUP BY name
UNION ALL SELECT 'distribution', label, count(*) FROM nodes GROUP BY label""", "functions"))
def f09(t):
    one = t.functions.where(X.matches(F.col("name"), _Q)).groupBy(F.col("module").alias("name")).agg(F.count("*").alias("n")).withColumn("kind", F.lit("module"))
    two = t.nodes.where("label = 'Class'").where(X.matches(F.col("name"), "1")).groupBy("name").agg(F.count("*").alias("n")).withColumn("kind", F.lit("pattern"))
    three = t.nodes.groupBy(F.col("label").alias("name")).agg(F.count("*").alias("n")).withColumn("kind", F.lit("distribution"))
    return one.unionByName(two).unionByName(three).select("kind", "name", "n")


@query("f10_namespace_scope", sql("SELECT id, name FROM nodes WHERE namespace IS NULL OR namespace = 'Brand#2'", "nodes"))
def f10(t):
    return t.nodes.where(F.col("namespace").isNull() | (F.col("namespace") == "Brand#2")).select("id", "name")


_STOP = ", ".join(f"'{w}'" for w in X.STOPWORDS)


@query("f11_keyword_extraction", f"SELECT item_id, array_to_string(CASE WHEN len(f) = 0 THEN [text] ELSE f[1:5] END, ' ') AS keywords FROM (SELECT item_id, text, list_filter(regexp_extract_all(lower(text), '([a-z0-9_]+)', 1), lambda w: length(w) > 1 AND w NOT IN ({_STOP})) AS f FROM benchmark)")
def f11(t):
    return t.benchmark.select("item_id", F.array_join(X.keywords(F.col("text")), " ").alias("keywords"))


@query("f19_suppress_seen", sql("SELECT id, name FROM functions WHERE name NOT IN (SELECT p_name FROM part WHERE p_size < 5)", "functions"))
def f19(t):
    seen = t.part.where("p_size < 5").select(F.col("p_name").alias("name")).distinct()
    return t.functions.join(seen, "name", "left_anti").select("id", "name")


@query("f20_expiring_keys", "SELECT user_id, event_type, count(*) AS live FROM events WHERE event_type IN ('click', 'view') AND (user_id % 2 = 0 OR user_id < 10) AND ts + INTERVAL 3 DAY >= (SELECT max(ts) FROM events) GROUP BY ALL")
def f20(t):
    asof = t.events.agg(F.max("ts").alias("asof"))
    live = t.events.crossJoin(F.broadcast(asof)).where(F.col("ts") + F.expr("interval 3 days") >= F.col("asof"))  # one row
    return live.where("event_type in ('click', 'view') and (user_id % 2 = 0 or user_id < 10)").groupBy("user_id", "event_type").agg(F.count("*").alias("live"))


@query("f21_scoped_broker_search", "SELECT doc_id, source FROM documents WHERE lang = 'en' AND source IN ('src1', 'src2', 'src3') AND contains(lower(concat_ws(' ', source, text)), 'the')")
def f21(t):
    scoped = t.documents.where("lang = 'en'").where(F.col("source").isin("src1", "src2", "src3"))
    return scoped.where(X.matches(F.concat_ws(" ", "source", "text"), "the")).select("doc_id", "source")


_BANNED = {"shout": "!!", "license": "[Ll]icense", "digits": "[0-9]{6,}"}


@query("f22_forbidden_scan", "SELECT doc_id, line_no, rule FROM (SELECT doc_id, unnest(range(1, len(l) + 1)) AS line_no, unnest(l) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)), (VALUES ('shout', '!!'), ('license', '[Ll]icense'), ('digits', '[0-9]{6,}')) r(rule, pattern) WHERE NOT starts_with(ltrim(line), '#') AND regexp_matches(line, pattern)")
def f22(t):
    lines = t.documents.select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("p", "line")).where("not startswith(ltrim(line), '#')")
    hits = F.filter(F.array(*[F.when(F.col("line").rlike(p), F.lit(r)) for r, p in _BANNED.items()]), lambda x: x.isNotNull())
    return lines.select("doc_id", (F.col("p") + 1).cast("long").alias("line_no"), F.explode(hits).alias("rule"))


@query("f23_mask_sensitive", "SELECT event_id, CASE WHEN event_type IN ('purchase', 'signup') THEN '***' ELSE props END AS props FROM events")
def f23(t):
    record = F.create_map("event_type", "props")
    masked = F.transform_values(record, lambda k, v: F.when(k.rlike("^(purchase|signup)$"), "***").otherwise(v))
    return t.events.select("event_id", F.element_at(masked, F.col("event_type")).alias("props"))


@query("f24_path_filters", "SELECT page_id FROM pages WHERE len(list_intersect(string_split(url, '/'), ['blog', 'tags', 'en'])) = 0 AND NOT regexp_matches(url, '#')")
def f24(t):
    parts = F.split("url", "/", -1)
    return t.pages.where(~F.arrays_overlap(parts, X.strings(["blog", "tags", "en"])) & ~F.contains("url", F.lit("#"))).select("page_id")


_PREFIXES = [("http://", "plain"), ("https://", "secure"), ("https://blog.", "blog"), ("http://www.", "www")]


@query("f25_longest_prefix", "SELECT page_id, arg_max(ns, length(prefix)) AS namespace FROM pages JOIN (VALUES ('http://', 'plain'), ('https://', 'secure'), ('https://blog.', 'blog'), ('http://www.', 'www')) p(prefix, ns) ON starts_with(url, prefix) GROUP BY page_id")
def f25(t):
    best = F.lit(None).cast("string")
    for prefix, ns in sorted(_PREFIXES, key=lambda p: len(p[0])):
        best = F.when(F.startswith("url", F.lit(prefix)), ns).otherwise(best)
    return t.pages.select("page_id", best.alias("namespace")).where("namespace is not null")

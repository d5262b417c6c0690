"""Composite pipelines: search, context, reports, evidence; each one lazy program over the bindings."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import analytics as A
from ..operators import evidence as E
from ..operators import graph as G
from ..operators import learning as L
from ..operators import search as S
from ..operators import state as Z
from ..sources.bindings import sql
from ..sources.scratch import stored
from .catalog import query
from .graph import imports
from .intents import identifiers, rendered
from .search import LOCAL_SQL, local_search

_WORDS = ["red", "plate"]


@query("p04_knowledge_search", "SELECT p_partkey, round(score, 4) AS score FROM (SELECT p_partkey, (3 * len(list_intersect(['plate', 'red'], string_split(p_name, ' '))) / 2.0) * 1.2 AS score FROM part WHERE contains(p_name, 'red') OR contains(p_name, 'plate')) ORDER BY score DESC, p_partkey LIMIT 10")
def p04(t):
    found = t.part.where(X.any_keyword(F.col("p_name"), _WORDS)).withColumn("none", F.lit(""))
    return S.rerank(found, _WORDS, "p_name", "none", F.lit(1.2)).orderBy(F.desc("rerank"), "p_partkey").limit(10).select("p_partkey", F.round("rerank", 4).alias("score"))


@query("p05_smart_context", sql(", hits AS (SELECT name, label, id FROM nodes WHERE contains(lower(name), 'plate') UNION ALL SELECT name, label, id FROM nodes WHERE contains(lower(name), 'nation')) SELECT name, label, min(id) AS id, count(*) AS hits FROM hits GROUP BY ALL", "nodes"))
def p05(t):
    hits = F.array_compact(F.array(*[F.when(X.matches(F.col("name"), k), F.lit(k)) for k in ("plate", "nation")]))
    return t.nodes.select("name", "label", "id", F.explode(hits)).groupBy("name", "label").agg(F.min("id").alias("id"), F.count("*").alias("hits"))


def nearest(t, like: int, limit: int):
    """(id, score) of the functions whose vectors are nearest to that of number ``like``; ``limit`` rows, written once for all who use them."""
    best, _ = t.vectors.search(t.vector_of(like), limit)
    return stored(best.select(F.concat(F.lit("p"), "key").alias("id"), "score"))


def hybrid_search(t, word: str, near, limit: int = 20, weight: float = 0.6):
    """Keyword and vector results (``nearest``) fused by rank, the best row of each name with alternatives, and hotspot warnings.

    Vectors stand for functions of the same number; both lists are limited before they are ranked and joined.
    """
    found = S.keyword_search(t.functions, word, ["name"]).groupBy("name").agg(F.max("score").alias("score"), F.count("*").alias("n"))
    keyword = S.with_rank(found.orderBy(F.desc("score"), F.desc("n"), "name").limit(limit), F.desc("score"), F.desc("n"), "name")
    named = t.functions.select("id", "name").join(F.broadcast(near), "id").groupBy("name").agg(F.max("score").alias("score"))  # at most `limit` rows
    vector = S.with_rank(named, F.desc("score"), "name")
    return S.fuse(keyword, vector, weight, digits=6).orderBy(F.desc("rrf"), "name").limit(limit)


_COS = "list_sum(list_transform(list_zip(e.embedding, q.embedding), lambda z: CAST(z[1] AS DOUBLE) * z[2])) / (sqrt(list_sum(list_transform(e.embedding, lambda x: CAST(x AS DOUBLE) * x))) * sqrt(list_sum(list_transform(q.embedding, lambda x: CAST(x AS DOUBLE) * x))))"
_HYBRID = f""", kw AS (SELECT name, max(CASE WHEN name = 'plate' THEN 100 WHEN starts_with(name, 'plate') THEN 80 ELSE 60 END) AS score, count(*) AS n FROM functions WHERE contains(name, 'plate') GROUP BY name ORDER BY 2 DESC, 3 DESC, 1 LIMIT 20),
k AS (SELECT *, row_number() OVER (ORDER BY score DESC, n DESC, name) AS r FROM kw),
nn AS (SELECT 'p' || e.vec_id AS id, (1 + {_COS}) / 2 AS score FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 3) q ORDER BY score DESC, e.vec_id LIMIT 20),
v AS (SELECT name, row_number() OVER (ORDER BY max(nn.score) DESC, name) AS r FROM nn JOIN functions USING (id) GROUP BY name),
f AS (SELECT coalesce(k.name, v.name) AS name, round_even(coalesce(0.4 / (20 + k.r), 0) + coalesce(0.6 / (20 + v.r), 0) + CASE WHEN k.r IS NOT NULL AND v.r IS NOT NULL THEN 0.015 ELSE 0 END + CASE WHEN k.score >= 60 THEN 0.02 ELSE 0 END, 6) AS rrf FROM k FULL JOIN v ON k.name = v.name)"""


@query("p06_hybrid_search", sql(_HYBRID + " SELECT name, rrf FROM f ORDER BY rrf DESC, name LIMIT 20", "functions"))
def p06(t):
    return hybrid_search(t, "plate", nearest(t, 3, 20)).select("name", "rrf")


#: The names in two result lists: words that guardrails have, and words that none has, beside one guardrails' keyword.
_CONTEXTS = {"seen": "license the", "unseen": "src3 zzqx"}
_GUARD = """SELECT doc_id, ln(1 + (n - d0 + 0.5) / (d0 + 0.5)) * f0 * 2.2 / (f0 + 1.2 * (0.25 + 0.75 * dl / avgdl)) + ln(1 + (n - d1 + 0.5) / (d1 + 0.5)) * f1 * 2.2 / (f1 + 1.2 * (0.25 + 0.75 * dl / avgdl)) AS score FROM
 (SELECT doc_id, len(w) AS dl, len(list_filter(w, lambda x: x = '{0}')) AS f0, len(list_filter(w, lambda x: x = '{1}')) AS f1 FROM w),
 (SELECT count(*) AS n, avg(len(w)) AS avgdl, count(*) FILTER (WHERE list_contains(w, '{0}')) AS d0, count(*) FILTER (WHERE list_contains(w, '{1}')) AS d1 FROM w) WHERE f0 + f1 > 0"""


@query("p07_guardrails", "WITH w AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '([a-z0-9_]+)', 1) AS w FROM documents), "
    + ", ".join(f"{k} AS (SELECT '{k}' AS context, doc_id, 'fulltext' AS mode, score FROM ({_GUARD.format(*words.split())}) WHERE score > 0.5 ORDER BY round(score, 9) DESC, doc_id LIMIT 2)" for k, words in _CONTEXTS.items())
    + ", found AS (SELECT context, doc_id, mode FROM seen UNION ALL SELECT context, doc_id, mode FROM unseen), c AS (SELECT * FROM (VALUES " + ", ".join(f"('{k}', '{words}')" for k, words in _CONTEXTS.items()) + ") v(context, names))"
    + ", fallback AS (SELECT context, doc_id, row_number() OVER (PARTITION BY context ORDER BY doc_id) AS rn FROM c JOIN documents ON contains(names, lower(source)) WHERE context NOT IN (SELECT context FROM found))"
    + " SELECT * FROM found UNION ALL SELECT context, doc_id, 'keyword' FROM fallback WHERE rn <= 2")
def p07(t):
    """The two best guardrails of each context by full text, with a score above 0.5; a context without any gets two of
    those whose keyword, here their source, its names contain. All contexts are one search of the index."""
    found = stored(t.fulltext.search({k: words.split() for k, words in _CONTEXTS.items()}, 2).where("score > 0.5").select(F.col("query").alias("context"), F.col("key").alias("doc_id"), F.lit("fulltext").alias("mode")))
    have = {r.context for r in found.select("context").distinct().collect()}  # one row a context
    for context, names in _CONTEXTS.items():
        if context not in have:
            named = t.documents.where(F.contains(F.lit(names), F.lower("source"))).orderBy("doc_id").limit(2)
            found = found.unionByName(named.select(F.lit(context).alias("context"), "doc_id", F.lit("keyword").alias("mode")))
    return found


#: A prompt about the whole rests on keywords: the weight of vectors in its fusion.
_WHOLE = 0.2
_RAG = _HYBRID.replace("LIMIT 20", "LIMIT 30").replace("0.4 / (20", f"{1 - _WHOLE} / (20").replace("0.6 / (20", f"{_WHOLE} / (20") + """, h AS (SELECT name, row_number() OVER (ORDER BY rrf DESC, name) AS pos FROM (SELECT * FROM f ORDER BY rrf DESC, name LIMIT 15)),
s AS (SELECT functions.name, max(nn.score) AS score FROM (SELECT * FROM nn WHERE score >= 0.5 ORDER BY score DESC, id LIMIT 10) nn JOIN functions USING (id) GROUP BY 1),
u AS (SELECT coalesce(h.name, s.name) AS name, h.name IS NOT NULL AS hybrid, round(s.score, 6) AS similarity, row_number() OVER (ORDER BY h.pos IS NULL, h.pos, s.score DESC, s.name) AS pos FROM h FULL JOIN s ON h.name = s.name),
c AS (SELECT name, hybrid, similarity, pos, sum((length('[Function:' || name || ']') + 40) // 3) OVER (ORDER BY pos ROWS UNBOUNDED PRECEDING) AS used FROM u)
SELECT '[Function:' || name || ']' AS citation, CASE WHEN hybrid THEN 'hybrid' ELSE 'vector' END AS mode, similarity, CAST(used AS BIGINT) AS used FROM c WHERE used <= 400"""


@query("p08_rag_context", sql(_RAG, "functions"))
def p08(t):
    """Hybrid search (15) with vector search (10, similarity 0.5 or more): the first of a name wins and takes the other's
    similarity over; the context ends where its token budget does, and each item in it is a citation. Vectors are searched once."""
    close = nearest(t, 3, 30)
    hybrid = S.with_rank(hybrid_search(t, "plate", close, 30, _WHOLE).select("name", "rrf").orderBy(F.desc("rrf"), "name").limit(15), F.desc("rrf"), "name", rank="pos")
    best = close.where("score >= 0.5").orderBy(F.desc("score"), "id").limit(10)
    near = t.functions.select("id", "name").join(F.broadcast(best), "id").groupBy("name").agg(F.max("score").alias("score"))  # 10 rows
    merged = hybrid.join(near, "name", "full_outer").withColumn("late", F.col("pos").isNull())
    item = F.concat(F.lit("[Function:"), "name", F.lit("]"))
    costed = merged.select("late", "pos", "score", "name", item.alias("citation"), F.floor((F.length(item) + 40) / 3).alias("cost"), F.lit(1).alias("one"))
    fits = Z.budget_prefix(costed, "one", "cost", 400, "late", "pos", F.desc("score"), "name")  # 25 rows at most
    return fits.select("citation", F.when(F.col("late"), "vector").otherwise("hybrid").alias("mode"), F.round("score", 6).alias("similarity"), "used")


@query("p09_assist_context", sql(" SELECT f.id, f.name, count(DISTINCT g.id) AS siblings FROM functions f JOIN functions g ON f.module = g.module AND f.namespace = g.namespace AND f.id <> g.id GROUP BY ALL", "functions"))
def p09(t):
    sizes = t.functions.groupBy("module", "namespace").agg(F.count("*").alias("n")).where("n > 1")  # a sibling count needs no pairs
    return t.functions.join(sizes, ["module", "namespace"]).select("id", "name", (F.col("n") - 1).alias("siblings"))


@query("p10_test_inputs", sql(" SELECT f.id, least(10, coalesce(o.n, 0)) AS mocks, least(5, coalesce(i.n, 0)) AS callers FROM functions f LEFT JOIN (SELECT src, count(*) AS n FROM calls GROUP BY 1) o ON o.src = f.id LEFT JOIN (SELECT dst, count(*) AS n FROM calls GROUP BY 1) i ON i.dst = f.id", "functions", "calls"))
def p10(t):
    rows = t.functions.select("id").join(G.degrees(t.calls), "id", "left")
    at_most = lambda c, n: F.least(F.lit(n), F.coalesce(c, F.lit(0)))
    return rows.select("id", at_most("fan_out", 10).alias("mocks"), at_most("fan_in", 5).alias("callers"))


@query("p11_docs_extract", sql(", u AS (SELECT a.module, count(*) AS calls FROM calls JOIN functions a ON a.id = src GROUP BY 1) SELECT f.module, count(*) AS functions, count(DISTINCT name) AS names, coalesce(max(u.calls), 0) AS calls FROM functions f LEFT JOIN u ON u.module = f.module GROUP BY f.module", "functions", "calls"))
def p11(t):
    used = t.calls.join(t.functions.select(F.col("id").alias("src"), "module"), "src").groupBy("module").agg(F.count("*").alias("calls"))
    docs = t.functions.groupBy("module").agg(F.count("*").alias("functions"), F.countDistinct("name").alias("names"))
    return docs.join(used, "module", "left").select("module", "functions", "names", F.coalesce("calls", F.lit(0)).alias("calls"))


_REVERSE = """, walk AS (SELECT id AS target, id AS node, 0 AS d FROM functions WHERE end_line = 11 UNION SELECT w.target, c.src, w.d + 1 FROM walk w JOIN calls c ON c.dst = w.node WHERE w.d < 3),
hit AS (SELECT target, node, min(d) AS distance FROM walk WHERE node <> target GROUP BY ALL)"""


@query("p12_impact_report", sql(_REVERSE + " SELECT target, count(*) AS affected, max(distance) AS depth, count(DISTINCT f.namespace) AS namespaces FROM hit JOIN functions f ON f.id = node GROUP BY target", "functions", "calls", recursive=True))
def p12(t):
    hit = G.reach(t.calls, t.functions.where("end_line = 11"), 3, reverse=True).join(t.functions.select(F.col("id").alias("node"), "namespace"), "node")
    return hit.groupBy(F.col("start").alias("target")).agg(F.count("*").alias("affected"), F.max("distance").alias("depth"), F.countDistinct("namespace").alias("namespaces"))


@query("p13_health_report", sql(""", imports AS (SELECT DISTINCT a.module AS src, b.module AS dst FROM calls JOIN functions a ON a.id = src JOIN functions b ON b.id = dst WHERE a.module <> b.module)
 SELECT (SELECT count(*) FROM nodes WHERE id NOT IN (SELECT src FROM edges UNION SELECT dst FROM edges)) AS orphans, (SELECT count(*) FROM (SELECT name FROM functions GROUP BY name HAVING count(*) > 1)) AS duplicate_names,
 (SELECT count(*) FROM calls a JOIN calls b ON a.src = b.dst AND a.dst = b.src WHERE a.src < a.dst) AS call_cycles, (SELECT count(*) FROM imports a JOIN imports b ON a.src = b.dst AND a.dst = b.src WHERE a.src < a.dst) AS import_cycles""", "functions", "edges"))
def p13(t):
    ends = t.edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
    orphans = t.nodes.join(ends, "id", "left_anti").agg(F.count("*").alias("orphans"))
    names = t.functions.groupBy("name").count().where("count > 1").agg(F.count("*").alias("duplicate_names"))

    def cycles(edges, name):
        back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
        return edges.join(back, ["src", "dst"], "left_semi").where("src < dst").agg(F.count("*").alias(name))

    return orphans.crossJoin(names).crossJoin(cycles(t.calls, "call_cycles")).crossJoin(cycles(imports(t), "import_cycles"))  # one row each


@query("p14_global_insights", "SELECT vec_id, CASE WHEN label >= 7 THEN 'global' WHEN label >= 5 THEN 'candidate' WHEN label < 1 THEN 'anti' END AS kind FROM embeddings WHERE label >= 5 OR label < 1")
def p14(t):
    kind = F.when(F.col("label") >= 7, "global").when(F.col("label") >= 5, "candidate").when(F.col("label") < 1, "anti")
    return t.embeddings.select("vec_id", kind.alias("kind")).where("kind is not null")


@query("p15_feedback_loop", "SELECT user_id, round((p - 0.5 * n) / (p + n + 1), 4) AS relevance, p > n AS keep FROM (SELECT user_id, count(*) FILTER (WHERE event_type IN ('click', 'purchase')) AS p, count(*) FILTER (WHERE event_type = 'error') AS n FROM events GROUP BY user_id)")
def p15(t):
    g = t.events.groupBy("user_id").agg(F.count_if(F.col("event_type").isin("click", "purchase")).alias("p"), F.count_if(F.col("event_type") == "error").alias("n"))
    return g.select("user_id", F.round(L.dual_score(F.col("p"), F.col("n")), 4).alias("relevance"), (F.col("p") > F.col("n")).alias("keep"))


@query("p16_judge_feedback", "SELECT doc_id, 1 + 4 * quality - toxic AS score, CASE WHEN 1 + 4 * quality - toxic >= 4 THEN 'success' WHEN 1 + 4 * quality - toxic <= 2 THEN 'failure' END AS verdict FROM labels")
def p16(t):
    s = 1 + 4 * F.col("quality") - F.col("toxic")
    return t.labels.select("doc_id", s.alias("score"), F.when(s >= 4, "success").when(s <= 2, "failure").alias("verdict"))


@query("p17_dashboard_snapshot", sql(" SELECT label AS type, count(*) AS n, count(namespace) AS scoped, count(DISTINCT name) AS names FROM nodes GROUP BY label", "nodes"))
def p17(t):
    return t.nodes.groupBy(F.col("label").alias("type")).agg(F.count("*").alias("n"), F.count("namespace").alias("scoped"), F.countDistinct("name").alias("names"))


@query("p18_quality_report", "WITH c AS (SELECT event_type, count(*) AS n FROM events GROUP BY 1), e AS (SELECT -sum(n / t * log2(n / t)) / log2(count(*)) AS h FROM c, (SELECT sum(n) AS t FROM c)) SELECT event_type, round(n / sum(n) OVER (), 4) AS share, n / sum(n) OVER () < 0.05 AS rare, CASE WHEN h >= 0.8 THEN 'good' WHEN h >= 0.6 THEN 'fair' ELSE 'poor' END AS diversity FROM c, e")
def p18(t):
    c = t.events.groupBy("event_type").agg(F.count("*").alias("n"))
    share = F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(1)))  # one row per event type
    h = F.col("entropy")
    shares = c.select("event_type", share.alias("s")).crossJoin(F.broadcast(A.entropy(c)))  # one row
    return shares.select("event_type", F.round("s", 4).alias("share"), (F.col("s") < 0.05).alias("rare"), F.when(h >= 0.8, "good").when(h >= 0.6, "fair").otherwise("poor").alias("diversity"))


@query("p19_prompt_context", sql(" SELECT conv_id, turn, CASE WHEN contains(lower(text), 'the') THEN 'IMPLEMENT' WHEN contains(lower(text), 'der') THEN 'DEBUG' ELSE 'DESIGN' END AS intent, length(text) // 4 AS tokens FROM turns WHERE role = 'user'", "turns"))
def p19(t):
    has = lambda w: F.contains(F.lower("text"), F.lit(w))
    return t.turns.where("role = 'user'").select("conv_id", "turn", F.when(has("the"), "IMPLEMENT").when(has("der"), "DEBUG").otherwise("DESIGN").alias("intent"), X.token_estimate(F.col("text"), 4).alias("tokens"))


# Tools whose answers are contexts, and those whose answers hold references.
CONTEXT_TOOLS = ("search_knowledge", "hybrid_search", "smart_context", "get_function_context", "get_similar_code")
REFERENCE_TOOLS = ("hybrid_search", "get_function_context", "get_call_graph", "smart_context", "search_knowledge", "get_module_structure")
#: The tool that an event stands for; an error is a call that failed.
_TOOLS = {"view": "get_similar_code", "click": "hybrid_search", "purchase": "get_call_graph", "signup": "get_recent_nodes", "error": "hybrid_search"}


@query("p20_tool_events", sql(f""", o AS (SELECT src AS id, least(10, count(*)) AS calls, array_to_string(list_sort(list(dst))[1:10], ', ') AS l FROM calls GROUP BY 1),
 r AS (SELECT f.id, coalesce(calls, 0) AS calls, length('## 1. [Function] ' || name || chr(10) || '경로: `' || namespace || '.' || module || '.' || f.id || '`' || chr(10) || '호출: ' || coalesce(l, '')) AS chars FROM functions f LEFT JOIN o USING (id)),
 e AS (SELECT event_id, event_type <> 'error' AS success, CASE event_type {" ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _TOOLS.items())} END AS tool, chars, calls FROM events LEFT JOIN r ON id = 'p' || user_id)
 SELECT event_id, 'context_provided' AS kind, CAST(2 + calls AS BIGINT) AS amount FROM e WHERE success AND tool IN {CONTEXT_TOOLS} AND chars IS NOT NULL
 UNION ALL SELECT event_id, 'code_generation', coalesce(chars, 0) FROM e
 UNION ALL SELECT event_id, 'code_validation', calls FROM e WHERE success AND tool IN {REFERENCE_TOOLS} AND calls > 0""", "functions", "calls"))
def p20(t):
    """What a tool call is told of: a context with the identifiers in its answer, an attempt with the answer's length, references with the
    calls in it; a failed call has the attempt only, and an answer that holds nothing tells nothing."""
    answers = rendered(t).select("id", F.length("text").alias("chars"), F.size(identifiers("text")).alias("names"), "calls")
    tool = F.element_at(F.create_map(*[F.lit(x) for kv in _TOOLS.items() for x in kv]), F.col("event_type"))
    calls = t.events.select("event_id", (F.col("event_type") != "error").alias("success"), tool.alias("tool"), F.concat(F.lit("p"), "user_id").alias("id")).join(answers, "id", "left")
    told = lambda kind, when, amount: F.when(when, F.struct(F.lit(kind).alias("kind"), F.coalesce(amount, F.lit(0)).cast("long").alias("amount")))
    kinds = F.array_compact(F.array(
        told("context_provided", F.col("success") & F.col("tool").isin(*CONTEXT_TOOLS) & (F.col("names") > 0), F.col("names")),
        told("code_generation", F.lit(True), F.col("chars")),
        told("code_validation", F.col("success") & F.col("tool").isin(*REFERENCE_TOOLS) & (F.col("calls") > 0), F.col("calls")),
    ))
    return calls.select("event_id", F.explode(kinds).alias("k")).select("event_id", "k.*")


#: Who may ask: workspaces that opted in, each with the projects it may see (none: all), and those whose provider is down.
_SCOPES = {"en": ("src1", "src2", "src3"), "de": (), "fr": ("src1",)}
_DOWN = ("fr",)
_ALLOWED = "CASE lang " + " ".join(f"WHEN '{k}' THEN {f'source IN ({chr(44).join(chr(39) + x + chr(39) for x in v)})' if v else 'true'}" for k, v in _SCOPES.items()) + " ELSE false END"


@query("p21_audited_broker_query", f"""WITH asked AS (SELECT DISTINCT lang, source FROM documents WHERE lang IS NOT NULL AND source IS NOT NULL),
hits AS (SELECT lang, source, doc_id, row_number() OVER (PARTITION BY lang, source ORDER BY doc_id) AS rn FROM documents WHERE contains(lower(coalesce(text, '')), 'license'))
SELECT a.lang, a.source, CASE WHEN a.lang NOT IN ({", ".join(f"'{x}'" for x in _SCOPES)}) THEN 'not_enabled' WHEN NOT ok THEN 'out_of_scope' WHEN a.lang IN ('fr') THEN 'unavailable' ELSE 'succeeded' END AS status,
 count(h.doc_id) AS results, coalesce(string_agg(h.doc_id, ',' ORDER BY h.doc_id), '') AS items
FROM (SELECT lang, source, {_ALLOWED} AS ok FROM asked) a LEFT JOIN hits h ON h.lang = a.lang AND h.source = a.source AND rn <= 5 AND ok AND a.lang NOT IN ('fr') GROUP BY ALL""")
def p21(t):
    """Each workspace (a language) asks about each project (a source): the request is refused, the provider is down, or up
    to five hits of that scope come back; every request leaves an audit row."""
    docs = t.documents.where("lang is not null and source is not null")
    asked = docs.select("lang", "source").distinct()
    allowed = F.lit(False)
    for workspace, projects in _SCOPES.items():
        allowed = allowed | ((F.col("lang") == workspace) & (F.col("source").isin(*projects) if projects else F.lit(True)))
    enabled, down = F.col("lang").isin(*_SCOPES), F.col("lang").isin(*_DOWN)
    status = F.when(~enabled, "not_enabled").when(~allowed, "out_of_scope").when(down, "unavailable").otherwise("succeeded")
    audit = asked.withColumn("status", status)
    scoped = docs.where(allowed & ~down).where(X.matches(F.col("text"), "license")).select(F.struct("lang", "source").alias("scope"), "doc_id")
    hits = S.capped(scoped, "scope", "doc_id", 5, "items").select("scope.*", "items")
    joined = audit.join(hits, ["lang", "source"], "left")
    none = F.array().cast("array<bigint>")
    items = F.coalesce("items", none)
    return joined.select("lang", "source", "status", F.size(items).cast("long").alias("results"), F.array_join(items.cast("array<string>"), ",").alias("items"))


@query("p22_memory_lifecycle", "SELECT o_custkey, count(*) FILTER (WHERE o_orderstatus <> 'F') AS active, count(*) FILTER (WHERE o_orderstatus = 'F' AND o_orderdate < (SELECT max(o_orderdate) FROM orders) - INTERVAL 30 DAY) AS purged FROM orders GROUP BY o_custkey")
def p22(t):
    asof = F.broadcast(t.orders.agg(F.max("o_orderdate").alias("asof")))  # one row
    old = (F.col("o_orderstatus") == "F") & (F.col("o_orderdate") < F.col("asof") - F.expr("interval 30 days"))
    return t.orders.crossJoin(asof).groupBy("o_custkey").agg(F.count_if(F.col("o_orderstatus") != "F").alias("active"), F.count_if(old).alias("purged"))


def _tree_sql(name: str, source: str, group: str, key: str, content: list[str]) -> str:
    """A tree as ``operators.evidence`` makes it, with a fixed number of levels."""
    fields = " || ".join(f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')" for c in content)
    word = lambda at: f"CAST(sum(CAST(CAST('0x' || substr(h, {at}, 16) AS UBIGINT) AS HUGEINT)) % 18446744073709551616 AS VARCHAR)"
    parts = [
        f"{name}_h AS (SELECT {group}, {key} // {E.WIDTH} AS place, sha256({fields}) AS h FROM {source})",
        f"{name}_0 AS (SELECT {group}, place, count(*) AS rows, sha256(count(*) || ':' || {word(1)} || ':' || {word(17)}) AS digest FROM {name}_h GROUP BY {group}, place)",
    ]
    for k in range(E.LEVELS):
        parts.append(f"{name}_{k + 1} AS (SELECT {group}, place // {E.FANOUT} AS place, CAST(sum(rows) AS BIGINT) AS rows, sha256(string_agg((place % {E.FANOUT}) || ':' || digest, ',' ORDER BY place)) AS digest FROM {name}_{k} GROUP BY {group}, place // {E.FANOUT})")
    return ", ".join(parts)


_CONTENT = ["job_id", "owner", "status", "priority", "cents"]
_JOBS = "c AS (SELECT job_id, owner, status, priority, CAST(round(cost * 100) AS BIGINT) AS cents, year(requested_at) AS revision FROM jobs)"


def _jobs(t):
    """The jobs with their cost in whole cents, which prints alike everywhere, and the year of their request."""
    return t.jobs.select("job_id", "owner", "status", "priority", F.round(F.col("cost") * 100).cast("long").alias("cents"), F.year("requested_at").alias("revision"))


@query("p23_evidence_bundle", sql(", " + _JOBS + """, s AS (SELECT owner, revision, status, count(*) AS n FROM c GROUP BY ALL),
 g AS (SELECT owner, revision, count(*) AS stages, CAST(sum(n) AS BIGINT) AS jobs, CASE max(CASE status WHEN 'succeeded' THEN 1 WHEN 'running' THEN 2 ELSE 3 END) WHEN 1 THEN 'succeeded' WHEN 2 THEN 'running' ELSE 'queued' END AS worst FROM s GROUP BY ALL), """
 + _tree_sql("t", "c", "owner, revision", "job_id", _CONTENT) + f" SELECT g.*, t.digest, lag(t.digest) OVER (PARTITION BY g.owner ORDER BY g.revision) AS before FROM g JOIN t_{E.LEVELS} t USING (owner, revision)", "jobs"))
def p23(t):
    """A bundle for each owner and year: its stages and jobs, the worst of their states, the root of a tree over the content of its jobs, and
    the root of the bundle before it."""
    jobs = _jobs(t)
    stages = jobs.groupBy("owner", "revision", "status").agg(F.count("*").alias("n"))
    bundles = stages.groupBy("owner", "revision").agg(F.count("*").alias("stages"), F.sum("n").alias("jobs"), A.worst(F.col("status"), ["succeeded", "running", "queued"]).alias("worst"))
    found = bundles.join(E.roots_of(jobs, ["owner", "revision"], "job_id", _CONTENT).drop("rows"), ["owner", "revision"])
    return found.withColumn("before", F.lag("digest").over(Window.partitionBy("owner").orderBy("revision")))


#: The jobs a day later: some have ended, one in a while was withdrawn, and some are new.
_LATER = """l AS (SELECT job_id, owner, CASE WHEN job_id % 89 = 0 THEN 'succeeded' ELSE status END AS status, priority, cents FROM c WHERE job_id % 1009 <> 5
 UNION ALL SELECT job_id + 10000000, owner, 'queued', priority, cents FROM c WHERE job_id % 997 = 1)"""


@query("p23_evidence_diff", sql(", " + _JOBS + ", " + _LATER + ", " + _tree_sql("a", "c", "priority", "job_id", _CONTENT) + ", " + _tree_sql("b", "l", "priority", "job_id", _CONTENT)
 + f" SELECT priority, place * {E.WIDTH} AS first, place * {E.WIDTH} + {E.WIDTH - 1} AS last, coalesce(a.rows, 0) AS old_rows, coalesce(b.rows, 0) AS new_rows FROM a_0 a FULL JOIN b_0 b USING (priority, place) WHERE a.digest IS DISTINCT FROM b.digest", "jobs"))
def p23d(t):
    """Two revisions of the jobs compared by their trees: the ranges of jobs in which anything changed."""
    old = _jobs(t)
    ended = F.when(F.col("job_id") % 89 == 0, "succeeded").otherwise(F.col("status"))
    new = old.where("job_id % 1009 <> 5").withColumn("status", ended)
    more = old.where("job_id % 997 = 1").withColumn("job_id", F.col("job_id") + 10_000_000).withColumn("status", F.lit("queued"))
    trees = [E.tree(x, ["priority"], "job_id", _CONTENT) for x in (old, new.unionByName(more))]
    return E.differing(*trees, ["priority"])


@query("p24_staleness", sql(" SELECT owner, max(requested_at) + INTERVAL 1 SECOND < (SELECT max(requested_at) FROM jobs) AS stale FROM jobs GROUP BY owner", "jobs"))
def p24(t):
    asof = F.broadcast(t.jobs.agg(F.max("requested_at").alias("asof")))  # one row
    g = t.jobs.groupBy("owner").agg(F.max("requested_at").alias("newest")).crossJoin(asof)
    return g.select("owner", (F.col("newest") + F.expr("interval 1 second") < F.col("asof")).alias("stale"))


#: Of the purpose "review": its level, and a context's tokens at each level below that of whole sources.
_LEVEL, _TOKENS, _BUDGET = 3, (5, 20, 50, 100, 200), 800
_LEVELS = """, ends AS (SELECT src AS a, dst AS b FROM calls UNION SELECT dst, src FROM calls),
walk AS (SELECT id AS target, id AS node, 0 AS d FROM functions WHERE end_line = 11 UNION SELECT w.target, b, w.d + 1 FROM walk w JOIN ends ON a = w.node WHERE w.d < 2),
hit AS (SELECT target, node, min(d) AS d FROM walk GROUP BY ALL),
o AS (SELECT *, CASE d WHEN 0 THEN 4 WHEN 1 THEN 3 ELSE 2 END AS level, CASE d WHEN 0 THEN 200 WHEN 1 THEN 100 ELSE 50 END AS cost, row_number() OVER (PARTITION BY target ORDER BY d, node) AS rn FROM hit),
f AS (SELECT target, node, rn, level, 800 - cost AS left_ FROM o WHERE rn = 1
 UNION ALL SELECT o.target, o.node, o.rn, CASE WHEN left_ >= o.cost THEN o.level WHEN left_ >= 20 THEN 1 ELSE 0 END, left_ - CASE WHEN left_ >= o.cost THEN o.cost WHEN left_ >= 20 THEN 20 ELSE 0 END FROM f JOIN o ON o.target = f.target AND o.rn = f.rn + 1)"""


@query("p26_context_levels", sql(_LEVELS + " SELECT target, node, CAST(level AS BIGINT) AS level FROM f WHERE level > 0", "functions", "calls", recursive=True))
def p26(t):
    """A target with its callers and callees to depth 2, each at the level its distance asks for, at level 1 where the
    budget has no more room, or left out."""
    starts = t.functions.where("end_line = 11").select("id")
    both = t.calls.select("src", "dst").unionByName(t.calls.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    near = G.reach(both, starts, 2).select(F.col("start").alias("target"), "node", "distance")
    rows = near.unionByName(starts.select(F.col("id").alias("target"), F.col("id").alias("node"), F.lit(0).alias("distance")))
    level = F.when(F.col("distance") == 0, max(_LEVEL, 4)).when(F.col("distance") == 1, min(_LEVEL, 3)).otherwise(min(_LEVEL, 2))
    cost = F.element_at(F.array(*[F.lit(x) for x in _TOKENS]), level + 1)
    asked = rows.select("target", "distance", "node", level.alias("level"), cost.alias("cost"))
    return Z.ordered_fold(asked, "target", ["distance", "node"], (_BUDGET,), Z.downgrading(_TOKENS[1]), "node string, level long", Z.granted(_TOKENS[1]))


@query("p27_gate_decision", sql(" SELECT owner, CASE WHEN count(*) FILTER (WHERE status = 'queued' AND priority = '1-URGENT') > 0 THEN 'REJECTED' WHEN count(*) FILTER (WHERE status = 'queued') > 3 THEN 'NEEDS_WORK' ELSE 'APPROVED' END AS decision FROM jobs GROUP BY owner", "jobs"))
def p27(t):
    waits = F.col("status") == "queued"
    urgent = F.count_if(waits & (F.col("priority") == "1-URGENT"))
    return t.jobs.groupBy("owner").agg(F.when(urgent > 0, "REJECTED").when(F.count_if(waits) > 3, "NEEDS_WORK").otherwise("APPROVED").alias("decision"))


#: Rules of readiness: the mode they are for (empty: any), the setting that must be there, a setting and value that ask for it, and how grave it is.
_RULES = (
    ("managed", "url", "", "", "blocker"), ("managed", "secret", "", "", "blocker"), ("managed", "contact", "", "", "warning"), ("own", "folder", "", "", "blocker"),
    ("", "token", "channel", "enabled", "blocker"), ("", "token", "channel", "auto", "warning"), ("", "name", "channel", "enabled", "warning"),
)


def _settings(t):
    """(s_suppkey, env): the settings of a supplier's workspace."""
    n = F.col("s_suppkey")
    values = {
        "mode": F.when(n % 7 == 6, "other").when(n % 2 == 0, "managed").otherwise("own"), "channel": F.element_at(X.strings(["enabled", "auto", "off"]), (n % 3 + 1).cast("int")),
        "url": F.when(F.col("s_acctbal") >= 0, "https://"), "secret": F.when(F.col("s_acctbal") >= 2000, "set"), "contact": F.when(F.col("s_nationkey") < 12, "desk"),
        "folder": F.when(n % 5 != 0, "/data"), "token": F.when(n % 4 != 1, "t"), "name": F.when(n % 11 != 3, "bot"),
    }
    return t.supplier.select("s_suppkey", F.map_filter(F.create_map(*[x for k, v in values.items() for x in (F.lit(k), v)]), lambda _, v: v.isNotNull()).alias("env"))


_SETTINGS = """, s AS (SELECT s_suppkey AS n, CASE WHEN s_suppkey % 7 = 6 THEN 'other' WHEN s_suppkey % 2 = 0 THEN 'managed' ELSE 'own' END AS mode, ['enabled', 'auto', 'off'][s_suppkey % 3 + 1] AS channel,
 CASE WHEN s_acctbal >= 0 THEN 'https://' END AS url, CASE WHEN s_acctbal >= 2000 THEN 'set' END AS secret, CASE WHEN s_nationkey < 12 THEN 'desk' END AS contact, CASE WHEN s_suppkey % 5 <> 0 THEN '/data' END AS folder, CASE WHEN s_suppkey % 4 <> 1 THEN 't' END AS token,
 CASE WHEN s_suppkey % 11 <> 3 THEN 'bot' END AS name FROM supplier),
 v AS (SELECT n, mode, channel, unnest(['url', 'secret', 'contact', 'folder', 'token', 'name']) AS needs, unnest([url, secret, contact, folder, token, name]) AS value FROM s),
 rules(mode, needs, key, value, level) AS (VALUES """ + ", ".join(str(r) for r in _RULES) + """),
 broken AS (SELECT n, rules.needs || CASE WHEN key = '' THEN '' ELSE ':' || rules.value END AS what, level FROM rules JOIN v ON v.needs = rules.needs AND v.value IS NULL AND rules.mode IN ('', v.mode) AND (key = '' OR rules.value = channel) WHERE v.mode <> 'other')"""


@query("p28_readiness_blockers", sql(_SETTINGS + """ SELECT n AS s_suppkey, CASE WHEN mode = 'other' THEN 'invalid' WHEN count(what) FILTER (WHERE level = 'blocker') > 0 THEN mode || '-blocked' ELSE mode || '-ready' END AS status,
 CASE WHEN mode = 'other' THEN 'mode' ELSE coalesce(string_agg(what, ',' ORDER BY what) FILTER (WHERE level = 'blocker'), '') END AS blockers, coalesce(string_agg(what, ',' ORDER BY what) FILTER (WHERE level = 'warning'), '') AS warnings
 FROM s LEFT JOIN broken USING (n) GROUP BY n, mode"""))
def p28(t):
    """Each workspace's settings against the table of rules: what blocks it, what it is warned of, and its state; a mode that nobody knows is invalid."""
    rows = _settings(t).withColumn("mode", F.element_at("env", F.lit("mode")))
    broken = []
    for mode, needs, key, value, level in _RULES:
        asked = F.lit(True) if not key else F.element_at("env", F.lit(key)) == value
        here = F.lit(True) if not mode else F.col("mode") == mode
        text = needs + (f":{value}" if key else "")
        broken.append(F.when(here & asked & ~F.map_contains_key("env", needs), F.struct(F.lit(level).alias("level"), F.lit(text).alias("what"))))
    rows = rows.select("s_suppkey", "mode", F.array_compact(F.array(*broken)).alias("broken"))
    of = lambda level: F.array_join(F.array_sort(F.transform(F.filter("broken", lambda x: x["level"] == level), lambda x: x["what"])), ",")
    known = F.col("mode") != "other"
    blockers = F.when(known, of("blocker")).otherwise("mode")
    status = F.when(~known, "invalid").when(blockers != "", F.concat("mode", F.lit("-blocked"))).otherwise(F.concat("mode", F.lit("-ready")))
    return rows.select("s_suppkey", status.alias("status"), blockers.alias("blockers"), F.when(known, of("warning")).otherwise("").alias("warnings"))


@query("entry_local_search", sql(LOCAL_SQL, "functions", "calls"))
def flagship(t):
    found = local_search(t, "plate")
    return found.select("id", "name", "score", F.array_join("callees", ",").alias("callees"), F.array_join("callers", ",").alias("callers"))

"""Mutations, feedback, windows, ranking, sets and state over the given tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import analytics as A
from ..operators import learning as L
from ..operators import search as S
from ..operators import state as Z
from ..operators import structure as R
from ..sources.bindings import sql
from ..sources.scratch import folder
from ..sources.versions import VersionedTable
from .catalog import query

_ASOF = "(SELECT max(ts) FROM events)"


def _asof(t):
    """The newest event as a one-row table."""
    return F.broadcast(t.events.agg(F.max("ts").alias("asof")))


@query("m01_node_upsert", "SELECT p_partkey AS k, CASE WHEN p_partkey % 3 = 0 THEN upper(p_name) ELSE p_name END AS name FROM part")
def m01(t):
    """Nodes merged into a stored table: the second version has the changed ones' new properties."""
    old = t.part.select(F.col("p_partkey").alias("k"), F.col("p_name").alias("name"))
    table = VersionedTable(t.spark, folder(t.spark), "k", old.schema)
    table.create(old)
    table.merge(old.where("k % 3 = 0").select("k", F.upper("name").alias("name")))
    return table.read()


@query("m02_edge_upsert", sql("SELECT src, dst, type FROM calls", "calls"))
def m02(t):
    return t.calls.unionByName(t.calls).dropDuplicates(["src", "dst", "type"])


@query("m03_stale_removal", sql("SELECT src, dst FROM calls WHERE src NOT IN (SELECT 'p' || p_partkey FROM part WHERE p_size < 10) AND dst NOT IN (SELECT 'p' || p_partkey FROM part WHERE p_size < 10)", "calls"))
def m03(t):
    gone = t.functions.where("end_line < 10").select("id")
    return t.calls.join(gone, F.col("src") == F.col("id"), "left_anti").join(gone, F.col("dst") == F.col("id"), "left_anti").select("src", "dst")


@query("m04_replace_partition", "SELECT p_brand, count(*) AS n, sum(CASE WHEN p_brand = 'Brand#2' THEN 2 ELSE 1 END) AS version_sum FROM part GROUP BY p_brand")
def m04(t):
    rows = t.part.select("p_brand", "p_partkey")
    kept = rows.where("p_brand <> 'Brand#2'").withColumn("v", F.lit(1))
    return kept.unionByName(rows.where("p_brand = 'Brand#2'").withColumn("v", F.lit(2))).groupBy("p_brand").agg(F.count("*").alias("n"), F.sum("v").alias("version_sum"))


@query("m05_callee_resolution", sql(", own AS (SELECT name, namespace, min(id) AS id FROM functions GROUP BY ALL), other AS (SELECT name, min(id) AS id FROM functions GROUP BY name), want AS (SELECT id, namespace, 'red plate' AS callee FROM functions) SELECT w.id, coalesce(own.id, other.id) AS callee_id, own.id IS NOT NULL AS same_file FROM want w LEFT JOIN own ON own.name = callee AND own.namespace = w.namespace LEFT JOIN other ON other.name = callee", "functions"))
def m05(t):
    want = t.functions.select("id", "namespace", F.lit("red plate").alias("name"))
    own = t.functions.groupBy("name", "namespace").agg(F.min("id").alias("own"))
    other = t.functions.groupBy("name").agg(F.min("id").alias("other"))
    joined = want.join(own, ["name", "namespace"], "left").join(other, "name", "left")
    return joined.select("id", F.coalesce("own", "other").alias("callee_id"), F.col("own").isNotNull().alias("same_file"))


@query("m06_counter_with_history", "SELECT user_id, count(*) AS n, array_to_string(list(event_id ORDER BY ts, event_id)[-5:], ',') AS last_events FROM events GROUP BY user_id")
def m06(t):
    ranked = t.events.withColumn("rn", F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id"))))
    recent = F.array_sort(F.collect_list(F.when(F.col("rn") <= 5, F.struct((-F.col("rn")).alias("o"), "event_id"))))
    return ranked.groupBy("user_id").agg(F.count("*").alias("n"), F.array_join(F.transform(recent, lambda x: x["event_id"].cast("string")), ",").alias("last_events"))


@query("m07_access_bump", "SELECT user_id, count(*) AS accesses, max(ts) AS last_accessed FROM events WHERE event_type = 'view' GROUP BY user_id")
def m07(t):
    return t.events.where("event_type = 'view'").groupBy("user_id").agg(F.count("*").alias("accesses"), F.max("ts").alias("last_accessed"))


_FOLD = """WITH RECURSIVE e AS (SELECT user_id, event_type <> 'error' AS good, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events),
f AS (SELECT user_id, 0::BIGINT AS rn, 1.0::DOUBLE AS w FROM (SELECT DISTINCT user_id FROM events)
UNION ALL SELECT e.user_id, e.rn, CASE WHEN good THEN least(w + 0.2, 2.0) ELSE greatest(w - 0.1, 0.1) END FROM f JOIN e ON e.user_id = f.user_id AND e.rn = f.rn + 1)
SELECT user_id, round(arg_max(w, rn), 4) AS weight FROM f GROUP BY user_id"""


@query("m08_clamped_weight_fold", _FOLD)
def m08(t):
    return L.folded_weights(t.events, "user_id", ["ts", "event_id"], F.col("event_type") != "error").select("user_id", F.round("weight", 4).alias("weight"))


@query("m09_dual_score", "SELECT user_id, p, n, round((p - 0.5 * n) / (p + n + 1), 4) AS relevance FROM (SELECT user_id, count(*) FILTER (WHERE event_type = 'purchase') * 2 + count(*) FILTER (WHERE event_type = 'click') AS p, count(*) FILTER (WHERE event_type = 'error') AS n FROM events GROUP BY user_id)")
def m09(t):
    c = lambda k: F.count_if(F.col("event_type") == k)
    g = t.events.groupBy("user_id").agg((c("purchase") * 2 + c("click")).alias("p"), c("error").alias("n"))
    return g.withColumn("relevance", F.round(L.dual_score(F.col("p"), F.col("n")), 4))


@query("m10_intent_penalties", "SELECT user_id, CAST(sum(CASE event_type WHEN 'error' THEN 1.5 WHEN 'view' THEN 0.3 ELSE 1.0 END) AS DOUBLE) AS penalty FROM events GROUP BY user_id")
def m10(t):
    rate = F.when(F.col("event_type") == "error", 15).when(F.col("event_type") == "view", 3).otherwise(10)
    return t.events.groupBy("user_id").agg((F.sum(rate) / 10.0).alias("penalty"))


@query("m11_deletion_penalty", "SELECT conv_id, sum(CASE WHEN prev IS NOT NULL AND NOT list_has_all(w, prev) THEN 2.0 ELSE 0.0 END)::DOUBLE AS penalty FROM (SELECT conv_id, w, lag(w) OVER (PARTITION BY conv_id ORDER BY turn) AS prev FROM (SELECT conv_id, turn, list_distinct(regexp_extract_all(lower(coalesce(text, '')), '([a-z0-9_]+)', 1)) AS w FROM conversations)) GROUP BY conv_id")
def m11(t):
    """Every word of the turn before is looked for: one that is gone costs the penalty."""
    rows = t.conversations.select("conv_id", "turn", F.array_distinct(X.tokens(F.col("text"))).alias("w"))
    before = rows.withColumn("prev", F.lag("w").over(Window.partitionBy("conv_id").orderBy("turn")))
    lost = F.col("prev").isNotNull() & (F.size(F.array_except("prev", "w")) > 0)
    return before.groupBy("conv_id").agg(F.sum(F.when(lost, 2.0).otherwise(0.0)).alias("penalty"))


@query("m12_co_use", "SELECT a, b, count(*) AS n FROM (SELECT event_type AS a, unnest([lead(event_type, 1) OVER w, lead(event_type, 2) OVER w, lead(event_type, 3) OVER w]) AS b FROM (SELECT *, ts AS t2 FROM events) WINDOW w AS (PARTITION BY user_id ORDER BY event_id)) WHERE b IS NOT NULL AND a <> b GROUP BY ALL")
def m12(t):
    return L.co_use(t.events, "user_id", "event_id", "event_type")


@query("m13_last_writer", "SELECT user_id, event_type, arg_max(value, {'t': ts, 'e': event_id}) AS value, max(ts) AS published_at FROM events GROUP BY ALL")
def m13(t):
    return t.events.groupBy("user_id", "event_type").agg(F.max_by("value", F.struct("ts", "event_id")).alias("value"), F.max("ts").alias("published_at"))


@query("m14_expiry_purge", f"SELECT event_id FROM events WHERE ts + to_seconds(CAST(value * 3600 AS INT)) >= {_ASOF}")
def m14(t):
    until = F.expr("unix_micros(cast(ts as timestamp)) + cast(round(value * 3600) as bigint) * 1000000")
    return t.events.crossJoin(_asof(t)).where(until >= F.unix_micros(F.col("asof").cast("timestamp"))).select("event_id")


@query("m15_label_promotion", "SELECT vec_id, CASE WHEN label >= 7 THEN 'GLOBAL' ELSE 'LOCAL' END AS scope FROM embeddings")
def m15(t):
    return t.embeddings.select("vec_id", F.when(F.col("label") >= 7, "GLOBAL").otherwise("LOCAL").alias("scope"))


@query("m16_auto_promotion", "SELECT user_id FROM (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn <= 3 GROUP BY user_id HAVING count(*) = 3 AND bool_and(event_type <> 'error')")
def m16(t):
    last = t.events.withColumn("rn", F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id")))).where("rn <= 3")
    return last.groupBy("user_id").agg(F.count("*").alias("n"), F.every(F.col("event_type") != "error").alias("ok")).where("n = 3 and ok").select("user_id")


@query("m17_archive_deleted", "SELECT page_id, url = (SELECT min(url) FROM pages) OR contains(url, 'blog') AS archived FROM pages")
def m17(t):
    first = F.broadcast(t.pages.agg(F.min("url").alias("gone")))  # one row
    return t.pages.select("page_id", "url").crossJoin(first).select("page_id", ((F.col("url") == F.col("gone")) | F.contains("url", F.lit("blog"))).alias("archived"))


@query("m18_orphan_delete", sql("SELECT id FROM nodes WHERE id IN (SELECT src FROM edges UNION SELECT dst FROM edges)", "nodes", "edges"))
def m18(t):
    ends = t.edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
    return t.nodes.join(ends, "id", "left_semi").select("id")


@query("m19_conflict_update", "SELECT c_custkey, c_acctbal + coalesce(paid, 0) AS balance FROM customer LEFT JOIN (SELECT o_custkey, count(*) * 1.0 AS paid FROM orders WHERE o_orderstatus = 'F' GROUP BY 1) ON o_custkey = c_custkey")
def m19(t):
    """Balances in a stored table; where a customer has one, what was paid is added to it."""
    held = t.customer.select("c_custkey", F.col("c_acctbal").cast("double").alias("balance"))
    paid = t.orders.where("o_orderstatus = 'F'").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").cast("double").alias("balance"))
    table = VersionedTable(t.spark, folder(t.spark), "c_custkey", held.schema)
    table.create(held)
    table.merge(paid.join(held.select("c_custkey"), "c_custkey", "left_semi"), {"balance": F.col("old.balance") + F.col("new.balance")})
    return table.read()


@query("m20_monotonic_cursor", "SELECT event_type, max(event_id) AS cursor FROM events GROUP BY event_type")
def m20(t):
    return t.events.groupBy("event_type").agg(F.max("event_id").alias("cursor"))


@query("m21_revision_numbers", "SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS revision FROM events")
def m21(t):
    return Z.revisions(t.events, "user_id", "ts", "event_id").select("event_id", "revision")


@query("m22_soft_delete", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'deleted' ELSE 'active' END AS state, CASE WHEN o_orderstatus = 'F' THEN o_orderdate + INTERVAL 30 DAY END AS purge_after FROM orders")
def m22(t):
    gone = F.col("o_orderstatus") == "F"
    return t.orders.select("o_orderkey", F.when(gone, "deleted").otherwise("active").alias("state"), F.when(gone, F.col("o_orderdate") + F.expr("interval 30 days")).alias("purge_after"))


@query("m23_purge_from_arrays", "SELECT l_orderkey, array_to_string(list_sort(list_distinct(list_filter(list(l_partkey), lambda x: x % 7 <> 0))), ',') AS parts FROM lineitem GROUP BY l_orderkey")
def m23(t):
    kept = F.array_sort(F.collect_set("l_partkey"))
    return t.lineitem.groupBy("l_orderkey").agg(F.array_join(F.filter(kept, lambda x: x % 7 != 0).cast("array<string>"), ",").alias("parts"))


#: The tables that name an owner, and the column.
_OWNED = {"customer": "c_custkey", "orders": "o_custkey", "events": "user_id", "conversations": "conv_id", "labels": "doc_id"}
_MERGED = "SELECT c_custkey AS c, c_custkey - 1 AS target FROM customer WHERE c_custkey % 10 = 1"


@query("m24_identity_merge", f"WITH m AS ({_MERGED}) " + " UNION ALL ".join(f"SELECT '{x}' AS kind, coalesce(target, {c}) AS owner, count(*) AS n FROM {x} LEFT JOIN m ON m.c = {c} GROUP BY ALL" for x, c in _OWNED.items()))
def m24(t):
    """One identity goes over into another in five tables."""
    merged = t.customer.where("c_custkey % 10 = 1").select(F.col("c_custkey").alias("owner"), (F.col("c_custkey") - 1).alias("target"))
    rows = [getattr(t, x).select(F.lit(x).alias("kind"), F.col(c).cast("long").alias("owner")) for x, c in _OWNED.items()]
    every = rows[0]
    for more in rows[1:]:
        every = every.unionByName(more)
    counts = every.groupBy("kind", "owner").agg(F.count("*").alias("n"))  # combined first, so that few rows meet the mapping
    return counts.join(merged, "owner", "left").groupBy("kind", F.coalesce("target", "owner").alias("owner")).agg(F.sum("n").alias("n"))


@query("m25_version_conflicts", "SELECT o_orderkey, CASE WHEN v IS NULL AND base = 0 THEN 'created' WHEN v = base THEN 'updated' WHEN force THEN 'forced' ELSE 'conflict' END AS outcome, CASE WHEN coalesce(v, 0) = base OR force THEN coalesce(v, 0) + 1 ELSE v END AS version FROM (SELECT o_orderkey, o_orderkey % 4 AS base, o_orderstatus = 'P' AS force FROM orders) LEFT JOIN (SELECT l_orderkey, CAST(max(l_linenumber) AS BIGINT) AS v FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1) ON l_orderkey = o_orderkey")
def m25(t):
    """A write names the version it was made from; another stored one is a conflict unless the write is forced."""
    held = t.lineitem.where("l_returnflag = 'R'").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.max("l_linenumber").cast("long").alias("v"))
    asked = t.orders.select("o_orderkey", (F.col("o_orderkey") % 4).alias("base"), (F.col("o_orderstatus") == "P").alias("force"))
    return Z.versioned(asked.join(held, "o_orderkey", "left"), "v", "base", "force").select("o_orderkey", "outcome", "version")


#: Revisions in one row of an export.
_PAGE = 256


@query("m26_nested_export", "WITH r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role) AS v FROM conversations), s AS (SELECT conv_id, string_agg('\"' || role || '\"', ',' ORDER BY role) AS sources FROM (SELECT DISTINCT conv_id, role FROM conversations) GROUP BY conv_id) "
    + f"SELECT conv_id, CAST((v - 1) // {_PAGE} AS BIGINT) AS page, '{{\"conv_id\":' || conv_id || ',\"page\":' || ((v - 1) // {_PAGE}) || ',\"sources\":[' || any_value(sources) || '],\"revisions\":[' || string_agg('{{\"version\":' || v || ',\"turn\":' || turn || ',\"role\":\"' || role || '\",\"chars\":' || length(text) || '}}', ',' ORDER BY v) || ']}}' AS item FROM r JOIN s USING (conv_id) GROUP BY conv_id, (v - 1) // {_PAGE}")
def m26(t):
    """An item with the sources it came from and its revisions, as JSON; an item with very many has several pages, so no row grows with it.
    The texts stay out."""
    sources = t.conversations.select("conv_id", "role").distinct().groupBy("conv_id").agg(F.array_sort(F.collect_list("role")).alias("sources"))  # kinds of speakers
    rows = Z.revisions(t.conversations.select("conv_id", "turn", "role", F.length("text").alias("chars")), "conv_id", "turn", "role")
    revision = F.struct(F.col("revision").alias("version"), "turn", "role", "chars")
    pages = rows.groupBy("conv_id", F.floor((F.col("revision") - 1) / _PAGE).alias("page")).agg(F.array_sort(F.collect_list(revision)).alias("revisions"))
    return pages.join(sources, "conv_id").select("conv_id", "page", F.to_json(F.struct("conv_id", "page", "sources", "revisions")).alias("item"))


@query("m29_backfill_batches", "SELECT doc_id, (row_number() OVER (ORDER BY doc_id) - 1) // 100 AS batch FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)")
def m29(t):
    todo = t.documents.select("doc_id").join(t.embeddings, F.col("doc_id") == F.col("vec_id"), "left_anti")
    return Z.numbered(todo, "doc_id").select("doc_id", F.floor(F.col("number") / 100).alias("batch"))


# Windows and budgets.


@query("w01_rank_in_list", "SELECT p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS rank FROM part")
def w01(t):
    return t.part.select("p_partkey", F.row_number().over(Window.partitionBy("p_brand").orderBy(F.desc("p_retailprice"), "p_partkey")).alias("rank"))


@query("w02_last_three", "SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn <= 3")
def w02(t):
    return t.events.withColumn("rn", F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id")))).where("rn <= 3").select("user_id", "event_id")


@query("w03_next_version", "SELECT o_custkey, max(o_orderkey) AS latest, count(*) + 1 AS next_version FROM orders GROUP BY o_custkey")
def w03(t):
    return t.orders.groupBy("o_custkey").agg(F.max("o_orderkey").alias("latest"), (F.count("*") + 1).alias("next_version"))


@query("w04_transitions", sql(", p AS (SELECT *, lag(intent) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM turns) SELECT before, intent, count(*) AS n FROM p WHERE before IS NOT NULL AND before <> intent GROUP BY ALL", "turns"))
def w04(t):
    before = F.lag("intent").over(Window.partitionBy("conv_id").orderBy("turn"))
    return t.turns.select(before.alias("before"), "intent").where("before is not null and before <> intent").groupBy("before", "intent").agg(F.count("*").alias("n"))


@query("w05_bounded_recency", "SELECT event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY event_id DESC) AS rn FROM events) WHERE rn <= 20")
def w05(t):
    return t.events.withColumn("rn", F.row_number().over(Window.partitionBy("event_type").orderBy(F.desc("event_id")))).where("rn <= 20").select("event_type", "event_id")


@query("w06_first_last_turn", sql("SELECT conv_id, intent, min(turn) AS first_turn, max(turn) AS last_turn, count(*) AS n FROM turns GROUP BY ALL", "turns"))
def w06(t):
    return t.turns.groupBy("conv_id", "intent").agg(F.min("turn").alias("first_turn"), F.max("turn").alias("last_turn"), F.count("*").alias("n"))


@query("w07_budget_prefix", "SELECT conv_id, turn, used FROM (SELECT conv_id, turn, sum(length(text) // 3) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS used FROM conversations) WHERE used <= 400")
def w07(t):
    costed = t.conversations.select("conv_id", "turn", X.token_estimate(F.col("text")).alias("cost"))
    return Z.budget_prefix(costed, "conv_id", "cost", 400, "turn").select("conv_id", "turn", "used")


@query("w08_greedy_budget", "WITH RECURSIVE c AS (SELECT conv_id, length(text) // 3 AS cost, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rn FROM conversations), f AS (SELECT conv_id, 0::BIGINT AS rn, 0::BIGINT AS used, 0 AS n FROM (SELECT DISTINCT conv_id FROM c) UNION ALL SELECT c.conv_id, c.rn, CASE WHEN used + cost <= 300 THEN used + cost ELSE used END, CASE WHEN used + cost <= 300 THEN n + 1 ELSE n END FROM f JOIN c ON c.conv_id = f.conv_id AND c.rn = f.rn + 1) SELECT conv_id, arg_max(n, rn) AS fitted FROM f GROUP BY conv_id")
def w08(t):
    costs = t.conversations.select("conv_id", "turn", X.token_estimate(F.col("text")).alias("cost"))
    return Z.ordered_fold(costs, "conv_id", ["turn"], (0, 0), Z.greedy(300), "used long, fitted long").select("conv_id", "fitted")


@query("w09_section_budget", "SELECT conv_id, CASE WHEN a <= 100 THEN a ELSE 0 END + CASE WHEN CASE WHEN a <= 100 THEN a ELSE 0 END + b <= 100 THEN b ELSE 0 END AS used FROM (SELECT conv_id, coalesce(max(CASE WHEN turn = 0 THEN length(text) // 3 END), 0) AS a, coalesce(max(CASE WHEN turn = 1 THEN length(text) // 3 END), 0) AS b FROM conversations GROUP BY conv_id)")
def w09(t):
    part = lambda k: F.coalesce(F.max(F.when(F.col("turn") == k, X.token_estimate(F.col("text")))), F.lit(0))
    g = t.conversations.groupBy("conv_id").agg(part(0).alias("a"), part(1).alias("b"))
    first = F.when(F.col("a") <= 100, F.col("a")).otherwise(0)
    return g.select("conv_id", (first + F.when(first + F.col("b") <= 100, F.col("b")).otherwise(0)).alias("used"))


@query("w10_share_of_ideal", "SELECT lang, round(n / sum(n) OVER () * count(*) OVER (), 4) AS share FROM (SELECT lang, count(*) AS n FROM documents GROUP BY lang)")
def w10(t):
    w = Window.partitionBy(F.lit(1))  # over a handful of languages
    return t.documents.groupBy("lang").agg(F.count("*").alias("n")).select("lang", F.round(F.col("n") / F.sum("n").over(w) * F.count("*").over(w), 4).alias("share"))


@query("w11_first_of_key", "SELECT p_name, min(p_partkey) AS first_key FROM part GROUP BY p_name")
def w11(t):
    return t.part.groupBy("p_name").agg(F.min("p_partkey").alias("first_key"))


# Sorts, ranking, sets.


@query("t01_tier_order", "SELECT p_partkey, tier FROM (SELECT p_partkey, p_name, CASE WHEN starts_with(p_name, 'red') THEN 80 WHEN contains(p_name, 'plate') THEN 60 ELSE 40 END AS tier FROM part) ORDER BY tier DESC, p_name, p_partkey LIMIT 25")
def t01(t):
    tier = F.when(F.startswith("p_name", F.lit("red")), 80).when(F.contains("p_name", F.lit("plate")), 60).otherwise(40)
    return t.part.select("p_partkey", "p_name", tier.alias("tier")).orderBy(F.desc("tier"), "p_name", "p_partkey").limit(25).select("p_partkey", "tier")


@query("t02_null_aware_order", "SELECT c_custkey FROM (SELECT c_custkey, (SELECT max(o_orderdate) FROM orders WHERE o_custkey = c_custkey) AS d FROM customer) ORDER BY coalesce(d, TIMESTAMP '1970-01-01') DESC, c_custkey LIMIT 30")
def t02(t):
    last = t.orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_orderdate").alias("d"))
    return t.customer.select("c_custkey").join(last, "c_custkey", "left").orderBy(F.coalesce("d", F.lit("1970-01-01").cast("timestamp_ntz")).desc(), "c_custkey").limit(30).select("c_custkey")


@query("t03_priority_pick", sql("SELECT owner, arg_min(job_id, {'p': CASE status WHEN 'running' THEN 0 WHEN 'queued' THEN 1 ELSE 2 END, 'j': job_id}) AS job_id FROM jobs GROUP BY owner", "jobs"))
def t03(t):
    p = F.when(F.col("status") == "running", 0).when(F.col("status") == "queued", 1).otherwise(2)
    return t.jobs.groupBy("owner").agg(F.min_by("job_id", F.struct(p.alias("p"), "job_id")).alias("job_id"))


@query("t04_queue_order", sql("SELECT job_id FROM jobs WHERE status = 'queued' ORDER BY priority, requested_at, job_id LIMIT 100", "jobs"))
def t04(t):
    return t.jobs.where("status = 'queued'").orderBy("priority", "requested_at", "job_id").limit(100).select("job_id")


@query("t05_overfetch_then_filter", "SELECT p_partkey FROM part WHERE p_size > 25 ORDER BY p_retailprice DESC, p_partkey LIMIT 10")
def t05(t):
    return t.part.where("p_size > 25").orderBy(F.desc("p_retailprice"), "p_partkey").limit(10).select("p_partkey")


@query("t06_keyword_rerank", "SELECT p_partkey, round((3 * len(list_intersect(['plate', 'red'], string_split(p_name, ' '))) / 2.0 + len(list_intersect(['plate', 'red'], string_split(lower(p_type), ' '))) / 2.0) * CASE WHEN p_size > 25 THEN 1.2 ELSE 1.1 END, 4) AS score FROM part")
def t06(t):
    kind = F.when(F.col("p_size") > 25, 1.2).otherwise(1.1)
    return S.rerank(t.part, ["red", "plate"], "p_name", "p_type", kind).select("p_partkey", F.round("rerank", 4).alias("score"))


_LISTS = """WITH k AS (SELECT p_name AS name, max(p_size) AS score FROM part GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 40), kr AS (SELECT *, row_number() OVER (ORDER BY score DESC, name) AS r FROM k), v AS (SELECT p_name AS name, count(*) AS score FROM part WHERE contains(p_name, 'plate') OR contains(p_name, 'rod') GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 40), vr AS (SELECT *, row_number() OVER (ORDER BY score DESC, name) AS r FROM v)
SELECT coalesce(kr.name, vr.name) AS name, round_even(coalesce(0.4 / (20 + kr.r), 0) + coalesce(0.6 / (20 + vr.r), 0) + CASE WHEN kr.r IS NOT NULL AND vr.r IS NOT NULL THEN 0.015 ELSE 0 END + CASE WHEN kr.score >= 49 THEN 0.02 ELSE 0 END, 7) AS rrf FROM kr FULL JOIN vr ON kr.name = vr.name"""


@query("t07_rank_fusion", _LISTS)
def t07(t):
    """Two result lists of twice the result's limit, as a search fetches them, then fused by rank."""
    best = lambda rows: rows.orderBy(F.desc("score"), "name").limit(40)
    k = best(t.part.groupBy(F.col("p_name").alias("name")).agg(F.max("p_size").alias("score")))
    v = best(t.part.where("contains(p_name, 'plate') or contains(p_name, 'rod')").groupBy(F.col("p_name").alias("name")).agg(F.count("*").alias("score")))
    left = S.with_rank(k, F.desc("score"), "name").withColumn("score", F.col("score") + 11)
    return S.fuse(left, S.with_rank(v, F.desc("score"), "name"), 0.6, digits=7).select("name", "rrf")


@query("t08_boost_order", "SELECT p_partkey, round_even(p_size * (CASE WHEN p_brand = 'Brand#2' THEN 1.5 WHEN p_type = 'ECONOMY' THEN 1.2 ELSE 1.0 END) * (CASE WHEN p_retailprice < 1000 THEN 0.3 ELSE 1.0 END), 6) AS boosted FROM part")
def t08(t):
    return t.part.select("p_partkey", S.boost(F.col("p_size").cast("double"), F.col("p_brand"), "Brand#2", F.col("p_retailprice") < 1000, F.col("p_type") == "ECONOMY").alias("boosted"))


@query("t09_grouped_dedup", sql(", r AS (SELECT name, id, row_number() OVER (PARTITION BY name ORDER BY end_line DESC, id) AS rn FROM functions) SELECT name, max(CASE WHEN rn = 1 THEN id END) AS id, coalesce(string_agg(CASE WHEN rn IN (2, 3) THEN id END, ',' ORDER BY rn), '') AS alternatives FROM r WHERE rn <= 3 GROUP BY name", "functions"))
def t09(t):
    best = S.best_of_name(t.functions.select("name", "id", "end_line"), "name", F.desc("end_line"), "id")
    return best.select("name", "id", F.array_join("alternatives", ",").alias("alternatives"))


@query("t10_action_plan", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O' ORDER BY o_orderpriority, o_totalprice, o_orderkey LIMIT 50")
def t10(t):
    return t.orders.where("o_orderstatus = 'O'").orderBy("o_orderpriority", "o_totalprice", "o_orderkey").limit(50).select("o_orderkey")


@query("t11_item_relevance", "SELECT p_partkey, round(s, 4) AS relevance, CASE WHEN s >= 0.5 THEN 'HIGH' WHEN s >= 0.25 THEN 'MEDIUM' ELSE 'LOW' END AS quality FROM (SELECT p_partkey, CASE WHEN p_name = 'red plate' THEN 0.5 WHEN starts_with(p_name, 'red') THEN 0.3 WHEN contains(p_name, 'plate') THEN 0.15 ELSE 0 END + 0.3 * CAST(contains(p_name, 'rod') AS INT) + CASE WHEN p_type = 'ECONOMY' THEN 0.1 ELSE 0.05 END AS s FROM part)")
def t11(t):
    n = F.col("p_name")
    target = F.when(n == "red plate", 0.5).when(F.startswith(n, F.lit("red")), 0.3).when(F.contains(n, F.lit("plate")), 0.15).otherwise(0.0)
    s = target + 0.3 * F.contains(n, F.lit("rod")).cast("int") + F.when(F.col("p_type") == "ECONOMY", 0.1).otherwise(0.05)
    return t.part.select("p_partkey", F.round(s, 4).alias("relevance"), F.when(F.round(s, 9) >= 0.5, "HIGH").when(F.round(s, 9) >= 0.25, "MEDIUM").otherwise("LOW").alias("quality"))


@query("t12_intent_budgets", "SELECT doc_id, lang, left(text, CASE lang WHEN 'en' THEN 120 WHEN 'de' THEN 80 ELSE 40 END) AS doc FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS rn FROM documents) WHERE rn <= CASE lang WHEN 'en' THEN 7 WHEN 'de' THEN 5 ELSE 3 END")
def t12(t):
    pick = lambda a, b, c: F.when(F.col("lang") == "en", a).when(F.col("lang") == "de", b).otherwise(c)
    short = t.documents.select("doc_id", "lang", F.left("text", pick(120, 80, 40)).alias("doc"))
    # the greatest budget is a number, so each task keeps that many rows of a language before any moves
    ranked = short.withColumn("rn", F.row_number().over(Window.partitionBy("lang").orderBy("doc_id"))).where(F.col("rn") <= 7)
    return ranked.where(F.col("rn") <= pick(7, 5, 3)).select("doc_id", "lang", "doc")


@query("u01_heterogeneous_union", "SELECT p_name AS name, p_brand AS brand, NULL::DOUBLE AS balance FROM part WHERE p_size = 1 UNION ALL SELECT s_name, NULL, s_acctbal FROM supplier")
def u01(t):
    a = t.part.where("p_size = 1").select(F.col("p_name").alias("name"), F.col("p_brand").alias("brand"))
    return a.unionByName(t.supplier.select(F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance")), allowMissingColumns=True)


@query("u02_union_first_wins", "SELECT name, min(pos) AS pos FROM (SELECT p_name || ' ' || p_size AS name, 0 AS pos FROM part WHERE p_brand < 'Brand#2' UNION ALL SELECT p_name || ' ' || p_size, 1 FROM part WHERE p_brand >= 'Brand#2') GROUP BY name")
def u02(t):
    name = F.concat_ws(" ", "p_name", "p_size").alias("name")
    a = t.part.where("p_brand < 'Brand#2'").select(name, F.lit(0).alias("pos"))
    return a.unionAll(t.part.where("p_brand >= 'Brand#2'").select(name, F.lit(1))).groupBy("name").agg(F.min("pos").alias("pos"))


@query("u03_intersection", "SELECT p_name FROM part WHERE p_size < 5 INTERSECT SELECT p_name FROM part WHERE p_size > 45")
def u03(t):
    return t.part.where("p_size < 5").select("p_name").intersect(t.part.where("p_size > 45").select("p_name"))


@query("u04_difference", "SELECT DISTINCT p_name FROM part WHERE p_size > 20 EXCEPT SELECT p_name FROM part WHERE p_brand = 'Brand#2'")
def u04(t):
    return t.part.where("p_size > 20").select("p_name").subtract(t.part.where("p_brand = 'Brand#2'").select("p_name"))


@query("u05_unique_merge", "SELECT p_partkey, array_to_string(CASE WHEN p_brand = p_type THEN [p_brand] ELSE [p_brand, p_type] END, ',') AS tags FROM part")
def u05(t):
    return t.part.select("p_partkey", F.array_join(F.array_distinct(F.array("p_brand", "p_type", "p_brand")), ",").alias("tags"))


@query("u06_found_and_expected", "SELECT p_partkey, len(list_intersect(string_split(p_name, ' '), ['red', 'plate', 'rod'])) AS found FROM part")
def u06(t):
    return t.part.select("p_partkey", F.size(F.array_intersect(F.split("p_name", " "), X.strings(["red", "plate", "rod"]))).alias("found"))


@query("u07_worst_of_union", sql("SELECT CASE max(CASE status WHEN 'succeeded' THEN 1 WHEN 'running' THEN 2 ELSE 3 END) WHEN 1 THEN 'succeeded' WHEN 2 THEN 'running' ELSE 'queued' END AS worst FROM jobs", "jobs"))
def u07(t):
    return t.jobs.agg(A.worst(F.col("status"), ["succeeded", "running", "queued"]).alias("worst"))


# State over time; streaming/ has the same operators for streams.


@query("v01_timeline", "WITH c AS (SELECT date_trunc('hour', ts) AS start, count(*) AS n FROM events GROUP BY 1), g AS (SELECT unnest(generate_series(min(start), max(start), INTERVAL 1 HOUR)) AS start FROM c) SELECT g.start, coalesce(n, 0) AS n FROM g LEFT JOIN c USING (start)")
def v01(t):
    return A.timeline(t.events, "ts", "1 hour")


@query("v02_sliding_windows", "SELECT start, count(*) AS n FROM (SELECT unnest([time_bucket(INTERVAL 6 HOUR, ts), time_bucket(INTERVAL 6 HOUR, ts) - INTERVAL 6 HOUR, time_bucket(INTERVAL 6 HOUR, ts) - INTERVAL 12 HOUR, time_bucket(INTERVAL 6 HOUR, ts) - INTERVAL 18 HOUR]) AS start FROM events) GROUP BY start")
def v02(t):
    return t.events.groupBy(F.window("ts", "24 hours", "6 hours").start.alias("start")).agg(F.count("*").alias("n"))


_SESS = ", m AS (SELECT *, CASE WHEN lag(ts) OVER w IS NULL OR ts - lag(ts) OVER w >= INTERVAL 30 MINUTE THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), x AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session FROM m)"


@query("v03_inactivity_sessions", sql(_SESS + " SELECT user_id, min(ts) AS start, count(*) AS n FROM x GROUP BY user_id, session"))
def v03(t):
    s = t.events.groupBy("user_id", F.session_window("ts", "30 minutes").alias("w")).agg(F.count("*").alias("n"))
    return s.select("user_id", F.col("w.start").alias("start"), "n")


@query("v04_debounce", sql(", m AS (SELECT *, CASE WHEN lag(ts) OVER w IS NULL OR ts - lag(ts) OVER w > INTERVAL 60 SECOND THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), x AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS island FROM m) SELECT user_id, arg_max(event_id, {'t': ts, 'e': event_id}) AS event_id FROM x GROUP BY user_id, island"))
def v04(t):
    return A.sessions(t.events, "user_id", "ts", 60).groupBy("user_id", "session").agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("event_id")).select("user_id", "event_id")


_SUPPRESSED = """WITH RECURSIVE e AS (SELECT user_id, CAST(floor(epoch(ts)) AS BIGINT) AS s, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events),
f AS (SELECT user_id, rn, s AS last, 1 AS n FROM e WHERE rn = 1 UNION ALL SELECT e.user_id, e.rn, CASE WHEN e.s - last >= 86400 THEN e.s ELSE last END, CASE WHEN e.s - last >= 86400 THEN n + 1 ELSE n END FROM f JOIN e ON e.user_id = f.user_id AND e.rn = f.rn + 1)
SELECT user_id, arg_max(n, rn) AS accepted FROM f GROUP BY user_id"""


@query("v05_repeat_suppression", _SUPPRESSED)
def v05(t):
    return R.steps_from_first(t.events.select("user_id", F.unix_timestamp("ts").alias("at")), "user_id", "at", 86400)


#: The log as (user_id, at, event_id, action): kinds of events stand for actions, a user for a job or reminder.
def _log(t, actions: dict[str, str]):
    action = F.element_at(F.create_map(*[F.lit(x) for kv in actions.items() for x in kv]), F.col("event_type"))
    return t.events.select("user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), "event_id", action.alias("action"))


def _folded(state: str, start: str, cases: str, extra: str = "") -> str:
    """SQL that walks each user's log in order; ``cases`` are the state's columns after an event."""
    return f"""WITH RECURSIVE e AS (SELECT user_id, event_type AS k, epoch_us(ts) AS s, event_id AS id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events),
f AS (SELECT user_id, 0::BIGINT AS rn, {start} FROM (SELECT DISTINCT user_id FROM e)
UNION ALL SELECT user_id, rn2, {cases} FROM (SELECT f.*, k, s, id, e.rn AS rn2{extra} FROM f JOIN e ON e.user_id = f.user_id AND e.rn = f.rn + 1))
SELECT f.user_id, {state} FROM f JOIN (SELECT user_id, max(rn) AS rn FROM f GROUP BY user_id) USING (user_id, rn)"""


_QUEUE = _folded(
    "status, attempts::BIGINT AS attempts, expired::BIGINT AS expired, refused::BIGINT AS refused",
    "'queued' AS status, -1::BIGINT AS holder, 0::BIGINT AS until, 0 AS attempts, 0 AS expired, 0 AS refused",
    """CASE WHEN k = 'signup' AND status IN ('succeeded', 'failed') THEN 'queued' WHEN k = 'click' AND may THEN 'running' WHEN k = 'purchase' AND held THEN 'succeeded' WHEN k = 'error' AND held THEN CASE WHEN attempts < 3 THEN 'queued' ELSE 'failed' END ELSE status END,
 CASE WHEN k = 'signup' AND status IN ('succeeded', 'failed') OR k IN ('purchase', 'error') AND held THEN -1 WHEN k = 'click' AND may THEN id % 3 ELSE holder END,
 CASE WHEN k = 'signup' AND status IN ('succeeded', 'failed') OR k = 'purchase' AND held THEN s WHEN k = 'click' AND may OR k = 'view' AND held THEN s + 43200000000 WHEN k = 'error' AND held THEN CASE WHEN attempts < 3 THEN s + 10800000000 ELSE s END ELSE until END,
 CASE WHEN k = 'signup' AND status IN ('succeeded', 'failed') THEN 0 WHEN k = 'click' AND may THEN attempts + 1 ELSE attempts END,
 CASE WHEN k = 'click' AND may AND status = 'running' THEN expired + 1 ELSE expired END,
 CASE WHEN k IN ('view', 'purchase', 'error') AND NOT held THEN refused + 1 ELSE refused END""",
    ", status IN ('queued', 'running') AND until <= s AS may, status = 'running' AND holder = id % 3 AS held",
)


@query("v09_queue_claims", _QUEUE)
def v09(t):
    """Claims of due jobs and of ended leases, heartbeats, completions by the holder only; three workers."""
    log = _log(t, {"signup": "enqueue", "click": "claim", "view": "heartbeat", "purchase": "complete", "error": "fail"}).withColumn("worker", F.col("event_id") % 3)
    done = Z.ordered_fold(log, "user_id", ["at", "event_id"], ("queued", -1, 0, 0, 0, 0), Z.queue_step, "status string, holder long, until long, attempts long, expired long, refused long")
    return done.select("user_id", "status", "attempts", "expired", "refused")


_RETRY = _folded(
    "outcome, attempts::BIGINT AS attempts, next_at, early::BIGINT AS early",
    "'scheduled' AS outcome, 0 AS attempts, 0::BIGINT AS next_at, 0 AS early",
    """CASE WHEN k = 'signup' AND NOT waits THEN 'scheduled' WHEN tries AND k = 'click' THEN 'delivered' WHEN tries THEN CASE WHEN attempts + 1 < 3 THEN 'retry' ELSE 'dead_letter' END ELSE outcome END,
 CASE WHEN k = 'signup' AND NOT waits THEN 0 WHEN tries THEN attempts + 1 ELSE attempts END,
 CASE WHEN k = 'signup' AND NOT waits OR tries AND (k = 'click' OR attempts + 1 >= 3) THEN s WHEN tries THEN s + (attempts + 1) * 10800000000 ELSE next_at END,
 CASE WHEN k IN ('click', 'error') AND waits AND s < next_at THEN early + 1 ELSE early END""",
    ", outcome IN ('scheduled', 'retry') AS waits, outcome IN ('scheduled', 'retry') AND k IN ('click', 'error') AND s >= next_at AS tries",
)


@query("v10_retry_or_dead_letter", _RETRY)
def v10(t):
    log = _log(t, {"signup": "schedule", "click": "deliver", "error": "fail"}).where("action is not null")
    users = t.events.select("user_id").distinct()
    done = Z.ordered_fold(log, "user_id", ["at", "event_id"], ("scheduled", 0, 0, 0), Z.retry_step, "outcome string, attempts long, next_at long, early long")
    fresh = lambda c, x: F.coalesce(c, F.lit(x)).alias(c)
    return users.join(done, "user_id", "left").select("user_id", fresh("outcome", "scheduled"), fresh("attempts", 0), fresh("next_at", 0), fresh("early", 0))


_LIFE = _folded(
    "state, attempts::BIGINT AS attempts, errors::BIGINT AS errors",
    "'none' AS state, 0 AS attempts, 0 AS errors",
    """CASE WHEN NOT fits THEN state WHEN k = 'signup' THEN 'scheduled' WHEN k = 'view' THEN 'snoozed' WHEN k = 'click' AND id % 4 = 0 THEN 'canceled' WHEN k = 'click' THEN 'rescheduled' WHEN k = 'purchase' THEN 'delivered'
  WHEN user_id % 3 = 0 THEN 'failed' WHEN attempts + 1 < 3 THEN 'retry_scheduled' ELSE 'dead_letter' END,
 CASE WHEN NOT fits THEN attempts WHEN k = 'signup' THEN 0 WHEN k IN ('purchase', 'error') THEN attempts + 1 ELSE attempts END,
 CASE WHEN fits THEN errors ELSE errors + 1 END""",
    """, CASE WHEN k = 'signup' THEN state NOT IN ('scheduled', 'snoozed', 'rescheduled', 'retry_scheduled') WHEN k = 'view' OR k = 'click' AND id % 4 <> 0 THEN state NOT IN ('none', 'canceled', 'delivered')
  ELSE state IN ('scheduled', 'snoozed', 'rescheduled', 'retry_scheduled') END AS fits""",
)


@query("v11_reminder_lifecycle", _LIFE)
def v11(t):
    """Eight states; of clicks every fourth event cancels, a third of the reminders isn't retried."""
    log = _log(t, {"signup": "schedule", "view": "snooze", "click": "reschedule", "purchase": "deliver", "error": "fail"})
    action = F.when((F.col("action") == "reschedule") & (F.col("event_id") % 4 == 0), "cancel").otherwise(F.col("action"))
    log = log.withColumn("action", action).withColumn("retries", F.col("user_id") % 3 != 0)
    return Z.ordered_fold(log, "user_id", ["at", "event_id"], ("none", 0, 0), Z.reminder_step, "state string, attempts long, errors long")


@query("v12_conversation_state", sql(", p AS (SELECT *, lag(intent) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM turns) SELECT conv_id, turn, least(3, count(*) FILTER (WHERE before IS NOT NULL AND before <> intent) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING)) AS level FROM p", "turns"))
def v12(t):
    w = Window.partitionBy("conv_id").orderBy("turn")
    changed = F.coalesce((F.lag("intent").over(w) != F.col("intent")).cast("int"), F.lit(0))
    return t.turns.withColumn("c", changed).select("conv_id", "turn", F.least(F.lit(3), F.sum("c").over(w.rowsBetween(Window.unboundedPreceding, 0))).alias("level"))


@query("v13_refinement_hints", sql(", k AS (SELECT conv_id, intent, count(*) AS n, max(turn) AS last FROM turns GROUP BY ALL), m AS (SELECT conv_id, max(turn) AS now FROM turns GROUP BY conv_id) SELECT conv_id, intent, CASE WHEN n >= 2 AND last >= now - 1 THEN 'boost' WHEN n >= 3 AND last < now - 2 THEN 'suppress' END AS hint FROM k JOIN m USING (conv_id) WHERE (n >= 2 AND last >= now - 1) OR (n >= 3 AND last < now - 2)", "turns"))
def v13(t):
    k = t.turns.groupBy("conv_id", "intent").agg(F.count("*").alias("n"), F.max("turn").alias("last"))
    k = k.withColumn("now", F.max("last").over(Window.partitionBy("conv_id")))
    hint = F.when((F.col("n") >= 2) & (F.col("last") >= F.col("now") - 1), "boost").when((F.col("n") >= 3) & (F.col("last") < F.col("now") - 2), "suppress")
    return k.select("conv_id", "intent", hint.alias("hint")).where("hint is not null")


@query("v14_writer_conflicts", "SELECT p_name, count(DISTINCT l_suppkey) AS writers FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY p_name HAVING count(DISTINCT l_suppkey) > 1")
def v14(t):
    names = t.part.select(F.col("p_partkey").alias("l_partkey"), "p_name")
    return t.lineitem.select("l_partkey", "l_suppkey").join(names, "l_partkey").groupBy("p_name").agg(F.countDistinct("l_suppkey").alias("writers")).where("writers > 1")


@query("v15_ring_buffer", "SELECT user_id, array_to_string(list(event_id ORDER BY ts DESC, event_id DESC)[1:5], ',') AS ring FROM events GROUP BY user_id")
def v15(t):
    last = t.events.withColumn("rn", F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id")))).where("rn <= 5")
    ring = F.transform(F.array_sort(F.collect_list(F.struct("rn", "event_id"))), lambda x: x["event_id"].cast("string"))
    return last.groupBy("user_id").agg(F.array_join(ring, ",").alias("ring"))

"""Counts, coverage, bias, sessions, scores and benchmark metrics."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import analytics as A
from ..operators import search as S
from ..sources.bindings import sql
from .catalog import query


@query("a01_group_counts", "SELECT lang AS grp, count(*) AS n FROM documents GROUP BY lang UNION ALL SELECT event_type, count(*) FROM events GROUP BY event_type")
def a01(t):
    a = t.documents.groupBy(F.col("lang").alias("grp")).agg(F.count("*").alias("n"))
    return a.unionByName(t.events.groupBy(F.col("event_type").alias("grp")).agg(F.count("*").alias("n")))


_COVER = "SELECT count(*) AS total, count(namespace) AS with_namespace, count(module) AS with_module, count(end_line) AS with_lines, count(CASE WHEN label = 'Function' THEN 1 END) AS functions FROM nodes"


@query("a02_conditional_counts", sql(_COVER, "nodes"))
def a02(t):
    return t.nodes.agg(F.count("*").alias("total"), F.count("namespace").alias("with_namespace"), F.count("module").alias("with_module"), F.count("end_line").alias("with_lines"), F.count_if(F.col("label") == "Function").alias("functions"))


@query("a03_coverage_score", sql(f"SELECT round_even(100.0 * with_namespace / greatest(total, 1), 2) AS namespace_pct, round_even(100.0 * with_module / greatest(total, 1), 2) AS module_pct, round_even((100.0 * with_namespace + 100.0 * with_module + 100.0 * with_lines + 100.0 * functions) / 4 / greatest(total, 1), 2) AS quality FROM ({_COVER})", "nodes"))
def a03(t):
    c, whole = a02(t), F.greatest("total", F.lit(1))
    pct = lambda x: F.bround(100.0 * F.col(x) / whole, 2)
    quality = F.bround((100.0 * F.col("with_namespace") + 100.0 * F.col("with_module") + 100.0 * F.col("with_lines") + 100.0 * F.col("functions")) / 4 / whole, 2)
    return c.select(pct("with_namespace").alias("namespace_pct"), pct("with_module").alias("module_pct"), quality.alias("quality"))


@query("a04_coverage_by_namespace", sql("SELECT namespace, count(*) AS total, count(CASE WHEN end_line > 25 THEN 1 END) AS long FROM functions GROUP BY namespace ORDER BY total DESC, namespace LIMIT 10", "functions"))
def a04(t):
    return t.functions.groupBy("namespace").agg(F.count("*").alias("total"), F.count_if(F.col("end_line") > 25).alias("long")).orderBy(F.desc("total"), "namespace").limit(10)


@query("a05_embedding_stats", "SELECT count(*) AS total, count(vec_id) AS embedded, count(*) - count(vec_id) AS pending, round_even(100.0 * count(vec_id) / greatest(count(*), 1), 1) AS coverage FROM documents LEFT JOIN embeddings ON doc_id = vec_id")
def a05(t):
    j = t.documents.select("doc_id").join(t.embeddings.select("vec_id"), F.col("doc_id") == F.col("vec_id"), "left")
    s = j.agg(F.count("*").alias("total"), F.count("vec_id").alias("embedded"))
    return s.select("total", "embedded", (F.col("total") - F.col("embedded")).alias("pending"), F.bround(100.0 * F.col("embedded") / F.greatest("total", F.lit(1)), 1).alias("coverage"))


@query("a06_stale_derived", "SELECT count(*) FILTER (WHERE l_shipdate > o_orderdate + INTERVAL 60 DAY OR o_orderdate IS NULL) AS stale, count(*) AS total FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey")
def a06(t):
    j = t.lineitem.select("l_orderkey", "l_shipdate").join(t.orders.select("o_orderkey", "o_orderdate"), F.col("l_orderkey") == F.col("o_orderkey"), "left")
    late = F.col("o_orderdate").isNull() | (F.col("l_shipdate") > F.col("o_orderdate") + F.expr("interval 60 days"))
    return j.agg(F.count_if(late).alias("stale"), F.count("*").alias("total"))


@query("a07_distinct_counts", sql("SELECT module, count(DISTINCT name) AS names, count(DISTINCT namespace) AS namespaces FROM functions GROUP BY module", "functions"))
def a07(t):
    return t.functions.groupBy("module").agg(F.countDistinct("name").alias("names"), F.countDistinct("namespace").alias("namespaces"))


@query("a08_having_threshold", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) >= 12")
def a08(t):
    return t.orders.groupBy("o_custkey").agg(F.count("*").alias("n")).where("n >= 12")


@query("a09_min_and_sample", "SELECT o_custkey, min(o_orderdate) AS first_date, arg_min(o_orderkey, {'d': o_orderdate, 'k': o_orderkey}) AS first_order FROM orders GROUP BY o_custkey")
def a09(t):
    return t.orders.groupBy("o_custkey").agg(F.min("o_orderdate").alias("first_date"), F.min_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("first_order"))


@query("a10_capped_collect", "SELECT l_suppkey, array_to_string(list_sort(list(DISTINCT l_partkey))[1:5], ',') AS parts FROM lineitem GROUP BY l_suppkey")
def a10(t):
    return t.lineitem.groupBy("l_suppkey").agg(F.array_join(F.slice(F.array_sort(F.collect_set("l_partkey")), 1, 5).cast("array<string>"), ",").alias("parts"))


@query("a11_all_of_group", "SELECT l_orderkey, bool_and(l_quantity >= 10) AS all_large, bool_and(l_returnflag <> 'R') AND count(*) >= 3 AS promote FROM lineitem GROUP BY l_orderkey")
def a11(t):
    return t.lineitem.groupBy("l_orderkey").agg(F.every(F.col("l_quantity") >= 10).alias("all_large"), (F.every(F.col("l_returnflag") != "R") & (F.count("*") >= 3)).alias("promote"))


@query("a12_array_frequencies", "SELECT w, count(*) AS n FROM (SELECT unnest(string_split(p_name, ' ')) AS w FROM part) GROUP BY w ORDER BY n DESC, w LIMIT 5")
def a12(t):
    return t.part.select(F.explode(F.split("p_name", " ")).alias("w")).groupBy("w").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "w").limit(5)


@query("a13_event_means", "SELECT event_type, round(avg(value), 4) AS mean, CAST(sum(CAST(value AS DECIMAL(18, 2))) AS DOUBLE) AS total FROM events GROUP BY event_type")
def a13(t):
    return t.events.groupBy("event_type").agg(F.round(F.avg("value"), 4).alias("mean"), F.sum(F.col("value").cast("decimal(18,2)")).cast("double").alias("total"))


@query("a14_entropy", "SELECT round(-sum(p * log2(p)) / log2(count(*)), 4) AS entropy FROM (SELECT count(*) / sum(count(*)) OVER () AS p FROM events GROUP BY event_type)")
def a14(t):
    return A.entropy(t.events.groupBy("event_type").agg(F.count("*").alias("n"))).select(F.round("entropy", 4).alias("entropy"))


@query("a15_type_bias", "SELECT event_type, round_even((n / sum(n) OVER () - 1.0 / count(*) OVER ()) / (1.0 / count(*) OVER ()), 3) AS signed, abs(round_even((n / sum(n) OVER () - 1.0 / count(*) OVER ()) / (1.0 / count(*) OVER ()), 3)) AS bias FROM (SELECT event_type, count(*) AS n FROM events GROUP BY event_type)")
def a15(t):
    return A.type_bias(t.events.groupBy("event_type").agg(F.count("*").alias("n"))).select("event_type", "signed", "bias")


_ASOF = "(SELECT max(ts) FROM events)"


@query("a16_recency_bias", f"SELECT CASE WHEN older = 0 THEN CASE WHEN recent > 0 THEN 1.0 ELSE 0.0 END ELSE round(recent / older, 4) END AS recency FROM (SELECT count(*) FILTER (WHERE ts >= {_ASOF} - INTERVAL 24 HOUR) AS recent, count(*) FILTER (WHERE ts >= {_ASOF} - INTERVAL 7 DAY) AS older FROM events)")
def a16(t):
    asof = F.broadcast(t.events.agg(F.max("ts").alias("asof")))  # one row
    c = t.events.select("ts").crossJoin(asof).agg(F.count_if(F.col("ts") >= F.col("asof") - F.expr("interval 24 hours")).alias("recent"), F.count_if(F.col("ts") >= F.col("asof") - F.expr("interval 7 days")).alias("older"))
    return c.select(F.when(F.col("older") == 0, F.when(F.col("recent") > 0, 1.0).otherwise(0.0)).otherwise(F.round(F.try_divide("recent", "older"), 4)).alias("recency"))


@query("a17_top_referenced", "SELECT user_id, count(*) AS n FROM events GROUP BY user_id ORDER BY n DESC, user_id LIMIT 20")
def a17(t):
    return t.events.groupBy("user_id").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "user_id").limit(20)


@query("a18_summary_row", "SELECT count(*) AS events, count(DISTINCT user_id) AS users, count(DISTINCT event_type) AS types, min(ts) AS first_ts, max(ts) AS last_ts FROM events")
def a18(t):
    return t.events.agg(F.count("*").alias("events"), F.countDistinct("user_id").alias("users"), F.countDistinct("event_type").alias("types"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


@query("a19_histogram", "SELECT event_type, CAST(le AS DOUBLE) AS le, count(*) FILTER (WHERE value <= le) AS n, count(value) AS count FROM events, (VALUES (1.0), (5.0), (25.0), (100.0)) b(le) GROUP BY ALL")
def a19(t):
    return A.histogram(t.events, "value", (1, 5, 25, 100), "event_type")


@query("a20_error_rates", "SELECT user_id, count(*) AS calls, count(*) FILTER (WHERE event_type = 'error') AS errors, round(count(*) FILTER (WHERE event_type = 'error') / count(*), 4) AS error_rate, round(avg(value) FILTER (WHERE event_type = 'view'), 3) AS mean_view FROM events GROUP BY user_id")
def a20(t):
    errors = F.count_if(F.col("event_type") == "error")
    return t.events.groupBy("user_id").agg(F.count("*").alias("calls"), errors.alias("errors"), F.round(errors / F.count("*"), 4).alias("error_rate"), F.round(F.avg(F.when(F.col("event_type") == "view", F.col("value"))), 3).alias("mean_view"))


_LOAD = "SELECT CAST(ts AS DATE) AS day, user_id, max(CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END) AS s, max(CASE WHEN event_type = 'view' THEN 1 ELSE 0 END) AS l FROM events GROUP BY ALL"


def _load_days(t):
    flag = lambda kind: F.max((F.col("event_type") == kind).cast("int"))
    return t.events.groupBy(F.to_date("ts").alias("day"), "user_id").agg(flag("signup").alias("s"), flag("view").alias("l"))


@query("a21_load_rate", f"SELECT sum(s) AS starts, sum(s * l) AS loaded, round_even(100.0 * sum(s * l) / greatest(sum(s), 1), 1) AS rate FROM ({_LOAD})")
def a21(t):
    c = _load_days(t).agg(F.sum("s").alias("starts"), F.sum(F.col("s") * F.col("l")).alias("loaded"))
    return c.withColumn("rate", F.bround(100.0 * F.col("loaded") / F.greatest("starts", F.lit(1)), 1))


_SESS = ", m AS (SELECT *, CASE WHEN lag(ts) OVER w IS NULL OR ts - lag(ts) OVER w > INTERVAL 30 MINUTE THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), x AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session FROM m)"


@query("a22_session_rollup", sql(_SESS + " SELECT user_id, CAST(session AS BIGINT) AS session, count(*) AS events, min(ts) AS started, max(ts) AS ended, arg_max(event_type, {'t': ts, 'e': event_id}) AS last_type FROM x GROUP BY user_id, session"))
def a22(t):
    return A.sessions(t.events, "user_id", "ts", 1800).groupBy("user_id", "session").agg(F.count("*").alias("events"), F.min("ts").alias("started"), F.max("ts").alias("ended"), F.max_by("event_type", F.struct("ts", "event_id")).alias("last_type"))


@query("a23_daily_sessions", f"SELECT day, sum(s) AS starts, sum(s * l) AS loaded FROM ({_LOAD}) GROUP BY day")
def a23(t):
    return _load_days(t).groupBy("day").agg(F.sum("s").alias("starts"), F.sum(F.col("s") * F.col("l")).alias("loaded"))


@query("a24_active_sessions", f"SELECT user_id, count(*) AS n, max(ts) AS last_seen FROM events WHERE ts >= {_ASOF} - INTERVAL 2 DAY GROUP BY user_id")
def a24(t):
    asof = F.broadcast(t.events.agg(F.max("ts").alias("asof")))  # one row
    return t.events.crossJoin(asof).where(F.col("ts") >= F.col("asof") - F.expr("interval 2 days")).groupBy("user_id").agg(F.count("*").alias("n"), F.max("ts").alias("last_seen"))


@query("a25_daily_growth", "SELECT day, n, sum(n) OVER (ORDER BY day) AS total FROM (SELECT CAST(o_orderdate AS DATE) AS day, count(*) AS n FROM orders GROUP BY 1)")
def a25(t):
    days = t.orders.groupBy(F.to_date("o_orderdate").alias("day")).agg(F.count("*").alias("n"))  # one row a day, so one window is small
    return days.withColumn("total", F.sum("n").over(Window.orderBy("day")))


@query("a26_feedback_split", "SELECT quality, toxic, count(*) AS n FROM labels GROUP BY ALL")
def a26(t):
    return t.labels.groupBy("quality", "toxic").agg(F.count("*").alias("n"))


@query("a27_hook_activity", f"SELECT event_type, count(*) FILTER (WHERE ts > {_ASOF} - INTERVAL 1 HOUR) AS last_hour, count(*) AS total FROM events GROUP BY event_type")
def a27(t):
    asof = F.broadcast(t.events.agg(F.max("ts").alias("asof")))  # one row
    return t.events.crossJoin(asof).groupBy("event_type").agg(F.count_if(F.col("ts") > F.col("asof") - F.expr("interval 1 hour")).alias("last_hour"), F.count("*").alias("total"))


@query("a28_cost_estimate", "SELECT label, count(*) AS n, round(count(*) * 0.00012, 6) AS cost FROM embeddings GROUP BY label")
def a28(t):
    return t.embeddings.groupBy("label").agg(F.count("*").alias("n"), F.round(F.count("*") * 0.00012, 6).alias("cost"))


@query("a29_weighted_grade", "SELECT o_orderkey, s AS score, CASE WHEN s >= 90 THEN 'A' WHEN s >= 80 THEN 'B' WHEN s >= 70 THEN 'C' WHEN s >= 60 THEN 'D' ELSE 'F' END AS grade FROM (SELECT o_orderkey, round(100 * (0.5 * (o_totalprice > 100000)::INT + 0.3 * (o_orderpriority < '3')::INT + 0.2 * (o_orderstatus = 'F')::INT), 2) AS s FROM orders)")
def a29(t):
    one = lambda c: c.cast("int")
    s = F.round(100 * (0.5 * one(F.col("o_totalprice") > 100000) + 0.3 * one(F.col("o_orderpriority") < "3") + 0.2 * one(F.col("o_orderstatus") == "F")), 2)
    return t.orders.select("o_orderkey", s.alias("score"), F.when(s >= 90, "A").when(s >= 80, "B").when(s >= 70, "C").when(s >= 60, "D").otherwise("F").alias("grade"))


@query("a30_penalty_score", "SELECT doc_id, greatest(0, 100 - 2 * (length(text) // 1000) - 5 * (length(text) - length(replace(text, '!!', ''))) // 2) AS score FROM documents")
def a30(t):
    shouts = F.floor((F.length("text") - F.length(F.replace("text", F.lit("!!"), F.lit("")))) * 5 / 2)
    return t.documents.select("doc_id", F.greatest(F.lit(0), 100 - 2 * F.floor(F.length("text") / 1000) - shouts).alias("score"))


@query("a31_smell_severity", "SELECT p_brand, sum(CASE WHEN p_size > 45 THEN 10 WHEN p_size > 30 THEN 5 WHEN p_size > 20 THEN 2 ELSE 0 END) AS severity FROM part GROUP BY p_brand")
def a31(t):
    w = F.when(F.col("p_size") > 45, 10).when(F.col("p_size") > 30, 5).when(F.col("p_size") > 20, 2).otherwise(0)
    return t.part.groupBy("p_brand").agg(F.sum(w).alias("severity"))


@query("a32_gate_score", "SELECT o_custkey, greatest(0, 30 - 10 * count(*) FILTER (WHERE o_orderpriority = '1-URGENT' AND o_orderstatus = 'O') - 5 * count(*) FILTER (WHERE o_orderpriority = '2-HIGH' AND o_orderstatus = 'O') - count(*) FILTER (WHERE o_orderstatus = 'P')) AS score FROM orders GROUP BY o_custkey")
def a32(t):
    open_ = F.col("o_orderstatus") == "O"
    lost = 10 * F.count_if((F.col("o_orderpriority") == "1-URGENT") & open_) + 5 * F.count_if((F.col("o_orderpriority") == "2-HIGH") & open_) + F.count_if(F.col("o_orderstatus") == "P")
    return t.orders.groupBy("o_custkey").agg(F.greatest(F.lit(0), 30 - lost).alias("score"))


@query("a33_review_aggregate", "SELECT s_nationkey, CASE WHEN bad >= 5 THEN least(m, 15.0) WHEN bad > 0 THEN least(m, 20.0) ELSE m END AS score FROM (SELECT s_nationkey, round(avg(s_acctbal) / 1000 * 3, 3) AS m, count(*) FILTER (WHERE s_acctbal < 0) AS bad FROM supplier GROUP BY s_nationkey)")
def a33(t):
    g = t.supplier.groupBy("s_nationkey").agg(F.round(F.avg("s_acctbal") / 1000 * 3, 3).alias("m"), F.count_if(F.col("s_acctbal") < 0).alias("bad"))
    return g.select("s_nationkey", F.when(F.col("bad") >= 5, F.least("m", F.lit(15.0))).when(F.col("bad") > 0, F.least("m", F.lit(20.0))).otherwise(F.col("m")).alias("score"))


@query("a34_checklist_score", "SELECT o_custkey, CAST(round_even((count(*) FILTER (WHERE o_orderstatus = 'F') + 0.5 * count(*) FILTER (WHERE o_orderstatus = 'P')) / count(*) * 10, 0) AS BIGINT) AS score FROM orders GROUP BY o_custkey")
def a34(t):
    good = F.count_if(F.col("o_orderstatus") == "F") + 0.5 * F.count_if(F.col("o_orderstatus") == "P")
    return t.orders.groupBy("o_custkey").agg(F.bround(good.cast("double") / F.count("*") * 10, 0).cast("long").alias("score"))


@query("a35_worst_status", sql("SELECT owner, arg_max(status, CASE status WHEN 'succeeded' THEN 1 WHEN 'running' THEN 2 ELSE 3 END) AS worst FROM jobs GROUP BY owner", "jobs"))
def a35(t):
    return t.jobs.groupBy("owner").agg(A.worst(F.col("status"), ["succeeded", "running", "queued"]).alias("worst"))


@query("a36_weakest_perspective", "SELECT p_type, arg_min(p_brand, {'p': p_retailprice, 'b': p_brand}) AS weakest FROM part GROUP BY p_type")
def a36(t):
    return t.part.groupBy("p_type").agg(F.min_by("p_brand", F.struct("p_retailprice", "p_brand")).alias("weakest"))


@query("a37_gain_estimate", "SELECT p_name, p_brand, least(40, sum(CAST(floor(0.6 * (50 - p_size)) AS BIGINT))) AS gain FROM part WHERE p_size > 20 GROUP BY ALL")
def a37(t):
    return t.part.where("p_size > 20").groupBy("p_name", "p_brand").agg(F.least(F.lit(40), F.sum(F.floor(0.6 * (50 - F.col("p_size"))))).alias("gain"))


@query("a38_precision_recall", "WITH e AS (SELECT o_custkey AS q, o_orderkey AS d, o_orderstatus = 'F' AS expected, o_totalprice > 150000 AS found FROM orders), s AS (SELECT q, count(*) FILTER (WHERE expected AND found) AS hits, count(*) FILTER (WHERE expected) AS e, count(*) FILTER (WHERE found) AS f FROM e GROUP BY q) SELECT q, round(hits / greatest(f, 1), 4) AS precision, round(hits / greatest(e, 1), 4) AS recall FROM s")
def a38(t):
    expected, found = F.col("o_orderstatus") == "F", F.col("o_totalprice") > 150000
    s = t.orders.groupBy(F.col("o_custkey").alias("q")).agg(F.count_if(expected & found).alias("b"), F.count_if(expected).alias("e"), F.count_if(found).alias("f"))
    return s.select("q", F.round(F.col("b") / F.greatest("f", F.lit(1)), 4).alias("precision"), F.round(F.col("b") / F.greatest("e", F.lit(1)), 4).alias("recall"))


@query("a39_ranking_metrics", "WITH r AS (SELECT o_custkey AS q, o_orderstatus = 'F' AS hit, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders), m AS (SELECT q, max(CASE WHEN rn = 1 AND hit THEN 1 ELSE 0 END) AS p1, coalesce(max(CASE WHEN hit THEN 1.0 / rn END), 0) AS rr, max(CASE WHEN rn <= 5 AND hit THEN 1 ELSE 0 END) AS hit5, coalesce(sum(CASE WHEN rn <= 5 AND hit THEN 1 / log2(rn + 1) END), 0) AS dcg, least(count(*) FILTER (WHERE hit), 5) AS n FROM r GROUP BY q) SELECT q, p1, round(rr, 4) AS rr, hit5, round(CASE WHEN n = 0 THEN 0 ELSE dcg / list_sum(list_transform(range(1, n + 1), lambda i: 1 / log2(i + 1))) END, 4) AS ndcg5 FROM m")
def a39(t):
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    r = t.orders.select(F.col("o_custkey").alias("q"), (F.col("o_orderstatus") == "F").alias("hit"), F.row_number().over(w).alias("rn"))
    top = (F.col("rn") <= 5) & F.col("hit")
    m = r.groupBy("q").agg(
        F.max(((F.col("rn") == 1) & F.col("hit")).cast("int")).alias("p1"), F.coalesce(F.max(F.when(F.col("hit"), 1.0 / F.col("rn"))), F.lit(0.0)).alias("rr"),
        F.max(top.cast("int")).alias("hit5"), F.coalesce(F.sum(F.when(top, 1 / F.log2(F.col("rn") + 1))), F.lit(0.0)).alias("dcg"), F.least(F.count_if("hit"), F.lit(5)).cast("int").alias("n"),
    )
    ideal = F.aggregate(F.sequence(F.lit(1), F.greatest("n", F.lit(1))), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1))
    return m.select("q", "p1", F.round("rr", 4).alias("rr"), "hit5", F.round(F.when(F.col("n") == 0, 0.0).otherwise(F.col("dcg") / ideal), 4).alias("ndcg5"))


@query("a40_recent_judge_mean", "SELECT round(avg(1 + 4 * quality), 4) AS mean_score FROM (SELECT quality FROM labels ORDER BY doc_id DESC LIMIT 50)")
def a40(t):
    return t.labels.orderBy(F.desc("doc_id")).limit(50).agg(F.round(F.avg(1 + 4 * F.col("quality")), 4).alias("mean_score"))


@query("a41_cache_statistics", "SELECT sum(hit) AS hits, sum(1 - hit) AS misses, round(100.0 * sum(hit) / count(*), 2) AS hit_rate FROM (SELECT CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) <= INTERVAL 600 SECOND THEN 1 ELSE 0 END AS hit FROM events)")
def a41(t):
    w = Window.partitionBy("user_id", "event_type").orderBy("ts", "event_id")
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    age = at - F.lag(at).over(w)
    hits = t.events.select(F.coalesce((age <= 600_000_000).cast("int"), F.lit(0)).alias("hit"))
    return hits.agg(F.sum("hit").alias("hits"), F.sum(1 - F.col("hit")).alias("misses"), F.round(100.0 * F.sum("hit") / F.count("*"), 2).alias("hit_rate"))


@query("a42_duplicate_ratio", sql("SELECT round_even(100.0 * sum(CASE WHEN n > 1 THEN n ELSE 0 END) / sum(n), 1) AS ratio FROM (SELECT name, count(*) AS n FROM functions GROUP BY name)", "functions"))
def a42(t):
    names = t.functions.groupBy("name").agg(F.count("*").alias("n"))
    return names.agg(F.bround(100.0 * F.sum(F.when(F.col("n") > 1, F.col("n")).otherwise(0)) / F.sum("n"), 1).alias("ratio"))


# Scalar groups over text, time and arrays.


@query("x01_string_functions", "SELECT p_partkey, lower(p_name) AS low, left(p_type, 3) AS head, concat(p_brand, '/', p_type) AS path, trim(replace(p_brand, '#', ' ')) AS brand FROM part")
def x01(t):
    return t.part.select("p_partkey", F.lower("p_name").alias("low"), F.left("p_type", F.lit(3)).alias("head"), F.concat("p_brand", F.lit("/"), "p_type").alias("path"), F.trim(F.replace("p_brand", F.lit("#"), F.lit(" "))).alias("brand"))


@query("x02_regex_functions", "SELECT doc_id, len(regexp_extract_all(text, '[A-Z]{3,}')) AS capitals, regexp_replace(text, '[aeiou]', '_', 'g') AS masked FROM documents")
def x02(t):
    return t.documents.select("doc_id", F.regexp_count("text", F.lit("[A-Z]{3,}")).alias("capitals"), F.regexp_replace("text", "[aeiou]", "_").alias("masked"))


@query("x03_query_escaping", r"""SELECT page_id, regexp_replace(url, '([+\-&|!(){}\[\]^"~*?:\\/])', '\\\1', 'g') AS escaped FROM pages""")
def x03(t):
    return t.pages.select("page_id", X.escaped(F.col("url")).alias("escaped"))


@query("x07_time_functions", "SELECT event_id, CAST(ts AS DATE) AS day, date_trunc('hour', ts) AS hour, date_diff('day', CAST(ts AS DATE), DATE '2024-02-01') AS days FROM events")
def x07(t):
    return t.events.select("event_id", F.to_date("ts").alias("day"), F.date_trunc("hour", "ts").alias("hour"), F.datediff(F.lit("2024-02-01").cast("date"), "ts").alias("days"))


@query("x09_math_functions", "SELECT event_id, round(exp(-value / 100), 5) AS decay, round(log2(value + 1), 5) AS bits, least(greatest(value, 1), 50) AS clamped FROM events")
def x09(t):
    v = F.col("value")
    return t.events.select("event_id", F.round(F.exp(-v / 100), 5).alias("decay"), F.round(F.log2(v + 1), 5).alias("bits"), F.least(F.greatest(v, F.lit(1.0)), F.lit(50.0)).alias("clamped"))


@query("x10_array_functions", "SELECT p_partkey, array_to_string(string_split(p_name, ' ')[1:1], ',') AS head, list_contains(string_split(p_name, ' '), 'plate') AS has_plate, len(list_filter(string_split(p_name, ' '), lambda x: length(x) > 3)) AS long_words FROM part")
def x10(t):
    w = F.split("p_name", " ")
    return t.part.select("p_partkey", F.array_join(F.slice(w, 1, 1), ",").alias("head"), F.array_contains(w, "plate").alias("has_plate"), F.size(F.filter(w, lambda x: F.length(x) > 3)).alias("long_words"))


@query("x11_json_functions", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, '{\"k\":' || CAST(json_extract(props, '$.k') AS BIGINT) || ',\"type\":\"' || event_type || '\"}' AS canonical FROM events")
def x11(t):
    k = F.from_json("props", "k long")["k"]
    return t.events.select("event_id", k.alias("k"), F.to_json(F.struct(k.alias("k"), F.col("event_type").alias("type"))).alias("canonical"))


@query("x12_hash_functions", "SELECT doc_id, md5(text) AS md5, sha256(text) AS sha256 FROM documents")
def x12(t):
    return t.documents.select("doc_id", F.md5("text").alias("md5"), F.sha2("text", 256).alias("sha256"))


@query("x13_token_estimates", "SELECT doc_id, length(text) // 3 AS third, length(text) // 4 AS quarter FROM documents")
def x13(t):
    return t.documents.select("doc_id", X.token_estimate(F.col("text")).alias("third"), X.token_estimate(F.col("text"), 4).alias("quarter"))


@query("x14_embed_text", sql("SELECT id, concat_ws(chr(10), namespace || '.' || name, module, CASE WHEN end_line > 25 THEN 'long' END) AS embed_text FROM functions", "functions"))
def x14(t):
    return t.functions.select("id", F.concat_ws("\n", F.concat("namespace", F.lit("."), "name"), "module", F.when(F.col("end_line") > 25, "long")).alias("embed_text"))


@query("x15_path_functions", r"SELECT page_id, string_split(url, '/')[-1] AS basename, regexp_extract(string_split(url, '/')[-1], '\.([a-z]+)$', 1) AS suffix FROM pages")
def x15(t):
    base = F.element_at(F.split("url", "/", -1), -1)
    return t.pages.select("page_id", base.alias("basename"), F.regexp_extract(base, r"\.([a-z]+)$", 1).alias("suffix"))


# What adds a branch; an else-if counts twice, as its if is counted too.
BRANCHES = (r"\bif\s*\(", r"\belse\s+if\s*\(", r"\bcase\s+", r"&&|\|\|", r"\b(for|while)\s*\(", r"\?[^?:]+:", r"\bcatch\s*\(")
# What makes a line harder to follow; the first ones by one and the depth of its braces, the others by one.
NESTED = (r"\bif\s*\(", r"\belse\s+if\s*\(", r"\b(for|while)\s*\(", r"\bswitch\s*\(", r"\bcatch\s*\(")
FLAT = (r"\belse\s*\{", r"\b(break|continue)\b")
#: Lines that a function has for each function that it calls, by that one's number; the last leaves its brace open.
_LINES = (
    "if (a && b) {\n{}();\n} else if (c || d) {\n{}(1);\n} else {\n}\n", "for (x) {\nwhile (y) { {}(); }\n}\n", "switch (k) {\ncase 1: break;\ncase 2: continue;\n}\n",
    "try {\n{}();\n} catch (e) {\n}\n", "v = q ? 1 : {}(2);\n", "if (if(deep)) {\n",
)


def bodies(t):
    """(id, body): the source of each function, as deep as its size and the functions that it calls ask for."""
    outs = S.capped(t.calls, "src", "dst", 10, "o").withColumnRenamed("src", "id")

    def called(d):
        number, out = F.substring(d, 2, 20).cast("long") % len(_LINES), F.lit("")
        for i, line in enumerate(_LINES):
            out = F.when(number == i, F.replace(F.lit(line), F.lit("{}"), d)).otherwise(out)
        return out

    depth = F.col("end_line") % 4
    inner = F.coalesce(F.array_join(F.transform("o", called), ""), F.lit(""))
    body = F.concat(F.lit("function "), "id", F.lit("() {\n"), F.repeat(F.lit("if (n) {\n"), depth), inner, F.repeat(F.lit("}\n"), depth), F.lit("}"))
    return t.functions.join(outs, "id", "left").select("id", body.alias("body"))


def cognitive(body):
    """The weight of a body's lines by the depth of braces that they stand at, in one pass with the depth as its state."""

    def step(s, raw):
        line = F.trim(raw)
        opens, shuts = line.rlike(r"\{") & ~line.rlike(r"\}.*\{"), line.rlike(r"\}") & ~line.rlike(r"\{.*\}")
        depth = s["depth"] + opens.cast("int")
        depth = F.when(shuts, F.greatest(F.lit(0), depth - 1)).otherwise(depth)
        weight = s["weight"]
        for p in NESTED:
            weight = weight + F.when(line.rlike(p), 1 + depth).otherwise(0)
        for p in FLAT:
            weight = weight + line.rlike(p).cast("int")
        return F.struct(depth.alias("depth"), weight.alias("weight"))

    return F.aggregate(F.split(body, "\n", -1), F.struct(F.lit(0).alias("depth"), F.lit(0).alias("weight")), step)["weight"]


_CYCLOMATIC = "1 + " + " + ".join(f"len(regexp_extract_all(body, '{p}'))" for p in BRANCHES)
_BODIES = ", bodies AS (SELECT f.id, 'function ' || f.id || '() {' || chr(10) || repeat('if (n) {' || chr(10), end_line % 4) || coalesce(array_to_string(list_transform(o.l, lambda d: CASE CAST(substr(d, 2) AS BIGINT) % 6 " + " ".join(f"WHEN {i} THEN replace('{x}', '{{}}', d)" for i, x in enumerate(_LINES)) + " END), ''), '') || repeat('}' || chr(10), end_line % 4) || '}' AS body FROM functions f LEFT JOIN (SELECT src, list_sort(list(dst))[1:10] AS l FROM calls GROUP BY 1) o ON o.src = f.id)"


@query("x16_cyclomatic_text", sql(_BODIES + rf""", lines AS (SELECT id, i, trim(line) AS line FROM (SELECT id, unnest(range(len(l))) AS i, unnest(l) AS line FROM (SELECT id, string_split(body, chr(10)) AS l FROM bodies))),
 steps AS (SELECT *, CAST(regexp_matches(line, '\{{') AND NOT regexp_matches(line, '\}}.*\{{') AS INT) - CAST(regexp_matches(line, '\}}') AND NOT regexp_matches(line, '\{{.*\}}') AS INT) AS d FROM lines),
 sums AS (SELECT *, sum(d) OVER (PARTITION BY id ORDER BY i) AS s FROM steps),
 depths AS (SELECT id, line, s - least(0, min(s) OVER (PARTITION BY id ORDER BY i)) AS depth FROM sums),
 weights AS (SELECT id, sum({" + ".join(f"CASE WHEN regexp_matches(line, '{p}') THEN 1 + depth ELSE 0 END" for p in NESTED)} + {" + ".join(f"CAST(regexp_matches(line, '{p}') AS INT)" for p in FLAT)}) AS cognitive FROM depths GROUP BY id)
 SELECT id, complexity, CASE WHEN complexity <= 5 THEN 'low' WHEN complexity <= 10 THEN 'fair' WHEN complexity <= 20 THEN 'high' ELSE 'very high' END AS band, CAST(cognitive AS BIGINT) AS cognitive
 FROM (SELECT id, {_CYCLOMATIC} AS complexity FROM bodies) JOIN weights USING (id)""", "functions", "calls"))
def x16(t):
    total = F.lit(1)
    for p in BRANCHES:
        total = total + F.regexp_count("body", F.lit(p))
    rows = bodies(t).select("id", total.alias("complexity"), cognitive(F.col("body")).cast("long").alias("cognitive"))
    c = F.col("complexity")
    return rows.withColumn("band", F.when(c <= 5, "low").when(c <= 10, "fair").when(c <= 20, "high").otherwise("very high"))


@query("x17_naming_rules", sql("SELECT id, regexp_matches(name, '^[a-z]+( [a-z]+)*$') AS lower_words, regexp_matches(coalesce(namespace, ''), '^Brand#[0-9]+$') AS branded FROM nodes", "nodes"))
def x17(t):
    return t.nodes.select("id", F.col("name").rlike("^[a-z]+( [a-z]+)*$").alias("lower_words"), F.coalesce("namespace", F.lit("")).rlike("^Brand#[0-9]+$").alias("branded"))


@query("x18_smell_thresholds", sql("SELECT id, CASE WHEN end_line > 45 THEN 'critical' WHEN end_line > 30 THEN 'major' WHEN end_line > 15 THEN 'minor' END AS smell FROM functions WHERE end_line > 15", "functions"))
def x18(t):
    n = F.col("end_line")
    return t.functions.where(n > 15).select("id", F.when(n > 45, "critical").when(n > 30, "major").otherwise("minor").alias("smell"))


# Names of languages, short ones, and the endings of their files.
LANGUAGES = ("typescript", "javascript", "python")
SHORT = {"ts": "typescript", "js": "javascript", "py": "python"}
ENDINGS = {".ts": "typescript", ".tsx": "typescript", ".js": "javascript", ".jsx": "javascript", ".py": "python"}
#: What a function's node says of its language, its file's ending and that of its module, by its brand and size.
_SAID, _FILED, _MODULED = ("TypeScript", "js", "py", "rust", "", "JavaScript", ""), (".tsx", ".js", ".py", "", ".jsx", ".md"), ("", ".ts", ".js")


@query("x20_language_cascade", sql(f""", f AS (SELECT id, lower(({list(_SAID)})[CAST(replace(namespace, 'Brand#', '') AS INT) % {len(_SAID)} + 1]) AS said, module || '/' || id || ({list(_FILED)})[end_line % {len(_FILED)} + 1] AS path, module || ({list(_MODULED)})[end_line % {len(_MODULED)} + 1] AS module FROM functions)
 SELECT id, CASE WHEN said IN {LANGUAGES} THEN said {" ".join(f"WHEN said = '{k}' THEN '{v}'" for k, v in SHORT.items())} {" ".join(f"WHEN suffix(path, '{k}') THEN '{v}'" for k, v in ENDINGS.items())}
 WHEN contains(module, '.ts') THEN 'typescript' WHEN contains(module, '.js') THEN 'javascript' ELSE 'python' END AS language FROM f""", "functions"))
def x20(t):
    """What the node says, else what its file's ending says, else its module's name, else the default."""
    pick = lambda values, number: F.element_at(X.strings(values), (number % len(values) + 1).cast("int"))
    size = F.col("end_line")
    said = F.lower(pick(_SAID, F.replace("namespace", F.lit("Brand#"), F.lit("")).cast("int")))
    path = F.concat("module", F.lit("/"), "id", pick(_FILED, size))
    rows = t.functions.select("id", said.alias("said"), path.alias("path"), F.concat("module", pick(_MODULED, size)).alias("module"))
    out = F.when(F.col("said").isin(*LANGUAGES), F.col("said"))
    for k, v in SHORT.items():
        out = out.when(F.col("said") == k, v)
    for k, v in ENDINGS.items():
        out = out.when(F.endswith("path", F.lit(k)), v)
    out = out.when(F.contains("module", F.lit(".ts")), "typescript").when(F.contains("module", F.lit(".js")), "javascript")
    return rows.select("id", out.otherwise("python").alias("language"))


@query("x22_citations", "SELECT doc_id, unnest(list_distinct(regexp_extract_all(text, '(Version [0-9.]+[0-9])', 1))) AS citation FROM documents")
def x22(t):
    return t.documents.select("doc_id", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit("(Version [0-9.]+[0-9])"), 1))).alias("citation"))


@query("x23_diagram_ids", sql("SELECT id, CASE WHEN regexp_matches(regexp_replace(name, '[^a-zA-Z0-9_]', '_', 'g'), '^[0-9]') THEN '_' ELSE '' END || regexp_replace(name, '[^a-zA-Z0-9_]', '_', 'g') AS diagram_id FROM nodes", "nodes"))
def x23(t):
    return t.nodes.select("id", X.diagram_id(F.col("name")).alias("diagram_id"))


@query("x24_status_labels", sql("SELECT job_id, CASE status WHEN 'succeeded' THEN 'trusted' WHEN 'running' THEN 'in progress' ELSE 'unknown' END AS label FROM jobs", "jobs"))
def x24(t):
    names = F.create_map(F.lit("succeeded"), F.lit("trusted"), F.lit("running"), F.lit("in progress"))
    return t.jobs.select("job_id", F.coalesce(F.try_element_at(names, F.col("status")), F.lit("unknown")).alias("label"))

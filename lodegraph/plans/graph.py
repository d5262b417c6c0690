"""Graph statistics, traversal, impact and structure over the derived property graph."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import graph as G
from ..operators import search as S
from ..operators import structure as R
from ..sources.bindings import sql
from ..sources.scratch import stored
from .catalog import query


@query("g01_graph_stats", sql("SELECT 'node' AS kind, label AS type, count(*) AS n FROM nodes GROUP BY label UNION ALL SELECT 'edge', type, count(*) FROM edges GROUP BY type", "nodes", "edges"))
def g01(t):
    nodes = t.nodes.groupBy(F.col("label").alias("type")).agg(F.count("*").alias("n")).withColumn("kind", F.lit("node"))
    edges = t.edges.groupBy("type").agg(F.count("*").alias("n")).withColumn("kind", F.lit("edge"))
    return nodes.unionByName(edges).select("kind", "type", "n")


@query("g02_function_context", sql("""SELECT f.id, name, array_to_string(o.l, ',') AS callees, array_to_string(i.l, ',') AS callers FROM functions f
LEFT JOIN (SELECT src, list_sort(list(dst))[1:10] AS l FROM calls GROUP BY 1) o ON o.src = f.id LEFT JOIN (SELECT dst, list_sort(list(src))[1:10] AS l FROM calls GROUP BY 1) i ON i.dst = f.id""", "functions", "calls"))
def g02(t):
    outs = S.capped(t.calls, "src", "dst", 10, "o").withColumnRenamed("src", "id")
    ins = S.capped(t.calls, "dst", "src", 10, "i").withColumnRenamed("dst", "id")
    joined = t.functions.select("id", "name").join(outs, "id", "left").join(ins, "id", "left")
    return joined.select("id", "name", F.array_join("o", ",").alias("callees"), F.array_join("i", ",").alias("callers"))


@query("g03_module_structure", sql("SELECT m.name AS module, n.label, count(*) AS members, min(n.name) AS first_name FROM edges e JOIN nodes m ON m.id = e.src JOIN nodes n ON n.id = e.dst WHERE e.type = 'DEFINES' GROUP BY ALL", "nodes", "edges"))
def g03(t):
    m, n = t.nodes.select(F.col("id").alias("src"), F.col("name").alias("module")), t.nodes.select(F.col("id").alias("dst"), "label", "name")
    joined = t.edges.where("type = 'DEFINES'").join(m, "src").join(n, "dst")
    return joined.groupBy("module", "label").agg(F.count("*").alias("members"), F.min("name").alias("first_name"))


@query("g04_catalogue_union", "SELECT 'supplier' AS kind, s_name AS name FROM supplier WHERE s_acctbal < 0 UNION ALL SELECT 'customer', c_name FROM customer WHERE c_acctbal < 0 UNION ALL SELECT 'part', p_name FROM part WHERE p_retailprice < 950")
def g04(t):
    a = t.supplier.where("s_acctbal < 0").select(F.lit("supplier").alias("kind"), F.col("s_name").alias("name"))
    b = t.customer.where("c_acctbal < 0").select(F.lit("customer").alias("kind"), F.col("c_name").alias("name"))
    return a.unionByName(b).unionByName(t.part.where("p_retailprice < 950").select(F.lit("part").alias("kind"), F.col("p_name").alias("name")))


_PATHS = """, walk AS (
  SELECT id AS start, id AS node, [id] AS chain, 0 AS length FROM functions WHERE end_line = 7
  UNION ALL SELECT w.start, c.dst, list_append(w.chain, c.dst), w.length + 1 FROM walk w JOIN calls c ON c.src = w.node
  WHERE w.length < {depth} AND NOT list_contains(list_transform(range(1, len(w.chain)), lambda i: w.chain[i] || '>' || w.chain[i + 1]), c.src || '>' || c.dst))"""


@query("g05_call_paths", sql(_PATHS.format(depth=2) + " SELECT start, node, length, array_to_string(chain, '>') AS chain FROM walk WHERE length > 0", "functions", "calls", recursive=True))
def g05(t):
    found = G.paths(t.calls, t.functions.where("end_line = 7"), 2)
    return found.select("start", "node", "length", F.array_join("chain", ">").alias("chain"))


_REVERSE = """, walk AS (
  SELECT id AS target, id AS node, 0 AS d, [id] AS chain FROM functions WHERE end_line = 9
  UNION SELECT w.target, c.src, w.d + 1, list_append(w.chain, c.src) FROM walk w JOIN calls c ON c.dst = w.node WHERE w.d < 3),
hit AS (SELECT target, node, min(d) AS distance, array_to_string(min({'d': d, 'c': chain}).c, '>') AS chain FROM walk WHERE node <> target GROUP BY ALL)"""


@query("g06_blast_radius", sql(_REVERSE + " SELECT target, node, distance, chain FROM hit", "functions", "calls", recursive=True))
def g06(t):
    """Dependents up to distance 3, each with a chain that leads to it."""
    hit = G.reach(t.calls, t.functions.where("end_line = 9"), 3, reverse=True, chains=True)
    return hit.select(F.col("start").alias("target"), "node", "distance", F.array_join("chain", ">").alias("chain"))


@query("g07_impact_risk", sql(_REVERSE + """, agg AS (SELECT target, count(*) FILTER (WHERE distance = 1) AS direct, count(*) FILTER (WHERE distance > 1) AS indirect, count(DISTINCT f.module) AS modules
 FROM hit JOIN functions f ON f.id = node GROUP BY target)
SELECT target, direct, indirect, modules, least(100, 15 * direct + 5 * indirect + 10 * modules) AS risk,
 CASE WHEN least(100, 15 * direct + 5 * indirect + 10 * modules) >= 80 THEN 'CRITICAL' WHEN least(100, 15 * direct + 5 * indirect + 10 * modules) >= 50 THEN 'HIGH' WHEN least(100, 15 * direct + 5 * indirect + 10 * modules) >= 20 THEN 'MEDIUM' ELSE 'LOW' END AS band FROM agg""", "functions", "calls", recursive=True))
def g07(t):
    hit = G.reach(t.calls, t.functions.where("end_line = 9"), 3, reverse=True).join(t.functions.select(F.col("id").alias("node"), "module"), "node")
    agg = hit.groupBy(F.col("start").alias("target")).agg(F.count_if(F.col("distance") == 1).alias("direct"), F.count_if(F.col("distance") > 1).alias("indirect"), F.countDistinct("module").alias("modules"))
    score, band = G.impact_risk(F.col("direct"), F.col("indirect"), F.col("modules"), F.lit(0))
    return agg.select("target", "direct", "indirect", "modules", score.alias("risk"), band.alias("band"))


_DEG = ", deg AS (SELECT id, count(*) FILTER (WHERE way = 'out') AS fan_out, count(*) FILTER (WHERE way = 'in') AS fan_in FROM (SELECT DISTINCT src AS id, 'out' AS way, dst AS other FROM calls UNION SELECT DISTINCT dst, 'in', src FROM calls) GROUP BY id)"


@query("g08_fan_in_out", sql(_DEG + " SELECT * FROM deg", "calls"))
def g08(t):
    return G.degrees(t.calls)


_HOT = _DEG + ", h AS (SELECT f.id, f.name, changes, f.end_line * 2 AS lines, coalesce(fan_in, 0) AS fan_in, coalesce(fan_out, 0) AS fan_out FROM functions f JOIN churn USING (id) LEFT JOIN deg USING (id))"
_SIZE = "CASE WHEN lines > 50 THEN lines / 10.0 WHEN lines > 20 THEN lines / 20.0 ELSE 0 END"


def _hot(t):
    rows = t.functions.join(t.churn, "id").join(G.degrees(t.calls), "id", "left")
    return rows.select("id", "name", "changes", (F.col("end_line") * 2).alias("lines"), F.coalesce("fan_in", F.lit(0)).alias("fan_in"), F.coalesce("fan_out", F.lit(0)).alias("fan_out"))


@query("g09_hotspots", sql(_HOT + f", r AS (SELECT *, 3 * changes + 2 * ({_SIZE}) + 1.5 * fan_in * fan_out AS risk FROM h) SELECT id, name, round(risk, 2) AS risk, CASE WHEN risk >= 80 THEN 'CRITICAL' WHEN risk >= 50 THEN 'HIGH' WHEN risk >= 25 THEN 'MEDIUM' ELSE 'LOW' END AS severity FROM r", "functions", "calls", "churn"))
def g09(t):
    risk = 3 * F.col("changes") + 2 * G.size_term(F.col("lines")) + 1.5 * F.col("fan_in") * F.col("fan_out")
    severity = F.when(risk >= 80, "CRITICAL").when(risk >= 50, "HIGH").when(risk >= 25, "MEDIUM").otherwise("LOW")
    return _hot(t).select("id", "name", F.round(risk, 2).alias("risk"), severity.alias("severity"))


@query("g10_hotspot_warnings", sql(_HOT + " SELECT id, name, round(3 * changes + 1.5 * fan_in * fan_out, 2) AS risk FROM h WHERE changes >= 3 AND 3 * changes + 1.5 * fan_in * fan_out >= 40", "functions", "calls", "churn"))
def g10(t):
    risk = 3 * F.col("changes") + 1.5 * F.col("fan_in") * F.col("fan_out")
    return _hot(t).where((F.col("changes") >= 3) & (risk >= 40)).select("id", "name", F.round(risk, 2).alias("risk"))


@query("g11_module_risk", sql(_HOT + " SELECT id, round(2 * lines / 50.0 + 1.5 * fan_in * fan_out, 2) AS risk FROM h WHERE 2 * lines / 50.0 + 1.5 * fan_in * fan_out > 10", "functions", "calls", "churn"))
def g11(t):
    risk = 2 * F.col("lines") / 50.0 + 1.5 * F.col("fan_in") * F.col("fan_out")
    return _hot(t).where(risk > 10).select("id", F.round(risk, 2).alias("risk"))


@query("g12_ontology_checks", sql(""", imports AS (SELECT DISTINCT a.module AS src, b.module AS dst FROM calls JOIN functions a ON a.id = src JOIN functions b ON b.id = dst WHERE a.module <> b.module) SELECT 'orphan' AS kind, id FROM nodes WHERE id NOT IN (SELECT src FROM edges UNION SELECT dst FROM edges)
UNION ALL SELECT 'god_module', src FROM edges WHERE type = 'DEFINES' GROUP BY src HAVING count(*) >= 5
UNION ALL SELECT 'cycle', a.src || '<>' || a.dst FROM imports a JOIN imports b ON a.src = b.dst AND a.dst = b.src WHERE a.src < a.dst
UNION ALL SELECT 'stale', id FROM churn WHERE last_change < (SELECT max(last_change) FROM churn) - INTERVAL 365 DAY""", "functions", "edges", "churn"))
def g12(t):
    edges = t.edges
    ends = edges.select(F.col("src").alias("id")).union(edges.select("dst")).distinct()
    orphans = t.nodes.select("id").join(ends, "id", "left_anti").select(F.lit("orphan").alias("kind"), "id")
    gods = edges.where("type = 'DEFINES'").groupBy("src").agg(F.count("*").alias("n")).where("n >= 5").select(F.lit("god_module").alias("kind"), F.col("src").alias("id"))
    mutual = stored(imports(t))
    back = mutual.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    cycles = mutual.join(back, ["src", "dst"], "left_semi").where("src < dst").select(F.lit("cycle").alias("kind"), F.concat("src", F.lit("<>"), "dst").alias("id"))
    last = t.churn.agg(F.max("last_change").alias("asof"))
    stale = t.churn.crossJoin(F.broadcast(last)).where(F.col("last_change") < F.col("asof") - F.expr("interval 365 days")).select(F.lit("stale").alias("kind"), "id")  # one row
    return orphans.unionByName(gods).unionByName(cycles).unionByName(stale)


@query("g13_duplicate_names", sql("SELECT name, count(*) AS n, array_to_string(list_sort(list(DISTINCT namespace))[1:5], ',') AS namespaces FROM functions GROUP BY name HAVING count(*) > 1 ORDER BY n DESC, name LIMIT 20", "functions"))
def g13(t):
    groups = stored(t.functions.groupBy("name").agg(F.count("*").alias("n")).where("n > 1").orderBy(F.desc("n"), "name").limit(20))
    of_them = t.functions.join(F.broadcast(groups.select("name")), "name", "left_semi")  # 20 rows
    few = S.capped(of_them, "name", "namespace", 5, "ns")
    return groups.join(few, "name", "left").select("name", "n", F.array_join("ns", ",").alias("namespaces"))


@query("g14_resolve_ambiguous", sql(""", b AS (SELECT name, id, round_even((CASE WHEN namespace = 'Brand#2' THEN 1.5 ELSE 1.0 END) * (CASE WHEN end_line > 40 THEN 0.3 ELSE 1.0 END), 6) AS boost, namespace FROM functions),
r AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY boost DESC, namespace, id) AS rn FROM b)
SELECT name, max(id) FILTER (WHERE rn = 1) AS id, array_to_string(list(id ORDER BY rn) FILTER (WHERE rn BETWEEN 2 AND 5), ',') AS alternatives FROM r WHERE rn <= 5 GROUP BY name""", "functions"))
def g14(t):
    rows = t.functions.withColumn("boost", S.boost(F.lit(1.0), F.col("namespace"), "Brand#2", F.col("end_line") > 40))
    best = S.best_of_name(rows.select("name", "id", "boost", "namespace"), "name", F.desc("boost"), "namespace", "id", alternatives=4)
    return best.select("name", "id", F.when(F.size("alternatives") > 0, F.array_join("alternatives", ",")).alias("alternatives"))


@query("g15_neighbourhood", sql("SELECT * FROM (SELECT 'out' AS way, dst AS node FROM calls WHERE src = 'p10' ORDER BY dst LIMIT 20) UNION ALL SELECT * FROM (SELECT 'in', src FROM calls WHERE dst = 'p10' ORDER BY src LIMIT 20)", "calls"))
def g15(t):
    outs = t.calls.where("src = 'p10'").orderBy("dst").limit(20).select(F.lit("out").alias("way"), F.col("dst").alias("node"))
    ins = t.calls.where("dst = 'p10'").orderBy("src").limit(20).select(F.lit("in").alias("way"), F.col("src").alias("node"))
    return outs.unionByName(ins)


@query("g16_balanced_edges", sql("SELECT type, src, dst FROM (SELECT *, row_number() OVER (PARTITION BY type ORDER BY src, dst) AS rn FROM edges) WHERE rn <= 30", "edges"))
def g16(t):
    return t.edges.withColumn("rn", F.row_number().over(Window.partitionBy("type").orderBy("src", "dst"))).where("rn <= 30").select("type", "src", "dst")


@query("g17_namespace_sample", sql("SELECT namespace, module, id FROM (SELECT *, row_number() OVER (PARTITION BY namespace ORDER BY r1, module, id) AS r2 FROM (SELECT *, row_number() OVER (PARTITION BY namespace, module ORDER BY id) AS r1 FROM functions)) WHERE r2 <= 10", "functions"))
def g17(t):
    one = t.functions.withColumn("r1", F.row_number().over(Window.partitionBy("namespace", "module").orderBy("id")))
    two = one.withColumn("r2", F.row_number().over(Window.partitionBy("namespace").orderBy("r1", "module", "id")))
    return two.where("r2 <= 10").select("namespace", "module", "id")


@query("g18_intent_neighbourhoods", sql(_DEG + """ SELECT 'refactor' AS intent, f.id FROM functions f JOIN deg USING (id) WHERE fan_in >= 4 UNION ALL SELECT 'test', f.id FROM functions f LEFT JOIN deg USING (id) WHERE coalesce(fan_in, 0) = 0
UNION ALL SELECT 'debug', f.id FROM functions f JOIN churn USING (id) WHERE changes >= 40 UNION ALL SELECT 'document', id FROM functions WHERE end_line >= 48 UNION ALL SELECT 'design', id FROM nodes WHERE label = 'Module'
UNION ALL SELECT 'implement', f.id FROM functions f WHERE contains(name, 'plate') AND end_line < 5""", "functions", "calls", "churn"))
def g18(t):
    rows = t.functions.select("id", "name", "end_line").join(G.degrees(t.calls), "id", "left").join(t.churn.select("id", "changes"), "id", "left")
    rules = {"refactor": F.col("fan_in") >= 4, "test": F.coalesce("fan_in", F.lit(0)) == 0, "debug": F.col("changes") >= 40, "document": F.col("end_line") >= 48, "implement": F.contains("name", F.lit("plate")) & (F.col("end_line") < 5)}
    hits = F.filter(F.array(*[F.when(c, F.lit(k)) for k, c in rules.items()]), lambda x: x.isNotNull())  # one pass for all strategies
    design = t.nodes.where("label = 'Module'").select(F.lit("design").alias("intent"), "id")
    return rows.select(F.explode(hits).alias("intent"), "id").unionByName(design)


@query("g19_decayed_ranking", sql(", a AS (SELECT max(last_change) AS latest FROM churn) SELECT f.id, round(CASE WHEN contains(name, 'plate') THEN 10 ELSE 5 END + 0.3 * changes + 2 * exp(-CASE module WHEN 'ECONOMY' THEN 0.005 WHEN 'SMALL' THEN 0.02 ELSE 0.01 END * date_diff('day', CAST(last_change AS DATE), CAST(latest AS DATE))), 3) AS score FROM functions f JOIN churn USING (id), a WHERE contains(name, 'plate') OR contains(name, 'red')", "functions", "churn"))
def g19(t):
    asof = t.churn.agg(F.max("last_change").alias("asof"))
    rows = t.functions.where(F.contains("name", F.lit("plate")) | F.contains("name", F.lit("red"))).join(t.churn, "id").crossJoin(F.broadcast(asof))  # one row
    rate = F.when(F.col("module") == "ECONOMY", 0.005).when(F.col("module") == "SMALL", 0.02).otherwise(0.01)
    text = F.when(F.contains("name", F.lit("plate")), 10).otherwise(5)
    return rows.select("id", F.round(text + 0.3 * F.col("changes") + 2 * F.exp(-rate * F.datediff("asof", "last_change")), 3).alias("score"))


@query("g20_hubs_and_cycles", sql(_DEG + """, imports AS (SELECT DISTINCT a.module AS src, b.module AS dst FROM calls JOIN functions a ON a.id = src JOIN functions b ON b.id = dst WHERE a.module <> b.module),
 every AS (SELECT 'call' AS kind, src, dst FROM calls UNION ALL SELECT 'import', src, dst FROM imports),
 r AS (SELECT kind, src, dst FROM every UNION SELECT r.kind, r.src, e.dst FROM r JOIN every e ON e.kind = r.kind AND e.src = r.dst)
 SELECT 'hub' AS kind, id, NULL AS component FROM deg WHERE fan_in >= 3
 UNION ALL SELECT a.kind || '_cycle', a.src, least(a.src, min(a.dst)) FROM r a JOIN r b ON a.kind = b.kind AND a.src = b.dst AND a.dst = b.src WHERE a.src <> a.dst GROUP BY a.kind, a.src""", "functions", "calls", recursive=True))
def g20(t):
    """Hubs, and the nodes on cycles of any length of calls or module imports, with their strongly connected component."""
    hubs = G.degrees(t.calls).where("fan_in >= 3").select(F.lit("hub").alias("kind"), "id", F.lit(None).cast("string").alias("component"))
    named = lambda kind, edges: R.strongly_connected(edges).select(F.lit(kind).alias("kind"), F.col("node").alias("id"), "component")
    return hubs.unionByName(named("call_cycle", t.calls)).unionByName(named("import_cycle", imports(t)))


#: Edges of a path that is still looked for, and SQL that goes on level by level with the least path to each node.
_MOST = 10
_LEVELS = "".join(
    f""", l{k} AS (SELECT * FROM (SELECT start, goal, dst AS node, min(list_append(path, dst)) AS path FROM l{k - 1} JOIN ways ON src = node WHERE node <> goal GROUP BY ALL) n
      WHERE NOT EXISTS (SELECT 1 FROM s{k - 1} s WHERE s.start = n.start AND s.goal = n.goal AND s.node = n.node)),
 s{k} AS (SELECT * FROM s{k - 1} UNION ALL SELECT * FROM l{k})"""
    for k in range(1, _MOST + 1)
)


@query("g20_shortest_paths", sql(_DEG + """, hubs AS (SELECT module, arg_min(id, {'f': -fan_in, 'id': id}) AS goal FROM deg JOIN functions USING (id) GROUP BY module),
 ways AS (SELECT src, dst FROM calls UNION SELECT dst, src FROM calls),
 l0 AS (SELECT id AS start, goal, id AS node, [id] AS path FROM functions CROSS JOIN hubs WHERE end_line = 11), s0 AS (SELECT * FROM l0)""" + _LEVELS + f"""
 SELECT start, goal, len(path) - 1 AS length, array_to_string(path, '>') AS path FROM s{_MOST} WHERE node = goal""", "functions", "calls"))
def g20p(t):
    """How a function is connected with the hub of each module, by calls in either direction: the shortest path."""
    modules = t.functions.select("id", "module").hint("merge")  # its file is far smaller than its rows, too many for a broadcast
    hubs = G.degrees(t.calls).join(modules, "id").groupBy("module").agg(F.min_by("id", F.struct((-F.col("fan_in")).alias("f"), "id")).alias("goal"))
    pairs = t.functions.where("end_line = 11").select(F.col("id").alias("start")).crossJoin(F.broadcast(hubs.select("goal")))  # a row for each module type
    ways = t.calls.select("src", "dst").unionByName(t.calls.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    found = R.shortest_paths(ways, pairs, _MOST)
    return found.select("start", "goal", F.col("length").cast("long").alias("length"), F.array_join("path", ">").alias("path"))


@query("g21_confidence_impact", sql(_REVERSE + " SELECT target, node, distance, round(0.9 * power(0.7, distance - 1), 4) AS confidence FROM hit", "functions", "calls", recursive=True))
def g21(t):
    hit = G.reach(t.calls, t.functions.where("end_line = 9"), 3, reverse=True)
    return hit.select(F.col("start").alias("target"), "node", "distance", F.round(0.9 * F.pow(F.lit(0.7), F.col("distance") - 1), 4).alias("confidence"))


@query("g22_change_type_risk", sql(_DEG + """, b AS (SELECT f.id, CASE module WHEN 'ECONOMY' THEN 20 WHEN 'SMALL' THEN 50 WHEN 'LARGE' THEN 60 WHEN 'PROMO' THEN 40 ELSE 45 END + least(3 * coalesce(fan_in, 0), 30) + least(coalesce(fan_out, 0), 20) AS s FROM functions f LEFT JOIN deg USING (id))
SELECT id, least(s, 100) AS score, CASE WHEN s >= 75 THEN 'critical' WHEN s >= 50 THEN 'high' WHEN s >= 30 THEN 'medium' ELSE 'low' END AS band FROM b""", "functions", "calls"))
def g22(t):
    base = F.when(F.col("module") == "ECONOMY", 20).when(F.col("module") == "SMALL", 50).when(F.col("module") == "LARGE", 60).when(F.col("module") == "PROMO", 40).otherwise(45)
    rows = t.functions.join(G.degrees(t.calls), "id", "left")
    s = base + F.least(3 * F.coalesce("fan_in", F.lit(0)), F.lit(30)) + F.least(F.coalesce("fan_out", F.lit(0)), F.lit(20))
    return rows.select("id", F.least(s, F.lit(100)).alias("score"), F.when(s >= 75, "critical").when(s >= 50, "high").when(s >= 30, "medium").otherwise("low").alias("band"))


@query("g23_test_suggestions", sql(_REVERSE + ", r AS (SELECT *, row_number() OVER (PARTITION BY target, distance = 1 ORDER BY distance, node) AS rn FROM hit) SELECT target, node, distance FROM r WHERE (distance = 1 AND rn <= 10) OR (distance > 1 AND rn <= 5)", "functions", "calls", recursive=True))
def g23(t):
    hit = G.reach(t.calls, t.functions.where("end_line = 9"), 3, reverse=True)
    rn = F.row_number().over(Window.partitionBy("start", F.col("distance") == 1).orderBy("distance", "node"))
    return hit.withColumn("rn", rn).where("(distance = 1 and rn <= 10) or (distance > 1 and rn <= 5)").select(F.col("start").alias("target"), "node", "distance")


@query("g24_module_rollup", sql("SELECT a.module AS src_module, b.module AS dst_module, count(*) AS weight, count(*) > 5 AS strong FROM calls JOIN functions a ON a.id = src JOIN functions b ON b.id = dst WHERE a.module <> b.module GROUP BY ALL", "functions", "calls"))
def g24(t):
    a, b = (t.functions.select(F.col("id").alias(x), F.col("module").alias(f"{x}_module")) for x in ("src", "dst"))
    rolled = t.calls.join(a, "src").join(b, "dst").where("src_module <> dst_module").groupBy("src_module", "dst_module").agg(F.count("*").alias("weight"))
    return rolled.withColumn("strong", F.col("weight") > 5)


@query("g25_layer_violations", sql(", l AS (SELECT id, CASE WHEN module IN ('ECONOMY', 'STANDARD') THEN 0 WHEN module IN ('SMALL', 'MEDIUM') THEN 1 ELSE 2 END AS layer FROM functions) SELECT src, dst, a.layer AS src_layer, b.layer AS dst_layer FROM calls JOIN l a ON a.id = src JOIN l b ON b.id = dst WHERE a.layer > b.layer", "functions", "calls"))
def g25(t):
    layer = F.when(F.col("module").isin("ECONOMY", "STANDARD"), 0).when(F.col("module").isin("SMALL", "MEDIUM"), 1).otherwise(2)
    a, b = (t.functions.select(F.col("id").alias(x), layer.alias(f"{x}_layer")) for x in ("src", "dst"))
    return t.calls.join(a, "src").join(b, "dst").where("src_layer > dst_layer").select("src", "dst", "src_layer", "dst_layer")


@query("g26_sequence_steps", sql(", top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY dst) AS rn FROM calls) WHERE rn <= 5), walk AS (SELECT id AS start, id AS node, 0 AS depth, id AS chain FROM functions WHERE end_line = 7 UNION ALL SELECT start, dst, depth + 1, chain || '>' || dst FROM walk JOIN top ON src = node WHERE depth < 2) SELECT start, depth, chain FROM walk WHERE depth > 0", "functions", "calls", recursive=True))
def g26(t):
    top = t.calls.withColumn("rn", F.row_number().over(Window.partitionBy("src").orderBy("dst"))).where("rn <= 5")
    found = G.paths(top, t.functions.where("end_line = 7"), 2)
    return found.select("start", F.col("length").alias("depth"), F.array_join("chain", ">").alias("chain"))


@query("g27_module_docs", sql("SELECT module, count(*) AS functions, count(DISTINCT namespace) AS namespaces, array_to_string(list_sort(list(DISTINCT name))[1:8], ',') AS names, max(end_line) AS longest FROM functions GROUP BY module", "functions"))
def g27(t):
    docs = t.functions.groupBy("module").agg(F.count("*").alias("functions"), F.countDistinct("namespace").alias("namespaces"), F.max("end_line").alias("longest"))
    few = S.capped(t.functions, "module", "name", 8, "n")
    return docs.join(few, "module", "left").select("module", "functions", "namespaces", F.array_join("n", ",").alias("names"), "longest")


#: Modules that call each other's functions: src, dst.
_IMPORTS = ", imports AS (SELECT DISTINCT a.module AS src, b.module AS dst FROM calls JOIN functions a ON a.id = src JOIN functions b ON b.id = dst WHERE a.module <> b.module)"


def imports(t):
    a, b = (t.functions.select(F.col("id").alias(x), F.col("module").alias(f"{x}_module")) for x in ("src", "dst"))
    return t.calls.join(a, "src").join(b, "dst").where("src_module <> dst_module").select(F.col("src_module").alias("src"), F.col("dst_module").alias("dst")).distinct()


# Joins that the retrieval and state queries are made of.


@query("j01_inner_join", "SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey")
def j01(t):
    return t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey")).select("n_name", "r_name")


@query("j02_filtered_inner_join", "SELECT c_custkey, o_orderkey FROM customer JOIN orders ON c_custkey = o_custkey WHERE o_orderstatus = 'P' AND c_acctbal > 0")
def j02(t):
    jobs = t.orders.where("o_orderstatus = 'P'").select("o_orderkey", "o_custkey")
    return t.customer.where("c_acctbal > 0").join(jobs, F.col("c_custkey") == F.col("o_custkey")).select("c_custkey", "o_orderkey")


@query("j03_left_traversal", sql("SELECT f.id, count(dst) AS callees FROM functions f LEFT JOIN calls ON src = f.id GROUP BY f.id", "functions", "calls"))
def j03(t):
    counts = t.calls.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("callees"))
    return t.functions.select("id").join(counts, "id", "left").select("id", F.coalesce("callees", F.lit(0)).alias("callees"))


@query("j04_inner_traversal", sql("SELECT a.name AS caller, b.name AS callee, count(*) AS n FROM calls JOIN functions a ON a.id = src JOIN functions b ON b.id = dst GROUP BY ALL", "functions", "calls"))
def j04(t):
    a, b = t.functions.select(F.col("id").alias("src"), F.col("name").alias("caller")), t.functions.select(F.col("id").alias("dst"), F.col("name").alias("callee"))
    return t.calls.join(a, "src").join(b, "dst").groupBy("caller", "callee").agg(F.count("*").alias("n"))


@query("j05_two_hops", sql("SELECT a.src AS top, b.dst AS leaf, count(*) AS ways FROM edges a JOIN edges b ON a.dst = b.src WHERE a.type = 'DEFINES' AND b.type = 'DEFINES' GROUP BY ALL", "edges"))
def j05(t):
    d = t.edges.where("type = 'DEFINES'")
    second = d.select(F.col("src").alias("dst"), F.col("dst").alias("leaf"))
    return d.select(F.col("src").alias("top"), "dst").join(second, "dst").groupBy("top", "leaf").agg(F.count("*").alias("ways"))


@query("j06_variable_length", sql(_PATHS.format(depth=3) + " SELECT start, node, min(length) AS nearest, count(*) AS walks FROM walk WHERE length > 0 GROUP BY ALL", "functions", "calls", recursive=True))
def j06(t):
    found = G.paths(t.calls, t.functions.where("end_line = 7"), 3)
    return found.groupBy("start", "node").agg(F.min("length").alias("nearest"), F.count("*").alias("walks"))


@query("j07_two_cycles", sql(_IMPORTS + " SELECT a.src AS a, a.dst AS b FROM imports a JOIN imports b ON a.src = b.dst AND a.dst = b.src WHERE a.src < a.dst", "functions", "calls"))
def j07(t):
    edges = stored(imports(t))
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return edges.join(back, ["src", "dst"], "left_semi").where("src < dst").select(F.col("src").alias("a"), F.col("dst").alias("b"))


@query("j08_anti_join", sql("SELECT id FROM functions f WHERE NOT EXISTS (SELECT 1 FROM calls WHERE src = f.id OR dst = f.id)", "functions", "calls"))
def j08(t):
    """Functions with no call at all, in either direction."""
    ends = t.calls.select(F.explode(F.array("src", "dst")).alias("id"))
    return t.functions.select("id").join(ends, "id", "left_anti")


@query("j09_semi_join_in_order", "SELECT ord, doc_id FROM (SELECT unnest([7, 3, 3, 11, 999999]) AS doc_id, unnest([0, 1, 2, 3, 4]) AS ord) WHERE doc_id IN (SELECT doc_id FROM documents)")
def j09(t):
    wanted = t.spark.range(1).select(F.posexplode(F.array(*[F.lit(x) for x in (7, 3, 3, 11, 999999)])).alias("ord", "doc_id"))
    return wanted.join(t.documents.select("doc_id"), "doc_id", "left_semi").select("ord", "doc_id")


@query("j10_prefix_join", "SELECT page_id, arg_max(h, length(h)) AS host FROM pages JOIN (SELECT DISTINCT regexp_extract(url, '^(https?://[^/]+/)', 1) AS h FROM pages) ON starts_with(url, h) AND h <> '' GROUP BY page_id")
def j10(t):
    host = F.regexp_extract("url", "^(https?://[^/]+/)", 1)  # a url's own host is the only one it starts with, so no join is needed
    return t.pages.select("page_id", host.alias("host")).where("host <> ''")


@query("j11_time_proximity", "SELECT DISTINCT a.event_id FROM events a JOIN events b ON a.user_id = b.user_id AND b.event_type = 'click' AND abs(date_diff('second', a.ts, b.ts)) < 3600 WHERE a.event_type = 'signup'")
def j11(t):
    hour = lambda c: F.floor(F.unix_timestamp(c) / 3600)
    a = t.events.where("event_type = 'signup'").select("event_id", "user_id", "ts", F.explode(F.array(hour("ts") - 1, hour("ts"), hour("ts") + 1)).alias("bucket"))
    b = t.events.where("event_type = 'click'").select("user_id", F.col("ts").alias("other"), hour("ts").alias("bucket"))
    near = F.abs(F.unix_timestamp("ts") - F.unix_timestamp("other")) < 3600
    return a.join(b, ["user_id", "bucket"]).where(near).select("event_id").distinct()


@query("j12_two_key_lookup", sql("SELECT DISTINCT f.id, w.w FROM functions f JOIN (SELECT DISTINCT c_mktsegment AS w FROM customer UNION SELECT 'red plate' UNION SELECT 'Brand#2:old rod') w ON f.name = w.w OR f.namespace || ':' || f.name = w.w", "functions"))
def j12(t):
    words = t.customer.select(F.col("c_mktsegment").alias("w")).union(t.spark.range(1).select(F.explode(X.strings(["red plate", "Brand#2:old rod"])))).distinct()
    keys = t.functions.select("id", F.explode(F.array("name", F.concat("namespace", F.lit(":"), "name"))).alias("w"))
    return keys.join(words, "w").select("id", "w").distinct()


@query("j13_scalar_subquery", "SELECT o_orderkey, coalesce((SELECT max(l_shipdate) FROM lineitem WHERE l_orderkey = o_orderkey), o_orderdate) AS due FROM orders")
def j13(t):
    last = t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.max("l_shipdate").alias("ship"))
    return t.orders.select("o_orderkey", "o_orderdate").join(last, "o_orderkey", "left").select("o_orderkey", F.coalesce("ship", "o_orderdate").alias("due"))


@query("j14_nested_children", "SELECT o_orderkey, array_to_string(list(l_partkey || ':' || l_suppkey ORDER BY l_linenumber, l_partkey, l_suppkey), ',') AS lines FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1")
def j14(t):
    child = F.struct("l_linenumber", "l_partkey", "l_suppkey")
    lines = t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.array_sort(F.collect_list(child)).alias("c"))
    text = F.array_join(F.transform("c", lambda x: F.concat(x["l_partkey"], F.lit(":"), x["l_suppkey"])), ",")
    return t.orders.select("o_orderkey").join(lines, "o_orderkey").select("o_orderkey", text.alias("lines"))


@query("j15_id_intersection", "SELECT user_id FROM events WHERE event_type = 'signup' INTERSECT SELECT user_id FROM events WHERE event_type = 'purchase'")
def j15(t):
    both = t.events.where("event_type in ('signup', 'purchase')").groupBy("user_id").agg(F.countDistinct("event_type").alias("k"))
    return both.where("k = 2").select("user_id")


@query("j16_siblings", sql("SELECT a.dst AS node, b.dst AS sibling FROM edges a JOIN edges b ON a.src = b.src AND a.dst <> b.dst WHERE a.type = 'DEFINES' AND b.type = 'DEFINES' AND a.dst IN ('s1', 's2', 'n3')", "edges"))
def j16(t):
    d = t.edges.where("type = 'DEFINES'").select("src", "dst")
    a = d.where(F.col("dst").isin("s1", "s2", "n3")).select("src", F.col("dst").alias("node"))
    return a.join(d.withColumnRenamed("dst", "sibling"), "src").where("node <> sibling").select("node", "sibling")


@query("j17_reference_validation", "SELECT name, count(p_partkey) > 0 AS found FROM (SELECT unnest(['red plate', 'no such', 'old rod']) AS name) LEFT JOIN part ON p_name = name GROUP BY name")
def j17(t):
    names = t.spark.range(1).select(F.explode(X.strings(["red plate", "no such", "old rod"])).alias("name"))
    known = t.part.groupBy(F.col("p_name").alias("name")).agg(F.count("*").alias("n"))
    return names.join(known, "name", "left").select("name", (F.coalesce("n", F.lit(0)) > 0).alias("found"))


@query("j18_patterns_times_text", "SELECT item_id, CAST(regexp_matches(lower(text), 'the') AS INT) + CAST(regexp_matches(lower(text), 'tion') AS INT) AS score FROM benchmark")
def j18(t):
    low = F.lower("text")
    return t.benchmark.select("item_id", (low.rlike("the").cast("int") + low.rlike("tion").cast("int")).alias("score"))

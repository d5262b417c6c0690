"""The given tables, and the property graph, logs and states that Spark derives from them.

Functions are parts, classes suppliers, modules nations, files regions. DEFINES follows region, nation, supplier; CALLS
joins consecutive parts of an order's returned lines, urgent orders only.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.fulltext import FullText, index_of
from ..operators.vectors import VectorIndex, vector_index_of
from .scratch import folder

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)


class Tables:
    """Lazy tables of one folder; each attribute is a DataFrame whose scan reads only the columns used."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name not in TABLES:
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def nodes(self) -> DataFrame:
        """id, label, name, namespace, module, start_line, end_line."""
        null = F.lit(None)
        functions = self.part.select(
            F.concat(F.lit("p"), "p_partkey").alias("id"), F.lit("Function").alias("label"), F.col("p_name").alias("name"),
            F.col("p_brand").alias("namespace"), F.col("p_type").alias("module"), F.lit(0).alias("start_line"), F.col("p_size").alias("end_line"),
        )
        nations = self.nation.select("n_nationkey", F.col("n_name").alias("module"))
        classes = self.supplier.join(nations, F.col("s_nationkey") == F.col("n_nationkey"), "left").select(
            F.concat(F.lit("s"), "s_suppkey"), F.lit("Class"), "s_name", null.cast("string"), "module", null.cast("int"), null.cast("int")
        )
        modules = self.nation.select(F.concat(F.lit("n"), "n_nationkey"), F.lit("Module"), "n_name", null.cast("string"), null.cast("string"), null.cast("int"), null.cast("int"))
        files = self.region.select(F.concat(F.lit("r"), "r_regionkey"), F.lit("File"), "r_name", null.cast("string"), null.cast("string"), null.cast("int"), null.cast("int"))
        return functions.unionAll(classes).unionAll(modules).unionAll(files)

    @cached_property
    def functions(self) -> DataFrame:
        return self.nodes.where("label = 'Function'")

    @cached_property
    def calls(self) -> DataFrame:
        """src, dst, type of CALLS edges, distinct and without loops."""
        urgent = self.orders.where("o_orderpriority = '1-URGENT'").select("o_orderkey")
        lines = self.lineitem.where("l_returnflag = 'R'").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
        lines = lines.join(urgent, F.col("l_orderkey") == F.col("o_orderkey"), "left_semi")
        follow = F.lead("l_partkey").over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey"))
        pairs = lines.select(F.col("l_partkey").alias("a"), follow.alias("b")).where("b is not null and a <> b").distinct()
        return pairs.select(F.concat(F.lit("p"), "a").alias("src"), F.concat(F.lit("p"), "b").alias("dst"), F.lit("CALLS").alias("type"))

    @cached_property
    def edges(self) -> DataFrame:
        """CALLS and DEFINES edges: src, dst, type."""
        defines = self.nation.select(F.concat(F.lit("r"), "n_regionkey"), F.concat(F.lit("n"), "n_nationkey"), F.lit("DEFINES"))
        owns = self.supplier.select(F.concat(F.lit("n"), "s_nationkey"), F.concat(F.lit("s"), "s_suppkey"), F.lit("DEFINES"))
        return self.calls.unionAll(defines).unionAll(owns)

    @cached_property
    def churn(self) -> DataFrame:
        """id, changes, last_change of each function that any line names."""
        return self.lineitem.groupBy(F.concat(F.lit("p"), "l_partkey").alias("id")).agg(F.count("*").alias("changes"), F.max("l_shipdate").alias("last_change"))

    @cached_property
    def references(self) -> DataFrame:
        """The reference log: node_name, node_type, ts, weight."""
        return self.events.select(F.col("user_id").cast("string").alias("node_name"), F.col("event_type").alias("node_type"), "ts", F.col("value").alias("weight"), "event_id")

    @cached_property
    def jobs(self) -> DataFrame:
        """The queue's history: job_id, owner, status, priority, requested_at, cost."""
        status = F.when(F.col("o_orderstatus") == "F", "succeeded").when(F.col("o_orderstatus") == "P", "running").otherwise("queued")
        return self.orders.select(
            F.col("o_orderkey").alias("job_id"), F.col("o_custkey").alias("owner"), status.alias("status"), F.col("o_orderpriority").alias("priority"),
            F.col("o_orderdate").alias("requested_at"), F.col("o_totalprice").alias("cost"),
        )

    @cached_property
    def fulltext(self) -> FullText:
        """The application's index of the documents' texts."""
        return index_of(self.spark, self.documents, "doc_id", "text", folder)

    @cached_property
    def vectors(self) -> VectorIndex:
        """The application's index of the embeddings."""
        return vector_index_of(self.spark, self.embeddings, "vec_id", "embedding", folder)

    def vector_of(self, number: int) -> DataFrame:
        """The one-row query (query, q) that is the embedding of this number."""
        return self.embeddings.where(F.col("vec_id") == number).limit(1).select(F.lit("").alias("query"), F.col("embedding").alias("q"))

    @cached_property
    def turns(self) -> DataFrame:
        """conv_id, turn, role, text, intent: the first word's first letter class stands for a turn's intent."""
        return self.conversations.select("conv_id", "turn", "role", "text", F.lower(F.substring(F.ltrim("text"), 1, 1)).alias("intent"))


#: The same bindings as DuckDB common table expressions, for the queries' SQL.
SQL = {
    "nodes": """nodes AS (
      SELECT 'p' || p_partkey AS id, 'Function' AS label, p_name AS name, p_brand AS namespace, p_type AS module, 0 AS start_line, p_size AS end_line FROM part
      UNION ALL SELECT 's' || s_suppkey, 'Class', s_name, NULL, n_name, NULL, NULL FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey
      UNION ALL SELECT 'n' || n_nationkey, 'Module', n_name, NULL, NULL, NULL, NULL FROM nation
      UNION ALL SELECT 'r' || r_regionkey, 'File', r_name, NULL, NULL, NULL, NULL FROM region)""",
    "functions": "functions AS (SELECT * FROM nodes WHERE label = 'Function')",
    "calls": """calls AS (
      SELECT DISTINCT 'p' || a AS src, 'p' || b AS dst, 'CALLS' AS type FROM (
        SELECT l_partkey AS a, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS b
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderpriority = '1-URGENT' AND l_returnflag = 'R')
      WHERE b IS NOT NULL AND a <> b)""",
    "edges": """edges AS (
      SELECT * FROM calls
      UNION ALL SELECT 'r' || n_regionkey, 'n' || n_nationkey, 'DEFINES' FROM nation
      UNION ALL SELECT 'n' || s_nationkey, 's' || s_suppkey, 'DEFINES' FROM supplier)""",
    "churn": "churn AS (SELECT 'p' || l_partkey AS id, count(*) AS changes, max(l_shipdate) AS last_change FROM lineitem GROUP BY 1)",
    "refs": "refs AS (SELECT CAST(user_id AS VARCHAR) AS node_name, event_type AS node_type, ts, value AS weight, event_id FROM events)",
    "jobs": """jobs AS (
      SELECT o_orderkey AS job_id, o_custkey AS owner, CASE o_orderstatus WHEN 'F' THEN 'succeeded' WHEN 'P' THEN 'running' ELSE 'queued' END AS status,
             o_orderpriority AS priority, o_orderdate AS requested_at, o_totalprice AS cost FROM orders)""",
    "turns": "turns AS (SELECT conv_id, turn, role, text, lower(substr(ltrim(text), 1, 1)) AS intent FROM conversations)",
}
_NEEDS = {"functions": ("nodes",), "edges": ("calls",)}


def sql(body: str, *names: str, recursive: bool = False) -> str:
    """``body`` after the bindings it uses; ``body`` may begin with further expressions, comma first."""
    order: list[str] = []
    for name in names:
        order += [x for x in (*_NEEDS.get(name, ()), name) if x not in order]
    head = "WITH " + ("RECURSIVE " if recursive else "")
    return f"{head}{', '.join(SQL[x] for x in order)} {body}" if order else f"{head}{body.lstrip().removeprefix(',')}" if body.lstrip().startswith(",") else body

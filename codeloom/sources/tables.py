"""A symbol graph from ordinary tables: regions hold nations (files), nations hold customers (classes) and suppliers (interfaces), customers hold orders (methods); parts are functions."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


class StarGraph:
    """Nodes, edges and files of the star schema, whole tables; each is built, and its tables are read, when it is first asked for.

    ``calls`` run from orders to their parts and from parts to their suppliers, ``references`` from customers to suppliers of returned goods,
    ``imports`` from each nation to the three nations that supply it most often, ``extends`` from each customer to the one before it in its
    nation and segment, and ``implements`` from customers to the first supplier of their nation.
    """

    refs = None

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def _table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def _place(self) -> DataFrame:
        """Each nation's path; one row for each nation."""
        place = self._table("nation").join(self._table("region"), F.col("n_regionkey") == F.col("r_regionkey"))
        return place.select("n_nationkey", F.concat("r_name", F.lit("/"), "n_name").alias("path"))

    @cached_property
    def files(self) -> DataFrame:
        return self._place.select("path", F.lit("unknown").alias("language"))

    @cached_property
    def nodes(self) -> DataFrame:
        t = self._table

        def part(df: DataFrame, letter: str, key: str, kind: str, name, file, exported, place: int) -> DataFrame:
            return df.select(
                node(letter, key).alias("id"), F.lit(kind).alias("kind"), name.alias("name"), file.alias("file_path"), F.concat(file, F.lit("."), name).alias("qualified_name"), F.lit("unknown").alias("language"),
                exported.alias("is_exported"), F.lit(False).alias("is_abstract"), (F.lit(place) * F.lit(10**12) + F.col(key)).cast("long").alias("ord"),
            )

        place = F.broadcast(self._place)
        region, nation = t("region"), t("nation")
        customer = t("customer").join(place, F.col("c_nationkey") == F.col("n_nationkey"))
        supplier = t("supplier").join(place, F.col("s_nationkey") == F.col("n_nationkey"))
        orders = t("orders").join(customer.select("c_custkey", "path"), F.col("o_custkey") == F.col("c_custkey"))
        every = [
            part(region, "r", "r_regionkey", "namespace", F.col("r_name"), F.col("r_name"), F.lit(True), 0),
            part(nation.join(place.select(F.col("n_nationkey").alias("k"), "path"), F.col("n_nationkey") == F.col("k")), "n", "n_nationkey", "file", F.col("n_name"), F.col("path"), F.lit(False), 1),
            part(customer, "c", "c_custkey", "class", F.col("c_name"), F.col("path"), F.col("c_acctbal") > 0, 2),
            part(supplier, "s", "s_suppkey", "interface", F.col("s_name"), F.col("path"), F.col("s_acctbal") > 0, 3),
            part(orders, "o", "o_orderkey", "method", F.concat(F.lit("order"), F.col("o_orderkey").cast("string")), F.col("path"), F.lit(False), 4),
            part(t("part"), "p", "p_partkey", "function", F.col("p_name"), F.concat(F.lit("parts/"), F.col("p_brand")), F.col("p_size") > 25, 5),
        ]
        out = every[0]
        for n in every[1:]:
            out = out.unionByName(n)
        return out

    @cached_property
    def edges(self) -> DataFrame:
        t = self._table

        def edge(df: DataFrame, a: tuple[str, str], b: tuple[str, str], kind: str, provenance: str = "tree-sitter") -> DataFrame:
            return df.select(node(*a).alias("source"), node(*b).alias("target"), F.lit(kind).alias("kind"), F.lit(provenance).alias("provenance"))

        region_of = t("nation")
        line = t("lineitem")
        sold = line.join(t("orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
        back = sold.where("l_returnflag = 'R'").select("o_custkey", "l_suppkey").distinct()
        lanes = sold.join(t("customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey")).join(t("supplier").select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))
        lanes = lanes.where("c_nationkey <> s_nationkey").groupBy("c_nationkey", "s_nationkey").agg(F.count("*").alias("n"))
        lanes = lanes.withColumn("k", F.row_number().over(Window.partitionBy("c_nationkey").orderBy(F.desc("n"), "s_nationkey"))).where("k <= 3")
        chain = t("customer").withColumn("above", F.lag("c_custkey").over(Window.partitionBy("c_nationkey", "c_mktsegment").orderBy("c_custkey"))).where("above is not null")
        first = t("supplier").groupBy(F.col("s_nationkey").alias("nk")).agg(F.min("s_suppkey").alias("first_supp"))
        kinds = [
            edge(region_of, ("r", "n_regionkey"), ("n", "n_nationkey"), "contains"),
            edge(t("customer"), ("n", "c_nationkey"), ("c", "c_custkey"), "contains"),
            edge(t("supplier"), ("n", "s_nationkey"), ("s", "s_suppkey"), "contains"),
            edge(t("orders"), ("c", "o_custkey"), ("o", "o_orderkey"), "contains"),
            edge(line.select("l_orderkey", "l_partkey").distinct(), ("o", "l_orderkey"), ("p", "l_partkey"), "calls", "scope-resolution"),
            edge(line.select("l_partkey", "l_suppkey").distinct(), ("p", "l_partkey"), ("s", "l_suppkey"), "calls", "scope-resolution"),
            edge(back, ("c", "o_custkey"), ("s", "l_suppkey"), "references", "heuristic"),
            edge(lanes, ("n", "c_nationkey"), ("n", "s_nationkey"), "imports", "import-resolution"),
            edge(chain, ("c", "c_custkey"), ("c", "above"), "extends", "scope-resolution"),
            edge(t("customer").join(F.broadcast(first), F.col("c_nationkey") == F.col("nk")), ("c", "c_custkey"), ("s", "first_supp"), "implements", "scope-resolution"),
        ]
        edges = kinds[0]
        for e in kinds[1:]:
            edges = edges.unionByName(e)
        # An order of edges that does not depend on how they were read.
        return edges.withColumn("ord", F.xxhash64("source", "target", "kind"))


def node(letter: str, key: str) -> Column:
    return F.concat(F.lit(f"{letter}:"), F.col(key).cast("string"))


def star_graph(spark: SparkSession, sf_dir: str) -> StarGraph:
    return StarGraph(spark, sf_dir)


#: The same nodes and edges in SQL, for comparison.
STAR_SQL = """
place AS (SELECT n_nationkey AS nk, r_name || '/' || n_name AS path FROM nation JOIN region ON n_regionkey = r_regionkey),
g_nodes AS (
  SELECT 'r:' || r_regionkey AS id, 'namespace' AS kind, r_name AS name, r_name AS file_path, true AS is_exported, CAST(r_regionkey AS BIGINT) AS ord FROM region
  UNION ALL SELECT 'n:' || n_nationkey, 'file', n_name, path, false, 1000000000000 + n_nationkey FROM nation JOIN place ON n_nationkey = nk
  UNION ALL SELECT 'c:' || c_custkey, 'class', c_name, path, c_acctbal > 0, 2000000000000 + c_custkey FROM customer JOIN place ON c_nationkey = nk
  UNION ALL SELECT 's:' || s_suppkey, 'interface', s_name, path, s_acctbal > 0, 3000000000000 + s_suppkey FROM supplier JOIN place ON s_nationkey = nk
  UNION ALL SELECT 'o:' || o_orderkey, 'method', 'order' || o_orderkey, path, false, 4000000000000 + o_orderkey FROM orders JOIN customer ON o_custkey = c_custkey JOIN place ON c_nationkey = nk
  UNION ALL SELECT 'p:' || p_partkey, 'function', p_name, 'parts/' || p_brand, p_size > 25, 5000000000000 + p_partkey FROM part),
g_edges AS (
  SELECT 'r:' || n_regionkey AS source, 'n:' || n_nationkey AS target, 'contains' AS kind FROM nation
  UNION ALL SELECT 'n:' || c_nationkey, 'c:' || c_custkey, 'contains' FROM customer
  UNION ALL SELECT 'n:' || s_nationkey, 's:' || s_suppkey, 'contains' FROM supplier
  UNION ALL SELECT 'c:' || o_custkey, 'o:' || o_orderkey, 'contains' FROM orders
  UNION ALL SELECT DISTINCT 'o:' || l_orderkey, 'p:' || l_partkey, 'calls' FROM lineitem
  UNION ALL SELECT DISTINCT 'p:' || l_partkey, 's:' || l_suppkey, 'calls' FROM lineitem
  UNION ALL SELECT DISTINCT 'c:' || o_custkey, 's:' || l_suppkey, 'references' FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_returnflag = 'R'
  UNION ALL SELECT 'n:' || a, 'n:' || b, 'imports' FROM (SELECT c_nationkey AS a, s_nationkey AS b, row_number() OVER (PARTITION BY c_nationkey ORDER BY count(*) DESC, s_nationkey) AS k
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey WHERE c_nationkey <> s_nationkey GROUP BY 1, 2) WHERE k <= 3
  UNION ALL SELECT 'c:' || c_custkey, 'c:' || above, 'extends' FROM (SELECT c_custkey, lag(c_custkey) OVER (PARTITION BY c_nationkey, c_mktsegment ORDER BY c_custkey) AS above FROM customer) WHERE above IS NOT NULL
  UNION ALL SELECT 'c:' || c_custkey, 's:' || f, 'implements' FROM customer JOIN (SELECT s_nationkey, min(s_suppkey) AS f FROM supplier GROUP BY 1) ON c_nationkey = s_nationkey)
"""

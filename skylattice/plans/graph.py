"""Station network graph (operators F02 to F04)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .aggregates import TRI, canonical_triangles
from .registry import register
from .surrogate import table


def triangles(spark, sf_dir) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").select(*[(F.col(c) % 40).alias(n) for c, n in (("l_orderkey", "a"), ("l_partkey", "b"), ("l_suppkey", "c"))]).filter("a != b AND b != c AND a != c")
    return canonical_triangles(li, "a", "b", "c").distinct()


def edges(t: DataFrame) -> DataFrame:
    """Directed edges of triangles v0, v1, v2."""
    pair = lambda i, j: F.struct(F.col(f"v{i}").alias("src"), F.col(f"v{j}").alias("dst"))
    return t.select(F.explode(F.array(pair(0, 1), pair(1, 2), pair(2, 0))).alias("e")).select("e.src", "e.dst")


T3 = f"t AS ({TRI}), c AS (SELECT CASE WHEN a <= b AND a <= c THEN [a, b, c] WHEN b <= a AND b <= c THEN [b, c, a] ELSE [c, a, b] END AS t FROM t WHERE a <> b AND b <> c AND a <> c), tri AS (SELECT DISTINCT t[1] AS v0, t[2] AS v1, t[3] AS v2 FROM c), ed AS (SELECT v0 AS src, v1 AS dst FROM tri UNION ALL SELECT v1, v2 FROM tri UNION ALL SELECT v2, v0 FROM tri)"


@register("f02_edges_of_triangles", f"WITH {T3} SELECT src, dst, count(*) AS n_triangles FROM ed GROUP BY 1, 2")
def edges_of_triangles(spark, sf_dir) -> DataFrame:
    return edges(triangles(spark, sf_dir)).groupBy("src", "dst").agg(F.count("*").alias("n_triangles"))


@register("f03_baseline_registry", "WITH p AS (SELECT o_custkey % 60 AS b, o_orderkey % 60 AS r, o_orderkey AS seq FROM orders) SELECT arg_min(b, seq) AS base, arg_min(r, seq) AS rover FROM p WHERE b <> r GROUP BY least(b, r), greatest(b, r)")
def baseline_registry(spark, sf_dir) -> DataFrame:
    """A base line and its reverse are one: the first direction asked for stays."""
    p = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 60).alias("b"), (F.col("o_orderkey") % 60).alias("r"), "o_orderkey").filter("b != r")
    g = p.groupBy(F.least("b", "r").alias("_x"), F.greatest("b", "r").alias("_y")).agg(F.min_by(F.struct("b", "r"), "o_orderkey").alias("_f"))
    return g.select(F.col("_f.b").alias("base"), F.col("_f.r").alias("rover"))


@register("f04_mutation_log", "SELECT user_id AS vertex, arg_max(event_type, {'t': ts, 'e': event_id}) AS op FROM events GROUP BY user_id HAVING op <> 'error'")
def mutation_log(spark, sf_dir) -> DataFrame:
    """State after a log of additions and deletions: the last operation of each vertex, without those deleted."""
    g = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("vertex")).agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("op"))
    return g.filter("op != 'error'")


@register("j07_subnets", f"WITH {T3} SELECT src AS vertex, array_to_string(list_sort(list_distinct(list(dst))), ',') AS neighbours FROM (SELECT src, dst FROM ed UNION SELECT dst, src FROM ed) GROUP BY src")
def subnets(spark, sf_dir) -> DataFrame:
    """Neighbours of each vertex; a planar network has few for each."""
    e = edges(triangles(spark, sf_dir))
    both = e.union(e.select("dst", "src"))
    return both.groupBy(F.col("src").alias("vertex")).agg(F.concat_ws(",", F.transform(F.array_sort(F.collect_set("dst")), lambda v: v.cast("string"))).alias("neighbours"))

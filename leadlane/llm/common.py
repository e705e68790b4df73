"""Helpers shared by the text operators: table access, ASCII word rules, hashing keys and connected components."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut_lineage

#: The word separators of every contract: space and the control characters 9 to 13.
ASCII_SPACE = " \t\n\x0b\f\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def workers_find_package(spark: SparkSession) -> None:
    """Python workers import this package from where the driver has it; on a cluster it is shipped with the job
    (--py-files) or installed, and this path is one more that they try."""
    root = str(Path(__file__).resolve().parents[2])
    env = spark.sparkContext.environment
    paths = [x for x in env.get("PYTHONPATH", "").split(os.pathsep) if x]
    if root not in paths:
        env["PYTHONPATH"] = os.pathsep.join([*paths, root])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables; Spark's own reader, so any store Spark can open works."""
    workers_find_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: str | None) -> list[bytes]:
    """Lower-cased (A-Z only) words of a text, as UTF-8. Bytes methods touch ASCII alone, which is the contract's rule."""
    return text.encode().lower().split() if text else []


def text_tag(col) -> F.Column:
    """128 bits that tell rows of the same doc_id but another text apart (null counts as its own value)."""
    return F.coalesce(F.unhex(F.md5(F.col(col).cast("string").cast("binary"))), F.lit(b""))


def components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """Connected components of an undirected edge list, as (node, component = smallest node reachable).

    Alternating large-star and small-star rounds: every round is one grouped minimum (combined before the shuffle)
    and a join back, so a hub's links are never gathered in one task and skewed hubs are split by the join. Each round
    is written to the shared checkpoint folder, which cuts the lineage; the loop ends when a round changes nothing and
    takes about log2 of the longest path. Self links and repeated links are allowed; nodes without a link to another
    node do not appear. Null ends are ignored.
    """
    e = (edges.select(F.least(a, b).alias("u"), F.greatest(a, b).alias("v"))
         .where("u is not null and v is not null and u < v").distinct())
    e = cut_lineage(e)
    seen = None
    for _ in range(max_rounds):
        # Large star: every larger neighbour of a node moves to the smallest of that node's neighbourhood.
        both = e.select(F.col("u").alias("n"), F.col("v").alias("m")).unionAll(
            e.select(F.col("v").alias("n"), F.col("u").alias("m")))
        low = cut_lineage(both.groupBy("n").agg(F.min("m").alias("low")).select("n", F.least("n", "low").alias("low")))
        e = cut_lineage(both.where("m > n").join(low, "n").where("m != low")
                        .select(F.col("low").alias("u"), F.col("m").alias("v")).distinct())
        # Small star: a node and its smaller neighbours all point to the smallest of them.
        low = cut_lineage(e.groupBy(F.col("v").alias("n")).agg(F.min("u").alias("low")))
        j = e.select(F.col("v").alias("n"), F.col("u").alias("m")).join(low, "n")
        e = cut_lineage(j.where("m != low").select(F.col("low").alias("u"), F.col("m").alias("v"))
                        .unionAll(low.select(F.col("low").alias("u"), F.col("n").alias("v"))).distinct())
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    # Settled: each edge leads from a root to a leaf, and each root stands for itself.
    return e.select(F.col("v").alias("node"), F.col("u").alias("component")).unionAll(
        e.select(F.col("u").alias("node"), F.col("u").alias("component")).distinct())

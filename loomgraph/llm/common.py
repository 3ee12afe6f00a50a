"""Helpers of the training-data operators: shared folder, seeded hashes, connected components."""

from __future__ import annotations

import gc
import re
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII blanks separate words; everything else is part of one.
WORD_BREAK = r"[\x20\x09-\x0D]+"
#: Edges from which a node may count as a hub, how many hubs may be told apart, and the tasks one is dealt to.
HUB_EDGES, HUBS, HUB_SALTS = 1000, 5000, 32


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def words(text: Column) -> Column:
    """The words of a text as an array; null counts as no text."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), WORD_BREAK), lambda w: w != "")


def named(df: DataFrame, *out: str, used: tuple[str, ...] = ()) -> list[Column]:
    """The columns of ``df`` but those named like ``out``, in any case, whose place an operator's own take.

    A column that the operator reads cannot give way, so its name in ``out`` is an error.
    """
    taken = {n.lower() for n in out}
    if clash := [n for n in used if n.lower() in taken]:
        raise ValueError(f"columns that are read bear names of results: {', '.join(clash)}")
    return [F.col(f"`{c.replace('`', '``')}`") for c in df.columns if c.lower() not in taken]


def seeded(seed: int, *parts: Column) -> Column:
    """60 random-looking bits of the parts as a long; the same in any SQL engine with md5."""
    key = F.concat_ws(":", F.lit(str(seed)), *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return F.conv(F.substring(F.md5(key), 1, 15), 16, 10).cast("long")


def shared_dir(spark: SparkSession) -> str:
    """A new folder that the driver and all executors see.

    It lies under ``spark.checkpoint.dir``.  Only a session without that setting, as
    in tests on one machine, gets a local folder.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = "file:///tmp/loomgraph-checkpoints"
    return f"{base.rstrip('/')}/loomgraph/{uuid.uuid4().hex}"


def bound_batches(spark: SparkSession) -> None:
    """Has Arrow batches of this session hold 4 MB or 2,000 rows at most.

    Rows here carry whole texts, of any length, so batches must be cut by bytes for a worker's memory to be
    bounded.  Smaller values that the session already has stay.
    """
    for name, most in (("spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20), ("spark.sql.execution.arrow.maxRecordsPerBatch", 2000)):
        now = re.fullmatch(r"(-?\d+)b?", str(spark.conf.get(name, None)))
        if now is None or not 0 < int(now[1]) <= most:
            spark.conf.set(name, str(most))


def materialize(df: DataFrame) -> DataFrame:
    """Cuts the lineage: writes the rows to the shared folder and reads them back."""
    spark = df.sparkSession
    path = shared_dir(spark)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._folder = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes written tables that nothing still to be computed reads."""
    for t in tables:
        path = t.sparkSession._jvm.org.apache.hadoop.fs.Path(t._folder)
        path.getFileSystem(t.sparkSession._jsc.hadoopConfiguration()).delete(path, True)
    release(tables[0].sparkSession)


def release(spark: SparkSession) -> None:
    """Has Spark drop the shuffle files and broadcasts of finished work.

    They go once neither Python nor the JVM refers to their plans, so both are asked to look.
    """
    gc.collect()
    spark._jvm.System.gc()


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the smallest node reachable, for every node of an edge.

    Alternating large-star and small-star rounds; edges only move towards smaller
    nodes, so the logarithm of the longest path bounds the rounds.  Each round is a
    partial aggregation and a join, written to the shared folder; the driver sees
    only the number of edges and a checksum.
    """
    flat = materialize(edges.select(F.greatest(a, b).alias("v"), F.least(a, b).alias("u")).filter("v <> u").distinct())

    def star(e: DataFrame, large: bool, hubs: DataFrame | None) -> DataFrame:
        out = e.select(F.col("v").alias("x"), F.col("u").alias("y"))
        if large:
            out = out.union(e.select(F.col("u").alias("x"), F.col("v").alias("y")))
        low = out.groupBy("x").agg(F.min("y").alias("m")).select("x", F.least("x", "m").alias("m"))
        kept, keys, near = out.filter("y > x") if large else out, ["x"], low
        if hubs is not None:
            salts = F.when(F.col("hub"), F.sequence(F.lit(0), F.lit(HUB_SALTS - 1))).otherwise(F.array(F.lit(0)))
            near = low.join(F.broadcast(hubs), "x", "left").select("x", "m", F.explode(salts).alias("salt"))
            salt = F.when(F.col("hub"), F.pmod(F.xxhash64("y"), F.lit(HUB_SALTS)).cast("int")).otherwise(0)
            kept, keys = kept.join(F.broadcast(hubs), "x", "left").select("x", "y", salt.alias("salt")), ["x", "salt"]
        moved = kept.join(near, keys).select(F.col("y").alias("v"), F.col("m").alias("u"))
        if not large:
            moved = moved.union(low.select(F.col("x").alias("v"), F.col("m").alias("u")))
        return moved.filter("v <> u").distinct()

    def hubs_of(e: DataFrame, n: int) -> DataFrame | None:
        """Nodes of so many edges that they are dealt to several tasks; 2 * HUBS at most, as every edge has two ends."""
        most = max(HUB_EDGES, n // HUBS)
        if n <= most:
            return None
        ends = e.select(F.col("v").alias("x")).union(e.select("u")).groupBy("x").agg(F.count("*").alias("n"))
        found = [(r["x"], True) for r in ends.filter(F.col("n") > most).select("x").collect()]
        return e.sparkSession.createDataFrame(found, e.select(F.col("u").alias("x"), F.lit(True).alias("hub")).schema) if found else None

    def print_of(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("v", "u").cast("decimal(20,0)"))).first())

    last = print_of(flat)
    while last[0]:
        hubs, old = hubs_of(flat, last[0]), flat
        flat = materialize(star(star(flat, True, hubs), False, hubs))
        discard(old)
        now = print_of(flat)
        if now == last:
            break
        last = now
    tops = flat.select(F.col("u").alias("node")).distinct()
    return flat.select(F.col("v").alias("node"), F.col("u").alias("component")).union(tops.select("node", F.col("node").alias("component"))).distinct()

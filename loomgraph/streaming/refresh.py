"""Streams: incremental refresh of a tree's extraction, the touch ring, windowed activity."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from loomgraph.operators.touches import SCHEMA as TOUCH
from loomgraph.operators.touches import trim
from loomgraph.plans import index
from loomgraph.sources.scan import lossy_text

FILES = "path string, modificationTime timestamp, length bigint, content binary"


def watch(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """New and changed files of a folder, as they appear."""
    files = spark.readStream.format("binaryFile").schema(FILES).option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root)
    return files.select("path", lossy_text(F.col("content")).alias("content"), F.xxhash64("content").alias("content_hash"))


def refresh(stream: DataFrame, language: str, table: str, checkpoint: str):
    """Extracts what arrives and appends it to a table; run with what is there, then stops.

    A file whose path and content hash the table has is not extracted again.
    """

    def add(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        files = batch.dropDuplicates(["path", "content_hash"]).withColumn("language", F.lit(language))
        try:
            known = spark.read.parquet(table).select("path", "content_hash")
            files = files.join(known, ["path", "content_hash"], "left_anti")
        except Exception as e:  # the first batch has no table yet
            if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
                raise
        index.extract(files).write.mode("append").parquet(table)

    return stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def touch_rings(stream: DataFrame, key: str = "project") -> DataFrame:
    """The ring of each project after every batch; the state is one ring per project.

    Entries (key, ts, seq, files, why, agent) of a batch are applied in order of ts and seq.
    """
    columns = ["ts", "files", "why", "agent"]

    def update(project, frames, state):
        ring = [dict(zip(columns, (t, list(f), w, a), strict=True)) for t, f, w, a in zip(*state.get, strict=True)] if state.exists else []
        new = pd.concat(list(frames)).sort_values(["ts", "seq"])
        for r in new.to_dict("records"):
            ring = trim([*ring, {"ts": int(r["ts"]), "files": list(r["files"]), "why": r["why"], "agent": r["agent"]}])
        state.update(tuple([e[c] for e in ring] for c in columns))
        yield pd.DataFrame([{key: project[0], **e} for e in ring], columns=[key, *columns])

    kind = stream.schema[key].dataType.simpleString()
    held = "ts array<bigint>, files array<array<string>>, why array<string>, agent array<string>"
    return stream.groupBy(key).applyInPandasWithState(update, f"{key} {kind}, {TOUCH}", held, "update", GroupStateTimeout.NoTimeout)


def activity(stream: DataFrame, time: str = "ts", group: str = "agent", width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Entries per group and tumbling window, with late ones up to the watermark; goes beyond the reference."""
    return stream.withWatermark(time, late).groupBy(F.window(time, width).alias("w"), group).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), group, "n")


def current(answers: DataFrame, version: str) -> DataFrame:
    """Side results of this version of the tree only; those of others are dropped."""
    return answers.filter(F.col("version") == version)

"""The ring of recent edits: at most 250 entries, and at most 10 that mention a file.

Whole-entry trimming depends on the order of writes, so entries of several files are replayed one by
one; the state is at most one ring, whatever the history's length.
"""

from __future__ import annotations

import json
import os
import time
from collections import Counter

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomgraph.functions import text as T

MOST, PER_FILE = 250, 10
SCHEMA = "ts bigint, files array<string>, why string, agent string"


def trim_single(entries: DataFrame, file: str = "file", order: tuple[str, ...] = ("ts",), most: int = MOST, per_file: int = PER_FILE) -> DataFrame:
    """For entries of one file each: the newest per file, then the newest of all; the same as trimming at every write."""
    newest = [F.desc(c) for c in order]
    ranked = entries.withColumn("_r", F.row_number().over(Window.partitionBy(file).orderBy(*newest)))
    return ranked.filter(F.col("_r") <= per_file).drop("_r").orderBy(*newest).limit(most)


def trim(ring: list[dict], most: int = MOST, per_file: int = PER_FILE) -> list[dict]:
    """Newest to oldest: an entry stays unless one of its files has had its share; oldest first in the result."""
    kept, seen = [], Counter()
    for entry in reversed(ring):
        if len(kept) == most:
            break
        if all(seen[f] < per_file for f in entry["files"]):
            seen.update(entry["files"])
            kept.append(entry)
    return kept[::-1]


def replay(ring: list[dict], new: list[dict]) -> list[dict]:
    for entry in new:
        ring = trim([*ring, entry])
    return ring


def replay_history(entries: DataFrame, key: str = "project") -> DataFrame:
    """The ring of each project after all its entries (key, ts, seq, files, why, agent), written in order of ts and seq.

    Rows stream through a task in order; only the ring is held.
    """
    rows = entries.repartition(key).sortWithinPartitions(key, "ts", "seq")
    columns = ["ts", "files", "why", "agent"]

    def run(frames):
        held, ring = None, []

        def out():
            return pd.DataFrame([{key: held, **e} for e in ring], columns=[key, *columns])

        for f in frames:
            for r in f.to_dict("records"):
                if r[key] != held:
                    if ring:
                        yield out()
                    held, ring = r[key], []
                ring = trim([*ring, {c: list(r[c]) if c == "files" else r[c] for c in columns}])
        if ring:
            yield out()

    return rows.select(key, *columns).mapInPandas(run, f"{key} {entries.schema[key].dataType.simpleString()}, {SCHEMA}")


def recent(ring: DataFrame, file: str | None = None, limit: int = 10) -> DataFrame:
    """Newest first; with a file, entries that mention it or a path that ends in it."""
    if file:
        ring = ring.filter(F.exists("files", lambda f: T.mentions(f, F.lit(file))))
    return ring.orderBy(F.desc("ts")).limit(max(1, min(limit, 50)))


class TouchLog:
    """A JSON-lines ring in a folder: tolerant reads, atomic writes under a lock file."""

    def __init__(self, folder: str):
        self.path, self.lock = os.path.join(folder, "touches.jsonl"), os.path.join(folder, "touches.lock")
        os.makedirs(folder, exist_ok=True)

    def read(self) -> list[dict]:
        out = []
        if os.path.exists(self.path):
            with open(self.path, encoding="utf-8") as f:
                for line in f:
                    try:
                        e = json.loads(line)
                        out.append({"ts": int(e["ts"]), "files": list(e["files"]), "why": e.get("why", ""), "agent": e.get("agent", "")})
                    except (ValueError, KeyError, TypeError):
                        continue
        return out

    def frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(e["ts"], e["files"], e["why"], e["agent"]) for e in self.read()], SCHEMA)

    def record(self, files: list[str], why: str, agent: str = "", ts: int | None = None) -> dict:
        """Appends an entry and trims; returns the entry, the ring's size and its files' mentions."""
        entry = {"ts": int(time.time()) if ts is None else ts, "files": [f.strip().replace("\\", "/").removeprefix("./") for f in files], "why": why, "agent": agent}
        for attempt in range(200):
            try:
                os.close(os.open(self.lock, os.O_CREAT | os.O_EXCL))
                break
            except FileExistsError:
                try:
                    stale = time.time() - os.path.getmtime(self.lock) > 10
                except OSError:
                    stale = False
                if stale:
                    os.unlink(self.lock)
                elif attempt == 199:
                    raise
                time.sleep(0.015)
        try:
            ring = trim([*self.read(), entry])
            with open(self.path + ".tmp", "w", encoding="utf-8") as f:
                f.writelines(json.dumps(e) + "\n" for e in ring)
            os.replace(self.path + ".tmp", self.path)
        finally:
            os.unlink(self.lock)
        return {"entry": entry, "total": len(ring), "mentions": {x: sum(x in e["files"] for e in ring) for x in entry["files"]}}

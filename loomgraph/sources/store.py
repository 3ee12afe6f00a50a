"""The index as versions of Parquet tables beside the tree, each complete once its manifest is written.

Everything goes through Hadoop paths, so a tree on shared storage gets its index there.  No rename is
needed: a version whose manifest is missing or cut off is passed over for the one before it.
"""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame, SparkSession

from loomgraph.sources.storage import Folder

FOLDER = ".loomgraph"
#: How many versions are kept; readers of the last but one may still be at work.
KEPT = 2


def _versions(folder: Folder, pattern: str) -> list[int]:
    return sorted((int(m[1]) for n in folder.names() if (m := re.fullmatch(pattern, n))), reverse=True)


def save(tables: dict[str, DataFrame], root: str, fingerprint: str, stats: dict) -> str:
    """Writes the tables beside the tree and then the manifest that makes them the index."""
    folder = Folder(next(iter(tables.values())).sparkSession, f"{root.rstrip('/')}/{FOLDER}")
    folder.write(".gitignore", "*\n")
    version = 1 + max(_versions(folder, r"v(\d+)"), default=0)
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(folder.uri(f"v{version}/{name}"))
    manifest = {"version": version, "fingerprint": fingerprint, "tables": sorted(tables), "stats": stats}
    folder.write(f"manifest-{version}.json", json.dumps(manifest))
    for old in _versions(folder, r"v(\d+)"):
        if old <= version - KEPT:
            folder.remove(f"manifest-{old}.json")
            folder.remove(f"v{old}")
    return f"v{version}"


def load(spark: SparkSession, root: str) -> tuple[dict[str, DataFrame], str, dict] | None:
    """(tables, fingerprint, stats) of the newest complete version, or None without one."""
    folder = Folder(spark, f"{root.rstrip('/')}/{FOLDER}")
    for version in _versions(folder, r"manifest-(\d+)\.json"):
        try:
            m = json.loads(folder.read(f"manifest-{version}.json") or "")
        except ValueError:
            continue
        return {t: spark.read.parquet(folder.uri(f"v{version}/{t}")) for t in m["tables"]}, m["fingerprint"], m["stats"]
    return None

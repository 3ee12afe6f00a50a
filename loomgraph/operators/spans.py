"""Containment of points and spans: innermost owner, enclosing chain, running maximum.

Owners and points share a key such as a file.  Owners are spread over the blocks of a fixed
width they overlap, so a point meets the owners of its own block only, not all of its key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 4096


def _pairs(points: DataFrame, spans: DataFrame, keys: list[str], pos: str, end: str | None, block: int) -> DataFrame:
    s = spans.select(*keys, F.col("id").alias("span_id"), F.col("start").alias("s_start"), F.col("end").alias("s_end"))
    s = s.withColumn("_b", F.explode(F.sequence(F.expr(f"s_start div {block}"), F.expr(f"s_end div {block}"))))
    p = points.withColumn("_b", F.expr(f"{pos} div {block}"))
    last = F.col(end) if end else F.col(pos)
    return p.join(s, [*keys, "_b"]).filter((F.col("s_start") <= F.col(pos)) & (last <= F.col("s_end"))).drop("_b")


def innermost(points: DataFrame, spans: DataFrame, keys: list[str], point_id: str, pos: str, end: str | None = None, block: int = BLOCK) -> DataFrame:
    """Each point with the shortest span around it, ties to the smaller id; points in none have a null span_id."""
    # The smallest of a struct is a partial aggregate: no window over all spans around a point.
    best = _pairs(points, spans, keys, pos, end, block).groupBy(*keys, point_id).agg(F.min(F.struct((F.col("s_end") - F.col("s_start")).alias("len"), "span_id")).alias("m"))
    return points.join(best.select(*keys, point_id, F.col("m.span_id").alias("span_id")), [*keys, point_id], "left")


def enclosing_chain(points: DataFrame, spans: DataFrame, keys: list[str], point_id: str, pos: str, block: int = BLOCK) -> DataFrame:
    """The ids of all spans around each point, outermost first."""
    around = _pairs(points, spans, keys, pos, None, block)
    item = F.struct("s_start", (-F.col("s_end")).alias("e"), "span_id")
    return around.groupBy(*keys, point_id).agg(F.transform(F.array_sort(F.collect_list(item)), lambda x: x.span_id).alias("chain"))


def fold_prefixes(points: DataFrame, spans: DataFrame, keys: list[str], point_id: str, pos: str, prefix: str = "prefix", block: int = BLOCK) -> DataFrame:
    """The prefixes of the spans around each point, joined outermost first."""
    around = _pairs(points, spans, keys, pos, None, block).join(spans.select(F.col("id").alias("span_id"), prefix), "span_id")
    item = F.struct("s_start", (-F.col("s_end")).alias("e"), prefix)
    parts = F.transform(F.array_sort(F.collect_list(item)), lambda x: F.regexp_replace(x[prefix], "^/+|/+$", ""))
    out = around.groupBy(*keys, point_id).agg(parts.alias("parts"))
    return out.withColumn("path", F.concat(F.lit("/"), F.array_join(F.filter("parts", lambda x: x != ""), "/"))).drop("parts")


def running_max_end(spans: DataFrame, keys: list[str]) -> DataFrame:
    """The largest end so far in order of starts, the bound at which a scan for owners may stop."""
    w = Window.partitionBy(*keys).orderBy("start", "id").rowsBetween(Window.unboundedPreceding, 0)
    return spans.withColumn("max_end", F.max("end").over(w))

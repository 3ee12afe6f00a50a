"""Queries over functions and calls: search, callers, callees, packages, counts, liveness.

``functions`` has id, name, qualified_name, language, is_toplevel, ...; ``calls`` has idx, caller,
callee, ambiguous_with, name, line, kind (internal, external, unresolved), high, package.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.functions import text as T
from loomgraph.plans.lineage import materialize


def search_functions(functions: DataFrame, query: str, limit: int = 20) -> DataFrame:
    """The best matches by name: score descending, id ascending."""
    scored = functions.withColumn("score", T.search_score(F.col("name"), F.col("qualified_name"), F.col("is_toplevel"), query))
    return scored.filter("score is not null").orderBy(F.desc("score"), "id").limit(limit)


def callees(calls: DataFrame, caller: int, limit: int = 100) -> DataFrame:
    """Calls made by a function, in call order."""
    return calls.filter(F.col("caller") == caller).orderBy("idx").limit(limit)


def callers(calls: DataFrame, callee: int, limit: int = 50) -> DataFrame:
    """Calls of a function: resolved ones first, then those that may mean it; one limit for both."""
    direct = calls.filter((F.col("kind") == "internal") & (F.col("callee") == callee)).withColumn("rank", F.lit(0))
    maybe = calls.filter((F.col("kind") == "internal") & F.array_contains("ambiguous_with", callee)).withColumn("rank", F.lit(1))
    return direct.unionByName(maybe).orderBy("rank", "idx").limit(limit)


def list_packages(calls: DataFrame, limit: int = 100) -> DataFrame:
    """External packages by calls, with the number of distinct callers."""
    out = calls.filter("kind = 'external'").groupBy("package").agg(F.count("*").alias("calls"), F.countDistinct("caller").alias("callers"))
    return out.orderBy(F.desc("calls"), "package").limit(limit)


def packages_used(calls: DataFrame, caller: int) -> DataFrame:
    used = calls.filter((F.col("caller") == caller) & (F.col("kind") == "external"))
    return used.agg(F.array_sort(F.collect_set("package")).alias("packages"))


def resolution_stats(calls: DataFrame) -> DataFrame:
    """Call sites by how they were resolved, and sure ones among the internal."""
    return calls.groupBy("kind").agg(F.count("*").alias("n"), F.count_if(F.col("high") & (F.col("kind") == "internal")).alias("sure"))


def functions_by_language(functions: DataFrame) -> DataFrame:
    return functions.groupBy("language").agg(F.count("*").alias("n"))


def unique_or_null(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """One row per key: the value if all rows agree on it, else null."""
    one = F.count_distinct(value) == 1
    return rows.groupBy(*keys).agg(F.when(one, F.min(value)).alias(value))


def field_types(fields: DataFrame) -> DataFrame:
    """(owner, name, type_name) of the fields that have exactly one type."""
    return unique_or_null(fields, ["owner", "name"], "type_name").filter("type_name is not null")


def type_expansion(types: DataFrame, methods: DataFrame, bindings: DataFrame, registered: DataFrame | None = None) -> DataFrame:
    """(type, method id, hop): methods of a type, or of what is registered for it, else of what derives from it."""
    own = types.join(methods, types.type_name == methods.containing_type).select("type_name", F.col("id").alias("method"), F.lit(0).alias("hop"))
    derived = bindings.select(F.col("base").alias("type_name"), F.col("derived").alias("to"), F.lit(1).alias("order"))
    if registered is not None:
        derived = derived.unionByName(registered.select(F.col("abstract").alias("type_name"), F.col("concrete").alias("to"), F.lit(0).alias("order")))
    best = derived.withColumn("first", F.min("order").over(Window.partitionBy("type_name"))).filter("order = first")
    hop = types.join(best, "type_name").join(methods, F.col("to") == F.col("containing_type")).select("type_name", F.col("id").alias("method"), F.lit(1).alias("hop"))
    return own.unionByName(hop).distinct()


def unreferenced_functions(functions: DataFrame, called: DataFrame, referenced: DataFrame, handlers: DataFrame | None = None, language: str | None = None) -> DataFrame:
    """Functions that nothing names, with reason and class (excluded, public or strong).

    ``called`` and ``referenced`` have a column name; a name used anywhere keeps all its functions alive.
    Both are reduced to distinct names first, so the anti joins see each name once.
    """
    f = functions.filter(~F.col("is_toplevel"))
    if language:
        f = f.filter(F.col("language") == language)
    alive = called.select("name").union(referenced.select("name")).distinct()
    f = f.join(alive, "name", "left_anti")
    if handlers is None:
        f = f.withColumn("_handler", F.lit(False))
    else:
        f = f.join(handlers.select(F.col("handler").alias("id"), F.lit(True).alias("_handler")).distinct(), "id", "left")
    reason = F.when(F.col("has_decorations"), "decorated").when(F.coalesce("_handler", F.lit(False)), "endpoint_handler").otherwise(T.entry_point_reason(F.col("name")))
    public = F.col("is_exported") | T.looks_public(F.coalesce("signature", F.lit("")))
    return f.withColumn("reason", reason).drop("_handler").withColumn("class", F.when(F.col("reason").isNotNull(), "excluded").when(public, "public").otherwise("strong"))


def excluded_counts(unreferenced: DataFrame) -> DataFrame:
    return unreferenced.filter("reason is not null").groupBy("reason").agg(F.count("*").alias("n"))


def assign_ids(rows: DataFrame, order: list, name: str = "id") -> DataFrame:
    """Dense 0-based ids in a global order, without sending all rows to one task.

    Rows are range-partitioned and sorted; a row's id is the number of rows in earlier partitions,
    from a table with one row per partition, plus its place in its own.  Partitions are written with their
    numbers first: a range shuffle that is computed twice may be cut elsewhere.
    """
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = materialize(placed.withColumn("_p", F.spark_partition_id()).withColumn("_m", F.monotonically_increasing_id()))
    within = Window.partitionBy("_p").orderBy("_m")
    counts = placed.groupBy("_p").agg(F.count("*").alias("_n"))
    before = counts.withColumn("_before", F.coalesce(F.sum("_n").over(Window.partitionBy(F.lit(1)).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    return placed.join(F.broadcast(before), "_p").withColumn(name, (F.col("_before") + F.row_number().over(within) - 1).cast("long")).drop("_p", "_m", "_before")


def service_stats(paths: DataFrame, path: str = "path") -> DataFrame:
    """Files and summed sizes by service."""
    return paths.groupBy(T.service_of(F.col(path)).alias("service")).agg(F.count("*").alias("files"))


def centroids(points: DataFrame, group: str, axes: list[str]) -> DataFrame:
    return points.groupBy(group).agg(F.count("*").alias("n"), *[F.avg(a).alias(a) for a in axes])


def top_by_degree(functions: DataFrame, calls: DataFrame, limit: int = 5000) -> DataFrame:
    """The functions of most internal calls in either direction, by id."""
    inside = calls.filter("kind = 'internal'")
    ends = inside.select(F.col("caller").alias("id")).union(inside.select(F.col("callee").alias("id")))
    degree = ends.groupBy("id").agg(F.count("*").alias("degree"))
    return functions.join(degree, "id", "left").fillna(0, ["degree"]).orderBy(F.desc("degree"), "id").limit(limit)



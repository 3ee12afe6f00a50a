"""Routes that need facts of other files: global and module prefixes, versions, class views, view sets.

Detection leaves what one file cannot tell as ``versions``, ``action`` and ``handler_type`` of a route and
as project facts (kind, name, value); here they meet functions and base types by joins.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.functions import text as T

#: Actions of a view set with the mixin that brings each, and verbs a class view may answer.
VIEWSET = {"list": "ListModelMixin", "create": "CreateModelMixin", "retrieve": "RetrieveModelMixin", "update": "UpdateModelMixin", "partial_update": "UpdateModelMixin", "destroy": "DestroyModelMixin"}
READ_ONLY = ["list", "retrieve"]
VERBS = ["get", "post", "put", "patch", "delete", "head", "options"]


def lineage(classes: DataFrame, hierarchy: DataFrame, rounds: int = 4) -> DataFrame:
    """(class, member): each class itself and its bases up to ``rounds`` levels above, by name."""
    up = hierarchy.select(F.col("derived").alias("member"), "base").distinct()
    front = classes.select("class", F.col("class").alias("member"))
    levels = [front]
    for _ in range(rounds):
        front = front.join(up, "member").select("class", F.col("base").alias("member")).distinct()
        levels.append(front)
    return reduce(DataFrame.union, levels).distinct()


def prefixed_routes(rows: DataFrame, facts: DataFrame) -> DataFrame:
    """Nest routes under their global prefix, version and module prefix, in that order.

    A prefix stated in two ways is unknown and left out.  Versions count where versioning by path is on.
    """
    stated = F.when(F.col("kind") == "global_prefix", F.col("value"))
    found = facts.agg(F.count_distinct(stated).alias("n"), F.min(stated).alias("prefix"), F.max(F.col("kind") == "uri_versions").alias("versioned")).first()
    here = facts.filter("kind = 'module_prefix'").select("name", F.col("value").alias("_module"))
    members = facts.filter("kind = 'module_controller'").select("name", F.col("value").alias("handler_type"))
    modules = here.join(members, "name").groupBy("handler_type").agg(F.count_distinct("_module").alias("_n"), F.min("_module").alias("_module")).filter("_n = 1").drop("_n")
    nest = F.coalesce(F.col("framework") == "nestjs", F.lit(False))
    rows = rows.join(modules, "handler_type", "left")
    rows = rows.withColumn("_version", F.explode_outer(F.when(nest & F.lit(bool(found["versioned"])), F.col("versions"))))
    for outer in (F.col("_module"), F.concat(F.lit("v"), "_version"), F.lit(found["prefix"] if found["n"] == 1 else None).cast("string")):
        applies = nest & outer.isNotNull()
        rows = rows.withColumn("path", F.when(applies, T.join_prefix(outer, F.col("path"))).otherwise(F.col("path"))).withColumn("high", F.col("high") & ~applies)
    return rows.drop("_module", "_version", "versions")


def viewset_routes(rows: DataFrame, functions: DataFrame, hierarchy: DataFrame) -> DataFrame:
    """Keeps of a registered view set's six routes those its class answers; ``known`` is the handler if only one fits.

    Read-only bases give two, model view sets all, mixins theirs, else the actions defined by the class or its
    bases; a plain view set without any gives none, and a class of which nothing is known gives all.
    """
    is_set = F.coalesce(F.col("framework") == "drf", F.lit(False))
    members = lineage(rows.filter(is_set & F.col("handler_type").isNotNull()).select(F.col("handler_type").alias("class")).distinct(), hierarchy)
    holds = lambda word: F.max(F.col("member").contains(word))
    mixed = F.array_compact(F.array(*[F.when(holds(m), F.lit(a)) for a, m in VIEWSET.items()]))
    bases = members.filter("member <> class").groupBy("class").agg(holds("ReadOnly").alias("_ro"), holds("ModelViewSet").alias("_model"), holds("ViewSet").alias("_set"), mixed.alias("_mixed"))
    defined = functions.filter(F.col("name").isin(list(VIEWSET)) & F.col("containing_type").isNotNull()).select(F.col("id"), F.col("name").alias("action"), F.col("containing_type").alias("member"))
    own = members.join(defined, "member").groupBy("class", "action").agg(F.when(F.count("*") == 1, F.min("id")).alias("known"))
    # At most one entry per action.
    names = own.groupBy("class").agg(F.collect_set("action").alias("_own"))
    rows = rows.withColumn("class", F.when(is_set, F.col("handler_type"))).join(bases, "class", "left").join(names, "class", "left").join(own, ["class", "action"], "left")
    none = F.array().cast("array<string>")
    via, mine = F.coalesce("_mixed", none), F.coalesce("_own", none)
    answers = (
        F.when(F.col("_ro"), F.col("action").isin(READ_ONLY))
        .when(F.col("_model"), F.lit(True))
        .when(F.size(via) > 0, F.array_contains(via, F.col("action")))
        .when(F.size(mine) > 0, F.array_contains(mine, F.col("action")))
        .otherwise(~F.coalesce("_set", F.lit(False)))
    )
    return rows.filter(~is_set | F.col("class").isNull() | answers).drop("class", "_ro", "_model", "_set", "_mixed", "_own")


def class_view_routes(rows: DataFrame, functions: DataFrame) -> DataFrame:
    """A route to a class view becomes one per verb its class defines; without any it stays as it was."""
    verbs = functions.filter(F.col("name").isin(VERBS) & F.col("containing_type").isNotNull()).groupBy(F.col("containing_type").alias("_class"), F.col("name").alias("_verb")).agg(F.when(F.count("*") == 1, F.min("id")).alias("_fn"))
    rows = rows.withColumn("_class", F.when(F.col("action") == "view", F.col("handler_type"))).join(verbs, "_class", "left")
    hit = F.col("_verb").isNotNull()
    rows = rows.withColumn("method", F.when(hit, F.upper("_verb")).otherwise(F.col("method"))).withColumn("high", F.col("high") & ~hit)
    rows = rows.withColumn("typed", hit | F.coalesce(F.col("framework") == "drf", F.lit(False))).withColumn("known", F.when(hit, F.col("_fn")).otherwise(F.col("known")))
    # A class without verbs may still be a callable known by its name.
    plain = (F.col("action") == "view") & ~hit
    rows = rows.withColumn("handler", F.when(plain, F.col("handler_type")).otherwise(F.col("handler"))).withColumn("handler_type", F.when(plain, F.lit(None)).otherwise(F.col("handler_type")))
    return rows.drop("_class", "_verb", "_fn", "action")


def complete(rows: DataFrame, facts: DataFrame, functions: DataFrame, hierarchy: DataFrame) -> DataFrame:
    """All of the above; adds ``known``, a handler already known, and ``typed``, whether only that one may count."""
    return class_view_routes(viewset_routes(prefixed_routes(rows, facts), functions, hierarchy), functions)

"""Building the index: scan, extract, detect, resolve, correlate, vectorise, as tables."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.functions import text as T
from loomgraph.operators import correlate, graph, resolve, routes
from loomgraph.operators import vectors as V
from loomgraph.operators.traverse import effect_features
from loomgraph.plans.lineage import materialize
from loomgraph.sources import detect as D
from loomgraph.sources import iac, scan
from loomgraph.sources.frontends import SCHEMA, extract_text

#: Receivers that stand for a language's own library.
BUILTINS = {
    "cpp": ["std"],
    "csharp": ["Console", "Math", "Convert"],
    "java": ["System", "Math", "Objects", "Arrays", "Collections"],
    "javascript": ["console", "Math", "JSON", "Object", "Array", "Promise"],
    "typescript": ["console", "Math", "JSON", "Object", "Array", "Promise"],
    "tsx": ["console", "Math", "JSON", "Object", "Array", "Promise"],
    "kotlin": ["System"],
    "swift": ["Swift"],
}
EXTRACTED = f"path string, language string, content_hash bigint, record struct<{', '.join(p for p in SCHEMA.split(', '))}>, found struct<{D.SCHEMA}>, iac {iac.ROW}"


def extract(files: DataFrame, evidence: list[str] | None = None) -> DataFrame:
    """One row per file with its record, its detections and its declared routes, from Arrow batches of texts."""
    proof = list(evidence or [])

    def run(frames):
        for f in frames:
            out = []
            for path, language, text, h in zip(f["path"], f["language"], f["content"], f["content_hash"], strict=True):
                record = extract_text(language, path, text)
                found = D.detect(language, path, record, proof)
                out.append((path, language, h, record, found, iac.findings(path, text or "")))
            yield pd.DataFrame(out, columns=["path", "language", "content_hash", "record", "found", "iac"])

    schema = EXTRACTED.replace(": ", ":")
    return files.select("path", "language", "content", "content_hash").mapInPandas(run, _typed(schema))


def _typed(schema: str) -> str:
    """Fields of the nested structs with colons."""
    head, _, rest = schema.partition("record struct<")
    body, _, tail = rest.partition(", found struct<")
    found, _, last = tail.partition(", iac ")
    colon = lambda s: re.sub(r"(^|, )(\w+) (?=\w)", r"\1\2:", s)
    return f"{head}record struct<{colon(body)}, found struct<{colon(found)}, iac {last}"


def tables(extracted: DataFrame) -> dict[str, DataFrame]:
    """The relational tables of extracted files; ids follow paths and the order of definitions."""
    files = graph.assign_ids(extracted.select("path", "language", F.col("record.package").alias("package"), "content_hash"), ["path"])
    files = materialize(files)
    e = extracted.join(files.select("path", F.col("id").alias("file_id")), "path")
    flat = e.select("file_id", "path", "language", F.col("record.package").alias("package"), F.posexplode("record.functions").alias("ord", "f"))
    functions = graph.assign_ids(flat, ["file_id", "ord"])
    functions = materialize(functions)
    name = T.qualified_name(F.col("package"), F.col("path"), F.col("f.containing_type"), F.col("f.name"))
    marked = F.exists("f.decorations", lambda d: T.is_test_mark(d["name"]))
    test = T.is_test_file(F.col("path")) | marked | T.is_test_name(F.col("f.name"), F.col("language"))
    plain = ["name", "start_line", "end_line", "signature", "containing_type", "param_count", "is_toplevel", "is_exported"]
    out = {"files": files}
    out["functions"] = functions.select(
        "id", *[F.col(f"f.{c}").alias(c) for c in plain], name.alias("qualified_name"), "file_id", "path", "language", (F.size("f.decorations") > 0).alias("has_decorations"), (test & ~F.col("f.is_toplevel")).alias("is_test"), "ord"
    )
    raw = functions.select(F.col("id").alias("caller"), "file_id", F.posexplode("f.calls").alias("call_ord", "c"))
    raw = materialize(graph.assign_ids(raw, ["caller", "call_ord"], "idx"))
    out["raw_calls"] = raw.select("idx", "caller", "file_id", "c.*")
    out["literals"] = raw.select(F.col("idx").alias("call"), "file_id", F.posexplode("c.arg_lits").alias("ord", "l")).select("call", "file_id", "ord", "l.*")
    out["imports"] = e.select("file_id", F.posexplode("record.imports").alias("ord", "i")).select("file_id", "ord", "i.*")
    out["decorations"] = functions.select(F.col("id").alias("fn_id"), F.posexplode("f.decorations").alias("ord", "d")).select("fn_id", "ord", "d.*")
    out["locals"] = functions.select(F.col("id").alias("fn_id"), F.explode("f.locals").alias("l")).select("fn_id", "l.*")
    out["fields"] = e.select("file_id", F.explode("record.fields").alias("x")).select("x.*")
    out["hierarchy"] = e.select("file_id", F.explode("record.hierarchy").alias("x")).select("file_id", "x.*")
    out["consts"] = e.select("file_id", F.explode("record.consts").alias("x")).select("file_id", "x.*")
    out["bags"] = functions.select(F.col("id").alias("fn_id"), F.explode("f.features").alias("feature", "tf")).withColumn("tf", F.col("tf").cast("long"))
    return out


def _handlers(rows: DataFrame, functions: DataFrame) -> DataFrame:
    """Handlers by name, unless already known: the only one in the file, by type if it is known, else the only one anywhere."""
    f = functions.filter(~F.col("is_toplevel")).select(F.col("id").alias("fn"), F.col("name").alias("handler"), "file_id", "containing_type")
    here = rows.join(f, ["handler", "file_id"]).filter("handler_type is null or handler_type = containing_type").groupBy("row").agg(F.count("*").alias("n"), F.min("fn").alias("h1")).filter("n = 1")
    lone = f.groupBy("handler").agg(F.count("*").alias("n"), F.min("fn").alias("h2")).filter("n = 1").drop("n")
    return rows.join(here.select("row", "h1"), "row", "left").join(lone, "handler", "left").withColumn("handler", F.when(F.col("typed"), F.col("known")).otherwise(F.coalesce("h1", "h2"))).drop("h1", "h2", "handler_type", "known", "typed")


def detections(extracted: DataFrame, t: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Endpoints with handlers and cross-file prefixes, client calls, test cases and bridge ends."""
    e = extracted.join(t["files"].select("path", F.col("id").alias("file_id")), "path").select("file_id", "language", "found", "iac")
    by_ord = t["functions"].select("file_id", F.col("ord").alias("caller_ord"), F.col("id").alias("caller"))
    code = e.select("file_id", F.posexplode("found.endpoints").alias("n", "x")).select("file_id", "n", "x.*").withColumn("require_handler", F.lit(False))
    declared = e.select("file_id", F.posexplode("iac").alias("n", "x")).select("file_id", (F.col("n") + 100000).alias("n"), "x.*", F.lit(None).cast("string").alias("handler_type"), F.lit(None).cast("string").alias("var"))
    declared = declared.withColumn("handler", F.regexp_extract(F.regexp_replace("handler", r"\(\)$", ""), r"([A-Za-z_]\w*)$", 1))
    rows = code.unionByName(declared, allowMissingColumns=True)
    facts = materialize(e.select(F.explode("found.facts").alias("x")).select("x.*"))
    rows = routes.complete(rows, facts, t["functions"], t["hierarchy"])
    rows = materialize(graph.assign_ids(rows, ["file_id", "line", "n", "method", "path"], "row"))
    mounts = e.select("file_id", F.posexplode("found.mounts").alias("ord", "m")).select("file_id", "ord", F.col("m.target").alias("path"), F.col("m.prefix").alias("prefix"))
    wanted = mounts.select("file_id", "ord", "path", F.array().cast("array<string>").alias("names"))
    # Python mounts name a bound module or a dotted path; both resolve as imports do.
    bound = t["imports"].select("file_id", F.explode("names").alias("path"), F.col("path").alias("module"))
    wanted = wanted.join(bound, ["file_id", "path"], "left").withColumn("path", F.coalesce(F.when(F.col("module").contains("."), F.col("module")), "module", "path")).select("file_id", "ord", "path", "names").dropDuplicates(["file_id", "ord"])
    targets = resolve.classify_imports(wanted, t["files"]).filter("resolved_file is not null").select("file_id", "ord", "resolved_file")
    links = mounts.join(targets, ["file_id", "ord"]).select(F.col("resolved_file").alias("child"), F.col("file_id").alias("parent"), "prefix").filter("child <> parent")
    links = links.join(t["files"].select(F.col("id").alias("child"), "language"), "child").withColumn("hops", F.when(F.col("language") == "python", 12).when(F.col("language") == "go", 8).otherwise(4)).drop("language")
    prefixes = correlate.compose_prefixes(links).withColumnRenamed("child", "file_id").withColumn("mounted", F.lit(True))
    rows = rows.join(prefixes, "file_id", "left")
    full = F.when(F.col("mounted") & F.col("prefix").isNotNull(), T.join_prefix(F.col("prefix"), F.col("path"))).otherwise(F.col("path"))
    rows = rows.withColumn("path_raw", full).withColumn("high", F.col("high") & (F.col("mounted").isNull() | F.col("prefix").isNotNull())).drop("prefix", "mounted", "path")
    rows = _handlers(rows, t["functions"]).filter("not require_handler or handler is not null")
    endpoints = rows.select(F.col("row").alias("id"), "kind", "method", "path_raw", T.normalize_path(F.col("path_raw")).alias("path_norm"), "framework", "file_id", "line", "handler", "high").filter("path_norm is not null")
    calls = e.select("file_id", F.posexplode("found.clients").alias("n", "x")).select("file_id", "n", "x.kind", "x.method", F.col("x.url").alias("url_raw"), "x.library", "x.line", F.col("x.caller").alias("caller_ord"), "x.high")
    clients = graph.assign_ids(calls.withColumn("path_norm", T.normalize_path(F.col("url_raw"))).filter("path_norm is not null").join(by_ord, ["file_id", "caller_ord"]), ["file_id", "line", "n"]).drop("n", "caller_ord")
    cases = e.select("file_id", "language", F.posexplode("found.cases").alias("n", "x")).select("file_id", "language", "n", "x.name", "x.framework", "x.kind", "x.line", "x.suite", F.col("x.function").alias("caller_ord"))
    cases = cases.join(by_ord.withColumnRenamed("caller", "function"), ["file_id", "caller_ord"], "left").join(t["files"].select(F.col("id").alias("file_id"), "path"), "file_id")
    natives = e.select("file_id", F.posexplode("found.natives").alias("n", "x")).select("file_id", "n", "x.module", "x.alias", "x.method", "x.mechanism", F.col("x.function").alias("caller_ord")).join(by_ord.withColumnRenamed("caller", "function"), ["file_id", "caller_ord"])
    js = e.select("file_id", F.posexplode("found.bridge_calls").alias("n", "x")).select("file_id", "n", "x.module", "x.method", "x.line", F.col("x.caller").alias("caller_ord"), "x.high").join(by_ord, ["file_id", "caller_ord"])
    return {
        "endpoints": endpoints,
        "clients": clients,
        "test_cases": graph.assign_ids(cases, ["file_id", "line", "n"]).drop("n", "caller_ord"),
        "bridge_natives": graph.assign_ids(natives, ["file_id", "n"]).drop("n", "caller_ord"),
        "bridge_calls": graph.assign_ids(js, ["file_id", "n"]).drop("n", "caller_ord"),
    }


def build(spark: SparkSession, root: str, cache: DataFrame | None = None) -> tuple[dict[str, DataFrame], dict]:
    """All tables of a tree and its statistics; ``cache`` is the extraction of an earlier build."""
    files = materialize(scan.scan_tree(spark, root))
    proof = scan.manifest_evidence(spark, root)
    if cache is not None and cache.schema.simpleString() != extract(files, proof).schema.simpleString():
        cache = None  # of an earlier layout
    kept, todo = scan.split_cached(files, cache)
    fresh = materialize(extract(todo, proof))
    parsed = fresh.count()
    extracted = fresh if kept is None else materialize(kept.unionByName(fresh))
    t = tables(extracted)
    t["imports"] = materialize(resolve.classify_imports(t["imports"], t["files"]))
    bindings = t["hierarchy"].select("derived", "base").union(resolve.injection_bindings(t["raw_calls"], t["literals"]).select(F.col("concrete"), F.col("abstract"))).distinct()
    calls = resolve.resolve_calls(t["raw_calls"].select("idx", "caller", "name", "receiver", "line", "arg_count", "name_line", "name_col"), t["functions"], t["imports"], t["files"], t["locals"], t["fields"], bindings, BUILTINS)
    t["calls"] = materialize(calls)
    t |= {k: materialize(v) for k, v in detections(extracted, t).items()}
    t["matches"] = materialize(correlate.correlate(t["clients"], t["endpoints"]))
    t["bridge_matches"] = materialize(correlate.bridge_matches(t["bridge_calls"], t["bridge_natives"]))
    used = t["calls"].filter("kind = 'external'").select(F.col("caller").alias("fn_id"), F.concat(F.lit("pkg:"), "package").alias("feature"), F.lit(1).cast("long").alias("tf"))
    effects = effect_features(t["functions"], t["calls"])
    bags = V.merge_bags(V.augment_bags(t["bags"], t["locals"]), used, effects)
    t["bags"] = materialize(bags)
    t["vectors"] = V.structural_vectors(t["bags"])
    t["semantic"] = V.semantic_vectors(t["bags"])
    t["extracted"] = extracted
    kinds = {r["kind"]: r["n"] for r in graph.resolution_stats(t["calls"]).collect()}
    skipped, paths = scan.skipped_files(files, extracted)
    stats = {
        "files": files.count(),
        "functions": t["functions"].count(),
        "calls": sum(kinds.values()),
        "resolved_internal": kinds.get("internal", 0),
        "resolved_external": kinds.get("external", 0),
        "unresolved": kinds.get("unresolved", 0),
        "external_packages": t["calls"].filter("kind = 'external'").select("package").distinct().count(),
        "parsed_files": parsed,
        "cached_files": 0 if kept is None else kept.count(),
        "skipped_files": skipped,
        "skipped_paths": paths,
        "endpoints": t["endpoints"].count(),
        "endpoints_with_handler": t["endpoints"].filter("handler is not null").count(),
        "client_calls": t["clients"].count(),
        "test_cases": t["test_cases"].filter("kind <> 'hook'").count(),
        "functions_by_language": {r["language"]: r["n"] for r in graph.functions_by_language(t["functions"]).collect()},
    }
    return t, stats



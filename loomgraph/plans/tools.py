"""The named tools over an index: each takes plain arguments and returns plain data.

Totals are exact; limits apply to listed rows only, from 1 to 500.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.functions import text as T
from loomgraph.operators import correlate as C
from loomgraph.operators import graph as G
from loomgraph.operators import inventory, touches, traverse
from loomgraph.operators import vectors as V
from loomgraph.plans import index, visual
from loomgraph.sources import scan, store
from loomgraph.sources.frontends import extract_text
from loomgraph.sources.frontends.record import TOPLEVEL


def clamp(value, default: int, low: int = 1, high: int = 500) -> int:
    return default if value is None else max(low, min(int(value), high))


def rows(df: DataFrame) -> list[dict]:
    """Listed rows as dictionaries; callers have limited them."""
    return [r.asDict(recursive=True) for r in df.collect()]


class Tools:
    """A tree and its index, rebuilt when the tree's fingerprint changes."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root
        self.t: dict[str, DataFrame] | None = None
        self.stats: dict = {}
        self.print: str | None = None

    # ---- freshness

    def ensure(self, force: bool = False) -> dict[str, DataFrame]:
        now = scan.fingerprint(self.spark, self.root)
        if self.t is not None and now == self.print and not force:
            return self.t
        saved = store.load(self.spark, self.root)
        if saved and saved[1] == now and not force:
            self.t, self.print, self.stats = saved
            return self.t
        cache = saved[0].get("extracted") if saved and not force else None
        made, self.stats = index.build(self.spark, self.root, cache)
        store.save(made, self.root, now, self.stats)
        self.t, self.print, self.stats = store.load(self.spark, self.root)
        return self.t

    # ---- references

    def function_id(self, ref) -> int:
        """An id, ``fn:id``, a unique qualified name or a unique plain name; else an error that lists candidates."""
        f = self.ensure()["functions"]
        text = str(ref)
        if text.removeprefix("fn:").isdigit():
            return int(text.removeprefix("fn:"))
        hits: list = []
        for condition in (F.col("qualified_name") == text, (F.col("name") == text) & ~F.col("is_toplevel")):
            hits = f.filter(condition).select("id", "qualified_name").orderBy("id").limit(11).collect()
            if len(hits) == 1:
                return hits[0]["id"]
            if hits:
                break
        if hits:
            raise ValueError(f"{text} is ambiguous: " + ", ".join(f"fn:{h['id']} {h['qualified_name']}" for h in hits[:10]))
        raise ValueError(f"no function {text}")

    def file_id(self, path: str) -> int:
        f = self.ensure()["files"]
        hits = f.filter(F.col("path") == path).select("id").collect() or f.filter(F.col("path").endswith("/" + path)).select("id").limit(2).collect()
        if len(hits) != 1:
            raise ValueError(f"no single file {path}")
        return hits[0]["id"]

    def seeds(self, function=None, file=None) -> DataFrame:
        f = self.ensure()["functions"]
        if function is not None:
            return f.filter(F.col("id") == self.function_id(function)).select("id")
        found = f.filter(F.col("file_id") == self.file_id(file)).select("id")
        if found.isEmpty():
            raise ValueError(f"no functions in {file}")
        return found

    def _summary(self, ids: DataFrame | None = None) -> DataFrame:
        f = self.ensure()["functions"].select("id", "name", "qualified_name", "language", F.col("path").alias("file"), F.concat_ws("-", "start_line", "end_line").alias("lines"), "signature")
        return f if ids is None else f.join(ids, "id")

    def _edges(self) -> DataFrame:
        t = self.ensure()
        n, c, m = t["bridge_natives"], t["bridge_calls"], t["bridge_matches"]
        bridge = m.join(n.select(F.col("id").alias("native_id"), F.col("function").alias("src")), "native_id").join(c.select(F.col("id").alias("call_id"), F.col("caller").alias("dst"), F.col("high").alias("sure")), "call_id")
        bridge = bridge.select("src", "dst", (F.col("high") & F.col("sure")).alias("high"), F.col("call_id").alias("ord"))
        return traverse.reverse_edges(t["calls"], t["matches"], t["endpoints"], t["clients"], bridge)

    # ---- tools

    def index_project(self, force: bool = False) -> dict:
        self.ensure(force)
        return self.stats

    def index_stats(self) -> dict:
        self.ensure()
        return {**self.stats, "fingerprint": self.print}

    def search_functions(self, query: str, limit=None) -> dict:
        return {"results": rows(G.search_functions(self.ensure()["functions"], query, clamp(limit, 20)).select("id", "name", "qualified_name", "language", F.col("path").alias("file"), "start_line", "signature", "score"))}

    def get_function(self, function) -> dict:
        i, t = self.function_id(function), self.ensure()
        return {
            **rows(self._summary().filter(F.col("id") == i))[0],
            "callers": self.get_callers(i, 20)["callers"],
            "callees": self.get_callees(i)["callees"],
            "packages": G.packages_used(t["calls"], i).first()["packages"],
            "decorations": rows(t["decorations"].filter(F.col("fn_id") == i).select("name", "line")) if "decorations" in t else [],
        }

    def get_callers(self, function, limit=None) -> dict:
        i = self.function_id(function)
        c = G.callers(self.ensure()["calls"], i, clamp(limit, 50))
        who = self._summary().select(F.col("id").alias("caller"), "qualified_name", "file")
        return {"callers": rows(c.join(who, "caller").orderBy("rank", "idx").select("caller", "qualified_name", "file", "line", T.confidence(F.col("high") & (F.col("rank") == 0)).alias("confidence"), (F.col("rank") == 1).alias("ambiguous")))}

    def get_callees(self, function, limit=None) -> dict:
        c = G.callees(self.ensure()["calls"], self.function_id(function), clamp(limit, 100))
        who = self._summary().select(F.col("id").alias("callee"), "qualified_name")
        return {"callees": rows(c.join(who, "callee", "left").orderBy("idx").select("name", "receiver", "line", "kind", "callee", "qualified_name", "package", "ambiguous_with", T.confidence(F.col("high")).alias("confidence")))}

    def find_similar(self, function=None, snippet: str | None = None, language: str | None = None, limit=None) -> dict:
        t, k = self.ensure(), clamp(limit, 10)
        if snippet is not None:
            lang = scan.language_name(language or "")
            if lang is None:
                raise ValueError(f"unknown language {language}")
            record = extract_text(lang, "snippet", snippet)
            fn = next((f for f in record["functions"] if f["name"] != TOPLEVEL), None)
            if fn is None:
                raise ValueError("the snippet has no function")
            bag = self.spark.createDataFrame([(-1, key, tf) for key, tf in fn["features"].items()], "fn_id bigint, feature string, tf bigint")
            types = self.spark.createDataFrame([(-1, x["type"]) for x in fn["locals"]], "fn_id bigint, type string")
            bag = V.augment_bags(bag, types)
            n = t["bags"].select("fn_id").distinct().count()
            own = V.dense(V.hashed_vectors(V.tfidf(bag, V.doc_frequency(t["bags"]), n))).first()
            words = V.semantic_vectors(bag).first()
            exclude = None
        else:
            exclude = self.function_id(function)
            own = t["vectors"].filter(F.col("fn_id") == exclude).first()
            words = t["semantic"].filter(F.col("fn_id") == exclude).first()
        if own is None:
            return {"results": []}
        ranked = V.top_k_blend(t["vectors"], t["semantic"], (own["vector"], words["vector"] if words else [0.0] * V.SEMANTIC_DIMS), k + 10, exclude)
        found = V.find_similar(t["functions"], ranked, k)
        who = self._summary().select(F.col("id").alias("fn_id"), "qualified_name", "file", "lines")
        return {"results": rows(found.join(who, "fn_id").orderBy(F.desc("score"), "fn_id"))}

    def call_path(self, source, target, max_depth=None) -> dict:
        a, b = self.function_id(source), self.function_id(target)
        steps = rows(traverse.call_path(self.ensure()["calls"], a, b, clamp(max_depth, 10, 1, 32)))
        return {"found": a == b or bool(steps), "steps": steps}

    def file_overview(self, path: str, limit=None) -> dict:
        t = self.ensure()
        hit = t["files"].filter((F.col("path") == path) | F.col("path").startswith(path.rstrip("/") + "/"))
        if hit.isEmpty():
            hit = t["files"].filter(F.col("id") == self.file_id(path))
        listed = hit.orderBy("path").limit(clamp(limit, 50))
        f = t["functions"].select("file_id", F.struct("id", "name", "start_line", "end_line", "signature").alias("f")).groupBy("file_id").agg(F.array_sort(F.collect_list("f")).alias("functions"))
        i = t["imports"].select("file_id", F.struct("line", "path", "external_package", "resolved_file").alias("i")).groupBy("file_id").agg(F.array_sort(F.collect_list("i")).alias("imports"))
        own = listed.withColumnRenamed("id", "file_id").join(f, "file_id", "left").join(i, "file_id", "left").orderBy("path")
        return {"total": hit.count(), "files": rows(own)}

    def extract_file(self, path: str) -> dict:
        files = scan.scan_tree(self.spark, self.root).filter(F.col("path") == path)
        one = index.extract(files, scan.manifest_evidence(self.spark, self.root)).first()
        if one is None:
            raise ValueError(f"no source file {path}")
        return one.asDict(recursive=True)

    def supported_languages(self) -> dict:
        return {"languages": [{"language": k, "extensions": v.split()} for k, v in scan.EXTENSIONS.items()]}

    def list_packages(self, limit=None) -> dict:
        return {"packages": rows(G.list_packages(self.ensure()["calls"], clamp(limit, 100)))}

    def list_endpoints(self, kind=None, method=None, path=None, framework=None, limit=None) -> dict:
        e = self.ensure()["endpoints"]
        return {"total": e.count(), "endpoints": rows(C.list_endpoints(e, kind, method, path, framework, clamp(limit, 100)))}

    def find_endpoint_callers(self, path: str, method=None) -> dict:
        t = self.ensure()
        found = C.find_endpoint_callers(t["endpoints"], t["matches"], path, method)
        clients = t["clients"].select(F.col("id").alias("client_id"), "caller", "url_raw", "library", F.col("line").alias("client_line"))
        return {"endpoints": rows(found.join(clients, "client_id", "left").orderBy("id", "client_id").limit(500))}

    def get_endpoint(self, endpoint) -> dict:
        t, i = self.ensure(), int(str(endpoint).removeprefix("ep:"))
        e = rows(t["endpoints"].filter(F.col("id") == i))
        if not e:
            raise ValueError(f"no endpoint {endpoint}")
        m = t["matches"].filter(F.col("endpoint_id") == i).join(t["clients"].withColumnRenamed("id", "client_id").drop("high"), "client_id")
        return {**e[0], "clients": rows(m.orderBy("client_id"))}

    def list_client_calls(self, unmatched: bool = False, limit=None) -> dict:
        t = self.ensure()
        return {"total": t["clients"].count(), "clients": rows(C.client_calls(t["clients"], t["matches"], unmatched).orderBy("id").limit(clamp(limit, 100)))}

    def unreferenced_endpoints(self, limit=None) -> dict:
        t = self.ensure()
        u = C.unreferenced_endpoints(t["endpoints"], t["matches"])
        return {"total": u.count(), "endpoints": rows(u.orderBy("id").limit(clamp(limit, 100)))}

    def unreferenced_functions(self, language=None, limit=None) -> dict:
        t, k = self.ensure(), clamp(limit, 50)
        mentioned = t["literals"].filter("kind = 'ident'").select(F.regexp_extract("text", r"(\w+)$", 1).alias("name"))
        inner = t["bags"].filter("feature like 'id:%'").join(t["functions"].select(F.col("id").alias("fn_id"), F.col("name").alias("own")), "fn_id").select(F.expr("substring(feature, 4)").alias("name"), "own").filter("name <> own").select("name")
        u = G.unreferenced_functions(t["functions"], t["calls"], mentioned.union(inner), t["endpoints"].filter("handler is not null"), scan.language_name(language) if language else None)
        u = index.materialize(u.select("id", "name", "qualified_name", "language", "path", "start_line", "reason", "class"))
        pick = lambda c: rows(u.filter(F.col("class") == c).orderBy("id").limit(k))
        return {"strong_candidates": pick("strong"), "public_unreferenced": pick("public"), "excluded_counts": {r["reason"]: r["n"] for r in G.excluded_counts(u).collect()}}

    def blast_radius(self, function=None, file=None, max_depth=None, limit=None) -> dict:
        t, depth = self.ensure(), clamp(max_depth, 10, 1, 50)
        seeds = self.seeds(function, file)
        hit = index.materialize(traverse.blast_radius(self._edges(), seeds, depth, mode="fifo"))
        listed = self._summary(hit).orderBy("depth", ~F.col("high"), "id").limit(clamp(limit, 100))
        return {
            "seed_count": seeds.count(),
            "max_depth": depth,
            "total_impacted": hit.count(),
            "by_depth": {str(r["depth"]): r["n"] for r in traverse.by_depth(hit).orderBy("depth").collect()},
            "functions": rows(listed.select("id", "qualified_name", "file", "lines", "depth", T.confidence(F.col("high")).alias("confidence"), "via")),
            "affected_endpoints": rows(traverse.affected_endpoints(t["endpoints"], hit, seeds).orderBy("id")),
            "affected_test_count": traverse.affected_tests(t["functions"], hit, seeds).count(),
        }

    def affected_tests(self, function=None, file=None, max_depth=None, limit=None) -> dict:
        t = self.ensure()
        seeds = self.seeds(function, file)
        hit = index.materialize(traverse.blast_radius(self._edges(), seeds, clamp(max_depth, 20, 1, 50), mode="fifo"))
        found = traverse.affected_tests(t["functions"], hit, seeds)
        grouped = traverse.affected_tests_by_file(t["functions"], found, clamp(limit, 200)).join(t["files"].select(F.col("id").alias("file_id"), "path"), "file_id")
        return {"total": found.count(), "files": rows(grouped.orderBy("min_depth", "file_id"))}

    def list_tests(self, path=None, name=None, suite=None, framework=None, language=None, hooks: bool = False, limit=None) -> dict:
        cases = self.ensure()["test_cases"]
        listed = inventory.list_tests(cases, path, name, suite, framework, scan.language_name(language) if language else None, hooks, clamp(limit, 200))
        return {"total": inventory.case_count(cases).first()["cases"], "frameworks": {r["framework"]: r["n"] for r in inventory.frameworks(cases).collect()}, "files": rows(inventory.by_file(listed))}

    def test_command(self, path=None, name=None, test=None) -> dict:
        t = self.ensure()
        cases = t["test_cases"].filter("kind = 'case'")
        if test is not None:
            cases = cases.filter(F.col("id") == int(test))
        if path:
            cases = cases.filter((F.col("path") == path) | F.col("path").endswith("/" + path))
        whole = name is None and test is None
        if name:
            cases = cases.filter(F.col("name") == name)
        marks = inventory.build_markers(t["files"].unionByName(self._manifests(), allowMissingColumns=True))
        cases = cases.orderBy("id").limit(1).crossJoin(F.broadcast(marks))  # one row each
        none = F.lit(None).cast("string")
        command = inventory.test_command(F.col("framework"), F.col("path"), none if whole else F.col("name"), none if whole else F.col("suite"), F.lit(None).cast("int") if whole else F.col("line"), *[F.col(c) for c in ("maven", "gradle", "swift_package", "composer", "gemfile")])
        hit = cases.select("framework", "path", command.alias("command")).first()
        if hit is None:
            raise ValueError("no such test")
        return hit.asDict()

    def _manifests(self) -> DataFrame:
        names = ["pom.xml", "build.gradle", "build.gradle.kts", "Package.swift", "composer.json", "Gemfile"]
        return scan._listed(self.spark, self.root, False).select("path").filter(F.substring_index("path", "/", -1).isin(names))

    def bridge_map(self, module=None, limit=None) -> dict:
        t, k = self.ensure(), clamp(limit, 100)
        n = t["bridge_natives"]
        if module:
            n = n.filter((F.col("module") == module) | (F.col("alias") == module))
        m = t["bridge_matches"].join(t["bridge_calls"].select(F.col("id").alias("call_id"), "caller", "line"), "call_id").groupBy(F.col("native_id").alias("id")).agg(F.array_sort(F.collect_list(F.struct("call_id", "caller", "line", "high"))).alias("js_callers"))
        left = t["bridge_calls"].join(t["bridge_matches"].select(F.col("call_id").alias("id")).distinct(), "id", "left_anti")
        return {"natives": rows(n.join(m, "id", "left").orderBy("id").limit(k)), "unmatched_js_calls": rows(left.orderBy("id").limit(k))}

    def visualize(self, output: str | None = None) -> dict:
        return visual.write(self.ensure(), output or f"{self.root.removeprefix('file://')}/{store.FOLDER}/map.html")

    def record_touch(self, files: list[str], why: str, agent: str = "") -> dict:
        return touches.TouchLog(f"{self.root.removeprefix('file://')}/{store.FOLDER}").record(files, why, agent)

    def recent_touches(self, file=None, limit=None) -> dict:
        log = touches.TouchLog(f"{self.root.removeprefix('file://')}/{store.FOLDER}")
        return {"touches": rows(touches.recent(log.frame(self.spark), file, clamp(limit, 10, 1, 50)))}


TOOLS = [n for n in vars(Tools) if not n.startswith("_") and n not in ("ensure", "function_id", "file_id", "seeds")]

import pytest
from pyspark.sql import functions as F

from loomgraph.operators import correlate as C
from loomgraph.operators import graph as G
from loomgraph.operators import inventory, resolve, spans, touches, traverse
from loomgraph.operators import vectors as V


def edges(spark, rows):
    return spark.createDataFrame(rows, "src bigint, dst bigint, high boolean, via string, ord bigint")


def got(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


@pytest.mark.parametrize("mode", ["canonical", "fifo"])
def test_blast_radius(spark, mode):
    e = edges(spark, [(0, 1, True, "call", 0), (1, 2, True, "call", 1), (2, 3, False, "endpoint-client", 2), (0, 3, False, "ambiguous-call", 3), (3, 0, True, "call", 4)])
    out = traverse.blast_radius(e, [0], 10, mode=mode)
    assert got(out, "id", "depth", "high") == [(1, 1, True), (2, 2, True), (3, 1, False)]
    assert got(traverse.blast_radius(e, [0], 1, mode=mode), "id") == [(1,), (3,)]
    assert traverse.blast_radius(e.limit(0), [0], 3, mode=mode).count() == 0


def test_sure_path_upgrades(spark):
    e = edges(spark, [(0, 2, False, "call", 0), (0, 1, True, "call", 1), (1, 2, True, "call", 2)])
    assert got(traverse.blast_radius(e, [0], 5), "id", "depth", "high") == [(1, 1, True), (2, 2, True)]


def calls(spark, rows):
    return spark.createDataFrame([(i, a, b, 1, "internal", True) for i, (a, b) in enumerate(rows)], "idx bigint, caller bigint, callee bigint, line int, kind string, high boolean")


def test_call_path_takes_the_first_found(spark):
    c = calls(spark, [(0, 2), (0, 1), (1, 3), (2, 3)])
    assert [(r.caller, r.callee) for r in traverse.call_path(c, 0, 3).orderBy("step").collect()] == [(0, 2), (2, 3)]
    assert traverse.call_path(c, 3, 0).count() == 0
    assert traverse.call_path(c, 1, 1).count() == 0


ENDPOINTS = "id bigint, kind string, method string, path_norm string, high boolean"


def test_correlation_tiers(spark):
    e = spark.createDataFrame([(1, "http", "GET", "/users/{*}", True), (2, "http", "ANY", "/items", True), (3, "http", "POST", "/a/b", True), (4, "rpc", "ANY", "/sum", True)], ENDPOINTS)
    c = spark.createDataFrame([(1, "http", "GET", "/users/7", True), (2, "http", "GET", "/items", True), (3, "http", "POST", "/v1/x/a/b", True), (4, "http", "GET", "/nothing", True), (5, "rpc", "ANY", "/sum", True), (6, "http", "GET", "/{*}/7", True)], ENDPOINTS)
    out = C.correlate(c, e)
    assert got(out, "client_id", "endpoint_id", "high") == [(1, 1, True), (2, 2, False), (3, 3, False), (5, 4, True), (6, 1, True)]
    assert got(C.unreferenced_endpoints(e, out), "id") == []
    assert got(C.client_calls(c, out, True), "id") == [(4,)]


def test_mounts_and_rest_paths(spark):
    m = spark.createDataFrame([(2, 1, "/api"), (3, 2, "users"), (4, 1, "/x"), (4, 2, "/y"), (5, 4, "/z")], "child bigint, parent bigint, prefix string")
    assert got(C.compose_prefixes(m), "child", "prefix")[:2] == [(2, "/api"), (3, "/api/users")]
    assert {r.child: r.prefix for r in C.compose_prefixes(m).collect() if r.child > 3} == {4: None, 5: None}
    chain = spark.createDataFrame([(n, n - 1, f"/p{n}") for n in range(2, 9)], "child bigint, parent bigint, prefix string")
    assert {r.child: r.prefix for r in C.compose_prefixes(chain).collect()} == {n: "/" + "/".join(f"p{k}" for k in range(2, n + 1)) if n <= 5 else None for n in range(2, 9)}
    assert {r.prefix for r in C.compose_prefixes(chain.selectExpr("*", "12 AS hops")).collect() if r.child == 8} == {"/p2/p3/p4/p5/p6/p7/p8"}
    r = spark.createDataFrame([(1, None, "a"), (2, 1, "b"), (3, 99, "c")], "id int, parent int, part string")
    assert got(C.rest_paths(r), "id", "path", "known") == [(1, "/a", True), (2, "/a/b", True), (3, "/{*}/c", False)]


def test_bridge(spark):
    n = spark.createDataFrame([(1, "GeoModule", "Geo", "locate"), (2, "PayModule", "Pay", "pay")], "id bigint, module string, alias string, method string")
    c = spark.createDataFrame([(1, "Geo", "locate", True), (2, None, "pay", False), (3, "Other", "pay", True)], "id bigint, module string, method string, high boolean")
    assert got(C.bridge_matches(c, n), "call_id", "native_id", "high") == [(1, 1, True), (2, 2, False)]


def test_bridge_repeated_ids(spark):
    n = spark.createDataFrame([(1, "M", "A", "f"), (1, "M", "M", "f"), (2, None, "A", "g"), (3, "M", None, "h")], "id bigint, module string, alias string, method string")
    c = spark.createDataFrame([(1, "M", "f", True), (2, "A", "g", True), (2, None, "h", True), (3, None, "g", True), (4, "", "g", True), (None, "M", "h", True)], "id bigint, module string, method string, high boolean")
    pairs = [tuple(r) for r in C.bridge_matches(c, n).collect()]
    assert sorted(pairs, key=str) == sorted([(1, 1, False), (1, 1, False), (2, 2, False), (2, 3, False), (3, 2, True), (None, 3, True)], key=str)


def test_bridge_shuffles_no_matches(spark):
    n = spark.createDataFrame([(i, "M", "A", "f") for i in range(60)], "id bigint, module string, alias string, method string")
    c = spark.createDataFrame([(i, None, "f", True) for i in range(50)], "id bigint, module string, method string, high boolean")
    out = C.bridge_matches(c, n)
    assert out.count() == 3000
    top = out._jdf.queryExecution().optimizedPlan().toString().split("Join Inner")[0]
    assert "Window" not in top and "Aggregate" not in top, top


def test_spans(spark):
    s = spark.createDataFrame([(1, 1, 0, 10000), (2, 1, 10, 5000), (3, 1, 20, 30)], "id bigint, f bigint, start bigint, end bigint")
    p = spark.createDataFrame([(1, 1, 25), (2, 1, 4500), (3, 1, 9000), (4, 1, 20000), (5, 2, 25)], "pid bigint, f bigint, pos bigint")
    assert {r.pid: r.span_id for r in spans.innermost(p, s, ["f"], "pid", "pos").collect()} == {1: 3, 2: 2, 3: 1, 4: None, 5: None}
    assert {r.pid: r.chain for r in spans.enclosing_chain(p, s, ["f"], "pid", "pos").collect()} == {1: [1, 2, 3], 2: [1, 2], 3: [1]}
    named = s.withColumn("prefix", F.concat(F.lit("p"), F.col("id").cast("string")))
    assert {r.pid: r.path for r in spans.fold_prefixes(p, named, ["f"], "pid", "pos").collect()}[1] == "/p1/p2/p3"


def test_ids_are_dense_and_ordered(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("v"))
    assert [r.v for r in G.assign_ids(df, ["v"]).orderBy("id").collect()] == list(range(1000))
    assert G.assign_ids(df.limit(0), ["v"]).count() == 0


def test_ladder(spark):
    files = spark.createDataFrame([(0, "a/x.py", "python", None), (1, "a/y.py", "python", None), (2, "b/z.py", "python", None)], "id bigint, path string, language string, package string")
    f = spark.createDataFrame([(0, "run", 0, "python", None, False), (1, "load", 0, "python", None, False), (2, "load", 1, "python", None, False), (3, "near", 1, "python", None, False), (4, "far", 2, "python", None, False), (5, "save", 2, "python", "Store", False)], "id bigint, name string, file_id bigint, language string, containing_type string, is_toplevel boolean")
    i = spark.createDataFrame([(0, 0, ["pg"], None, "pg"), (0, 1, ["y"], 1, None)], "file_id bigint, ord int, names array<string>, resolved_file bigint, external_package string")
    c = spark.createDataFrame([(0, 0, "load", None, 1), (1, 0, "near", None, 2), (2, 0, "far", None, 3), (3, 0, "query", "pg", 4), (4, 0, "load", "y", 5), (5, 0, "save", "Store", 6), (6, 0, "unknown", None, 7)], "idx bigint, caller bigint, name string, receiver string, line int")
    out = {r.idx: (r.kind, r.callee, r.high, r.rung, r.package) for r in resolve.resolve_calls(c, f, i, files).collect()}
    assert out[0] == ("internal", 1, True, 5, None)
    assert out[1] == ("internal", 3, False, 8, None)
    assert out[2] == ("internal", 4, True, 9, None)
    assert out[3] == ("external", None, True, 3, "pg")
    assert out[4] == ("internal", 2, True, 3, None)
    assert out[5] == ("internal", 5, True, 4, None)
    assert out[6] == ("unresolved", None, False, None, None)


def test_answers_rewrite_edges(spark):
    files = spark.createDataFrame([(0, "a.ts", 1), (1, "b.ts", 2)], "id bigint, path string, content_hash bigint")
    f = spark.createDataFrame([(0, 0, 1, 9, False), (1, 1, 1, 9, False), (2, 1, 3, 5, False)], "id bigint, file_id bigint, start_line int, end_line int, is_toplevel boolean")
    c = spark.createDataFrame([(0, 0, 2, 4, "internal", 1, False, [2], None), (1, 0, 3, 4, "internal", 1, False, [], None), (2, 0, 4, 4, "internal", 1, False, [], None)], "idx bigint, caller bigint, name_line int, name_col int, kind string, callee bigint, high boolean, ambiguous_with array<bigint>, package string")
    a = spark.createDataFrame([("a.ts", 2, 4, "b.ts", 4, None, 1), ("a.ts", 3, 4, None, None, "lodash", 1)], "path string, line int, col int, def_file string, def_line int, def_package string, content_hash bigint")
    out = {r.idx: (r.kind, r.callee, r.high, r.package) for r in resolve.apply_answers(c, a, f, files).collect()}
    assert out == {0: ("internal", 2, True, None), 1: ("external", None, True, "lodash"), 2: ("internal", 1, False, None)}
    assert [r.idx for r in resolve.questions(c, a, f, files).collect()] == [2]


def test_answers_in_rounds(spark):
    files = spark.createDataFrame([(0, "a.ts"), (1, "b.ts")], "id bigint, path string")
    # Equal spans, one that begins on the line, one over several blocks, one that ends before it begins.
    f = spark.createDataFrame([(0, 0, 1, 900, False), (1, 1, 1, 400, False), (2, 1, 70, 90, False), (3, 1, 70, 90, False), (4, 1, 80, 300, False), (5, 1, 90, 80, False), (6, 1, 80, 81, True)], "id bigint, file_id bigint, start_line int, end_line int, is_toplevel boolean")
    c = spark.createDataFrame([(i, 0, i, 4, "internal", 1, False, [2], None) for i in range(40)], "idx bigint, caller bigint, name_line int, name_col int, kind string, callee bigint, high boolean, ambiguous_with array<bigint>, package string")
    a = spark.createDataFrame([("a.ts", i, 4, "b.ts", (80, 75, 350, 500)[i % 4], "out" if i % 8 == 3 else None) for i in range(20)] + [("a.ts", i, 4, None, None, "lodash" if i % 2 else None) for i in range(20, 30)], "path string, line bigint, col bigint, def_file string, def_line int, def_package string")
    want = {i: ("internal", (4, 2, 1)[i % 4], True, None) if i < 20 and i % 4 < 3 else ("external", None, True, "out") if i < 20 and i % 8 == 3 else ("external", None, True, "lodash") if 20 <= i < 30 and i % 2 else ("internal", 1, False, None) for i in range(40)}
    for rounds in (1, 3):
        out = resolve.apply_answers(c, a, f, files, rounds).collect()
        assert len(out) == 40 and {r.idx: (r.kind, r.callee, r.high, r.package) for r in out} == want


def test_answers_meet_spans_once_a_line(spark):
    files = spark.createDataFrame([(0, "a.ts")], "id bigint, path string")
    f = spark.createDataFrame([(i, 0, 1, 9, False) for i in range(100)], "id bigint, file_id bigint, start_line int, end_line int, is_toplevel boolean")
    c = spark.createDataFrame([(i, 0, i, 4, "internal", 1, False, [2], None) for i in range(100)], "idx bigint, caller bigint, name_line int, name_col int, kind string, callee bigint, high boolean, ambiguous_with array<bigint>, package string")
    a = spark.createDataFrame([("a.ts", i, 4, "a.ts", 5, None) for i in range(100)], "path string, line int, col int, def_file string, def_line int, def_package string")
    out = resolve.apply_answers(c, a, f, files)
    assert {r.callee for r in out.collect()} == {0}
    # 10,000 rows when every answer meets every span.
    nodes, most = [out._jdf.queryExecution().executedPlan()], 0
    while nodes:
        n = nodes.pop()
        if n.metrics().contains("numOutputRows"):
            most = max(most, n.metrics().apply("numOutputRows").value())
        kids = n.children()
        nodes += [kids.apply(i) for i in range(kids.size())]
        nodes += [n.executedPlan()] if n.nodeName().startswith("AdaptiveSparkPlan") else [n.plan()] if "QueryStage" in n.nodeName() else []
    assert 100 <= most <= 200, most


def test_ring():
    ring = touches.replay([], [{"ts": i, "files": ["a"], "why": "", "agent": ""} for i in range(30)])
    assert [e["ts"] for e in ring] == list(range(20, 30))
    ring = touches.replay([], [{"ts": i, "files": [f"f{i}"], "why": "", "agent": ""} for i in range(300)])
    assert (len(ring), ring[0]["ts"]) == (250, 50)


def test_ring_replay_matches_writes(spark):
    rows = [(p, t, t, [f"f{t % 3}", f"g{t % 5}"], "w", "a") for p in (0, 1) for t in range(80)]
    df = spark.createDataFrame(rows, "project int, ts bigint, seq bigint, files array<string>, why string, agent string")
    want = [e["ts"] for e in touches.replay([], [{"ts": t, "files": f, "why": w, "agent": a} for p, t, _, f, w, a in rows if p == 0])]
    assert [r.ts for r in touches.replay_history(df).filter("project = 0").orderBy("ts").collect()] == want


def test_touch_log(tmp_path, spark):
    log = touches.TouchLog(str(tmp_path))
    log.record(["./src/api.py"], "why", ts=1)
    (tmp_path / "touches.jsonl").open("a").write("broken\n")
    log.record(["b.py"], "more", ts=2)
    assert [e["files"] for e in log.read()] == [["src/api.py"], ["b.py"]]
    assert [r.why for r in touches.recent(log.frame(spark), "api.py").collect()] == ["why"]


def test_vectors(spark):
    bags = spark.createDataFrame([(1, "id:getUser", 2), (1, "call:load", 1), (2, "id:fetchUser", 1), (3, "id:zap", 1)], "fn_id bigint, feature string, tf bigint")
    full = V.augment_bags(bags)
    assert ("vb:READ", 3) in got(full.filter("fn_id = 1"), "feature", "tf")
    assert ("w:user", 2) in got(full.filter("fn_id = 1"), "feature", "tf")
    v = {r.fn_id: r.vector for r in V.structural_vectors(full).collect()}
    assert all(abs(sum(x * x for x in u) - 1) < 1e-9 for u in v.values())
    s = V.semantic_vectors(full)
    near = V.top_k(s, s.filter("fn_id = 1").first().vector, 5, exclude=1).collect()
    assert near[0].fn_id == 2
    assert V.pca_3d(V.structural_vectors(full)).select("x").distinct().count() == 1


def test_test_commands(spark):
    def command(framework, path, name=None, suite=None, line=None, **marks):
        row = spark.createDataFrame([(framework, path, name, suite, line)], "f string, p string, n string, s string, l int")
        flags = [F.lit(bool(marks.get(m))) for m in ("maven", "gradle", "swift_package", "composer", "gemfile")]
        return row.select(inventory.test_command(F.col("f"), F.col("p"), F.col("n"), F.col("s"), F.col("l"), *flags)).first()[0]

    assert command("pytest", "t.py", "test_a") == "pytest t.py -k 'test_a'"
    assert command("go-test", "a/b_test.go", "TestX") == "go test -run '^TestX$' ./a"
    assert command("junit", "A.java", "x", "A", gradle=True) == "./gradlew test --tests 'A.x'"
    assert command("junit", "A.java", "x", "A", maven=True) == "./mvnw test -Dtest=A#x"
    assert command("rust-test", "tests/it.rs", "works") == "cargo test --test it works"
    assert command("rspec", "a_spec.rb", "x", None, 7, gemfile=True) == "bundle exec rspec a_spec.rb:7"
    assert command("xctest", "A.swift", "testA", "ATests", swift_package=True) == "swift test --filter ATests/testA"
    assert command("unknown", "x") == "<runner> x"


def test_effect_features_add_up_per_call_and_bucket(spark):
    names = ["root", "fetchUser", "loadAll", "zap", "(toplevel)"]
    f = spark.createDataFrame([(i, n, n == "(toplevel)") for i, n in enumerate(names)], "id bigint, name string, is_toplevel boolean")
    rows = [(0, 0, 1, "internal", None), (1, 0, 1, "internal", None), (2, 0, 2, "internal", None), (3, 0, 4, "internal", None), (4, 1, 3, "internal", None), (5, 3, 0, "internal", None), (6, 3, None, "external", "pg"), (7, 0, None, "external", "own")]
    c = spark.createDataFrame(rows, "idx bigint, caller bigint, callee bigint, kind string, package string")
    out = {(r.fn_id, r.feature): r.tf for r in traverse.effect_features(f, c).collect()}
    assert {k[1]: v for k, v in out.items() if k[0] == 0} == {"eff:READ": 12, "eff:zap": 2, "eff:root": 1, "effpkg:pg": 4, "effpkg:own": 4}
    # With room for one callee a level, the first found goes on; what the level calls still counts.
    few = {(r.fn_id, r.feature): r.tf for r in traverse.effect_features(f, c.filter("idx <> 1"), fan=1).collect()}
    assert few[0, "eff:READ"] == 8 and few[0, "eff:zap"] == 2


def test_more_seeds_than_the_cap(spark):
    e = edges(spark, [(i, 100 + i, True, "call", i) for i in range(8)])
    out = traverse.blast_radius(e, range(8), 3, mode="fifo", cap=5)
    assert out.count() == 5


def test_wildcards_on_both_sides_meet_by_key(spark):
    routes = ["/a/{*}/c", "/{*}/b/c", "/a/b/{*}", "/x/y", "/{*}/{*}", "/a"]
    calls_ = ["/a/{*}/c", "/{*}/b/{*}", "/x/{*}", "/a/b/c", "/{*}", "/q/{*}/c"]
    e = spark.createDataFrame([(i, "http", "GET", p, True) for i, p in enumerate(routes)], "id bigint, kind string, method string, path_norm string, high boolean")
    c = spark.createDataFrame([(i, "http", "GET", p, True) for i, p in enumerate(calls_)], "id bigint, kind string, method string, path_norm string, high boolean")

    def agree(p, q):
        x, y = p.strip("/").split("/"), q.strip("/").split("/")
        return len(x) == len(y) and all(a == b or "{*}" in (a, b) for a, b in zip(x, y, strict=True))

    want = sorted((i, j) for i, p in enumerate(calls_) for j, q in enumerate(routes) if agree(p, q))
    assert got(C.correlate_exact(c, e), "client_id", "endpoint_id") == want
    plan = C.correlate_exact(c, e)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan


def test_verbs_of_every_bucket():
    from loomgraph.functions import text

    for verb, bucket in {"view": "READ", "unlink": "DELETE", "equals": "CHECK", "fire": "EMIT", "unpack": "PARSE", "pack": "FORMAT", "toggle": "UPDATE", "seed": "INIT", "signup": "AUTH", "tally": "COMPUTE", "halt": "CLOSE", "prune": "FILTER", "coerce": "TRANSFORM", "defer": "WAIT", "paint": "SHOW", "fuzz": "TEST", "cipher": "CRYPTO", "construct": "BUILD", "divide": "SPLIT"}.items():
        assert text.VERB_BUCKETS[verb] == bucket


def test_words_of_any_script():
    from loomgraph.sources.frontends.record import words_of

    assert words_of("chargerÉtéHTTPUrl2x") == ["charger", "été", "http", "url", "2", "x"]

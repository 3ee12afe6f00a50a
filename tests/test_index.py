"""A small tree from files to tools, and the streams."""

import json

import pytest

from loomgraph.operators import touches
from loomgraph.plans.tools import Tools
from loomgraph.sources import store
from loomgraph.streaming import refresh

TREE = {
    "core.py": "def parse_item(raw):\n    return raw.strip()\n\n\ndef unused_helper():\n    return 1\n",
    "service.py": "from core import parse_item\n\n\ndef load_item(raw):\n    return parse_item(raw)\n",
    "app.py": "from flask import Flask\nfrom service import load_item\n\napp = Flask(__name__)\n\n\n@app.route('/items/<int:item_id>')\ndef get_item(item_id):\n    return load_item(item_id)\n",
    "client.py": "import requests\n\n\ndef fetch_item(item_id):\n    return requests.get('http://api.internal/items/%d' % item_id)\n",
    "tests/test_service.py": "from service import load_item\n\n\ndef test_load_item():\n    assert load_item(' x ')\n",
    "web/main.ts": "import { helper } from './util';\nexport function start(): void { helper(); }\n",
    "web/util.ts": "export function helper(): number { return 1; }\n",
    "node_modules/x.js": "function hidden() {}\n",
    "template.yaml": "Resources:\n  Fn:\n    Type: AWS::Serverless::Function\n    Properties:\n      Handler: app.get_item\n      Events:\n        A:\n          Type: Api\n          Properties: {Path: '/lambda-items', Method: get}\n",
}


@pytest.fixture(scope="module")
def tools(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("tree")
    for name, text in TREE.items():
        path = root / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text)
    made = Tools(spark, str(root))
    made.ensure()
    return made


def test_stats(tools):
    s = tools.index_stats()
    assert s["files"] == 8 and s["skipped_files"] == 0 and s["endpoints"] == 2 and s["client_calls"] == 1 and s["test_cases"] == 1


def test_impact_crosses_the_endpoint(tools):
    out = tools.blast_radius(function="core::parse_item")
    names = {f["qualified_name"].split("::")[-1]: f["depth"] for f in out["functions"]}
    assert names == {"load_item": 1, "get_item": 2, "test_load_item": 2, "fetch_item": 3}
    assert out["by_depth"] == {"1": 1, "2": 2, "3": 1}
    assert {e["path_norm"] for e in out["affected_endpoints"]} == {"/items/{*}", "/lambda-items"}
    assert [f["path"] for f in tools.affected_tests(function="core::parse_item")["files"]] == ["tests/test_service.py"]


def test_queries(tools):
    assert tools.search_functions("parse_item")["results"][0]["score"] == 100
    path = tools.call_path("app::get_item", "core::parse_item")
    assert path["found"] and len(path["steps"]) == 2
    assert {"unused_helper", "fetch_item"} <= {f["name"] for f in tools.unreferenced_functions()["strong_candidates"]}
    assert tools.list_tests()["frameworks"] == {"pytest": 1}
    assert tools.test_command(name="test_load_item")["command"] == "pytest tests/test_service.py -k 'test_load_item'"
    assert [c["qualified_name"] for c in tools.get_callers("helper")["callers"]] == ["web/main::start"]
    assert {p["package"] for p in tools.list_packages()["packages"]} >= {"flask", "requests"}
    assert tools.find_similar(function="service::load_item")["results"]
    with pytest.raises(ValueError):
        tools.get_function("nothing_like_it")


def test_map(tools, tmp_path):
    out = tools.visualize(str(tmp_path / "map.html"))
    page = (tmp_path / "map.html").read_text()
    data = json.loads(page.split('id="data">')[1].split("</script>")[0])
    assert out["functions"] == len(data["functions"]) > 5 and "NaN" not in page


def test_incremental_build(spark, tools):
    with open(f"{tools.root}/core.py", "a") as f:
        f.write("\n\ndef added():\n    return parse_item('x')\n")
    s = Tools(spark, tools.root).index_project()
    assert (s["parsed_files"], s["cached_files"]) == (1, 7)
    assert store.load(spark, tools.root)[2]["functions"] == s["functions"]


def test_ring_stream(spark, tmp_path):
    schema = "project string, ts bigint, seq bigint, files array<string>, why string, agent string"
    rows = [("p", t, t, [f"f{t % 2}"], "w", "a") for t in range(40)]
    spark.createDataFrame(rows, schema).coalesce(1).write.json(f"{tmp_path}/in")
    stream = spark.readStream.schema(schema).json(f"{tmp_path}/in")
    q = refresh.touch_rings(stream).writeStream.outputMode("update").format("memory").queryName("rings").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    q.awaitTermination(120)
    want = [e["ts"] for e in touches.replay([], [{"ts": t, "files": f, "why": w, "agent": a} for _, t, _, f, w, a in rows])]
    assert [r.ts for r in spark.table("rings").orderBy("ts").collect()] == want


def test_refresh_stream(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "src" / "a.py").write_text("def a():\n    pass\n")
    for _ in range(2):
        q = refresh.refresh(refresh.watch(spark, f"file://{tmp_path}/src", "*.py"), "python", f"file://{tmp_path}/table", f"file://{tmp_path}/cp")
        q.awaitTermination(120)
        assert q.exception() is None
    assert [r.n for r in spark.read.parquet(f"file://{tmp_path}/table").selectExpr("record.functions[0].name as n").collect()] == ["a"]

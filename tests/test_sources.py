import json

import pytest

from loomgraph.server import Server
from loomgraph.sources import detect, iac, scan
from loomgraph.sources.frontends import extract_text

CASES = {
    "python": ("class A(Base):\n    def go(self, x: Store):\n        return x.save('k')\n", [("go", "A", 2, ["save"])]),
    "javascript": ("const f = (a, b) => { return g(a); };\nfunction h() { x.y(1); }\n", [("f", None, 2, ["g"]), ("h", None, 0, ["y"])]),
    "typescript": ("class A {\n  async go(x: Store): Promise<void> { x.save(1); }\n}\n", [("go", "A", 1, ["save"])]),
    "java": ("class A {\n  public int go(int a, int b) { return add(a, b); }\n}\n", [("go", "A", 2, ["add"])]),
    "kotlin": ("class A {\n  fun go(a: Int): Int { return add(a) }\n}\n", [("go", "A", 1, ["add"])]),
    "csharp": ("class A {\n  public int Go(int a) { return Add(a); }\n}\n", [("Go", "A", 1, ["Add"])]),
    "go": ("package p\nfunc (a *A) Go(x int) int {\n\treturn add(x)\n}\n", [("Go", "A", 1, ["add"])]),
    "rust": ("impl A {\n  pub fn go(&self, x: i32) -> i32 { add(x) }\n}\n", [("go", "A", 1, ["add"])]),
    "ruby": ("class A\n  def go(x)\n    add(x)\n  end\nend\n", [("go", "A", 1, ["add"])]),
    "php": ("<?php\nclass A {\n  function go($x) { return add($x); }\n}\n", [("go", "A", 1, ["add"])]),
    "swift": ("class A {\n  func go(x: Int) -> Int { return add(x) }\n}\n", [("go", "A", 1, ["add"])]),
    "c": ("int go(int x) {\n  return add(x);\n}\n", [("go", None, 1, ["add"])]),
    "cpp": ("int A::go(int x) {\n  return add(x);\n}\n", [("go", "A", 1, ["add"])]),
    "bash": ("go() {\n  add 1\n}\n", [("go", None, 0, ["add"])]),
    "sql": ("CREATE TABLE a (b INT REFERENCES c);\n", [("a", None, 0, ["c"])]),
    "prisma": ("model A {\n  b B\n}\n", [("A", None, 0, ["B"])]),
    "graphql": ("type A {\n  b: B\n}\n", [("A", None, 0, ["B"])]),
}


@pytest.mark.parametrize("language", CASES)
def test_frontends(language):
    text, want = CASES[language]
    found = [f for f in extract_text(language, "x", text)["functions"] if not f["is_toplevel"]]
    assert [(f["name"], f["containing_type"], f["param_count"], [c["name"] for c in f["calls"]]) for f in found] == want


@pytest.mark.parametrize("language", [*CASES, "objc", "yaml", "terraform", "tsx"])
@pytest.mark.parametrize("text", ["", "{{{", "'\"`", "def (", "/* open", "\x00", None])
def test_frontends_take_anything(language, text):
    record = extract_text(language, "x", text)
    assert isinstance(record["functions"], list)
    detect.detect(language, "x", record)


ROUTES = [
    ("python", "app.py", "from flask import Flask\napp = Flask(__name__)\n@app.route('/a/<id>', methods=['POST'])\ndef a(id):\n    pass\n", [("POST", "/a/<id>", "flask", "a")]),
    ("python", "api.py", "from fastapi import APIRouter\nrouter = APIRouter(prefix='/v1')\n@router.get('/b')\ndef b():\n    pass\n", [("GET", "/v1/b", "fastapi", "b")]),
    ("typescript", "s.ts", "import express from 'express';\nconst app = express();\napp.get('/u/:id', getUser);\n", [("GET", "/u/:id", "express", "getUser")]),
    ("java", "C.java", 'import org.springframework.web.bind.annotation.*;\n@RequestMapping("/api")\nclass C {\n  @GetMapping("/x")\n  public String x() { return ""; }\n}\n', [("GET", "/api/x", "spring", "x")]),
    ("csharp", "C.cs", '[Route("api/[controller]")]\npublic class UsersController {\n  [HttpGet("{id}")]\n  public int Get(int id) { return 1; }\n}\n', [("GET", "/api/Users/{id}", "aspnet", "Get")]),
    ("go", "m.go", 'package m\nimport "net/http"\nfunc main() {\n\thttp.HandleFunc("GET /h", health)\n}\n', [("GET", "/h", "net/http", "health")]),
    ("rust", "w.rs", 'use axum::Router;\nfn app() { Router::new().route("/w/{id}", get(show)); }\n', [("GET", "/w/{id}", "axum", "show")]),
    ("ruby", "app.rb", "require 'sinatra'\nget '/ping' do\n  'x'\nend\n", [("GET", "/ping", "sinatra", None)]),
    ("php", "routes/web.php", "<?php\nRoute::get('/o', 'OrderController@index');\n", [("GET", "/o", "laravel", "index")]),
]


@pytest.mark.parametrize(("language", "path", "text", "want"), ROUTES)
def test_routes(language, path, text, want):
    out = detect.detect(language, path, extract_text(language, path, text))
    assert [(e["method"], e["path"], e["framework"], e["handler"]) for e in out["endpoints"]] == want


def test_clients_and_cases():
    text = "import requests\ndef f():\n    requests.get('/items/1')\ndef test_a():\n    pass\n"
    out = detect.detect("python", "tests/test_x.py", extract_text("python", "x", text))
    assert [(c["method"], c["url"], c["library"]) for c in out["clients"]] == [("GET", "/items/1", "requests")]
    assert [(c["name"], c["framework"]) for c in out["cases"]] == [("test_a", "pytest")]
    js = "describe('outer', () => { it('inner', () => {}); });\n"
    out = detect.detect("javascript", "a.test.js", extract_text("javascript", "a", js))
    assert [(c["name"], c["kind"], c["suite"]) for c in out["cases"]] == [("outer", "suite", None), ("inner", "case", "outer")]


def test_declared_routes():
    sam = "Resources:\n  Fn:\n    Type: AWS::Serverless::Function\n    Properties:\n      Handler: app.get\n      CodeUri: src/\n      Events:\n        A:\n          Type: Api\n          Properties: {Path: '/u/{id}', Method: get}\n"
    assert [(r["method"], r["path"], r["handler"]) for r in iac.findings("t.yaml", sam)] == [("GET", "/u/{id}", "src/app.get")]
    sls = "provider: {name: aws}\nfunctions:\n  a:\n    handler: src/a.h\n    events:\n      - http: GET /x\n      - httpApi: {method: post, path: /y}\n"
    assert [(r["method"], r["path"]) for r in iac.findings("serverless.yml", sls)] == [("GET", "/x"), ("POST", "/y")]
    tf = 'resource "aws_apigatewayv2_route" "r" {\n  route_key = "GET /z"\n}\n'
    assert [(r["method"], r["path"]) for r in iac.findings("m.tf", tf)] == [("GET", "/z")]
    assert iac.findings("broken.yaml", "AWS:: [") == []


def test_ignore_rules():
    rules = [("", "*.log", False), ("", "/build/", False), ("sub", "x.py", False), ("", "!keep.log", True)]
    rules[3] = ("", "keep.log", True)
    assert [scan.ignored(p, rules) for p in ("a.log", "d/a.log", "keep.log", "build/a.py", "a/build/b.py", "sub/x.py", "x.py")] == [True, True, False, True, False, True, False]


def test_scan_and_fingerprint(spark, tmp_path):
    (tmp_path / "a.py").write_text("x = 1\n")
    (tmp_path / "node_modules").mkdir()
    (tmp_path / "node_modules" / "b.js").write_text("x")
    (tmp_path / "c.min.js").write_text("x")
    (tmp_path / "bad.py").write_bytes(b"\xff\xfe = 1\n")
    got = {r.path: r.language for r in scan.scan_tree(spark, str(tmp_path)).collect()}
    assert got == {"a.py": "python", "bad.py": "python"}
    before = scan.fingerprint(spark, str(tmp_path))
    assert before == scan.fingerprint(spark, str(tmp_path))
    (tmp_path / "a.py").write_text("x = 22\n")
    assert before != scan.fingerprint(spark, str(tmp_path))


def test_protocol():
    class Fake:
        def search_functions(self, query, limit=None):
            return {"results": [query]}

    s = Server(Fake())
    ask = lambda **k: json.loads(s.line(json.dumps({"jsonrpc": "2.0", **k})))
    assert ask(id=1, method="initialize", params={"protocolVersion": "2024-11-05"})["result"]["protocolVersion"] == "2024-11-05"
    assert len(ask(id=2, method="tools/list")["result"]["tools"]) == 26
    assert "a" in ask(id=3, method="tools/call", params={"name": "search_functions", "arguments": {"query": "a"}})["result"]["content"][0]["text"]
    assert ask(id=4, method="nope")["error"]["code"] == -32601
    assert json.loads(s.line("{"))["error"]["code"] == -32700
    assert json.loads(s.line("[]"))["error"]["code"] == -32600
    assert s.line(json.dumps({"jsonrpc": "2.0", "method": "note"})) is None

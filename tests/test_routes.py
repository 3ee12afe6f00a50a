import pytest

from loomgraph.plans import index
from loomgraph.sources import scan, store

NEST = {
    "main.ts": "import { NestFactory } from '@nestjs/core';\nasync function boot() {\n  const app = await NestFactory.create(M);\n  app.setGlobalPrefix('api');\n  app.enableVersioning();\n}\n",
    "a.ts": "import { Controller, Get, Version } from '@nestjs/common';\n@Controller('cats')\nexport class Cats {\n  @Version(['1', '2'])\n  @Get(':id')\n  one(id: string) { return id; }\n  @Get()\n  all() { return 1; }\n}\n",
}
VIEWS = {
    "urls.py": "from django.urls import path\nfrom views import Users, plain\nurlpatterns = [path('users/', Users.as_view()), path('plain/', plain)]\n",
    "views.py": "class Users(View):\n    def get(self, r):\n        pass\n    def post(self, r):\n        pass\ndef plain(r):\n    pass\n",
    "api.py": "from rest_framework import routers\nrouter = routers.DefaultRouter()\nrouter.register('dogs', Dogs)\nrouter.register('birds', Birds)\nrouter.register('fish', Fish)\nrouter.register('ants', Ants)\nrouter.register('far', Far)\n",
    "sets.py": "class Base(viewsets.ReadOnlyModelViewSet):\n    pass\nclass Dogs(Base):\n    def list(self, r):\n        pass\nclass Birds(mixins.DestroyModelMixin, viewsets.GenericViewSet):\n    pass\nclass Fish(viewsets.ViewSet):\n    def create(self, r):\n        pass\nclass Ants(viewsets.ViewSet):\n    pass\n",
}


def found(spark, files):
    rows = [(p, scan.LANGUAGE_OF[p.rpartition(".")[2]], text, n) for n, (p, text) in enumerate(files.items())]
    extracted = index.materialize(index.extract(spark.createDataFrame(rows, "path string, language string, content string, content_hash bigint")))
    t = index.tables(extracted)
    t["imports"] = index.materialize(index.resolve.classify_imports(t["imports"], t["files"]))
    endpoints = index.detections(extracted, t)["endpoints"].join(t["functions"].selectExpr("id AS handler", "name"), "handler", "left")
    return sorted((e.method, e.path_raw, e.name or "", e.high) for e in endpoints.collect())


def test_global_prefix_and_versions(spark):
    assert found(spark, NEST) == [("GET", "/api/cats", "all", False), ("GET", "/api/v1/cats/:id", "one", False), ("GET", "/api/v2/cats/:id", "one", False)]


MODULES = {
    "app.module.ts": "import { RouterModule } from '@nestjs/core';\nfunction setup() { return RouterModule.register([{ path: 'admin', module: AdminModule }]); }\n",
    "admin.ts": "import { Controller, Get, Module } from '@nestjs/common';\n@Controller('x')\nexport class Admin {\n  @Get('y')\n  y() { return 1; }\n}\n@Module({ controllers: [Admin, Other] })\nexport class AdminModule {}\n",
}
FLASK = {
    "app.py": "from flask import Flask\nfrom flask.views import MethodView\napp = Flask(__name__)\nclass Counter(MethodView):\n    def get(self):\n        pass\n    def put(self):\n        pass\napp.add_url_rule('/n', view_func=Counter.as_view('n'))\n",
}


def test_module_prefix(spark):
    assert found(spark, MODULES) == [("GET", "/admin/x/y", "y", False)]


def test_method_views(spark):
    assert found(spark, FLASK) == [("GET", "/n", "get", False), ("PUT", "/n", "put", False)]


def test_class_views_and_view_sets(spark):
    got = found(spark, VIEWS)
    assert [g for g in got if "users" in g[1] or "plain" in g[1]] == [("ANY", "/plain/", "plain", True), ("GET", "/users/", "get", False), ("POST", "/users/", "post", False)]
    assert [(m, p, h) for m, p, h, _ in got if "dogs" in p] == [("GET", "/dogs", "list"), ("GET", "/dogs/{pk}", "")]
    assert [(m, p, h) for m, p, h, _ in got if "birds" in p] == [("DELETE", "/birds/{pk}", "")]
    assert [(m, p, h) for m, p, h, _ in got if "fish" in p] == [("POST", "/fish", "create")]
    assert [g for g in got if "ants" in g[1]] == []
    assert len([g for g in got if "far" in g[1]]) == 6


@pytest.mark.parametrize("scheme", ["", "file://"])
def test_tree_on_any_path(spark, tmp_path, scheme):
    (tmp_path / "d").mkdir()
    for name, text in {"d/a.py": "a = 1\n", "d/b.py": "b = 1\n", "c.py": "c = 1\n", "d/.gitignore": "b.py\n", "requirements.txt": "Flask==3\n"}.items():
        (tmp_path / name).write_text(text)
    root = f"{scheme}{tmp_path}"
    assert sorted(r.path for r in scan.scan_tree(spark, root).collect()) == ["c.py", "d/a.py"]
    assert scan.manifest_evidence(spark, root) == ["flask==3\n"]
    assert store.load(spark, root) is None
    for n in (1, 2, 3):
        assert store.save({"t": spark.range(n)}, root, f"f{n}", {"n": n}) == f"v{n}"
    t, print_, stats = store.load(spark, root)
    assert (t["t"].count(), print_, stats) == (3, "f3", {"n": 3})
    assert not (tmp_path / ".loomgraph" / "v1").exists()
    # A version cut off in writing is passed over.
    for f in (tmp_path / ".loomgraph").glob(".manifest-3.json.crc"):
        f.unlink()
    (tmp_path / ".loomgraph" / "manifest-3.json").write_text("{")
    assert store.load(spark, root)[1] == "f2"

import pytest
from pyspark.sql import functions as F

from loomgraph.functions import text as T


def column(spark, f, *rows):
    rows = [r if isinstance(r, tuple) else (r,) for r in rows]
    df = spark.createDataFrame(rows, ", ".join(f"c{i} string" for i in range(len(rows[0]))))
    return [x[0] for x in df.select(f(*[F.col(c) for c in df.columns])).collect()]


def test_split_words(spark):
    got = column(spark, T.split_words, "fetchUserById", "get_user", "HTTPServer", "parseXMLDoc2", "ÉtatInitial", "__init__", "", None)
    assert got == [["fetch", "user", "by", "id"], ["get", "user"], ["http", "server"], ["parse", "xml", "doc", "2"], ["état", "initial"], ["init"], [], None]


def test_verb_buckets(spark):
    assert column(spark, T.bucket_for_name, "fetchUserById", "saveOrder", "UserRepository", "", "is_valid") == ["READ", "WRITE", None, None, "CHECK"]


@pytest.mark.parametrize(
    ("raw", "norm"),
    [("/users/:id", "/users/{*}"), ("/Users/{id}/", "/users/{*}"), ("https://h.example", "/"), ("https://h.example/A/b?x=1#y", "/a/b"), (" ", None), ("a//b", "/a/b"), ("/Éen", "/Éen"), ("/a/#{x}/b", "/a/{*}/b"), ("/p/<int:id>/q", "/p/{*}/q"), ("/p/*", "/p/{*}"), ("/x/${id}", "/x/{*}")],
)
def test_normalize_path(spark, raw, norm):
    assert column(spark, T.normalize_path, raw) == [norm]


def test_paths(spark):
    assert column(spark, T.paths_unify, ("/a/{*}", "/a/b"), ("/a", "/a/b"), ("/", "/"), ("/a/b", "/a/c")) == [True, False, True, False]
    assert column(spark, T.join_prefix, ("/a/", "/b"), ("", "b"), ("a", ""), ("", "")) == ["/a/b", "/b", "/a", "/"]
    assert column(spark, T.resolve_relative, "a/./b/../c", "../x") == ["a/c", "x"]
    assert column(spark, T.service_of, "apps/web/src/x.ts", "apps/x.ts", "README.md", "src/a/b") == ["apps/web", "apps", "(root)", "src"]
    assert column(spark, T.strip_extension, "a/b.c/d", "x.tar.gz", ".env", "a/.env") == ["a/b.c/d", "x.tar", ".env", "a/.env"]


def test_predicates(spark):
    assert column(spark, T.is_test_file, "tests/a.py", "src/contest.rs", "A/FooTest.java", "x.spec.ts", "conftest.py", "a/test_x.py", "Test.java") == [True, False, True, True, True, True, False]
    assert column(spark, T.entry_point_reason, "main", "__init__", "Java_x", "onClick", "once", "test_a", "plain") == ["main", "dunder", "jni_export", "callback_convention", None, "test_convention", None]
    assert column(spark, T.looks_public, "pub fn a", "fn a", "  public void a()", "@objc func a") == [True, False, True, True]
    assert column(spark, T.clean_type, "cdk.App", "App\\Models\\User", "List<X>", "?User", "") == ["App", "User", None, "User", None]
    assert column(spark, T.strip_quotes, "'a'", '"b"', "f'c'", "<stdio.h>") == ["a", "b", "c", "stdio.h"]
    assert column(spark, T.receiver_member, "this.svc", "self.x", "$this->db", "a.b", "this.a.b") == ["svc", "x", "db", None, None]


def test_routes(spark):
    assert column(spark, T.http_method, "get", "Route", "x") == ["GET", "ANY", None]
    assert column(spark, lambda c: T.route_key(c)["path"], "GET /x", "$default", "/y") == ["/x", "/{proxy+}", "/y"]
    assert column(spark, T.clean_route_regex, r"^users/(?P<pk>\d+)/$") == ["users/{pk}/"]
    assert column(spark, lambda a, b: T.aspnet_route(a, b, F.lit("UsersController"), F.lit("Find")), ("api/[controller]", "[action]/{id}"), ("api", "/root"), ("api", "~/top")) == ["/api/Users/Find/{id}", "/root", "/top"]
    assert column(spark, lambda c: T.gtest_names(c)["name"], "TEST(Suite, Case) {") == ["Case"]
    assert column(spark, T.shell_quote, "it's") == ["'it'\\''s'"]


def test_sql_functions(spark):
    T.register(spark)
    row = spark.sql("SELECT split_words('getHTTPFoo2') AS w, verb_bucket('get') AS v, paths_unify('/a/{*}', '/a/c') AS u").first()
    assert (row.w, row.v, row.u) == (["get", "http", "foo", "2"], "READ", True)

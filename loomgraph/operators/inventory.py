"""The inventory of tests, and the commands that run them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.functions import text as T

HOOK = "hook"


def list_tests(cases: DataFrame, path: str | None = None, name: str | None = None, suite: str | None = None, framework: str | None = None, language: str | None = None, hooks: bool = False, limit: int | None = 200) -> DataFrame:
    """Cases that pass the filters (substrings of path, name and suite; equal framework and language), by file, line and id."""
    c = cases if hooks else cases.filter(F.col("kind") != HOOK)
    for column, want in (("path", path), ("name", name), ("suite", suite)):
        if want:
            c = c.filter(F.contains(F.lower(column), F.lit(want.lower())))
    for column, want in (("framework", framework), ("language", language)):
        if want:
            c = c.filter(F.lower(column) == want.lower())
    c = c.orderBy("file_id", "line", "id")
    return c.limit(limit) if limit else c


def by_file(cases: DataFrame) -> DataFrame:
    return cases.groupBy("file_id", "path").agg(F.array_sort(F.collect_list(F.struct("line", "id", "name", "kind", "framework", "suite"))).alias("tests")).orderBy("file_id")


def frameworks(cases: DataFrame) -> DataFrame:
    """Cases per framework, all kinds: most first, then by name."""
    return cases.groupBy("framework").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "framework")


def case_count(cases: DataFrame) -> DataFrame:
    return cases.agg(F.count_if(F.col("kind") != HOOK).alias("cases"), F.count("*").alias("total"))


def suites(cases: DataFrame, blocks: DataFrame) -> DataFrame:
    """Cases with the name of the innermost suite block around them."""
    from loomgraph.operators.spans import innermost

    inner = innermost(cases, blocks, ["file_id"], "id", "line")
    return inner.join(blocks.select(F.col("id").alias("span_id"), F.col("name").alias("suite_name")), "span_id", "left").drop("span_id")


def build_markers(paths: DataFrame) -> DataFrame:
    """One row of flags: which build tools the tree has files of, at any depth."""
    has = lambda r: F.coalesce(F.bool_or(F.col("path").rlike(rf"(^|/){r}$")), F.lit(False))
    return paths.agg(has(r"pom\.xml").alias("maven"), has(r"build\.gradle(\.kts)?").alias("gradle"), has(r"Package\.swift").alias("swift_package"), has(r"composer\.json").alias("composer"), has("Gemfile").alias("gemfile"))


def test_command(framework: Column, path: Column, name: Column, suite: Column, line: Column, maven: Column, gradle: Column, swift_package: Column, composer: Column, gemfile: Column) -> Column:
    """The command that runs a case, or its whole file if the name is null."""
    q, cat = T.shell_quote, lambda *x: F.concat(*[F.lit(v) if isinstance(v, str) else v for v in x])
    with_name = lambda head, flag, n=name: F.coalesce(cat(head, path, f" {flag} ", q(n)), cat(head, path))
    both = cat(suite, ".", name)
    binary = F.nullif(F.regexp_extract(path, r"^tests/([^/]+)\.rs$", 1), F.lit(""))
    package = F.when(path.contains("/"), T.parent_dir(path)).otherwise(".")
    gradle_target, maven_target = cat(" --tests ", q(F.coalesce(both, suite))), cat(" -Dtest=", F.coalesce(cat(suite, "#", name), suite))
    tool = F.when(gradle, "./gradlew test").when(maven, "./mvnw test").otherwise("mvn test")
    java = cat(tool, F.coalesce(F.when(gradle, gradle_target).otherwise(maven_target), F.lit("")))
    dotnet = F.coalesce(cat("dotnet test --filter ", q(cat("FullyQualifiedName~", F.coalesce(both, suite, name)))), F.lit("dotnet test"))
    swift = F.coalesce(cat("swift test --filter ", F.coalesce(cat(suite, "/", name), suite, name)), F.lit("swift test"))
    xcode = F.coalesce(cat("xcodebuild test -only-testing:'<Scheme>/", suite, F.coalesce(cat("/", name), F.lit("")), "'  # set the test target"), F.lit("xcodebuild test"))
    php, ruby = F.when(composer, "vendor/bin/phpunit").otherwise("phpunit"), F.when(gemfile, "bundle exec ").otherwise("")
    return (
        F.when(framework.isin("pytest", "unittest"), with_name("pytest ", "-k"))
        .when(framework == "jest", with_name("npx jest ", "-t"))
        .when(framework == "vitest", with_name("npx vitest run ", "-t"))
        .when(framework == "mocha", with_name("npx mocha ", "--grep"))
        .when(framework == "node-test", cat("node --test ", path))
        .when(framework == "go-test", F.coalesce(cat("go test -run '^", name, "$' ./", package), cat("go test ./", package)))
        .when(framework == "rust-test", F.coalesce(cat("cargo test --test ", binary, F.coalesce(cat(" ", name), F.lit(""))), cat("cargo test ", name), cat("cargo test  # ", path)))
        .when(framework == "junit", java)
        .when(framework.isin("xunit", "nunit", "mstest"), dotnet)
        .when(framework == "phpunit", F.coalesce(cat(php, " --filter ", q(name), " ", path), cat(php, " ", path)))
        .when(framework == "rspec", cat(ruby, "rspec ", path, F.coalesce(cat(":", line.cast("string")), F.lit(""))))
        .when(framework == "minitest", cat(ruby, "ruby -Itest ", path, F.coalesce(cat(" -n ", name), F.lit(""))))
        .when(framework.isin("xctest", "swift-testing"), F.when(swift_package, swift).otherwise(xcode))
        .when(framework == "gtest", F.coalesce(cat("<test-binary> --gtest_filter=", suite, ".", F.coalesce(name, F.lit("*"))), F.lit("ctest")))
        .when(framework == "catch2", F.coalesce(cat("<test-binary> ", q(name)), F.lit("ctest")))
        .when(framework == "bats", with_name("bats ", "-f"))
        .when(framework == "shunit2", cat("sh ", path))
        .when(framework == "c-test", cat("<test-binary>  # built from ", path))
        .otherwise(cat("<runner> ", path))
    )

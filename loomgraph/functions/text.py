"""Scalar functions on identifiers, paths and routes, as Column expressions.

Everything here is built from Spark's own functions, so it stays in the JVM and can be
pushed down; ``register`` offers the main ones to SQL.
"""

from __future__ import annotations

import re
from itertools import chain

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

#: Leading verbs of identifiers by the bucket they stand for.
VERBS = {
    "READ": "fetch get load retrieve read find query lookup list scan search peek view resolve",
    "WRITE": "create insert add save store persist write put append record",
    "DELETE": "delete remove drop clear purge destroy erase evict unlink discard",
    "CHECK": "check validate verify assert ensure expect is has can should confirm guard contains matches equals exists",
    "EMIT": "send emit publish dispatch notify broadcast post trigger fire signal announce",
    "PARSE": "parse decode deserialize unmarshal extract unserialize unpack interpret",
    "FORMAT": "format encode serialize marshal stringify escape pack",
    "UPDATE": "update set modify patch mutate change edit replace assign toggle increment decrement bump",
    "INIT": "init initialize setup configure register bootstrap install prepare provision seed",
    "EXEC": "handle process execute run apply invoke perform do call exec",
    "AUTH": "auth login logout authenticate authorize signin signout signup",
    "COMPUTE": "count sum aggregate reduce compute calculate average score calc measure total tally",
    "CONNECT": "open connect listen dial accept subscribe",
    "CLOSE": "close disconnect shutdown stop cancel abort terminate kill dispose teardown unsubscribe halt",
    "START": "start begin launch spawn resume restart",
    "COPY": "copy clone duplicate snapshot",
    "MERGE": "merge join combine concat union zip",
    "FILTER": "filter select pick exclude omit reject prune dedupe distinct",
    "SORT": "sort order rank arrange",
    "TRANSFORM": "map transform convert cast normalize translate migrate adapt coerce flatten invert reverse wrap unwrap",
    "WAIT": "wait sleep delay poll retry block await defer debounce throttle timeout",
    "LOG": "log trace debug warn report audit",
    "SHOW": "render draw display show print plot paint visualize highlight",
    "TEST": "test mock stub fake spy bench benchmark fuzz",
    "LOCK": "lock acquire release unlock",
    "CRYPTO": "hash sign encrypt decrypt digest cipher hmac",
    "XFER": "upload download sync push pull import export",
    "BUILD": "build make generate produce derive compile new assemble construct",
    "BIND": "bind attach mount wire inject hook link",
    "SPLIT": "split tokenize chunk slice partition segment divide",
}
VERB_BUCKETS = {v: k for k, vs in VERBS.items() for v in vs.split()}

#: Directories that hold services, names of test directories.
GROUP_DIRS = ["apps", "packages", "services", "libs", "modules"]
TEST_DIRS = ["tests", "test", "__tests__", "spec", "specs", "testing"]
#: The last segment of names that mark a test, and names of HTTP methods.
TEST_MARKS = ["test", "Test", "TestCase", "TestMethod", "TestFixture", "ParameterizedTest", "RepeatedTest", "TestFactory", "TestTemplate", "Fact", "Theory", "bench", "fixture"]
HTTP_METHODS = ["get", "post", "put", "delete", "patch", "head", "options"]
ANY_METHOD = ["all", "any", "route", "match"]
#: Fixed value: a path segment that stands for any value.
WILD = "{*}"
#: Weights of structural and semantic similarity.
BLEND = (0.6, 0.4)

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _map(table: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for x in chain(*table.items())])


def split_words(name: Column) -> Column:
    """Lower-case words of a camelCase, snake_case or acronymic identifier, digits apart; any script."""
    s = name
    for a, b in ((r"\p{Lu}+", r"\p{Lu}\p{Ll}"), (r"\p{Ll}", r"\p{Lu}"), (r"\p{L}", r"\p{N}"), (r"\p{N}", r"\p{L}")):
        s = F.regexp_replace(s, f"({a})({b})", "$1 $2")
    return F.filter(F.split(F.lower(s), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def verb_bucket(word: Column) -> Column:
    """The bucket of a verb, null for other words."""
    return F.try_element_at(_map(VERB_BUCKETS), word)


def bucket_for_name(name: Column) -> Column:
    """The bucket of an identifier's leading word."""
    return verb_bucket(F.coalesce(F.get(split_words(name), F.lit(0)), F.lit("")))


def ascii_lower(s: Column) -> Column:
    return F.translate(s, _UPPER, _LOWER)


def segments(path: Column) -> Column:
    """Segments between slashes that are not empty."""
    return F.filter(F.split(path, "/"), lambda x: x != "")


def normalize_path(raw: Column) -> Column:
    """A route or link in canonical form: no scheme, host, query or fragment, ASCII lower case, parameters as {*}.

    Null for blank input, ``/`` for a bare host.  A ``#`` that opens ``#{`` is a parameter, not a fragment.
    """
    p = F.trim(raw)
    rest = F.regexp_extract(p, r"(?s)://[^/]*(/.*)?$", 1)
    p = F.when(F.instr(p, "://") > 0, F.regexp_replace(rest, "^$", "/")).otherwise(p)
    # The first ? or # ends the path, unless it is the # of #{, after which nothing is cut.
    p = F.regexp_replace(p, r"(?s)^([^?#]*)(?:\?|#(?!\{)).*$", "$1")
    folded = F.transform(segments(p), lambda x: F.when(x.rlike(r"^[:<*$]") | x.contains("{"), F.lit(WILD)).otherwise(ascii_lower(x)))
    return F.when(F.trim(raw) == "", None).otherwise(F.concat(F.lit("/"), F.array_join(folded, "/")))


def paths_unify(a: Column, b: Column) -> Column:
    """Whether two canonical paths agree, {*} on either side standing for any segment."""
    x, y = segments(a), segments(b)
    agree = F.zip_with(x, y, lambda p, q: (p == q) | (p == WILD) | (q == WILD))
    return (F.size(x) == F.size(y)) & F.forall(agree, lambda t: F.coalesce(t, F.lit(False)))


def concrete_segments(path: Column) -> Column:
    return F.size(F.filter(segments(path), lambda x: x != WILD))


def join_prefix(prefix: Column, sub: Column) -> Column:
    """Two route parts joined by one slash."""
    p, s = F.regexp_replace(prefix, "^/+|/+$", ""), F.regexp_replace(sub, "^/+", "")
    return F.concat(F.lit("/"), F.concat_ws("/", F.nullif(p, F.lit("")), F.nullif(s, F.lit(""))))


def ensure_slash(p: Column) -> Column:
    return F.when(p.startswith("/"), p).otherwise(F.concat(F.lit("/"), p))


def http_method(name: Column) -> Column:
    """Upper-case method of a verb; ANY for all, any, route and match; else null."""
    n = F.lower(name)
    return F.when(n.isin(HTTP_METHODS), F.upper(name)).when(n.isin(ANY_METHOD), "ANY")


def methods_compatible(a: Column, b: Column) -> Column:
    return (a == b) | (a == "ANY") | (b == "ANY")


def url_shaped(s: Column) -> Column:
    return ~s.contains(" ") & (s.startswith("/") | s.contains("://"))


def parent_dir(path: Column) -> Column:
    return F.when(path.contains("/"), F.regexp_replace(path, "/[^/]*$", "")).otherwise("")


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def strip_extension(path: Column) -> Column:
    """Without the last extension; names that begin with their only dot keep it."""
    return F.regexp_replace(path, r"([^/])\.[^./]*$", "$1")


def resolve_relative(path: Column) -> Column:
    """``a/./b/../c`` as ``a/c``; ``..`` at the top is dropped."""
    done = F.aggregate(
        F.filter(F.split(path, "/"), lambda x: ~x.isin("", ".")),
        F.array().cast("array<string>"),
        lambda acc, x: F.when(x == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(x))),
    )
    return F.array_join(done, "/")


def qualified_name(package: Column, path: Column, owner: Column, name: Column) -> Column:
    """``scope::Type::name`` with the package, or the path without extension, as the scope."""
    return F.concat_ws("::", F.coalesce(package, strip_extension(path)), owner, name)


def dotted_package(path: Column) -> Column:
    """A dotted import without its trailing wildcard and type names."""
    return F.regexp_replace(path, r"(\.(\*|\p{Lu}\w*))+$", "")


def js_package(path: Column) -> Column:
    """The package of an import: ``@scope/name`` or the first segment."""
    return F.regexp_extract(path, r"^(@[^/]+/[^/]+|[^/]+)", 1)


def is_test_file(path: Column) -> Column:
    """Whether directories or the file name follow a test convention."""
    p = ascii_lower(path)
    base = base_name(p)
    stem = strip_extension(base)
    by_class = stem.rlike(r"^.+tests?$") & ~stem.isin("tests") & p.rlike(r"\.(java|kt|cs|scala|swift)$")
    return (
        p.rlike(rf"(^|/)({'|'.join(TEST_DIRS)})/")
        | base.rlike(r"\.(test|spec)\.")
        | (base == "conftest.py")
        | stem.rlike(r"_(test|spec)$")
        | stem.startswith("test_")
        | by_class
    )


def is_test_mark(name: Column) -> Column:
    last = F.regexp_extract(name, r"([^.:]*)$", 1)
    return name.startswith("pytest.mark") | last.isin(TEST_MARKS)


def is_test_name(name: Column, language: Column) -> Column:
    """Whether a name alone makes a test in its language; the prefix must end a word."""
    plain, camel = name.startswith("test_"), name.rlike(r"^test[A-Z0-9_]")
    return (
        F.when(language.isin("python", "ruby"), plain)
        .when(language.isin("php", "swift", "objc", "bash"), plain | camel)
        .when(language == "go", name.rlike(r"^(Test|Benchmark|Fuzz|Example)[A-Z0-9_]"))
        .otherwise(False)
    )


def entry_point_reason(name: Column) -> Column:
    """Why a function may be called from outside although nothing names it; else null."""
    return (
        F.when(name == "main", "main")
        .when(name.rlike(r"^__.+__$"), "dunder")
        .when(name.startswith("Java_"), "jni_export")
        .when(name.rlike(r"^(on|handle)[\p{Lu}_]"), "callback_convention")
        .when(name.startswith("test_") | name.startswith("Test") | name.endswith("_test"), "test_convention")
    )


def looks_public(signature: Column) -> Column:
    return signature.rlike(r"^(pub|export|open) ") | signature.rlike(r"public |extern |@objc")


def service_of(path: Column) -> Column:
    """The top directory, or the second one below apps, packages and the like; ``(root)`` for files at the top."""
    s = F.split(path, "/")
    deep = (F.size(s) > 2) & s[0].isin(GROUP_DIRS)
    return F.when((F.size(s) < 2) | (s[0] == ""), "(root)").when(deep, F.concat_ws("/", s[0], s[1])).otherwise(s[0])


def search_score(name: Column, qualified: Column, toplevel: Column, query: str) -> Column:
    """100 equal, 80 prefix, 60 inside, 40 in the qualified name, 20 letters in order, less 15 for module scope; else null."""
    q = query.lower()
    n, in_order = F.lower(name), "(?s).*" + ".*".join(map(re.escape, q)) + ".*"
    score = F.when(n == q, 100).when(n.startswith(q), 80).when(n.contains(q), 60).when(F.lower(qualified).contains(q), 40).when(n.rlike(in_order), 20)
    return score - F.when(toplevel, 15).otherwise(0)


def clean_type(t: Column) -> Column:
    """The simple name of a type; null for generics, unions, tuples and overlong ones."""
    bare = F.regexp_replace(t, r"^\?|\?$", "")
    last = F.regexp_extract(bare, r"([^.:\\]*)$", 1)
    return F.when(bare.rlike(r"[\s<>\[\](){},|&*]") | (F.length(last) > 64) | (last == ""), None).otherwise(last)


def strip_quotes(s: Column) -> Column:
    """A string literal or include without prefix and quotes."""
    t = F.regexp_replace(F.trim(s), r"""^[rRbBuUfF@$]{0,2}(?=["'`])""", "")
    return F.regexp_replace(F.regexp_replace(t, r"""^("{3}|'{3}|["'`<])""", ""), r"""("{3}|'{3}|["'`>])$""", "")


def sanitize_receiver(r: Column) -> Column:
    return F.when((F.length(r) <= 48) & ~r.rlike(r"[(\n]"), r)


def receiver_member(r: Column) -> Column:
    """The member of ``this.x``, ``self.x``, ``$this->x`` or ``Self::x``; null if there is none or more hops."""
    return F.nullif(F.regexp_extract(r, r"^(?:this\.|self\.|\$this->|Self::)(\w+)$", 1), F.lit(""))


def truncate_chars(s: Column, n: int) -> Column:
    return F.when(F.char_length(s) > n, F.concat(F.substring(s, 1, n - 1), F.lit("…"))).otherwise(s)


def shell_quote(s: Column) -> Column:
    return F.concat(F.lit("'"), F.replace(s, F.lit("'"), F.lit("'\\''")), F.lit("'"))


def touch_path(p: Column) -> Column:
    return F.regexp_replace(F.translate(F.trim(p), "\\", "/"), r"^(\./)+", "")


def mentions(entry: Column, file: Column) -> Column:
    return (entry == file) | entry.endswith(F.concat(F.lit("/"), file))


def aspnet_route(prefix: Column, sub: Column, controller: Column, action: Column) -> Column:
    """A class and a method template joined, tokens replaced; ``/`` and ``~/`` override the class."""
    own = F.regexp_replace(sub, "^~", "")
    path = F.when(own.startswith("/"), own).otherwise(join_prefix(prefix, own))
    name = F.regexp_replace(controller, "Controller$", "")
    return F.replace(F.replace(path, F.lit("[controller]"), name), F.lit("[action]"), action)


def route_key(key: Column) -> Column:
    """``GET /x`` as (method, path); a lone path is any method, ``$default`` any path."""
    method = F.upper(F.regexp_extract(key, r"^\s*([A-Za-z]+)\s+/", 1))
    path = F.regexp_extract(key, r"(/\S*)\s*$", 1)
    return F.struct(
        F.when(method.isin([m.upper() for m in HTTP_METHODS]), method).otherwise("ANY").alias("method"),
        F.when(F.trim(key) == "$default", "/{proxy+}").otherwise(F.nullif(path, F.lit(""))).alias("path"),
    )


def gtest_names(signature: Column) -> Column:
    """(suite, name) of a ``TEST(Suite, Name)`` signature."""
    pick = lambda i: F.nullif(F.regexp_extract(signature, r"TEST(?:_[FP])?\s*\(\s*(\w+)\s*,\s*(\w+)", i), F.lit(""))
    return F.struct(pick(1).alias("suite"), pick(2).alias("name"))


def clean_route_regex(p: Column) -> Column:
    """A regex route as a plain one: anchors go, groups become parameters."""
    s = F.regexp_replace(p, r"^\^|\$$|\\Z$", "")
    s = F.regexp_replace(s, r"\(\?P?<(\w+)>(?:[^()]|\([^()]*\))*\)", "{$1}")
    return F.regexp_replace(s, r"\([^()]*\)", WILD.replace("*", r"\*"))


def singular(name: Column) -> Column:
    return F.when(name.rlike("ies$"), F.regexp_replace(name, "ies$", "y")).otherwise(F.regexp_replace(name, "([^s])s$", "$1"))


def grpc_service(name: Column) -> Column:
    """The service of a generated stub, client or servicer."""
    return F.regexp_replace(F.regexp_replace(name, r"^(?:New|add_|Register)", ""), r"(?:Stub|Client|Servicer|ImplBase|Grpc|Server|_to_server)+$", "")


def confidence(high: Column) -> Column:
    return F.when(high, "high").otherwise("heuristic")


def register(spark: SparkSession) -> None:
    """Offers split_words, normalize_path, verb_bucket and paths_unify to SQL, as SQL functions."""
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION ascii_lower(s STRING) RETURNS STRING RETURN translate(s, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")
    spark.sql(
        "CREATE OR REPLACE TEMPORARY FUNCTION split_words(s STRING) RETURNS ARRAY<STRING> RETURN filter(split(lower("
        r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(s, '(\\p{Lu}+)(\\p{Lu}\\p{Ll})', '$1 $2'), '(\\p{Ll})(\\p{Lu})', '$1 $2'), '(\\p{L})(\\p{N})', '$1 $2'), '(\\p{N})(\\p{L})', '$1 $2')"
        r"), '[^\\p{L}\\p{N}]+'), w -> w <> '')"
    )
    pairs = ", ".join(f"'{k}', '{v}'" for k, v in VERB_BUCKETS.items())
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION verb_bucket(w STRING) RETURNS STRING RETURN try_element_at(map({pairs}), w)")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION paths_unify(a STRING, b STRING) RETURNS BOOLEAN RETURN size(split(a, '/')) = size(split(b, '/')) AND forall(zip_with(split(a, '/'), split(b, '/'), (p, q) -> p = q OR p = '{*}' OR q = '{*}'), t -> t)")

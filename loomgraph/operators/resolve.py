"""Name resolution: imports to files or packages, calls to functions.

Resolution is a ladder: candidates of all rungs are one table with the rung's number, and the lowest
rung with any candidate decides.  Names as common as ``get`` would multiply rows, so per name and scope
only the nine smallest ids are ever candidates: one callee and eight rivals is all that a call keeps.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.functions import text as T
from loomgraph.plans.lineage import materialize, release

#: What a relative import may end in, in the order tried.
SUFFIXES = ["", ".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs", ".mts", ".cts", "/index.ts", "/index.tsx", "/index.js", "/index.jsx"]
#: Receivers that mean the own type.
SELF = ["this", "self", "$this", "Self"]
RIVALS = 8
#: Lines in a block of spans.
BLOCK = 64
RUNGS = ["by type", "own type", "builtin", "import", "type name", "same file", "named import", "same package", "same directory", "by name", "external import"]


def classify_imports(imports: DataFrame, files: DataFrame) -> DataFrame:
    """``imports`` (file_id, ord, path, names) plus resolved_file and external_package.

    ``files`` has id, path, language, package.  Relative script imports try the suffixes in order; includes the
    joined, the literal and then the only path with that ending; Python modules their longest prefix; dotted
    imports a declared package; Go directories.  What resolves to no file is a package.
    """
    here = files.select(F.col("id").alias("file_id"), F.col("path").alias("own"), "language")
    i = imports.join(here, "file_id")
    known = files.select(F.col("id").alias("target"), F.col("path").alias("candidate"))
    keys = ["file_id", "ord"]
    base = T.parent_dir(F.col("own"))
    beside = T.resolve_relative(F.concat_ws("/", base, F.col("path")))
    script = F.col("language").isin("javascript", "typescript", "tsx")
    relative = F.col("path").startswith(".")
    js = i.filter(script & relative).select(*keys, F.posexplode(F.transform(F.array(*map(F.lit, SUFFIXES)), lambda s: F.concat(beside, s))).alias("rank", "candidate"))
    include = F.col("language").isin("c", "cpp", "objc", "bash", "ruby", "php")
    near = i.filter(include).select(*keys, F.posexplode(F.array(beside, F.col("path"), F.concat(beside, F.lit(".rb")), F.concat(beside, F.lit(".php")))).alias("rank", "candidate"))
    python = i.filter(F.col("language") == "python")
    dots = F.length(F.regexp_extract("path", r"^(\.*)", 1))
    rest = F.split(F.regexp_replace("path", r"^\.+", ""), r"\.")
    up = F.aggregate(F.sequence(F.lit(2), F.greatest(dots, F.lit(2))), base, lambda d, n: F.when(n <= dots, T.parent_dir(d)).otherwise(d))
    root = F.when(dots > 0, F.concat_ws("/", F.nullif(up, F.lit("")), F.lit("."))).otherwise(F.lit("."))
    python = python.withColumn("_root", root).withColumn("_rest", F.filter(rest, lambda x: x != ""))
    lengths = F.transform(F.sequence(F.size("_rest"), F.lit(1), F.lit(-1)), lambda n: T.resolve_relative(F.concat_ws("/", F.col("_root"), F.array_join(F.slice("_rest", 1, n), "/"))))
    ends = F.flatten(F.transform(lengths, lambda p: F.array(F.concat(p, F.lit(".py")), F.concat(p, F.lit("/__init__.py")))))
    py = python.filter(F.size("_rest") > 0).select(*keys, F.posexplode(ends).alias("rank", "candidate"))
    ranked = reduce(DataFrame.unionByName, [js, near, py]).join(known, "candidate").groupBy(*keys).agg(F.min(F.struct("rank", "target")).alias("m")).select(*keys, F.col("m.target").alias("t1"))
    # Endings: only if one file alone has it.  Files are keyed by all their endings.
    pieces = F.split("path", "/")
    endings = files.select(F.col("id").alias("target"), F.explode(F.transform(F.sequence(F.lit(1), F.size(pieces)), lambda n: F.array_join(F.slice(pieces, n, F.size(pieces)), "/"))).alias("tail"))
    alone = endings.groupBy("tail").agg(F.count("*").alias("n"), F.min("target").alias("t2")).filter("n = 1").drop("n")
    tail = i.filter(include).select(*keys, F.regexp_replace("path", r"^(\.\./|\./)+", "").alias("tail")).join(alone, "tail").select(*keys, "t2")
    # Declared packages: the import itself or what encloses it; one file stands for the package.
    declared = files.filter("package is not null").groupBy("package").agg(F.min("id").alias("t3"))
    steps = F.split("path", r"[.\\]|::")
    dotted = i.filter(F.col("language").isin("java", "kotlin", "csharp", "php", "scala")).select(*keys, F.explode(F.transform(F.sequence(F.lit(1), F.size(steps)), lambda n: F.array_join(F.slice(steps, 1, n), "."))).alias("package"))
    owned = dotted.join(declared, "package").groupBy(*keys).agg(F.max(F.struct(F.length("package").alias("l"), "t3")).alias("m")).select(*keys, F.col("m.t3").alias("t3"))
    dirs = files.filter(F.col("language") == "go").groupBy(T.parent_dir(F.col("path")).alias("dir")).agg(F.min("id").alias("t4"))
    go_parts = F.split("path", "/")
    go = i.filter(F.col("language") == "go").select(*keys, F.explode(F.transform(F.sequence(F.lit(1), F.size(go_parts)), lambda n: F.array_join(F.slice(go_parts, n, F.size(go_parts)), "/"))).alias("dir"))
    inside = go.join(dirs, "dir").groupBy(*keys).agg(F.max(F.struct(F.length("dir").alias("l"), "t4")).alias("m")).select(*keys, F.col("m.t4").alias("t4"))
    crate = F.filter(F.split(F.regexp_replace("path", r"^(crate|self|super)::", ""), "::"), lambda x: x.rlike("^[a-z_]"))
    rust = i.filter((F.col("language") == "rust") & F.col("path").rlike("^(crate|self|super)::")).withColumn("_c", crate)
    paths = F.transform(F.sequence(F.size("_c"), F.lit(1), F.lit(-1)), lambda n: F.array_join(F.slice("_c", 1, n), "/"))
    rust = rust.filter(F.size("_c") > 0).select(*keys, F.posexplode(F.flatten(F.transform(paths, lambda p: F.array(F.concat(p, F.lit(".rs")), F.concat(p, F.lit("/mod.rs")))))).alias("rank", "tail"))
    crates = rust.join(alone, "tail").groupBy(*keys).agg(F.min(F.struct("rank", "t2")).alias("m")).select(*keys, F.col("m.t2").alias("t5"))
    out = i
    for part in (ranked, tail, owned, inside, crates):
        out = out.join(part, keys, "left")
    out = out.withColumn("resolved_file", F.coalesce("t1", "t2", "t3", "t4", "t5"))
    package = (
        F.when(script, F.when(~relative, T.js_package(F.col("path"))))
        .when(F.col("language") == "python", F.when(dots == 0, rest[0]))
        .when(F.col("language").isin("java", "kotlin", "csharp", "scala", "php"), T.dotted_package(F.col("path")))
        .when(F.col("language") == "rust", F.when(~F.col("path").rlike("^(crate|self|super)(::|$)"), F.split("path", "::")[0]))
        .otherwise(F.col("path"))
    )
    out = out.withColumn("external_package", F.when(F.col("resolved_file").isNull(), package))
    return out.select(*imports.columns, "resolved_file", "external_package")


def substitute_constants(literals: DataFrame, consts: DataFrame) -> DataFrame:
    """Adds after each unkeyed identifier that names a constant of its file the constant's string."""
    hit = literals.filter("kind = 'ident' and key is null").join(consts.select("file_id", F.col("name").alias("text"), "value"), ["file_id", "text"])
    added = hit.withColumns({"kind": F.lit("str"), "text": F.col("value"), "added": F.lit(1)}).drop("value")
    return literals.withColumn("added", F.lit(0)).unionByName(added.select(*literals.columns, "added")).orderBy("file_id", "call", "ord", "added")


def injection_bindings(calls: DataFrame, literals: DataFrame) -> DataFrame:
    """(abstract, concrete) from container calls: two type arguments of AddX, bind and singleton of two classes, provide and useClass."""
    generic = calls.filter(F.col("name").isin("AddScoped", "AddSingleton", "AddTransient") & (F.size("type_args") == 2)).select(F.col("type_args")[0].alias("abstract"), F.col("type_args")[1].alias("concrete"))
    ident = literals.filter("kind = 'ident'").select("call", "index", "key", "text")
    bound = calls.filter(F.col("name").isin("bind", "singleton") & F.col("receiver").rlike(r"(^|->)app$|^\$app$|\$this->app")).select(F.col("idx").alias("call"))
    pair = lambda a, b: a.join(b, "call").select("abstract", "concrete")
    capital = ident.filter(F.col("text").rlike(r"^\\?\p{Lu}"))
    php = pair(bound.join(capital.filter("index = 0").select("call", T.clean_type(F.col("text")).alias("abstract")), "call"), capital.filter("index = 1").select("call", T.clean_type(F.col("text")).alias("concrete")))
    provide = ident.filter("key = 'provide'").select("call", "index", F.col("text").alias("abstract"))
    nest = provide.join(ident.filter("key = 'useClass'").select("call", "index", F.col("text").alias("concrete")), ["call", "index"]).select("abstract", "concrete")
    return generic.union(php).union(nest).distinct()


def _candidates(functions: DataFrame, scope: list[str]) -> DataFrame:
    """The nine smallest ids per name and scope, and how many there are."""
    g = functions.groupBy("name", *scope).agg(F.count("*").alias("n"), F.min("id").alias("low"))
    r = F.row_number().over(Window.partitionBy("name", *scope).orderBy("id"))
    few = functions.withColumn("_r", r).filter(F.col("_r") <= RIVALS + 1).groupBy("name", *scope).agg(F.array_sort(F.collect_list("id")).alias("ids"))
    return g.join(few, ["name", *scope]).select("name", *scope, "n", "ids")


def resolve_calls(calls: DataFrame, functions: DataFrame, imports: DataFrame, files: DataFrame, locals_: DataFrame | None = None, fields: DataFrame | None = None, bindings: DataFrame | None = None, builtins: dict[str, list[str]] | None = None) -> DataFrame:
    """``calls`` (idx, caller, name, receiver, line) plus kind, callee, high, ambiguous_with, package and rung.

    A rung that hits decides; the callee is its smallest id and the next eight are rivals.  Every rung but
    three is sure even with several hits: the same directory never is, the whole language or tree only if
    one function bears the name, types only through one step.
    """
    f = functions.filter(~F.col("is_toplevel")).select("id", "name", "containing_type", "file_id", "language").join(files.select(F.col("id").alias("file_id"), "path", "package"), "file_id").withColumn("dir", T.parent_dir(F.col("path")))
    f = f.select("id", "name", "containing_type", "file_id", "language", "package", "dir")
    of_caller = functions.select(F.col("id").alias("caller"), "file_id", "language", F.col("containing_type").alias("own_type")).join(files.select(F.col("id").alias("file_id"), "path", "package"), "file_id")
    c = calls.select("idx", "caller", "name", "receiver").join(of_caller, "caller").withColumn("dir", T.parent_dir(F.col("path")))
    c = c.withColumn("member", T.receiver_member(F.col("receiver")))
    rungs: list[DataFrame] = []

    def rung(number: int, hits: DataFrame, high, package=None, kind: str = "internal") -> None:
        ids = F.col("ids") if kind == "internal" else F.lit(None).cast("array<bigint>")
        rungs.append(hits.select("idx", F.lit(number).alias("rung"), F.lit(kind).alias("kind"), ids.alias("ids"), high.cast("boolean").alias("high"), (package if package is not None else F.lit(None).cast("string")).alias("package")))

    sure = F.lit(True)
    methods = _candidates(f.filter("containing_type is not null"), ["containing_type"])
    if locals_ is not None and fields is not None:
        simple = c.filter("receiver is not null")
        from_local = simple.join(locals_.select(F.col("fn_id").alias("caller"), F.col("name").alias("receiver"), F.col("type").alias("type_name")), ["caller", "receiver"]).select("idx", "name", "type_name", F.lit(0).alias("via"))
        typed = fields.groupBy("owner", "name").agg(F.count_distinct("type_name").alias("n"), F.min("type_name").alias("type_name")).filter("n = 1")
        from_field = simple.filter("member is not null").join(typed.select(F.col("owner").alias("own_type"), F.col("name").alias("member"), "type_name"), ["own_type", "member"]).select("idx", "name", "type_name", F.lit(0).alias("via"))
        want = from_local.unionByName(from_field)
        if bindings is not None:
            step = want.join(bindings.select(F.col("base").alias("type_name"), "derived"), "type_name").select("idx", "name", F.col("derived").alias("type_name"), F.lit(1).alias("via"))
            want = want.unionByName(step)
        by_type = want.withColumnRenamed("type_name", "containing_type").join(methods, ["name", "containing_type"])
        # The declared type's own methods come before those of what derives from it; results merge per call.
        merged = by_type.groupBy("idx").agg(F.min("via").alias("first"), F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))), 1, RIVALS + 1).alias("ids"))
        rung(0, merged, F.size("ids") == 1)
    own = c.filter(F.col("receiver").isin(SELF) & F.col("own_type").isNotNull())
    same_file = _candidates(f.filter("containing_type is not null"), ["containing_type", "file_id"])
    rung(1, own.join(same_file, (own.name == same_file.name) & (own.own_type == same_file.containing_type) & (own.file_id == same_file.file_id)), sure)
    rung(1, own.join(same_file.select("name", "containing_type", "file_id"), (own.name == same_file.name) & (own.own_type == same_file.containing_type) & (own.file_id == same_file.file_id), "left_anti").join(methods.withColumnRenamed("containing_type", "own_type"), ["name", "own_type"]), sure)
    if builtins:
        known = c.sparkSession.createDataFrame([(lang, r) for lang, rs in builtins.items() for r in rs], "language string, receiver string")
        rung(2, c.join(F.broadcast(known), ["language", "receiver"]), sure, F.concat(F.lit("builtin:"), "receiver"), "external")
    bound = imports.select("file_id", "ord", F.explode("names").alias("bound"), "resolved_file", "external_package")
    with_receiver = c.join(bound.withColumnRenamed("bound", "receiver"), ["file_id", "receiver"])
    first = Window.partitionBy("idx").orderBy("ord")
    with_receiver = with_receiver.withColumn("_r", F.row_number().over(first)).filter("_r = 1")
    rung(3, with_receiver.filter("external_package is not null"), sure, F.col("external_package"), "external")
    in_file = _candidates(f, ["file_id"])
    target = with_receiver.filter("resolved_file is not null").drop("file_id").withColumnRenamed("resolved_file", "file_id").join(in_file, ["name", "file_id"])
    rung(3, target, sure)
    rung(4, c.filter(F.col("receiver").rlike(r"^\p{Lu}")).join(methods.withColumnRenamed("containing_type", "receiver"), ["name", "receiver"]), sure)
    rung(5, c.join(in_file, ["name", "file_id"]), sure)
    named = c.join(bound.withColumnRenamed("bound", "name"), ["file_id", "name"])
    rung(6, named.filter("resolved_file is not null").drop("file_id").withColumnRenamed("resolved_file", "file_id").join(in_file, ["name", "file_id"]), sure)
    rung(7, c.filter("package is not null").join(_candidates(f.filter("package is not null"), ["package"]), ["name", "package"]), sure)
    rung(8, c.join(_candidates(f, ["dir", "language"]), ["name", "dir", "language"]), F.lit(False))
    rung(9, c.join(_candidates(f, ["language"]), ["name", "language"]), F.col("n") == 1)
    any_language = c.join(_candidates(f, ["language"]).select("name", "language"), ["name", "language"], "left_anti").join(_candidates(f, []), "name")
    rung(9, any_language, F.col("n") == 1)
    rung(10, named.filter("external_package is not null"), sure, F.col("external_package"), "external")
    best = reduce(DataFrame.unionByName, rungs).groupBy("idx").agg(F.min(F.struct("rung", "kind", "package", "ids", "high")).alias("m")).select("idx", "m.*")
    out = calls.join(best, "idx", "left")
    return out.select(
        *calls.columns,
        F.coalesce("kind", F.lit("unresolved")).alias("kind"),
        F.get("ids", F.lit(0)).alias("callee"),
        F.coalesce("high", F.lit(False)).alias("high"),
        F.coalesce(F.slice("ids", 2, RIVALS), F.array().cast("array<bigint>")).alias("ambiguous_with"),
        "package",
        "rung",
    )


def _pointed(answers: DataFrame, functions: DataFrame, files: DataFrame) -> DataFrame:
    """(def_file, def_line, fn) for every line an answer points to: the function that begins there or the smallest around it.

    Answers share lines and functions share spans, so distinct lines meet distinct spans, by blocks of lines.
    """
    spans = functions.filter(~F.col("is_toplevel")).join(files.select(F.col("id").alias("file_id"), F.col("path").alias("def_file")), "file_id")
    spans = spans.groupBy("def_file", "start_line", "end_line").agg(F.min("id").alias("fn")).filter("start_line <= end_line")
    block = lambda line: F.floor(F.col(line) / BLOCK).cast("bigint")
    spans = spans.withColumn("_b", F.explode(F.sequence(block("start_line"), block("end_line"))))
    lines = answers.filter("def_line is not null").select("def_file", "def_line").distinct().withColumn("_b", block("def_line"))
    rank = F.struct((F.col("start_line") != F.col("def_line")).alias("off"), (F.col("end_line") - F.col("start_line")).alias("len"), "fn")
    inside = lines.join(spans, ["def_file", "_b"]).filter("start_line <= def_line and def_line <= end_line")
    return inside.groupBy("def_file", "def_line").agg(F.min(rank).alias("m")).select("def_file", "def_line", F.col("m.fn").alias("fn"))


def apply_answers(calls: DataFrame, answers: DataFrame, functions: DataFrame, files: DataFrame, rounds: int = 1) -> DataFrame:
    """Edges settled by answers (path, line, col, def_file, def_line, def_package) about a call's name.

    A definition in the tree becomes the sure callee, the function that begins there or the smallest around it;
    one outside makes the call external; calls without an answer stay.  With several ``rounds`` each takes the
    places of its own hash and writes its calls, so that only one round's shuffle files are on disk at a time.
    """
    pointed = _pointed(answers, functions, files)
    if rounds == 1:
        return _rewrite(calls, answers, pointed, functions, files)
    pointed, out = materialize(pointed), []
    for r in range(rounds):
        mine = lambda line, col: F.pmod(F.xxhash64(F.col(line).cast("bigint"), F.col(col).cast("bigint")), F.lit(rounds)) == r  # noqa: B023, E731
        out.append(materialize(_rewrite(calls.filter(mine("name_line", "name_col")), answers.filter(mine("line", "col")), pointed, functions, files)))
        release(calls.sparkSession)
    return reduce(DataFrame.unionByName, out)


def _rewrite(calls: DataFrame, answers: DataFrame, pointed: DataFrame, functions: DataFrame, files: DataFrame) -> DataFrame:
    # What names neither a function nor a package changes no call.
    inside = answers.filter("def_line is not null").join(pointed, ["def_file", "def_line"], "left").filter("fn is not null or def_package is not null")
    outside = answers.filter("def_line is null and def_package is not null").withColumn("fn", F.lit(None).cast("bigint"))
    told = inside.unionByName(outside).select(F.col("path").alias("_path"), F.col("line").alias("name_line"), F.col("col").alias("name_col"), "fn", "def_package")
    where = functions.select(F.col("id").alias("caller"), "file_id").join(files.select(F.col("id").alias("file_id"), F.col("path").alias("_path")), "file_id").drop("file_id")
    d = calls.join(where, "caller").join(told, ["_path", "name_line", "name_col"], "left")
    settled, outside = F.col("fn").isNotNull(), F.col("fn").isNull() & F.col("def_package").isNotNull()
    none = F.array().cast("array<bigint>")
    return d.withColumns({
        "kind": F.when(settled, "internal").when(outside, "external").otherwise(F.col("kind")),
        "callee": F.when(settled, F.col("fn")).when(outside, None).otherwise(F.col("callee")),
        "high": F.col("high") | settled | outside,
        "ambiguous_with": F.when(settled | outside, none).otherwise(F.col("ambiguous_with")),
        "package": F.when(settled, None).when(outside, F.col("def_package")).otherwise(F.col("package")),
    }).select(*calls.columns)


def questions(calls: DataFrame, answers: DataFrame, functions: DataFrame, files: DataFrame, limit: int = 2000) -> DataFrame:
    """Unsure internal calls without a stored answer for their file's content: ambiguous ones first, then call order."""
    where = functions.select(F.col("id").alias("caller"), "file_id").join(files.select(F.col("id").alias("file_id"), "path", "content_hash"), "file_id")
    unsure = calls.filter("kind = 'internal' and not high").join(where, "caller")
    known = answers.select("path", "content_hash", F.col("line").alias("name_line"), F.col("col").alias("name_col"))
    return unsure.join(known, ["path", "content_hash", "name_line", "name_col"], "left_anti").orderBy(F.size("ambiguous_with") == 0, "idx").limit(limit)

"""The driver's tables seen as a code graph, with the same arithmetic in Spark and in SQL.

functions are parts, calls are line items, packages suppliers, routes and links come from pages,
touches from events.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.functions import text as T
from loomgraph.plans.lineage import materialize


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def functions(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "part").select(
        F.col("p_partkey").alias("id"),
        F.col("p_name").alias("name"),
        F.concat_ws("::", "p_brand", "p_name").alias("qualified_name"),
        F.col("p_brand").alias("containing_type"),
        F.col("p_type").alias("language"),
        (F.col("p_partkey") % 50).alias("file_id"),
        F.col("p_size").alias("start_line"),
        (F.col("p_size") % 11 == 0).alias("is_toplevel"),
        (F.col("p_size") % 7 == 0).alias("is_test"),
        (F.col("p_size") % 5 == 0).alias("has_decorations"),
        (F.col("p_size") % 3 == 0).alias("is_exported"),
        F.concat(F.lit("fn "), "p_name").alias("signature"),
    )


FUNCTIONS = """functions AS (SELECT p_partkey AS id, p_name AS name, p_brand || '::' || p_name AS qualified_name, p_brand AS containing_type, p_type AS language,
  p_partkey % 50 AS file_id, p_size AS start_line, p_size % 11 = 0 AS is_toplevel, p_size % 7 = 0 AS is_test, p_size % 5 = 0 AS has_decorations, p_size % 3 = 0 AS is_exported, 'fn ' || p_name AS signature FROM part)"""


def lines(spark: SparkSession, d: str) -> DataFrame:
    """Line items by order and number, which need not be unique in the table: one row each, of smallest values."""
    item = load(spark, d, "lineitem")
    return item.groupBy("l_orderkey", "l_linenumber").agg(*[F.min(c).alias(c) for c in ("l_partkey", "l_suppkey", "l_linestatus", "l_returnflag", "l_quantity")])


LINES = "lines AS (SELECT l_orderkey, l_linenumber, min(l_partkey) AS l_partkey, min(l_suppkey) AS l_suppkey, min(l_linestatus) AS l_linestatus, min(l_returnflag) AS l_returnflag, min(l_quantity) AS l_quantity FROM lineitem GROUP BY ALL)"


def calls(spark: SparkSession, d: str, items: DataFrame | None = None) -> DataFrame:
    """Internal unless the line status is F; external calls name their supplier's package."""
    n = load(spark, d, "part").select(F.count("*").alias("n"))
    item = (load(spark, d, "lineitem") if items is None else items).crossJoin(F.broadcast(n))  # one row
    kind = F.when(F.col("l_linestatus") == "O", "internal").when(F.col("l_linenumber") < 3, "external").otherwise("unresolved")
    return item.select(
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("idx"),
        F.col("l_partkey").alias("caller"),
        ((F.col("l_orderkey") * 31 + F.col("l_suppkey")) % F.col("n")).alias("callee"),
        F.col("l_linenumber").cast("int").alias("line"),
        kind.alias("kind"),
        (F.col("l_returnflag") != "R").alias("high"),
        F.concat(F.lit("pkg"), F.col("l_suppkey").cast("string")).alias("package"),
        "l_linenumber",
    )


CALLS = """calls AS (SELECT l_orderkey * 8 + l_linenumber AS idx, l_partkey AS caller, (l_orderkey * 31 + l_suppkey) % (SELECT count(*) FROM part) AS callee,
  l_linenumber AS line, CASE WHEN l_linestatus = 'O' THEN 'internal' WHEN l_linenumber < 3 THEN 'external' ELSE 'unresolved' END AS kind,
  l_returnflag <> 'R' AS high, 'pkg' || l_suppkey AS package, l_linenumber FROM lineitem)"""


def maybe_calls(spark: SparkSession, d: str, items: DataFrame | None = None) -> DataFrame:
    """Calls with two rivals each where they are not sure."""
    n = load(spark, d, "part").select(F.count("*").alias("n"))
    c = calls(spark, d, items).crossJoin(F.broadcast(n))  # one row
    rivals = F.array((F.col("callee") + 1) % F.col("n"), (F.col("callee") + 5) % F.col("n"))
    return c.withColumn("ambiguous_with", F.when(F.col("high"), F.array().cast("array<bigint>")).otherwise(rivals)).drop("n")


# ---- a tree with files, imports and types, for resolution

LANGUAGES = ["python", "java", "go", "rust"]
FILES = """files AS (SELECT range AS id, 'd' || (range % 7) || '/f' || range || '.x' AS path, 'd' || (range % 7) AS dir, ['python', 'java', 'go', 'rust'][range % 4 + 1] AS language,
  CASE WHEN range % 3 > 0 THEN 'p' || (range % 5) END AS package FROM range(50))"""
METHODS = """methods AS (SELECT p_partkey AS id, p_name || ' ' || (p_partkey % 13) AS name, p_partkey % 50 AS file_id, ['python', 'java', 'go', 'rust'][p_partkey % 50 % 4 + 1] AS language,
  CASE WHEN p_size % 2 = 0 THEN p_brand END AS containing_type, p_size % 11 = 0 AS is_toplevel, p_size AS start_line, p_size + p_partkey % 9 AS end_line, p_brand FROM part)"""
SITES = f"""{LINES}, {CALLS.replace('FROM lineitem', 'FROM lines')}, sites AS (SELECT idx, caller, CASE l_linenumber WHEN 6 THEN 'imp' || (callee % 4) ELSE coalesce(m.name, 'none') END AS name, CASE l_linenumber WHEN 2 THEN 'this' WHEN 3 THEN coalesce(m.p_brand, 'None')
  WHEN 4 THEN 'm' || (callee % 4) WHEN 5 THEN CASE WHEN callee % 2 = 0 THEN 'sys' ELSE 'v' END WHEN 7 THEN 'self.dep' END AS receiver, line FROM calls LEFT JOIN methods m ON m.id = callee)"""
IMPORTS = """imports AS (SELECT id AS file_id, 0 AS ord, 'm0' AS bound, (id * 3 + 1) % 50 AS resolved_file, NULL AS external_package FROM files
  UNION ALL SELECT id, 0, 'm1', (id * 3 + 1) % 50, NULL FROM files UNION ALL SELECT id, 1, 'm2', NULL, 'pkg' || (id % 6) FROM files
  UNION ALL SELECT id, 2, 'imp0', NULL, 'ext' || (id % 6) FROM files UNION ALL SELECT files.id, 3, m.name, (files.id + 25) % 50, NULL FROM files JOIN methods m ON m.id = (files.id + 25) % 50)"""


def files(spark: SparkSession, n: int = 50) -> DataFrame:
    i = F.col("id")
    text = lambda p, x: F.concat(F.lit(p), x.cast("string"))
    return spark.range(n).select(
        "id",
        F.concat(text("d", i % 7), text("/f", i), F.lit(".x")).alias("path"),
        F.element_at(F.array(*map(F.lit, LANGUAGES)), (i % 4 + 1).cast("int")).alias("language"),
        F.when(i % 3 > 0, text("p", i % 5)).alias("package"),
    )


def methods(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    return load(spark, d, "part").select(
        k.alias("id"),
        F.concat_ws(" ", "p_name", (k % 13).cast("string")).alias("name"),
        (k % 50).alias("file_id"),
        F.element_at(F.array(*map(F.lit, LANGUAGES)), (k % 50 % 4 + 1).cast("int")).alias("language"),
        F.when(F.col("p_size") % 2 == 0, F.col("p_brand")).alias("containing_type"),
        (F.col("p_size") % 11 == 0).alias("is_toplevel"),
        F.col("p_size").alias("start_line"),
        (F.col("p_size") + k % 9).alias("end_line"),
        "p_brand",
    )


def sites(spark: SparkSession, d: str) -> DataFrame:
    """All order lines as call sites, with a name and, by line number, one of the kinds of receiver."""
    c = calls(spark, d, lines(spark, d)).join(methods(spark, d).select(F.col("id").alias("callee"), "name", "p_brand"), "callee", "left")
    n, text = F.col("l_linenumber"), lambda p: F.concat(F.lit(p), (F.col("callee") % 4).cast("string"))
    receiver = F.when(n == 2, "this").when(n == 3, F.coalesce("p_brand", F.lit("None"))).when(n == 4, text("m")).when(n == 5, F.when(F.col("callee") % 2 == 0, "sys").otherwise("v")).when(n == 7, "self.dep")
    return c.select("idx", "caller", F.when(n == 6, text("imp")).otherwise(F.coalesce("name", F.lit("none"))).alias("name"), receiver.alias("receiver"), "line")


def imports(spark: SparkSession, d: str) -> DataFrame:
    f, i = files(spark), F.col("id")
    none = F.lit(None).cast("string")
    own = f.select(i.alias("file_id"), F.lit(0).alias("ord"), F.array(F.lit("m0"), F.lit("m1")).alias("names"), ((i * 3 + 1) % 50).alias("resolved_file"), none.alias("external_package"))
    out = lambda ord_, name, p: f.select(i.alias("file_id"), F.lit(ord_), F.array(F.lit(name)), F.lit(None).cast("bigint"), F.concat(F.lit(p), (i % 6).cast("string")))
    named = f.withColumn("at", (i + 25) % 50).join(methods(spark, d).select(F.col("id").alias("at"), "name"), "at").select(i.alias("file_id"), F.lit(3), F.array("name"), "at", none)
    return own.union(out(1, "m2", "pkg")).union(out(2, "imp0", "ext")).union(named)


def endpoints(spark: SparkSession, d: str) -> DataFrame:
    """One route per page, by id; its method follows from the id."""
    p = load(spark, d, "pages")
    method = F.when(F.col("page_id") % 5 == 0, "ANY").when(F.col("page_id") % 2 == 0, "GET").otherwise("POST")
    path = F.when(F.col("page_id") % 7 == 0, F.regexp_replace("url", r"[0-9]+$", "{id}")).otherwise(F.col("url"))
    return p.select(F.col("page_id").alias("id"), F.lit("http").alias("kind"), method.alias("method"), path.alias("path_raw"), T.normalize_path(path).alias("path_norm"), (F.col("page_id") % 3 != 0).alias("high"), F.lit("web").alias("framework"))


def clients(spark: SparkSession, d: str) -> DataFrame:
    """One call per link of a page, and one per page to its own address below another root."""
    p = load(spark, d, "pages")
    links = p.select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit(r'href="([^"]*)"'), F.lit(1))).alias("i", "url"))
    own = p.select("page_id", F.lit(-1).alias("i"), F.concat(F.lit("/v1"), F.regexp_extract("url", r"://[^/]*(/.*)$", 1)).alias("url"))
    both = links.unionByName(own).withColumn("id", F.col("page_id") * 1000 + F.col("i") + 1)
    return both.select("id", F.lit("http").alias("kind"), F.when(F.col("id") % 2 == 0, "GET").otherwise("POST").alias("method"), F.col("url").alias("url_raw"), T.normalize_path(F.col("url")).alias("path_norm"), (F.col("id") % 4 != 0).alias("high")).filter("path_norm is not null")


def _norm(s: str) -> str:
    p = f"CASE WHEN instr(trim({s}), '://') > 0 THEN coalesce(nullif(regexp_extract(trim({s}), '://[^/]*(/.*)?$', 1, 's'), ''), '/') ELSE trim({s}) END"
    cut = f"CASE WHEN regexp_matches({p}, '^[^?#]*#\\{{') THEN {p} ELSE regexp_replace({p}, '[?#].*$', '', 's') END"
    seg = f"list_filter(string_split({cut}, '/'), lambda x: x <> '')"
    fold = f"list_transform({seg}, lambda x: CASE WHEN regexp_matches(x, '^[:<*$]') OR contains(x, '{{') THEN '{{*}}' ELSE translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') END)"
    return f"CASE WHEN trim({s}) = '' THEN NULL ELSE '/' || array_to_string({fold}, '/') END"


NORMALIZE = _norm
ENDPOINTS = f"""routes AS (SELECT page_id AS id, CASE WHEN page_id % 5 = 0 THEN 'ANY' WHEN page_id % 2 = 0 THEN 'GET' ELSE 'POST' END AS method,
  CASE WHEN page_id % 7 = 0 THEN regexp_replace(url, '[0-9]+$', '{{id}}') ELSE url END AS path_raw, page_id % 3 <> 0 AS high FROM pages),
endpoints AS (SELECT *, {_norm('path_raw')} AS path_norm FROM routes)"""
CLIENTS = f"""links AS (SELECT page_id, unnest(range(len(l))) AS i, unnest(l) AS url FROM (SELECT page_id, regexp_extract_all(html, 'href="([^"]*)"', 1) AS l FROM pages)),
urls AS (SELECT page_id * 1000 + i + 1 AS id, url FROM links UNION ALL SELECT page_id * 1000, '/v1' || regexp_extract(url, '://[^/]*(/.*)$', 1) FROM pages),
clients AS (SELECT * FROM (SELECT id, CASE WHEN id % 2 = 0 THEN 'GET' ELSE 'POST' END AS method, url AS url_raw, {_norm('url')} AS path_norm, id % 4 <> 0 AS high FROM urls) WHERE path_norm IS NOT NULL)"""
UNIFY = "len(list_filter(list_zip({a}, {b}), lambda z: z[1] <> z[2] AND z[1] <> '{{*}}' AND z[2] <> '{{*}}')) = 0"
SEGS = "list_filter(string_split({p}, '/'), lambda x: x <> '')"


def bags(spark: SparkSession, d: str) -> DataFrame:
    """Words of documents as feature bags, written once for the several passes over them."""
    words = load(spark, d, "documents").select(F.col("doc_id").alias("fn_id"), F.explode(F.filter(F.split(F.lower("text"), r"[^\p{L}]+"), lambda w: w != "")).alias("feature"))
    return materialize(words.groupBy("fn_id", "feature").agg(F.count("*").alias("tf")))


BAGS = r"""bags AS (SELECT fn_id, feature, count(*) AS tf FROM (SELECT doc_id AS fn_id, unnest(list_filter(regexp_split_to_array(lower(text), '[^\p{L}]+'), lambda w: w <> '')) AS feature FROM documents) GROUP BY ALL)"""

"""Named queries over the driver's tables, each with its SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.functions import text as T
from loomgraph.operators import correlate as C
from loomgraph.operators import graph as G
from loomgraph.operators import inventory, resolve, spans, touches, traverse
from loomgraph.operators import vectors as V
from loomgraph.plans import adapters as A
from loomgraph.plans.lineage import materialize, release
from loomgraph.sources import scan

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
SEEDS = (0, 1, 2)
DEPTH = 3


def query(sql: str | None = None):
    """Registers a query under its function's name."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


_SPLIT = r"list_filter(regexp_split_to_array(lower(regexp_replace(regexp_replace(regexp_replace(regexp_replace({s}, '(\p{{Lu}}+)(\p{{Lu}}\p{{Ll}})', '\1 \2', 'g'), '(\p{{Ll}})(\p{{Lu}})', '\1 \2', 'g'), '(\p{{L}})(\p{{N}})', '\1 \2', 'g'), '(\p{{N}})(\p{{L}})', '\1 \2', 'g')), '[^\p{{L}}\p{{N}}]+'), lambda w: w <> '')"


@query(f"""WITH {A.FUNCTIONS}, s AS (SELECT id, name, CASE WHEN lower(name) = 'al' THEN 100 WHEN starts_with(lower(name), 'al') THEN 80 WHEN contains(lower(name), 'al') THEN 60
  WHEN contains(lower(qualified_name), 'al') THEN 40 WHEN regexp_matches(lower(name), 'a.*l') THEN 20 END - CASE WHEN is_toplevel THEN 15 ELSE 0 END AS score FROM functions)
SELECT id, name, CAST(score AS INTEGER) AS score FROM s WHERE score IS NOT NULL""")
def search_functions(spark: SparkSession, d: str) -> DataFrame:
    """Every match, so that all tiers of the score are compared."""
    f = A.functions(spark, d)
    return G.search_functions(f, "al", f.count()).select("id", "name", "score")


@query(f"""WITH n AS (SELECT DISTINCT p_name AS name FROM part UNION SELECT DISTINCT p_brand || 'Get' || p_type FROM part UNION SELECT DISTINCT 'getHTTP' || p_name || 'URL2x' FROM part)
SELECT name, array_to_string({_SPLIT.format(s='name')}, ' ') AS words FROM n""")
def subword_split(spark: SparkSession, d: str) -> DataFrame:
    p = A.load(spark, d, "part")
    n = p.select(F.col("p_name").alias("name")).union(p.select(F.concat("p_brand", F.lit("Get"), "p_type"))).union(p.select(F.concat(F.lit("getHTTP"), "p_name", F.lit("URL2x")))).distinct()
    return n.select("name", F.array_join(T.split_words(F.col("name")), " ").alias("words"))


_NAMES = "fetchUser save_order HTTPServer deleteAll peekTop evict2 isOpen signalDone unpackRow pack_row bumpVersion seedData signIn tallyVotes haltNow dedupeRows wrapText debounceInput paintCell fuzzCase hmacSha assemble divideUp zebra"


@query(f"""WITH w AS (SELECT {_SPLIT.format(s=f"string_split('{_NAMES}', ' ')[event_id % 24 + 1] || '_' || event_type")} AS ws FROM events)
SELECT CASE WHEN ws[1] IN ('fetch', 'peek') THEN 'READ' WHEN ws[1] = 'save' THEN 'WRITE' WHEN ws[1] IN ('delete', 'evict') THEN 'DELETE' WHEN ws[1] = 'is' THEN 'CHECK' WHEN ws[1] = 'signal' THEN 'EMIT'
  WHEN ws[1] = 'unpack' THEN 'PARSE' WHEN ws[1] = 'pack' THEN 'FORMAT' WHEN ws[1] = 'bump' THEN 'UPDATE' WHEN ws[1] = 'seed' THEN 'INIT' WHEN ws[1] = 'sign' THEN 'CRYPTO' WHEN ws[1] = 'tally' THEN 'COMPUTE'
  WHEN ws[1] = 'halt' THEN 'CLOSE' WHEN ws[1] = 'dedupe' THEN 'FILTER' WHEN ws[1] = 'wrap' THEN 'TRANSFORM' WHEN ws[1] = 'debounce' THEN 'WAIT' WHEN ws[1] = 'paint' THEN 'SHOW' WHEN ws[1] = 'fuzz' THEN 'TEST'
  WHEN ws[1] = 'hmac' THEN 'CRYPTO' WHEN ws[1] = 'assemble' THEN 'BUILD' WHEN ws[1] = 'divide' THEN 'SPLIT' ELSE 'none' END AS bucket, count(*) AS n FROM w GROUP BY 1""")
def verb_buckets(spark: SparkSession, d: str) -> DataFrame:
    name = F.concat_ws("_", F.element_at(F.split(F.lit(_NAMES), " "), (F.col("event_id") % 24 + 1).cast("int")), "event_type")
    e = A.load(spark, d, "events").select(T.bucket_for_name(name).alias("b"))
    return e.groupBy(F.coalesce("b", F.lit("none")).alias("bucket")).agg(F.count("*").alias("n"))


@query(f"""WITH {A.CALLS}, t AS (SELECT count(*) AS n FROM part), c AS (SELECT *, CASE WHEN callee = 7 THEN 0 WHEN NOT high AND (callee + 1) % n = 7 OR NOT high AND (callee + 5) % n = 7 THEN 1 END AS rank FROM calls, t WHERE kind = 'internal')
SELECT idx, caller, callee, line FROM c WHERE rank IS NOT NULL ORDER BY rank, idx LIMIT 50""")
def get_callers(spark: SparkSession, d: str) -> DataFrame:
    return G.callers(A.maybe_calls(spark, d), 7).select("idx", "caller", "callee", "line")


@query(f"WITH {A.CALLS} SELECT idx, callee, line, kind FROM calls WHERE caller = 7 ORDER BY idx LIMIT 100")
def get_callees(spark: SparkSession, d: str) -> DataFrame:
    return G.callees(A.calls(spark, d), 7).select("idx", "callee", "line", "kind")


@query(f"WITH {A.CALLS} SELECT package, count(*) AS calls, count(DISTINCT caller) AS callers FROM calls WHERE kind = 'external' GROUP BY package ORDER BY calls DESC, package LIMIT 100")
def list_packages(spark: SparkSession, d: str) -> DataFrame:
    return G.list_packages(A.calls(spark, d))


@query(f"WITH {A.CALLS} SELECT kind, count(*) AS n, count(*) FILTER (high AND kind = 'internal') AS sure FROM calls GROUP BY kind")
def resolution_stats(spark: SparkSession, d: str) -> DataFrame:
    return G.resolution_stats(A.calls(spark, d))


@query(f"WITH {A.FUNCTIONS} SELECT language, count(*) AS n FROM functions GROUP BY language")
def functions_by_language(spark: SparkSession, d: str) -> DataFrame:
    return G.functions_by_language(A.functions(spark, d))


@query(f"SELECT page_id, {A.NORMALIZE('url')} AS path FROM pages")
def normalize_paths(spark: SparkSession, d: str) -> DataFrame:
    return A.load(spark, d, "pages").select("page_id", T.normalize_path(F.col("url")).alias("path"))


@query(f"WITH {A.ENDPOINTS} SELECT id, method, path_norm FROM endpoints WHERE method = 'GET' AND (contains(path_norm, 'en') OR contains(lower(path_raw), 'en')) ORDER BY id LIMIT 100")
def list_endpoints(spark: SparkSession, d: str) -> DataFrame:
    return C.list_endpoints(A.endpoints(spark, d), method="get", path="en").select("id", "method", "path_norm")


_EXACT = f"""pairs AS (SELECT c.id AS client_id, e.id AS endpoint_id, c.method <> 'ANY' AND e.method <> 'ANY' AND c.high AND e.high AS ok
  FROM (SELECT *, {A.SEGS.format(p='path_norm')} AS s FROM clients) c JOIN (SELECT *, {A.SEGS.format(p='path_norm')} AS s FROM endpoints) e
  ON len(c.s) = len(e.s) AND {A.UNIFY.format(a='c.s', b='e.s')} AND (c.method = e.method OR c.method = 'ANY' OR e.method = 'ANY')),
matches AS (SELECT client_id, endpoint_id, ok AND count(*) OVER (PARTITION BY client_id) = 1 AS high FROM pairs)"""


@query(f"WITH {A.ENDPOINTS}, {A.CLIENTS}, {_EXACT} SELECT client_id, endpoint_id, high FROM matches")
def correlate_exact(spark: SparkSession, d: str) -> DataFrame:
    return C.correlate_exact(A.clients(spark, d), A.endpoints(spark, d))


@query(f"""WITH {A.ENDPOINTS}, {A.CLIENTS}, {_EXACT}, rest AS (SELECT *, {A.SEGS.format(p='path_norm')} AS s FROM clients WHERE id NOT IN (SELECT client_id FROM matches)),
tails AS (SELECT id, method, strip, s[strip + 1:] AS s FROM (SELECT *, unnest(range(1, len(s))) AS strip FROM rest)),
e AS (SELECT *, {A.SEGS.format(p='path_norm')} AS s FROM endpoints)
SELECT t.id AS client_id, e.id AS endpoint_id, false AS high FROM tails t JOIN e ON len(t.s) = len(e.s) AND {A.UNIFY.format(a='t.s', b='e.s')} AND (t.method = e.method OR e.method = 'ANY')
WHERE len(list_filter(e.s, lambda x: x <> '{{*}}')) >= 2 QUALIFY strip = min(strip) OVER (PARTITION BY t.id)""")
def correlate_suffix(spark: SparkSession, d: str) -> DataFrame:
    c, e = A.clients(spark, d), A.endpoints(spark, d)
    return C.correlate_suffix(c, e, C.correlate_exact(c, e))


@query("""WITH e AS (SELECT min(event_id) AS id, event_type AS op, user_id FROM events GROUP BY event_type, user_id),
c AS (SELECT event_id AS id, event_type AS op, user_id, event_id % 3 <> 0 AS high FROM events)
SELECT c.id AS client_id, e.id AS endpoint_id, c.high AND count(*) OVER (PARTITION BY c.id) = 1 AS high FROM c JOIN e ON c.op || '/' || c.user_id = e.op || '/' || e.user_id""")
def correlate_rpc(spark: SparkSession, d: str) -> DataFrame:
    """All events as clients of one procedure per type and user."""
    ev = A.load(spark, d, "events").withColumn("path_norm", F.concat_ws("/", "event_type", F.col("user_id").cast("string")))
    e = ev.groupBy("path_norm").agg(F.min("event_id").alias("id")).select("id", F.lit("rpc").alias("kind"), "path_norm", F.lit(True).alias("high"))
    return C.correlate_rpc(ev.select(F.col("event_id").alias("id"), F.lit("rpc").alias("kind"), "path_norm", (F.col("event_id") % 3 != 0).alias("high")), e)


@query(f"WITH {A.ENDPOINTS}, {A.CLIENTS}, {_EXACT} SELECT id, path_norm FROM endpoints WHERE id NOT IN (SELECT endpoint_id FROM matches)")
def unreferenced_endpoints(spark: SparkSession, d: str) -> DataFrame:
    e = A.endpoints(spark, d)
    return C.unreferenced_endpoints(e, C.correlate_exact(A.clients(spark, d), e)).select("id", "path_norm")


@query(f"WITH {A.ENDPOINTS}, {A.CLIENTS}, {_EXACT} SELECT id, path_norm FROM clients WHERE id NOT IN (SELECT client_id FROM matches)")
def client_unmatched(spark: SparkSession, d: str) -> DataFrame:
    c = A.clients(spark, d)
    return C.client_calls(c, C.correlate_exact(c, A.endpoints(spark, d)), unmatched=True).select("id", "path_norm")


@query(f"""WITH {A.ENDPOINTS}, {A.CLIENTS}, {_EXACT}, e AS (SELECT *, {A.SEGS.format(p='path_norm')} AS s FROM endpoints)
SELECT e.id, e.path_norm, m.client_id, m.high AS match_high FROM e LEFT JOIN matches m ON m.endpoint_id = e.id
WHERE len(s) = 2 AND (s[1] = 'en' OR s[1] = '{{*}}')""")
def find_endpoint_callers(spark: SparkSession, d: str) -> DataFrame:
    e = A.endpoints(spark, d)
    m = C.correlate_exact(A.clients(spark, d), e)
    return C.find_endpoint_callers(e, m, "/en/:page").select("id", "path_norm", "client_id", "match_high")


def _rung(number: int, source: str, few: str, on: str, high: str = "true") -> str:
    """Candidates of one rung in SQL: ``source`` joined with the ids of ``few``."""
    return f"SELECT x.idx, {number} AS rung, 'internal' AS kind, CAST(NULL AS VARCHAR) AS package, k.ids, {high} AS high FROM {source} x JOIN {few} k ON {on}"


def _few(name: str, scope: str, source: str = "f") -> str:
    by = f"name, {scope}" if scope else "name"
    return f"{name} AS (SELECT {by}, (list(id ORDER BY id))[1:9] AS ids, count(*) AS n FROM {source} GROUP BY {by})"


_LADDER = f"""WITH {A.FILES}, {A.METHODS}, {A.SITES}, {A.IMPORTS},
f AS (SELECT m.id, m.name, m.containing_type, m.file_id, m.language, files.package, files.dir FROM methods m JOIN files ON files.id = m.file_id WHERE NOT m.is_toplevel),
t AS (SELECT * FROM f WHERE containing_type IS NOT NULL), fp AS (SELECT * FROM f WHERE package IS NOT NULL),
c AS (SELECT s.idx, s.name, s.receiver, m.id AS caller, m.file_id, m.language, m.containing_type AS own_type, files.package, files.dir FROM sites s JOIN methods m ON m.id = s.caller JOIN files ON files.id = m.file_id),
{_few('by_type', 'containing_type', 't')}, {_few('by_own', 'containing_type, file_id', 't')}, {_few('by_file', 'file_id')}, {_few('by_package', 'package', 'fp')}, {_few('by_dir', 'dir, language')}, {_few('by_language', 'language')}, {_few('by_name', '')},
typed AS (SELECT p_brand AS owner, min(p_type) AS x, 'Brand#' || (count(*) % 25 + 1) AS type_name FROM part GROUP BY p_brand HAVING count(*) % 5 > 0),
want AS (SELECT c.idx, c.name, l.p_brand AS type_name FROM c JOIN methods l ON l.id = (c.caller * 7) % (SELECT count(*) FROM part) WHERE receiver = 'v'
  UNION ALL SELECT idx, name, type_name FROM c JOIN typed ON owner = own_type WHERE receiver = 'self.dep'),
steps AS (SELECT * FROM want UNION ALL SELECT idx, name, 'Brand#' || (CAST(substr(type_name, 7) AS BIGINT) % 25 + 1) FROM want WHERE CAST(substr(type_name, 7) AS BIGINT) % 3 = 0),
r0 AS (SELECT s.idx, list_sort(list_distinct(flatten(list(ids))))[1:9] AS ids FROM steps s JOIN by_type k ON k.name = s.name AND k.containing_type = s.type_name GROUP BY s.idx),
bound AS (SELECT c.*, i.resolved_file, i.external_package FROM c JOIN imports i ON i.file_id = c.file_id AND i.bound = c.receiver QUALIFY row_number() OVER (PARTITION BY c.idx ORDER BY ord) = 1),
named AS (SELECT c.*, i.resolved_file, i.external_package FROM c JOIN imports i ON i.file_id = c.file_id AND i.bound = c.name),
own AS (SELECT * FROM c WHERE receiver = 'this' AND own_type IS NOT NULL),
here AS (SELECT x.idx, k.ids FROM own x JOIN by_own k ON k.name = x.name AND k.containing_type = x.own_type AND k.file_id = x.file_id),
r AS (SELECT idx, 0 AS rung, 'internal' AS kind, CAST(NULL AS VARCHAR) AS package, ids, len(ids) = 1 AS high FROM r0
UNION ALL SELECT idx, 1, 'internal', NULL, ids, true FROM here
UNION ALL {_rung(1, '(SELECT * FROM own WHERE idx NOT IN (SELECT idx FROM here))', 'by_type', 'k.name = x.name AND k.containing_type = x.own_type')}
UNION ALL SELECT idx, 2, 'external', 'builtin:sys', NULL, true FROM c WHERE receiver = 'sys' AND language IN ('python', 'java')
UNION ALL SELECT idx, 3, 'external', external_package, NULL, true FROM bound WHERE external_package IS NOT NULL
UNION ALL {_rung(3, 'bound', 'by_file', 'k.name = x.name AND k.file_id = x.resolved_file')}
UNION ALL {_rung(4, 'c', 'by_type', "regexp_matches(x.receiver, '^[A-Z]') AND k.name = x.name AND k.containing_type = x.receiver")}
UNION ALL {_rung(5, 'c', 'by_file', 'k.name = x.name AND k.file_id = x.file_id')}
UNION ALL {_rung(6, 'named', 'by_file', 'k.name = x.name AND k.file_id = x.resolved_file')}
UNION ALL {_rung(7, 'c', 'by_package', 'k.name = x.name AND k.package = x.package')}
UNION ALL {_rung(8, 'c', 'by_dir', 'k.name = x.name AND k.dir = x.dir AND k.language = x.language', 'false')}
UNION ALL {_rung(9, 'c', 'by_language', 'k.name = x.name AND k.language = x.language', 'k.n = 1')}
UNION ALL {_rung(9, '(SELECT * FROM c WHERE NOT EXISTS (SELECT 1 FROM by_language b WHERE b.name = c.name AND b.language = c.language))', 'by_name', 'k.name = x.name', 'k.n = 1')}
UNION ALL SELECT idx, 10, 'external', external_package, NULL, true FROM named WHERE external_package IS NOT NULL),
best AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY idx ORDER BY rung) = 1)
SELECT s.idx, coalesce(kind, 'unresolved') AS kind, ids[1] AS callee, coalesce(high, false) AS high, coalesce(array_to_string(ids[2:9], ','), '') AS rivals, package, rung FROM sites s LEFT JOIN best USING (idx)"""


@query(_LADDER)
def resolve_ladder(spark: SparkSession, d: str) -> DataFrame:
    """All order lines as call sites through all rungs of the ladder."""
    part, m = A.load(spark, d, "part"), A.methods(spark, d)
    n = part.count()
    brand = lambda x: F.concat(F.lit("Brand#"), x.cast("string"))
    locals_ = m.select(F.col("id").alias("fn_id"), ((F.col("id") * 7) % n).alias("at")).join(m.select(F.col("id").alias("at"), F.col("p_brand").alias("type")), "at").select("fn_id", F.lit("v").alias("name"), "type")
    # A field of one type; owners whose number of parts five divides have a second and thus none.
    count = part.groupBy(F.col("p_brand").alias("owner")).agg(F.count("*").alias("k"))
    fields = count.select("owner", F.lit("dep").alias("name"), F.explode(F.when(F.col("k") % 5 > 0, F.array(brand(F.col("k") % 25 + 1))).otherwise(F.array(F.lit("A"), F.lit("B")))).alias("type_name"))
    i = F.col("id") + 1
    bindings = spark.range(25).filter((F.col("id") + 1) % 3 == 0).select(brand(i).alias("base"), brand(i % 25 + 1).alias("derived"))
    out = resolve.resolve_calls(A.sites(spark, d), m, A.imports(spark, d), A.files(spark), locals_, fields, bindings, {"python": ["sys"], "java": ["sys"]})
    return out.select("idx", "kind", "callee", "high", F.array_join("ambiguous_with", ",").alias("rivals"), "package", "rung")


@query("SELECT o_custkey AS owner, o_orderstatus AS name, min(o_orderpriority) AS type_name FROM orders GROUP BY 1, 2 HAVING count(DISTINCT o_orderpriority) = 1")
def field_types(spark: SparkSession, d: str) -> DataFrame:
    o = A.load(spark, d, "orders").select(F.col("o_custkey").alias("owner"), F.col("o_orderstatus").alias("name"), F.col("o_orderpriority").alias("type_name"))
    return G.field_types(o)


@query("""WITH s AS (SELECT conv_id, min(turn) AS a, max(turn) AS b, conv_id % 4 AS width FROM conversations GROUP BY conv_id),
sp AS (SELECT conv_id, a + i AS "start", least(b, a + i + 1 + width) AS "end", conv_id * 100 + i AS id FROM (SELECT *, unnest(range(0, b - a + 1)) AS i FROM s))
SELECT c.conv_id, c.turn, sp.id AS span_id FROM conversations c LEFT JOIN sp ON sp.conv_id = c.conv_id AND sp."start" <= c.turn AND c.turn <= sp."end"
QUALIFY row_number() OVER (PARTITION BY c.conv_id, c.turn ORDER BY sp."end" - sp."start", sp.id) = 1""")
def innermost_span(spark: SparkSession, d: str) -> DataFrame:
    c = A.load(spark, d, "conversations")
    s = c.groupBy("conv_id").agg(F.min("turn").alias("a"), F.max("turn").alias("b"))
    s = s.withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("b") - F.col("a"))))
    s = s.select("conv_id", (F.col("a") + F.col("i")).alias("start"), F.least("b", F.col("a") + F.col("i") + 1 + F.col("conv_id") % 4).alias("end"), (F.col("conv_id") * 100 + F.col("i")).alias("id"))
    return spans.innermost(c.select("conv_id", "turn"), s, ["conv_id"], "turn", "turn", block=8).dropDuplicates(["conv_id", "turn"]).select("conv_id", "turn", "span_id")


@query("""SELECT n.n_name AS type_name, c_custkey AS method, 0 AS hop FROM nation n JOIN customer ON c_nationkey = n_nationkey UNION
SELECT r_name, c_custkey, 1 FROM region JOIN nation ON n_regionkey = r_regionkey JOIN customer ON c_nationkey = n_nationkey""")
def type_expansion(spark: SparkSession, d: str) -> DataFrame:
    n, r, c = (A.load(spark, d, t) for t in ("nation", "region", "customer"))
    types = n.select(F.col("n_name").alias("type_name")).union(r.select("r_name"))
    methods = c.join(F.broadcast(n), c.c_nationkey == n.n_nationkey).select(F.col("c_custkey").alias("id"), F.col("n_name").alias("containing_type"))
    bindings = n.join(r, n.n_regionkey == r.r_regionkey).select(F.col("r_name").alias("base"), F.col("n_name").alias("derived"))
    return G.type_expansion(types, methods, bindings)


_DEAD = f"""WITH {A.FUNCTIONS}, named AS (SELECT * REPLACE (CASE id % 12 WHEN 0 THEN 'test_' || id WHEN 1 THEN 'onX' || id WHEN 2 THEN '__' || id || '__' WHEN 3 THEN 'Java_' || id ELSE name || ' ' || id END AS name) FROM functions),
alive AS (SELECT name FROM named WHERE id IN (SELECT (l_suppkey * 7 + l_linenumber) % (SELECT count(*) FROM part) FROM lineitem) OR id IN (SELECT user_id FROM events)),
handlers AS (SELECT p_partkey AS id FROM part WHERE p_size = 13),
u AS (SELECT *, CASE WHEN has_decorations THEN 'decorated' WHEN id IN (SELECT id FROM handlers) THEN 'endpoint_handler' WHEN name = 'main' THEN 'main' WHEN regexp_matches(name, '^__.+__$') THEN 'dunder' WHEN starts_with(name, 'Java_') THEN 'jni_export'
  WHEN regexp_matches(name, '^(on|handle)[\\p{{Lu}}_]') THEN 'callback_convention'
  WHEN starts_with(name, 'test_') OR starts_with(name, 'Test') OR ends_with(name, '_test') THEN 'test_convention' END AS reason FROM named WHERE NOT is_toplevel AND name NOT IN (SELECT name FROM alive))"""


def _dead(spark: SparkSession, d: str) -> DataFrame:
    """What no line item calls and no event names."""
    f = A.functions(spark, d)
    k = F.col("id").cast("string")
    name = F.when(F.col("id") % 12 == 0, F.concat(F.lit("test_"), k)).when(F.col("id") % 12 == 1, F.concat(F.lit("onX"), k)).when(F.col("id") % 12 == 2, F.concat(F.lit("__"), k, F.lit("__")))
    f = f.withColumn("name", name.when(F.col("id") % 12 == 3, F.concat(F.lit("Java_"), k)).otherwise(F.concat_ws(" ", "name", k)))
    called = A.load(spark, d, "lineitem").select(((F.col("l_suppkey") * 7 + F.col("l_linenumber")) % f.count()).alias("id")).distinct()
    used, mentioned = (x.join(f.select("id", "name"), "id").select("name") for x in (called, A.load(spark, d, "events").select(F.col("user_id").alias("id")).distinct()))
    handlers = A.load(spark, d, "part").filter("p_size = 13").select(F.col("p_partkey").alias("handler"))
    return G.unreferenced_functions(f, used, mentioned, handlers)


@query(_DEAD + " SELECT id, name, reason, CASE WHEN reason IS NOT NULL THEN 'excluded' WHEN is_exported THEN 'public' ELSE 'strong' END AS class FROM u")
def dead_code(spark: SparkSession, d: str) -> DataFrame:
    return _dead(spark, d).select("id", "name", "reason", "class")


@query(_DEAD + " SELECT reason, count(*) AS n FROM u WHERE reason IS NOT NULL GROUP BY reason")
def dead_code_reasons(spark: SparkSession, d: str) -> DataFrame:
    return G.excluded_counts(_dead(spark, d))


@query(f"WITH {A.BAGS} SELECT feature, count(*) AS df FROM bags GROUP BY feature HAVING count(*) >= 2")
def doc_frequency(spark: SparkSession, d: str) -> DataFrame:
    return V.doc_frequency(A.bags(spark, d))


_WEIGHTS = f"""{A.BAGS}, df AS (SELECT feature, count(*) AS df FROM bags GROUP BY feature HAVING count(*) >= 2), n AS (SELECT count(DISTINCT fn_id) AS n FROM bags),
weights AS (SELECT fn_id, feature, (1 + ln(tf)) * (ln((n + 1.0) / (coalesce(df, 1) + 1.0)) + 1) AS weight FROM bags LEFT JOIN df USING (feature), n)"""


@query(f"WITH {_WEIGHTS} SELECT fn_id, feature, round(weight, 6) AS weight FROM weights")
def tfidf_weights(spark: SparkSession, d: str) -> DataFrame:
    b = A.bags(spark, d)
    n = b.select("fn_id").distinct().count()
    return V.tfidf(b, V.doc_frequency(b), n).withColumn("weight", F.round("weight", 6))


@query(f"""WITH {_WEIGHTS}, h AS (SELECT fn_id, weight, CAST(('0x' || substr(md5(feature), 1, 8)) AS BIGINT) AS h FROM weights),
s AS (SELECT fn_id, h % 256 AS dim, sum(CASE WHEN h >= 2147483648 THEN -weight ELSE weight END) AS v FROM h GROUP BY 1, 2)
SELECT fn_id, dim, round(v / sqrt(sum(v * v) OVER (PARTITION BY fn_id)), 6) AS value FROM s""")
def hashed_vectors(spark: SparkSession, d: str) -> DataFrame:
    b = A.bags(spark, d)
    n = b.select("fn_id").distinct().count()
    return V.hashed_vectors(V.tfidf(b, V.doc_frequency(b), n), portable=True).withColumn("value", F.round("value", 6) + 0.0)


_UNIT = "SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings"


@query(f"""WITH v AS ({_UNIT}), q AS (SELECT v AS q FROM v WHERE vec_id = 0)
SELECT vec_id, round(list_inner_product(v, q), 6) AS score FROM v, q WHERE vec_id <> 0 AND list_inner_product(v, q) > 0 ORDER BY list_inner_product(v, q) DESC, vec_id LIMIT 10""")
def similar_topk(spark: SparkSession, d: str) -> DataFrame:
    e = A.load(spark, d, "embeddings")
    q = e.filter("vec_id = 0").select("embedding").first()[0]
    return V.top_k(e, q, 10, exclude=0, key="vec_id", column="embedding").withColumn("score", F.round("score", 6))


@query(f"""WITH v AS ({_UNIT}), h AS (SELECT vec_id, v[1:48] AS a, v[49:64] AS b FROM v),
n AS (SELECT vec_id, list_transform(a, lambda x: x / sqrt(list_inner_product(a, a))) AS a, list_transform(b, lambda x: x / sqrt(list_inner_product(b, b))) AS b FROM h),
q AS (SELECT a AS qa, b AS qb FROM n WHERE vec_id = 0), s AS (SELECT vec_id, 0.6 * list_inner_product(a, qa) + 0.4 * list_inner_product(b, qb) AS score FROM n, q WHERE vec_id <> 0)
SELECT vec_id AS fn_id, round(score, 6) AS score FROM s WHERE score > 0 ORDER BY s.score DESC, vec_id LIMIT 10""")
def similar_blend(spark: SparkSession, d: str) -> DataFrame:
    e = A.load(spark, d, "embeddings").select(F.col("vec_id").alias("fn_id"), F.slice("embedding", 1, 48).alias("a"), F.slice("embedding", 49, 16).alias("b"))
    unit = lambda c: F.transform(c, lambda x: x.cast("double") / F.sqrt(V.dot(F.col(c), F.col(c))))
    a, b = e.select("fn_id", unit("a").alias("vector")), e.select("fn_id", unit("b").alias("vector"))
    q = [x.filter("fn_id = 0").select("vector").first()[0] for x in (a, b)]
    return V.top_k_blend(a, b, (q[0], q[1]), 10, exclude=0).withColumn("score", F.round("score", 6))


@query(f"""WITH v AS ({_UNIT}), p AS (SELECT a.vec_id AS fn_id, b.vec_id AS other, list_inner_product(a.v, b.v) AS score FROM v a JOIN v b ON a.vec_id <> b.vec_id)
SELECT fn_id, other, round(score, 6) AS score, CAST(row_number() OVER (PARTITION BY fn_id ORDER BY score DESC, other) AS INTEGER) AS rank FROM p WHERE score > 0
QUALIFY row_number() OVER (PARTITION BY fn_id ORDER BY p.score DESC, other) <= 5""")
def nearest_neighbours(spark: SparkSession, d: str) -> DataFrame:
    e = A.load(spark, d, "embeddings").select(F.col("vec_id").alias("fn_id"), F.col("embedding").alias("vector"))
    return V.neighbours(e).withColumn("score", F.round("score", 6))


@query()
def pca_3d(spark: SparkSession, d: str) -> DataFrame:
    return V.pca_3d(A.load(spark, d, "embeddings"), key="vec_id", column="embedding")


@query()
def structural_vectors(spark: SparkSession, d: str) -> DataFrame:
    return V.structural_vectors(A.bags(spark, d))


@query()
def semantic_vectors(spark: SparkSession, d: str) -> DataFrame:
    f = A.functions(spark, d).select(F.col("id").alias("fn_id"), F.explode(F.array(F.concat(F.lit("id:"), "name"), F.concat(F.lit("ty:"), "containing_type"))).alias("feature"), F.lit(1).cast("long").alias("tf"))
    return V.semantic_vectors(V.augment_bags(f))


def _level(n: int) -> str:
    """The first 32 new callees of level n - 1 by discovery, in SQL."""
    known = " AND ".join(f"NOT EXISTS (SELECT 1 FROM l{i} WHERE l{i}.root = x.root AND l{i}.fn = x.callee)" for i in range(n))
    return f"""x{n} AS (SELECT root, callee, min((place, idx)) AS first FROM l{n - 1} JOIN e ON e.caller = l{n - 1}.fn GROUP BY root, callee),
l{n} AS (SELECT root, callee AS fn, row_number() OVER (PARTITION BY root ORDER BY first) AS place FROM x{n} x WHERE {known} QUALIFY row_number() OVER (PARTITION BY root ORDER BY first) <= 32)"""


@query(f"""WITH {A.FUNCTIONS}, {A.CALLS}, f AS (SELECT * FROM functions WHERE NOT is_toplevel), inside AS (SELECT c.caller, c.callee, c.idx, f.name FROM calls c JOIN f ON f.id = c.callee WHERE kind = 'internal'),
e AS (SELECT caller, callee, min(idx) AS idx FROM inside GROUP BY ALL), own AS (SELECT caller, 'eff:' || CASE WHEN starts_with(name, 'new ') THEN 'BUILD' ELSE name END AS feature, count(*) AS n FROM inside GROUP BY ALL),
used AS (SELECT DISTINCT caller, 'effpkg:' || package AS feature FROM calls WHERE kind = 'external'), l0 AS (SELECT id AS root, id AS fn, 0 AS place FROM f), {_level(1)}, {_level(2)},
every AS ({' UNION ALL '.join(f"SELECT root, feature, n * {w} AS tf FROM l{i} JOIN own ON caller = fn UNION ALL SELECT root, feature, 0 FROM l{i} JOIN used ON caller = fn" for i, w in enumerate((4, 2, 1)))})
SELECT root AS fn_id, feature, CAST(CASE WHEN starts_with(feature, 'effpkg:') THEN 4 ELSE sum(tf) END AS BIGINT) AS tf FROM every GROUP BY 1, 2""")
def effect_features(spark: SparkSession, d: str) -> DataFrame:
    return traverse.effect_features(A.functions(spark, d), A.calls(spark, d))


_BLAST = f"""WITH RECURSIVE {A.CALLS}, sparse AS (SELECT * FROM calls WHERE kind = 'internal'), reach(id, depth, high) AS (
  SELECT range, 0, true FROM range(3) UNION
  SELECT s.caller, r.depth + 1, r.high AND s.high FROM reach r JOIN sparse s ON s.callee = r.id WHERE r.depth < {DEPTH}),
best AS (SELECT id, max(high) AS high FROM reach WHERE id >= 3 GROUP BY id),
impacted AS (SELECT id, CAST(min(depth) AS INTEGER) AS depth, high FROM reach JOIN best USING (id, high) GROUP BY id, high)"""


def _impact(spark: SparkSession, d: str) -> DataFrame:
    return traverse.blast_radius(traverse.reverse_edges(A.calls(spark, d)), SEEDS, DEPTH)


@query(_BLAST + " SELECT id, depth, high FROM impacted")
def blast_radius(spark: SparkSession, d: str) -> DataFrame:
    return _impact(spark, d).select("id", "depth", "high")


@query(_BLAST + " SELECT depth, count(*) AS n FROM impacted GROUP BY depth")
def blast_by_depth(spark: SparkSession, d: str) -> DataFrame:
    return traverse.by_depth(_impact(spark, d))


@query(_BLAST.replace("RECURSIVE ", f"RECURSIVE {A.FUNCTIONS}, ") + " SELECT id, depth, high FROM (SELECT id, depth, high FROM impacted UNION ALL SELECT range, 0, true FROM range(3)) WHERE id IN (SELECT id FROM functions WHERE is_test)")
def affected_tests(spark: SparkSession, d: str) -> DataFrame:
    seeds = spark.createDataFrame([(s,) for s in SEEDS], "id bigint")
    return traverse.affected_tests(A.functions(spark, d), _impact(spark, d), seeds)


@query(f"""WITH RECURSIVE {A.CALLS}, walk(id, depth) AS (SELECT CAST(0 AS BIGINT), 0 UNION SELECT callee, depth + 1 FROM walk JOIN calls ON caller = id AND kind = 'internal' WHERE depth < 6)
SELECT min(depth) AS steps FROM walk WHERE id = 42""")
def call_path_length(spark: SparkSession, d: str) -> DataFrame:
    p = traverse.call_path(A.calls(spark, d), 0, 42, 6)
    return p.agg(F.when(F.count("*") > 0, F.count("*").cast("int")).alias("steps"))


def _walk(n: int) -> str:
    """Nodes first found in round n, with the smallest rank and what led there, in SQL."""
    known = " AND ".join(f"callee NOT IN (SELECT node FROM w{i})" for i in range(n))
    return f"w{n} AS (SELECT callee AS node, min((rank || '/' || lpad(CAST(idx AS VARCHAR), 19, '0'), caller, idx, line)) AS m, min(rank || '/' || lpad(CAST(idx AS VARCHAR), 19, '0')) AS rank FROM w{n - 1} JOIN e ON caller = node WHERE {known} GROUP BY callee)"


_STEPS = 6


@query(f"""WITH RECURSIVE {A.CALLS}, e AS (SELECT * FROM calls WHERE kind = 'internal'), w0 AS (SELECT CAST(0 AS BIGINT) AS node, NULL AS m, '' AS rank), {', '.join(map(_walk, range(1, _STEPS + 1)))},
found AS ({' UNION ALL '.join(f"SELECT {i} AS step, node, m[2] AS caller, m[3] AS idx, m[4] AS line FROM w{i}" for i in range(1, _STEPS + 1))}),
back(step, caller, callee, idx, line) AS (SELECT step, caller, node, idx, line FROM found WHERE node = 42 UNION ALL SELECT f.step, f.caller, f.node, f.idx, f.line FROM back b JOIN found f ON f.node = b.caller)
SELECT CAST(step - 1 AS INTEGER) AS step, caller, callee, idx, CAST(line AS INTEGER) AS line FROM back""")
def call_path(spark: SparkSession, d: str) -> DataFrame:
    return traverse.call_path(A.calls(spark, d), 0, 42, _STEPS)


_RING = """SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r, ts FROM events"""


@query(f"SELECT event_id, user_id FROM ({_RING}) WHERE r <= 10 ORDER BY ts DESC, event_id DESC LIMIT 250")
def touch_ring(spark: SparkSession, d: str) -> DataFrame:
    e = A.load(spark, d, "events").select("event_id", "user_id", "ts")
    return touches.trim_single(e, "user_id", ("ts", "event_id")).select("event_id", "user_id")


@query(f"SELECT event_id FROM (SELECT event_id, user_id, ts FROM ({_RING}) WHERE r <= 10 ORDER BY ts DESC, event_id DESC LIMIT 250) WHERE user_id = 3 ORDER BY ts DESC LIMIT 10")
def recent_touches(spark: SparkSession, d: str) -> DataFrame:
    e = A.load(spark, d, "events").select("event_id", F.col("user_id").cast("string").alias("user_id"), "ts")
    ring = touches.trim_single(e, "user_id", ("ts", "event_id")).withColumn("files", F.array("user_id"))
    return touches.recent(ring, "3").select("event_id")


@query()
def touch_replay(spark: SparkSession, d: str) -> DataFrame:
    e = A.load(spark, d, "events")
    files = F.array(F.concat(F.lit("f"), (F.col("user_id") % 40).cast("string")), F.concat(F.lit("g"), (F.col("event_id") % 7).cast("string")))
    rows = e.select((F.col("user_id") % 3).alias("project"), F.unix_timestamp("ts").alias("ts"), F.col("event_id").alias("seq"), files.alias("files"), F.col("props").alias("why"), F.col("event_type").alias("agent"))
    return touches.replay_history(rows)


@query(f"WITH {A.FUNCTIONS} SELECT language AS framework, count(*) AS n FROM functions WHERE is_test GROUP BY language")
def test_inventory(spark: SparkSession, d: str) -> DataFrame:
    cases = A.functions(spark, d).filter("is_test").withColumn("framework", F.col("language"))
    return inventory.frameworks(cases)


@query(f"WITH {A.FUNCTIONS} SELECT id, file_id, start_line AS line FROM functions WHERE is_test AND contains(lower(name), 'e') ORDER BY file_id, start_line, id LIMIT 200")
def list_tests(spark: SparkSession, d: str) -> DataFrame:
    cases = A.functions(spark, d).filter("is_test").withColumns({"kind": F.lit("case"), "line": F.col("start_line")})
    return inventory.list_tests(cases, name="E").select("id", "file_id", "line")


@query("SELECT string_split(regexp_extract(url, '://(.*)$', 1), '/')[1] AS service, count(*) AS files FROM pages GROUP BY 1")
def service_stats(spark: SparkSession, d: str) -> DataFrame:
    return G.service_stats(A.load(spark, d, "pages").select(F.regexp_extract("url", "://(.*)$", 1).alias("path")))


@query("SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'kept' ELSE 'extract' END AS state FROM documents")
def incremental_scan(spark: SparkSession, d: str) -> DataFrame:
    """All documents as files; the cache holds every third under another name and every odd one with other content."""
    files = A.load(spark, d, "documents").select("doc_id", F.concat(F.lit("d/"), F.col("doc_id").cast("string")).alias("path"), F.xxhash64("text").alias("content_hash"))
    changed = F.when(F.col("doc_id") % 2 == 1, F.col("content_hash") + 1).otherwise(F.col("content_hash"))
    cache = files.withColumn("content_hash", changed).unionByName(files.filter("doc_id % 3 = 0").withColumn("path", F.concat(F.lit("old/"), "path")))
    kept, todo = scan.split_cached(files, cache)
    return kept.select("doc_id", F.lit("kept").alias("state")).unionByName(todo.select("doc_id", F.lit("extract").alias("state")))


@query("""WITH n AS (SELECT c_custkey AS id, c_mktsegment || (c_custkey % 100) AS method, 'N' || c_nationkey AS module, 'A' || (c_custkey % 7) AS alias FROM customer),
c AS (SELECT o_orderkey AS id, CASE o_orderkey % 5 WHEN 0 THEN 'BUILDING' WHEN 1 THEN 'MACHINERY' ELSE 'AUTOMOBILE' END || (o_custkey % 100) AS method, CASE WHEN o_orderkey % 3 = 0 THEN NULL WHEN o_orderkey % 3 = 1 THEN 'N' || (o_custkey % 25) ELSE 'A' || (o_custkey % 7) END AS module, o_orderstatus = 'F' AS high FROM orders)
SELECT c.id AS call_id, n.id AS native_id, c.high AND count(*) OVER (PARTITION BY c.id) = 1 AS high FROM c JOIN n ON c.method = n.method AND (c.module IS NULL OR c.module = n.module OR c.module = n.alias)""")
def bridge_map(spark: SparkSession, d: str) -> DataFrame:
    """All orders as calls of all customers as native methods."""
    c, o = A.load(spark, d, "customer"), A.load(spark, d, "orders")
    text = lambda p, x: F.concat(F.lit(p), x.cast("string"))
    n = c.select(F.col("c_custkey").alias("id"), F.concat("c_mktsegment", (F.col("c_custkey") % 100).cast("string")).alias("method"), text("N", F.col("c_nationkey")).alias("module"), text("A", F.col("c_custkey") % 7).alias("alias"))
    k = F.col("o_orderkey")
    method = F.concat(F.when(k % 5 == 0, "BUILDING").when(k % 5 == 1, "MACHINERY").otherwise("AUTOMOBILE"), (F.col("o_custkey") % 100).cast("string"))
    module = F.when(k % 3 == 1, text("N", F.col("o_custkey") % 25)).when(k % 3 == 2, text("A", F.col("o_custkey") % 7))
    return C.bridge_matches(o.select(k.alias("id"), method.alias("method"), module.alias("module"), (F.col("o_orderstatus") == "F").alias("high")), n)


@query(f"""WITH {A.FILES.replace('range(50)', 'range(500)')}, {A.METHODS}, m AS (SELECT id, is_toplevel, start_line, end_line, id % 500 AS file_id FROM methods), {A.LINES}, {A.CALLS.replace('FROM lineitem', 'FROM lines')},
a AS (SELECT l_orderkey * 8 + l_linenumber AS idx, l_suppkey % 500 AS def_id, CASE WHEN l_returnflag = 'A' THEN l_quantity END AS def_line, CASE WHEN l_returnflag = 'N' AND l_linestatus = 'F' THEN 'pkg' || l_suppkey END AS def_package FROM lines),
hit AS (SELECT idx, min((start_line <> def_line, end_line - start_line, m.id))[3] AS fn FROM a JOIN m ON m.file_id = def_id AND NOT is_toplevel AND start_line <= def_line AND def_line <= end_line WHERE def_line IS NOT NULL GROUP BY idx)
SELECT c.idx, CASE WHEN fn IS NOT NULL THEN 'internal' WHEN def_package IS NOT NULL THEN 'external' ELSE kind END AS kind, CASE WHEN fn IS NOT NULL THEN fn WHEN def_package IS NOT NULL THEN NULL ELSE callee END AS callee,
  high OR fn IS NOT NULL OR def_package IS NOT NULL AS high, CASE WHEN fn IS NOT NULL THEN NULL WHEN def_package IS NOT NULL THEN def_package ELSE package END AS package,
  CASE WHEN fn IS NOT NULL OR def_package IS NOT NULL OR high THEN 0 ELSE 2 END AS rivals
FROM calls c JOIN a USING (idx) LEFT JOIN hit USING (idx)""")
def lsp_rewrite(spark: SparkSession, d: str) -> DataFrame:
    """Answers for all order lines: a definition in the tree, one outside, or none."""
    files = A.files(spark, 500)
    f = A.methods(spark, d).withColumn("file_id", F.col("id") % 500)
    lines = materialize(A.lines(spark, d))
    release(spark)
    # A call's place is its own line; its file is its caller's.
    c = A.maybe_calls(spark, d, lines).select("idx", "caller", "kind", "callee", "high", "ambiguous_with", "package", F.col("idx").alias("name_line"), F.lit(1).alias("name_col"))
    item = lines.withColumn("file_id", F.col("l_partkey") % 500).join(files.select(F.col("id").alias("file_id"), "path"), "file_id")
    where = files.select(F.col("id").alias("def_id"), F.col("path").alias("def_file"))
    answers = item.withColumn("def_id", F.col("l_suppkey") % 500).join(where, "def_id").select(
        "path", (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("line"), F.lit(1).alias("col"), "def_file",
        F.when(F.col("l_returnflag") == "A", F.col("l_quantity")).alias("def_line"),
        F.when((F.col("l_returnflag") == "N") & (F.col("l_linestatus") == "F"), F.concat(F.lit("pkg"), F.col("l_suppkey").cast("string"))).alias("def_package"),
    )
    return resolve.apply_answers(c, answers, f, files, min(4, 1 + lines.count() // 1_000_000)).select("idx", "kind", "callee", "high", "package", F.size("ambiguous_with").alias("rivals"))


@query("""SELECT 100 + n_nationkey AS id, CASE WHEN r_regionkey IS NULL OR n_nationkey % 9 = 8 THEN '/{*}/' || lower(n_name) ELSE '/' || lower(r_name) || '/' || lower(n_name) END AS path FROM nation LEFT JOIN region ON r_regionkey = n_regionkey
UNION ALL SELECT r_regionkey, '/' || lower(r_name) FROM region""")
def rest_path_chain(spark: SparkSession, d: str) -> DataFrame:
    n, r = A.load(spark, d, "nation"), A.load(spark, d, "region")
    parent = F.when(F.col("n_nationkey") % 9 == 8, -1).otherwise(F.col("n_regionkey"))
    rows = n.select((F.col("n_nationkey") + 100).alias("id"), parent.alias("parent"), F.lower("n_name").alias("part"))
    rows = rows.unionByName(r.select(F.col("r_regionkey").alias("id"), F.lit(None).cast("int").alias("parent"), F.lower("r_name").alias("part")))
    return C.rest_paths(rows).select("id", "path")


@query("SELECT row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS id, o_orderkey FROM orders")
def dense_ids(spark: SparkSession, d: str) -> DataFrame:
    return G.assign_ids(A.load(spark, d, "orders").select("o_orderdate", "o_orderkey"), ["o_orderdate", "o_orderkey"]).select("id", "o_orderkey")


@query(f"WITH {A.FUNCTIONS}, {A.CALLS}, ends AS (SELECT caller AS id FROM calls WHERE kind = 'internal' UNION ALL SELECT callee FROM calls WHERE kind = 'internal'), g AS (SELECT f.id, count(e.id) AS degree FROM functions f LEFT JOIN ends e USING (id) GROUP BY f.id) SELECT id, degree FROM g ORDER BY degree DESC, id LIMIT 50")
def top_degree(spark: SparkSession, d: str) -> DataFrame:
    return G.top_by_degree(A.functions(spark, d), A.calls(spark, d), 50).select("id", "degree")



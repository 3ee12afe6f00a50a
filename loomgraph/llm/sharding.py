"""Sharding by proportional stratified interleaving, in DataFrame functions only.

Rows are shuffled by a seeded hash and ranked within their source; the fractional
rank (rank + 1/2) / source size spreads each source evenly over [0, 1); the order by
it is cut into shards whose row counts differ by one at most, so each holds every
source in proportion.

No window covers a whole source or the whole table: a rank is the number of rows in
earlier hash ranges, from a small table of counts, plus a rank within the own range.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomgraph.llm.common import load, named, seeded

#: Rows that one range of hashes, or of fractional ranks, has on average.
RANGE_ROWS = 2048
#: Ranges whose counts one window sums up.
BLOCK_RANGES = 4096
_HASH_BITS = 60


def _offsets(counts: DataFrame, by: list[str], at: str) -> DataFrame:
    """Adds to each range the rows of the ranges before it.

    Sums run over blocks of ranges and, within a block, over its ranges, so no window
    grows with the table but by one row in RANGE_ROWS * BLOCK_RANGES.
    """
    counts = counts.withColumn("_b", F.expr(f"{at} div {BLOCK_RANGES}"))
    earlier = Window.partitionBy(*by).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    blocks = counts.groupBy(*by, "_b").agg(F.sum("_n").alias("_m")).withColumn("_m", F.coalesce(F.sum("_m").over(earlier), F.lit(0)))
    inner = Window.partitionBy(*by, "_b").orderBy(at).rowsBetween(Window.unboundedPreceding, -1)
    sums = counts.withColumn("_before", F.coalesce(F.sum("_n").over(inner), F.lit(0)))
    return sums.join(blocks, [*by, "_b"]).withColumn("_before", F.col("_before") + F.col("_m")).drop("_b", "_m")


def interleave_shards(docs: DataFrame, shards: int, seed: int = 7, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """All rows and columns of ``docs`` plus ``shard`` (int) and ``slot`` (long, gapless from 0 in a shard).

    A null source is a source of its own; null keys and texts hash as empty ones.
    Rows that agree in key and text are interchangeable.  An empty table gives an empty one.
    Columns of ``docs`` called shard or slot give way to the results; if they are read it is an error.
    """
    if shards < 1:
        raise ValueError("shards must be at least 1")
    total = docs.count()
    width = max(1, -(-total // RANGE_ROWS))
    names = named(docs, "shard", "slot", used=(key, text, source))
    crc = F.crc32(F.encode(F.coalesce(F.col(text).cast("string"), F.lit("")), "UTF-8"))
    rows = docs.select(F.struct(*names).alias("_row"), F.coalesce(F.concat(F.lit("s"), F.col(source)), F.lit("n")).alias("_s"), F.col(key).alias("_k"), crc.alias("_c"))
    rows = rows.withColumn("_h", seeded(seed, F.col("_k")))
    rows = rows.withColumn("_r", F.floor(F.col("_h") / F.lit(float(2**_HASH_BITS)) * width).cast("int"))
    counts = rows.groupBy("_s", "_r").agg(F.count("*").alias("_n"))
    ranges = _offsets(counts, ["_s"], "_r").drop("_n").join(counts.groupBy("_s").agg(F.sum("_n").alias("_size")), "_s")
    within = Window.partitionBy("_s", "_r").orderBy("_h", "_k", "_c")
    ranked = rows.withColumn("_i", F.row_number().over(within) - 1).join(ranges, ["_s", "_r"])
    ranked = ranked.withColumn("_f", (F.col("_before") + F.col("_i") + F.lit(0.5)) / F.col("_size"))
    return _cut(ranked, total, width, shards).select("_row.*", "shard", "slot")


def _cut(ranked: DataFrame, total: int, width: int, shards: int) -> DataFrame:
    """Ranks by fractional rank, source and hash over all rows, and cuts the order."""
    ranked = ranked.withColumn("_q", F.least(F.lit(width - 1), F.floor(F.col("_f") * width).cast("int")))
    counts = ranked.groupBy("_q").agg(F.count("*").alias("_n"))
    before = _offsets(counts.withColumn("_one", F.lit(1)), ["_one"], "_q").select("_q", F.col("_before").alias("_ahead"))
    w = Window.partitionBy("_q").orderBy("_f", "_s", "_h", "_k", "_c")
    out = ranked.withColumn("_j", F.row_number().over(w) - 1).join(before, "_q")
    place = F.col("_ahead") + F.col("_j")
    shard = F.expr(f"cast((_ahead + _j) * {shards} div {max(total, 1)} as int)")
    out = out.withColumn("shard", shard)
    first = F.expr(f"(cast(shard as bigint) * {total} + {shards - 1}) div {shards}")
    return out.withColumn("slot", (place - first).cast("long"))


SHARDS, SEED = 8, 7


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's shard under the ``rows`` law, with its size and text checksum."""
    docs = load(spark, sf_dir, "documents")
    body = F.encode(F.coalesce(F.col("text"), F.lit("")), "UTF-8")
    digest = docs.select("doc_id", "source", (F.octet_length(body) + 1).cast("long").alias("size"), F.crc32(body).alias("text_crc32"))
    out = interleave_shards(digest, SHARDS, SEED, text="text_crc32")
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


#: CRC-32 byte by byte; its table follows from the reflected polynomial 0xEDB88320.
OP1_SQL = f"""
WITH RECURSIVE bits(b, k, c) AS (
  SELECT range, 0, CAST(range AS UBIGINT) FROM range(256)
  UNION ALL
  SELECT b, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, CAST(3988292384 AS UBIGINT)) ELSE c >> 1 END FROM bits WHERE k < 8
), crc AS (SELECT list(c ORDER BY b) AS t FROM bits WHERE k = 8
), d AS (
  SELECT doc_id, coalesce('s' || source, 'n') AS s, coalesce(text, '') AS body,
         CAST(('0x' || substr(md5('{SEED}:' || doc_id), 1, 15)) AS BIGINT) AS h FROM documents
), f AS (
  SELECT *, (row_number() OVER (PARTITION BY s ORDER BY h, doc_id) - 1 + CAST(0.5 AS DOUBLE)) / count(*) OVER (PARTITION BY s) AS f,
         count(*) OVER () AS n FROM d
), g AS (SELECT *, row_number() OVER (ORDER BY f, s, h, doc_id) - 1 AS g FROM f
)
SELECT doc_id, CAST(strlen(body) + 1 AS BIGINT) AS size,
       CAST(xor(list_reduce(list_prepend(CAST(4294967295 AS UBIGINT), list_transform(regexp_extract_all(hex(encode(body)), '..'), lambda x: CAST('0x' || x AS UBIGINT))),
            lambda a, x: xor(a >> 8, t[CAST(xor(a, x) & 255 AS INTEGER) + 1])), CAST(4294967295 AS UBIGINT)) AS BIGINT) AS text_crc32,
       'rows' AS law, CAST(g * {SHARDS} // n AS INTEGER) AS shard,
       CAST(g - ((g * {SHARDS} // n) * n + {SHARDS - 1}) // {SHARDS} AS BIGINT) AS slot, CAST(NULL AS INTEGER) AS grown_shard
FROM g, crc
"""

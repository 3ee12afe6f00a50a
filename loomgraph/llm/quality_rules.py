"""Quality rules by distribution divergence, in DataFrame functions only.

A document's histogram of character classes and of common words is compared with the
histogram of all documents of its language by Jensen-Shannon distance.  Texts too short
for a histogram are not judged by it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm.common import load, materialize, named, words

#: Frequent function words, the bins of the word histogram.
COMMON_WORDS = {
    "en": ["the", "of", "and", "to", "in", "a", "is", "that", "for", "it", "as", "was"],
    "fr": ["de", "la", "le", "et", "les", "des", "en", "un", "du", "une", "que", "est"],
    "de": ["der", "die", "und", "in", "den", "von", "zu", "das", "mit", "sich", "des", "auf"],
    "es": ["de", "la", "que", "el", "en", "y", "a", "los", "del", "se", "las", "por"],
}
#: The characters of each ASCII class; what is outside ASCII or in none has two more bins.
CLASSES = {
    "vowel": "aeiouAEIOU",
    "consonant": "bcdfghjklmnpqrstvwxyzBCDFGHJKLMNPQRSTVWXYZ",
    "digit": "0123456789",
    "blank": " \t\n\x0b\x0c\r",
    "stop": ".,;:!?'\"()-",
    "symbol": "#*$%&|<>",
}
_BLANK, _SYMBOL = 3, 5
#: Bins of the word histogram but the one of all other words.
WORD_BINS = 12
#: Documents with fewer characters, or words, are not judged by the respective histogram.
MIN_CHARS, MIN_WORDS = 200, 50
#: Largest distance (base 2, 0 to 1) from the language's reference.
MAX_CLASS_DISTANCE, MAX_WORD_DISTANCE = 0.24, 0.3
_BINS = len(CLASSES) + 2
#: Columns of the verdict; input columns of these names give way to them.
OUTPUTS = ["_n_words", "_word_chars", "_n_symbols", "_n_dup_lines", "_n_repeat_words", "_base_failed", "_kept", "_class_distance", "_word_distance"]


def _count_chars(text: Column, chars: str) -> Column:
    return F.char_length(text) - F.char_length(F.translate(text, chars, ""))


def _windows(ws: Column) -> Column:
    """(hash, start) of all three-word windows, sorted; 64-bit hashes stand for the words."""
    pairs = F.transform(F.sequence(F.lit(0), F.size(ws) - 3), lambda i: F.struct(F.xxhash64(ws[i], ws[i + 1], ws[i + 2]).alias("h"), i.alias("i")))
    return F.when(F.size(ws) >= 4, F.sort_array(pairs)).otherwise(F.array().cast("array<struct<h:bigint,i:int>>"))


def document_features(docs: DataFrame, carry: list[str] | None = None, text: str = "text", lang: str = "lang") -> DataFrame:
    """The columns ``carry`` (all by default) plus the counts that the rules read, one row per row of ``docs``.

    Null texts count as empty.  Words are runs without ASCII blanks.  _classes has a bin per
    character class, one for characters outside ASCII and one for the rest; _common a bin
    per common word of the language and one for all other words, null if there is no list.
    """
    carried = named(docs, *OUTPUTS, used=(text, lang)) if carry is None else [F.col(c) for c in carry]
    d = docs.select(F.struct(*carried).alias("_row"), F.col(lang).alias("_lang"), F.coalesce(F.col(text), F.lit("")).alias("_t"))
    # Letters go in runs; all other classes are counted in what is left, a fifth of the text.
    d = d.withColumns({"_len": F.char_length("_t"), "_rest": F.regexp_replace("_t", "[A-Za-z]+", "")})
    d = d.withColumn("_vowels", _count_chars(F.col("_t"), CLASSES["vowel"]))
    tally = [F.col("_vowels"), F.col("_len") - F.char_length("_rest") - F.col("_vowels"), *[_count_chars(F.col("_rest"), c) for c in list(CLASSES.values())[2:]]]
    spaced = F.concat(F.lit(" "), F.regexp_replace(F.lower("_t"), r"[^\p{L}]+", "  "), F.lit(" "))
    lines = F.filter(F.split("_t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    d = d.withColumns({"_ws": words(F.col("_t")), "_tally": F.array(*tally), "_wide": F.char_length(F.regexp_replace("_rest", r"[\x00-\x7F]+", "")), "_spaced": spaced, "_lines": lines})
    d = d.withColumn("_sorted", _windows(F.col("_ws")))
    again = lambda x, k: (x.h == F.get(F.col("_sorted"), k - 1).h) | (x.h == F.get(F.col("_sorted"), k + 1).h)
    d = d.withColumn("_starts", F.transform(F.filter("_sorted", lambda x, k: F.coalesce(again(x, k), F.lit(False))), lambda x: x.i))
    hits = lambda w: ((F.char_length("_spaced") - F.char_length(F.replace(F.col("_spaced"), F.lit(f" {w} "), F.lit("")))) / (len(w) + 2)).cast("long")
    common = F.lit(None).cast("array<bigint>")
    for name, listed in COMMON_WORDS.items():
        common = F.when(F.col("_lang") == name, F.array(*[hits(w) for w in listed])).otherwise(common)
    covered = F.aggregate("_tally", F.lit(0), lambda a, x: a + x) + F.col("_wide")
    return d.withColumn("_hits", common).select(
        "_row", "_lang",
        F.size("_ws").cast("long").alias("_n_words"),
        (F.col("_len") - F.col("_tally")[_BLANK]).cast("long").alias("_word_chars"),
        F.col("_tally")[_SYMBOL].cast("long").alias("_n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("_n_dup_lines"),
        F.size(F.array_distinct(F.flatten(F.transform("_starts", lambda i: F.array(i, i + 1, i + 2))))).cast("long").alias("_n_repeat_words"),
        F.concat("_tally", F.array("_wide", F.col("_len") - covered)).cast("array<bigint>").alias("_classes"),
        F.concat("_hits", F.array(F.greatest(F.lit(0), F.size("_ws") - F.aggregate("_hits", F.lit(0).cast("bigint"), lambda a, x: a + x)).cast("bigint"))).alias("_common"),
    )


def _distance(a: Column, b: Column) -> Column:
    """Jensen-Shannon distance, base 2, of two histograms of counts."""
    total = lambda x: F.aggregate(x, F.lit(0.0), lambda s, v: s + v)
    p, q = F.transform(a, lambda v: v / total(a)), F.transform(b, lambda v: v / total(b))

    def part(x: Column, y: Column) -> Column:
        return F.when(x > 0, x * F.log2(2 * x / (x + y))).otherwise(0.0)

    both = F.zip_with(p, q, lambda x, y: part(x, y) + part(y, x))
    return F.sqrt(F.greatest(F.lit(0.0), total(both) / 2))


def judge_documents(docs: DataFrame, carry: list[str] | None = None, text: str = "text", lang: str = "lang", min_words: int = 50, max_repeat_percent: int = 50) -> DataFrame:
    """The columns ``carry`` plus the counts, _class_distance, _word_distance, _base_failed and _kept.

    References are the summed histograms of all documents of a language that pass the
    length guards; null is a language of its own.  A distance is null, and its rule
    passes, below its guard, without a word list or without a reference.  An empty table
    gives an empty one; a language with one document is its own reference and passes.  Columns of ``docs``
    named like a result give way to it.
    """
    f = materialize(document_features(docs, carry, text, lang))
    chars = F.aggregate("_classes", F.lit(0).cast("bigint"), lambda a, x: a + x)
    long_chars, long_words = chars >= MIN_CHARS, F.col("_n_words") >= MIN_WORDS
    sums = [F.sum(F.when(long_chars, F.col("_classes")[i])).cast("double") for i in range(_BINS)]
    word_sums = [F.sum(F.when(long_words, F.col("_common")[i])).cast("double") for i in range(WORD_BINS + 1)]
    ref = f.groupBy("_lang").agg(F.array(*sums).alias("_rc"), F.array(*word_sums).alias("_rw")).withColumnRenamed("_lang", "_l")
    d = f.join(ref, F.col("_lang").eqNullSafe(F.col("_l"))).withColumns({"_c": F.col("_classes").cast("array<double>"), "_w": F.col("_common").cast("array<double>")})
    d = d.withColumns({
        "_class_distance": F.when(long_chars, _distance(F.col("_c"), F.col("_rc"))),
        "_word_distance": F.when(long_words & F.col("_w").isNotNull(), _distance(F.col("_w"), F.col("_rw"))),
        "_base_failed": (F.col("_n_words") < min_words) | (100 * F.col("_n_repeat_words") > max_repeat_percent * F.col("_n_words")),
    })
    close = lambda c, most: F.coalesce(F.col(c) <= most, F.lit(True))
    kept = ~F.col("_base_failed") & close("_class_distance", MAX_CLASS_DISTANCE) & close("_word_distance", MAX_WORD_DISTANCE)
    counts = ["_n_words", "_word_chars", "_n_symbols", "_n_dup_lines", "_n_repeat_words"]
    return d.select("_row.*", *counts, "_base_failed", kept.alias("_kept"), "_class_distance", "_word_distance")


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdict of every document."""
    out = judge_documents(load(spark, sf_dir, "documents"), ["doc_id"])
    names = {c: c[1:] for c in out.columns if c.startswith("_")}
    out = out.withColumns({c: F.round(c, 6) for c in ("_class_distance", "_word_distance")})
    return out.withColumnsRenamed(names)


def _sql_distance(a: str, b: str) -> str:
    p, q = (f"list_transform({x}, lambda v: v / list_sum({x}))" for x in (a, b))
    part = lambda x, y: f"CASE WHEN {x} > 0 THEN {x} * log2(2 * {x} / ({x} + {y})) ELSE 0 END"
    return f"sqrt(greatest(0, list_sum(list_transform(list_zip({p}, {q}), lambda z: {part('z[1]', 'z[2]')} + {part('z[2]', 'z[1]')})) / 2))"


def _sql() -> str:
    def count(chars: str) -> str:
        listed = " || ".join(f"chr({ord(c)})" for c in chars)
        return f"length(t) - length(translate(t, {listed}, ''))"

    tally = [count(c) for c in CLASSES.values()]
    common = " ".join(
        f"WHEN lang = '{k}' THEN [" + ", ".join(f"(length(sp) - length(replace(sp, ' {w} ', ''))) // {len(w) + 2}" for w in v) + "]" for k, v in COMMON_WORDS.items()
    )
    return rf"""
WITH d AS (
  SELECT doc_id, lang, coalesce(text, '') AS t, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS ws,
         ' ' || regexp_replace(lower(coalesce(text, '')), '[^\p{{L}}]+', '  ', 'g') || ' ' AS sp FROM documents
), win AS (
  SELECT doc_id, i, [ws[i], ws[i + 1], ws[i + 2]] AS w FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM d)
), rep AS (
  SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM win QUALIFY count(*) OVER (PARTITION BY doc_id, w) > 1) GROUP BY doc_id
), c AS (
  SELECT doc_id, lang, t, ws, [{', '.join(tally)}] AS tally, length(regexp_replace(t, '[\x00-\x7F]+', '', 'g')) AS wide, CASE {common} END AS hits,
         list_filter(string_split(t, chr(10)), lambda x: regexp_replace(x, '[\x20\x09-\x0D]+', '', 'g') <> '') AS lines FROM d
), f AS (
  SELECT doc_id, lang, len(ws) AS n_words, length(t) - tally[{_BLANK + 1}] AS word_chars, tally[{_SYMBOL + 1}] AS n_symbols,
         len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words, length(t) AS len,
         list_concat(tally, [wide, length(t) - list_sum(tally) - wide]) AS classes,
         CASE WHEN hits IS NOT NULL THEN list_concat(hits, [greatest(0, len(ws) - list_sum(hits))]) END AS common
  FROM c LEFT JOIN rep USING (doc_id)
), r AS (
  SELECT lang AS l, [{', '.join(f'sum(classes[{i + 1}]) FILTER (len >= {MIN_CHARS})' for i in range(_BINS))}] AS rc,
         [{', '.join(f'sum(common[{i + 1}]) FILTER (n_words >= {MIN_WORDS})' for i in range(WORD_BINS + 1))}] AS rw FROM f GROUP BY lang
), j AS (
  SELECT *, CASE WHEN len >= {MIN_CHARS} THEN {_sql_distance('classes', 'rc')} END AS cd,
         CASE WHEN n_words >= {MIN_WORDS} AND common IS NOT NULL THEN {_sql_distance('common', 'rw')} END AS wd,
         n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM f JOIN r ON lang IS NOT DISTINCT FROM l
)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
       CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
       NOT base_failed AND coalesce(cd <= {MAX_CLASS_DISTANCE}, true) AND coalesce(wd <= {MAX_WORD_DISTANCE}, true) AS kept,
       round(cd, 6) AS class_distance, round(wd, 6) AS word_distance
FROM j
"""


OP5_SQL = _sql()

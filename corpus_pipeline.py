"""The corpus pipeline: raw documents to a mixed, sharded training corpus.

Each stage gets what its predecessor kept, reads it from Parquet and returns the columns of
``documents``; the last adds the shard and the place in it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm.common import load, materialize, words
from loomgraph.llm.decontaminate import contaminated
from loomgraph.llm.langid import UNKNOWN, identify, learn_prototypes
from loomgraph.llm.mixing import mix_sources
from loomgraph.llm.ngram_join import jaccard_components
from loomgraph.llm.sharding import interleave_shards

#: Texts whose cosine with every language is below this are no language.
MIN_LANGUAGE_SCORE = 0.05
#: Near duplicates: five-word shingles, Jaccard similarity in percent.
NEAR_WORDS, NEAR_PERCENT = 5, 80
SHARDS = 8


def _packed(docs: DataFrame, *columns: str) -> DataFrame:
    """The rows as a struct beside the columns that a stage reads, so that no other name can clash with a result."""
    return docs.select(F.struct("*").alias("_row"), *columns)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without letters and those that resemble no language.

    Documents keep their own language tag.  Without any tag nothing can be learnt and all stay.
    """
    prototypes = learn_prototypes(docs.select("text", "lang"))
    if not prototypes:
        return docs
    found = identify(_packed(docs, "text"), prototypes)
    return found.filter((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= MIN_LANGUAGE_SCORE)).select("_row.*")


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document of the smallest id stays; of rows of one id, one row."""
    groups = jaccard_components(docs.select("doc_id", "text"), NEAR_WORDS, NEAR_PERCENT)
    gone = groups.filter("component_id <> doc_id").select("doc_id").distinct()
    kept = _packed(docs, "doc_id").join(gone, "doc_id", "left_anti")
    keyed = kept.filter("doc_id is not null").groupBy("doc_id").agg(F.first("_row").alias("_row"))
    return keyed.select("_row.*").unionByName(kept.filter("doc_id is null").select("_row.*"))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that contain a benchmark item."""
    # What a document contains follows from its text alone, so ids may be null or repeat.
    body = F.md5("text").alias("_key")
    hits = materialize(contaminated(docs.select(body, "text"), load(spark, sf_dir, "benchmark"), key="_key").select("_key").distinct())
    return docs.select(F.struct("*").alias("_row"), body).join(hits, "_key", "left_anti").select("_row.*")


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats each document as often as the mixture takes it: not at all, once or twice."""
    counted = docs.select(F.struct("*").alias("_row"), "doc_id", "source", F.size(words(F.col("text"))).alias("_words"))
    taken = mix_sources(counted, size=F.col("_words")).filter("_copies > 0")
    return taken.select("_row", F.explode(F.sequence(F.lit(1), F.col("_copies")))).select("_row.*")


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows with their shard and their place in it, which take the place of columns of those names."""
    return interleave_shards(docs, SHARDS)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language),
    ("ngram_join", deduplicate),
    ("decontamination", decontaminate),
    ("mixing", mix),
    ("sharding", shard),
]

#: SQL has no counterpart of the language profiles and the pairwise rounding.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to ``documents``, writing and rereading between them."""
    docs = load(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = materialize(docs)
    return docs

"""The pipeline on a small corpus with planted cases."""

import random

import pytest

import corpus_pipeline as P
from loomgraph.llm.common import load


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    rnd = random.Random(5)
    words = ["the", "river", "stone", "walks", "green", "light", "house", "garden", "window", "of", "and"] + ["".join(rnd.choice("abcdefgh") for _ in range(5)) for _ in range(500)]
    text = lambda n: " ".join(rnd.choice(words) for _ in range(n))
    rows = [(i, text(80), "en", f"s{i % 4}", 0) for i in range(200)]
    near = rows[10][1].split()
    near[40] = "changed"
    item = text(30)
    rows += [(300, rows[10][1], "en", "s0", 0), (301, " ".join(near), "en", "s1", 0), (302, text(40) + " " + item + " " + text(40), "en", "s2", 0), (303, None, "en", "s2", 0), (304, "### 123", "en", None, 0)]
    base = tmp_path_factory.mktemp("data")
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"file://{base}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id bigint, text string").write.parquet(f"file://{base}/benchmark.parquet")
    return f"file://{base}"


def test_stages(spark, sf_dir):
    docs = load(spark, sf_dir, "documents")
    columns = docs.columns
    kept = {}
    for name, stage in P.STAGES:
        docs = P.materialize(stage(spark, docs, sf_dir))
        kept[name] = [r.doc_id for r in docs.collect()]
        if name != "sharding":
            assert docs.columns == columns
    assert not {303, 304} & set(kept["language_id"])
    assert not {300, 301} & set(kept["ngram_join"]) and 10 in kept["ngram_join"]
    assert sorted(set(kept["ngram_join"]) - set(kept["decontamination"])) == [302]
    assert set(kept["decontamination"]) == set(range(200))
    assert set(kept["mixing"]) <= set(range(200)) and len(kept["mixing"]) > 200
    assert sorted(kept["sharding"]) == sorted(kept["mixing"])


def test_run(spark, sf_dir):
    out = P.run(spark, sf_dir).toPandas()
    counts = out.groupby("shard").size()
    assert len(counts) == P.SHARDS and counts.max() - counts.min() <= 1


def test_empty_tables(spark, sf_dir):
    docs = load(spark, sf_dir, "documents").limit(0)
    for _, stage in P.STAGES:
        docs = P.materialize(stage(spark, docs, sf_dir))
        assert docs.count() == 0


def test_odd_tables(spark, sf_dir, tmp_path):
    """Clashing columns, a map, null and repeated ids, a very long text, and a benchmark without items."""
    from pyspark.sql import functions as F

    docs = load(spark, sf_dir, "documents").filter("doc_id < 60")
    more = docs.filter("doc_id < 20").withColumn("doc_id", F.lit(None).cast("bigint")).withColumn("text", F.concat("text", F.lit(" other "), F.sha2("text", 256)))
    long = docs.filter("doc_id = 1").withColumn("doc_id", F.lit(900).cast("bigint")).withColumn("text", F.repeat(F.concat(F.lit("the river of stone "), F.sha2("text", 256)), 4000))
    docs = docs.unionByName(docs.filter("doc_id = 5")).unionByName(more).unionByName(long)
    clash = ["score", "lang_pred", "shard", "slot", "_size", "_copies", "_row", "_key", "_words", "component_id"]
    docs = docs.withColumns({c: F.lit(1) for c in clash}).withColumn("map", F.create_map(F.lit("a"), F.lit(1)))
    docs.write.parquet(f"file://{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id bigint, text string").write.parquet(f"file://{tmp_path}/benchmark.parquet")
    docs = load(spark, f"file://{tmp_path}", "documents")
    columns, kept = docs.columns, {}
    for name, stage in P.STAGES:
        docs = P.materialize(stage(spark, docs, f"file://{tmp_path}"))
        kept[name] = [r.doc_id for r in docs.select("doc_id").collect()]
        if name != "sharding":
            assert docs.columns == columns
    assert len(kept["language_id"]) == 82
    assert sorted(k for k in kept["ngram_join"] if k is not None) == [*range(60), 900] and kept["ngram_join"].count(None) == 20
    assert len(kept["decontamination"]) == 81 and len(kept["mixing"]) > 81
    assert docs.columns == [c for c in columns if c not in ("shard", "slot")] + ["shard", "slot"]

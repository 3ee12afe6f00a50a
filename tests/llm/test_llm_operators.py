"""Small tests of the training-data operators: laws, brute force, and odd rows."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomgraph.llm import common, cotraining, decontaminate, langid, mixing, ngram_join, quality_rules, sharding, textkit, token_counts, toxicity, warc

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, extra string"
ODD = [
    (1, None, "en", "a", None, "x"),
    (2, "", None, "a", 0, "x"),
    (3, " \n\t ", "en", None, 3, None),
    (4, "one", "en", "b", 3, "x"),
    (4, "one", "en", "b", 3, "x"),
    (None, "no key here at all", "fr", "b", 18, "x"),
    (5, "été " * 5000, "fr", "c", 20000, "x"),
    (6, "#### $$$$ ||||", "en", "c", 14, "x"),
]


@pytest.fixture(scope="module")
def odd(spark):
    # Columns named like internal ones or like results must not clash, nor may types without an order.
    clash = ["_s", "_row", "_id", "_size", "_copies", "_kept", "_n_words", "lang_pred", "Score", "shard", "slot", "payload", "k"]
    d = spark.createDataFrame(ODD, DOCS).withColumn("t", F.lit("y")).withColumn("map", F.create_map(F.lit("a"), F.lit(1)))
    return d.withColumns({c: F.lit(1) for c in clash})


@pytest.fixture(scope="module")
def empty(odd):
    return odd.limit(0)


def prose(rnd, words, vocabulary):
    return " ".join(rnd.choice(vocabulary) for _ in range(words))


def corpus(spark, n=300, seed=3):
    rnd = random.Random(seed)
    vocabulary = ["".join(rnd.choice("abcdefghij") for _ in range(rnd.randint(2, 6))) for _ in range(400)]
    rows = []
    for i in range(n):
        rows.append((i, prose(rnd, rnd.randint(5, 120), vocabulary), "en", "hot" if i % 3 == 0 else f"s{i % 7}", 0, "x"))
    return spark.createDataFrame(rows, DOCS), vocabulary, rnd


# ---- sharding


def test_shards_are_even_gapless_and_mixed(spark):
    docs, _, _ = corpus(spark, 1000)
    out = sharding.interleave_shards(docs, 8).toPandas()
    assert sorted(out.doc_id) == list(range(1000))
    counts = out.groupby("shard").size()
    assert counts.max() - counts.min() <= 1
    for _, g in out.groupby("shard"):
        assert sorted(g.slot) == list(range(len(g)))
    mix = out.groupby(["source", "shard"]).size().unstack(fill_value=0)
    assert (mix.max(axis=1) - mix.min(axis=1)).max() <= 2
    again = sharding.interleave_shards(docs.repartition(5), 8).toPandas()
    assert dict(zip(out.doc_id, out.shard, strict=True)) == dict(zip(again.doc_id, again.shard, strict=True))


def test_shards_of_odd_rows(odd, empty):
    out = sharding.interleave_shards(odd, 3)
    assert out.columns == [*[c for c in odd.columns if c not in ("shard", "slot")], "shard", "slot"]
    with pytest.raises(ValueError, match="shard"):
        sharding.interleave_shards(odd, 3, source="shard")
    assert out.count() == len(ODD)
    assert sharding.interleave_shards(empty, 3).count() == 0
    with pytest.raises(ValueError):
        sharding.interleave_shards(odd, 0)


# ---- mixing


def water(sizes, share, most, cycle):
    """Targets by raising a level step by step."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: cycle[i % len(cycle)] for i, s in enumerate(names)}
    left, open_, out = share * sum(sizes.values()), set(names), {}
    while True:
        level = left / sum(w[s] for s in open_)
        over = [s for s in open_ if level * w[s] > most * sizes[s]]
        if not over:
            return {**out, **{s: level * w[s] for s in open_}}
        for s in over:
            out[s] = most * sizes[s]
            left -= out[s]
            open_.remove(s)
        if not open_:
            return out


def test_targets_match_a_plain_loop(spark):
    sizes = {"a": 10, "b": 1000, "c": 50, "d": 400, None: 30}
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size bigint")
    got = {r.source: r.target for r in mixing.source_targets(df, 1.5, 2.0).collect()}
    want = water(sizes, 1.5, 2.0, (3, 1, 2))
    assert got.keys() == want.keys() and all(abs(got[s] - want[s]) < 1e-6 for s in want)


def test_mix_comes_near_targets(spark):
    docs, _, _ = corpus(spark, 2000)
    out = mixing.mix_sources(docs).toPandas()
    assert len(out) == 2000
    taken = (out._size * out._copies).groupby(out.source).sum()
    target = out.groupby("source")._target.first()
    assert ((taken - target).abs() <= out.groupby("source")._size.median()).all()
    assert out._copies.between(0, 2).all()
    again = mixing.mix_sources(docs.repartition(3)).toPandas()
    key = lambda d: dict(zip(d.doc_id, d._copies, strict=True))
    assert key(out) == key(again)


def test_mix_keeps_expectations(spark):
    docs = spark.createDataFrame([(i, "w " * (1 + i % 5), "en", "a" if i < 60 else "b", 0, "x") for i in range(90)], DOCS)
    total = np.zeros(90)
    for seed in range(12):
        p = mixing.mix_sources(docs, seed=seed).toPandas().sort_values("doc_id")
        total += p._copies.to_numpy()
    ratio = (p._target / p._source_size).to_numpy()
    assert abs(total.mean() / 12 - ratio.mean()) < 0.15


def test_long_documents_do_not_decide_the_mix(spark):
    rnd = random.Random(9)
    sizes = [(i, "ab"[i % 2], 5000 if i < 6 else rnd.randint(10, 400)) for i in range(400)]
    for seed in range(3):
        out = mixing.mix_sources(spark.createDataFrame(sizes, "doc_id bigint, source string, n bigint"), seed=seed, size=F.col("n")).toPandas()
        off = (out._size * out._copies).groupby(out.source).sum() - out.groupby("source")._target.first()
        assert (off.abs() < 200).all()


def test_mix_of_equal_and_missing_keys(spark):
    rows = [(None if i % 2 else 7, "a" if i % 3 else None, 10) for i in range(900)]
    df = spark.createDataFrame(rows, "doc_id bigint, source string, n bigint")
    out, again = (mixing.mix_sources(x, size=F.col("n")).toPandas() for x in (df, df.repartition(7)))
    count = lambda o: o.fillna({"source": "-", "doc_id": -1}).groupby(["source", "doc_id", "_copies"]).size().to_dict()
    assert len(out) == 900 and count(out) == count(again)
    off = (out._size * out._copies).groupby(out.source.fillna("-")).sum() - out.groupby(out.source.fillna("-"))._target.first()
    assert (off.abs() <= 10).all()


def test_mix_of_odd_rows(odd, empty):
    out = mixing.mix_sources(odd)
    assert out.count() == len(ODD)
    assert out.columns == [*[c for c in odd.columns if c not in ("_size", "_copies")], "_size", "_source_size", "_target", "_copies"]
    assert mixing.mix_sources(empty).count() == 0


# ---- quality rules


def brute_repeats(ws):
    seen = {}
    for i in range(len(ws) - 2):
        seen.setdefault(tuple(ws[i : i + 3]), []).append(i)
    return len({j for at in seen.values() if len(at) > 1 for i in at for j in range(i, i + 3)})


def test_base_counts(spark):
    rnd = random.Random(1)
    texts = [None, "", "a b c a b c", "x\nx\n\n \nx", "a a a a a", "#a $b", "é é\x0bé"] + [" ".join(rnd.choice("abc") for _ in range(n)) for n in (1, 2, 3, 4, 60, 300)]
    df = spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], "doc_id bigint, text string, lang string")
    out = {r.doc_id: r for r in quality_rules.judge_documents(df).collect()}
    for i, t in enumerate(texts):
        ws = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", t or "") if w]
        lines = [x for x in (t or "").split("\n") if x.strip(" \t\n\x0b\x0c\r")]
        assert out[i]._n_words == len(ws)
        assert out[i]._word_chars == sum(map(len, ws))
        assert out[i]._n_repeat_words == brute_repeats(ws)
        assert out[i]._n_dup_lines == len(lines) - len(set(lines))
        assert out[i]._base_failed == (len(ws) < 50 or 100 * brute_repeats(ws) > 50 * len(ws))


def test_divergent_text_goes_and_ordinary_stays(spark):
    rnd = random.Random(2)
    base = [(i, " ".join(rnd.choice(["the", "of", "and", "river", "stone", "walks", "green", "to"]) + rnd.choice(["", "", "s"]) for _ in range(120)), "en") for i in range(60)]
    junk = [(100, " ".join("%$#" + str(rnd.randint(0, 10**6)) for _ in range(120)), "en")]
    out = {r.doc_id: r._kept for r in quality_rules.judge_documents(spark.createDataFrame(base + junk, "doc_id bigint, text string, lang string")).collect()}
    assert not out[100]
    assert all(out[i] for i in range(60))


def test_rules_of_odd_rows(odd, empty):
    out = quality_rules.judge_documents(odd)
    assert out.count() == len(ODD)
    assert out.columns == [*[c for c in odd.columns if c not in ("_kept", "_n_words")], *quality_rules.OUTPUTS[:5], "_base_failed", "_kept", "_class_distance", "_word_distance"]
    assert out.filter("_kept is null").count() == 0
    assert quality_rules.judge_documents(empty).count() == 0


# ---- language


def test_language_profiles(spark):
    rnd = random.Random(4)
    words = {"en": ["the", "quick", "river", "walks", "with", "stone"], "fr": ["été", "maison", "où", "chat", "leçon", "très"], "de": ["straße", "über", "schön", "wälder", "nicht"]}
    rows = [(i, prose(rnd, 30, words[lang := list(words)[i % 3]]), lang) for i in range(120)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    protos = langid.learn_prototypes(df.filter("doc_id < 60"))
    assert list(protos) == ["de", "en", "fr"]
    out = langid.identify(df.filter("doc_id >= 60"), protos).toPandas()
    assert (out.lang == out.lang_pred).all()
    assert out.score.between(0, 1).all()


def test_profiles_equal_plain_hypervectors(spark):
    texts = {"en": ["the river, the stone", "a b"], "fr": ["été où"], "xx": ["12 34"]}
    rows = [(t, k) for k, ts in texts.items() for t in ts]
    got = langid.learn_prototypes(spark.createDataFrame(rows, "text string, lang string"), dims=256)

    def letter(c):
        return np.ones(256) if c is None else np.random.default_rng([langid.SEED, c]).integers(0, 2, 256, np.int8) * 2.0 - 1

    def plain(text):
        s = [0]
        for c in text.lower() + " ":
            p = ord(c) if c.isalpha() else 0
            if p or s[-1]:
                s.append(p)
        if not any(s):
            return np.zeros(256)
        v = sum(np.prod([np.roll(letter(p), 2 - j) for j, p in enumerate(s[i : i + 3])], axis=0) for i in range(len(s) - 2))
        return v / np.linalg.norm(v)

    want = {k: sum(map(plain, ts)) for k, ts in texts.items()}
    assert sorted(got) == ["en", "fr"]
    for k, v in got.items():
        assert np.abs(v - want[k] / np.linalg.norm(want[k])).max() < 1e-5
    asked = ["stone river", "é", "9"]
    found = {r.text: (r.lang_pred, r.score) for r in langid.identify(spark.createDataFrame([(t,) for t in asked], "text string"), got).collect()}
    for t in asked:
        cos = {k: float(plain(t) @ want[k] / np.linalg.norm(want[k])) for k in got}
        best = max(cos, key=cos.get)
        assert found[t] == (("und", 0.0) if t == "9" else (best, pytest.approx(max(0, cos[best]), abs=1e-4)))


def test_language_of_odd_rows(odd, empty):
    protos = langid.learn_prototypes(odd)
    out = langid.identify(odd, protos)
    assert out.columns == [*[c for c in odd.columns if c not in ("lang_pred", "Score")], "lang_pred", "score"]
    with pytest.raises(ValueError, match="lang_pred"):
        langid.identify(odd, protos, text="lang_pred")
    got = {(r.doc_id, r.text): r.lang_pred for r in out.collect()}
    assert got[1, None] == got[2, ""] == got[6, "#### $$$$ ||||"] == "und"
    assert langid.identify(empty, protos).count() == 0
    assert langid.learn_prototypes(empty) == {}
    assert {r.lang_pred for r in langid.identify(odd, {}).collect()} == {"und"}


# ---- hashing


def test_word_hashes_tell_words_apart():
    texts = ["one two", "Two one", "", "été one", "a" * 5000, "x" + " " * 9 + "y\x0bz"]
    h, n = textkit.word_hashes([t.encode() for t in texts])
    assert list(n) == [2, 2, 0, 2, 1, 3]
    assert h[0] == h[3] == h[5] and h[1] == h[2] and len({*h[:2], h[4], *h[6:]}) == 7


# ---- decontamination


def test_items_are_found_wherever_they_stand(spark):
    docs, vocabulary, rnd = corpus(spark, 60)
    items = [(i, prose(rnd, n, vocabulary)) for i, n in enumerate([3, 5, 8, 20, 45, 90])] + [(90, None), (91, ""), (92, "!!!")]
    rows = docs.select("doc_id", "text").collect()
    planted = [(1000 + i, prose(rnd, rnd.randint(0, 300), vocabulary) + " " + t.upper().replace(" ", ",  ") + ". " + prose(rnd, rnd.randint(0, 300), vocabulary)) for i, t in items if t and t != "!!!"]
    planted += [(2000, items[0][1]), (2001, None), (2002, "")]
    df = spark.createDataFrame([(r.doc_id, r.text) for r in rows] + planted, "doc_id bigint, text string")
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(df, bench).collect()}
    sets = {i: decontaminate.shingles(t) for i, t in items}
    want = {(d, i) for d, t in [(r.doc_id, r.text) for r in rows] + planted for i, s in sets.items() if s and len(s & decontaminate.shingles(t)) >= 0.8 * len(s)}
    assert got == want
    assert {(1000 + i, i) for i in range(1, 6)} <= got and (2000, 0) in got


def test_scattered_items_are_found(spark):
    rnd = random.Random(21)
    vocabulary = ["".join(rnd.choice("abcdefghijklm") for _ in range(6)) for _ in range(4000)]
    items = [(i, prose(rnd, 125, vocabulary).split()) for i in range(40)]
    rows = []
    for i, w in items:
        pieces = [w[j : j + 25] for j in range(0, 125, 25)]  # of 121 shingles 105 are left
        rows.append((i, " ".join(prose(rnd, 300, vocabulary) + " " + " ".join(p) for p in pieces)))
        rows.append((100 + i, " ".join([prose(rnd, 900, vocabulary), *w[:62], prose(rnd, 900, vocabulary), *w[62:]])))
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in items], "item_id bigint, text string")
    want = {(d, i) for i, _ in items for d in (i, 100 + i)}
    exact = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(df, bench, exact=True).collect()}
    found = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(df, bench).collect()}
    assert exact == want and found <= want and len(found) >= 0.98 * len(want)


def test_decontamination_of_odd_rows(odd, empty, spark):
    bench = spark.createDataFrame([(1, "no key here at all")], "item_id bigint, text string")
    assert [(r.doc_id, r.item_id) for r in decontaminate.contaminated(odd, bench).collect()] == [(None, 1)]
    assert decontaminate.contaminated(empty, bench).count() == 0
    assert decontaminate.contaminated(odd, bench.limit(0)).count() == 0


# ---- n-gram join


def brute_join(rows, size, percent):
    def shingles(t):
        w = [x for x in __import__("re").split(r"[\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")) if x]
        return {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set()

    s = [(k, shingles(t)) for k, t in rows]
    top = {k: k for k, _ in rows}

    def find(a):
        while top[a] != a:
            a = top[a]
        return a

    links = dict.fromkeys(range(len(s)), 0)
    for i, (a, x) in enumerate(s):
        for j, (b, y) in enumerate(s):
            if i != j and x and y and 100 * len(x & y) >= percent * len(x | y):
                links[i] += 1
                p, q = find(a), find(b)
                top[max(p, q)] = min(p, q)
    return {k: (len(x), find(k), links[i]) for i, (k, x) in enumerate(s)}


@pytest.mark.parametrize(("size", "percent", "chunk"), [(4, 85, 512), (5, 80, 7), (2, 60, 512)])
def test_join_equals_brute_force(spark, monkeypatch, size, percent, chunk):
    monkeypatch.setattr(ngram_join, "CHUNK_DOCS", chunk)
    monkeypatch.setattr(ngram_join, "BATCH_TOKENS", 500)
    rnd = random.Random(size)
    vocabulary = ["".join(rnd.choice("abcdef") for _ in range(3)) for _ in range(80)]
    common_part = prose(rnd, 40, vocabulary)
    rows, n = [], 0
    for _ in range(25):
        base = prose(rnd, rnd.randint(1, 60), vocabulary).split()
        for _ in range(rnd.randint(1, 6)):
            w = base[:]
            for _ in range(rnd.randint(0, 2)):
                w[rnd.randrange(len(w))] = rnd.choice(vocabulary)
            rows.append((n, " ".join(w) + (f" {common_part}" if rnd.random() < 0.3 else "")))
            n += 1
    rows += [(n, None), (n + 1, ""), (n + 2, "Same Text"), (n + 3, "same\ttext"), (n + 4, "same text")]
    rnd.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.n_links) for r in ngram_join.jaccard_components(df, size, percent).collect()}
    assert got == brute_join(rows, size, percent)


def test_join_of_odd_rows(odd, empty):
    out = {(r.doc_id, r.component_id) for r in ngram_join.jaccard_components(odd).collect()}
    assert (None, None) in out and (4, 4) in out and (1, 1) in out
    assert ngram_join.jaccard_components(odd).count() == len(ODD)
    assert ngram_join.jaccard_components(empty).count() == 0
    with pytest.raises(ValueError, match="integers"):
        ngram_join.jaccard_components(odd, key="lang")


def test_components_of_chains(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (7, 7)], "a bigint, b bigint")
    got = {r.node: r.component for r in common.connected_components(chain).collect()}
    assert all(got[i] == 0 for i in range(41)) and got[101] == got[100] == 100
    assert common.connected_components(chain.limit(0)).count() == 0


# ---- toxicity


def test_toxic_words_score_high(spark):
    rnd = random.Random(6)
    plain = ["river", "stone", "green", "walks", "light", "house", "garden", "window"]
    rows, labels = [], []
    for i in range(300):
        words = prose(rnd, 60, plain).split()
        if i % 4 == 0:
            words[rnd.randrange(60)] = rnd.choice(["vilewort", "grimscum"])
        rows.append((i, " ".join(words)))
        labels.append((i, int(i % 4 == 0)))
    rows += [(1000, None), (1001, ""), (1002, "12 34")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    marks = spark.createDataFrame(labels + [(5000, None)], "doc_id bigint, toxic int")
    out = {r.doc_id: r.score for r in toxicity.score_toxicity(docs, marks, learn_from=lambda k: k % 3 != 1).collect()}
    held = [i for i in range(300) if i % 3 == 1]
    assert all((out[i] >= 0.7) == (i % 4 == 0) for i in held)
    assert all(0 <= s <= 1 for s in out.values()) and out[1000] == out[1001] == out[1002] < 0.7


def plain_ratios(train, words):
    """log P(toxic) - log P(ordinary) of each word by Kneser-Ney models in plain loops; ``train`` has (words, toxic)."""
    from collections import Counter
    from math import log

    n, d = toxicity.ORDER, toxicity.DISCOUNT
    spell = lambda w: "^" * (n - 1) + w + "^"
    grams = lambda w: [spell(w)[i - n + 1 : i + 1] for i in range(n - 1, len(spell(w)))]
    own = [Counter(), Counter()]
    for ws, toxic in train:
        own[toxic].update(g for w in ws for g in grams(w))
    level, shared = set(own[0]) | set(own[1]), {}
    for k in range(n - 1, 0, -1):
        shared[k] = Counter(g[1:] for g in level)
        level = set(shared[k])

    def backed(counts, g, lower):
        after = {x: c for x, c in counts.items() if x[:-1] == g[:-1] and c}
        total = sum(after.values())
        return (max(counts.get(g, 0) - d, 0) + d * len(after) * lower) / total if total else lower

    def ratio(g):
        p = 1 / 1024
        for k in range(1, n):
            p = backed(shared[k], g[-k:], p)
        return log(backed(own[1], g, p)) - log(backed(own[0], g, p))

    return [sum(map(ratio, grams(w))) for w in words]


@pytest.mark.parametrize("rows", [1 << 21, 300])
def test_ratios_equal_plain_kneser_ney(spark, monkeypatch, rows):
    monkeypatch.setattr(toxicity, "PART_ROWS", rows)
    rnd = random.Random(11)
    make = lambda a: "".join(rnd.choice(a) for _ in range(rnd.randint(1, 7)))
    train = [(i, [make("abé") if i % 3 else make("abx") for _ in range(12)], int(i % 3 == 0)) for i in range(15)]
    labelled = spark.createDataFrame([(" ".join(ws), t, i % toxicity.FOLDS) for i, ws, t in train], "text string, toxic int, fold int")
    model = common.materialize(toxicity.model_table(toxicity.count_grams(labelled)))
    asked = ["abé", "x", "bax", "zebra", "ab xa-b x"]
    rows = spark.createDataFrame([(t, t, toxicity.FOLDS) for t in asked], "k string, text string, model int")
    got = {r.k: r.ratio for r in toxicity.score_texts(rows, model).collect()}
    for t in asked:
        assert abs(got[t] - max(plain_ratios([(ws, t) for _, ws, t in train], t.replace("-", " ").split()))) < 1e-4
    assert got["zebra"] != 0


def test_strongest_part_of_a_text():
    x = np.arange(100.0)
    assert toxicity.strongest_mean(x) == np.mean([96, 97, 98, 99]) and toxicity.strongest_mean(x[:5]) == 4 and toxicity.strongest_mean(x[:0]) == 0


def test_isotonic_curve():
    places, chances = toxicity.isotonic(np.array([1.0, 2, 3, 4, 4]), np.array([0.0, 1, 0, 1, 1]))
    assert places == sorted(places) and chances == sorted(chances) and chances[0] < 0.3 < 0.6 < chances[-1]
    assert toxicity.isotonic(np.zeros(0), np.zeros(0)) == ([0.0], [0.02])


def test_toxicity_without_labels(odd, empty, spark):
    none = spark.createDataFrame([], "doc_id bigint, toxic int")
    assert all(r.score < 0.5 for r in toxicity.score_toxicity(odd, none).collect())
    some = spark.createDataFrame([(4, 1), (5, 0)], "doc_id bigint, toxic int")
    assert toxicity.score_toxicity(odd, some).count() == len(ODD)
    assert toxicity.score_toxicity(empty, some).count() == 0


# ---- quality


def test_co_training_separates_junk(spark):
    rnd = random.Random(8)
    words = ["river", "stone", "green", "walks", "light", "house"]
    rows, labels = [], []
    for i in range(400):
        bad = i % 4 == 0
        text = " ".join("###|" + str(rnd.randint(0, 9)) for _ in range(60)) if bad else prose(rnd, 60, words) + "."
        rows.append((i, text, "en", f"s{i % 5}", len(text), "x"))
        if i < 250:
            labels.append((i, int(not bad)))
    out = cotraining.classify_quality(spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, "doc_id bigint, quality int")).toPandas()
    assert ((out.score >= 0.5) == (out.doc_id % 4 != 0)).mean() > 0.98
    assert len(out) == 400


def test_rounds_equal_a_plain_loop(spark, monkeypatch):
    """Both classifiers' models from all unlabelled rows, against lists of training rows that grow by sorting."""
    monkeypatch.setattr(cotraining, "SHARE", 0.2)
    rnd = np.random.default_rng(3)
    rows, labels = [], []
    for i in range(900):
        good = rnd.random() < 0.6
        bad_words = rnd.integers(0, 25) if good else rnd.integers(15, 40)
        text = " ".join("###|1" if j < bad_words else "".join(rnd.choice(list("abcdeXY19."), rnd.integers(2, 9))) for j in range(40))
        rows.append((i, text, "en", f"s{rnd.integers(0, 3) + 2 * int(good)}", int(rnd.integers(1, 10**6)), "x"))
        if i < 300:
            labels.append((i, int(good)))
    docs, marks = spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, "doc_id bigint, quality int")
    end = []
    train = cotraining.co_train
    monkeypatch.setattr(cotraining, "co_train", lambda r: end.append((r, train(r))) or end[0][1])
    cotraining.classify_quality(docs, marks)
    p = end[0][0].toPandas()
    x, page = np.array(p.f.tolist()), p[["s", "l", "z"]].to_numpy()
    pool, known = p.role.to_numpy() == cotraining.POOL, p.role.to_numpy() == cotraining.TRAIN
    assert pool.sum() == 600 and 100 < known.sum() < 200
    y = p.y.to_numpy()
    own = [(list(np.flatnonzero(known)), list(y[known].astype(int))) for _ in (0, 1)]  # rows and labels of each view
    share, free = y[known].mean(), [pool.copy(), pool.copy()]

    def fit():
        sums = np.zeros(cotraining._SUMS)
        for a in (0, 1):
            labels_ = [np.full(len(own[a][0]), -1), np.full(len(own[a][0]), -1)]
            labels_[a] = np.array(own[a][1])
            sums += cotraining.add_up(x[own[a][0]], page[own[a][0]], *labels_)
        return cotraining.models(sums)

    for _ in range(cotraining.ROUNDS):
        odds = cotraining.odds_of(fit(), x, page)
        new = []
        for a in (0, 1):
            for label, side, n in ((0, -odds[a], int(120 * (1 - share)) + 1), (1, odds[a], int(120 * share))):
                sure = [i for i in range(len(x)) if free[a][i] and side[i] >= np.log(19)]
                best, left = [], n
                for step in sorted({int(min(side[i], cotraining.TOP) * cotraining.STEPS) for i in sure}, reverse=True):
                    tied = [i for i in sure if int(min(side[i], cotraining.TOP) * cotraining.STEPS) == step]
                    # Of the last ones, equally sure, hashes take the part that is still wanted.
                    best += [i for i in tied if left >= len(tied) or p.h[i] < left / len(tied)]
                    left -= len(tied)
                    if left <= 0:
                        break
                new.append((1 - a, best, label))
        for view, best, label in new:
            free[1 - view][best] = False
            own[view][0].extend(best)
            own[view][1].extend([label] * len(best))
    assert min(len(o[0]) for o in own) > known.sum() + 50
    for got, want in zip(cotraining.odds_of(end[0][1], x, page), cotraining.odds_of(fit(), x, page), strict=True):
        assert np.abs(got - want).max() < 1e-4


def test_both_views_help_each_other(spark):
    """A source that no labelled row has is learnt from the text's pseudo-labels."""
    rnd = random.Random(12)
    words = ["river", "stone", "green", "walks", "light", "house"]
    rows, labels = [], []
    for i in range(1200):
        bad = i % 3 == 0
        text = " ".join("###|" + str(rnd.randint(0, 9)) for _ in range(60)) if bad else prose(rnd, 60, words) + "."
        rows.append((i, text, "en", ("spam" if bad else "fine") if i >= 300 else "old", 400, "x"))
        if i < 300:
            labels.append((i, int(not bad)))
    out = cotraining.classify_quality(spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, "doc_id bigint, quality int")).toPandas().sort_values("doc_id")
    late = out[out.doc_id >= 300]
    assert late[late.doc_id % 3 == 0].page_score.max() < late[late.doc_id % 3 != 0].page_score.min()


def test_quality_of_odd_rows_after_a_fit(odd, spark):
    rnd = random.Random(13)
    rows = [(100 + i, prose(rnd, 40, ["river", "stone", "walks"]) if i % 2 else "#| 1 " * 40, "en", "a", 200, "x") for i in range(120)]
    rows += [(500, "word " * 200_000, "en", "a", 10**6, "x"), (501, None, None, None, None, None)]
    labels = [(100 + i, i % 2) for i in range(120)] + [(100, 0), (101, 0), (102, None), (None, 1), (103, 7)]
    docs = spark.createDataFrame(rows, DOCS).unionByName(odd.select("doc_id", "text", "lang", "source", "n_chars", "extra"))
    out = cotraining.classify_quality(docs, spark.createDataFrame(labels, "doc_id bigint, quality int"))
    got = out.toPandas()
    assert len(got) == len(rows) + len(ODD) and got.score.between(0, 1).all() and got.score.nunique() > 2


def test_quality_of_odd_rows(odd, empty, spark):
    labels = spark.createDataFrame([(4, 1)], "doc_id bigint, quality int")
    assert cotraining.classify_quality(odd, labels).count() == len(ODD)
    assert cotraining.classify_quality(empty, labels).count() == 0


# ---- WARC


def test_round_trip_with_magic_inside_payloads(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "PIECE_BYTES", 700)
    monkeypatch.setattr(warc, "HEADER_BYTES", 600)
    fake = "WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:666>\r\nContent-Length: 4\r\n\r\nevil\r\n\r\n"
    html = ["plain", fake, "x" + fake * 3, None, "", "dup", "dup", "dup", "é" * 900, fake[:20], "WARC/1.0\r\n" * 50]
    rows = [(i, f"http://h/{i} x\ny", h) for i, h in enumerate(html)] + [(None, None, "dup")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").repartition(2)
    path = f"file://{tmp_path}/w"
    warc.write_archives(pages, path)
    out = {r.page_id: r for r in warc.read_archives(spark, path).collect()}
    assert len(out) == len(rows) and 666 not in out
    for i, h in enumerate(html):
        r = out[i]
        same = [j for j, x in enumerate(html) if (x or "") == (h or "")]
        assert r.payload_bytes == len((h or "").encode())
        assert r.record_type == ("response" if i == max(same) else "revisit")
        assert r.refers_to == (None if i == max(same) else max(same))
        if r.record_type == "response":
            assert bytes(r.payload).decode() == (h or "") and r.intact
    assert out[None].record_type == "revisit" and out[None].refers_to == 7
    import base64
    import hashlib

    assert out[0].payload_digest == base64.b32encode(hashlib.sha1(b"plain").digest()).decode()


def test_pages_of_odd_rows(spark, tmp_path):
    rows = [(1, "u", "a"), (1, "u", "a"), (1, None, "b"), (None, "v", None), (2, "w", ""), (3, "x", "z" * 300_000)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumns({c: F.lit("x") for c in ("payload", "Record_Type", "_sha", "_row")})
    out = warc.with_revisits(pages)
    assert out.columns == ["page_id", "url", "_sha", "_row", "payload", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    # Rows that repeat a response's key are responses too.
    assert sorted((r.page_id or 0, r.payload[:1], r.record_type) for r in out.collect()) == sorted([(1, "a", "response"), (1, "a", "response"), (1, "b", "response"), (0, "", "revisit"), (2, "", "response"), (3, "z", "response")])
    path = f"file://{tmp_path}/odd"
    warc.write_archives(pages, path)
    assert sorted((r.page_id or 0, r.payload_bytes) for r in warc.read_archives(spark, path).collect()) == sorted((k or 0, len(h or "")) for k, _, h in rows)


def test_small_payloads_are_not_revisited(spark, tmp_path):
    pages = spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abcdef"), (4, "u", "abcdef")], "page_id bigint, url string, html string")
    out = {r.page_id: r.record_type for r in warc.with_revisits(pages, min_bytes=5).collect()}
    assert out == {1: "response", 2: "response", 3: "revisit", 4: "response"}
    path = f"file://{tmp_path}/e"
    warc.write_archives(pages.limit(0), path)
    assert warc.read_archives(spark, path).count() == 0


def test_archives_are_bounded_by_bytes(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 20_000)
    rows = [(i, f"http://h/{i}", f"{i} " + "x" * (50_000 if i == 17 else 200 if i < 40 else 4000)) for i in range(60)]
    path = tmp_path / "b"
    warc.write_archives(spark.createDataFrame(rows, "page_id bigint, url string, html string").coalesce(2), f"file://{path}")
    sizes = sorted(f.stat().st_size for f in path.rglob("part-*"))
    assert len(sizes) > 8 and sizes[-1] > 50_000 and sizes[-2] <= 20_000
    assert sorted((r.page_id, bytes(r.payload).decode()) for r in warc.read_archives(spark, f"file://{path}").collect()) == [(i, h) for i, _, h in rows]


def test_long_headers_and_broken_chains(spark, tmp_path):
    rows = [(0, "http://h/0", "a"), (1, "data:," + "x" * 100_000, "b"), (2, "http://h/WARC/1.0", "c"), (3, "http://h/3", "d")]
    path = f"file://{tmp_path}/l"
    warc.write_archives(spark.createDataFrame(rows, "page_id bigint, url string, html string").coalesce(1), path)
    out = warc.read_archives(spark, path).collect()
    assert sorted((r.page_id, r.url, bytes(r.payload).decode()) for r in out) == rows and all(r.intact for r in out)
    for name, cut in (("cut", lambda b: b[:-30]), ("tail", lambda b: b + b"rest"), ("head", lambda b: b"x" + b)):
        (tmp_path / name).mkdir()
        for f in (tmp_path / "l").rglob("part-*"):
            (tmp_path / name / f.name).write_bytes(cut(f.read_bytes()))
        with pytest.raises(ValueError, match="not with the file"):
            warc.read_archives(spark, f"file://{tmp_path}/{name}").count()


# ---- token counts


@pytest.fixture(scope="module")
def counter():
    with open(token_counts.VOCABULARY, "rb") as f:
        return token_counts.Counter(f.read())


def test_edits_equal_encoding_anew(counter):
    rnd = random.Random(1)
    for _ in range(300):
        alphabet = rnd.choice(["ab 'st\n  1!é", "a  \n\t ", "'re ll's x9", "abc def, "])
        text = "".join(rnd.choice(alphabet) for _ in range(rnd.choice([0, 3, 50, 400, 3000])))
        tree = token_counts.TokenTree(text, counter)
        for _ in range(rnd.randint(1, 5)):
            a = rnd.randint(0, len(text))
            b = min(len(text), a + rnd.choice([0, 1, 2, 5, 100, 700]))
            new = "".join(rnd.choice(alphabet) for _ in range(rnd.choice([0, 1, 7, 60, 6000])))
            tree.edit(a, b, new)
            text = text[:a] + new + text[b:]
            assert tree.text() == text
            assert tree.total() == len(counter.encoding.encode_ordinary(text))


def test_an_edit_touches_little(counter):
    tree = token_counts.TokenTree("some plain words here " * 5000, counter)
    assert tree.edit(30000, 30004, "other") < 10


def test_kept_trees_are_edited_again_and_again(spark, counter, monkeypatch):
    rnd = random.Random(5)
    texts = {i: "".join(rnd.choice("ab 'st\n  1!é") for _ in range(rnd.choice([0, 5, 900, 4000]))) for i in range(12)} | {99: None}
    trees = common.materialize(token_counts.build_trees(spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")))
    e = "doc_id bigint, edits array<struct<start:int,end:int,text:string>>"
    for _ in range(3):
        edits = {i: [(a := rnd.randint(0, len(t)), a + rnd.randint(0, 40), rnd.choice(["", "x", " new 'words" * 9]))] for i, t in texts.items() if t and rnd.random() < 0.7}
        trees = common.materialize(token_counts.apply_edits(trees.join(spark.createDataFrame(list(edits.items()), e), "doc_id", "left")))
        texts |= {i: texts[i][:a] + new + texts[i][min(b, len(texts[i])) :] for i, [(a, b, new)] in edits.items()}
        for r in trees.collect():
            t = texts[r.doc_id] or ""
            assert (r.text or "") == t and sum(r.leaf_chars) == len(t)
            assert sum(r.leaf_tokens) == len(counter.encoding.encode_ordinary(t)) and sum(r.leaf_pieces) == len(counter.pattern.findall(t))
            assert r.n_edits == len(edits.get(r.doc_id, []))


def test_a_kept_tree_encodes_touched_leaves_only(counter):
    text = "some plain words here " * 5000
    kept = token_counts.TokenTree(text, counter).leaf_sums()
    asked = []

    class Watch:
        pattern = counter.pattern

        def __call__(self, pieces):
            asked.append(len(pieces))
            return counter(pieces)

    tree = token_counts.TokenTree(text, Watch(), kept)
    assert tree.total() == len(counter.encoding.encode_ordinary(text)) and not asked
    assert tree.edit(30000, 30004, "other") < 10 and sum(asked) <= 2 * token_counts.LEAF


def test_counts_with_an_edits_column(spark, odd, empty):
    e = "array<struct<start:int,end:int,text:string>>"
    df = spark.createDataFrame([(1, "mail me at a@b.cd now", [(11, 17, "[X]"), (12, 14, "lost")]), (2, None, None), (3, "abc", [(0, 99, "")])], f"doc_id bigint, text string, edits {e}")
    out = {r.doc_id: r for r in token_counts.count_after_edits(df).collect()}
    assert (out[1].n_edits, out[1].n_chars_after) == (1, len("mail me at [X] now"))
    assert (out[2].n_tokens, out[2].n_tokens_after) == (0, 0)
    assert (out[3].n_tokens_after, out[3].n_chars_after) == (0, 0)
    assert token_counts.count_after_edits(odd, token_counts.redactions).count() == len(ODD)
    assert token_counts.count_after_edits(empty, token_counts.redactions).count() == 0


def test_redactions():
    text = "write to a.b@c.example or https://x.y/z, call +1 234 567 8901."
    assert [t for _, _, t in token_counts.redactions(text)] == ["[EMAIL]", "[URL]", "[NUMBER]"]


def test_folds(spark):
    got = {r.i: r.h for r in spark.range(50).select(F.col("id").alias("i"), langid.held_out(F.col("id"), 3, 1).alias("h")).collect()}
    assert got == {i: zlib.crc32(str(i).encode()) % 3 == 1 for i in range(50)}


def test_long_texts_are_bundled_in_pieces(monkeypatch):
    rnd = random.Random(1)
    texts = ["".join(rnd.choice("abc é. ") for _ in range(n)) for n in (5, 300, 5000, 0, 40, 9000, 20)] + [None]
    bundler = langid.Bundler(256)
    whole = bundler.bundle(texts)
    monkeypatch.setattr(langid, "BLOCK_CHARS", 700)
    assert (bundler.bundle(texts) == whole).all()

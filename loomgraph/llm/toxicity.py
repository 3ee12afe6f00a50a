"""Toxicity by class-conditional Kneser-Ney models.

Two models, of toxic and of ordinary text, give each letter of a word a probability after
the letters before it.  Each discounts its own counts of the longest n-grams and backs
off to one shared model of shorter ones, built from the continuation counts of both
classes, so an expression that neither or only one class has seen is not taken for proof.
A word scores the difference of its two log-likelihoods, and a text the mean difference a
word over the strongest part of its words.  The mean over all words ranks badly: a toxic
text holds a few toxic words in a hundred, and the rest says only which subjects and
languages the labelled toxic rows happened to have.  On the held-out rows of the tables at
0.1 it reaches an area of 0.75 under the curve, the strongest word alone 0.93, the strongest
thirty-second 0.96.

An isotonic curve, fitted on labelled rows scored by models that had not seen their fold,
turns the score into a chance.  Where toxic rows are rare, the cut of the best F1 on those rows lies at
a chance below one half; the curve is then raised, in log-odds, so that the cut comes to stand at CUT.

All counts stay in Spark and no n-gram is left out: the shared model and both classes'
probabilities are joins and sums over the table of n-grams.  What a word's letters look up is sent
to the executors in parts of bounded size, one pass over the documents a part.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomgraph.llm.common import bound_batches, discard, load, materialize
from loomgraph.llm.langid import held_out
from loomgraph.llm.textkit import mix

ORDER, SYMBOL_BITS, DISCOUNT = 6, 10, 0.75
#: The part of a text's words that counts is one in so many, rounded up.
STRONGEST = 32
#: Folds of labelled rows; each is scored by a model of the others to fit the curve.
FOLDS = 5
#: The score from which a text counts as toxic.
CUT = 0.7
#: Labelled rows that the curve is fitted on, the default of a parameter.
CALIBRATION_ROWS = 20_000
#: Rows of the model that one pass sends to the executors: 64 MB.
PART_ROWS = 1 << 21
#: Words whose score a worker keeps; beyond it, it starts anew.
KEPT_WORDS = 1 << 20
_MASK = (1 << SYMBOL_BITS) - 1
#: Marks the key of a context among those of n-grams.
_CONTEXT = 1 << 62
CHUNK_CHARS = 1 << 20
#: N-grams that a task counts before it passes the counts on.
TALLY_GRAMS = 1 << 22
_POWER = 0x5851F42D4C957F2D
_POWER_INVERSE = pow(_POWER, -1, 1 << 64)
_SCATTER = np.random.default_rng(20240118).integers(1, 2**63, _MASK + 1, dtype=np.uint64)

_fold: list[np.ndarray] = []


def _symbols() -> np.ndarray:
    """Lower-cased letters as 1 to 1023, all else 0."""
    if not _fold:
        n = 0x110000
        letter = np.fromiter((chr(c).isalpha() for c in range(n)), bool, n)
        lower = np.fromiter((ord(x) if len(x := chr(c).lower()) == 1 else c for c in range(n)), np.int64, n)
        _fold.append(np.where(letter, lower % _MASK + 1, 0))
    return _fold[0]


def _words(texts: list[str | None]):
    """(symbols of all texts, first and last position of each word, words of each text); words are runs of letters."""
    rows = [np.frombuffer(f" {t if isinstance(t, str) else ''} ".encode("utf-32-le", "surrogatepass"), np.uint32) for t in texts]
    s = _symbols()[np.concatenate(rows)] if rows else np.zeros(0, np.int64)
    edge = np.flatnonzero(np.diff((s != 0).view(np.int8)))
    starts, stops = edge[0::2] + 1, edge[1::2] + 1
    return s, starts, stops, np.diff(np.searchsorted(starts, np.cumsum([len(r) for r in rows])), prepend=0)


def _hashes(s: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word."""
    power = np.full(len(s), _POWER, np.uint64)
    inverse = np.full(len(s), _POWER_INVERSE, np.uint64)
    power[:1] = inverse[:1] = 1
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_SCATTER[s] * np.multiply.accumulate(power), dtype=np.uint64)))
    return mix((sums[stops] - sums[starts]) * np.multiply.accumulate(inverse)[starts] + (stops - starts).astype(np.uint64))


def _codes(s: np.ndarray, starts: np.ndarray, stops: np.ndarray):
    """(n-grams of the words in order, n-grams of each word): one per letter and one for the end, a symbol of its own."""
    sizes = stops - starts + 1
    first = np.cumsum(sizes) - sizes
    own = np.arange(sizes.sum()) - np.repeat(first, sizes)
    letters = np.where(own < np.repeat(sizes - 1, sizes), s[np.minimum(np.repeat(starts, sizes) + own, max(len(s) - 1, 0))], 0)
    code = letters.copy()
    for j in range(1, ORDER):
        code[j:] |= np.where(own[j:] >= j, letters[:-j], 0) << (SYMBOL_BITS * j)
    return code, sizes


def _chunks(texts: list):
    low, used = 0, 0
    for i, t in enumerate(texts):
        used += len(t or "")
        if used >= CHUNK_CHARS:
            yield low, texts[low : i + 1]
            low, used = i + 1, 0
    if low < len(texts):
        yield low, texts[low:]


def count_grams(labelled: DataFrame) -> DataFrame:
    """(gram, n0, n1, ...): counts by 2 * fold + toxic, from columns text, toxic and fold."""
    kinds = 2 * FOLDS

    def summed(codes: list, of: list) -> pd.DataFrame:
        code, kind = np.concatenate(codes), np.concatenate(of)
        order = np.lexsort((kind, code))
        code, kind = code[order], kind[order]
        at = np.flatnonzero(np.concatenate(([True], (code[1:] != code[:-1]) | (kind[1:] != kind[:-1]))))
        return pd.DataFrame({"gram": code[at], "kind": kind[at].astype(np.int32), "n": np.diff(np.append(at, len(code)))})

    def tally(frames):
        codes, of, used = [], [], 0
        for f in frames:
            kind = (2 * f["fold"] + f["toxic"]).to_numpy(np.int8)
            for low, run in _chunks(f["text"].tolist()):
                s, starts, stops, n = _words(run)
                code, sizes = _codes(s, starts, stops)
                codes.append(code)
                of.append(np.repeat(np.repeat(kind[low : low + len(run)], n), sizes))
                used += len(code)
                if used >= TALLY_GRAMS:
                    yield summed(codes, of)
                    codes, of, used = [], [], 0
        if used:
            yield summed(codes, of)

    parts = labelled.select("text", F.col("toxic").cast("int"), F.col("fold").cast("int")).mapInPandas(tally, "gram bigint, kind int, n bigint")
    return parts.groupBy("gram").agg(*[F.sum(F.when(F.col("kind") == k, F.col("n")).otherwise(0)).alias(f"n{k}") for k in range(kinds)])


def _shared(grams: DataFrame) -> DataFrame:
    """(suffix, shared): the shared model's probability of an n-gram's last letter after the shorter context.

    A suffix counts the letters that stand before it in distinct n-grams.  No window is wider than the alphabet.
    """
    types, levels = grams.select("gram"), []
    for k in range(ORDER - 1, 0, -1):
        types = types.groupBy(F.col("gram").bitwiseAND((1 << (SYMBOL_BITS * k)) - 1).alias("gram")).agg(F.count("*").alias("n"))
        levels.append((k, types))
    prob = None
    for k, level in reversed(levels):
        after = Window.partitionBy(F.shiftright("gram", SYMBOL_BITS))
        total = F.sum("n").over(after)
        own, weight = (F.col("n") - DISCOUNT) / total, DISCOUNT * F.count("*").over(after) / total
        level = level.select("gram", own.alias("own"), weight.alias("weight"))
        if prob is None:
            prob = level.select("gram", (F.col("own") + F.col("weight") * (1 / (_MASK + 1))).alias("p"))
            continue
        below = F.col("gram").bitwiseAND((1 << (SYMBOL_BITS * (k - 1))) - 1)
        shorter = prob.select(F.col("gram").alias("_below"), F.col("p").alias("_p"))
        prob = level.join(shorter, below == F.col("_below")).select("gram", (F.col("own") + F.col("weight") * F.col("_p")).alias("p"))
    return prob.select(F.col("gram").alias("suffix"), F.col("p").alias("shared"))


def model_table(counts: DataFrame) -> DataFrame:
    """(context, key, r0, r1, ...): log P(toxic) - log P(ordinary) of every n-gram and context under every model.

    Model m below FOLDS leaves fold m out; the last takes all.  After a known context a letter that was not
    seen there differs by the context's two weights of the shared model; after an unknown one by nothing.
    """
    suffix = F.col("gram").bitwiseAND((1 << (SYMBOL_BITS * (ORDER - 1))) - 1)
    rows = counts.withColumn("suffix", suffix).join(_shared(counts), "suffix").withColumn("context", F.shiftright("gram", SYMBOL_BITS))
    after = Window.partitionBy("context")

    def ends(t: int, m: int) -> tuple[Column, Column]:
        """(log probability of the n-gram, log weight of the shared model) of class t under model m."""
        c = sum((F.col(f"n{2 * f + t}") for f in range(FOLDS) if f != m), F.lit(0))
        total, kinds = F.sum(c).over(after), F.count_if(c > 0).over(after)
        back = F.when(total > 0, DISCOUNT * kinds / total).otherwise(1.0)
        return F.log(F.greatest(c - DISCOUNT, F.lit(0.0)) / F.greatest(total, F.lit(1)) + back * F.col("shared")), F.log(back)

    both = [(ends(1, m), ends(0, m)) for m in range(FOLDS + 1)]
    wide = rows.select("context", "gram", *[(t[0] - o[0]).alias(f"r{m}") for m, (t, o) in enumerate(both)], *[(t[1] - o[1]).alias(f"c{m}") for m, (t, o) in enumerate(both)])
    values = lambda x: [F.col(f"{x}{m}").cast("float").alias(f"r{m}") for m in range(FOLDS + 1)]
    contexts = wide.groupBy("context").agg(*[F.first(f"c{m}").alias(f"c{m}") for m in range(FOLDS + 1)])
    return wide.select("context", F.col("gram").alias("key"), *values("r")).union(contexts.select("context", F.col("context").bitwiseOR(_CONTEXT), *values("c")))


class Part:
    """A part of the model: sorted keys with a row of values each.  Words keep what the part adds to them."""

    def __init__(self, keys: np.ndarray, values: np.ndarray, part: int, parts: int):
        order = np.argsort(keys)
        self.keys, self.values = keys[order], values[order]
        self.part, self.parts = part, parts
        self.known, self.sums = np.empty(0, np.uint64), np.empty((0, values.shape[1]), np.float32)

    def _find(self, keys: np.ndarray) -> np.ndarray:
        if len(self.keys) == 0:
            return np.full(len(keys), -1)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, at, -1)

    def _sum(self, s: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
        code, sizes = _codes(s, starts, stops)
        own = np.flatnonzero(part_of(code >> SYMBOL_BITS, self.parts) == self.part)
        at = self._find(code[own])
        new = np.flatnonzero(at < 0)
        at[new] = self._find((code[own[new]] >> SYMBOL_BITS) | _CONTEXT)
        v = np.zeros((len(code), self.values.shape[1]))
        v[own[at >= 0]] = self.values[at[at >= 0]]
        return np.add.reduceat(v, np.cumsum(sizes) - sizes, axis=0).astype(np.float32)

    def words(self, s: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
        """What the part adds to the log-ratio of each word (rows) under each model."""
        if len(starts) == 0:
            return np.zeros((0, self.values.shape[1]), np.float32)
        hashes, first, at = np.unique(_hashes(s, starts, stops), return_index=True, return_inverse=True)
        fresh = ~np.isin(hashes, self.known, assume_unique=True)
        if fresh.any():
            if len(self.known) + fresh.sum() > KEPT_WORDS:
                self.known, self.sums = self.known[:0], self.sums[:0]
                fresh[:] = True
            some = first[fresh]
            known, sums = np.concatenate((self.known, hashes[fresh])), np.concatenate((self.sums, self._sum(s, starts[some], stops[some])))
            order = np.argsort(known)
            self.known, self.sums = known[order], sums[order]
        return self.sums[np.searchsorted(self.known, hashes)][at]


def part_of(context: np.ndarray, parts: int) -> np.ndarray:
    return (mix(context.astype(np.uint64)) % np.uint64(parts)).astype(np.int64)


def strongest_mean(x: np.ndarray) -> float:
    """The mean of the largest values, one in STRONGEST; 0 of none."""
    k = -(-len(x) // STRONGEST)
    return float(np.partition(x, len(x) - k)[len(x) - k :].astype(np.float64).mean()) if k else 0.0


def score_texts(rows: DataFrame, model: DataFrame) -> DataFrame:
    """``rows`` (k, text, model) with the column ratio instead of text: the row's score under the model of that number.

    The model goes out in parts by context.  Between passes the words' sums so far stay with their rows.
    """
    spark, n = rows.sparkSession, model.count()
    parts = max(1, -(-n // PART_ROWS))
    # Parts are told by the same function on both sides, so they are cut where the rows are read.
    pieces = model.mapInPandas(lambda fs: (f.assign(part=part_of(f["context"].to_numpy(np.int64), parts)) for f in fs), model.schema.simpleString()[7:-1] + ",part:bigint") if parts > 1 else model.withColumn("part", F.lit(0).cast("long"))
    pieces = materialize(pieces) if parts > 1 else pieces
    columns = [f"r{m}" for m in range(FOLDS + 1)]
    now = rows.select("k", "text", "model", F.lit(None).cast("array<float>").alias("sums"))
    for part in range(parts):
        table = pieces.filter(F.col("part") == part).select("key", F.array(*columns).alias("r")).toArrow()
        values = table["r"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, FOLDS + 1)
        sent = spark.sparkContext.broadcast((table["key"].to_numpy(), values))
        del table, values
        held: list[Part] = []
        last = part == parts - 1

        def add(frames, sent=sent, held=held, part=part, last=last):
            if not held:
                held.append(Part(*sent.value, part, parts))
            for f in frames:
                out, texts, which, before = [], f["text"].tolist(), f["model"].to_numpy(np.int64), f["sums"].tolist()
                for low, run in _chunks(texts):
                    s, starts, stops, n = _words(run)
                    at = np.cumsum(n) - n
                    w = held[0].words(s, starts, stops)
                    for i, k in enumerate(n):
                        x = w[at[i] : at[i] + k, which[low + i]]
                        if before[low + i] is not None:
                            x = x + np.asarray(before[low + i], np.float32)
                        out.append(round(strongest_mean(x), 5) if last else x)
                yield pd.DataFrame({"k": f["k"], "model": f["model"], "ratio": out}) if last else f.assign(sums=out)

        kind = rows.schema["k"].dataType.simpleString()
        if last:
            return now.mapInPandas(add, f"k {kind}, model int, ratio double")
        now = materialize(now.mapInPandas(add, f"k {kind}, text string, model int, sums array<float>"))
    raise AssertionError


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[list[float], list[float]]:
    """(places, chances) of the rising curve nearest to labels ``y`` at ``x``, to be read with lines between its steps.

    Without labels of both kinds the chance is near 0, or near 1, everywhere.
    """
    if len(y) == 0 or y.min() == y.max():
        return [0.0], [0.98 if len(y) and y[0] else 0.02]
    blocks: list[list[float]] = []  # sum of labels, rows, first and last place
    order = np.lexsort((y, x))
    for a, b in zip(x[order].tolist(), y[order].tolist(), strict=True):
        if blocks and blocks[-1][3] == a:  # rows of one place belong together
            blocks[-1][0] += b
            blocks[-1][1] += 1
        else:
            blocks.append([b, 1.0, a, a])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            s, n, _, end = blocks.pop()
            blocks[-1] = [blocks[-1][0] + s, blocks[-1][1] + n, blocks[-1][2], end]
    hits, rows = np.cumsum([b[0] for b in blocks][::-1])[::-1], np.cumsum([b[1] for b in blocks][::-1])[::-1]
    chance = np.array([(s + 0.1) / (n + 0.3) for s, n, _, _ in blocks])
    best = chance[np.argmax(2 * hits / (rows + hits[0]))]
    odds = np.log(chance / (1 - chance)) + max(0.0, np.log((CUT + 0.01) / (0.99 - CUT)) - np.log(best / (1 - best)))
    knots = [(at, float(c)) for (_, _, first, end), c in zip(blocks, 1 / (1 + np.exp(-odds)), strict=True) for at in ([first, end] if first < end else [first])]
    return [a for a, _ in knots], [c for _, c in knots]


def _read(curve: tuple[list[float], list[float]], x: Column) -> Column:
    """The curve at ``x``, as a column."""
    places, chances = curve
    arrays = F.array(*map(F.lit, places)), F.array(*map(F.lit, chances))
    i = F.size(F.filter(arrays[0], lambda p: p <= x))
    a, b = F.get(arrays[0], i - 1), F.get(arrays[0], i)
    low, high = F.get(arrays[1], i - 1), F.get(arrays[1], i)
    return F.when(i == 0, chances[0]).when(i == len(places), chances[-1]).otherwise(low + (high - low) * (x - a) / (b - a))


def score_toxicity(docs: DataFrame, labels: DataFrame, learn_from=None, key: str = "doc_id", text: str = "text", label: str = "toxic", calibration_rows: int = CALIBRATION_ROWS) -> DataFrame:
    """(key, score) of every row of ``docs``; only ``text`` decides a score.

    ``labels`` has ``key`` and ``label`` (0 or 1; others and null are no label); of them, rows where
    the condition ``learn_from`` holds are learnt from.  A key with several labels counts once for each, as
    does each of several rows of one key.  Null, empty and wordless texts get the curve's value at no
    evidence.  Without labels of both kinds all scores are near 0, or near 1.  The curve is fitted on
    the documents of ``calibration_rows`` labels in hash order at most; all else takes all rows.
    """
    bound_batches(docs.sparkSession)
    marks = labels.select(F.col(key).alias("k"), F.col(label).cast("int").alias("toxic")).filter(F.col("toxic").isin(0, 1) & F.col("k").isNotNull())
    if learn_from is not None:
        marks = marks.filter(learn_from(F.col("k")))
    marks = marks.withColumn("fold", F.pmod(F.xxhash64("k"), F.lit(FOLDS)).cast("int"))
    body = docs.select(F.col(key).alias("k"), F.col(text).cast("string").alias("text"))
    labelled = body.join(marks.hint("shuffle_hash"), "k")
    counts = materialize(count_grams(labelled))
    model = materialize(model_table(counts))
    discard(counts)
    # At most ``calibration_rows`` rows, so they may go to the documents.
    some = materialize(marks.orderBy(F.xxhash64("k", F.lit(3)), "k", "toxic").limit(calibration_rows))
    sample = materialize(body.join(F.broadcast(some), "k"))
    crossed = score_texts(sample.select(F.struct("k", "toxic").alias("k"), "text", F.col("fold").alias("model")), model).select("k.toxic", "ratio").toPandas()
    curve = isotonic(crossed["ratio"].to_numpy(float), crossed["toxic"].to_numpy(float))
    scored = score_texts(body.select("k", "text", F.lit(FOLDS).alias("model")), model)
    return scored.select(F.col("k").alias(key), F.round(_read(curve, F.col("ratio")), 6).alias("score"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document; a third of the keys is never learnt from."""
    out = score_toxicity(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"), learn_from=lambda k: ~held_out(k, 3, 1))
    return out.select("doc_id", held_out(F.col("doc_id"), 3, 1).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))

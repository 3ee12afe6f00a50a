"""Quality classification by co-training.

Two classifiers see different views of a document.  One judges statistics of its text by linear
discriminants; the other the page's metadata (source, language, the shape of its length) by
label rates shrunk towards the common one.  Over some rounds each marks the unlabelled documents
it is surest of as training rows for the other.  Both are then calibrated on rows held back, and a
logistic model of the two calibrated views scores every document.

Both classifiers follow from sums over their training rows, so training sets stay where they are: a
round is two passes over the table, one that counts how sure the views are, which decides who is
given, and one that adds what the given rows bring.  All labelled rows outside the held-out and
calibration folds and all unlabelled rows take part; only the curve of the last step is
fitted on a bounded sample.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm.common import bound_batches, load, materialize
from loomgraph.llm.langid import held_out
from loomgraph.llm.textkit import BLANKS, batches, word_hashes

#: Labelled rows that calibration may see, in the order of a hash: the default of a parameter.
CALIBRATION_ROWS = 20_000
ROUNDS, SHARE, SURE = 5, 0.02, 0.95
#: Steps that a unit of log-odds is counted in, and the log-odds that the last step stands for.
STEPS, TOP = 256, 64
#: Bins that sources and languages are hashed to; where several fall in one, they share a rate.  Bins of lengths.
SOURCE_BINS, LANG_BINS, LENGTH_BINS = 4096, 256, 128
_BINS = SOURCE_BINS + LANG_BINS + LENGTH_BINS
#: Rows that a bin's own rate needs to weigh as much as the common one.
SHRINK = 20.0
#: What is added to the variance of each text statistic, as a part of it.
RIDGE = 0.05
#: Sums are whole multiples of 1 / GRID, so they do not depend on the order of tasks.
GRID = 1 << 24
#: What a row is to the fit: unlabelled, learnt from, for calibration, or nothing.
POOL, TRAIN, CALIBRATE, NONE = range(4)
_CLASSES = {
    "lower": range(97, 123),
    "upper": range(65, 91),
    "digit": range(48, 58),
    "symbol": b"#*$%&|<>",
    "stop": b".,;:!?",
    "newline": b"\n",
}
_KIND = np.zeros(256, np.uint8)
for _i, _c in enumerate(_CLASSES.values(), 1):
    _KIND[list(_c)] = _i
_KIND[128:] = len(_CLASSES) + 1
TEXT_FEATURES = [*_CLASSES, "wide", "blank_words", "word_length", "distinct", "top_word", "top_pair", "log_words", "line_length"]


def text_features(texts: list[str | None]) -> np.ndarray:
    """One row of statistics per text; zeros without words."""
    out = np.zeros((len(texts), len(TEXT_FEATURES)))
    for first, run in batches(texts):
        h, n = word_hashes(run, BLANKS)
        at = 0
        for i, (body, k) in enumerate(zip(run, n, strict=True), first):
            w = h[at : at + k]
            at += k
            if k == 0:
                continue
            kinds = np.bincount(_KIND[np.frombuffer(body, np.uint8)], minlength=len(_CLASSES) + 2) / len(body)
            _, count = np.unique(w, return_counts=True)
            pairs = np.unique(w[1:] * np.uint64(3) + w[:-1], return_counts=True)[1] if k > 1 else np.ones(1)
            out[i, : len(kinds) - 1] = kinds[1:]
            out[i, len(kinds) - 1 :] = kinds[0], len(body) / k / 10, len(count) / k, count.max() / k, pairs.max() / k, np.log1p(k) / 10, min(1.0, kinds[6] * 100)
    return np.round(out, 6)

_N = len(TEXT_FEATURES)
_TEXT = 1 + _N + _N * _N


def _fit(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Logistic regression by Newton steps; the last weight is the constant."""
    z = np.column_stack((x, np.ones(len(x))))
    w, penalty = np.zeros(z.shape[1]), np.diag([*[ridge] * x.shape[1], 1e-6])
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve(z.T @ (z * (p * (1 - p) + 1e-9)[:, None]) + penalty, z.T @ (y - p) - penalty @ w)
        w += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return w


def _text_sums(x: np.ndarray) -> np.ndarray:
    return np.concatenate(([len(x)], x.sum(0), (x.T @ x).ravel()))


def add_up(x: np.ndarray, page: np.ndarray, text_labels: np.ndarray, page_labels: np.ndarray) -> np.ndarray:
    """What rows bring to the sums of both classifiers; a label of -1 is none for that view."""
    parts = [_text_sums(x[text_labels == label]) for label in (0, 1)]
    parts += [np.bincount(page[page_labels == label].ravel(), minlength=_BINS) for label in (0, 1)]
    return np.concatenate(parts)


_SUMS = 2 * _TEXT + 2 * _BINS


def models(sums: np.ndarray) -> tuple[np.ndarray, float, np.ndarray, float]:
    """(weights, constant) of the text view and (weight per bin, constant) of the page view, as log-odds of label 1."""
    parts = [sums[i * _TEXT : (i + 1) * _TEXT] for i in (0, 1)]
    n = [p[0] for p in parts]
    means = [p[1 : 1 + _N] / max(p[0], 1) for p in parts]
    within = sum(p[1 + _N :].reshape(_N, _N) - p[0] * np.outer(m, m) for p, m in zip(parts, means, strict=True)) / max(sum(n), 1)
    w = np.linalg.solve(within + np.diag(RIDGE * np.diag(within).clip(0) + 1e-6), means[1] - means[0])
    counts = [sums[2 * _TEXT + i * _BINS :][:_BINS] for i in (0, 1)]
    # Every row has one bin of each kind.
    rows = [c[:SOURCE_BINS].sum() for c in counts]
    common = (counts[0] + counts[1]) / max(sum(rows), 1)
    rate = [(c + SHRINK * common + 1e-9) / (r + SHRINK) for c, r in zip(counts, rows, strict=True)]
    prior = lambda m: float(np.log((m[1] + 1) / (m[0] + 1)))
    return w, float(-(means[0] + means[1]) @ w / 2) + prior(n), np.log(rate[1] / rate[0]), prior(rows)


def odds_of(model: tuple, x: np.ndarray, page: np.ndarray) -> list[np.ndarray]:
    """Log-odds of label 1 of rows by the text view and by the page view."""
    w, c, bins, d = model
    return [x @ w + c, bins[page].sum(1) + d]


def _sides(odds: np.ndarray):
    """(label, rows that are sure of it, their steps of confidence) for both labels."""
    for label, side in ((0, -odds), (1, odds)):
        yield label, side >= np.log(SURE / (1 - SURE)), (np.clip(side, 0, TOP) * STEPS).astype(np.int64)


def _cut(counts: np.ndarray, n: int) -> tuple[int, float]:
    """The step, and the share of the rows at it, that the ``n`` surest of the counted rows reach."""
    above = np.cumsum(counts[::-1])[::-1]
    if above[0] <= n:
        return -1, 1.0
    low = int(np.flatnonzero(above > n)[-1])
    return low, float(n - (above[low] - counts[low])) / float(counts[low])


def _give(odds: list[np.ndarray], cuts: list, h: np.ndarray, free: list[np.ndarray]) -> list[np.ndarray]:
    """The label that each view gives a row, -1 for none; given rows are no longer free.

    A row is given above its label's step, and at it if its hash falls into the share that the quota leaves.
    """
    out = []
    for a in (0, 1):
        given = np.full(len(h), -1)
        for label, sure, step in _sides(odds[a]):
            low, share = cuts[a][label]
            given[free[a] & sure & ((step > low) | ((step == low) & (h < share)))] = label
        free[a] &= given < 0
        out.append(given)
    return out


def _read(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """(text statistics, bins of the page) of the rows."""
    x = batch.column("f").flatten().to_numpy(zero_copy_only=False).reshape(-1, _N)
    return x, np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in ("s", "l", "z")], axis=1)


def _total(rows: DataFrame, each, size: int) -> np.ndarray:
    """The sum over all rows of the vectors that ``each`` makes of batches; only sums leave a task."""

    def add(batches):
        total = np.zeros(size)
        for batch in batches:
            if batch.num_rows:
                total += each(batch)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"at": at.astype(np.int32), "v": np.round(total[at] * GRID).astype(np.int64)})

    out = np.zeros(size)
    for r in rows.mapInArrow(add, "at int, v bigint").groupBy("at").agg(F.sum("v").alias("v")).collect():
        out[r["at"]] = r["v"] / GRID
    return out


def co_train(rows: DataFrame) -> tuple:
    """Both views' model after the rounds, from ``rows`` (f, s, l, z, h, role, y).

    In a round each view gives the other its surest rows of either class from all unlabelled ones, in the
    proportion of the labels; a row given once by a view is not given by it again.
    """

    def labelled(batch: pa.RecordBatch) -> np.ndarray:
        y = batch.column("y").to_numpy(zero_copy_only=False)
        return add_up(*_read(batch), y, y)

    sums = _total(rows.filter(F.col("role") == TRAIN), labelled, _SUMS)
    pool = rows.filter(F.col("role") == POOL)
    rate, size, past = sums[_TEXT] / max(sums[0] + sums[_TEXT], 1), pool.count(), ()
    quota = max(1, int(SHARE * size))
    wanted = {1: int(quota * rate), 0: int(quota * (1 - rate)) + 1}
    width = TOP * STEPS + 1
    for _ in range(ROUNDS if size else 0):
        now = models(sums)

        def replay(batch: pa.RecordBatch, past: tuple):
            """Both views of the rows, the rows still free, and the labels given in the last round."""
            x, page = _read(batch)
            h = batch.column("h").to_numpy(zero_copy_only=False)
            free, last = [np.ones(len(h), bool), np.ones(len(h), bool)], []
            for model, cuts in past:
                last = _give(odds_of(model, x, page), cuts, h, free)
            return x, page, free, last

        def count(batch: pa.RecordBatch, now=now, past=past) -> np.ndarray:
            x, page, free, _ = replay(batch, past)
            out = np.zeros((4, width))
            for a, odds in enumerate(odds_of(now, x, page)):
                for label, sure, step in _sides(odds):
                    out[2 * a + label] = np.bincount(step[sure & free[a]], minlength=width)
            return out.ravel()

        counts = _total(pool, count, 4 * width).reshape(4, width)
        cuts = [{label: _cut(counts[2 * a + label], wanted[label]) for label in (0, 1)} for a in (0, 1)]
        past = (*past, (now, cuts))

        def given(batch: pa.RecordBatch, past=past) -> np.ndarray:
            x, page, _, last = replay(batch, past)
            return add_up(x, page, last[1], last[0])

        sums = sums + _total(pool, given, _SUMS)
    return models(sums)


def _bin(c: Column, bins: int) -> Column:
    """A bin of the value; null has one of its own text."""
    return F.pmod(F.crc32(F.encode(F.coalesce(c.cast("string"), F.lit("\0")), "UTF-8")), F.lit(bins)).cast("int")


def classify_quality(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", lang: str = "lang", size: str = "n_chars", label: str = "quality", calibration_rows: int = CALIBRATION_ROWS) -> DataFrame:
    """(key, text_score, page_score, score), one row per row of ``docs``.

    Labels are 0 or 1, others and null count as none; equal labels of one key are one, and a key with
    both is neither learnt from nor unlabelled.  A quarter of the keys by checksum is never learnt from,
    another calibrates.  Null texts and metadata have features of their own.  With labels of one
    kind only, or none, all scores are that kind's share, or 1/2.
    """

    bound_batches(docs.sparkSession)

    def measure(texts: pd.Series) -> pd.Series:
        return pd.Series(list(text_features(texts.tolist())))

    measured = F.pandas_udf(measure, "array<double>")
    length = F.log2(1 + F.greatest(F.lit(0.0), F.coalesce(F.col(size).cast("double"), F.lit(0.0))))
    rows = docs.select(
        F.col(key).alias("_k"),
        measured(F.col(text).cast("string")).alias("f"),
        _bin(F.col(source), SOURCE_BINS).alias("s"),
        (SOURCE_BINS + _bin(F.col(lang), LANG_BINS)).alias("l"),
        (SOURCE_BINS + LANG_BINS + F.least(F.lit(LENGTH_BINS - 1), F.floor(2 * length))).cast("int").alias("z"),
    )
    marks = labels.filter(F.col(key).isNotNull()).select(F.col(key).alias("_k"), F.col(label).cast("int").alias("y"))
    marks = marks.groupBy("_k").agg(F.min(F.when(F.col("y").isin(0, 1), F.col("y"))).alias("y"), F.max(F.when(F.col("y").isin(0, 1), F.col("y"))).alias("_y"))
    known = F.col("y").isNotNull() & (F.col("y") == F.col("_y")) & ~held_out(F.col("_k"), 4, 0)
    role = F.when(F.col("_m").isNull(), POOL).when(~known, NONE).when(held_out(F.col("_k"), 4, 1), CALIBRATE).otherwise(TRAIN)
    h = F.xxhash64("_k", F.lit(17))
    rows = rows.join(marks.withColumn("_m", F.lit(True)), "_k", "left").select("_k", "f", "s", "l", "z", "y", role.alias("role"), (F.pmod(h, F.lit(1 << 30)) / (1 << 30)).alias("h"))
    rows = materialize(rows)
    shares = {r["role"]: (r["n"], r["one"]) for r in rows.filter(F.col("role").isin(TRAIN, CALIBRATE)).groupBy("role").agg(F.count("*").alias("n"), F.sum("y").alias("one")).collect()}
    if not all(0 < shares.get(r, (0, 0))[1] < shares.get(r, (0, 0))[0] for r in (TRAIN, CALIBRATE)):
        n, one = (sum(v[i] for v in shares.values()) for i in (0, 1))
        return rows.select(F.col("_k").alias(key), *[F.lit(one / n if n else 0.5).alias(c) for c in ("text_score", "page_score", "score")])
    model = co_train(rows)

    def judge(batches):
        for batch in batches:
            t, p = odds_of(model, *_read(batch)) if batch.num_rows else (np.zeros(0), np.zeros(0))
            yield pa.RecordBatch.from_arrays([batch.column("_k"), batch.column("role"), batch.column("y"), pa.array(np.round(t, 9)), pa.array(np.round(p, 9))], ["_k", "role", "y", "t", "p"])

    kind = docs.schema[key].dataType.simpleString()
    scored = materialize(rows.select("_k", "f", "s", "l", "z", "role", "y").mapInArrow(judge, f"_k {kind}, role int, y int, t double, p double"))
    sample = scored.filter(F.col("role") == CALIBRATE).orderBy(F.xxhash64("_k", F.lit(17)), "_k", "t", "p").limit(calibration_rows).toPandas()
    y, raw = sample["y"].to_numpy(float), [sample[c].to_numpy(float) for c in ("t", "p")]
    curve = [_fit(r[:, None], y, 0.01) for r in raw]
    both = _fit(np.column_stack([r * c[0] + c[1] for r, c in zip(raw, curve, strict=True)]), y, 0.01)
    t, p = (F.col(name) * float(c[0]) + float(c[1]) for name, c in zip(("t", "p"), curve, strict=True))
    chance = lambda c: F.round(1 / (1 + F.exp(-c)), 6)
    return scored.select(F.col("_k").alias(key), chance(t).alias("text_score"), chance(p).alias("page_score"), chance(t * float(both[0]) + p * float(both[1]) + float(both[2])).alias("score"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document; a quarter of the keys is never learnt from."""
    out = classify_quality(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"))
    good = F.col("score") >= 0.5
    return out.select("doc_id", held_out(F.col("doc_id"), 4, 0).alias("held_out"), "text_score", "page_score", "score", good.cast("int").alias("predicted"), good.alias("kept"))

"""Benchmark decontamination by size-partitioned MinHash containment search.

Test items are short and documents long, so Jaccard similarity between the two says
little.  Items are therefore partitioned by their number of shingles, and for the items of
2**c to 2**(c+1) - 1 shingles every document is read as overlapping windows of three
blocks of 2**c shingles: an item that stands in a document lies in one window of its own
size.  A window and an item that agree in any of the MinHash values are a candidate
pair; exact containment of the item's shingles in the whole document decides.

The documents are never shuffled: each task searches its own with an index of the
items, sent in blocks of bounded size.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm.common import bound_batches, load
from loomgraph.llm.textkit import PUNCTUATION, batches, mix, shingle_hashes, word_hashes

SHINGLE, THRESHOLD = 5, 0.8
#: MinHash values.  A window holds an item at a similarity of 1/4 at least, so one of 48 agrees with odds of 0.999999.
HASHES = 48
#: Bytes of item text that one pass over the documents looks for.
BLOCK_BYTES = 16 << 20

_WORD = re.compile("[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+")
_FACTORS = np.random.default_rng(99).integers(0, 2**63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(text: str | None, size: int = SHINGLE) -> set[tuple[str, ...]]:
    """Distinct word shingles; a shorter text is one shingle, a text without words has none.

    Words are runs of ASCII letters and digits and of characters outside ASCII, A-Z in lower case.
    """
    w = _WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set()


class ItemIndex:
    """MinHash values of the items of one block by size class, and their shingles for the exact check."""

    def __init__(self, ids: list, texts: list[str | None], size: int):
        self.size, self.ids = size, ids
        self.sets = [shingles(t, size) for t in texts]
        self.classes: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        members: dict[int, list[tuple[int, np.ndarray]]] = {}
        for first, run in batches(texts):
            h, n = word_hashes(run, PUNCTUATION)
            for i, part in enumerate(np.split(h, np.cumsum(n)[:-1])):
                s = np.unique(shingle_hashes(part, size))
                if len(s):
                    # An item of fewer words than a shingle is only found as a whole text.
                    members.setdefault(len(s).bit_length() - 1 if len(part) >= size else -1, []).append((first + i, s))
        every = [x for items in members.values() for x in items]
        flat = np.concatenate([x for _, x in every]) if every else np.empty(0, np.uint64)
        owner = np.repeat([i for i, _ in every], [len(x) for _, x in every]).astype(np.int64)
        order = np.argsort(flat, kind="stable")
        self.flat, self.flat_owner = flat[order], owner[order]
        for c, items in members.items():
            keys = np.concatenate([_minhash(s[None, :]) for _, s in items], axis=1)
            key, owner = keys.ravel(), np.tile([i for i, _ in items], HASHES)
            order = np.argsort(key, kind="stable")
            sieve = np.zeros(1 << 16, bool)
            sieve[key >> np.uint64(48)] = True
            self.classes[c] = key[order], owner[order], sieve

    def candidates(self, words: np.ndarray) -> set[int]:
        """Items that some window of a document may contain, by the document's word hashes."""
        s = shingle_hashes(words, self.size)
        found: set[int] = set()
        if len(s) == 0:
            return found
        low: dict[int, np.ndarray] = {}
        for c in sorted(self.classes):
            if c < 0:
                if len(words) < self.size:
                    self._probe(c, np.array([[mix_one(s, f).min()] for f in _FACTORS]), found)
                continue
            block = 1 << c
            if c - 1 in low:  # two blocks make one of the next class
                a = low[c - 1]
                a = a if a.shape[1] % 2 == 0 else np.concatenate((a, a[:, -1:]), axis=1)
                low[c] = np.minimum(a[:, 0::2], a[:, 1::2])
            else:
                starts = np.arange(0, len(s), block)
                low[c] = np.stack([np.minimum.reduceat(mix_one(s, f), starts) for f in _FACTORS])
            m = low[c]
            if m.shape[1] > 2:
                m = np.minimum(np.minimum(m[:, :-2], m[:, 1:-1]), m[:, 2:])
            else:
                m = m.min(1, keepdims=True)
            self._probe(c, m, found)
        return found

    def sharing(self, words: np.ndarray, threshold: float) -> set[int]:
        """Items of whose shingles the document has the share ``threshold``, by their hashes: misses none."""
        s = np.unique(shingle_hashes(words, self.size))
        a, b = np.searchsorted(self.flat, s, "left"), np.searchsorted(self.flat, s, "right")
        met = [self.flat_owner[i:j] for i, j in zip(a[a < b], b[a < b], strict=True)]
        if not met:
            return set()
        who, count = np.unique(np.concatenate(met), return_counts=True)
        return {int(i) for i, n in zip(who, count, strict=True) if n >= threshold * len(self.sets[i])}

    def _probe(self, c: int, values: np.ndarray, found: set[int]) -> None:
        key, owner, sieve = self.classes[c]
        rows = np.arange(HASHES, dtype=np.uint64)[:, None]
        v = _tag(values, rows).ravel()
        v = np.unique(v[sieve[v >> np.uint64(48)]])
        a, b = np.searchsorted(key, v, "left"), np.searchsorted(key, v, "right")
        for i, j in zip(a[a < b], b[a < b], strict=True):
            found.update(owner[i:j].tolist())


def mix_one(s: np.ndarray, factor: np.uint64) -> np.ndarray:
    """One of the hash functions; the input is already well mixed, so an odd factor and a fold do."""
    x = s * factor
    return x ^ (x >> np.uint64(29))


def _tag(values: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """MinHash values made distinct by the number of their hash function, evenly spread."""
    return mix(values + (rows + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))


def _minhash(sets: np.ndarray) -> np.ndarray:
    """Tagged values (functions by sets) of rows of shingle hashes."""
    low = np.stack([mix_one(sets, f).min(1) for f in _FACTORS])
    return _tag(low, np.arange(HASHES, dtype=np.uint64)[:, None])


def _blocks(items: DataFrame, key: str, text: str):
    """Blocks of (ids, texts) of bounded bytes, read partition by partition."""
    ids, texts, used = [], [], 0
    for row in items.select(key, text).toLocalIterator():
        ids.append(row[0])
        texts.append(row[1])
        used += len((row[1] or "").encode("utf-8", "surrogatepass")) + 16
        if used >= BLOCK_BYTES:
            yield ids, texts
            ids, texts, used = [], [], 0
    yield ids, texts


def contaminated(docs: DataFrame, benchmark: DataFrame, size: int = SHINGLE, threshold: float = THRESHOLD, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", exact: bool = False) -> DataFrame:
    """(document, item, n_item_shingles, n_shared) of every pair whose containment reaches the threshold.

    Containment is the share of the item's distinct shingles that the whole document has.
    Null, empty and wordless texts on either side match nothing.  Repeated rows give
    repeated pairs.  The benchmark may be of any size: the documents are read once per block.

    An item that stands in one piece is missed once in a million; of items cut in five pieces all over a
    long document, or in halves far apart, the tests ask for 98 in a hundred.  ``exact`` looks all shingles up
    instead of windows' MinHash values and misses none.
    """
    if key == item:
        raise ValueError(f"documents and items both have the key {key}")
    bound_batches(docs.sparkSession)
    schema = f"{key} {docs.schema[key].dataType.simpleString()}, {item} {benchmark.schema[item].dataType.simpleString()}, n_item_shingles bigint, n_shared bigint"
    out = None
    for ids, texts in _blocks(benchmark, item, item_text):
        index = docs.sparkSession.sparkContext.broadcast((ids, texts))
        held: list[ItemIndex] = []

        def search(frames, index=index, held=held):
            if not held:
                held.append(ItemIndex(*index.value, size))
            for frame in frames:
                hits = []
                body, keys = frame["t"].tolist(), frame["k"].tolist()
                for first, run in batches(body):
                    h, n = word_hashes(run, PUNCTUATION)
                    at = 0
                    for i, k in enumerate(n, first):
                        own_words = h[at : at + k]
                        found = held[0].sharing(own_words, threshold) if exact else held[0].candidates(own_words)
                        at += k
                        if found:
                            own = shingles(body[i], size)
                            for j in sorted(found):
                                shared = len(held[0].sets[j] & own)
                                if shared >= threshold * len(held[0].sets[j]):
                                    hits.append((keys[i], held[0].ids[j], len(held[0].sets[j]), shared))
                yield pd.DataFrame(hits, columns=[key, item, "n_item_shingles", "n_shared"])

        part = docs.select(F.col(key).alias("k"), F.col(text).cast("string").alias("t")).mapInPandas(search, schema)
        out = part if out is None else out.union(part)
    return out


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document and benchmark item it contains, with the item's share of shingles found."""
    out = contaminated(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"))
    return out.withColumn("containment", F.round(F.col("n_shared") / F.col("n_item_shingles"), 6))


_SETS = """SELECT id, list_distinct(CASE WHEN len(w) >= {n} THEN list_transform(range(1, len(w) - {n} + 2), lambda i: w[i:i + {n} - 1]) WHEN len(w) > 0 THEN [w] ELSE [] END) AS s
  FROM (SELECT {key} AS id, list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') AS w FROM {table} WHERE text IS NOT NULL)"""

OP3_SQL = f"""
WITH d AS ({_SETS.format(n=SHINGLE, key="doc_id", table="documents")}), b AS ({_SETS.format(n=SHINGLE, key="item_id", table="benchmark")}
), du AS (SELECT id, unnest(s) AS g FROM d), bu AS (SELECT id, len(s) AS n, unnest(s) AS g FROM b)
SELECT du.id AS doc_id, bu.id AS item_id, CAST(n AS BIGINT) AS n_item_shingles, CAST(count(*) AS BIGINT) AS n_shared, round(CAST(count(*) AS DOUBLE) / n, 6) AS containment
FROM du JOIN bu USING (g) GROUP BY du.id, bu.id, n HAVING count(*) >= {THRESHOLD} * n
"""

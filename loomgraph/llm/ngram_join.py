"""N-gram Jaccard join by T-occurrence search with DivideSkip.

A link needs an overlap of ``percent`` of the larger set, so both ends consist of shared shingles for
the most part.  Four steps narrow the table down without ever pairing it up:

1. In the order of their hashes, the first shingles of two sets that link hold a least number of common
   ones.  Tasks send these prefixes, each shingle of a batch once, to be counted by shingle; documents
   whose prefix shares fewer cannot link.
2. The rest, one per identical set, order their shingles from rare to frequent.  Two that link share
   one of the first few (prefix filter); each prefix shingle ties its documents of like size to
   the smallest of them, a linear number of ties, whose components are the blocks.
3. Blocks are cut into cells of bounded size.  In a cell every document runs a T-occurrence
   search over the inverted index of the others: short lists are merged, candidates are probed
   in the long ones by binary search, and those that reach the exact overlap link.
4. Links collapse to components by min-label stars.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from loomgraph.llm.common import bound_batches, connected_components, discard, load, materialize, release
from loomgraph.llm.textkit import BLANKS, batches, mix, shingle_hashes, word_hashes

SHINGLE, PERCENT = 4, 85
#: Shingles of one batch, of which each is sent on once.
BATCH_TOKENS = 1_000_000
#: Parts that a group of copies, or the documents of one shingle, are dealt to before they meet.
SALTS = 64
#: Documents of a chunk; a cell compares two chunks at most.
CHUNK_DOCS, CHUNK_SHINGLES = 512, 2_000_000
#: Weight of a binary probe against a merge step, DivideSkip's parameter.
PROBE_WEIGHT = 0.1


def _sets(frames, size: int):
    """(key, text, sorted distinct shingles) of every row with a key."""
    for f in frames:
        keys, texts = f["k"].tolist(), f["t"].tolist()
        for first, run in batches(texts):
            h, n = word_hashes(run, BLANKS)
            at = 0
            for i, k in enumerate(n, first):
                yield keys[i], texts[i], np.unique(shingle_hashes(h[at : at + k], size))
                at += k


def least_overlap(n: int, percent: int) -> int:
    """Shingles that a set of ``n`` shares with any it links with, which is also their least number."""
    return -(-percent * n // 100)


def least_common(n: int, percent: int) -> int:
    """Common shingles that the prefixes of two linked sets hold, if ``n`` is the smaller size: as many as either may lack."""
    return max(1, min(least_overlap(n, percent), (100 - percent) * n // 100))


def prefix_length(n: int, percent: int) -> int:
    """After the first ``least_common`` common shingles there are as many more as the overlap needs, so these come early."""
    return n - least_overlap(n, percent) + least_common(n, percent)


def _profiles(rows: DataFrame, size: int, percent: int) -> DataFrame:
    """(k, n, d1, d2, prefix): the set's size, a 128-bit checksum of the set, and its smallest shingles."""

    def profile(frames):
        for f in frames:
            out = []
            for k, _, s in _sets([f], size):
                first = s[: prefix_length(len(s), percent)].view(np.int64) if len(s) else s.view(np.int64)
                out.append((k, len(s), int(mix(s).sum(dtype=np.uint64).view(np.int64)), int(mix(~s).sum(dtype=np.uint64).view(np.int64)), first))
            yield pd.DataFrame(out, columns=["k", "n", "d1", "d2", "prefix"])

    return rows.mapInPandas(profile, "k bigint, n bigint, d1 bigint, d2 bigint, prefix array<bigint>")


def _shared_counts(profiles: DataFrame) -> DataFrame:
    """(k, shared): shingles of a document's prefix that stand in another document's.

    A batch sends each shingle once, so a shingle of very many documents has one row a batch.  What it finds
    twice it counts itself and sends without an owner.
    """

    def flush(keys: np.ndarray, tokens: np.ndarray, owner: np.ndarray) -> pa.RecordBatch:
        order = np.argsort(tokens, kind="stable")
        tokens, owner = tokens[order], owner[order]
        new = np.concatenate(([True], tokens[1:] != tokens[:-1]))
        twice = ~new | np.concatenate((~new[1:], [False]))
        here = np.bincount(owner, twice, minlength=len(keys)).astype(np.int64)
        counted = np.flatnonzero(here)
        # Counts travel under keys that look like shingles, so that they are dealt as evenly.
        token = np.concatenate((tokens[new], mix(keys[counted].view(np.uint64)).view(np.int64)))
        who = np.concatenate((keys[owner[new]], keys[counted]))
        n = np.concatenate((np.zeros(new.sum(), np.int64), here[counted]))
        return pa.RecordBatch.from_arrays([pa.array(token), pa.array(who, mask=np.concatenate((twice[new], np.zeros(len(counted), bool)))), pa.array(n)], ["token", "k", "n"])

    def pack(batches):
        held, used = [], 0
        for batch in batches:
            prefix = batch.column("prefix")
            held.append((batch.column("k").to_numpy(), prefix.flatten().to_numpy(), prefix.value_lengths().to_numpy()))
            used += len(held[-1][1])
            if used >= BATCH_TOKENS:
                yield flush(*join(held))
                held, used = [], 0
        if used:
            yield flush(*join(held))

    def join(held: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        keys, tokens, sizes = (np.concatenate([h[i] for h in held]) for i in range(3))
        return keys, tokens, np.repeat(np.arange(len(keys), dtype=np.int32), sizes)

    sent = profiles.filter("k is not null and n > 0").select("k", "prefix").mapInArrow(pack, "token bigint, k bigint, n bigint")
    met = F.count_if(F.col("n") == 0).over(Window.partitionBy("token"))
    found = sent.withColumn("met", met).filter("k is not null and (n > 0 or met > 1)")
    return found.groupBy("k").agg(F.sum(F.greatest("n", F.lit(1))).alias("shared"))


def _lowest(rows: DataFrame, by: list[str], node: str) -> DataFrame:
    """(a, b): edges that tie the nodes of every group to its smallest, by way of the smallest of a salt's part."""
    salted = rows.withColumn("salt", F.pmod(F.xxhash64(node, F.lit(1)), F.lit(SALTS)).cast("int"))
    part = salted.groupBy(*by, "salt").agg(F.min(node).alias("low"))
    low = part.groupBy(*by).agg(F.min("low").alias("least"))
    inside = salted.join(part, [*by, "salt"]).select(F.col(node).alias("a"), F.col("low").alias("b"))
    return inside.union(part.join(low, by).select(F.col("low"), F.col("least"))).filter("a <> b")


def _rare_prefixes(reps: DataFrame, size: int, percent: int) -> DataFrame:
    """(k, band, token): the first shared shingles of every document from rare to frequent, and its size's band."""

    def explode(frames):
        for f in frames:
            out = [(k, s.view(np.int64)) for k, _, s in _sets([f], size)]
            n = [len(s) for _, s in out]
            if out:
                yield pd.DataFrame({"k": np.repeat([k for k, _ in out], n), "n": np.repeat(n, n), "token": np.concatenate([s for _, s in out])})

    tokens = reps.select("k", "t").mapInPandas(explode, "k bigint, n bigint, token bigint")
    often = tokens.groupBy("token").agg(F.count("*").alias("df")).filter("df > 1")
    shared = tokens.join(often, "token").groupBy("k", "n").agg(F.sort_array(F.collect_list(F.struct("df", "token"))).alias("s"))
    # The rarest n - ceil(percent * n) + 1 shingles; those of one document alone come first and tie nothing.
    length = F.expr(f"cast(n - ({percent} * n + 99) div 100 + 1 - (n - size(s)) as int)")
    band = F.floor(F.log(F.col("n").cast("double")) / F.lit(-math.log((percent - 1) / 100)))
    return shared.withColumn("m", length).filter("m > 0").select("k", band.alias("band"), F.explode(F.slice("s", F.lit(1), F.col("m"))).alias("x")).select("k", "band", F.col("x.token").alias("token"))


def _blocks(reps: DataFrame, size: int, percent: int) -> DataFrame:
    """(node, component): documents that the prefix filter ties together, directly or by others."""
    prefix = materialize(_rare_prefixes(reps, size, percent))
    release(reps.sparkSession)
    low = prefix.groupBy("token", "band").agg(F.min("k").alias("low"))
    upper = low.select("token", (F.col("band") - 1).alias("band"), F.col("low").alias("b"))
    across = low.join(upper, ["token", "band"]).select(F.col("low").alias("a"), "b").filter("a <> b")
    blocks = materialize(connected_components(_lowest(prefix, ["token", "band"], "k").union(across).distinct()))
    discard(prefix)
    return blocks


class Cell:
    """T-occurrence search of query sets in an inverted index of other sets."""

    def __init__(self, sets: list[np.ndarray], percent: int):
        self.sets, self.percent = sets, percent
        self.sizes = np.array([len(s) for s in sets])
        tokens, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), self.sizes)
        order = np.lexsort((owner, tokens))
        tokens, self.owner = tokens[order], owner[order]
        self.tokens, self.first = np.unique(tokens, return_index=True)
        self.first = np.append(self.first, len(tokens))

    def search(self, x: np.ndarray) -> np.ndarray:
        """Indexes of the sets that ``x`` links with, itself included if it is one of them.

        The short lists are merged by sorting their concatenation: like a heap, it brings equal owners
        together in n log n steps, and numpy takes them all at once.
        """
        need = least_overlap(len(x), self.percent)
        at = np.searchsorted(self.tokens, x)
        at = at[self.tokens[np.minimum(at, len(self.tokens) - 1)] == x]
        if len(at) < need:
            return np.empty(0, np.int64)
        length = self.first[at + 1] - self.first[at]
        order = np.argsort(length, kind="stable")
        n_long = min(need - 1, int(need / (PROBE_WEIGHT * math.log(max(length.max(), 2)) + 1)))
        short, long = at[order[: len(at) - n_long]], at[order[len(at) - n_long :]]
        # Short lists: every candidate stands in need - n_long of them at least.
        merged = np.concatenate([self.owner[self.first[i] : self.first[i + 1]] for i in short])
        who, count = np.unique(merged, return_counts=True)
        keep = (count >= need - n_long) & (self.sizes[who] >= need) & (self.sizes[who] * self.percent <= 100 * len(x))
        who, count = who[keep], count[keep]
        # Long lists: probed for the candidates only.
        if len(who) <= len(long):
            wanted = np.sort(self.tokens[long])
            for j, w in enumerate(who):
                s = self.sets[w]
                count[j] += (s[np.minimum(np.searchsorted(s, wanted), len(s) - 1)] == wanted).sum()
        else:
            for i in long:
                part = self.owner[self.first[i] : self.first[i + 1]]
                count += part[np.minimum(np.searchsorted(part, who), len(part) - 1)] == who
        return who[100 * count >= self.percent * (len(x) + self.sizes[who] - count)]


def _roots(n: int, pairs: list[tuple[int, np.ndarray]]) -> np.ndarray:
    """The smallest index of each one's component."""
    top = np.arange(n)

    def find(i: int) -> int:
        while top[i] != i:
            top[i] = top[top[i]]
            i = top[i]
        return i

    for i, others in pairs:
        for j in others:
            a, b = find(i), find(int(j))
            top[max(a, b)] = min(a, b)
    return np.array([find(i) for i in range(n)], np.int64)


def _links(cells: DataFrame, size: int, percent: int) -> DataFrame:
    """(k, links, root) from rows (cell, left, right, chunk, k, copies, t), each cell's rows in a run."""

    def join(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("k", kind="stable").reset_index(drop=True)
        sets = [s for _, _, s in _sets([f], size)]
        copies, chunk = f["copies"].to_numpy(), f["chunk"].to_numpy()
        left, right = f["left"].iloc[0], f["right"].iloc[0]
        asks, told = np.flatnonzero(chunk == left), np.flatnonzero(chunk == right)
        links, pairs = np.zeros(len(f), np.int64), []
        if len(asks) and len(told):
            index = Cell([sets[i] for i in told], percent)
            for i in asks:
                found = told[index.search(sets[i])]
                found = found[found != i]
                links[i] += copies[found].sum()
                if left != right:
                    links[found] += copies[i]
                pairs.append((i, found))
        keys = f["k"].to_numpy()
        return pd.DataFrame({"k": keys, "links": links, "root": keys[_roots(len(f), pairs)]})

    def run(frames):
        held: list[pd.DataFrame] = []
        for f in frames:
            if f.empty:
                continue
            for _, g in f.groupby("cell", sort=False):
                if held and held[0]["cell"].iloc[0] != g["cell"].iloc[0]:
                    yield join(pd.concat(held))
                    held = []
                held.append(g)
        if held:
            yield join(pd.concat(held))

    placed = cells.repartition("cell").sortWithinPartitions("cell")
    return placed.mapInPandas(run, "k bigint, links bigint, root bigint")


def jaccard_components(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_shingles, component_id, n_links), one row per row of ``docs``.

    Sets hold the distinct word shingles (A-Z lower-cased, ASCII blanks between words); shorter texts
    are one shingle, null and wordless texts have none and link with nothing.  Two rows link
    when 100 * intersection >= percent * union; n_links counts partners, copies included;
    component_id is the smallest key reachable.  Keys are integers, else an error is raised; rows of one
    key are one node, and rows without a key link with nothing and have no component.
    """
    bound_batches(docs.sparkSession)
    if not isinstance(docs.schema[key].dataType, IntegralType):
        raise ValueError(f"{key} must hold integers")
    rows = docs.select(F.col(key).cast("long").alias("k"), F.col(text).cast("string").alias("t"))
    profiles = materialize(_profiles(rows, size, percent))
    some = rows.filter("k is not null")
    # What any partner's prefix must share with this one's, by the least size of a partner.
    partner = F.expr(f"({percent} * n + 99) div 100")
    common = F.greatest(F.lit(1), F.least(F.expr(f"({percent} * p + 99) div 100"), F.expr(f"{100 - percent} * p div 100")))
    able = profiles.filter("n > 0").join(_shared_counts(profiles), "k").withColumn("p", partner).filter(F.col("shared") >= common).select("k", "n", "d1", "d2")
    sizes = materialize(profiles.select("k", "n"))
    able = materialize(able.withColumn("salt", F.pmod(F.xxhash64("k"), F.lit(SALTS)).cast("int")))
    discard(profiles)
    same = ["n", "d1", "d2"]
    parts = able.groupBy(*same, "salt").agg(F.min("k").alias("low"), F.count("*").alias("c"))
    classes = parts.groupBy(*same).agg(F.min("low").alias("rep"), F.sum("c").alias("copies"))
    of_part = materialize(parts.select(*same, "salt").join(classes, same))
    member = materialize(able.join(of_part, [*same, "salt"]).select("k", "salt", "rep", "copies"))
    reps = member.filter("k = rep").select("k", "copies").groupBy("k").agg(F.max("copies").alias("copies"))
    reps = materialize(some.join(reps.hint("shuffle_hash"), "k"))
    release(docs.sparkSession)
    blocks = _blocks(reps, size, percent).withColumnRenamed("node", "k").withColumnRenamed("component", "block")
    placed = reps.join(blocks.hint("shuffle_hash"), "k")
    words_of = F.octet_length("t") / 6
    chunks = placed.groupBy("block").agg(F.greatest(F.ceil(F.count("*") / CHUNK_DOCS), F.ceil(F.sum(words_of) / CHUNK_SHINGLES)).cast("int").alias("chunks"))
    placed = placed.join(chunks, "block").withColumn("chunk", F.pmod(F.xxhash64("k"), F.col("chunks")).cast("int"))
    placed = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    left, right = F.least("chunk", "other").cast("int"), F.greatest("chunk", "other").cast("int")
    cells = placed.select(F.concat_ws(":", "block", left, right).alias("cell"), left.alias("left"), right.alias("right"), "chunk", "k", "copies", "t")
    links = materialize(_links(cells, size, percent))
    discard(able, reps)
    tops = connected_components(links.filter("k <> root").select(F.col("k").alias("a"), F.col("root").alias("b")))
    counted = links.groupBy("k").agg(F.sum("links").alias("links"))
    found = counted.join(tops.withColumnRenamed("node", "k"), "k", "left").select(F.col("k").alias("rep"), "links", "component")
    each = member.join(of_part.select("rep", "salt").join(found, "rep"), ["rep", "salt"], "left").groupBy("k").agg(F.min(F.coalesce("component", "rep")).alias("c"), F.max(F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("l"))
    out = sizes.join(each, "k", "left")
    return out.select(F.col("k").alias(key), F.col("n").alias("n_shingles"), F.coalesce("c", "k").alias("component_id"), F.coalesce("l", F.lit(0)).cast("long").alias("n_links"))


def op4_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's set size, component and number of links."""
    return jaccard_components(load(spark, sf_dir, "documents"))


OP4_SQL = f"""
WITH RECURSIVE d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents
), s AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) >= {SHINGLE} THEN list_transform(range(1, len(w) - {SHINGLE} + 2), lambda i: array_to_string(w[i:i + {SHINGLE} - 1], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM d
), u AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM s
), link AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM u a JOIN u b USING (g) WHERE a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= {PERCENT} * (a.n + b.n - count(*))
), reach AS (
  SELECT a, b FROM link UNION SELECT r.a, l.b FROM reach r JOIN link l ON r.b = l.a
)
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, CAST(least(doc_id, coalesce((SELECT min(b) FROM reach WHERE a = doc_id), doc_id)) AS BIGINT) AS component_id,
       (SELECT count(*) FROM link WHERE a = doc_id) AS n_links
FROM s
"""

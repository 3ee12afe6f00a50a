"""Edit-aware token counts.

A document's pre-tokens lie in the leaves of a segment tree that sums their characters and
tokens.  Trees are kept in a table beside the text, as the sums of their leaves.  An edit finds its
leaves by descending on characters, encodes the touched pre-tokens anew, plus some context before
and on until a boundary of the old text recurs, and updates the sums above the touched leaves.  The
rest of the text is neither cut into pre-tokens nor encoded again, then or by later edits.

Tokens of a pre-token do not depend on its neighbours, so the tree's total is the
tokenizer's count of the whole text.
"""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterable

import numpy as np
import pandas as pd
import regex
import tiktoken
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm.common import bound_batches, load, materialize

#: Fixed value: the pre-token pattern of the byte-level vocabulary below.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Pre-tokens of a leaf, and characters after a pre-token's end that the pattern may look at.
LEAF, LOOK_AHEAD = 64, 2
#: Distinct pre-tokens whose counts a worker keeps; beyond it, it starts anew.
KEPT = 1 << 19
#: A vocabulary file is sent to the executors; this bounds it.
MAX_VOCABULARY_BYTES = 64 << 20


class Counter:
    """Tokens of pre-tokens, remembered."""

    def __init__(self, ranks: bytes, pattern: str = PATTERN):
        made = {base64.b64decode(a): int(b) for a, b in (line.split() for line in ranks.splitlines() if line)}
        self.encoding = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=made, special_tokens={})
        self.pattern = regex.compile(pattern)
        self.kept: dict[str, int] = {}

    def __call__(self, pieces: list[str]) -> list[int]:
        try:
            return [self.kept[p] for p in pieces]
        except KeyError:
            if len(self.kept) > KEPT:
                self.kept.clear()
            for p in set(pieces):
                if p not in self.kept:
                    self.kept[p] = len(self.encoding.encode_ordinary(p))
            return [self.kept[p] for p in pieces]


class TokenTree:
    """A text under a segment tree of characters, tokens and pre-tokens.

    ``sums`` holds these three of every leaf, as ``leaf_sums`` gives them; without it the text is encoded.
    Leaves are cut into pre-tokens when an edit touches them: between two boundaries of pre-tokens the
    pattern cuts as in the whole text if it sees the next characters.
    """

    def __init__(self, text: str, counter: Counter, sums: np.ndarray | None = None):
        self.counter, self.encoded = counter, 0
        if sums is None:
            pieces = counter.pattern.findall(text)
            leaves = [pieces[i : i + LEAF] for i in range(0, len(pieces), LEAF)] or [[]]
            sums, self.encoded = self._measure(leaves), len(pieces)
        ends = np.cumsum(sums[0])
        # Each leaf's text: bounds in the old text, or its pre-tokens once an edit has touched it.
        self.old, self.leaves = text, list(zip((ends - sums[0]).tolist(), ends.tolist(), strict=True))
        self._build(sums)

    def _measure(self, leaves: list[list[str]]) -> np.ndarray:
        flat = self.counter([p for leaf in leaves for p in leaf])
        out, at = np.zeros((3, len(leaves)), np.int64), 0
        for i, leaf in enumerate(leaves):
            out[:, i] = sum(map(len, leaf)), sum(flat[at : at + len(leaf)]), len(leaf)
            at += len(leaf)
        return out

    def _build(self, sums: np.ndarray) -> None:
        self.width = level = 1 << (len(self.leaves) - 1).bit_length()
        self.sums = np.zeros((3, 2 * level), np.int64)
        self.sums[:, level : level + len(self.leaves)] = sums
        while level > 1:
            half = level >> 1
            self.sums[:, half:level] = self.sums[:, level : 2 * level : 2] + self.sums[:, level + 1 : 2 * level : 2]
            level = half
        self.chars = self.sums[0]

    def leaf_sums(self) -> np.ndarray:
        """Characters, tokens and pre-tokens (rows) of every leaf."""
        return self.sums[:, self.width : self.width + len(self.leaves)]

    def total(self) -> int:
        return int(self.sums[1, 1])

    def length(self) -> int:
        return int(self.sums[0, 1])

    def pieces(self) -> int:
        return int(self.sums[2, 1])

    def text(self) -> str:
        return "".join(map(self._text_of, range(len(self.leaves))))

    def _text_of(self, i: int) -> str:
        x = self.leaves[i]
        return self.old[x[0] : x[1]] if isinstance(x, tuple) else "".join(x)

    def _pieces(self, i: int) -> list[str]:
        """The pre-tokens of a leaf; where its last ones end may hang on the characters behind it."""
        if not isinstance(self.leaves[i], tuple):
            return self.leaves[i]
        own, behind, j = self._text_of(i), "", i + 1
        while len(behind) < LOOK_AHEAD and j < len(self.leaves):
            behind += self._text_of(j)[:LOOK_AHEAD]
            j += 1
        out, left = [], len(own)
        for m in self.counter.pattern.finditer(own + behind[:LOOK_AHEAD]):
            if left <= 0:
                break
            out.append(m[0])
            left -= len(m[0])
        return out

    def _leaf_at(self, pos: int) -> tuple[int, int]:
        """The leaf that holds a character, and the characters before the leaf."""
        node, before = 1, 0
        while node < self.width:
            node *= 2
            if pos >= before + self.chars[node] and self.chars[node + 1]:
                before += int(self.chars[node])
                node += 1
        return node - self.width, before

    def _set(self, i: int, pieces: list[str]) -> None:
        self.leaves[i] = pieces
        node = self.width + i
        self.sums[:, node] = sum(map(len, pieces)), sum(self.counter(pieces)), len(pieces)
        while node > 1:
            node >>= 1
            self.sums[:, node] = self.sums[:, 2 * node] + self.sums[:, 2 * node + 1]

    def edit(self, start: int, end: int, new: str) -> int:
        """Replaces characters start to end; returns the number of pre-tokens encoded for it."""
        start, end = max(0, min(start, self.length())), max(0, min(end, self.length()))
        end = max(start, end)
        first, before = self._leaf_at(start)
        while first > 0 and start - before <= LOOK_AHEAD:
            first -= 1
            before -= int(self.chars[self.width + first])
        last, _ = self._leaf_at(end)
        while True:
            old = [p for i in range(first, last + 1) for p in self._pieces(i)]
            ends = np.cumsum([len(p) for p in old], dtype=np.int64)
            window = "".join(old)
            a, b = start - before, end - before
            text, moved = window[:a] + new + window[b:], len(new) - (b - a)
            kept = int(np.searchsorted(ends, a - LOOK_AHEAD, "right"))
            at = int(ends[kept - 1]) if kept else 0
            whole = last == len(self.leaves) - 1
            boundary = {int(e): i for i, e in enumerate(ends)}
            made, rest = [], None
            for m in self.counter.pattern.finditer(text, at):
                e = m.end()
                if not whole and e + LOOK_AHEAD > len(text):
                    break
                made.append(m[0])
                if e >= a + len(new) and e - moved >= b and e - moved in boundary:
                    rest = boundary[e - moved] + 1
                    break
            else:
                rest = len(old)
            if rest is not None:
                break
            last = min(len(self.leaves) - 1, 2 * last - first + 1)
        self.encoded += len(made)
        pieces, n = old[:kept] + made + old[rest:], last - first + 1
        if len(pieces) > 4 * LEAF * n:  # a long insertion: more leaves
            new_leaves = [pieces[i : i + LEAF] for i in range(0, len(pieces), LEAF)]
            sums = np.concatenate((self.leaf_sums()[:, :first], self._measure(new_leaves), self.leaf_sums()[:, last + 1 :]), axis=1)
            self.leaves[first : last + 1] = new_leaves
            self._build(sums)
        else:
            step = -(-len(pieces) // n) or 1
            for i in range(n):
                self._set(first + i, pieces[i * step : (i + 1) * step])
        return len(made)


_counters: dict[bytes, Counter] = {}


def _worker_counter(ranks: bytes, pattern: str) -> Counter:
    if ranks not in _counters:
        _counters.clear()
        _counters[ranks] = Counter(ranks, pattern)
    return _counters[ranks]


def settle(edits: Iterable[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """Edits of one text from the last to the first; of overlapping ones the first by start, then end, stays."""
    out, free = [], 0
    for start, end, new in sorted((int(s), max(int(s), int(e)), n or "") for s, e, n in edits):
        if start >= free:
            out.append((start, end, new))
            free = max(end, start + (start == end))
    return out[::-1]


def _sent(spark: SparkSession, vocabulary: str):
    """The vocabulary for the executors.  The driver alone reads the file, whose size is bounded."""
    with open(vocabulary, "rb") as f:
        ranks = f.read(MAX_VOCABULARY_BYTES + 1)
    if len(ranks) > MAX_VOCABULARY_BYTES:
        raise ValueError("the vocabulary is too large to send to executors")
    return spark.sparkContext.broadcast(ranks)


#: Columns of a kept tree: characters, tokens and pre-tokens of its leaves.
TREE = ["leaf_chars", "leaf_tokens", "leaf_pieces"]
_TREE_SCHEMA = ", ".join(f"{c} array<int>" for c in TREE)


def build_trees(docs: DataFrame, key: str = "doc_id", text: str = "text", carry: str | None = None, vocabulary: str = VOCABULARY, pattern: str = PATTERN) -> DataFrame:
    """(key, text, leaf_chars, leaf_tokens, leaf_pieces), one row per row: the table to keep.

    Null and empty texts have one empty leaf.  ``carry`` names one more column to keep.
    """
    bound_batches(docs.sparkSession)
    sent = _sent(docs.sparkSession, vocabulary)

    def build(frames):
        counter = _worker_counter(sent.value, pattern)
        for f in frames:
            sums = [TokenTree(t if isinstance(t, str) else "", counter).leaf_sums().astype(np.int32) for t in f[text]]
            yield f.assign(**{c: [x[i] for x in sums] for i, c in enumerate(TREE)})

    more = [carry] if carry else []
    rows = docs.select(key, F.col(text).cast("string").alias(text), *more)
    kinds = "".join(f", {c} {docs.schema[c].dataType.simpleString()}" for c in more)
    return rows.mapInPandas(build, f"{key} {docs.schema[key].dataType.simpleString()}, {text} string{kinds}, {_TREE_SCHEMA}")


def apply_edits(trees: DataFrame, find_edits: Callable[[str], list[tuple[int, int, str]]] | None = None, edits: str = "edits", key: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY, pattern: str = PATTERN) -> DataFrame:
    """Kept trees after edits: their columns, n_edits and n_reencoded, the pre-tokens encoded for them.

    Edits (start, end, text) in characters of the kept text come from ``find_edits`` or from the column
    ``edits``, an array of structs; null is none.  A tree without edits is passed on as it is.
    """
    bound_batches(trees.sparkSession)
    sent = _sent(trees.sparkSession, vocabulary)

    def edit(frames):
        counter = _worker_counter(sent.value, pattern)
        for f in frames:
            out = []
            given = f[edits] if find_edits is None else [None] * len(f)
            for k, t, e, *sums in zip(f[key], f[text], given, *[f[c] for c in TREE], strict=True):
                todo = settle(find_edits(t or "") if find_edits else [(x["start"], x["end"], x["text"]) for x in e] if e is not None else [])
                again = 0
                if todo:
                    tree = TokenTree(t or "", counter, np.array(sums, np.int64))
                    again = sum(tree.edit(*x) for x in todo)
                    t, sums = tree.text(), tree.leaf_sums().astype(np.int32)
                out.append((k, t, *sums, len(todo), again))
            yield pd.DataFrame(out, columns=[key, text, *TREE, "n_edits", "n_reencoded"])

    rows = trees.select(key, text, *TREE, *([] if find_edits else [edits]))
    return rows.mapInPandas(edit, f"{key} {trees.schema[key].dataType.simpleString()}, {text} string, {_TREE_SCHEMA}, n_edits bigint, n_reencoded bigint")


def _sum(c: str) -> Column:
    return F.aggregate(c, F.lit(0).cast("bigint"), lambda a, x: a + x)


def count_after_edits(docs: DataFrame, find_edits: Callable[[str], list[tuple[int, int, str]]] | None = None, edits: str = "edits", key: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY, pattern: str = PATTERN) -> DataFrame:
    """(key, n_tokens, n_pretokens, n_edits, n_reencoded, n_tokens_after, n_chars_after), one row per row.

    Writes the trees of ``docs`` and reads them back for the edits.  Null and empty texts have no tokens.
    """
    trees = build_trees(docs, key, text, None if find_edits else edits, vocabulary, pattern)
    before = [_sum("leaf_tokens").alias("n_tokens"), _sum("leaf_pieces").alias("n_pretokens")]
    trees = materialize(trees)
    # The counts before ride along in the key, so no row needs to be found again.
    packed = trees.withColumn(key, F.struct(F.col(key).alias("k"), *before))
    after = apply_edits(packed, find_edits, edits, key, text, vocabulary, pattern)
    return after.select(F.col(f"{key}.k").alias(key), f"{key}.n_tokens", f"{key}.n_pretokens", "n_edits", "n_reencoded", _sum("leaf_tokens").alias("n_tokens_after"), _sum("leaf_chars").alias("n_chars_after"))


_PERSONAL = regex.compile(r"(?P<EMAIL>[\w.+-]+@[\w-]+(?:\.[\w-]+)+)|(?P<URL>https?://\S+)|(?P<NUMBER>\+?\d[\d ().-]{6,}\d)")


def redactions(text: str) -> list[tuple[int, int, str]]:
    """Edits that put a label in the place of mail addresses, links and long numbers."""
    return [(m.start(), m.end(), f"[{m.lastgroup}]") for m in _PERSONAL.finditer(text)]


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document, and after personal data are redacted from it."""
    return count_after_edits(load(spark, sf_dir, "documents").select("doc_id", "text"), redactions)

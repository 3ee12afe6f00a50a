"""Language identification by hyperdimensional profiles.

Each letter has a random vector of +1 and -1, drawn from a seed and its code point.  An
n-gram binds the vectors of its letters, permuted by position, by elementwise product;
a text bundles its n-grams by sum.  A language's prototype bundles the unit vectors of
its texts, and a text gets the language of largest cosine.

Texts are cut into n-grams and bundled with numpy on Arrow batches.  Learning sends one
vector per language from each task; only prototypes, whose number is checked, reach
the driver.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm.common import bound_batches, load, named

DIMS, GRAM, SEED = 1024, 3, 5
#: Prototypes that may be sent to executors: more than there are language codes, 32 MB.
MAX_LANGUAGES = 8192
#: Documents, and characters, bundled at once; a longer text is cut into pieces.
BLOCK, BLOCK_CHARS = 128, 1 << 19
#: N-gram vectors a worker keeps, 32 MB; beyond that it starts anew.
KEPT_GRAMS = 1 << 15
UNKNOWN = "und"


class Bundler:
    """Texts to hypervectors; keeps letter and n-gram vectors it has made."""

    def __init__(self, dims: int = DIMS, gram: int = GRAM, seed: int = SEED):
        self.dims, self.gram, self.seed = dims, gram, seed
        points = range(0x110000)
        letter = np.fromiter((chr(c).isalpha() for c in points), bool, 0x110000)
        lower = np.fromiter((ord(x) if len(x := chr(c).lower()) == 1 else c for c in points), np.uint32, 0x110000)
        #: Lower-cased code point of letters, 0 for all else.
        self.fold = np.where(letter, lower, 0).astype(np.int32)
        self.letters: dict[int, np.ndarray] = {}
        self.known, self.vectors = np.empty(0, np.int64), np.empty((0, dims), np.int8)

    def letter(self, point: int) -> np.ndarray:
        if point not in self.letters:
            self.letters[point] = np.random.default_rng([self.seed, point]).integers(0, 2, self.dims, np.int8) * 2 - 1
        return self.letters[point]

    def grams_of(self, text: str | None) -> np.ndarray:
        """Codes of the text's n-grams of letters; a run of other characters is one blank.  Empty without letters."""
        if not isinstance(text, str):
            return np.empty(0, np.int64)
        s = self._symbols(text)
        return self._codes(s) if s.any() else np.empty(0, np.int64)

    def _symbols(self, text: str) -> np.ndarray:
        s = self.fold[np.frombuffer(f" {text} ".encode("utf-32-le", "surrogatepass"), np.uint32)]
        return s[(s != 0) | (np.concatenate(([1], s[:-1])) != 0)]

    def _codes(self, s: np.ndarray) -> np.ndarray:
        n = len(s) - self.gram + 1
        code = np.zeros(n, np.int64)
        for i in range(self.gram):
            code = (code << 21) | s[i : n + i].astype(np.int64)
        return code

    def _learn(self, codes: np.ndarray) -> None:
        new = np.setdiff1d(codes, self.known, assume_unique=True)
        if len(new) == 0:
            return
        if len(self.known) + len(new) > KEPT_GRAMS:
            self.known, self.vectors, new = np.empty(0, np.int64), np.empty((0, self.dims), np.int8), codes
        made = np.ones((len(new), self.dims), np.int8)
        for i in range(self.gram):
            points = (new >> (21 * (self.gram - 1 - i))) & 0x1FFFFF
            distinct, at = np.unique(points, return_inverse=True)
            shifted = np.stack([np.roll(self.letter(int(p)), self.gram - 1 - i) for p in distinct])
            made *= shifted[at]
        codes = np.concatenate((self.known, new))
        order = np.argsort(codes)
        self.known, self.vectors = codes[order], np.concatenate((self.vectors, made))[order]

    def bundle(self, texts: list[str | None]) -> np.ndarray:
        """One row per text: the sum of its n-gram vectors (float32), zero without letters."""
        out, low, used = np.zeros((len(texts), self.dims), np.float32), 0, 0
        for i, t in enumerate(texts):
            size = len(t or "")
            if size > BLOCK_CHARS:
                # A long text is the sum of its pieces; they overlap by what an n-gram needs.
                s, step = self._symbols(t), BLOCK_CHARS
                for at in range(0, len(s) if s.any() else 0, step):
                    piece = s[at : at + step + self.gram - 1]
                    if len(piece) >= self.gram:
                        out[i] += self._add([self._codes(piece)])[0]
            if size > BLOCK_CHARS or used + size > BLOCK_CHARS:
                out[low:i] += self._add([self.grams_of(x) for x in texts[low:i]])
                low, used = (i + 1, 0) if size > BLOCK_CHARS else (i, size)
            else:
                used += size
        out[low:] += self._add([self.grams_of(x) for x in texts[low:]])
        return out

    def _add(self, grams: list[np.ndarray]) -> np.ndarray:
        if not grams:
            return np.zeros((0, self.dims), np.float32)
        which = np.repeat(np.arange(len(grams), dtype=np.int32), [len(g) for g in grams])
        codes, at = np.unique(np.concatenate(grams), return_inverse=True)
        out = np.zeros((len(grams), self.dims), np.float32)
        for low in range(0, len(codes), 4096):  # bounds the dense counts for rich alphabets
            part = codes[low : low + 4096]
            self._learn(part)
            mine = (at >= low) & (at < low + 4096)
            counts = np.bincount(which[mine].astype(np.int64) * len(part) + (at[mine] - low), minlength=len(grams) * len(part))
            rows = self.vectors[np.searchsorted(self.known, part)].astype(np.float32)
            out += counts.reshape(len(grams), len(part)).astype(np.float32) @ rows
        return out


_made: dict[tuple, Bundler] = {}


def _bundler(*key) -> Bundler:
    if key not in _made:
        _made[key] = Bundler(*key)
    return _made[key]


def _unit(x: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, norm, out=np.zeros_like(x), where=norm > 0)


def learn_prototypes(docs: DataFrame, text: str = "text", lang: str = "lang", dims: int = DIMS, gram: int = GRAM, seed: int = SEED) -> dict[str, np.ndarray]:
    """Unit prototypes by language, from all rows with a language and a letter."""

    bound_batches(docs.sparkSession)

    def partial(batches):
        sums: dict[str, np.ndarray] = {}
        for b in batches:
            for low in range(0, len(b), BLOCK):
                part = b.iloc[low : low + BLOCK]
                v = _unit(_bundler(dims, gram, seed).bundle(part["text"].tolist()))
                names, at = np.unique(part["lang"].to_numpy(str), return_inverse=True)
                for i, name in enumerate(names):
                    sums[name] = sums.get(name, 0) + v[at == i].sum(0, dtype=np.float64)
        # Rounded to a fixed grid, so that sums do not depend on the order of tasks.
        if sums:
            yield pd.DataFrame({"lang": list(sums), "v": [np.round(x * 2**20).astype(np.int64) for x in sums.values()]})

    rows = docs.filter(F.col(lang).isNotNull()).select(F.col(text).cast("string").alias("text"), F.col(lang).cast("string").alias("lang"))
    parts = rows.mapInPandas(partial, "lang string, v array<bigint>")
    sums = parts.groupBy("lang").agg(F.array(*[F.sum(F.col("v")[i]) for i in range(dims)]).alias("v"))
    found = sums.limit(MAX_LANGUAGES + 1).collect()
    if len(found) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} distinct languages; is {lang} a language column?")
    made = {r["lang"]: np.array(r["v"], np.float64) for r in found}
    return {k: (v / n).astype(np.float32) for k, v in sorted(made.items()) if (n := np.linalg.norm(v)) > 0}


def identify(docs: DataFrame, prototypes: dict[str, np.ndarray], text: str = "text", seed: int = SEED, gram: int = GRAM) -> DataFrame:
    """All rows and columns of ``docs`` plus lang_pred and score (cosine, 0 to 1).

    Null texts and texts without letters are ``und`` with score 0, as all are without
    prototypes.  Ties go to the first language by name.  Columns of ``docs`` called lang_pred or score
    give way to the results; if one is the text it is an error.
    """
    bound_batches(docs.sparkSession)
    names = sorted(prototypes)
    dims = len(prototypes[names[0]]) if names else DIMS
    matrix = np.stack([prototypes[n] for n in names]) if names else np.zeros((0, dims), np.float32)

    @F.pandas_udf("struct<lang:string,score:double>")
    def predict(texts: pd.Series) -> pd.DataFrame:
        langs, scores, all_texts = [], [], texts.tolist()
        for low in range(0, len(all_texts), BLOCK):
            v = _unit(_bundler(dims, gram, seed).bundle(all_texts[low : low + BLOCK]))
            if not names:
                langs += [UNKNOWN] * len(v)
                scores += [0.0] * len(v)
                continue
            cos = np.round((v @ matrix.T).astype(np.float64), 4)
            best = cos.argmax(1)
            silent = ~v.any(1)
            langs += [UNKNOWN if q else names[b] for q, b in zip(silent, best, strict=True)]
            scores += np.where(silent, 0.0, np.clip(cos[np.arange(len(v)), best], 0, 1)).tolist()
        return pd.DataFrame({"lang": langs, "score": scores})

    kept = named(docs, "lang_pred", "score", used=(text,))
    out = docs.select(F.struct(*kept).alias("_row"), predict(F.col(text).cast("string")).alias("_lid"))
    return out.select("_row.*", F.col("_lid.lang").alias("lang_pred"), F.col("_lid.score").alias("score"))


def held_out(key: Column, folds: int, fold: int) -> Column:
    """Whether crc32 of the key as text falls in the fold; rows without a key are held out."""
    return F.coalesce(F.crc32(F.encode(key.cast("string"), "UTF-8")) % folds == fold, F.lit(True))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of every document; a quarter of the keys is never learnt from."""
    docs = load(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    out = held_out(F.col("doc_id"), 4, 2)
    prototypes = learn_prototypes(docs.filter(~out))
    return identify(docs.select("doc_id", "text"), prototypes).select("doc_id", out.alias("held_out"), "lang_pred", "score")

"""Language identification with a string kernel.

A text becomes the set of its letter n-grams of length 1 to ORDER over a small
alphabet: a letter's lower case is one of 63 codes (a to z have their own, other
letters share the rest by a hash), a run of anything else is one gap. The blended
spectrum presence kernel of two texts is the size of the intersection of their
sets over the geometric mean of their sizes.

Nystroem landmarks, a few texts of each language, turn the kernel into finite
features; one-versus-rest ridge regression on them is folded into one matrix, so a
batch is scored by two matrix products: presence x landmark presence, x weights.

The fit uses a bounded sample: at most `per_language` labelled texts of each
language, those of least hash, of which `landmarks` per language are landmarks.
Whole texts are read, in fitting and in prediction.

Defined results: a null text, or one without a letter, is `und` with score 0;
equal texts get equal answers; ties go to the language first in order; without
labelled texts everything is `und`. Predictions are a column, so rows keep all
their other columns.
"""

from __future__ import annotations

from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codestrata.llm.text import bounded_batches, release_memory

ORDER = 3
PER_LANGUAGE = 300
LANDMARKS = 24
RIDGE = 1e-3
UNKNOWN = "und"
N_GRAMS = sum(64**n for n in range(1, ORDER + 1))
AT_ONCE = 256
PIECE = 1 << 20  # characters of a text that are turned into n-grams together
RESULT = T.StructType().add("lang_pred", T.StringType()).add("score", T.DoubleType())


def _alphabet() -> np.ndarray:
    """Code of each character of the basic plane; 0 is no letter."""
    code = np.zeros(1 << 16, np.uint8)
    for i in range(1 << 16):
        c = chr(i)
        if c.isalpha():
            low = ord(c.lower()[0])
            code[i] = low - 96 if 97 <= low <= 122 else 27 + (low * 40503 >> 4) % 37
    return code


class Grams:
    """The n-gram sets of texts. One object serves one batch after another."""

    def __init__(self):
        self.code = _alphabet()
        self.flag = np.zeros(N_GRAMS, np.bool_)

    def codes(self, text: str) -> np.ndarray:
        """Letter codes, with one 0 for each run of other characters."""
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        c = self.code[np.minimum(points, 0xFFFF)]
        far = points > 0xFFFF
        if far.any():
            c[far] = [27 + (p * 40503 >> 4) % 37 if chr(p).isalpha() else 0 for p in points[far].tolist()]
        full = c != 0
        keep = full.copy()
        keep[1:] |= full[:-1]
        return c[keep]

    def mark(self, text: str) -> np.ndarray:
        """Set the flags of the text's n-grams; returns their ids, with repeats, for `clear`."""
        ids = []
        for i in range(0, len(text), PIECE):  # pieces overlap, so no n-gram is lost between them
            c = np.r_[0, self.codes(text[max(0, i - ORDER) : i + PIECE]), 0].astype(np.int32)
            if not c.any():
                continue
            g, base = c, 0
            ids.append(np.unique(c) if ORDER > 1 else c)
            for n in range(2, ORDER + 1):
                base += 64 ** (n - 1)
                g = (g[:-1] << 6) | c[n - 1 :]
                ids.append(g + base if len(text) <= PIECE else np.unique(g + base))
        ids = np.concatenate(ids) if ids else np.zeros(0, np.int32)
        self.flag[ids] = True
        return ids

    def clear(self, ids: np.ndarray) -> None:
        self.flag[ids] = False

    def ids(self, text: str | None) -> np.ndarray:
        """The text's n-grams, in order."""
        marked = self.mark(text or "")
        out = np.unique(marked)
        self.clear(marked)
        return out.astype(np.int32)


class LanguageModel:
    """Languages, landmark presence and weights; small, so it travels with the plan."""

    def __init__(self, languages: list[str], grams: np.ndarray, presence: np.ndarray, sizes: np.ndarray, weights: np.ndarray):
        self.languages, self.grams, self.sizes, self.weights = languages, grams, sizes, weights
        self.packed, self.n_landmarks = np.packbits(presence.astype(bool), axis=1), presence.shape[1]

    @cached_property
    def presence(self) -> np.ndarray:
        return np.unpackbits(self.packed, axis=1, count=self.n_landmarks).astype(np.float32)

    @cached_property
    def reader(self) -> Grams:
        return Grams()

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k not in ("presence", "reader")}

    @classmethod
    def fit(cls, sets: list[tuple[str, np.ndarray]], landmarks: int = LANDMARKS, ridge: float = RIDGE) -> LanguageModel:
        """sets: (language, n-gram ids); the first `landmarks` of a language are landmarks."""
        sets = [(lang, ids) for lang, ids in sets if len(ids)]
        languages = sorted({lang for lang, _ in sets})
        if not languages:
            return cls([], np.zeros(0, np.int32), np.zeros((0, 0)), np.zeros(0), np.zeros((0, 0)))
        marks = [ids for lang in languages for ids in [x for name, x in sets if name == lang][:landmarks]]
        grams = np.unique(np.concatenate(marks))
        presence = np.zeros((len(grams), len(marks)), np.float32)
        for j, ids in enumerate(marks):
            presence[np.searchsorted(grams, ids), j] = 1
        sizes = np.array([len(x) for x in marks], np.float64)
        own = np.zeros((len(sets), len(grams)), np.float32)
        for i, (_, ids) in enumerate(sets):
            at = np.minimum(np.searchsorted(grams, ids), len(grams) - 1)
            own[i, at[grams[at] == ids]] = 1
        k = (own @ presence).astype(np.float64) / np.sqrt(np.outer([len(x) for _, x in sets], sizes))
        kmm = (presence.T @ presence).astype(np.float64) / np.sqrt(np.outer(sizes, sizes))
        value, vector = np.linalg.eigh(kmm)
        root = vector @ np.diag(1 / np.sqrt(np.maximum(value, 1e-6))) @ vector.T
        features = np.c_[k @ root, np.ones(len(sets))]
        goal = np.array([[1.0 if lang == name else -1.0 for name in languages] for lang, _ in sets])
        balance = np.array([1 / sum(x == lang for x, _ in sets) for lang, _ in sets])[:, None]  # each language weighs the same
        solved = np.linalg.solve(features.T @ (balance * features) + ridge * np.eye(features.shape[1]), features.T @ (balance * goal))
        return cls(languages, grams, presence, sizes, np.r_[root @ solved[:-1], solved[-1:]])

    def predict(self, texts: pa.Array) -> tuple[list[str], np.ndarray]:
        """Language and score (the softmax of four times the regression values) of each text."""
        names, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
        if not self.languages:
            return names, scores
        for a in range(0, len(texts), AT_ONCE):
            batch = texts.slice(a, AT_ONCE).to_pylist()
            rows, sizes = np.zeros((len(batch), len(self.grams)), np.float32), np.zeros(len(batch))
            for i, text in enumerate(batch):
                marked = self.reader.mark(text or "")
                if len(marked):
                    rows[i], sizes[i] = self.reader.flag[self.grams], np.count_nonzero(self.reader.flag)
                    self.reader.clear(marked)
            full = sizes > 0
            k = (rows[full] @ self.presence).astype(np.float64) / np.sqrt(np.outer(sizes[full], self.sizes))
            value = k @ self.weights[:-1] + self.weights[-1]
            best = value.argmax(axis=1)
            share = np.exp(4 * (value - value.max(axis=1, keepdims=True)))
            for i, j, s in zip(np.flatnonzero(full), best, 1 / share.sum(axis=1)):
                names[a + i], scores[a + i] = self.languages[j], s
        return names, scores

    def column(self, text: Column) -> Column:
        """struct(lang_pred, score)."""

        @F.arrow_udf(RESULT)
        def predict(texts: pa.Array) -> pa.Array:
            names, scores = self.predict(texts)
            release_memory()
            return pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(scores)], ["lang_pred", "score"])

        return predict(text)


@F.arrow_udf(T.BinaryType())
def _gram_set(texts: pa.Array) -> pa.Array:
    reader = Grams()
    return pa.array([reader.ids(t.as_py()).tobytes() for t in texts], pa.binary())


def train(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = PER_LANGUAGE, landmarks: int = LANDMARKS) -> LanguageModel:
    """Fit on at most `per_language` rows of each language, drawn by the hash of the id among those with a text and a label.

    The languages are counted first; a hash threshold leaves about twice the bound,
    so that ranking touches a bounded number of rows, however many a language has.
    """
    bounded_batches(labelled.sparkSession)
    rows = labelled.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), F.xxhash64(F.col(id_col)).alias("h"))
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return LanguageModel.fit([])
    share = F.create_map(*[F.lit(x) for lang, n in sorted(counts.items()) for x in (lang, min(1.0, 2 * per_language / n))])
    drawn = rows.filter(F.pmod("h", F.lit(1 << 40)) < F.element_at(share, F.col("lang")) * float(1 << 40))
    place = F.row_number().over(Window.partitionBy("lang").orderBy("h", "size", F.md5("text")))
    sample = drawn.withColumn("size", F.length("text")).withColumn("place", place).filter(F.col("place") <= per_language)
    found = sample.select("lang", "place", _gram_set("text").alias("grams")).orderBy("lang", "place").collect()
    return LanguageModel.fit([(r["lang"], np.frombuffer(r["grams"], np.int32)) for r in found], landmarks)


def identify(df: DataFrame, model: LanguageModel, text_col: str = "text", name: str = "lang_id") -> DataFrame:
    """df with a column `name`: struct(lang_pred, score)."""
    bounded_batches(df.sparkSession)
    return df.withColumn(name, model.column(F.col(text_col)))

"""Toxicity by a weighted lexicon.

A text is folded: case, accents, look-alike letters of other scripts, digits and signs
that stand for letters, invisible characters, letters set apart, letters drawn out. The
folded words are matched by one Aho-Corasick automaton against the lexicon's terms
(whole words, or beginnings of words written with a final `*`) and its exception
phrases; a term inside an exception phrase does not count. The weights found, for each
hundred words, give the score through a logistic curve.

The lexicon is learned from labelled documents. A bounded sample of each label, chosen
by a hash of ids and counted once where near copies repeat, names the candidates: words
and beginnings of words that toxic texts have far more often. Ridge-penalised logistic
regression on how often a text has them in a hundred words gives their weights, so that
common words and words that others explain already weigh little. Phrases around a term that only harmless texts
have become exceptions. The curve is fitted on weights that were learned without the
document at hand (two halves), so that it knows how far the lexicon can be trusted.

Defined results: a null text counts as empty; a text without words has the score of one
without any term. With no labels of one of the two kinds, there are no terms and every
text scores the smoothed share of toxic ones, 0 if nothing is labelled. Several labels
of an id count as toxic if one is; null labels and ids do not count. Repeated rows are
rows of their own; an empty table gives no rows. Only id and text of the documents, id
and the toxic mark of the labels are read, so further columns cannot clash.
"""

from __future__ import annotations

import json
import math
import re
import unicodedata
import zlib
from collections.abc import Iterable
from dataclasses import dataclass
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codestrata.llm.text import bounded_batches, release_memory
from codestrata.session import Scratch

#: Labelled documents of each label that the lexicon is learned from, at most. The driver holds a row of MAX_TERMS numbers for each.
PER_LABEL = 5000
#: Numbers of terms that are tried; the one that tells most about documents it was not learned from stays.
SIZES = (12, 25, 50, 100, 200, 400)
MAX_TERMS = max(SIZES)
#: Lengths of the beginnings of words that may become terms.
STEMS = range(4, 9)
#: How many times more frequent a term is in toxic texts, at least.
RATIO = 10
#: Score from which a text is predicted toxic.
THRESHOLD = 0.3

# Letters of other scripts, and the Latin ones that they look like.
LOOKS = dict(zip("аеорсухіјѕһԁԛԝвкмнтαβεηικνορτυχωıøłđ", "aeopcyxijshdqwbkmhtabenikvoptuxwiold", strict=True))
# Digits and signs that stand for letters within a word.
SIGNS = dict(zip("0134578@$!|", "oieastbasii", strict=True))
#: l, 1, ! and | may each stand for i as well, so all of them are i.
LETTERS = str.maketrans(LOOKS | {"l": "i", "ł": "i"})
SIGNED = str.maketrans(SIGNS)
_WITH_SIGN = re.compile(r"[\w@$!|]*[0-9@$!|][\w@$!|]*")
_APART = re.compile(r"(?<![^\W\d_])(?:[^\W\d_][ .\-*_]){3,}[^\W\d_](?![^\W\d_])")
_DRAWN = re.compile(r"([^\W\d_])\1\1+")
_WORD = re.compile(r"[^\W\d_]+")


def _as_letters(m: re.Match) -> str:
    """A word with signs in it as letters; signs behind it and words without letters stay as they are."""
    word = m[0].rstrip("@$!|")
    letters = any(c.isalpha() for c in word)
    return word.translate(SIGNED) + " " * (len(m[0]) - len(word)) if letters else " "


def folded(text: str | None) -> list[str]:
    """The words of a text in the form that is matched."""
    s = (text or "").casefold()
    if not s.isascii():
        s = "".join(c for c in unicodedata.normalize("NFKD", s) if unicodedata.category(c) not in ("Mn", "Cf"))
    s = _WITH_SIGN.sub(_as_letters, s.translate(LETTERS))
    s = _APART.sub(lambda m: "".join(c for c in m[0] if c.isalpha()), s)
    return _WORD.findall(_DRAWN.sub(r"\1", s))


@dataclass(frozen=True)
class Lexicon:
    """Weights of folded terms, exception phrases in folded words, and the curve from weight for each hundred words to score."""

    weights: dict[str, float]
    exceptions: tuple[str, ...] = ()
    curve: tuple[float, float] = (-4.0, 4.0)

    @staticmethod
    def of(weights: dict[str, float], exceptions: Iterable[str] = (), curve: tuple[float, float] = (-4.0, 4.0)) -> Lexicon:
        """A lexicon of terms and phrases as a person writes them; a final `*` marks the beginning of a word."""
        fold = lambda t: " ".join(folded(t.rstrip("*"))) + "*" * t.endswith("*")
        return Lexicon({fold(t): w for t, w in weights.items()}, tuple(fold(e) for e in exceptions), curve)

    def to_json(self) -> str:
        return json.dumps({"weights": self.weights, "exceptions": self.exceptions, "curve": self.curve})

    @staticmethod
    def from_json(text: str) -> Lexicon:
        held = json.loads(text)
        return Lexicon(held["weights"], tuple(held["exceptions"]), tuple(held["curve"]))


class Matcher:
    """The automaton of a lexicon's terms and phrases over ` word word ... `, spaces included."""

    def __init__(self, terms: Iterable[str], exceptions: Iterable[str] = ()):
        self.terms = list(terms)
        self.automaton = ahocorasick.Automaton()
        patterns: dict[str, list] = {}
        for i, t in enumerate(self.terms):
            patterns.setdefault(f" {t[:-1]}" if t.endswith("*") else f" {t} ", [None, False])[0] = i
        for e in exceptions:
            patterns.setdefault(f" {e} ", [None, False])[1] = True
        for p, (i, harmless) in patterns.items():
            self.automaton.add_word(p, (i, harmless, len(p)))
        if patterns:
            self.automaton.make_automaton()

    def hits(self, words: list[str]) -> list[tuple[int, int, int]]:
        """(term, start, end) in the joined words, but for those inside an exception phrase."""
        if not len(self.automaton) or not words:
            return []
        found, harmless = [], []
        for end, (i, phrase, n) in self.automaton.iter(f" {' '.join(words)} "):
            if phrase:
                harmless.append((end + 1 - n, end + 1))
            if i is not None:
                found.append((i, end + 1 - n, end + 1))
        if harmless:
            found = _outside(found, harmless)
        return found


def _outside(found: list[tuple[int, int, int]], spans: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
    """Matches that lie in no span; of the spans that begin at or before a match only the one that goes furthest matters."""
    spans, found = sorted(spans), sorted(found, key=lambda f: f[1])
    out, k, reach = [], 0, -1
    for f in found:
        while k < len(spans) and spans[k][0] <= f[1]:
            reach, k = max(reach, spans[k][1]), k + 1
        if f[2] > reach:
            out.append(f)
    return out


def rate(weight, words):
    """The weight found for each hundred words; some words more, so that short texts do not hang on one."""
    return 100 * weight / (words + 20)


def _logistic(z):
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


# -- learning --------------------------------------------------------------------
#: Odd factors, one for each hash.
SKETCHES = (0x9E3779B1, 0x85EBCA6B, 0xC2B2AE35, 0x27D4EB2F, 0x165667B1)


def sketches(words: list[str]) -> list[int]:
    """The least of three words in a row by each of several hashes: near copies share most of them, other texts none."""
    runs = [f"{a} {b} {c}" for a, b, c in zip(words, words[1:], words[2:])] or [" ".join(words)]
    h = np.array([zlib.crc32(r.encode()) for r in runs], np.uint32)
    with np.errstate(over="ignore"):
        return [int((h * np.uint32(m)).min()) for m in SKETCHES]


@F.arrow_udf(T.StructType([T.StructField("words", T.StringType()), T.StructField("sketches", T.ArrayType(T.LongType()))]))
def _prepared(texts: pa.Array) -> pa.Array:
    held = [folded(t) for t in texts.to_pylist()]
    return pa.StructArray.from_arrays([pa.array([" ".join(w) for w in held], pa.string()), pa.array([sketches(w) for w in held], pa.list_(pa.int64()))], ["words", "sketches"])


def labelled_sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, toxic_col: str, per_label: int) -> tuple[DataFrame, dict[int, float]]:
    """(toxic, words, half) of at most `per_label` documents of each label, without near copies, and how many labelled ids there are of each."""
    marks = labels.filter(F.col(id_col).isNotNull() & F.col(toxic_col).isNotNull()).groupBy(F.col(id_col).alias("__id")).agg(F.max((F.col(toxic_col) != 0).cast("int")).alias("toxic"))
    texts = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text"))
    marked = marks.join(texts.select("__id").distinct(), "__id", "left_semi")
    n = {r["toxic"]: r["n"] for r in marked.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    chosen = None
    for label in (0, 1):
        part = marked.filter(F.col("toxic") == label).orderBy(F.xxhash64("__id"), "__id").limit(per_label)
        chosen = part if chosen is None else chosen.unionByName(part)
    sample = texts.join(F.broadcast(chosen), "__id")  # 2 * per_label ids at most
    made = sample.select("toxic", _prepared("__text").alias("p")).select("toxic", "p.words", "p.sketches")
    for i in range(len(SKETCHES)):  # of texts that share a sketch one stays
        made = made.groupBy("toxic", F.get("sketches", F.lit(i)).alias("s")).agg(F.min(F.struct("sketches", "words")).alias("m")).select("toxic", "m.words", "m.sketches")
    return made.select("toxic", "words", (F.get("sketches", F.lit(0)) % 2).cast("int").alias("half")), n


@F.arrow_udf(T.ArrayType(T.StringType()))
def _terms(words: pa.Array) -> pa.Array:
    """The distinct words of each text and their beginnings."""
    out = []
    for w in words.to_pylist():
        distinct = set(w.split(" ")) - {""}
        out.append([*distinct, *{f"{x[:k]}*" for x in distinct for k in STEMS if len(x) >= k}])
    return pa.array(out, pa.list_(pa.string()))


def candidate_terms(sample: DataFrame, most: int) -> list[str]:
    """The terms that tell most, by their G statistic, first.

    In each half of the sample they are in two toxic texts or more and at least RATIO
    times as frequent there as in harmless ones; words of one copied text are in one
    half only. A beginning of words gives way to one a letter longer that nearly all its
    texts have, and a term to a beginning of it that is in as few harmless texts for
    each toxic one.
    """
    marks = {f"{kind}{h}": (kind, h, F.col("toxic") if kind == "t" else 1 - F.col("toxic")) for kind in "tc" for h in (0, 1)}
    half = F.col("half")
    n = {k: v or 0 for k, v in sample.agg(*[F.sum(F.when(half == h, mark).otherwise(0)).alias(k) for k, (_, h, mark) in marks.items()]).first().asDict().items()}
    if not all(n.values()):
        return []
    each = sample.select("toxic", "half", F.explode(_terms("words")).alias("term")).groupBy("term").agg(*[F.sum(F.when(half == h, mark).otherwise(0)).alias(k) for k, (_, h, mark) in marks.items()])
    told = sum(_g(F.col(f"t{h}"), F.col(f"c{h}"), n[f"t{h}"], n[f"c{h}"]) for h in (0, 1))
    twice = [(F.col(f"t{h}") >= 2) & ((F.col(f"t{h}") + 0.5) / (n[f"t{h}"] + 1) >= RATIO * (F.col(f"c{h}") + 0.5) / (n[f"c{h}"] + 1)) for h in (0, 1)]
    best = each.filter(twice[0] & twice[1]).select("term", told.alias("told"), (F.col("t0") + F.col("t1")).alias("t"), (F.col("c0") + F.col("c1")).alias("c")).orderBy(F.desc("told"), "term").limit(8 * most).collect()
    by = {r["term"]: r for r in best}
    gone = set()
    for term, r in by.items():
        stem = term.rstrip("*")
        shorter = [by[f"{stem[:k]}*"] for k in range(STEMS.start, len(stem) + (not term.endswith("*"))) if f"{stem[:k]}*" in by]
        gone |= {s["term"] for s in shorter if term.endswith("*") and len(s["term"]) == len(term) - 1 and r["t"] >= 0.9 * s["t"] and r["c"] <= s["c"]}
        if any(s["c"] * r["t"] <= r["c"] * s["t"] for s in shorter if s["term"] not in gone):
            gone.add(term)
    return [r["term"] for r in best if r["term"] not in gone][:most]


def _g(t: Column, c: Column, toxic: int, clean: int) -> Column:
    """Half the G statistic of a term in t of `toxic` and c of `clean` texts; a count of 0 adds nothing."""
    n, with_it = toxic + clean, t + c
    cell = lambda seen, row, column: seen * F.log(F.greatest(seen, F.lit(1)) * n / F.greatest(row * column, F.lit(1)))
    return cell(t, with_it, F.lit(toxic)) + cell(c, with_it, F.lit(clean)) + cell(toxic - t, n - with_it, F.lit(toxic)) + cell(clean - c, n - with_it, F.lit(clean))


def ridge_logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, penalty: float, rounds: int = 30) -> np.ndarray:
    """Coefficients by Newton steps, the intercept first and unpenalised; steps are halved until the loss falls."""
    full = np.hstack([np.ones((len(x), 1)), x])
    ridge = np.full(full.shape[1], penalty)
    ridge[0] = 1e-6
    loss = lambda c: float((weight * np.logaddexp(0, np.where(y > 0, -1, 1) * (full @ c))).sum() + 0.5 * (ridge * c * c).sum())
    c = np.zeros(full.shape[1])
    c[0] = math.log(max((weight * y).sum(), 0.5) / max((weight * (1 - y)).sum(), 0.5))
    now = loss(c)
    for _ in range(rounds):
        p = _logistic(full @ c)
        step = np.linalg.solve((full * (weight * p * (1 - p))[:, None]).T @ full + np.diag(ridge), full.T @ (weight * (p - y)) + ridge * c)
        size = 1.0
        while size > 1e-4 and loss(c - size * step) > now:
            size /= 2
        c = c - size * step
        new = loss(c)
        if now - new < 1e-6 * abs(now):
            break
        now = new
    return c


def _weights(rates: np.ndarray, y: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Weights of terms, none below 0, from how often each text has them in a hundred words."""
    return np.maximum(ridge_logistic(rates, y, w, 1.0)[1:], 0) if 0 < y.sum() < len(y) else np.zeros(rates.shape[1])


def exception_phrases(sample: DataFrame, terms: list[str], least: int = 3) -> tuple[str, ...]:
    """Two words, one of them matched by a term, that at least `least` harmless texts have and hardly a toxic one (a twentieth as often)."""

    @F.arrow_udf(T.ArrayType(T.StringType()))
    def around(words: pa.Array) -> pa.Array:
        matcher, out = Matcher(terms), []
        for text in words.to_pylist():
            joined, found = f" {text} ", set()
            for _, a, b in matcher.hits(text.split(" ") if text else []):
                end = joined.index(" ", a + 1)
                before, after = joined.rfind(" ", 0, a) + 1 if a else 0, joined.find(" ", end + 1)
                found |= {joined[before:end].strip(), joined[a:after].strip() if after > 0 else ""}
            out.append([p for p in found if " " in p])
        return pa.array(out, pa.list_(pa.string()))

    near = sample.select("toxic", F.explode(around("words")).alias("phrase")).groupBy("phrase").agg(F.sum("toxic").alias("t"), F.sum(1 - F.col("toxic")).alias("c"))
    return tuple(r["phrase"] for r in near.filter((F.col("c") >= least) & (F.col("t") * 20 <= F.col("c"))).orderBy(F.desc("c"), "phrase").limit(MAX_TERMS).collect())


def _found(sample: DataFrame, terms: list[str], exceptions: tuple[str, ...]) -> list[tuple[int, int, int, dict[int, int]]]:
    """(toxic, half, words, number of each term) of the sample's documents that are not near copies."""

    @F.arrow_udf(T.StructType([T.StructField("n", T.IntegerType()), T.StructField("hits", T.ArrayType(T.IntegerType()))]))
    def match(words: pa.Array) -> pa.Array:
        matcher = Matcher(terms, exceptions)
        held = [w.split(" ") if w else [] for w in words.to_pylist()]
        hits = [[i for i, _, _ in matcher.hits(w)] for w in held]
        return pa.StructArray.from_arrays([pa.array(list(map(len, held)), pa.int32()), pa.array(hits, pa.list_(pa.int32()))], ["n", "hits"])

    counted = sample.select("toxic", "half", match("words").alias("m"))
    # Counts for each term, not each occurrence: a long text has few terms, but may repeat them.
    rows = counted.select("toxic", "half", "m.n", F.transform(F.array_distinct("m.hits"), lambda t: F.struct(t.alias("t"), F.size(F.filter("m.hits", lambda h: h == t)).alias("k"))).alias("terms"))
    return [(r["toxic"], r["half"], r["n"], {x["t"]: x["k"] for x in r["terms"]}) for r in rows.collect()]


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", toxic_col: str = "toxic", per_label: int = PER_LABEL, max_terms: int = MAX_TERMS, exceptions: Iterable[str] = ()) -> Lexicon:
    """The lexicon of the documents that `labels` marks; `exceptions` are further phrases that are harmless."""
    bounded_batches(docs.sparkSession)
    scratch = Scratch(docs.sparkSession, "toxicity")
    sample, n = labelled_sample(docs, labels, id_col, text_col, toxic_col, per_label)
    total = sum(n.values())
    share = (n.get(1, 0) + 0.5) / (total + 1) if total else 0.0
    flat = Lexicon({}, curve=(math.log(share / (1 - share)) if share else -40.0, 0.0))
    sample = scratch.write(sample)
    terms = candidate_terms(sample, max_terms)
    if not terms:
        return flat
    given = tuple(" ".join(folded(e)) for e in exceptions)
    harmless = (*given, *exception_phrases(sample, terms))
    found = _found(sample, terms, harmless)
    y, half = np.array([f[0] for f in found], float), np.array([f[1] for f in found])
    words = np.array([f[2] for f in found], float)
    count = np.zeros((len(found), len(terms)), np.float32)
    for row, f in zip(count, found):
        for t, k in f[3].items():
            row[t] = k
    # Each document stands for as many of its label as the sample has taken one from.
    weight = np.where(y > 0, n.get(1, 0) / max(1, y.sum()), n.get(0, 0) / max(1, (1 - y).sum()))
    weight /= weight.mean()
    rates = rate(count, words[:, None])
    best = None
    for size in sorted({min(k, len(terms)) for k in SIZES}):
        x, apart = rates[:, :size], np.zeros(len(found))
        for k in (0, 1):
            apart[half == k] = x[half == k] @ _weights(x[half != k], y[half != k], weight[half != k])
        seen = np.log1p(apart)[:, None]
        curve = ridge_logistic(seen, y, weight, 1e-3)
        loss = float((weight * np.logaddexp(0, np.where(y > 0, -1, 1) * (curve[0] + seen[:, 0] * curve[1]))).sum())
        if best is None or loss < best[0]:
            best = (loss, size, curve)
    _, size, (a, b) = best
    scratch.drop()
    kept = {t: round(float(w), 6) for t, w in zip(terms, _weights(rates[:, :size], y, weight)) if w > 0}
    return Lexicon(kept, harmless, (float(a), max(float(b), 0.0)))


# -- scoring ---------------------------------------------------------------------
SCORED = T.StructType([T.StructField("score", T.DoubleType()), T.StructField("weight", T.DoubleType()), T.StructField("n_words", T.LongType()), T.StructField("terms", T.ArrayType(T.StringType()))])


@lru_cache(maxsize=4)
def _ready(text: str) -> tuple[Matcher, list[float]]:
    lexicon = Lexicon.from_json(text)
    return Matcher(lexicon.weights, lexicon.exceptions), list(lexicon.weights.values())


def judged(texts: list[str | None], lexicon: Lexicon) -> list[tuple[float, float, int, list[str]]]:
    """(score, weight, words, terms in their order) of each text."""
    matcher, weights = _ready(lexicon.to_json())
    out = []
    for t in texts:
        words = folded(t)
        hits = sorted(matcher.hits(words), key=lambda h: (h[1], h[0]))
        weight = float(sum(weights[i] for i, _, _ in hits))
        z = lexicon.curve[0] + lexicon.curve[1] * math.log1p(rate(weight, len(words)))
        out.append((float(_logistic(z)), weight, len(words), [matcher.terms[i] for i, _, _ in hits]))
    return out


def toxicity(text: Column, lexicon: Lexicon) -> Column:
    """struct(score, weight, n_words, terms) of a text."""

    @F.arrow_udf(SCORED)
    def run(texts: pa.Array) -> pa.Array:
        found = list(zip(*judged(texts.to_pylist(), lexicon))) or [(), (), (), ()]
        out = pa.StructArray.from_arrays([pa.array(found[0], pa.float64()), pa.array(found[1], pa.float64()), pa.array(found[2], pa.int64()), pa.array(found[3], pa.list_(pa.string()))], ["score", "weight", "n_words", "terms"])
        release_memory()
        return out

    return run(text)

"""Language-model scoring: a bigram model in sharded Elias-Fano tries.

Texts are packed once into batch rows: the batch's distinct tokens as 64-bit hashes,
and the texts as indices into them. What travels later are compressed blocks of sorted
pairs, never a row for each word.

1. Batches send their tokens and training counts to token shards, which return the
   total of each token and its id: its rank by frequency in the shard, spread so that
   ids of shards do not meet. Frequent tokens have small ids, which compress well.
   They travel by way of bundles: shards form groups and batches form bundles, of about
   the square root of their number each; a batch writes a block for each group, a bundle
   merges the blocks of a group and writes a block for each shard. So with B batches
   there are about B^1.5 blocks, not B^2, and tokens that batches share travel once.
2. Batches send their distinct bigrams with training counts to bigram shards, in the
   same way.
   A shard merges, smooths,  P(w | v) = (c(v w) + MU * P(w)) / (c(v) + MU),  and writes
   the trie; then it looks up all that the bundles ask for.
3. Answers go back the same way, and batches put them to their texts. An unseen bigram
   has MU / (c(v) + MU) * P(w). P(w) = (1 - e) c / N, or e, the share of tokens seen
   once, for any unknown token. The context of the first token is the end token.

A context is dealt to as many shards as its share of the corpus asks for, so a word
that follows everywhere does not fill one shard. Shards and batches grow in number
with the corpus, not in size. Probabilities in the trie have 16 bits, the P(w) in
them is taken from counts rounded to 0.5 %.

Two tokens count as one if their 63-bit hashes meet; bigrams of ids are exact.

Defined results: a null text is empty, and an empty text is one end token; without
training text every token is unknown; repeated rows count each; rows with null ids
train; an empty table gives no rows. Only the id, text and training flag are read.
"""

from __future__ import annotations

import math
import random
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codestrata.llm.eliasfano import ABSENT, Trie, dequantise, quantise
from codestrata.llm.simhash import split_words
from codestrata.llm.text import bounded_batches, release_memory
from codestrata.session import Scratch

MU = 512.0  # the best of the powers of 4 on held-out text
BATCH_BYTES = 4 << 20
KEY_MASK = np.uint64((1 << 63) - 1)
END = np.uint64(xxhash.xxh64_intdigest(b"\n")) & KEY_MASK  # no word is a line break
BATCH = "batch long, ids binary, train binary, lengths binary, tokens binary, keys binary"
LOG_STEP = 0.004


def _put(a: np.ndarray) -> bytes:
    """An array, its bytes of equal weight side by side, compressed."""
    a = np.ascontiguousarray(a)
    return zstandard.ZstdCompressor(level=1).compress(a.view(np.uint8).reshape(len(a), -1).T.tobytes())


def _get(data: bytes, kind) -> np.ndarray:
    raw, width = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8), np.dtype(kind).itemsize
    return np.ascontiguousarray(raw.reshape(width, -1).T).view(kind).reshape(-1)


def _rows(out: list[dict], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(out, schema)


BATCH_ARROW = pa.schema([("batch", pa.int64()), *((n, pa.binary()) for n in ("ids", "train", "lengths", "tokens", "keys"))])
TOKEN_ARROW = pa.schema([("place", pa.int32()), ("bundle", pa.int64()), ("batch", pa.int64()), ("keys", pa.binary()), ("counts", pa.binary())])
TOTAL_ARROW = pa.schema([("place", pa.int32()), ("bundle", pa.int64()), ("group", pa.int32()), ("totals", pa.binary()), ("ranks", pa.binary()), ("tokens", pa.int64()), ("distinct", pa.int64()), ("once", pa.int64())])
KNOWN_ARROW = pa.schema([("place", pa.int32()), ("batch", pa.int64()), ("totals", pa.binary()), ("ids", pa.binary())])
BLOCK_ARROW = pa.schema([("place", pa.int32()), ("bundle", pa.int64()), ("batch", pa.int64()), ("contexts", pa.binary()), ("successors", pa.binary()), ("counts", pa.binary()), ("levels", pa.binary())])
CODE_ARROW = pa.schema([("place", pa.int32()), ("bundle", pa.int64()), ("group", pa.int32()), ("batch", pa.int64()), ("answer", pa.binary())])
TOKEN = "place int, bundle long, batch long, keys binary, counts binary"
TOTAL, KNOWN = "place int, bundle long, group int, totals binary, ranks binary, tokens long, distinct long, once long", "place int, batch long, totals binary, ids binary"
PAIRS, CODES = "place int, bundle long, batch long, contexts binary, successors binary, counts binary, levels binary", "place int, bundle long, group int, batch long, answer binary"


class Pairs:
    """Bigrams (v, w) sorted by v, then w, with training counts, the rounded totals of w and the totals of v."""

    def __init__(self, v: np.ndarray, w: np.ndarray, count: np.ndarray, level: np.ndarray, total: np.ndarray):
        self.v, self.w, self.count, self.level, self.total = v, w, count, level, total

    def take(self, i: np.ndarray) -> Pairs:
        return Pairs(self.v[i], self.w[i], self.count[i], self.level[i], self.total[i])

    def pack(self) -> dict[str, bytes]:
        """Contexts once each; successors as steps from the one before in their context."""
        first = np.flatnonzero(np.r_[True, self.v[1:] != self.v[:-1]])
        step = np.diff(self.w, prepend=0)
        step[first] = self.w[first]
        head = np.concatenate([np.diff(self.v[first], prepend=0), np.diff(np.r_[first, len(self.v)]), self.total[first]]).astype(np.int64)
        return {"contexts": _put(head), "successors": _put(step.astype(np.int64)), "counts": _put(self.count.astype(np.uint32)), "levels": _put(self.level.astype(np.uint16))}

    @staticmethod
    def unpack(row: dict) -> Pairs:
        v, lengths, total = _get(row["contexts"], np.int64).reshape(3, -1)
        step = _get(row["successors"], np.int64)
        first = np.cumsum(lengths) - lengths
        run = np.cumsum(step)
        w = run - np.repeat(run[first] - step[first], lengths)
        return Pairs(np.repeat(np.cumsum(v), lengths), w, _get(row["counts"], np.uint32).astype(np.int64), _get(row["levels"], np.uint16), np.repeat(total, lengths))

    @staticmethod
    def merge(parts: list[Pairs]) -> tuple[Pairs, np.ndarray]:
        """All distinct pairs with their counts added, and for each pair of the parts in a row its place among them."""
        v, w, count, level, total = (np.concatenate([getattr(p, k) for p in parts]) for k in ("v", "w", "count", "level", "total"))
        order = np.lexsort((w, v))
        v, w = v[order], w[order]
        new = np.r_[True, (v[1:] != v[:-1]) | (w[1:] != w[:-1])]
        place = np.empty(len(v), np.int64)
        place[order] = np.cumsum(new) - 1
        first = order[new]
        return Pairs(v[new], w[new], np.bincount(place, count, len(first)).astype(np.int64), level[first], total[first]), place


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (id, train, text) to batch rows. The ids of the batches are random; the table is written before use."""
    held, size = [], 0

    def flush() -> pa.RecordBatch:
        t = pa.Table.from_batches(held).combine_chunks()
        count, words = split_words(t["text"].chunk(0))
        coded = words.dictionary_encode()
        names = coded.dictionary
        data, at = names.buffers()[2], np.frombuffer(names.buffers()[1], np.int32)[names.offset : names.offset + len(names) + 1].tolist()
        raw, digest = data.to_pybytes() if data else b"", xxhash.xxh64_intdigest
        keys = np.fromiter((digest(raw[a:b]) for a, b in zip(at, at[1:])), np.uint64, len(names)) & KEY_MASK
        keys, place = np.unique(np.r_[keys, END], return_inverse=True)
        tokens = np.full(len(words) + len(count), place[-1], np.int32)
        ends = np.cumsum(count + 1) - 1
        inner = np.ones(len(tokens), bool)
        inner[ends] = False
        tokens[inner] = place[coded.indices.to_numpy()]
        common = np.argsort(-np.bincount(tokens, minlength=len(keys)), kind="stable")  # small numbers for common tokens compress best
        rank = np.empty(len(keys), np.int32)
        rank[common] = np.arange(len(keys), dtype=np.int32)
        tokens, keys = rank[tokens], keys[common]
        ids = t["id"].chunk(0)
        valid = ids.is_valid().to_numpy(zero_copy_only=False)
        flags = t["train"].chunk(0).to_numpy(zero_copy_only=False).astype(np.uint8) | (valid.astype(np.uint8) << 1)
        return _rows([{"batch": random.getrandbits(62), "ids": _put(ids.fill_null(0).to_numpy()), "train": _put(flags), "lengths": _put((count + 1).astype(np.int64)), "tokens": _put(tokens), "keys": _put(keys)}], BATCH_ARROW)

    for b in batches:
        held.append(b)
        size += b["text"].nbytes
        if size >= BATCH_BYTES:
            yield flush()
            held, size = [], 0
            release_memory()
    if sum(len(b) for b in held):
        yield flush()
    release_memory()


def _training(row: dict, tokens: np.ndarray) -> np.ndarray:
    """For each token of the batch whether its text trains."""
    return np.repeat((_get(row["train"], np.uint8) & 1).astype(bool), _get(row["lengths"], np.int64))


def _by_shard(shard: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(shard, positions in order) of each shard."""
    order = np.argsort(shard, kind="stable")
    cut = np.flatnonzero(np.r_[True, shard[order][1:] != shard[order][:-1]]) if len(order) else []
    for a, b in zip(cut, [*cut[1:], len(order)]):
        yield int(shard[order[a]]), order[a:b]


def _mixed(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
        return x ^ (x >> np.uint64(29))


class Tokens:
    """The ways of tokens between batches and the shards that count them."""

    def __init__(self, shards: int, batches: int):
        self.shards = shards
        self.width = math.isqrt(shards - 1) + 1  # shards of a group
        self.bundles = max(1, math.isqrt(batches))

    def shard(self, keys: np.ndarray) -> np.ndarray:
        return (_mixed(keys) % np.uint64(self.shards)).astype(np.int64)

    def ask(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The batches' tokens and training counts, a block for each group of shards."""
        for b in batches:
            for row in b.to_pylist():
                tokens, keys = _get(row["tokens"], np.int32), _get(row["keys"], np.uint64)
                counts = np.bincount(tokens[_training(row, tokens)], minlength=len(keys))
                bundle = row["batch"] % self.bundles
                yield _rows([{"place": g, "bundle": bundle, "batch": row["batch"], "keys": _put(keys[i]), "counts": _put(counts[i])} for g, i in _by_shard(self.shard(keys) // self.width)], TOKEN_ARROW)
                release_memory()

    @staticmethod
    def _merged(rows: list[dict]) -> tuple[np.ndarray, np.ndarray, list[int]]:
        """The distinct keys of all rows, the place of each row's keys among them, and the rows' lengths."""
        keys = [_get(r["keys"], np.uint64) for r in rows]
        distinct, place = np.unique(np.concatenate(keys), return_inverse=True)
        return distinct, place, [len(k) for k in keys]

    def gather(self, table: pa.Table) -> pa.Table:
        """A bundle's blocks of one group, merged, to a block for each shard."""
        rows = table.to_pylist()
        distinct, place, _ = self._merged(rows)
        counts = np.bincount(place, np.concatenate([_get(r["counts"], np.int64) for r in rows]), len(distinct)).astype(np.int64)
        out = [{"place": s, "bundle": rows[0]["bundle"], "batch": 0, "keys": _put(distinct[i]), "counts": _put(counts[i])} for s, i in _by_shard(self.shard(distinct))]
        release_memory()
        return pa.Table.from_pylist(out, TOKEN_ARROW)

    def total(self, table: pa.Table) -> pa.Table:
        """One shard: the total of each key and its rank by total, for every bundle that has it; the shard's sums stand in its first row."""
        rows = table.to_pylist()
        distinct, place, sizes = self._merged(rows)
        total = np.bincount(place, np.concatenate([_get(r["counts"], np.int64) for r in rows]), len(distinct)).astype(np.int64)
        rank = np.empty(len(distinct), np.int64)
        rank[np.argsort(-total, kind="stable")] = np.arange(len(distinct))
        sums, none = {"tokens": int(total.sum()), "distinct": int((total > 0).sum()), "once": int((total == 1).sum())}, {"tokens": 0, "distinct": 0, "once": 0}
        out, at = [], 0
        for i, (r, n) in enumerate(zip(rows, sizes)):
            own = place[at : at + n]
            out.append({"place": r["place"], "bundle": r["bundle"], "group": r["place"] // self.width, "totals": _put(total[own]), "ranks": _put(rank[own]), **(none if i else sums)})
            at += n
        release_memory()
        return pa.Table.from_pylist(out, TOTAL_ARROW)

    def give_back(self, asked: pa.Table, answers: pa.Table) -> pa.Table:
        """The shards' totals and ids for a bundle and group, dealt to its batches."""
        rows = asked.to_pylist()
        if not rows:
            return pa.Table.from_pylist([], KNOWN_ARROW)
        distinct, place, sizes = self._merged(rows)
        by = {a["place"]: a for a in answers.to_pylist()}
        total, ids = np.zeros(len(distinct), np.int64), np.zeros(len(distinct), np.int64)
        for s, i in _by_shard(self.shard(distinct)):
            total[i], ids[i] = _get(by[s]["totals"], np.int64), _get(by[s]["ranks"], np.int64) * self.shards + s
        out, at = [], 0
        for r, n in zip(rows, sizes):
            own = place[at : at + n]
            out.append({"place": r["place"], "batch": r["batch"], "totals": _put(total[own]), "ids": _put(ids[own])})
            at += n
        release_memory()
        return pa.Table.from_pylist(out, KNOWN_ARROW)


class Corpus:
    """Numbers of the training text and what follows from them."""

    def __init__(self, tokens: int, distinct: int, once: int, token_shards: int, batches: int, mu: float):
        self.n, self.v, self.tokens, self.mu = tokens, distinct, Tokens(token_shards, batches), mu
        self.pair_shards = 1 + batches
        self.width = math.isqrt(self.pair_shards - 1) + 1  # shards of a group
        self.bundles = max(1, math.isqrt(batches))
        self.unknown = (once + 1) / (tokens + 2)

    def single(self, count: np.ndarray) -> np.ndarray:
        """P(w) from counts."""
        return np.where(count > 0, (1 - self.unknown) * count / max(1, self.n), self.unknown)

    def known(self, keys: np.ndarray, answers: list[dict]) -> tuple[np.ndarray, np.ndarray]:
        """The totals and ids of a batch's keys from the answers to its groups."""
        by = {a["place"]: a for a in answers}
        total, ids = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
        for g, i in _by_shard(self.tokens.shard(keys) // self.tokens.width):
            total[i], ids[i] = _get(by[g]["totals"], np.int64), _get(by[g]["ids"], np.int64)
        return total, ids

    def shards(self, p: Pairs) -> np.ndarray:
        """The shard of each pair; the pairs of a common context lie in several."""
        slices = (1 + 4 * self.pair_shards * p.total // max(1, self.n)).astype(np.uint64)
        v, w = p.v.astype(np.uint64), p.w.astype(np.uint64)
        with np.errstate(over="ignore"):
            odd = np.uint64(0xC2B2AE3D27D4EB4F)
            return (_mixed(_mixed(v * odd + np.uint64(1)) + (_mixed(w * odd + np.uint64(7)) % slices) * odd) % np.uint64(self.pair_shards)).astype(np.int64)

    def pairs(self, row: dict, answers: list[dict]) -> tuple[Pairs, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The batch's distinct bigrams; each token's bigram; the groups of the bigrams; the tokens' totals, and those of each bigram's w."""
        tokens, keys = _get(row["tokens"], np.int32), _get(row["keys"], np.uint64)
        total, ids = self.known(keys, answers)
        order = np.argsort(ids)
        rank = np.empty(len(keys), np.int64)
        rank[order] = np.arange(len(keys))
        spots = rank[tokens]
        ends = np.cumsum(_get(row["lengths"], np.int64))
        before = np.r_[0, spots[:-1]]
        before[np.r_[0, ends[:-1]]] = rank[np.flatnonzero(keys == END)[0]]
        pair, place = np.unique(before * len(keys) + spots, return_inverse=True)
        v, w = order[pair // len(keys)], order[pair % len(keys)]
        count = np.bincount(place[_training(row, tokens)], minlength=len(v))
        level = np.where(total > 0, 1 + np.rint(np.log10(np.maximum(total, 1)) / LOG_STEP), 0).astype(np.uint16)
        p = Pairs(ids[v], ids[w], count, level[w], total[v])
        return p, place, self.shards(p) // self.width, total[tokens], total[w]

    def ask(self, row: dict) -> list[dict]:
        """A batch's blocks for the groups of shards."""
        p, _, group, _, _ = self.pairs(row, row["totals"])
        bundle = row["batch"] % self.bundles
        return [{"place": g, "bundle": bundle, "batch": row["batch"], **p.take(i).pack()} for g, i in _by_shard(group)]

    def gather(self, table: pa.Table) -> pa.Table:
        """A bundle's blocks of one group, merged, to a block for each shard."""
        rows = table.to_pylist()
        p, _ = Pairs.merge([Pairs.unpack(r) for r in rows])
        out = [{"place": s, "bundle": rows[0]["bundle"], "batch": 0, **p.take(i).pack()} for s, i in _by_shard(self.shards(p))]
        release_memory()
        return pa.Table.from_pylist(out, BLOCK_ARROW)

    def answer(self, table: pa.Table) -> pa.Table:
        """One bigram shard: merge, smooth, build the trie, look everything up."""
        rows = table.to_pylist()
        parts = [Pairs.unpack(r) for r in rows]
        sizes = [len(p.v) for p in parts]
        p, place = Pairs.merge(parts)
        del parts
        level = p.level.astype(np.float64)
        single = self.single(np.where(level > 0, 10 ** ((level - 1) * LOG_STEP), 0))
        logp = np.log10((p.count + self.mu * single) / (p.total + self.mu))
        seen = p.count > 0
        held, per = np.unique(p.v[seen], return_counts=True)
        trie = Trie(held, np.r_[0, np.cumsum(per)], p.w[seen], quantise(logp[seen]))
        contexts, lengths = np.unique(p.v, return_counts=True)
        code = trie.find(contexts, lengths, p.w)
        trie.close()
        out, at = [], 0
        for r, n in zip(rows, sizes):
            out.append({"place": r["place"], "bundle": r["bundle"], "group": r["place"] // self.width, "batch": 0, "answer": _put(code[place[at : at + n]])})
            at += n
        del code, place, p, level, single, logp
        release_memory()
        return pa.Table.from_pylist(out, CODE_ARROW)

    def give_back(self, asked: pa.Table, answers: pa.Table) -> pa.Table:
        """The shards' answers to a bundle and group, dealt to its batches."""
        rows = asked.to_pylist()
        if not rows:
            return pa.Table.from_pylist([], CODE_ARROW)
        parts = [Pairs.unpack(r) for r in rows]
        p, place = Pairs.merge(parts)
        code, by = np.full(len(p.v), ABSENT, np.uint16), {a["place"]: a["answer"] for a in answers.to_pylist()}
        for s, i in _by_shard(self.shards(p)):
            code[i] = _get(by[s], np.uint16)
        out, at = [], 0
        for r, q in zip(rows, parts):
            out.append({"place": r["place"], "bundle": r["bundle"], "group": r["place"], "batch": r["batch"], "answer": _put(code[place[at : at + len(q.v)]])})
            at += len(q.v)
        release_memory()
        return pa.Table.from_pylist(out, CODE_ARROW)

    def scores(self, row: dict) -> dict[str, np.ndarray]:
        """The results of a batch's texts."""
        lengths = _get(row["lengths"], np.int64)
        p, place, group, total, single = self.pairs(row, row["totals"])
        by = {a["place"]: a["answer"] for a in row["pairs"]}
        code = np.full(len(p.v), ABSENT, np.uint16)
        for g, i in _by_shard(group):
            code[i] = _get(by[g], np.uint16)
        unseen = np.log10(self.mu / (p.total + self.mu)) + np.log10(self.single(single))
        logp = np.where(code == ABSENT, unseen, dequantise(code))
        starts = np.cumsum(lengths) - lengths
        flags = _get(row["train"], np.uint8)
        return {
            "id": pa.array(_get(row["ids"], np.int64), mask=flags < 2), "held_out": (flags & 1) == 0, "n_tokens": lengths,
            "n_known": np.add.reduceat((total > 0).astype(np.int64), starts), "train_tokens": np.full(len(lengths), self.n, np.int64),
            "base_score": np.add.reduceat(np.log10((total + 1) / (self.n + self.v + 1)), starts), "score": np.add.reduceat(logp[place], starts),
        }


def score(df: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text", mu: float = MU) -> DataFrame:
    """Every row as (id, held_out, n_tokens, n_known, train_tokens, base_score, score); rows where `train` is true are learned from."""
    spark = df.sparkSession
    bounded_batches(spark)
    scratch = Scratch(spark, "lm")
    packed = scratch.write(df.select(F.col(id_col).cast("long").alias("id"), F.coalesce(train, F.lit(True)).alias("train"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).mapInArrow(_pack, BATCH))
    batches = packed.count()
    token_shards = 1 + batches // 8

    ways = Tokens(token_shards, batches)
    asked = packed.select("batch", "train", "lengths", "tokens", "keys").mapInArrow(ways.ask, TOKEN)
    merged = scratch.write(asked.groupBy("bundle", "place").applyInArrow(lambda table: ways.gather(table), TOKEN))
    totals = scratch.write(merged.groupBy("place").applyInArrow(lambda table: ways.total(table), TOTAL))
    sums = totals.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("tokens", "distinct", "once")]).first()
    corpus = Corpus(sums["tokens"], sums["distinct"], sums["once"], token_shards, batches, mu)
    dealt = asked.withColumn("group", F.col("place")).groupBy("bundle", "group").cogroup(totals.groupBy("bundle", "group"))
    found = scratch.write(dealt.applyInArrow(lambda asked, answers: ways.give_back(asked, answers), KNOWN))
    known = scratch.write(packed.join(found.groupBy("batch").agg(F.collect_list(F.struct("place", "totals", "ids")).alias("totals")), "batch"))
    scratch.drop(keep=1)  # all that follows reads `known` alone

    def each(what):
        def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in rows:
                for r in b.to_pylist():
                    yield what(r)
                    release_memory()

        return run

    def ask() -> DataFrame:
        return known.mapInArrow(each(lambda r: _rows(corpus.ask(r), BLOCK_ARROW)), PAIRS)

    # Each step is written, as then what the one before was shuffled through can go. The batches' blocks are made twice rather than kept.
    blocks = scratch.write(ask().groupBy("bundle", "place").applyInArrow(lambda table: corpus.gather(table), PAIRS))
    codes = scratch.write(blocks.groupBy("place").applyInArrow(lambda table: corpus.answer(table), CODES))
    back = ask().withColumn("group", F.col("place")).groupBy("bundle", "group").cogroup(codes.groupBy("bundle", "group"))
    answers = scratch.write(back.applyInArrow(lambda asked, found: corpus.give_back(asked, found), CODES).select("batch", "place", "answer"))
    kind = "id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    full = known.join(answers.groupBy("batch").agg(F.collect_list(F.struct("place", "answer")).alias("pairs")), "batch")
    return full.mapInArrow(each(lambda r: pa.RecordBatch.from_pydict(corpus.scores(r))), kind).withColumnRenamed("id", id_col)

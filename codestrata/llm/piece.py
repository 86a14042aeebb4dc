"""SentencePiece encoding and decoding by suffix-array matching.

A batch's texts are cut into units, a space and what follows up to the next one; no
piece reaches over such a cut. The distinct units that are not yet known are
concatenated and indexed: their suffixes are sorted to the depth of 16 bytes. Every
piece of the vocabulary is binary-searched for its range of occurrences. Written in
order of length, the ranges leave the longest piece that starts at each position;
the shorter ones there are its chain of prefixes, so an edge list sorted by position
costs one number for each position. Each unit's edges are then relaxed from left to
right:

* BPE models: of the edges into the lattice only those stay whose piece can follow
  the piece before it, that is, no merge of higher rank crosses the border between
  them. A sequence of pieces is the BPE encoding exactly if each border holds, so
  the first path to the end, longest edges first, is the encoding.
* unigram models: the path of the highest sum of scores.

Characters outside the vocabulary become byte pieces, or the unknown piece where the
model has none. Units with runs of spaces, whose merges are of equal rank in such
models, and those with NUL are merged step by step instead, from a heap, so that a run
of any length costs no more than n log n.

Defined results: a null or empty text has no pieces and decodes to the empty text;
equal texts have equal pieces; whole texts are encoded; U+2581 counts as a space, as
in the model's own normal form. Encodings are a column, so rows keep all their other
columns.
"""

from __future__ import annotations

import codecs
import hashlib
import heapq
from dataclasses import dataclass
from functools import cached_property
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codestrata.llm.text import release_memory

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
HELD_UNITS, HELD_CHARS, HELD_PAIRS = 400_000, 8_000_000, 500_000
#: So many characters are split, indexed and matched at once; a text is not cut.
AT_ONCE = 1 << 18
BREAK = -1
codecs.register_error("each-byte", lambda e: ("�" * (e.end - e.start), e.end))


@dataclass(frozen=True)
class Vocabulary:
    """What of a model the encoder needs; small enough to travel with the plan."""

    pieces: tuple[str, ...]
    scores: tuple[float, ...]
    kinds: tuple[int, ...]  # 1 normal, 2 unknown, 3 control, 4 user defined, 5 unused, 6 byte
    bpe: bool

    @staticmethod
    def load(path: str = MODEL) -> Vocabulary:
        """Read a model file whose normal form is the identity with a leading space."""
        from sentencepiece import sentencepiece_model_pb2

        m = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            m.ParseFromString(f.read())
        n = m.normalizer_spec
        if n.precompiled_charsmap or n.remove_extra_whitespaces or not n.add_dummy_prefix or m.trainer_spec.model_type not in (1, 2):
            raise ValueError(f"{path}: its normal form or model type is not supported")
        return Vocabulary(tuple(p.piece for p in m.pieces), tuple(p.score for p in m.pieces), tuple(p.type for p in m.pieces), m.trainer_spec.model_type == 2)

    @cached_property
    def key(self) -> str:
        return hashlib.sha1(repr((self.bpe, self.pieces, self.scores, self.kinds)).encode()).hexdigest()


class Encoder:
    """Encodes and decodes batches; keeps a bounded memory of units already encoded."""

    def __init__(self, vocabulary: Vocabulary):
        v = self.v = vocabulary
        normal = [i for i, k in enumerate(v.kinds) if k in (1, 4)]
        if any(SPACE in v.pieces[i].lstrip(SPACE) for i in normal):
            raise ValueError("a piece holds a space after its start")
        self.id = {v.pieces[i]: i for i in normal}
        self.unk = next((i for i, k in enumerate(v.kinds) if k == 2), 0)
        self.byte = {int(v.pieces[i][1:-1], 16): i for i, k in enumerate(v.kinds) if k == 6}
        self.raw = [b"" if k == 3 else b" \xe2\x81\x87 " if k == 2 else bytes([int(p[1:-1], 16)]) if k == 6 else p.replace(SPACE, " ").encode() for p, k in zip(v.pieces, v.kinds)]
        self.length = [len(p.encode()) for p in v.pieces]
        self.shorter = [-1] * len(v.pieces)  # the longest piece that is a proper prefix
        for i in normal:
            p = v.pieces[i]
            self.shorter[i] = next((self.id[p[:n]] for n in range(len(p) - 1, 0, -1) if p[:n] in self.id), -1)
        self.usable = normal
        if v.bpe:
            self.parts = {i: self._last_merge(v.pieces[i]) for i in normal if len(v.pieces[i]) > 1 and v.pieces[i].count(SPACE) < 2}
            odd = [i for i, p in self.parts.items() if p is not None and not all(len(v.pieces[x]) == 1 or v.scores[x] > v.scores[i] for x in p)]
            if odd:
                raise ValueError("a piece outranks its own parts")
            self.usable = [i for i in normal if v.pieces[i].count(SPACE) < 2 and self.parts.get(i, ()) is not None]
            drop = set(normal) - set(self.usable)
            for i in normal:  # chains pass over what no path may use
                while self.shorter[i] in drop:
                    self.shorter[i] = self.shorter[self.shorter[i]]
            self.follows: dict[int, bool] = {}
        encoded = sorted(((v.pieces[i].encode(), i) for i in self.usable), key=lambda x: (len(x[0]), x[0]))
        self.search = encoded
        head = [int.from_bytes(p[:8].ljust(8, b"\0"), "big") for p, _ in encoded]
        tail = [int.from_bytes(p[:8].ljust(8, b"\xff"), "big") for p, _ in encoded]
        self.head, self.tail = np.array(head, np.uint64), np.array(tail, np.uint64)
        self.forget()

    # -- memory of units ---------------------------------------------------
    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.start, self.size, self.flat, self.used, self.chars = np.zeros(1024, np.int64), np.zeros(1024, np.int64), np.zeros(8192, np.int32), 0, 0

    def _remember(self, unit: str, ids: list[int]) -> None:
        n = len(self.known)
        if n == len(self.start):
            self.start, self.size = np.resize(self.start, 2 * n), np.resize(self.size, 2 * n)
        while self.used + len(ids) > len(self.flat):
            self.flat = np.resize(self.flat, 2 * len(self.flat))
        self.start[n], self.size[n] = self.used, len(ids)
        self.flat[self.used : self.used + len(ids)] = ids
        self.used, self.chars, self.known[unit] = self.used + len(ids), self.chars + len(unit), n

    # -- matching ----------------------------------------------------------
    def longest(self, data: bytes) -> np.ndarray:
        """The longest piece that starts at each byte, or -1, from a sorted index of all suffixes."""
        n = len(data)
        wide = np.frombuffer(data + bytes(24), np.uint8).astype(np.uint64)
        key = np.zeros(n + 8, np.uint64)
        for i in range(8):
            key = (key << np.uint64(8)) | wide[i : i + n + 8]
        order = np.lexsort((key[8:], key[:n]))
        first, second = key[:n][order], key[8:][order]
        low, high = np.searchsorted(first, self.head, "left"), np.searchsorted(first, self.tail, "right")
        out = np.full(n, -1, np.int32)
        for j in np.flatnonzero(low < high).tolist():  # by rising length: a longer piece overwrites a shorter
            p, i = self.search[j]
            a, b = int(low[j]), int(high[j])
            if len(p) > 8:
                part = second[a:b]
                rest = p[8:16]
                b = a + int(np.searchsorted(part, np.uint64(int.from_bytes(rest.ljust(8, b"\xff"), "big")), "right"))
                a += int(np.searchsorted(part, np.uint64(int.from_bytes(rest.ljust(8, b"\0"), "big")), "left"))
                if len(p) > 16:
                    at = [x for x in order[a:b].tolist() if data.startswith(p, x)]
                    if at:
                        out[at] = i
                    continue
            if a < b:
                out[order[a:b]] = i
        return out

    # -- relaxation --------------------------------------------------------
    def _merge(self, symbols: list[str]) -> tuple[list[str], tuple[str, str] | None]:
        """Merge step by step, the best-scored pair first and of equals the leftmost; also the last merge.

        Pairs wait in a heap, symbols are linked to their neighbours, so n symbols cost n log n.
        """
        text: list[str | None] = list(symbols)
        before, after = list(range(-1, len(text) - 1)), [*range(1, len(text)), -1]
        heap: list[tuple[float, int, str, str]] = []

        def offer(i: int, j: int) -> None:
            piece = self.id.get(text[i] + text[j])
            if piece is not None:
                heapq.heappush(heap, (-self.v.scores[piece], i, text[i], text[j]))

        for i in range(len(text) - 1):
            offer(i, i + 1)
        last = None
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i] if text[i] == a else -1
            if j < 0 or text[j] != b:  # one of the two was merged meanwhile
                continue
            last, text[i], text[j] = (a, b), a + b, None
            after[i] = after[j]
            if after[i] >= 0:
                before[after[i]] = i
                offer(i, after[i])
            if before[i] >= 0:
                offer(before[i], i)
        return [s for s in text if s is not None], last

    def _last_merge(self, piece: str) -> tuple[int, int] | None:
        """The two pieces whose merge makes this one; None if merging never ends in it."""
        symbols, last = self._merge(list(piece))
        if symbols != [piece] or last is None or any(len(x) > 1 and x not in self.id for x in last):
            return None
        return tuple(self.id.get(x, -1) for x in last)

    def _can_follow(self, a: int, b: int) -> bool:
        """Whether merging the characters of a and b ends in just these two pieces.

        The symbols beside the border grow along the right edge of a's merge tree and
        the left edge of b's. It holds unless at some time their own merge comes before
        the next merge of either; of equal ranks the leftmost comes first.
        """
        v, worst = self.v, -np.inf
        right, left = [a], [b]
        while right[-1] in self.parts:
            right.append(self.parts[right[-1]][1])
        while left[-1] in self.parts:
            left.append(self.parts[left[-1]][0])
        i, j = len(right) - 1, len(left) - 1
        while True:
            next_a, next_b = v.scores[right[i - 1]] if i else worst, v.scores[left[j - 1]] if j else worst
            cross = self.id.get(v.pieces[right[i]] + v.pieces[left[j]])
            if cross is not None and v.scores[cross] > next_a and v.scores[cross] >= next_b:
                return False
            if i == 0 and j == 0:
                return True
            if next_a >= next_b:
                i -= 1
            else:
                j -= 1

    def _relax_bpe(self, at: int, end: int, longest) -> list[int]:
        out, dead, last, follows, n = [], set(), BREAK, self.follows, len(self.v.pieces)
        edge = longest[at]
        while at < end:
            while edge >= 0:
                to = at + self.length[edge]
                if to not in dead:
                    if last < 0:
                        break
                    pair = last * n + edge
                    ok = follows.get(pair)
                    if ok is None:
                        if len(follows) > HELD_PAIRS:
                            follows.clear()
                        ok = follows[pair] = self._can_follow(last, edge)
                    if ok:
                        break
                edge = self.shorter[edge]
            if edge >= 0:
                out.append(edge)
                at, last = to, edge
            else:  # no path leads on from here: step back and take a shorter edge
                dead.add(at)
                edge = out.pop()
                at -= self.length[edge]
                last, edge = out[-1] if out else BREAK, self.shorter[edge]
                continue
            edge = longest[at] if at < end else -1
        return out

    def _relax_unigram(self, at: int, end: int, longest) -> list[int]:
        best, came = {at: 0.0}, {}
        for i in range(at, end):
            if i in best:
                edge = longest[i]
                while edge >= 0:
                    to, s = i + self.length[edge], best[i] + self.v.scores[edge]
                    if s > best.get(to, -np.inf):
                        best[to], came[to] = s, edge
                    edge = self.shorter[edge]
        out = []
        while end > at:
            out.append(came[end])
            end -= self.length[came[end]]
        return out[::-1]

    def _unknown(self, char: bytes) -> list[int]:
        return [self.byte[b] for b in char] if self.byte else [self.unk]

    def _encode_units(self, units: list[str]) -> None:
        """Index, match and relax new units, each given without its leading space."""
        plain, odd = [], []
        for u in units:
            (odd if "\0" in u or u[:1] == " " else plain).append(u)
        for u in odd:
            symbols = self._merge(list(SPACE + u.replace(" ", SPACE)))[0] if self.v.bpe else None
            if symbols is None:
                symbols = self._split_odd(u)
            self._remember(u, [i for s in symbols for i in ([self.id[s]] if s in self.id else self._unknown(s.encode()))])
        if not plain:
            return
        coded = [(SPACE + u).encode() for u in plain]
        data = b"\0".join(coded) + b"\0"
        longest = self.longest(data).tolist()
        relax = self._relax_bpe if self.v.bpe else self._relax_unigram
        for u, start, size in zip(plain, accumulate((len(c) + 1 for c in coded), initial=0), map(len, coded)):
            end, ids = start + size, []
            while start < end:
                if longest[start] < 0:
                    to = start + 1
                    while to < end and data[to] & 0xC0 == 0x80:
                        to += 1
                    ids += self._unknown(data[start:to])
                else:
                    to = start
                    while to < end and (longest[to] >= 0 or data[to] & 0xC0 == 0x80):
                        to += 1
                    ids += relax(start, to, longest)
                start = to
            self._remember(u, ids)

    def _split_odd(self, unit: str) -> list[str]:
        """A unigram model's path over a unit with NUL or a run of spaces, by plain dynamic programming."""
        t = SPACE + unit.replace(" ", SPACE)
        best: list[tuple[float, int]] = [(0.0, 0)] + [(-np.inf, 0)] * len(t)
        unknown, longest = min(self.v.scores) - 10, max((len(p) for p in self.id), default=1)
        for i in range(len(t)):
            for j in range(i + 1, min(i + longest, len(t)) + 1):
                s = self.v.scores[self.id[t[i:j]]] if t[i:j] in self.id else unknown if j == i + 1 else None
                if s is not None and best[i][0] + s > best[j][0]:
                    best[j] = (best[i][0] + s, i)
        out, j = [], len(t)
        while j:
            out.append(t[best[j][1] : j])
            j = best[j][1]
        return out[::-1]

    # -- batches -----------------------------------------------------------
    @staticmethod
    def units(text: str) -> list[str]:
        """The text cut before its spaces; the leading space of each unit is left out, further ones stay."""
        if SPACE in text:
            text = text.replace(SPACE, " ")
        if not text:
            return []
        parts = text.split(" ")
        if "" not in parts:
            return parts
        out, run = [], 0
        for p in parts[:-1]:
            if p:
                out.append(" " * run + p)
                run = 0
            else:
                run += 1
        return [*out, " " * run + parts[-1]]

    def encode(self, texts: pa.Array) -> pa.ListArray:
        """Piece ids of each text; a batch is taken in slices, so memory follows a slice's units and not the batch's."""
        held, flat, sizes, a = texts.to_pylist(), [np.zeros(0, np.int32)], [np.zeros(1, np.int64)], 0
        while a < len(held):
            b, chars = a + 1, len(held[a] or "")
            while b < len(held) and chars + len(held[b] or "") <= AT_ONCE:
                chars += len(held[b] or "")
                b += 1
            ids, size = self._encode_slice(held[a:b])
            flat.append(ids)
            sizes.append(size)
            a = b
        return pa.ListArray.from_arrays(pa.array(np.cumsum(np.concatenate(sizes)), pa.int32()), pa.array(np.concatenate(flat)))

    def _encode_slice(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The piece ids of some texts, one after the other, and how many each has."""
        if len(self.known) > HELD_UNITS or self.chars > HELD_CHARS:
            self.forget()
        split = [self.units(t) if t else [] for t in texts]
        every = [u for s in split for u in s]
        self._encode_units(sorted(set(every).difference(self.known)))
        at = np.fromiter(map(self.known.__getitem__, every), np.int64, len(every))
        size = self.size[at]
        ends = np.cumsum(size)
        where = np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.start[at] - (ends - size), size)
        cuts = np.cumsum([0, *map(len, split)])
        return self.flat[where], np.diff(np.r_[0, ends][cuts])

    def decode(self, ids: pa.ListArray) -> list[str]:
        """The texts of lists of piece ids; a null list is the empty text."""
        raw, out = self.raw, []
        flat, offsets = ids.values.to_numpy(zero_copy_only=False), ids.offsets.to_numpy()
        for a, b, null in zip(offsets, offsets[1:], ids.is_null().to_pylist()):
            t = "" if null else b"".join([raw[i] for i in flat[a:b].tolist()]).decode("utf-8", "each-byte")
            lead = t[:1] == " " and next(self.v.pieces[i] for i in flat[a:b].tolist() if raw[i]).startswith(SPACE)
            out.append(t[1:] if lead else t)
        return out


_ENCODERS: dict[str, Encoder] = {}


def encoder(vocabulary: Vocabulary) -> Encoder:
    """This process's encoder for a vocabulary; it outlives tasks where workers are reused."""
    if vocabulary.key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[vocabulary.key] = Encoder(vocabulary)
    return _ENCODERS[vocabulary.key]


def encode(text: Column, vocabulary: Vocabulary) -> Column:
    """array<int> of piece ids."""

    @F.arrow_udf(T.ArrayType(T.IntegerType()))
    def run(texts: pa.Array) -> pa.Array:
        out = encoder(vocabulary).encode(texts)
        release_memory()
        return out

    return run(text)


CHECKED = T.StructType().add("ids", T.ArrayType(T.IntegerType())).add("round_trip", T.BooleanType())


def encode_checked(text: Column, vocabulary: Vocabulary) -> Column:
    """struct(ids, round_trip): the pieces, and whether decoding them gives the text again, U+2581 taken as a space.

    One call does both, as a plan with two would encode twice.
    """

    @F.arrow_udf(CHECKED)
    def run(texts: pa.Array) -> pa.Array:
        coder = encoder(vocabulary)
        ids = coder.encode(texts)
        same = [a == (b or "").replace(SPACE, " ") for a, b in zip(coder.decode(ids), texts.to_pylist())]
        release_memory()
        return pa.StructArray.from_arrays([ids, pa.array(same, pa.bool_())], ["ids", "round_trip"])

    return run(text)


def decode(ids: Column, vocabulary: Vocabulary) -> Column:
    """The text of piece ids."""

    @F.arrow_udf(T.StringType())
    def run(lists: pa.Array) -> pa.Array:
        return pa.array(encoder(vocabulary).decode(lists), pa.string())

    return run(ids)

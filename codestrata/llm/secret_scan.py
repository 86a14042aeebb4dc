"""Secret scanning: candidate patterns, then a random forest that removes false positives.

Candidates come from patterns for assignments to telling names, credentials in URLs, key
formats with a prefix, private key blocks, and long tokens with digits. Each is described
by its length, character transitions (changes of class, and how likely its letters follow
one another in words), entropy, dictionary coverage, whether it stands in a path or URL,
and its neighbouring words; the forest, trained on labelled findings, says how likely it
is a secret. Words and letter transitions come from a public tokenizer's vocabulary, whose
path is a parameter; they travel with the model.

Labelled findings are (text, start, end, label) rows. `sample_findings` makes a
bounded default set by rule; `train` takes any other, `train_table` a table of them.

Defined results: a null or empty text has no findings; findings do not overlap, the
earlier pattern wins; repeated rows have equal findings; whole texts are scanned and
whole values judged. A private key block reaches to its closing line if that comes before
other dashes, else to its last line of key material; a marker without any is no candidate.
The findings are a column, so rows keep all their other columns.
"""

from __future__ import annotations

import math
import re
import string
from collections import Counter
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codestrata.llm import piece
from codestrata.llm.forest import RandomForest
from codestrata.llm.text import bounded_batches

THRESHOLD = 0.5
SAMPLE = 3000
MASK = "[SECRET]"
CONTEXT = 40
FINDING = T.StructType().add("start", T.IntegerType()).add("end", T.IntegerType()).add("kind", T.StringType()).add("score", T.DoubleType())

NAMES = ("password", "passwd", "passphrase", "passcode", "pwd", "secret", "token", "api_key", "apikey", "api-key", "access_key", "private_key", "auth_key", "encryption_key", "signing_key", "credential")
SECRET_WORDS = frozenset("password passwd passphrase pwd secret token key apikey api auth credential credentials bearer private access login aws".split())
PLAIN_WORDS = frozenset("commit sha md5 sha1 sha256 sha384 sha512 integrity checksum digest hash uuid guid id revision version build etag example sample placeholder test phone card ip isbn image data href src order invoice serial".split())
LEFT_OUT = frozenset("changeme letmein qwerty admin demo dummy foobar xxxx".split())  # words of no vocabulary that stand for a secret
BEGIN = r"-----BEGIN [A-Z0-9 ]{0,40}PRIVATE KEY(?: BLOCK)?-----"
GAP = r"(?:\s|\\[nr])"
PRIVATE_BLOCK = re.compile(
    BEGIN + r"(?:(?:(?!-----)[\s\S])*-----END [A-Z0-9 ]{0,40}PRIVATE KEY(?: BLOCK)?-----"
    + rf"|(?:{GAP}+[A-Z][A-Za-z\-]{{2,20}}: [^\n\\]{{0,100}})*(?:{GAP}+[A-Za-z0-9+/=]{{24,}})+(?:\n(?=[A-Za-z]*[0-9+/=])[A-Za-z0-9+/]{{1,76}}={{0,2}}(?=\s|$))?)"
)
MARKER = re.compile(r"-----(?:BEGIN|END) [A-Z0-9 ]{0,60}-----")
PREFIXED = re.compile(
    r"(?<![A-Za-z0-9])(?:(?:AKIA|ASIA)[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{30,}|glpat-[A-Za-z0-9_\-]{20,}|npm_[A-Za-z0-9]{30,}|hf_[A-Za-z0-9]{30,}|xox[abprs]-[A-Za-z0-9-]{10,}"
    r"|sk_(?:live|test)_[A-Za-z0-9]{16,}|sk-[A-Za-z0-9_\-]{32,}|AIza[A-Za-z0-9_\-]{35}|eyJ[A-Za-z0-9_\-]{8,}\.[A-Za-z0-9_\-]{8,}\.[A-Za-z0-9_\-]+)(?![A-Za-z0-9])"
)
PREFIX_STARTS = ("AKIA", "ASIA", "gh", "glpat", "npm_", "hf_", "xox", "sk", "AIza", "eyJ")
ASSIGNED = re.compile(r"(?:" + "|".join(map(re.escape, NAMES)) + r")[a-z0-9_\-]{0,24}[\"']?\s{0,3}(?::=|=>|[:=])\s{0,3}[\"']?([^\s\"'<>,;]{6,})", re.ASCII)
IN_URL = re.compile(r"[a-z][a-z0-9+.\-]{1,20}://[^\s/:@?#]{0,64}:([^\s/@]{4,})@", re.ASCII)
TOKEN = re.compile(r"(?<![A-Za-z0-9_+/=\-])(?=[A-Za-z_+/=\-]*[0-9])[A-Za-z0-9_+/=\-]{14,}", re.ASCII)
KINDS = ("private_key", "prefixed", "url", "assigned", "token")
WORDS = re.compile(r"[A-Za-z][A-Za-z0-9]*", re.ASCII)
DIGIT = re.compile(r"[0-9]", re.ASCII)


def candidates(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of all candidates, in order, not overlapping."""
    found: list[tuple[int, int, str]] = []
    if "PRIVATE KEY" in text:
        found += [(m.start(), m.end(), "private_key") for m in PRIVATE_BLOCK.finditer(text)]
    if any(p in text for p in PREFIX_STARTS):
        found += [(m.start(), m.end(), "prefixed") for m in PREFIXED.finditer(text)]
    low = text.lower() if text.isascii() else text.translate(_LOWER)  # of the same length
    if any(n in low for n in NAMES):
        found += [(m.start(1), m.end(1), "assigned") for m in ASSIGNED.finditer(low)]
    if "://" in low:
        found += [(m.start(1), m.end(1), "url") for m in IN_URL.finditer(low)]
    if DIGIT.search(text):
        found += [(m.start(), m.end(), "token") for m in TOKEN.finditer(text)]
    rank = {k: i for i, k in enumerate(KINDS)}
    kept: list[tuple[int, int, str]] = []
    for c in sorted(found, key=lambda x: (x[0], rank[x[2]])):  # of overlapping candidates the kind of least rank stays
        while kept and c[0] < kept[-1][1] and rank[c[2]] < rank[kept[-1][2]]:
            kept.pop()
        if not kept or c[0] >= kept[-1][1]:
            kept.append(c)
    return kept


_LOWER = {i: i + 32 for i in range(65, 91)}


@dataclass(frozen=True)
class Words:
    """What is known of plain language: its words, and the log of how often a letter follows another in them."""

    words: frozenset[str]
    follows: np.ndarray

    @staticmethod
    def of(words: set[str]) -> Words:
        counts = np.ones((26, 26))
        for w in words:
            for a, b in zip(w, w[1:]):
                counts[ord(a) - 97, ord(b) - 97] += 1
        return Words(frozenset(words) | LEFT_OUT, np.log(counts / counts.sum(axis=1, keepdims=True)))

    @staticmethod
    @lru_cache(maxsize=2)
    def load(path: str = piece.MODEL) -> Words:
        """The whole words of four letters or more in a tokenizer's vocabulary."""
        starts = (p[1:].lower() for p in piece.Vocabulary.load(path).pieces if p.startswith(piece.SPACE))
        return Words.of({w for w in starts if len(w) >= 4 and w.isascii() and w.isalpha()})

    def coverage(self, value: str) -> float:
        """The share of the letters that dictionary words cover, longest first at each place."""
        low, i, covered = value.lower(), 0, 0
        letters = sum(c.isalpha() for c in low)
        while i < len(low):
            n = next((n for n in range(min(14, len(low) - i), 3, -1) if low[i : i + n] in self.words), 0)
            covered += n
            i += n or 1
        return covered / letters if letters else 0.0

    def fluency(self, value: str) -> float:
        """The mean log likelihood of its pairs of letters; that of chance where it has none."""
        code = np.frombuffer(value.lower().encode("ascii", "replace"), np.uint8).astype(np.int64) - 97
        pairs = np.flatnonzero((code[:-1] >= 0) & (code[:-1] < 26) & (code[1:] >= 0) & (code[1:] < 26))
        return float(self.follows[code[pairs], code[pairs + 1]].mean()) if len(pairs) else -math.log(26)


def features(text: str, start: int, end: int, kind: str, known: Words) -> list[float]:
    """The numbers by which the forest judges a candidate."""
    value = text[start:end]
    if kind == "private_key":
        value = MARKER.sub("", value).strip() or "-"
    n = len(value)
    classes = ["d" if c.isdigit() else "u" if c.isupper() else "l" if c.isalpha() else "p" for c in value]
    share = Counter(classes)
    counts = Counter(value)
    entropy = -sum(c / n * math.log2(c / n) for c in counts.values())
    before, after = text[max(0, start - CONTEXT) : start], text[end : end + CONTEXT]
    near = [w.lower() for w in WORDS.findall(before)][-4:]
    near_parts = {p for w in near for p in re.split(r"[_\-]", w)}
    hexa = all(c in string.hexdigits for c in value)
    return [
        min(n, 400), sum(a != b for a, b in zip(classes, classes[1:])) / n, entropy, share["d"] / n, share["u"] / n, share["l"] / n, share["p"] / n,
        known.coverage(value), known.fluency(value), value.count(" ") / n, len(counts) / min(n, 400), float(hexa), float("/" in before[-3:] or "/" in after[:1] or value.count("/") > 1 or "\\" in value), float("://" in before or "www." in before),
        float(bool(near_parts & SECRET_WORDS)), float(bool(near_parts & PLAIN_WORDS)), float(before.rstrip()[-1:] in ("=", ":") or before[-2:-1] in ("=", ":")), float(before[-1:] in "\"'" and before[-1:] != ""),
        float("@" in value or after[:1] == "@"), float(re.fullmatch(r"[0-9a-f]{8}-(?:[0-9a-f]{4}-){3}[0-9a-f]{12}", value) is not None), float(value.isdigit()), float(re.match(r"\.[a-z]{1,5}\b", after) is not None),
        float(any(x in value for x in ("<", "${", "{{", "%(", "xxx", "XXX", "..."))), float(any(x in value.lower() for x in ("changeme", "example", "placeholder", "your_", "your-", "dummy", "redacted"))), *(float(kind == k) for k in KINDS),
    ]


def sample_findings(n: int = SAMPLE, seed: int = 8, leave_out: frozenset[str] = frozenset(), known: Words | None = None) -> list[tuple[str, int, int, int]]:
    """Labelled findings (text, start, end, label), made by rule: half secrets, half what looks like them; `leave_out` names families to hold out."""
    rng = np.random.default_rng(seed)
    pick = lambda chars, k: "".join(rng.choice(list(chars), k))
    hexa, alnum, upper = "0123456789abcdef", string.ascii_letters + string.digits, string.ascii_uppercase + string.digits
    some = lambda *x: x[rng.integers(len(x))]
    word = lambda: pick("etaoinshrdlu", int(rng.integers(2, 9)))
    between = lambda a, b: int(rng.integers(a, b))
    plain = sorted((known or Words.load()).words)
    real = lambda k, sep="": sep.join(rng.choice(plain, k))
    name = lambda: some(*NAMES) + some("", "", "", "_key", "_value", "_prod")
    sign = lambda: some("=", " = ", ": ", "=", " := ", " => ")
    lines = lambda k: "\n".join(pick(alnum + "+/", 64) for _ in range(k))
    value = lambda: some(pick(hexa, between(16, 65)), pick(alnum, between(16, 45)), pick(alnum + "+/", 40), pick(alnum + "!#%&*$^?", between(8, 20)))
    head = lambda: f"-----BEGIN {some('RSA ', 'EC ', 'OPENSSH ', '')}PRIVATE KEY-----"
    prose = lambda k: " ".join(some(word(), real(1)) for _ in range(k))
    quoted = lambda v: (lambda q: (f"{name()}{sign()}{q}", v, q))(some("", '"', "'"))

    secrets = {
        "access_id": lambda: ("", "AKIA" + pick(upper, 16), ""),
        "prefixed": lambda: ("", some("ghp_" + pick(alnum, 36), "sk_live_" + pick(alnum, 24), "AIza" + pick(alnum, 35), "glpat-" + pick(alnum, 20)), ""),
        "chat_token": lambda: ("", "xoxb-" + pick(string.digits, 11) + "-" + pick(alnum, 24), ""),
        "package_token": lambda: ("", some("npm_", "hf_") + pick(alnum, 36), ""),
        "key_block": lambda: ("", f"{head()}\n{some(lines(between(1, 9)) + chr(10), '')}{pick(alnum + '+/', between(20, 65))}\n-----END PRIVATE KEY-----", ""),
        "open_block": lambda: ("", f"{head()}\n{lines(between(1, 9))}", "\n"),
        "bearer": lambda: (some("Authorization: Bearer ", "secret key ", "api key: ", "access token "), pick(alnum, between(24, 45)), ""),
        "url": lambda: (f"{some('postgres', 'https', 'mysql', 'amqp')}://{word()}:", some(value(), pick(alnum + "!$%", between(6, 14))), f"@{word()}.example/x"),
        "short": lambda: quoted(pick(alnum, 5) + some(*"0123456789") + pick(alnum + "!#$%", between(3, 9))),
        "passphrase": lambda: (f"{some('password', 'passphrase', 'pwd')}{sign()}", real(between(4, 6), some("", "-")), ""),
        "assigned": lambda: quoted(value()),
        "assigned_hex": lambda: quoted(pick(hexa, between(16, 65))),
    }
    benign = {
        "digest": lambda: (some("commit ", "sha256: ", "md5 ", "checksum ", "revision ", "etag "), pick(hexa, int(some(32, 40, 64))), ""),
        "uuid": lambda: (some("id ", "uuid: ", ""), "-".join(pick(hexa, k) for k in (8, 4, 4, 4, 12)), ""),
        "link": lambda: (some("http://a.example/", "https://www.x.org/img/"), f"{word()}-{word()}-{rng.integers(10**6)}/{word()}{rng.integers(1000)}", some("", ".html", ".png")),
        "number": lambda: (some("call ", "card ", "isbn ", ""), pick(string.digits, between(14, 20)), ""),
        "path": lambda: ("src/", f"{word()}/{word()}_{word()}_{rng.integers(100)}", some(".cpp", ".hxx", ".py")),
        "stand_in": lambda: (f"{name()}{sign()}{some('', chr(34))}", some("changeme", "password1", "${" + word().upper() + "}", "xxxxxxxxxxxx", "your_" + word() + "_here", "example_value", "{{ secret }}", "placeholder", "os.environ[" + word() + "]", "None" + word()), ""),
        "image": lambda: ("data:image/png;base64,", pick(alnum + "+/", between(60, 300)), "=="),
        "integrity": lambda: (some('integrity="', "integrity: ", ""), some("sha512-", "sha384-", "sha256-") + pick(alnum + "+/", some(86, 64, 43)) + some("==", "="), some('"', "")),
        "identifier": lambda: ("", f"{word()}{rng.integers(1, 99)}_{word()}_{word()}", ""),
        "slug": lambda: ("", f"{word()}-{word()}-{word()}-{rng.integers(1900, 2030)}", ""),
        "words": lambda: ("", real(3) + str(rng.integers(10, 999)), ""),
        "order": lambda: (some("order ", "invoice no ", "serial "), pick(string.digits, 8) + "-" + pick(upper, 6), ""),
        "sentence": lambda: (some("the password: ", "no token: ", "secret: ", "the secret is: ", "forgot your password: ", "access_key: ", "credential: "), some(word(), real(1)).ljust(6, "e"), some(",", " ", ".")),
        "user_link": lambda: ("https://user:", some("password", "pass", "secret", "<token>", word()), "@host.example/x"),
        "quoted_block": lambda: ("", f"{head()} {prose(between(2, 40))} -----END PRIVATE KEY-----", ""),
        "mention": lambda: ("", f"{head()}", " " + prose(6)),
    }
    sides = [[f for k, f in group.items() if k not in leave_out] for group in (benign, secrets)]
    out = []
    for i in range(n):
        before, found, after = some(*sides[i % 2])()
        lead = " ".join(word() for _ in range(between(0, 7))) + " "
        tail = " " + " ".join(word() for _ in range(between(0, 7)))
        start = len(lead) + len(before)
        out.append((lead + before + found + after + tail, start, start + len(found), i % 2))
    return out


def kind_of(text: str, start: int, end: int) -> str:
    """The kind of the candidate that covers a labelled finding, `token` if none does."""
    return next((k for a, b, k in candidates(text) if a < end and start < b), "token")


@dataclass(frozen=True)
class Model:
    """A trained forest with what its features need."""

    forest: RandomForest
    known: Words

    def judge(self, found: list[tuple[str, int, int, str]]) -> list[float]:
        """How likely each (text, start, end, kind) is a secret."""
        return self.forest.predict(np.array([features(*f, self.known) for f in found])).tolist() if found else []


def train(findings: list[tuple[str, int, int, int]], seed: int = 0, known: Words | None = None) -> Model:
    """Fit the forest on labelled findings (text, start, end, label)."""
    known = known or Words.load()
    x = np.array([features(t, a, b, kind_of(t, a, b), known) for t, a, b, _ in findings])
    return Model(RandomForest(seed=seed).fit(x, np.array([f[3] for f in findings], float)), known)


def train_table(findings: DataFrame, sample: int = 20_000, seed: int = 0, known: Words | None = None) -> Model:
    """Fit on a table (text, start, end, label); of more than `sample` rows those of least hash are taken, the bound of what the driver holds."""
    rows = findings.filter("text IS NOT NULL AND start < end").select("text", F.col("start").cast("int"), F.col("end").cast("int"), F.col("label").cast("int"))
    return train([tuple(r) for r in rows.orderBy(F.xxhash64("text", "start", "end", "label")).limit(sample).collect()], seed, known)


@lru_cache(maxsize=1)
def default_model() -> Model:
    return train(sample_findings())


def scan(texts: list[str | None], model: Model) -> list[list[dict]]:
    """All candidates of each text with their scores."""
    found = [candidates(t) if t else [] for t in texts]
    score = iter(model.judge([(t, *c) for t, cs in zip(texts, found) for c in cs]))
    return [[{"start": a, "end": b, "kind": k, "score": next(score)} for a, b, k in cs] for cs in found]


def redacted(text: str, findings: list[dict], threshold: float = THRESHOLD) -> str:
    """The text with every finding at or above the threshold replaced by MASK."""
    out, at = [], 0
    for f in findings:
        if f["score"] >= threshold:
            out += [text[at : f["start"]], MASK]
            at = f["end"]
    return "".join([*out, text[at:]])


def findings(text: Column, model: Model | None = None) -> Column:
    """array<struct(start, end, kind, score)> of all candidates; offsets in code points."""
    judge = model or default_model()

    @F.arrow_udf(T.ArrayType(FINDING))
    def run(texts: pa.Array) -> pa.Array:
        return pa.array(scan(texts.to_pylist(), judge), pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string()), ("score", pa.float64())])))

    return run(text)


def redact(text: Column, model: Model | None = None, threshold: float = THRESHOLD) -> Column:
    """The text without its secrets; null stays null."""
    judge = model or default_model()

    @F.arrow_udf(T.StringType())
    def run(texts: pa.Array) -> pa.Array:
        held = texts.to_pylist()
        return pa.array([None if t is None else redacted(t, f, threshold) for t, f in zip(held, scan(held, judge))], pa.string())

    return run(text)


def scan_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: Model | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """Every row with n_candidates, n_secrets and the secrets found."""
    bounded_batches(df.sparkSession)
    rows = df.select(F.col(id_col), findings(F.col(text_col), model).alias("found"))
    kept = F.filter("found", lambda x: x["score"] >= threshold)
    return rows.select(id_col, F.size("found").cast("long").alias("n_candidates"), F.size(kept).cast("long").alias("n_secrets"), kept.alias("secrets"))

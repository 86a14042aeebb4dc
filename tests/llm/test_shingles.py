import random

import numpy as np
import pyarrow as pa

import corpus_pipeline as pipeline
from codestrata.llm import shingles


def jaccard(a, b):
    s = [{" ".join(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)} for t in (a, b)]
    return len(s[0] & s[1]) / len(s[0] | s[1])


def near(base, share, r):
    """A copy with words replaced at the end until just so much is shared."""
    words = base.split()
    for i in range(len(words) - 1, 0, -1):
        new = " ".join([*words[:i], *(f"n{r.random()}" for _ in words[i:])])
        if jaccard(base, new) < share:
            return last
        last = new


def test_sets_and_similarity():
    a, b, c, d = shingles.shingle_sets(pa.array(["A b c d e f", "a b c d e", "x", None]))
    assert len(a) == 2 and len(np.intersect1d(a, b)) == 1 and len(c) == 1 and len(d) == 0
    assert shingles.similar(np.arange(9), np.arange(1, 10)) and not shingles.similar(np.arange(9), np.arange(2, 11)) and shingles.similar(d, d)


def test_stage_drops_near_copies_down_to_a_similarity_of_eight_tenths(spark):
    r = random.Random(1)
    texts = [" ".join(f"w{r.randrange(5000)}" for _ in range(r.randint(60, 200))) for _ in range(30)]
    rows = [(i, t) for i, t in enumerate(texts)]
    rows += [(100 + i, near(texts[i], 0.8, r)) for i in range(10)] + [(200 + i, near(texts[10 + i], 0.9, r)) for i in range(10)]
    rows += [(300 + i, near(texts[20 + i], 0.6, r)) for i in range(10)]  # too far
    group = near(texts[0], 0.97, r)
    rows += [(400 + i, group + f" g{i}") for i in range(40)]  # one crowded bucket
    df = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = sorted(x["doc_id"] for x in pipeline.drop_near_duplicates(spark, df, "").collect())
    assert kept == [*range(30), *range(300, 310)]
    assert pipeline.drop_near_duplicates(spark, df.limit(0), "").count() == 0


def test_cells_equal_brute_force(monkeypatch):
    monkeypatch.setattr(shingles, "COLUMNS", 7)
    r = np.random.default_rng(2)
    sets = [np.unique(r.integers(0, 60, 40)).astype(np.uint64) for _ in range(25)]
    sets += [np.unique(np.r_[s[1:], 99].astype(np.uint64)) for s in sets[:10]] + [np.zeros(0, np.uint64)]
    left = r.random(len(sets)) < 0.5
    for side in (None, left):
        label = list(range(len(sets)))
        for i in range(len(sets)):
            for j in range(i):
                if shingles.similar(sets[i], sets[j]) and (side is None or left[i] != left[j]):
                    a, b = label[i], label[j]
                    label = [a if x == b else x for x in label]
        root = shingles.cell_links(sets, side, 8).tolist()
        assert len({(a, b) for a, b in zip(label, root)}) == len(set(label)) == len(set(root))


def test_crowded_buckets_of_several_groups(spark, monkeypatch):
    """Texts with a long passage in common meet in buckets; each pair of chunks is looked at, and only similar texts link."""
    monkeypatch.setattr(shingles, "CHUNK", 4)
    r = random.Random(3)
    passage = [f"p{i}" for i in range(60)]
    rows = []
    for g in range(12):  # groups alike within (at least 0.83), unlike between (at most 0.79)
        own = [f"g{g}x{i}" for i in range(14)]
        rows += [(10 * g + i, " ".join([*passage, *own, f"t{g}y{i}"])) for i in range(5)]
    r.shuffle(rows)
    df = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(x["doc_id"] for x in pipeline.drop_near_duplicates(spark, df, "").collect()) == [10 * g for g in range(12)]


def test_fingerprints_propose_and_sets_decide(spark, monkeypatch):
    """Without any band in common, near copies are found by their SimHash fingerprints, and only if their sets are similar."""
    r = random.Random(4)
    monkeypatch.setattr(shingles, "_signature", _signature_without_bands)
    texts = [" ".join(f"w{r.randrange(5000)}" for _ in range(400)) for _ in range(6)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(10 + i, t + " x") for i, t in enumerate(texts)] + [(20, "a b c a b c a b c a b c"), (21, "a b c a b c a b c d")]
    df = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(x["doc_id"] for x in pipeline.drop_near_duplicates(spark, df, "").collect()) == [*range(6), 20, 21]


def _signature_without_bands(texts, shingle):
    """Signatures whose bands are the fingerprint itself, so that no two different sets meet."""
    s = shingles.F.struct(shingles.F.xxhash64(texts).alias("fp"))
    return s.withField("bands", shingles.F.array(s["fp"]))

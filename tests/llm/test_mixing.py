import math
import random
from collections import Counter, defaultdict

import pytest

from codestrata.llm import mixing

SCHEMA = "doc_id long, text string, source string, size int, sk string"


def brute_targets(size, share=1.5, cap=2.0, weights=(5, 2, 1)):
    names = sorted((s for s in size if s is not None)) + ([None] if None in size else [])
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, fixed = share * sum(size.values()), {}
    while True:
        rest = {s: w[s] for s in names if s not in fixed}
        left = total - sum(fixed.values())
        goal = {s: left * x / sum(rest.values()) for s, x in rest.items()}
        over = {s: cap * size[s] for s in rest if goal[s] > cap * size[s] + 1e-12}
        if not over:
            return fixed | goal
        fixed |= over


def plain_rates(sizes, target, cap=2.0):
    """Bisection on one source's multiplier."""
    mean = sum(sizes) / len(sizes)
    rate = lambda l: [min(cap, math.exp(min(700, l * k / mean))) for k in sizes]  # noqa: E731, E741
    low, high = -1e5, 1e5
    for _ in range(200):
        mid = (low + high) / 2
        if sum(k * r for k, r in zip(sizes, rate(mid))) < target:
            low = mid
        else:
            high = mid
    return rate(high)


def table(seed, sources=7, n=400, long=False):
    r = random.Random(seed)
    out = []
    for i in range(n):
        s = f"s{int(r.random() ** 3 * sources)}" if r.random() > 0.05 else None
        k = r.randint(1, 60) if not long or r.random() < 0.95 else 3000
        out.append((i, " ".join(["w"] * k), s, 1, "x"))
    return out + [(9000, None, "s0", None, None), (9001, "", "empty", None, None), (9002, "a\x1cb \x0b c", "Ä", None, None), (5, out[5][1], out[5][2], 1, "x")]


@pytest.mark.parametrize("seed,long", [(0, False), (1, True), (2, False)])
def test_mix(spark, seed, long):
    rows = table(seed, long=long)
    df = spark.createDataFrame(rows, SCHEMA)
    got = mixing.mix(df).collect()
    assert len(got) == len(rows)
    words = lambda t: len([x for x in __import__("re").split(r"[\x20\x09-\x0D]+", t or "") if x])
    size = Counter()
    for _, t, s, *_ in rows:
        size[s] += words(t)
    goal = brute_targets(size)
    source = {i: s for i, _, s, *_ in rows}
    by = defaultdict(list)
    for r in got:
        s = source[r["doc_id"]]
        by[s].append(r)
        assert r["source_size"] == size[s] and r["target"] == pytest.approx(goal[s], rel=1e-9, abs=1e-9)
        assert r["taken"] == r["copies"] * r["size"] <= 2 * r["size"]
        assert r["copies"] in (math.floor(r["rate"] - 1e-9), math.floor(r["rate"]), math.floor(r["rate"]) + 1, 0, 1)
    for s, rs in by.items():
        held = [r for r in rs if r["size"]]
        if goal[s]:
            assert [r["rate"] for r in held] == pytest.approx(plain_rates([r["size"] for r in held], goal[s]), rel=1e-6, abs=1e-9)
        assert abs(sum(r["taken"] for r in rs) - goal[s]) <= 0.02 * goal[s] + 1.5 * min([r["size"] for r in rs if r["size"]] or [0]) + (1500 if long else 0)
    again = {(r["doc_id"], r["size"]): r["taken"] for r in mixing.mix(df.repartition(7)).collect() if r["doc_id"] != 5}
    assert again == {(r["doc_id"], r["size"]): r["taken"] for r in got if r["doc_id"] != 5}


def test_one_hot_source_and_nothing(spark):
    df = spark.createDataFrame([(i, "w " * 10, "only", 1, "x") for i in range(300)], SCHEMA)
    got = mixing.mix(df).collect()
    assert sum(r["taken"] for r in got) == 4500
    assert mixing.mix(df.limit(0)).count() == 0
    nothing = mixing.mix(spark.createDataFrame([(1, None, None, 1, "x")], SCHEMA)).collect()
    assert [(r["size"], r["target"], r["taken"]) for r in nothing] == [(0, 0.0, 0)]


def test_mixed_rows_are_the_copies_of_the_mix(spark):
    rows = table(4)
    df = spark.createDataFrame(rows, SCHEMA)
    due = Counter()
    for r in mixing.mix(df).collect():
        due[r["doc_id"], r["size"]] += r["copies"]
    assert Counter(r["doc_id"] for r in mixing.mixed_rows(df).collect()) == +Counter({i: sum(n for (j, _), n in due.items() if j == i) for i in {r[0] for r in rows}})


def test_equal_rows_of_several_sources(spark):
    """Rows of equal id and text are copied by their own source's rate."""
    df = spark.createDataFrame([(1, "a b", s, 1, "x") for s in "abcd" for _ in range(2)], SCHEMA)
    got = Counter(r["source"] for r in mixing.mixed_rows(df).collect())
    due = Counter()
    for r in mixing._copied(df, "doc_id", "text", "source", mixing.WEIGHTS, mixing.SHARE, mixing.CAP, []).collect():
        due[r["sk"][1:]] += r["copies"]
    goal = brute_targets({s: 4 for s in "abcd"})
    assert got == +due and all(abs(2 * due[s] - goal[s]) <= 1 for s in "abcd")


def test_a_large_group_of_repeated_rows(spark):
    """Exactly the quota of equal rows gets a copy more, whatever their number."""
    df = spark.createDataFrame([(7, "w " * 10, "hot", 1, "x")] * 5000 + [(i, "w " * 10, "b", 1, "x") for i in range(3000)], SCHEMA).repartition(3)
    goal = brute_targets({"b": 30000, "hot": 50000})
    got = Counter()
    for r in mixing.mix(df).collect():
        got["hot" if r["doc_id"] == 7 and r["source_size"] == 50000 else "b"] += r["taken"]
    assert all(abs(got[s] - goal[s]) <= 10 for s in goal)


def test_not_converged_raises(spark):
    hist = spark.createDataFrame([("a", 1, 3), ("a", 9, 2)], "sk string, size long, n long")
    goal = spark.createDataFrame([("a", 21, 30.0)], "sk string, source_size long, target double")
    with pytest.raises(RuntimeError, match="not balanced"):
        mixing.balance(hist, goal, mixing.Scratch(spark, "t"), max_steps=1)

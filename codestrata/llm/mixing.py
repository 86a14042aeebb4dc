"""Mixing sources to target weights by entropy balancing.

The mix gives every document a rate r between 0 and `cap`. Among all rates that meet
the token targets of the sources, entropy balancing takes those nearest to 1 in
Kullback-Leibler divergence, a document being a unit. With z_i the document's words
in units of its source's mean, the dual is convex, its gradient in the multiplier l of
source s is

    g_s(l) = sum_i size_i * min(cap, exp(l * z_i)) - target_s,

and its solution tilts the documents exponentially in their own words,
r_i = min(cap, exp(l_s * z_i)). Newton steps with the second derivative, held to a
bracket that every step narrows, are aggregations over a (source, size) histogram; a
source that does not converge is an error.

Rates become whole copies by error diffusion: each source's documents fall into
size classes of an eighth of an octave; from the largest class to the smallest,
a class gets the nearest whole number of extra copies and passes what remains to
the next. Within a class the documents of least hash get them. Where the quota ends is
found through counts: by hash bin, by hash in that bin, and among rows of equal hash by
row; so nothing ranks a source or a large group of repeated rows, and whether a row is
copied is a comparison within the row.

Defined results: a null text has size 0 and is never repeated; null is a source
of its own, the last; a source without words has target 0 and copies 0; repeated rows
count each, and which of them get a copy more may differ between runs, as they are the
same; an empty table gives no rows. Own names cannot clash with further columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codestrata.llm.text import word_count
from codestrata.session import Scratch

WEIGHTS = (5.0, 2.0, 1.0)
SHARE = 1.5
CAP = 2.0
HASH_BINS = 1024
CLASSES_PER_OCTAVE = 8


def source_key(source: Column) -> Column:
    """A key that never is null and sorts by code point, null last."""
    return F.coalesce(F.concat(F.lit("0"), source), F.lit("1"))


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """Adds `target` to rows (sk, source_size): share * all words by weight, none above cap * its size.

    Sharing the excess again until none is above ends at the level mu with
    sum min(cap * size, w * mu) = share * total. The level is found from prefix sums
    in order of cap * size / w. One row per source.
    """
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(F.row_number().over(Window.orderBy("sk")) - 1, F.lit(len(weights))) + 1).cast("int"))
    order = Window.orderBy(F.col("cap") / F.col("w"), "sk")
    t = sizes.withColumn("w", w).withColumn("cap", F.lit(float(cap)) * F.col("source_size"))
    everything = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    t = t.withColumn("goal", F.least(F.lit(float(share)) * F.sum("source_size").over(everything), F.sum("cap").over(everything)))
    t = t.withColumn("below", F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("cap"))
    t = t.withColumn("rest", F.sum("w").over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
    t = t.withColumn("mu", (F.col("goal") - F.col("below")) / F.col("rest"))
    level = F.min(F.when(F.col("mu") <= F.col("cap") / F.col("w"), F.struct(F.col("cap") / F.col("w"), F.col("sk"), F.col("mu").alias("mu")))).over(everything)["mu"]
    return t.withColumn("target", F.least(F.col("cap"), F.coalesce(level * F.col("w"), F.col("cap")))).select("sk", "source_size", "target")


def balance(histogram: DataFrame, goal: DataFrame, scratch: Scratch, cap: float = CAP, tolerance: float = 1e-10, max_steps: int = 100) -> DataFrame:
    """Newton on the dual; histogram (sk, size, n), goal (sk, source_size, target) -> (sk, source_size, target, mean, l).

    `l` is null where all rates are `cap` (the target is all that the source can give)
    or all are 0 (it has no words). A step that leaves the bracket halves it instead, or
    widens it while one side is open. Raises if a source does not come within
    `tolerance` of its target.
    """
    mean = histogram.filter("size > 0").groupBy("sk").agg((F.sum(F.col("size") * F.col("n")) / F.sum("n")).alias("mean"))
    none = F.lit(None).cast("double")
    free = (F.col("target") > 0) & (F.col("target") < F.lit(float(cap)) * F.col("source_size") * (1 - 1e-12))
    state = scratch.write(goal.join(mean, "sk", "left").select("sk", "source_size", "target", "mean", F.when(free, 0.0).alias("l"), none.alias("low"), none.alias("high"), free.alias("moving")))
    for _ in range(max_steps):
        z = F.col("size") / F.col("mean")
        tilt = F.exp(F.least(F.col("l") * z, F.lit(700.0)))
        words = F.col("size") * F.col("n")
        sums = histogram.join(state.filter("moving").select("sk", "l", "mean"), "sk").groupBy("sk").agg(
            F.sum(words * F.least(F.lit(float(cap)), tilt)).alias("got"), F.sum(F.when(tilt < cap, words * z * tilt).otherwise(0.0)).alias("slope")
        )
        gap = F.col("got") - F.col("target")
        moving = F.coalesce(F.abs(gap) > tolerance * F.col("target"), F.lit(False))
        low, high = F.when(gap < 0, F.col("l")).otherwise(F.col("low")), F.when(gap > 0, F.col("l")).otherwise(F.col("high"))
        newton = F.col("l") - gap / F.nullif("slope", F.lit(0.0))
        far = 2 * F.greatest(F.abs("l"), F.lit(1.0))
        inside = (newton > F.coalesce("low", F.col("l") - far)) & (newton < F.coalesce("high", F.col("l") + far))
        safe = F.when(low.isNotNull() & high.isNotNull(), (F.col("low") + F.col("high")) / 2).when(gap < 0, F.col("l") + far).otherwise(F.col("l") - far)
        step = state.join(sums, "sk", "left").withColumns({"low": low, "high": high, "moving": moving})
        step = step.withColumn("l", F.when(F.col("moving"), F.when(inside, newton).otherwise(safe)).otherwise(F.col("l")))
        state, left = scratch.counted(step.select(*state.columns), F.col("moving"))
        if not left:
            return state.select("sk", "source_size", "target", "mean", "l")
    raise RuntimeError(f"{left} sources not balanced after {max_steps} steps")


def rate_of(size: Column, cap: float) -> Column:
    """A document's rate from its size and its source's target, mean and l."""
    tilted = F.least(F.lit(float(cap)), F.exp(F.least(F.col("l") * size / F.col("mean"), F.lit(700.0))))
    return F.when(F.col("target") <= 0, 0.0).when(F.col("l").isNull(), F.lit(float(cap))).otherwise(tilted)


def size_class(size: Column) -> Column:
    return F.when(size > 0, F.floor(F.log2(size) * CLASSES_PER_OCTAVE)).cast("int")


def quotas(classes: DataFrame) -> DataFrame:
    """Whole numbers of extra copies by size class: classes (sk, cls, n, tokens, due), `due` being the tokens that the rates give -> (sk, cls, whole, quota).

    Every row of a class gets `whole` copies and `quota` of them one more. The fold
    runs over one source's classes, at most a few hundred, whatever its documents.
    """
    per = classes.groupBy("sk").agg(F.array_sort(F.collect_list(F.struct((-F.col("cls")).alias("order"), "cls", "n", "tokens", "due"))).alias("c"))
    kind = "array<struct<cls:int,whole:bigint,quota:bigint>>"
    start = F.struct(F.lit(0.0).alias("carry"), F.array().cast(kind).alias("out"))

    def fold(acc, x):
        whole = F.greatest(F.ceil(F.round(x["due"] / x["tokens"], 9)) - 1, F.lit(0)).cast("long")
        want = x["due"] - whole * x["tokens"] + acc["carry"]
        mean = x["tokens"] / x["n"]
        m = F.greatest(F.lit(0), F.least(x["n"], F.round(want / mean))).cast("long")
        return F.struct((want - m * mean).alias("carry"), F.concat(acc["out"], F.array(F.struct(x["cls"].alias("cls"), whole.alias("whole"), m.alias("quota")))).alias("out"))

    return per.select("sk", F.explode(F.aggregate("c", start, fold)["out"]).alias("q")).select("sk", "q.cls", "q.whole", "q.quota")


def _edge(counts: DataFrame, quota: DataFrame, key: str) -> DataFrame:
    """(sk, cls, key, need): the key, in order, at which a class's quota ends, and how many rows of it are still due; counts (sk, cls, key, n), quota (sk, cls, need)."""
    before = F.coalesce(F.sum("n").over(Window.partitionBy("sk", "cls").orderBy(key).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = counts.join(quota.select("sk", "cls", "need"), ["sk", "cls"]).withColumn("before", before).filter(F.col("before") < F.col("need"))
    last = placed.groupBy("sk", "cls").agg(F.max(F.struct("before", key, "need", "n")).alias("e"))
    return last.select("sk", "cls", F.col(f"e.{key}").alias(key), (F.col("e.need") - F.col("e.before")).alias("need"), F.col("e.n").alias("n"))


def _thresholds(rows: DataFrame, quota: DataFrame, scratch: Scratch) -> DataFrame:
    """(sk, cls, whole, bin, h, sub, row): the last row, in the order of these four, that gets a copy more; rows (sk, cls, bin, h, sub, row)."""
    def ends(part: DataFrame, due: DataFrame, key: str) -> DataFrame:
        return scratch.write(_edge(part.groupBy("sk", "cls", key).agg(F.count(F.lit(1)).alias("n")), due, key))

    due = quota.filter("quota > 0").select("sk", "cls", F.col("quota").alias("need"))
    out = quota.select("sk", "cls", "whole")
    part, keys = rows.filter("cls IS NOT NULL"), ("bin", "h", "sub", "row")
    for key in keys:
        edge = ends(part, due, key)
        out = out.join(edge.select("sk", "cls", key), ["sk", "cls"], "left")
        # A key all of whose rows are due needs no finer one.
        due, n = scratch.counted(edge.filter("need < n").select("sk", "cls", "need", key))
        if not n:
            for rest in keys[keys.index(key) + 1 :]:
                out = out.withColumn(rest, F.lit(None).cast("long"))
            break
        part, due = part.join(due.select("sk", "cls", key), ["sk", "cls", key], "left_semi"), due.drop(key)
    return scratch.write(out)


def _copied(df: DataFrame, id_col: str, text_col: str, source_col: str, weights: tuple[float, ...], share: float, cap: float, keep: list[Column]) -> DataFrame:
    """The columns `keep` of all rows with sk, size, source_size, target, rate and copies."""
    scratch = Scratch(df.sparkSession, "mixing")
    h = F.xxhash64(F.col(id_col), F.col(text_col))
    rows = df.select(*keep, source_key(F.col(source_col)).alias("sk"), word_count(F.col(text_col)).alias("size"), h.alias("h"), F.monotonically_increasing_id().alias("row"))
    rows = scratch.write(rows.withColumns({"cls": size_class(F.col("size")), "bin": F.pmod(F.shiftrightunsigned("h", 20), F.lit(HASH_BINS)), "sub": F.pmod(F.xxhash64("row"), F.lit(HASH_BINS))}))
    histogram = scratch.write(rows.groupBy("sk", "size").agg(F.count(F.lit(1)).alias("n")))
    goal = targets(histogram.groupBy("sk").agg(F.sum(F.col("size") * F.col("n")).alias("source_size")), weights, share, cap)
    tilts = scratch.write(balance(histogram, goal, scratch, cap))

    words = F.col("size") * F.col("n")
    classes = histogram.filter("size > 0").join(tilts, "sk").groupBy("sk", size_class(F.col("size")).alias("cls")).agg(F.sum("n").alias("n"), F.sum(words).alias("tokens"), F.sum(words * rate_of(F.col("size"), cap)).alias("due"))
    last = _thresholds(rows.select("sk", "cls", "bin", "h", "sub", "row"), scratch.write(quotas(classes)), scratch)
    last = last.select("sk", "cls", "whole", *[F.col(k).alias(f"last_{k}") for k in ("bin", "h", "sub", "row")])
    # A row comes before the last one if it does by the first key that differs; a null key means all of its rows do.
    extra = F.lit(True)
    for k in ("row", "sub", "h", "bin"):
        extra = F.when(F.col(f"last_{k}").isNull(), True).otherwise((F.col(k) < F.col(f"last_{k}")) | ((F.col(k) == F.col(f"last_{k}")) & extra))
    extra = F.when(F.col("last_bin").isNull(), 0).otherwise(extra.cast("int"))
    full = rows.join(last, ["sk", "cls"], "left").join(tilts, "sk", "left")
    return full.withColumns({"copies": F.coalesce(F.col("whole") + extra, F.lit(0)).cast("int"), "rate": rate_of(F.col("size"), cap)})


def mix(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """All rows with size, source_size, target, rate, copies and taken = copies * size."""
    full = _copied(df, id_col, text_col, source_col, weights, share, cap, [F.col(id_col).alias("c0")])
    return full.select(F.col("c0").alias(id_col), "size", "source_size", "target", "rate", "copies", (F.col("copies") * F.col("size")).cast("long").alias("taken"))


def mixed_rows(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """The mix itself: the rows of df, each as often as it is copied, with all their columns."""
    columns = [F.col(c).alias(f"c{i}") for i, c in enumerate(df.columns)]
    full = _copied(df, id_col, text_col, source_col, weights, share, cap, columns).filter("copies > 0")
    return full.withColumn("copy", F.explode(F.sequence(F.lit(1), "copies"))).select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(df.columns)])

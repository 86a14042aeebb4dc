"""Entity and relation kinds, and the numbers attached to them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Kinds in order of strength, edge weights and cut costs.
ENTITY_KINDS = ("namespace", "class", "struct", "interface", "enum", "method", "field")
CLASS_KINDS = ("class", "struct", "interface")
RELATION_KINDS = ("depends", "associates", "implements", "aggregates", "composes", "inherits")
LEVEL = {"depends": 0, "associates": 1, "implements": 2, "aggregates": 3, "composes": 4, "inherits": 5}
WEIGHT = {"inherits": 1.0, "composes": 1.0, "aggregates": 0.8, "implements": 0.7, "associates": 0.6, "depends": 0.3}
#: Which kind stands for a pair that has several, first to last; and the kinds that tie classes together.
PRIMARY = ("inherits", "implements", "composes", "aggregates", "associates", "depends")
STRUCTURAL = ("inherits", "implements", "composes", "aggregates")
DEFAULT_WEIGHT = 0.3
CUT_COST = {"inherits": 3.0, "implements": 2.0, "composes": 2.0, "aggregates": 1.5, "associates": 1.0, "depends": 1.0}
DEFAULT_CUT_COST = 1.0


def _mapped(kind: Column, values: dict, default) -> Column:
    pairs = F.create_map(*[F.lit(x) for item in values.items() for x in item])
    return F.coalesce(F.element_at(pairs, kind), F.lit(default))


def level_of(kind: Column) -> Column:
    """Strength of a relation kind, 0 (depends) to 5 (inherits); -1 for an unknown kind."""
    return _mapped(kind, LEVEL, -1)


def weight_of(kind: Column) -> Column:
    return _mapped(kind, WEIGHT, DEFAULT_WEIGHT)


def cut_cost_of(kind: Column) -> Column:
    return _mapped(kind, CUT_COST, DEFAULT_CUT_COST)


def kinds_by_strength(kinds: Column) -> Column:
    """An array of kinds, strongest first."""
    ranked = F.transform(kinds, lambda k: F.struct((-level_of(k)).alias("o"), k.alias("k")))
    return F.transform(F.array_sort(ranked), lambda s: s["k"])


def primary_kind(kinds: Column) -> Column:
    """The kind that stands for an array of kinds."""
    order = {k: i for i, k in enumerate(PRIMARY)}
    return F.array_min(F.transform(kinds, lambda k: F.struct(_mapped(k, order, len(order)).alias("o"), k.alias("k"))))["k"]


def checked_kind(kind: Column, allowed: tuple[str, ...]) -> Column:
    """The kind, or an error that names one that is not allowed."""
    return F.when(kind.isin(*allowed), kind).otherwise(F.raise_error(F.concat(F.lit("unknown kind: "), F.coalesce(kind, F.lit("null")))))


def kind_table(spark: SparkSession) -> DataFrame:
    """kind, level, weight, cut_cost of every relation kind."""
    return spark.createDataFrame([(k, LEVEL[k], WEIGHT[k], CUT_COST[k]) for k in RELATION_KINDS], "kind string, level int, weight double, cut_cost double")

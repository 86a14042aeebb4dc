"""An index of names by their three-letter pieces, for loosely written names of classes and files.

A name has a piece for each of its characters, the last ones filled up with NUL, so that
a query of one or two characters is the beginning of a piece. A query reads the postings
of its own pieces only and holds the names that have all of them against the tiers of
`relational.resolve_tiered` and `resolve_file`. Stored postings are sorted by piece, so
a scan opens few row groups; a common piece is spread over many parts by its names.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codestrata.operators.relational import resolve_file, resolve_tiered

SIZE = 3
FILL = "\0" * (SIZE - 1)


def plain(name: Column) -> Column:
    """A name in lower case, with `_` for `::`."""
    return F.replace(F.lower(name), F.lit("::"), F.lit("_"))


def name_index(names: DataFrame, col: str = "qualified_name") -> DataFrame:
    """(gram, col): the postings of all distinct names; null names have none."""
    full = F.concat(plain(F.col(col)), F.lit(FILL))
    at = F.sequence(F.lit(1), F.greatest(F.length(full) - len(FILL), F.lit(1)))
    grams = F.array_distinct(F.transform(at, lambda i: F.substring(full, i, F.lit(SIZE))))
    return names.select(col).filter(F.col(col).isNotNull()).distinct().select(F.explode(grams).alias("gram"), col)


def store_index(index: DataFrame, path: str) -> None:
    """Write postings in the order of their pieces."""
    index.repartitionByRange(*index.columns).sortWithinPartitions(*index.columns).write.mode("overwrite").parquet(path)


def open_index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def candidates(index: DataFrame, keys: list[str], col: str = "qualified_name") -> DataFrame:
    """Names that have all pieces of one of the keys, which are plain: every name that contains one is among them."""
    found = []
    for key in dict.fromkeys(keys):
        grams = sorted({key[i : i + SIZE] for i in range(len(key) - SIZE + 1)})
        if grams:
            found.append(index.filter(F.col("gram").isin(grams)).groupBy(col).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") == len(grams)).select(col))
        else:
            found.append(index.filter(F.col("gram").startswith(key)).select(col))
    return reduce(DataFrame.unionByName, found).distinct()


def resolve_class(index: DataFrame, query: str, col: str = "qualified_name") -> DataFrame:
    """(col, tier): distinct names as `resolve_tiered` finds them, from postings; an empty query finds none."""
    low = query.strip().lower()
    # A name may end with the query's segments without containing the query: its empty segments do not count.
    tails = ["_".join(p for p in re.split(mark, low) if p).replace("::", "_") for mark in (r"::|_", r"::")]
    near = candidates(index, [low.replace("::", "_"), *[t for t in tails if t]], col)
    return resolve_tiered(near.withColumnRenamed(col, "qualified_name"), query).select(F.col("qualified_name").alias(col), "tier")


def resolve_path(index: DataFrame, query: str, col: str = "file_path") -> DataFrame:
    """(col, tier): distinct paths as `resolve_file` finds them, from postings."""
    return resolve_file(candidates(index, [query.lower().replace("::", "_")], col), query, col).select(col, "tier")

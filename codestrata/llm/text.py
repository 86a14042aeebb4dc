"""Column expressions on texts that several operators share."""

from __future__ import annotations

import ctypes

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from codestrata.session import bounded_batches

__all__ = ["WORD", "bounded_batches", "release_memory", "word_count"]

WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    """Words between the ASCII white space characters; a null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def release_memory() -> None:
    """Give freed memory back: an idle worker keeps what its last batch took, and an executor has several."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # not glibc
        pass

"""Sets of strings that go to tasks, of bounded size for any number of strings.

Up to ``EXACT`` strings of together ``EXACT_BYTES`` go as they are, more of them as a
bit map of their hashes. A map lets some strings pass that are not in the set, so
an exact join follows wherever that matters.
"""

from __future__ import annotations

from zlib import crc32

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits a map has at most (16 MB), and a string gets at first.
MOST_BITS, BITS_EACH = 1 << 27, 16
EXACT, EXACT_BYTES = 100_000, 8 << 20


def marks_of(values: DataFrame, *columns: Column) -> bytes:
    """Marks of the strings of all ``columns``; Spark ORs the bits of each 64-bit word, so that at
    most ``MOST_BITS / 64`` rows come back."""
    strings = values.select(F.explode(F.array(*columns)).alias("s")).where(F.col("s").isNotNull())
    bits = min(MOST_BITS, max(1 << 10, 1 << (BITS_EACH * strings.count()).bit_length()))
    words = (strings.select(F.crc32(F.col("s").cast("binary")).bitwiseAND(F.lit(bits - 1)).alias("at"))
             .groupBy(F.shiftright("at", 6).alias("place"))
             .agg(F.bit_or(F.expr("shiftleft(1L, CAST(at & 63 AS INT))")).alias("word")).toArrow())
    out = np.zeros(bits // 64, np.int64)
    out[words["place"].to_numpy()] = words["word"].to_numpy()
    return out.tobytes()


class Members:
    """A set of strings, or a bit map that holds them."""

    def __init__(self, strings: frozenset[str] | None = None, marks: bytes = b""):
        self.strings, self.marks = strings, marks

    def __contains__(self, value: str) -> bool:
        if self.strings is not None:
            return value in self.strings
        at = crc32(value.encode()) & (len(self.marks) * 8 - 1)
        return bool(self.marks[at >> 3] >> (at & 7) & 1)

    def __bool__(self) -> bool:
        return self.strings is None or bool(self.strings)

    def among(self, values: set[str]) -> set[str]:
        return values & self.strings if self.strings is not None else {v for v in values if v in self}


def members_of(values: DataFrame, *columns: Column) -> Members:
    """The strings of all ``columns``."""
    strings = values.select(F.explode(F.array(*columns)).alias("s")).where(F.col("s").isNotNull()).distinct()
    count, size = strings.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("s")), F.lit(0))).first()
    if count <= EXACT and size <= EXACT_BYTES:
        return Members(frozenset(r.s for r in strings.collect()))
    return Members(marks=marks_of(values, *columns))

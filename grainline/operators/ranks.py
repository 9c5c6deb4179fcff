"""Exact order statistics without a sort in one task."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .groups import written

#: Intervals that a pass counts.
BINS = 4096
LARGEST = 1.7976931348623157e308


def at_ranks(df: DataFrame, column: str, ranks) -> tuple[int, list[float]]:
    """(number n of values, the values at the places from 0 that ``ranks`` (a function of n) gives, in ascending order) of a
    column of numbers; nulls and NaNs are left out, and without values there are none.

    Each pass counts the values of an interval in ``BINS`` parts with the least and largest of each, and the part that holds the
    place is the next interval, until it holds one value only. What reaches the driver is a row for each part."""
    d = df.select(F.col(column).cast("double").alias("v")).where("v is not null and not isnan(v)")
    d = written(d)
    n, low, high = d.agg(F.count("*"), F.min("v"), F.max("v")).first()
    wanted = [] if not n else [min(n - 1, max(0, int(r))) for r in ranks(n)]
    out: dict[int, float] = {}
    # (interval, places in it that are looked for, values before it)
    todo = [(low, high, sorted(set(wanted)), 0)] if wanted else []
    while todo:
        low, high, places, before = todo.pop()
        if low == high:
            out |= dict.fromkeys(places, low)
            continue
        # halves first: the difference of two doubles may be infinite; infinities have parts of their own
        a, b = max(low, -LARGEST) / 2, min(high, LARGEST) / 2
        inner = F.least(F.floor((F.col("v") / 2 - a) / (b - a) * BINS), F.lit(BINS - 1)) if b > a else F.when(F.col("v") > low, BINS - 1).otherwise(0)
        part = F.when(F.col("v") == -math.inf, -1).when(F.col("v") == math.inf, BINS).otherwise(inner).alias("part")
        rows = d.where(F.col("v").between(low, high)).groupBy(part).agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).orderBy("part").collect()
        for r in rows:
            inside = [p for p in places if before <= p < before + r["n"]]
            if inside:
                todo.append((r["lo"], r["hi"], inside, before))
            before += r["n"]
    return n, [out[p] for p in wanted]

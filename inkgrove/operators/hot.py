"""Joins whose left side may hold a third of its rows under one key."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows of one key that go to one task; keys looked at. A key beyond the first ``MOST_KEYS`` has less than that share of all rows.
ROWS, MOST_KEYS = 50_000, 64


def hot_join(left: DataFrame, right: DataFrame, on: list[str], how: str, rows: int = ROWS) -> DataFrame:
    """``left`` joined with ``right`` (``inner``, ``left``, ``left_semi`` or ``left_anti``) on equally named columns, of which
    ``right`` has each value once or a few times.

    Counting the keys, map-side first, shows the hot ones; a key with n rows is dealt over ``ceil(n / rows)`` salts, and the
    matching rows of ``right`` are repeated as often. All other keys join as they are. Null keys, which match nothing, are
    dealt out too. Equal rows get equal salts, so a repeated task gives the same rows.
    """
    top = left.groupBy(*on).count().where(F.col("count") > rows).orderBy(F.desc("count")).limit(MOST_KEYS).collect()
    if not top:
        return left.join(right, on, how)

    def salts() -> Column:
        n = F.lit(1)
        for r in top:
            n = F.when(reduce(Column.__and__, [F.col(c).eqNullSafe(F.lit(r[c])) for c in on]), F.lit(-(-r["count"] // rows))).otherwise(n)
        return n

    others = [c for c in left.columns if c not in on] or on
    dealt = left.withColumn("_salt", F.pmod(F.xxhash64(*[F.col(c).cast("string") for c in others]), salts()).cast("int"))
    repeated = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), salts() - 1)))
    return dealt.join(repeated, [*on, "_salt"], how).drop("_salt")

"""As-of joins by union and fill: one sort of both sides, no blow-up.

The fill always runs from the start of a frame to the row. Spark evaluates a frame that ends with the partition anew for each row, which is quadratic in a series; so
a forward join sorts the other way round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def asof_join(left: DataFrame, right: DataFrame, by: list[str], left_on: str, right_on: str, payload: list[str], direction: str = "backward") -> DataFrame:
    """Each left row with the payload of the last right row at or before it (backward), or the first at or after it (forward), within ``by``.

    Equal times match. Of right rows with one time, the last (first) by payload is taken. Without a match the payload is null; a
    null key or time matches nothing. Rows of the left all come back.
    """
    forward = direction == "forward"
    mine = [c for c in left.columns]
    l = left.select(*[left[b].alias(f"_b{i}") for i, b in enumerate(by)], left[left_on].alias("_t"), F.lit(0 if forward else 1).alias("_s"), F.struct(*[left[c] for c in mine]).alias("_l"))  # noqa: E741
    p = F.struct(right[right_on].alias("_at"), *[right[c] for c in payload])
    r = right.where(right[right_on].isNotNull()).select(*[right[b].alias(f"_b{i}") for i, b in enumerate(by)], right[right_on].alias("_t"), F.lit(1 if forward else 0).alias("_s"), p.alias("_p"))
    both = l.withColumn("_p", F.lit(None).cast(r.schema["_p"].dataType)).unionByName(r.withColumn("_l", F.lit(None).cast(l.schema["_l"].dataType)).select(*[f"_b{i}" for i in range(len(by))], "_t", "_s", "_l", "_p"))
    order = [F.desc(c) if forward else F.asc(c) for c in ("_t", "_s", "_p")]
    w = Window.partitionBy(*[f"_b{i}" for i in range(len(by))]).orderBy(*order)
    filled = F.last("_p", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    known = F.col("_t").isNotNull()
    for i in range(len(by)):
        known = known & F.col(f"_b{i}").isNotNull()
    out = both.withColumn("_f", F.when(known, filled)).where("_l is not null")
    return out.select(*[F.col("_l")[c].alias(c) for c in mine], *[F.col("_f")[c].alias(c) for c in payload])

"""Running values over ordered rows of a key, in parts: a key that holds very many rows is scanned by many tasks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a key from which its scan is split.
ROWS_A_PART = 100_000

_WITHIN = {"min": F.min, "max": F.max, "sum": F.sum, "last": lambda c: F.last(c, ignorenulls=True)}


def running(df: DataFrame, keys: list[str], order: str, values: dict[str, tuple[Column, str, bool]], rows_a_part: int = ROWS_A_PART) -> DataFrame:
    """df with a column for each of values (column, kind, whether the row itself counts): the min, max, sum or last known value
    of the rows of its key up to it, in the order of a number; null where there is none.

    Keys of more than rows_a_part rows are cut into ranges of their order. What comes before a range is one row of it (its
    own value, and a running one over the ranges); only these meet, never the key's rows."""
    sizes = df.groupBy(*keys).agg(F.count("*").alias("_n"), F.min(order).alias("_low"), F.max(order).alias("_high")).where(F.col("_n") > rows_a_part)
    until = lambda w, own: w.rowsBetween(Window.unboundedPreceding, 0 if own else -1)
    if not sizes.take(1):
        window = Window.partitionBy(*keys).orderBy(order)
        return df.withColumns({name: _WITHIN[kind](c).over(until(window, own)) for name, (c, kind, own) in values.items()})
    # Null keys meet null keys.
    one, large = df.alias("one"), sizes.select([F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)] + ["_low", "_high", F.ceil(F.col("_n") / rows_a_part).alias("_parts")])
    span = F.col("_high").cast("double") - F.col("_low") + 1
    part = F.coalesce(F.floor((F.col(order).cast("double") - F.col("_low")) * F.col("_parts") / span), F.lit(0)).cast("long")
    same = [F.col(f"one.{k}").eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)]
    dealt = one.join(large, same, "left").select("one.*", part.alias("_part"))
    whole = {"min": F.min, "max": F.max, "sum": F.sum, "last": lambda c: F.max_by(c, F.when(c.isNotNull(), F.col(order)))}
    parts = dealt.groupBy(*keys, "_part").agg(*[whole[kind](c).alias(f"_of_{name}") for name, (c, kind, _) in values.items()])
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    carried = parts.select([F.col(k).alias(f"_c{i}") for i, k in enumerate(keys)] + [F.col("_part").alias("_cpart")] + [_WITHIN[kind](F.col(f"_of_{name}")).over(before).alias(f"_up_{name}") for name, (_, kind, _) in values.items()])
    window = Window.partitionBy(*keys, "_part").orderBy(order)
    within = dealt.withColumns({f"_in_{name}": _WITHIN[kind](c).over(until(window, own)) for name, (c, kind, own) in values.items()}).alias("w")
    same = [F.col(f"w.{k}").eqNullSafe(F.col(f"_c{i}")) for i, k in enumerate(keys)] + [F.col("w._part") == F.col("_cpart")]
    both = {"min": F.least, "max": F.greatest, "last": lambda up, own: F.coalesce(own, up), "sum": lambda up, own: F.coalesce(up + own, up, own)}
    out = within.join(carried, same)
    return out.select([F.col(f"w.{c}").alias(c) for c in df.columns] + [both[kind](F.col(f"_up_{name}"), F.col(f"_in_{name}")).alias(name) for name, (_, kind, _) in values.items()])

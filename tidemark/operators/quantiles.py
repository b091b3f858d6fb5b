"""Exact quantiles by two passes: a sketch brackets each wanted rank, then only the rows inside the brackets are counted.

The sketch is Spark's ``percentile_approx``.  Whether a bracket holds its rank is seen from the counts; one
that doesn't is replaced by the whole range of values.  No task holds all distinct values, as
``percentile`` does; the results are the same to the last digit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.shared import materialize

from .evaluation import running_totals

#: A bracket holds about four of so many parts of the rows.
ACCURACY = 10_000


def exact_quantiles(df: DataFrame, values: dict[str, Column | str], shares: list[float], keys: list[str] = (), accuracy: int = ACCURACY) -> DataFrame:
    """(keys, name, share, value) for each of the named ``values`` and each share of 0 to 1, linear between ranks.

    Nulls take no part and repeated rows count each; NaN counts as the largest number.  A group or
    name without a value has no row, and an empty table gives none.  Keys may be null.
    """
    keys = list(keys)
    by = [*(f"_k{i}" for i in range(len(keys))), "name"]
    cells = F.array(*[F.struct(F.lit(n).alias("name"), (F.col(v) if isinstance(v, str) else v).cast("double").alias("v")) for n, v in values.items()])
    rows = df.select(*[F.col(k).alias(i) for k, i in zip(keys, by, strict=False)], F.explode(cells).alias("c")).select(*by[:-1], "c.name", "c.v").where("v is not null")
    margin = 2.0 / accuracy
    ends = [x for s in shares for x in (max(s - margin, 0.0), min(s + margin, 1.0))]
    sketch = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("total"), F.percentile_approx("v", ends, accuracy).alias("ends"), F.min("v").alias("least"), F.max("v").alias("most"))

    def bracket(i: int, share: float) -> Column:
        low = F.col("least") if share - margin <= 0 else F.col("ends")[2 * i]
        high = F.col("most") if share + margin >= 1 else F.col("ends")[2 * i + 1]
        return F.struct(F.lit(share).alias("share"), low.alias("lo"), high.alias("hi"))

    # A row for each key, name and share.
    brackets = sketch.select(*by, "total", "least", "most", F.explode(F.array(*[bracket(i, s) for i, s in enumerate(shares)])).alias("b"))
    brackets = materialize(brackets.select(*by, "total", "least", "most", "b.*", F.to_json(F.struct(*by, "b.share")).alias("key")), "brackets")

    def counted(some: DataFrame) -> DataFrame:
        """(key, v, n): distinct values inside the brackets, and under null the number of rows below."""
        named = some.select(*[F.col(c).alias(f"_b{c}") for c in by], "key", "lo", "hi")
        same = F.lit(True)
        for c in by:
            same = same & F.col(c).eqNullSafe(F.col(f"_b{c}"))
        met = rows.join(named, same).where("v <= hi").select("key", F.when(F.col("v") >= F.col("lo"), F.col("v")).alias("v"))
        return materialize(met.groupBy("key", "v").agg(F.count(F.lit(1)).alias("n")), "bracketed")

    at = F.col("share") * (F.col("total") - 1)
    counts = counted(brackets)
    held = counts.groupBy("key").agg(F.sum(F.when(F.col("v").isNull(), F.col("n")).otherwise(0)).alias("below"), F.sum("n").alias("upto"))
    missed = brackets.join(held, "key", "left").where(F.col("upto").isNull() | (F.col("below") > F.floor(at)) | (F.col("upto") <= F.ceil(at)))
    missed = materialize(missed.select(*brackets.columns), "missed")
    if not missed.isEmpty():
        more = counted(missed.withColumns({"lo": F.col("least"), "hi": F.col("most")}))
        counts = counts.join(missed.select("key"), "key", "left_anti").select("key", "v", "n").union(more)
    below = counts.where("v is null").select("key", F.col("n").alias("below"))
    cum = running_totals(counts.where("v is not null"), ["key"], "v", ["n"], descending=False)
    joined = cum.join(brackets.join(below, "key", "left"), "key").withColumn("upto", F.col("cum_n") + F.coalesce("below", F.lit(0)))
    found = joined.groupBy("key", *by, "share", "total").agg(
        F.min(F.when(F.col("upto") > F.floor(at), F.col("v"))).alias("a"), F.min(F.when(F.col("upto") > F.ceil(at), F.col("v"))).alias("b")
    )
    low, high = F.floor(at), F.ceil(at)
    value = F.when((low == high) | (F.col("a") == F.col("b")), F.col("a")).otherwise((high - at) * F.col("a") + (at - low) * F.col("b"))
    return found.select(*[F.col(i).alias(k) for k, i in zip(keys, by, strict=False)], "name", "share", value.alias("value"))


def quantile_columns(df: DataFrame, wanted: dict[str, tuple[Column | str, float]], keys: list[str] = ()) -> DataFrame:
    """A row for each key with a column for each wanted (value, share); null where a group has no value."""
    keys = list(keys)
    names = list(dict.fromkeys(v for v, _ in wanted.values()))
    shares = sorted({s for _, s in wanted.values()})
    long = exact_quantiles(df, {f"v{i}": v for i, v in enumerate(names)}, shares, keys)
    pick = [
        F.max(F.when((F.col("name") == f"v{names.index(v)}") & (F.col("share") == s), F.col("value"))).alias(out) for out, (v, s) in wanted.items()
    ]
    found = long.groupBy(*keys).agg(*pick)
    if not keys:
        return found
    all_keys = df.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]).distinct()
    same = F.lit(True)
    for i, k in enumerate(keys):
        same = same & F.col(f"_k{i}").eqNullSafe(F.col(k))
    return all_keys.join(found, same, "left").select(*[F.col(f"_k{i}").alias(k) for i, k in enumerate(keys)], *wanted)

"""Exact quantiles of groups of any size: histograms close in on the ranks, so no group's values meet in one task.

Each round counts the values in the bracket of every wanted rank by bins, map-side, and goes on with the bin that holds the rank, from
its smallest to its largest value. The two never fall into one bin, so brackets shrink until a single value is left; bins are of equal
width in one round and of equal ratio in the next, which takes few rounds for even and for skewed values. Brackets are a row a group;
those of hot groups are broadcast, of which there can't be many.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.storage import cut, join_hot

BINS = 1024
_BRACKET = "array<struct<low:double,high:double,rank:long>>"


def _bin(x: Column, low: Column, high: Column, ratio: bool, bins: int) -> Column:
    """The bin of ``x``, from 0; rises with ``x``, and ``low`` and ``high`` have different ones."""
    half = lambda c: c / 2  # noqa: E731  differences of halves don't overflow
    share = (F.log1p(half(x) - half(low)) / F.log1p(half(high) - half(low))) if ratio else ((half(x) - half(low)) / (half(high) - half(low)))
    return F.when(x == low, 0).when(x == high, bins - 1).otherwise(F.least(F.greatest(F.floor(share * bins), F.lit(0)), F.lit(bins - 1))).cast("int")


def _ranks(n: Column, share: float) -> tuple[Column, Column]:
    at = (n - 1) * F.lit(share)
    return F.floor(at), F.ceil(at)


def exact(rows: DataFrame, key: str, value: str, shares: dict[str, float], bins: int = BINS) -> DataFrame:
    """``key`` and a column for each of ``shares``: the quantile of ``value``, between the two nearest ranks by linear interpolation.

    Nulls and values that aren't finite don't count; a group without others has no row. A null key is a group.
    """
    x = F.col(value).cast("double")
    own = rows.select(F.coalesce(F.concat(F.lit("k"), F.col(key).cast("string")), F.lit("")).alias("key__"), x.alias("x")).where("x is not null and not isnan(x) and abs(x) < double('infinity')")
    found = own.groupBy("key__").agg(F.count("*").alias("n"), F.min("x").alias("low"), F.max("x").alias("high"))
    wanted = [r for s in shares.values() for r in _ranks(F.col("n"), s)]
    state = cut(found.select("key__", "n", F.array(*[F.struct("low", "high", r.cast("long").alias("rank")) for r in wanted]).cast(_BRACKET).alias("b")))
    total, ratio = state.agg(F.sum("n")).first()[0] or 0, False
    while total and not state.where(F.exists("b", lambda t: t["low"] < t["high"])).isEmpty():
        state, ratio = _closer(own, state, total, ratio, bins), not ratio
    out = state
    for k, (name, share) in enumerate(shares.items()):
        at = (F.col("n") - 1) * F.lit(share)
        a, b = F.col("b")[2 * k]["low"], F.col("b")[2 * k + 1]["low"]
        out = out.withColumn(name, a + (b - a) * (at - F.floor(at)))
    back = F.when(F.col("key__") != "", F.expr("substring(key__, 2)")).cast(rows.schema[key].dataType)
    return out.select(back.alias(key), *shares)


def _closer(own: DataFrame, state: DataFrame, total: int, ratio: bool, bins: int) -> DataFrame:
    """The brackets after one more round."""
    open_ = F.filter(F.transform("b", lambda t, i: F.when(t["low"] < t["high"], F.struct(i.alias("i"), t["low"].alias("low"), t["high"].alias("high"), t["rank"].alias("rank")))), lambda t: t.isNotNull())
    asked = state.select("key__", "n", open_.alias("t")).where(F.size("t") > 0)
    met = join_hot(own, asked, "key__", "n", total, "t")
    inside = met.select("key__", "x", F.explode(F.filter("t", lambda t: (t["low"] <= F.col("x")) & (F.col("x") <= t["high"]))).alias("t"))
    place = _bin(F.col("x"), F.col("t.low"), F.col("t.high"), ratio, bins)
    counts = inside.groupBy("key__", "t.i", "t.rank", place.alias("bin")).agg(F.count("*").alias("c"), F.min("x").alias("low"), F.max("x").alias("high"))
    upto = F.sum("c").over(Window.partitionBy("key__", "i").orderBy("bin"))  # of ``bins`` rows at most
    hit = counts.withColumn("upto", upto).where((F.col("rank") < F.col("upto")) & (F.col("rank") >= F.col("upto") - F.col("c")))
    new = hit.groupBy("key__").agg(F.collect_list(F.struct("i", F.struct("low", "high", (F.col("rank") - F.col("upto") + F.col("c")).alias("rank")).alias("t"))).alias("new"))
    replaced = F.transform("b", lambda t, i: F.coalesce(F.get(F.filter("new", lambda m: m["i"] == i), F.lit(0))["t"], t))
    joined = state.join(new, "key__", "left").withColumn("new", F.coalesce("new", F.array().cast(f"array<struct<i:int,t:{_BRACKET[6:-1]}>>")))
    return cut(joined.select("key__", "n", replaced.cast(_BRACKET).alias("b")))

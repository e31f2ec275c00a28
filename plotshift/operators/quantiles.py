"""Exact quantiles at any size, for all columns and ranks together.

Every wanted rank has a bracket, two values that enclose it. A first pass takes the brackets from a sketch. While a bracket
may hold more than ``KEEP`` different values, one more pass counts what lies below each and sketches what lies inside, which
narrows all brackets by ``GRID`` / 4. The last pass ranks the few values left. How many passes are needed follows from the
number of rows alone: none of the narrowing kind up to about 10^8, one up to 10^10. Ties never widen a bracket, as a value
counts once with its number of rows.

A group of at most ``KEEP`` rows is its own bracket. Brackets are one row per group and column; they are broadcast when their
number is counted to be small, and joined otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plotshift.session import materialize_at, remove

#: Different values that one task may rank, cells of a narrowing, and rows of brackets that are broadcast.
KEEP, GRID, SMALL = 20_000, 1000, 100_000


def long_form(df: DataFrame, columns: list[str], by: tuple[str, ...] = ()) -> DataFrame:
    """(by..., column, value) for every value that is a number."""
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast("double").alias("value")) for c in columns])
    return df.select(*by, F.inline(pairs)).where("value is not null and not isnan(value)")


def quantiles(
    df: DataFrame, columns: list[str], probs: tuple[float, ...], by: tuple[str, ...] = (), keep: int = KEEP, grid: int = GRID
) -> DataFrame:
    """(by..., column, p, value), linearly interpolated between neighbouring ranks."""
    rows, keys = long_form(df, columns, by), [*by, "column"]
    spark, folders = df.sparkSession, []

    def stored(frame: DataFrame) -> DataFrame:
        out, path = materialize_at(frame, "brackets")
        folders.append(path)
        return out

    brackets = stored(_first(rows, keys, probs, keep))
    most, groups = brackets.agg(F.max("n"), F.count("*")).first()
    beside = lambda b: rows.join(F.broadcast(b) if groups <= SMALL else b, keys)
    left = (most or 0) * 6 / keep if (most or 0) > keep else 0
    while left > keep:
        brackets = stored(_narrowed(beside(brackets), keys, probs, keep, grid))
        left *= 4 / grid
    out = stored(_ranked(beside(brackets), keys))
    result = out.select(*keys, "p", "value")
    for path in folders[:-1]:
        remove(spark, path)
    return result


def _bracket(p: float, lo: Column, hi: Column) -> Column:
    return F.struct(F.lit(float(p)).alias("p"), lo.alias("lo"), hi.alias("hi"))


def _first(rows: DataFrame, keys: list[str], probs: tuple[float, ...], keep: int) -> DataFrame:
    """(keys..., n, b): brackets from one sketch; the margin spans more than its error."""
    margin = 2.0 / keep
    edges = [min(max(p + s * margin, 0.0), 1.0) for p in probs for s in (-1, 1)]
    sketch = rows.groupBy(*keys).agg(
        F.count("*").alias("n"), F.min("value").alias("first"), F.max("value").alias("last"), F.percentile_approx("value", edges, keep).alias("e")
    )
    small = F.col("n") <= keep
    end = lambda i, whole, edge: F.when(small | F.lit(edges[i] in (0.0, 1.0)), F.col(whole)).otherwise(F.get("e", F.lit(i)))
    return sketch.select(*keys, "n", F.array(*[_bracket(p, end(2 * i, "first", 0.0), end(2 * i + 1, "last", 1.0)) for i, p in enumerate(probs)]).alias("b"))


def _narrowed(rows: DataFrame, keys: list[str], probs: tuple[float, ...], keep: int, grid: int) -> DataFrame:
    """(keys..., n, b) with narrower brackets."""
    cells = [i / grid for i in range(grid + 1)]
    b = [F.get("b", F.lit(i)) for i in range(len(probs))]
    sums = [F.any_value("n").alias("n"), F.any_value("b").alias("b")]
    for i, x in enumerate(b):
        value, inside = F.col("value"), F.col("value").between(x["lo"], x["hi"])
        sums += [
            F.count_if(value < x["lo"]).alias(f"below{i}"), F.count_if(inside).alias(f"m{i}"),
            F.percentile_approx(F.when(inside, value), cells, keep).alias(f"e{i}"),
        ]
    new = []
    for i, p in enumerate(probs):
        at = F.lit(float(p)) * (F.col("n") - 1) - F.col(f"below{i}")
        low = F.floor(F.floor(at) / F.col(f"m{i}") * grid).cast("int") - 1
        high = F.ceil((F.ceil(at) + 1) / F.col(f"m{i}") * grid).cast("int") + 1
        x = F.get("b", F.lit(i))
        lo = F.when(low > 0, F.get(f"e{i}", low)).otherwise(x["lo"])
        hi = F.when(high < grid, F.get(f"e{i}", high)).otherwise(x["hi"])
        new.append(_bracket(p, lo, hi))
    return rows.groupBy(*keys).agg(*sums).select(*keys, "n", F.array(*new).alias("b"))


def _ranked(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys..., p, value) from the values inside the brackets and the number below."""
    near = F.transform(
        F.filter("b", lambda x: F.col("value") <= x["hi"]), lambda x: F.struct(x["p"].alias("p"), F.when(F.col("value") >= x["lo"], F.col("value")).alias("v"))
    )
    counted = rows.select(*keys, "n", F.inline(near)).groupBy(*keys, "p", "n", "v").agg(F.count("*").alias("c"))
    order = Window.partitionBy(*keys, "p").orderBy(F.col("v").asc_nulls_first())
    ranked = counted.withColumn("upto", F.sum("c").over(order)).where("v is not null")
    at = F.col("p") * (F.col("n") - 1)
    pick = lambda rank: F.min(F.when(F.col("upto") > rank, F.col("v")))
    # nothing of the bracket may begin behind the rank
    start = F.min(F.col("upto") - F.col("c")).alias("start")
    out = ranked.groupBy(*keys, "p", "n").agg(pick(F.floor(at)).alias("a"), pick(F.ceil(at)).alias("z"), start)
    value = F.col("a") + (at - F.floor(at)) * (F.col("z") - F.col("a"))
    wrong = value.isNull() | (F.col("start") > F.floor(at))
    checked = F.when(~wrong, value).otherwise(F.raise_error(F.lit("quantile outside its bracket")).cast("double"))
    return out.select(*keys, "p", checked.alias("value"))


def medians(df: DataFrame, columns: list[str], exact: bool = True) -> dict[str, float]:
    """Median of every column, as fitted state (one number per column)."""
    if not exact:
        row = df.agg(*[F.percentile_approx(F.col(f"`{c}`"), 0.5, 10_000).alias(c) for c in columns]).first()
        return {c: row[c] for c in columns if row[c] is not None}
    return {r["column"]: r["value"] for r in quantiles(df, columns, (0.5,)).collect()}


def curve(df: DataFrame, columns: list[str], points: int) -> DataFrame:
    """(column, k, value): ``points`` evenly spaced quantiles of every column, k = 0 the least and points - 1 the largest.

    So many ranks need all values in order: different values with their counts are sorted by ranges, running counts are
    taken inside each range and over the ranges' totals, and each value gives the k whose ranks it covers.
    """
    counted = long_form(df, columns).groupBy("column", "value").agg(F.count("*").alias("c"))
    ordered = counted.repartitionByRange("column", "value").sortWithinPartitions("column", "value")
    at = F.monotonically_increasing_id()
    stored, path = materialize_at(ordered.select("column", "value", "c", at.alias("at"), F.shiftright(at, 33).alias("part")), "ordered")
    whole = Window.partitionBy("column")
    ranges = stored.groupBy("column", "part").agg(F.sum("c").alias("s"))
    before = F.sum("s").over(whole.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    ranges = ranges.select("column", "part", F.coalesce(before, F.lit(0)).alias("base"), F.sum("s").over(whole).alias("n"))
    upto = F.col("base") + F.sum("c").over(Window.partitionBy("column", "part").orderBy("at"))
    ranked = stored.join(ranges, ["column", "part"]).select("column", "value", "n", upto.alias("upto"), (upto - F.col("c")).alias("from"))
    last, steps = F.greatest(F.col("n") - 1, F.lit(1)), F.lit(points - 1)
    # rank k * (n - 1) / steps lies between two places: "a" takes the lower, "z" the upper
    lower = F.ceil(F.col("from") * steps / last), F.when(F.col("n") == 1, steps).otherwise(F.expr(f"(upto * {points - 1} - 1) div (n - 1)"))
    upper = F.greatest(F.floor((F.col("from") - 1) * steps / last) + 1, F.lit(0)), F.when(F.col("n") == 1, steps).otherwise(F.floor((F.col("upto") - 1) * steps / last))
    side = lambda name, ks: ranked.where(ks[0] <= ks[1]).select("column", "n", F.explode(F.sequence(ks[0].cast("long"), ks[1].cast("long"))).alias("k"), F.lit(name).alias("side"), "value")
    both = side("a", (lower[0], F.least(lower[1], steps))).union(side("z", (upper[0], F.least(upper[1], steps))))
    pair = both.groupBy("column", "n", "k").agg(*[F.max(F.when(F.col("side") == x, F.col("value"))).alias(x) for x in "az"])
    rank = F.col("k") * (F.col("n") - 1) / steps
    out, _ = materialize_at(pair.select("column", "k", (F.col("a") + (rank - F.floor(rank)) * (F.col("z") - F.col("a"))).alias("value")), "curve")
    remove(df.sparkSession, path)
    return out

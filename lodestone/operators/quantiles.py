"""Exact quantiles of many columns by distributed selection: brackets from summaries, counts below them, and the few values inside."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ACCURACY, FEW = 1000, 1_000_000
RESULT = "column_name string, q array<double>"


def _aggregates(df: DataFrame, named: dict[str, Column]) -> dict:
    """One row of aggregates, a bounded number of figures for each column."""
    return df.agg(*[c.alias(n) for n, c in named.items()]).first().asDict()


def exact_quantiles(df: DataFrame, numbers: dict[str, Column], quantiles: Sequence[float] = (0.25, 0.5, 0.75), few: int = FEW, accuracy: int = ACCURACY) -> DataFrame:
    """column_name, q: the exact quantiles of each column (name: expression of a number), interpolated between the two values they fall between; null without values.

    A summary of bounded size, whose ranks are off by 1 / ``accuracy`` of the values at most, gives a bracket around each quantile that holds
    both of its values. While more than ``few`` values lie in some bracket, a summary of those inside gives narrower ones: each round is two
    passes and leaves a share of 4 / ``accuracy``, so 10^12 values take two rounds. Then the values below each bracket are
    counted, those inside are grouped, and running sums of their counts pick the two. Only bounds and counts of brackets reach the driver. Nulls and NaN aren't counted.
    """
    spark = df.sparkSession
    clean = {c: F.when(~F.isnan(x.cast("double")), x.cast("double") + 0.0) for c, x in numbers.items()}
    held = df.select(*[x.alias(f"v{i}") for i, x in enumerate(clean.values())])
    v = [F.col(f"v{i}") for i in range(len(clean))]
    if not clean:
        return spark.createDataFrame([], RESULT)

    def around(share: float) -> list[float]:
        return [max(0.0, share - 2 / accuracy), min(1.0, share + 2 / accuracy)]

    # first brackets: of each column, a pair of values for each quantile
    asked = [s for q in quantiles for s in around(q)]
    got = _aggregates(held, {f"{k}{i}": f for i, x in enumerate(v) for k, f in (("n", F.count(x)), ("p", F.percentile_approx(x, [*asked, 0.0, 1.0], accuracy)))})
    n = [got[f"n{i}"] for i in range(len(v))]
    keys = [(i, j) for i in range(len(v)) if n[i] for j in range(len(quantiles))]
    whole = {(i, j): tuple(got[f"p{i}"][-2:]) for i, j in keys}  # a summary keeps the least and the largest
    bracket = {(i, j): (got[f"p{i}"][2 * j], got[f"p{i}"][2 * j + 1]) for i, j in keys}
    ranks = {(i, j): (int(quantiles[j] * (n[i] - 1)), -int(-quantiles[j] * (n[i] - 1) // 1)) for i, j in keys}
    below: dict[tuple[int, int], int] = {}
    settled: set[tuple[int, int]] = set()  # brackets that don't shrink: a few values, each very often
    while keys:
        inside = {k: v[k[0]].between(*map(F.lit, bracket[k])) for k in keys}
        got = _aggregates(held, {f"{w}{i}_{j}": F.count_if(c) for i, j in keys for w, c in (("b", v[i] < F.lit(bracket[i, j][0])), ("m", inside[i, j]))})
        below, within = ({(i, j): got[f"{w}{i}_{j}"] for i, j in keys} for w in "bm")
        missed = [k for k in keys if not (below[k] <= ranks[k][0] and ranks[k][1] < below[k] + within[k])]
        wide = [k for k in keys if within[k] > few and bracket[k][0] < bracket[k][1] and k not in missed and k not in settled]
        bracket |= {k: whole[k] for k in missed}
        if not wide and not missed:
            break
        if wide:
            shares = {k: [around((r - below[k]) / within[k])[side] for side, r in enumerate(ranks[k])] for k in wide}
            got = _aggregates(held, {f"p{i}_{j}": F.percentile_approx(F.when(inside[i, j], v[i]), shares[i, j], accuracy) for i, j in wide})
            narrower = {(i, j): tuple(got[f"p{i}_{j}"]) for i, j in wide}
            settled |= {k for k in wide if narrower[k] == bracket[k]}
            bracket |= narrower

    empty = spark.createDataFrame([(c, [None] * len(quantiles)) for i, c in enumerate(clean) if not n[i]], RESULT)
    if not keys:
        return empty
    met = [F.when(v[i].between(*map(F.lit, bracket[i, j])), F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), v[i].alias("value"))) for i, j in keys]
    values = held.select(F.explode(F.array_compact(F.array(*met))).alias("x")).groupBy("x.i", "x.j", "x.value").agg(F.count(F.lit(1)).alias("m"))
    rows = [(i, j, list(clean)[i], below[i, j], *ranks[i, j], quantiles[j] * (n[i] - 1) - ranks[i, j][0]) for i, j in keys]
    wanted = spark.createDataFrame(rows, "i int, j int, column_name string, below long, lo long, hi long, part double")
    upto = Window.partitionBy("i", "j").orderBy("value").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = values.join(F.broadcast(wanted), ["i", "j"]).withColumn("last", F.col("below") + F.sum("m").over(upto) - 1).withColumn("first", F.col("last") - F.col("m") + 1)
    at = lambda r: F.max(F.when(F.col(r).between(F.col("first"), F.col("last")), F.col("value")))
    picked = placed.groupBy("column_name", "j", "part").agg(at("lo").alias("low"), at("hi").alias("high"))
    picked = picked.withColumn("q", F.col("low") + F.col("part") * (F.col("high") - F.col("low")))
    return picked.groupBy("column_name").agg(F.transform(F.array_sort(F.collect_list(F.struct("j", "q"))), lambda s: s["q"]).alias("q")).union(empty)


def value_at_rank(df: DataFrame, number: Column, rank: int, cells: int = 1 << 16) -> int:
    """The ``rank``-th smallest (from 1) of the whole numbers of an expression, nulls aside; there must be so many.

    Each pass counts the values in ``cells`` equal cells of the range that holds the one sought and goes on with its cell: four passes for any
    range of 64 bits, whatever the number of rows. Only a cell's number and count reach the driver.
    """
    held = df.select(number.cast("long").alias("v"))
    lo, hi = held.agg(F.min("v"), F.max("v")).first()
    lo, hi = int(lo), int(hi)
    while lo < hi:
        width = (hi - lo) // cells + 1
        cell = F.expr(f"(cast(v as decimal(20,0)) - {lo}BD) div {width}BD")  # decimals: a difference of longs may not be one
        inside = held.where(F.col("v").between(lo, hi))
        for place, n in sorted((int(r["cell"]), r["n"]) for r in inside.groupBy(cell.alias("cell")).agg(F.count(F.lit(1)).alias("n")).collect()):
            if rank <= n:
                break
            rank -= n
        lo, hi = lo + place * width, min(hi, lo + (place + 1) * width - 1)
    return lo

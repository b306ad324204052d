"""Greedy packing and other steps that depend on the step before, one group at a time on the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def greedy_bins(sizes: Column, limit: Column) -> Column:
    """The bin of each item of an ordered array: a new one where the next item would not fit; an item above the limit stands alone."""
    return F.aggregate(
        sizes,
        F.struct(F.lit(0).alias("bin"), F.lit(0).cast("long").alias("used"), F.array().cast("array<int>").alias("out")),
        lambda acc, x: F.struct(
            F.when((acc.used > 0) & (acc.used + x > limit), acc.bin + 1).otherwise(acc.bin).alias("bin"),
            F.when((acc.used > 0) & (acc.used + x > limit), x.cast("long")).otherwise(acc.used + x).alias("used"),
            F.concat(acc.out, F.array(F.when((acc.used > 0) & (acc.used + x > limit), acc.bin + 1).otherwise(acc.bin))).alias("out"),
        ),
        lambda acc: acc.out,
    )


def feasible(lows: Column, highs: Column, gap: float) -> Column:
    """Whether ordered tones with bounds can keep a gap: each as low as possible, none above its bound."""
    return F.aggregate(
        F.arrays_zip(lows.alias("lo"), highs.alias("hi")),
        F.struct(F.lit(-1e9).alias("reach"), F.lit(True).alias("ok")),
        lambda acc, x: F.struct(F.greatest(x["lo"], acc.reach + gap).alias("reach"), (acc.ok & (F.greatest(x["lo"], acc.reach + gap) <= x["hi"] + 1e-4)).alias("ok")),
        lambda acc: acc.ok,
    )


def tiles(height: Column, screen: int, overlap: float = 0.1) -> Column:
    """Offsets of tiles of a tall page: one where it is at most two screens high, else steps of a screen less the overlap."""
    step = int(screen * (1 - overlap))
    return F.when(height <= 2 * screen, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.greatest(height - F.lit(int(screen * overlap)) - 1, F.lit(0)), F.lit(step)))


def apportion(df: DataFrame, group: str, weight: str, order: str, total: int) -> DataFrame:
    """Whole shares of ``total`` by weight: floors first, the rest to the largest remainders, ties to the earlier."""
    w = Window.partitionBy(group)
    exact = F.col(weight) * total / F.sum(weight).over(w)
    floor = F.floor(exact)
    rank = F.row_number().over(Window.partitionBy(group).orderBy(F.desc(F.round(F.col("exact") - F.col("share"), 9)), F.col(order)))
    left = F.lit(total) - F.sum("share").over(w)
    return df.withColumn("exact", exact).withColumn("share", floor).withColumn("share", F.when(rank <= left, F.col("share") + 1).otherwise(F.col("share"))).drop("exact")


def isotonic(values: list[float], weights: list[float], gap: float = 0.0) -> list[float]:
    """Weighted least squares under an order with a least gap: pool adjacent violators on values less their gaps."""
    blocks: list[list[float]] = []
    for i, (v, w) in enumerate(zip(values, weights, strict=True)):
        blocks.append([v - i * gap, w, 1])
        while len(blocks) > 1 and blocks[-2][0] > blocks[-1][0]:
            b, a = blocks.pop(), blocks.pop()
            total = a[1] + b[1]
            blocks.append([(a[0] * a[1] + b[0] * b[1]) / total, total, a[2] + b[2]])
    out: list[float] = []
    for mean, _, n in blocks:
        out += [mean + (len(out) + k) * gap for k in range(int(n))]
    return out


def nearest_heading_cut(offsets: list[int], headings: list[bool], budget: int) -> int | None:
    """Index of the heading nearest to half the budget, the first of equals; None without one."""
    best = [(abs(o - budget / 2), i) for i, (o, h) in enumerate(zip(offsets, headings, strict=True)) if h and i]
    return min(best)[1] if best else None

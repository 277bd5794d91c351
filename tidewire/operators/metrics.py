"""Evaluation, summaries, sweeps, timing histograms and labelling pools."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def shares(df: DataFrame, column: str, digits: int = 4) -> DataFrame:
    n = df.groupBy(column).agg(F.count("*").alias("n"))
    return n.select(column, "n", F.round(F.col("n") / F.sum("n").over(Window.partitionBy()), digits).alias("share"))


def confusion(df: DataFrame, truth: str, predicted: str, classes: list) -> DataFrame:
    """Counts of truth by prediction for all classes, zero where there is none."""
    return df.groupBy(truth).pivot(predicted, classes).agg(F.count(F.lit(1))).na.fill(0)


def by_class(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    """(class, support, precision, recall, f1) over the union of true and predicted classes; zero divided by zero is zero."""
    seen = df.select(F.explode(F.array(F.struct(F.col(truth).alias("c"), F.lit(1).alias("t"), F.lit(0).alias("p")), F.struct(F.col(predicted).alias("c"), F.lit(0).alias("t"), F.lit(1).alias("p")))).alias("x"), (F.col(truth) == F.col(predicted)).alias("hit")).select("x.*", "hit")
    n = seen.groupBy(F.col("c").alias("class")).agg(F.sum("t").alias("support"), F.sum("p").alias("predicted"), F.sum(F.when(F.col("hit"), F.col("t")).otherwise(0)).alias("tp"))
    ratio = lambda a, b: F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(b).cast("double")), F.lit(0.0))
    n = n.withColumn("precision", ratio("tp", "predicted")).withColumn("recall", ratio("tp", "support"))
    return n.select("class", "support", "precision", "recall", F.coalesce(F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), F.lit(0.0)).alias("f1"))


def overall(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    """One row: n, accuracy (which is micro-F1 here), macro-F1 and weighted F1."""
    c = by_class(df, truth, predicted)
    f = c.agg(F.avg("f1").alias("f1_macro"), (F.sum(F.col("f1") * F.col("support")) / F.sum("support")).alias("f1_weighted"))
    return df.agg(F.count("*").alias("n"), F.avg((F.col(truth) == F.col(predicted)).cast("double")).alias("accuracy")).crossJoin(F.broadcast(f))


def sweep(df: DataFrame, score: str, correct: str, cuts: list[float]) -> DataFrame:
    """(cut, kept, precision, recall, share) of keeping rows that score at least the cut; one pass, a row per cut."""
    each = df.select(F.explode(F.array(*map(F.lit, cuts))).alias("cut"), F.col(score).alias("s"), F.col(correct).cast("int").alias("ok"))
    keep = F.col("s") >= F.col("cut")
    n = each.groupBy("cut").agg(F.count_if(keep).alias("kept"), F.sum(F.when(keep, F.col("ok")).otherwise(0)).alias("right"), F.sum("ok").alias("all_right"), F.count("*").alias("n"))
    r = lambda a, b: F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(b).cast("double")), F.lit(0.0))
    return n.select("cut", "kept", r("right", "kept").alias("precision"), r("right", "all_right").alias("recall"), r("kept", "n").alias("share"))


def sweep_grid(df: DataFrame, a: str, b: str, correct: str, cuts_a: list[float], cuts_b: list[float]) -> DataFrame:
    """(cut_a, cut_b, kept, precision, recall, share) of keeping rows that reach both cuts, in one pass."""
    grid = F.array(*(F.struct(F.lit(x).alias("cut_a"), F.lit(y).alias("cut_b")) for x in cuts_a for y in cuts_b))
    keep = (F.col("a") >= F.col("cut_a")) & (F.col("b") >= F.col("cut_b"))
    each = df.select(F.col(a).alias("a"), F.col(b).alias("b"), F.col(correct).cast("int").alias("ok"), F.explode(grid).alias("g")).select("g.*", "a", "b", "ok")
    n = each.groupBy("cut_a", "cut_b").agg(F.count_if(keep).alias("kept"), F.sum(F.when(keep, F.col("ok")).otherwise(0)).alias("right"), F.sum("ok").alias("all_right"), F.count("*").alias("n"))
    r = lambda x, y: F.coalesce(F.try_divide(F.col(x).cast("double"), F.col(y).cast("double")), F.lit(0.0))
    return n.select("cut_a", "cut_b", "kept", r("right", "kept").alias("precision"), r("right", "all_right").alias("recall"), r("kept", "n").alias("share"))


def best_cuts(grid: DataFrame, target: float) -> DataFrame:
    """The row of `sweep_grid` that keeps most at the target precision; without one, the most precise."""
    met = F.col("precision") >= target
    order = [met.desc(), F.when(met, F.col("kept")).desc_nulls_last(), F.col("precision").desc(), F.col("kept").desc(), F.col("cut_a"), F.col("cut_b")]
    return grid.where("kept > 0").orderBy(*order).limit(1)


def describe(df: DataFrame, group: str, value: str) -> DataFrame:
    p = F.percentile(value, F.array(*map(F.lit, (0.1, 0.25, 0.5, 0.75, 0.9))))
    a = df.groupBy(group).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"), F.min(value).alias("least"), F.max(value).alias("most"), p.alias("p"))
    return a.select(group, "n", "mean", "std", "least", *(F.col("p")[i].alias(k) for i, k in enumerate(("p10", "p25", "p50", "p75", "p90"))), "most")


def market_window(local: Column) -> Column:
    """The window of the trading day that a local time falls in; the night wraps at midnight."""
    m = F.hour(local) * 60 + F.minute(local)
    return (
        F.when((m >= 1050) & (m < 1320), "evening").when((m >= 1320) | (m < 360), "late_night").when(m < 450, "early").when(m < 540, "pre_market").otherwise("market")
    )


def half_hours(df: DataFrame, ts: str) -> DataFrame:
    """(slot 0..47, n) with zeros."""
    slots = df.sparkSession.range(48).select(F.col("id").cast("int").alias("slot"))
    n = df.groupBy(F.floor((F.hour(ts) * 60 + F.minute(ts)) / 30).cast("int").alias("slot")).agg(F.count("*").alias("n"))
    return slots.join(n, "slot", "left").select("slot", F.coalesce("n", F.lit(0)).alias("n"))


def band(margin: Column) -> Column:
    return F.when(margin < 0.015, "hard").when(margin < 0.035, "mid").when(margin < 0.07, "easy").otherwise("very_easy")


def labelling_pool(df: DataFrame, cid: str, margin: str, key: str, k: int = 10) -> DataFrame:
    """Per class about k rows, most of them with a small margin: a quota per band, then the rest in band order."""
    b = band(F.col(margin))
    rank = F.when(b == "hard", 0).when(b == "mid", 1).when(b == "easy", 2).otherwise(3)
    size = F.least(F.lit(k), F.count("*").over(Window.partitionBy(cid)))
    quota = F.greatest(F.lit(1), F.round(size * F.when(b == "hard", 0.40).when(b == "mid", 0.35).when(b == "easy", 0.20).otherwise(0.05)))
    rows = df.withColumn("band", b).withColumn("_b", rank).withColumn("_k", size).withColumn("_q", quota)
    rows = rows.withColumn("_i", F.row_number().over(Window.partitionBy(cid, "_b").orderBy(margin, key)))
    order = Window.partitionBy(cid).orderBy((F.col("_i") > F.col("_q")).cast("int"), "_b", margin, key)
    return rows.withColumn("_n", F.row_number().over(order)).where("_n <= _k").select(cid, key, margin, "band")


def top_n(df: DataFrame, group: str, order: list, n: int) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col("rank") <= n)


def hash_sample(df: DataFrame, group: str, key: str, n: int) -> DataFrame:
    """n rows per group in the order of a hash of the key: a sample that reruns agree on."""
    return top_n(df, group, [F.md5(F.col(key).cast("string")), key], n).drop("rank")

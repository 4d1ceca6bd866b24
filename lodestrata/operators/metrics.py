"""Metrics of predictions, each as one aggregation or a few windows over distinct scores."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordered import percentiles, prefix_sums, value_ranks

DIGITS = 6


def _r(c: Column, name: str, digits: int = DIGITS) -> Column:
    return F.round(c, digits).alias(name)


def regression(df: DataFrame, groups: Sequence[str], y: str, p: str) -> DataFrame:
    """n, MAE, RMSE, R2 (null if y is constant), Pearson r."""
    e, v = F.col(y) - F.col(p), F.col(y)
    rows = df.where(F.col(y).isNotNull() & F.col(p).isNotNull()).groupBy(*groups).agg(F.count("*").alias("n"), F.avg(F.abs(e)).alias("mae"), F.avg(e * e).alias("mse"), F.var_pop(v).alias("var"), F.corr(y, p).alias("r"))
    return rows.select(*groups, "n", _r(F.col("mae"), "mae"), _r(F.sqrt("mse"), "rmse"), _r(1 - F.try_divide(F.col("mse"), F.col("var")), "r2"), _r(F.col("r"), "pearson"))


def _by_score(df: DataFrame, groups: Sequence[str], label: str, score: str) -> DataFrame:
    """Positives and negatives at each distinct score: small however many rows share a score, and combined before the shuffle."""
    return df.where(F.col(label).isNotNull() & F.col(score).isNotNull()).groupBy(*groups, F.col(score).alias("s")).agg(F.count_if(F.col(label) == 1).alias("p"), F.count_if(F.col(label) == 0).alias("q"))


def auroc(df: DataFrame, groups: Sequence[str], label: str, score: str) -> DataFrame:
    """Rank statistic with ties counted half; null if a class is empty."""
    rows = prefix_sums(_by_score(df, groups, label, score), groups, ["s"], {"under": "q"})
    sums = rows.groupBy(*groups).agg(F.sum("p").alias("n_pos"), F.sum("q").alias("n_neg"), F.sum(F.col("p") * (F.col("under") + F.col("q") / F.lit(2.0))).alias("u"))
    return sums.select(*groups, "n_pos", "n_neg", _r(F.try_divide(F.col("u"), F.col("n_pos").cast("double") * F.col("n_neg")), "auroc"))


def average_precision(df: DataFrame, groups: Sequence[str], label: str, score: str) -> DataFrame:
    """Sum over distinct thresholds of the recall gained times the precision there; null without positives."""
    rows = prefix_sums(_by_score(df, groups, label, score), groups, [F.desc("s")], {"tp": "p", "fp": "q"})
    rows = rows.withColumn("tp", F.col("tp") + F.col("p")).withColumn("all", F.col("tp") + F.col("fp") + F.col("q"))
    sums = rows.groupBy(*groups).agg(F.sum("p").alias("n_pos"), F.sum(F.col("p") * F.col("tp") / F.col("all")).alias("a"))
    return sums.select(*groups, "n_pos", _r(F.try_divide(F.col("a"), F.col("n_pos")), "auprc"))


def average_rank(partition: Sequence[str], value: Column) -> Column:
    """1-based rank with ties averaged."""
    return F.rank().over(Window.partitionBy(*partition).orderBy(value)) + (F.count("*").over(Window.partitionBy(*partition, value)) - 1) / F.lit(2.0)


def spearman(df: DataFrame, groups: Sequence[str], a: str, b: str) -> DataFrame:
    """Correlation of average ranks, null if one side is constant. Rows are counted by (a, b) before the shuffle, and ranks are
    found over distinct values, by parts of a group."""
    own = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(*groups, F.col(a).alias("__a"), F.col(b).alias("__b")).agg(F.count("*").alias("__n"))
    ranks = {side: value_ranks(own, groups, side, "__n").withColumnRenamed("rank", f"{side}_rank") for side in ("__a", "__b")}
    own = _with_group(own, own.groupBy(*groups).agg(F.sum("__n").alias("__size")), groups, [])
    for side in ranks:
        own = _with_group(own, ranks[side], groups, [side])
    # the mean of a group's ranks is (size + 1) / 2
    n, da, db = F.col("__n"), *(F.col(f"{side}_rank") - (F.col("__size") + 1) / F.lit(2.0) for side in ("__a", "__b"))
    sums = own.groupBy(*groups).agg(F.sum(n).alias("n"), F.sum(n * da * db).alias("ab"), F.sum(n * da * da).alias("aa"), F.sum(n * db * db).alias("bb"))
    return sums.select(*groups, "n", _r(F.try_divide(F.col("ab"), F.sqrt("aa") * F.sqrt("bb")), "rho"))


def _with_group(df: DataFrame, values: DataFrame, groups: Sequence[str], also: Sequence[str]) -> DataFrame:
    """df with the other columns of `values`, which has a row for each group (null is a group) and the columns `also`."""
    keys = [*groups, *also]
    named = values.select(*[F.col(k).alias(f"__of_{k}") for k in keys], *[c for c in values.columns if c not in keys])
    same = F.lit(True)
    for k in keys:
        same &= F.col(k).eqNullSafe(F.col(f"__of_{k}"))
    return df.join(named, same).drop(*[f"__of_{k}" for k in keys])


def _rates(groups: Sequence[str]) -> list[Column]:
    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))
    recall, spec = F.try_divide(tp, tp + fn), F.try_divide(tn, tn + fp)
    den = F.sqrt((tp + fp).cast("double") * (tp + fn) * (tn + fp) * (tn + fn))
    return [
        *[F.col(g) for g in groups], tp, fp, tn, fn,
        _r(F.try_divide(tp, tp + fp), "precision"), _r(recall, "recall"), _r(spec, "specificity"), _r((recall + spec) / 2, "balanced_accuracy"),
        _r(F.try_divide(2 * tp, 2 * tp + fp + fn), "f1"), _r(F.try_divide(tp + tn, tp + fp + tn + fn), "accuracy"), _r(F.try_divide(tp.cast("double") * tn - fp.cast("double") * fn, den), "mcc"),
    ]


def confusion(df: DataFrame, groups: Sequence[str], label: str, predicted: Column) -> DataFrame:
    """Counts and rates; a rate of nothing is null."""
    y, p = F.col(label) == 1, predicted
    rows = df.where(F.col(label).isNotNull()).groupBy(*groups).agg(F.count_if(y & p).alias("tp"), F.count_if(~y & p).alias("fp"), F.count_if(~y & ~p).alias("tn"), F.count_if(y & ~p).alias("fn"))
    return rows.select(*_rates(groups))


def threshold_sweep(df: DataFrame, label: str, score: str, steps: int) -> DataFrame:
    """`confusion` at thresholds i / steps. Rows are first counted by the highest threshold they reach, so the grid meets a
    histogram of steps + 2 bars and not the rows."""
    reached = F.least(F.floor(F.col(score) * steps + 1e-9), F.lit(steps)).cast("int")
    bars = df.where(F.col(label).isNotNull() & F.col(score).isNotNull()).groupBy(reached.alias("k")).agg(F.count_if(F.col(label) == 1).alias("p"), F.count_if(F.col(label) == 0).alias("q"))
    grid = df.sparkSession.range(steps + 1).select(F.col("id").cast("int").alias("i"))
    up = F.col("k") >= F.col("i")
    rows = grid.crossJoin(bars).groupBy("i").agg(F.sum(F.when(up, F.col("p")).otherwise(0)).alias("tp"), F.sum(F.when(up, F.col("q")).otherwise(0)).alias("fp"), F.sum(F.when(up, 0).otherwise(F.col("q"))).alias("tn"), F.sum(F.when(up, 0).otherwise(F.col("p"))).alias("fn"))
    return rows.withColumn("threshold", F.round(F.col("i") / steps, 9)).select(*_rates(["threshold"]))


def best_threshold(sweep: DataFrame, metric: str) -> DataFrame:
    """The threshold of the best metric, the lowest on a tie; nulls do not count."""
    return sweep.where(F.col(metric).isNotNull()).agg(F.max_by("threshold", F.struct(F.col(metric), -F.col("threshold"))).alias("threshold"), F.max(metric).alias(metric))


def calibration(df: DataFrame, label: str, score: str, bins: int) -> DataFrame:
    """Equal-width bins with mean score, positive rate, gap and share of ECE; empty bins have nulls and 0."""
    k = F.least(F.floor(F.col(score) * bins), F.lit(bins - 1)).cast("int")
    rows = df.where(F.col(label).isNotNull() & F.col(score).isNotNull()).groupBy(k.alias("bin")).agg(F.count("*").alias("n"), F.avg(score).alias("m"), F.avg(F.col(label).cast("double")).alias("f"))
    grid = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    own = grid.join(rows, "bin", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    own = own.crossJoin(rows.agg(F.sum("n").alias("all")))
    gap = F.abs(F.col("m") - F.col("f"))
    return own.select("bin", "n", _r(F.col("m"), "mean_score"), _r(F.col("f"), "positive_rate"), _r(gap, "gap"), _r(F.coalesce(F.col("n") / F.col("all") * gap, F.lit(0.0)), "ece_part"))


def probability_losses(df: DataFrame, groups: Sequence[str], label: str, score: str, logit: str) -> DataFrame:
    """Brier score of a probability and the stable log loss of a logit."""
    y, p, x = F.col(label).cast("double"), F.col(score), F.col(logit)
    loss = F.greatest(x, F.lit(0.0)) + F.log1p(F.exp(-F.abs(x))) - y * x
    return df.where(y.isNotNull()).groupBy(*groups).agg(F.count("*").alias("n"), _r(F.avg((p - y) * (p - y)), "brier"), _r(F.coalesce(F.avg(loss), F.lit(0.0)), "log_loss"))


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """n / (classes * count) of each class."""
    sizes = df.where(F.col(label).isNotNull()).groupBy(label).agg(F.count("*").alias("n"))
    return sizes.crossJoin(sizes.agg(F.sum("n").alias("all"), F.count("*").alias("k"))).select(label, "n", F.round(F.col("all") / (F.col("k") * F.col("n")), 9).alias("weight"))


def standardised(df: DataFrame, value: str, train: Column, name: str = "z") -> DataFrame:
    """z-scores by mean and population sd of the training rows; an sd of 0 counts as 1. The one fitted row is copied to all."""
    v = F.when(train, F.col(value))
    fit = df.agg(F.avg(v).alias("__m"), F.coalesce(F.nullif(F.stddev_pop(v), F.lit(0.0)), F.lit(1.0)).alias("__s"))
    return df.crossJoin(F.broadcast(fit)).withColumn(name, (F.col(value) - F.col("__m")) / F.col("__s")).drop("__m", "__s")


def imputed(df: DataFrame, value: str, train: Column) -> DataFrame:
    """Nulls become the exact median of the training rows."""
    fit = percentiles(df.where(train), [], value, (0.5,)).select(F.col("q")[0].alias("__m"))
    return df.crossJoin(F.broadcast(fit)).withColumn(value, F.coalesce(value, "__m")).drop("__m")


def token_f1(pairs: DataFrame, key: str, a: str, b: str) -> DataFrame:
    """Multiset F1 and exact match of two token arrays; of several rows of a key the best. Empty against empty is 1."""
    def counts(c):
        return F.aggregate(F.array_distinct(c), F.lit(0), lambda acc, x: acc + F.least(F.size(F.filter(F.col(a), lambda t: t == x)), F.size(F.filter(F.col(b), lambda t: t == x))))

    n = F.size(a) + F.size(b)
    f1 = F.when(n == 0, 1.0).otherwise(2.0 * counts(F.col(a)) / n)
    return pairs.select(key, f1.alias("f1"), (F.col(a) == F.col(b)).cast("int").alias("em")).groupBy(key).agg(_r(F.max("f1"), "f1"), F.max("em").alias("exact"))


def macro_f1(df: DataFrame, groups: Sequence[str], label: str, predicted: Column) -> DataFrame:
    """The mean F1 of both classes and their number of rows; a class that is neither present nor predicted has an F1 of 0."""
    y, p = F.col(label) == 1, predicted
    rows = df.where(F.col(label).isNotNull()).groupBy(*groups).agg(F.count("*").alias("n"), F.count_if(y & p).alias("tp"), F.count_if(~y & p).alias("fp"), F.count_if(~y & ~p).alias("tn"), F.count_if(y & ~p).alias("fn"))
    f1 = lambda hit: F.coalesce(F.try_divide(2 * hit, 2 * hit + F.col("fp") + F.col("fn")), F.lit(0.0))
    return rows.select(*groups, "n", _r((f1(F.col("tp")) + f1(F.col("tn"))) / 2, "macro_f1"))


def choice_accuracy(df: DataFrame, group: str, option: str, score: str, right: Column) -> DataFrame:
    """Groups of options: the share of groups whose option of the highest score (the lowest option on a tie) is right."""
    best = df.groupBy(group).agg(F.max_by(right.cast("int"), F.struct(F.col(score), -F.col(option))).alias("hit"))
    return best.agg(F.count("*").alias("n_groups"), _r(F.avg("hit"), "accuracy"))


def constant_prediction(df: DataFrame, value: str, train: Column, name: str = "predicted") -> DataFrame:
    """The median of the training rows as the prediction of every row; the one fitted row is copied to all."""
    fit = percentiles(df.where(train), [], value, (0.5,)).select(F.col("q")[0].alias(name))
    return df.crossJoin(F.broadcast(fit))


def pair_accuracy(df: DataFrame, groups: Sequence[str], label: str, score: str, band: float = 1e-5) -> DataFrame:
    """Of all pairs of a positive and a negative of a group: how many there are, and the share won by the positive; scores
    within the band share the point. Pairs are counted from running totals over distinct scores, by parts of a group, and never
    made."""
    one = df.where(F.col(label).isNotNull() & F.col(score).isNotNull())
    at = one.groupBy(*groups, F.col(score).cast("double").alias("__x")).agg(F.count_if(F.col(label) == 0).alias("__neg"), F.count_if(F.col(label) == 1).alias("__pos"))
    # a positive asks, just below and just above its band, how many negatives lie up to there: its points are half of each sum
    points = F.array(*[F.struct(x.alias("__x"), F.lit(o).alias("__o"), n.alias("__neg"), p.alias("__ask")) for x, o, n, p in (
        (F.col("__x"), 0, F.col("__neg"), F.lit(0).cast("long")),
        (F.col("__x") - F.lit(band * (1 + 1e-9)), 1, F.lit(0).cast("long"), F.col("__pos")),
        (F.col("__x") + F.lit(band), 1, F.lit(0).cast("long"), F.col("__pos")),
    )])
    asked = at.select(*groups, F.explode(points).alias("__p")).select(*groups, "__p.*").where("__neg > 0 or __ask > 0")
    upto = prefix_sums(asked, groups, ["__x", "__o"], {"__upto": "__neg"})
    sums = upto.groupBy(*groups).agg((F.sum("__ask") / 2).cast("long").alias("p"), F.sum("__neg").alias("q"), (F.sum(F.col("__ask") * F.col("__upto")) / F.lit(2.0)).alias("w"))
    return sums.select(*groups, (F.col("p") * F.col("q")).alias("n_pairs"), _r(F.try_divide(F.col("w"), F.col("p") * F.col("q")), "pair_accuracy"))

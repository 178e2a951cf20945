"""Evaluation of scores, labels and ratings; every report is one lazy DataFrame."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from flowfeat.columns import need
from flowfeat.functions import scores

CUTS, CUTS_PER_UNIT = 49, 50.0  # cut points 1/50 … 49/50


def _ratio(part, total) -> Column:
    return F.try_divide(part.cast("double"), total.cast("double"))


def confusion_counts(df: DataFrame, prediction: str = "prediction", label: str = "label") -> DataFrame:
    """One row (tp, fp, tn, fn) from a single pass over 0/1 predictions and labels."""
    need(df, prediction, label)
    p, y = F.col(prediction).cast("double"), F.col(label).cast("double")
    return df.agg(
        F.count_if((p == 1.0) & (y == 1.0)).alias("tp"),
        F.count_if((p == 1.0) & (y == 0.0)).alias("fp"),
        F.count_if((p == 0.0) & (y == 0.0)).alias("tn"),
        F.count_if((p == 0.0) & (y == 1.0)).alias("fn"),
    )


def confusion(df: DataFrame, prediction: str = "prediction", label: str = "label", places: int | None = 3) -> DataFrame:
    """Confusion counts with accuracy, precision, recall and the areas under ROC and PR.

    Hard predictions have one inner point on either curve, so both areas follow from the
    four counts and no sort of the data is needed. Zero denominators give NULL.
    """
    counts = confusion_counts(df, prediction, label)
    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))
    recall, precision = _ratio(tp, tp + fn), _ratio(tp, tp + fp)
    base, specificity = _ratio(tp + fn, tp + fp + tn + fn), _ratio(tn, tn + fp)
    top = F.coalesce(precision, base)  # no positive prediction: the curve starts at the base rate
    values = {
        "accuracy": _ratio(tp + tn, tp + fp + tn + fn),
        "precision": precision,
        "recall": recall,
        "auroc": (recall + specificity) / 2,
        "aupr": recall * top + (1 - recall) * (top + base) / 2,
    }
    return counts.select("*", *[_rounded(v, places).alias(k) for k, v in values.items()])


def _rounded(value: Column, places: int | None) -> Column:
    return value if places is None else scores.to_decimal(value, places)


def binary_report(df: DataFrame, prediction: str = "prediction", label: str = "label", places: int | None = 3) -> DataFrame:
    """One row: auroc of 0/1 predictions, accuracy, and precision and recall weighted by class.

    The class table (one row per label and prediction) is built by one partial aggregate;
    everything else is computed from it.
    """
    need(df, prediction, label)
    cells = df.groupBy(F.col(label).cast("double").alias("y"), F.col(prediction).cast("double").alias("p")).agg(
        F.count(F.lit(1)).alias("n")
    )
    # from here on one row per class pair
    per_y = cells.groupBy("y").agg(F.sum("n").alias("true_n"), F.sum(F.when(F.col("p") == F.col("y"), F.col("n")).otherwise(0)).alias("hit"))
    per_p = cells.groupBy("p").agg(F.sum("n").alias("pred_n"))
    classes = per_y.join(per_p, F.col("y") == F.col("p"), "left")
    total = F.sum("true_n")
    precision = F.coalesce(_ratio(F.col("hit"), F.col("pred_n")), F.lit(0.0))

    def of_class(value: float) -> Column:
        mine = F.col("y") == value
        return _ratio(F.sum(F.when(mine, F.col("hit"))), F.sum(F.when(mine, F.col("true_n"))))

    return classes.agg(
        _rounded((of_class(1.0) + of_class(0.0)) / 2, places).alias("auroc"),
        _rounded(_ratio(F.sum("hit"), total), places).alias("accuracy"),
        _rounded(F.try_divide(F.sum(precision * F.col("true_n")), total), places).alias("weighted_precision"),
        _rounded(_ratio(F.sum("hit"), total), places).alias("weighted_recall"),
    )


def pr_at_cut(df: DataFrame, cut: float, score: str = "score", label: str = "label") -> DataFrame:
    """One row (cut, precision, recall) for predictions score > cut."""
    need(df, score, label)
    above, positive = F.col(score) > F.lit(float(cut)), F.col(label) == 1.0
    counts = df.agg(
        F.count_if(above).alias("p"), F.count_if(positive).alias("y"), F.count_if(above & positive).alias("tp")
    )
    return counts.select(
        F.lit(float(cut)).alias("cut"),
        _ratio(F.col("tp"), F.col("p")).alias("precision"),
        _ratio(F.col("tp"), F.col("y")).alias("recall"),
    )


def cut_counts(df: DataFrame, score: str = "score", label: str = "label") -> DataFrame:
    """(i, predicted, tp) for every cut point i/50, and row i = 0 with the totals.

    One pass counts the rows by the number of cut points below their score (at most 50
    groups); only these groups are then added up per cut point.
    """
    need(df, score, label)
    below = F.coalesce(scores.cuts_below(score, CUTS, CUTS_PER_UNIT), F.lit(0))
    buckets = df.groupBy(below.alias("b")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col(label) == 1.0).alias("pos")
    )
    at_cut = buckets.select(F.explode(F.sequence(F.lit(0), F.col("b"))).alias("i"), "n", "pos")
    return at_cut.groupBy("i").agg(F.sum("n").alias("predicted"), F.sum("pos").alias("tp"))


def pr_curve(df: DataFrame, score: str = "score", label: str = "label") -> DataFrame:
    """(cut, precision, recall) at the 49 cut points 0.02 … 0.98, predictions score > cut."""
    counts = cut_counts(df, score, label)
    cuts = df.sparkSession.range(0, CUTS + 1).select(F.col("id").cast("int").alias("i"))
    rows = cuts.join(counts, "i", "left").fillna(0, ["predicted", "tp"])
    positives = F.max("tp").over(W.partitionBy())  # 50 rows; row 0 holds all positives
    return (
        rows.withColumn("positives", positives)
        .where(F.col("i") > 0)
        .select(
            (F.col("i") / F.lit(CUTS_PER_UNIT)).alias("cut"),
            _ratio(F.col("tp"), F.col("predicted")).alias("precision"),
            _ratio(F.col("tp"), F.col("positives")).alias("recall"),
        )
        .orderBy("cut")
    )


def _ranked(df: DataFrame, k: int, user: str, score: str, label: str) -> DataFrame:
    """(user, rank, rows, positives, best): the top k of a user, one row per distinct score.

    Equal scores share a rank, so rows are first counted per (user, score), and the rank of a
    score is one plus the rows above it. At most k distinct scores of a user can matter; the
    row-number filter applies that bound before the shuffle by user. A user with any number
    of rows, tied or not, costs at most k rows per task.
    """
    per_score = df.groupBy(user, score).agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(F.col(label) == 1.0).alias("positives"),
        F.max(label).alias("best"),
    )
    falling = W.partitionBy(user).orderBy(F.desc(score))
    top = per_score.withColumn("_at", F.row_number().over(falling)).where(F.col("_at") <= k)
    above = F.sum("rows").over(falling.rowsBetween(W.unboundedPreceding, -1))
    ranked = top.withColumn("rank", F.coalesce(above, F.lit(0)) + 1).where(F.col("rank") <= k)
    return ranked.select(user, "rank", "rows", "positives", "best")


def top_k(df: DataFrame, k: int, user: str = "userIdIndex", score: str = "score") -> DataFrame:
    """Rows whose rank by falling score within the user is at most k (equal scores share one)."""
    need(df, user, score)
    ranks = df.withColumn("rank", F.rank().over(W.partitionBy(user).orderBy(F.desc(score))))
    return ranks.where(F.col("rank") <= k)


def user_mean_rank(
    df: DataFrame, k: int = 30, user: str = "userIdIndex", score: str = "score", label: str = "label"
) -> DataFrame:
    """(user, mean_rank) of the positives in the top k; k+1 for users without one.

    A `rank` column in the input is used as it is.
    """
    if "rank" in df.columns:
        hit = F.count_if(F.col(label) == 1.0).alias("positives")
        top = df.where(F.col("rank") <= k).groupBy(user, "rank").agg(hit)
    else:
        need(df, user, score, label)
        top = _ranked(df, k, user, score, label)
    mean = _ratio(F.sum(F.col("rank") * F.col("positives")), F.sum("positives"))
    return top.groupBy(user).agg(F.coalesce(mean, F.lit(float(k + 1))).alias("mean_rank"))


def abs_rank(df: DataFrame, k: int = 30, user: str = "userIdIndex", score: str = "score", label: str = "label") -> DataFrame:
    """(rank, count): users by their truncated mean rank of positives, in rank order."""
    per_user = user_mean_rank(df, k, user, score, label)
    return (
        per_user.groupBy(F.col("mean_rank").cast("int").alias("rank"))
        .agg(F.count(F.lit(1)).alias("count"))
        .orderBy("rank")
    )


def user_hit_gain(
    df: DataFrame, k: int = 30, user: str = "userIdIndex", score: str = "score", label: str = "label"
) -> DataFrame:
    """(user, hit, gain) of the user's best-labelled row in the top k, the best-ranked one first."""
    need(df, user, score, label)
    top = _ranked(df, k, user, score, label)
    best = top.groupBy(user).agg(F.max(F.struct("best", (-F.col("rank")).alias("back"))).alias("_b"))
    found, rank = F.col("_b.best"), -F.col("_b.back")
    return best.select(
        user,
        F.when(found.isNull() | (found == 0), 0).otherwise(1).alias("hit"),
        F.when(found == 1, scores.rank_gain(rank)).otherwise(F.lit(0.0)).alias("gain"),
    )


def hit_ndcg(df: DataFrame, k: int = 30, user: str = "userIdIndex", score: str = "score", label: str = "label") -> DataFrame:
    """One row (hit_ratio, ndcg): means over users."""
    per_user = user_hit_gain(df, k, user, score, label)
    return per_user.agg(F.avg("hit").alias("hit_ratio"), F.avg("gain").alias("ndcg"))


def score_buckets(df: DataFrame, score: str = "score", label: str = "label") -> DataFrame:
    """(bucket, count, percent): positives per tenth of the score and their share."""
    need(df, score, label)
    buckets = (
        df.where(F.col(label) == 1.0)
        .groupBy(scores.score_to_bucket(score).alias("bucket"))
        .agg(F.count(F.lit(1)).alias("count"))
    )
    total = F.sum("count").over(W.partitionBy())  # over the buckets, not the rows
    return buckets.select("bucket", "count", scores.share("count", total).alias("percent"))


def rating_report(
    df: DataFrame, prediction: str = "prediction", label: str = "label", whole: bool = False, total: int | None = None
) -> DataFrame:
    """One row (rmse, mse, accuracy, n) of predicted against true ratings.

    `whole` rounds predictions to whole ratings first; `total` replaces the row count in the
    accuracy, for predictions that cover only part of the rated rows.
    """
    need(df, prediction, label)
    predicted = F.col(prediction).cast("double")
    predicted = F.round(predicted) if whole else predicted
    truth = F.col(label).cast("double")
    error = scores.squared_error(predicted, truth)
    n = F.lit(total) if total is not None else F.count(F.lit(1))
    return df.agg(
        F.sqrt(F.avg(error)).alias("rmse"),
        F.avg(error).alias("mse"),
        _ratio(F.count_if(predicted == truth), n).alias("accuracy"),
        n.cast("long").alias("n"),
    )


def mae(df: DataFrame, prediction: str = "prediction", label: str = "label") -> DataFrame:
    """One row (mae, top1): mean absolute error and share of exact matches."""
    need(df, prediction, label)
    predicted, truth = F.col(prediction).cast("double"), F.col(label).cast("double")
    return df.agg(
        F.avg(F.abs(predicted - truth)).alias("mae"),
        F.avg((predicted == truth).cast("double")).alias("top1"),
    )


def residuals(df: DataFrame, idx: str = "idx", prediction: str = "prediction", label: str = "label") -> DataFrame:
    """(idx, label, prediction, error) with the absolute error."""
    need(df, idx, prediction, label)
    return df.select(idx, label, prediction, F.abs(F.col(label) - F.col(prediction)).alias("error"))


def unlabelled_users(df: DataFrame, user: str = "userIdIndex", label: str = "label") -> DataFrame:
    """Users that have no positive row."""
    need(df, user, label)
    return df.groupBy(user).agg(F.max((F.col(label) == 1.0).cast("int")).alias("_p")).where(
        F.coalesce("_p", F.lit(0)) == 0
    ).select(user)

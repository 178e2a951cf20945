"""Model jobs on Spark ML."""

from __future__ import annotations

import sys
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from functools import partial, reduce
from itertools import product

import numpy as np
import pandas as pd
from pyspark import cloudpickle, inheritable_thread_target
from pyspark.ml import Estimator, Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression, MultilayerPerceptronClassifier
from pyspark.ml.feature import Binarizer, OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.ml.functions import array_to_vector
from pyspark.ml.recommendation import ALS
from pyspark.ml.regression import LinearRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowfeat.columns import need
from flowfeat.functions import scores
from flowfeat.operators import metrics
from flowfeat.session import checkpoint_folder

# functions go to the executors by value, so that they need no copy of the package
cloudpickle.register_pickle_by_value(sys.modules[__name__])


ALS_BLOCKS = 10  # of users and of items, as Spark has them
BLOCK_RATINGS = 8_000_000  # a task of a fit holds the ratings of a block several times over


def als_blocks(rows: int) -> int:
    """Blocks of a fit of so many ratings: ten up to 80 million, then as many as keep a block within the memory of a task."""
    return max(ALS_BLOCKS, -(-rows // BLOCK_RATINGS))


def als(
    df: DataFrame, user: str = "userId", item: str = "movieId", rating: str = "rating", max_iter: int = 5,
    reg: float = 0.01, rank: int = 10, seed: int = 42, implicit: bool = False, blocks: int = ALS_BLOCKS,
):
    """Fitted ALS model; users and items unknown to it get no prediction.

    The start values follow from the seed and the number of `blocks`. With more blocks than Spark's ten a vector is sent to more of
    them, so the item vectors of every step are stored then, and what was shuffled for them is deleted at once.
    """
    need(df, user, item, rating)
    if blocks > ALS_BLOCKS:
        checkpoint_folder(df.sparkSession)
    return ALS(
        numUserBlocks=blocks, numItemBlocks=blocks, checkpointInterval=1 if blocks > ALS_BLOCKS else 10, rank=rank, maxIter=max_iter, regParam=reg, userCol=user, itemCol=item, ratingCol=rating, seed=seed,
        implicitPrefs=implicit, coldStartStrategy="drop",
    ).fit(df.select(user, item, rating))


def als_implicit(df: DataFrame, **settings):
    return als(df, implicit=True, **settings)


def als_report(train: DataFrame, test: DataFrame, rating: str = "rating", **settings) -> DataFrame:
    """Fit on `train`; rmse, mse and accuracy of predictions for `test` rounded to whole ratings."""
    scored = als(train, rating=rating, **settings).transform(test)
    return metrics.rating_report(scored, "prediction", rating, whole=True)


def grid(
    train: DataFrame, test: DataFrame, fit: Callable[..., object], settings: dict[str, list], label: str = "label",
    metric: Callable[[DataFrame], DataFrame] | None = None, stored: bool = False, at_once: int = 2,
) -> DataFrame:
    """One row per combination of `settings`: its values and the report of its predictions.

    `fit(train, **combination)` returns a fitted model. The input tables are the same for all
    runs and are read once; with `stored` the caller has persisted them, or the table they are cut from. `at_once` fits run side
    by side, as a fit has fewer tasks than the cluster has cores where its model is cut into a fixed number of blocks.
    """
    metric = metric or (lambda scored: metrics.rating_report(scored, "prediction", label))
    spark = train.sparkSession

    def line(chosen: dict) -> DataFrame:
        row = metric(fit(train, **chosen).transform(test)).first().asDict()
        return spark.createDataFrame([{**chosen, **row}])

    train, test = (train, test) if stored else (train.persist(), test.persist())
    try:
        train.count()  # or fits that begin together would each read the tables
        test.count()
        # each run has its own copy of the local properties, in which Spark keeps the id of a query
        runs = [inheritable_thread_target(spark)(partial(line, dict(zip(settings, v, strict=True)))) for v in product(*settings.values())]
        with ThreadPoolExecutor(at_once) as pool:
            lines = list(pool.map(lambda run: run(), runs))
        return reduce(DataFrame.unionByName, lines) if lines else None
    finally:
        if not stored:
            train.unpersist()
            test.unpersist()


def cross_sums(df: DataFrame, inputs: list[str], label: str) -> DataFrame:
    """One row with the sums of all products of the inputs, the label and one, as the array `sums` of a triangle, row by row."""
    need(df, *inputs, label)
    values = [F.lit(1.0), *[F.col(c).cast("double") for c in inputs], F.col(label).cast("double")]
    whole = df.where(reduce(lambda a, b: a & b, [v.isNotNull() for v in values]))
    return whole.agg(F.array(*[F.sum(a * b) for i, a in enumerate(values) for b in values[i:]]).alias("sums"))


def _square(row, size: int) -> np.ndarray:
    out = np.zeros((size, size))
    if row["sums"] is not None and row["sums"][0] is not None:
        out[np.triu_indices(size)] = row["sums"]
    return out + np.triu(out, 1).T


def ridge_grid(train: DataFrame, test: DataFrame, inputs: list[str], penalties: list[float], label: str = "label") -> DataFrame:
    """One row per penalty: penalty, the array `weights`, intercept, train_rmse and test_rmse of the least-squares fit.

    A fit needs nothing but the sums of products of its columns, and so does its error on other rows. Both tables are
    passed over once, whatever the number of penalties; what reaches the driver are (inputs + 2)² numbers for each. The
    intercept is not penalised.
    """
    size = len(inputs) + 2
    fit, held = (_square(cross_sums(df, inputs, label).first(), size) for df in (train, test))
    rows = []
    for penalty in penalties:
        weights = np.linalg.lstsq(fit[:-1, :-1] + penalty * np.diag([0.0] + [1.0] * len(inputs)), fit[:-1, -1], rcond=None)[0]
        far = np.append(weights, -1.0)  # prediction less label, as a sum over the columns
        errors = [float(np.sqrt(max(far @ m @ far, 0.0) / m[0, 0])) if m[0, 0] else None for m in (fit, held)]
        rows.append((float(penalty), [float(w) for w in weights[1:]], float(weights[0]), *errors))
    schema = "penalty double, weights array<double>, intercept double, train_rmse double, test_rmse double"
    return train.sparkSession.createDataFrame(rows, schema)


def fold_in(
    ratings: DataFrame, factors: DataFrame, reg: float = 0.01, user: str = "user", item: str = "item", rating: str = "rating",
    vector: str = "features",
) -> DataFrame:
    """(user, features, n): factors of users that a fitted model has not seen, by least squares against its item factors.

    Per user the sums of products of the factors of its items are added up, in part before the shuffle, so a user with very many
    ratings is as cheap as any; then one small system per user is solved. The penalty grows with the number of ratings, as
    in the fit of the factors. Ratings of items without factors, and null ratings, count for nothing.
    """
    need(ratings, user, item, rating)
    need(factors, item, vector)
    rank = factors.agg(F.max(F.size(vector))).first()[0] or 0
    known = factors.select(F.col(item).alias("_i"), F.col(vector).cast("array<double>").alias("_v"))
    rows = ratings.select(user, item, F.col(rating).cast("double").alias("_r")).where(F.col("_r").isNotNull())
    rows = rows.join(known, F.col(item) == F.col("_i"))
    places = [F.get("_v", F.lit(k)) for k in range(rank)]
    products = [F.sum(a * b) for i, a in enumerate(places) for b in places[i:]]
    sums = rows.groupBy(user).agg(
        F.array(*products).alias("a"), F.array(*[F.sum(a * F.col("_r")) for a in places]).alias("b"), F.count(F.lit(1)).alias("n")
    )

    def solve(frames):
        for frame in frames:
            if not len(frame):
                continue
            upper = np.stack(frame["a"].to_numpy())
            whole = np.zeros((len(frame), rank, rank))
            rows_, cols = np.triu_indices(rank)
            whole[:, rows_, cols] = upper
            whole[:, cols, rows_] = upper
            whole += np.eye(rank) * (reg * frame["n"].to_numpy())[:, None, None]
            found = np.linalg.solve(whole, np.stack(frame["b"].to_numpy())[:, :, None])[:, :, 0]
            yield pd.DataFrame({user: frame[user], "features": list(found), "n": frame["n"]})

    kind = ratings.schema[user].dataType.simpleString()
    return sums.mapInPandas(solve, f"`{user}` {kind}, features array<double>, n bigint")


def factor_scores(
    pairs: DataFrame, users: DataFrame, items: DataFrame, user: str = "user", item: str = "item", vector: str = "features", out: str = "prediction"
) -> DataFrame:
    """`pairs` with the dot product of the factors of user and item; pairs of which one has no factors are left out."""
    left = users.select(F.col(user).alias("_u"), F.col(vector).cast("array<double>").alias("_uv"))
    right = items.select(F.col(item).alias("_i"), F.col(vector).cast("array<double>").alias("_iv"))
    rows = pairs.join(left, F.col(user) == F.col("_u")).join(right, F.col(item) == F.col("_i"))
    total = F.aggregate(F.zip_with("_uv", "_iv", lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    return rows.withColumn(out, total).drop("_u", "_uv", "_i", "_iv")


def dense_classifier(
    df: DataFrame, features: str = "features", label: str = "label", layers: tuple[int, ...] = (100, 40, 20, 10, 2),
    max_iter: int = 20, seed: int = 42,
):
    """Fitted feed-forward classifier on a vector column; labels count from zero."""
    need(df, features, label)
    return MultilayerPerceptronClassifier(
        layers=list(layers), maxIter=max_iter, seed=seed, featuresCol=features, labelCol=label
    ).fit(df)


def wide_deep_classifier(df: DataFrame, label: str = "label", max_iter: int = 20, reg: float = 0.0):
    """Fitted rating classifier on the columns of `features.wide_deep`.

    Codes and the hashed cross are one-hot encoded, age and occupation enter as numbers.
    """
    need(df, "gender", "age", "occupation", "genres", "age-gender", label)
    codes = ["gender", "genres", "age-gender"]
    encode = OneHotEncoder(
        inputCols=codes, outputCols=[f"{c}_vec" for c in codes], handleInvalid="keep", dropLast=False
    )
    gather = VectorAssembler(inputCols=[*[f"{c}_vec" for c in codes], "age", "occupation"], outputCol="features")
    fit = LogisticRegression(maxIter=max_iter, regParam=reg, labelCol=label)
    return Pipeline(stages=[encode, gather, fit]).fit(df)


def window_rows(windows: DataFrame, feature: str = "feature") -> DataFrame:
    """Windows with a vector column `features` of all their values."""
    need(windows, feature)
    return windows.withColumn("features", array_to_vector(F.flatten(feature)))


def forecast(train: DataFrame, test: DataFrame, idx: str = "idx", label: str = "label", reg: float = 0.0) -> DataFrame:
    """Residuals (idx, label, prediction, error) of a linear next-value forecast for `test`."""
    model = LinearRegression(labelCol=label, regParam=reg).fit(window_rows(train))
    return metrics.residuals(model.transform(window_rows(test)), idx, "prediction", label)


def doc_classifier(df: DataFrame, features: str = "features", label: str = "label", max_iter: int = 20, reg: float = 0.0):
    """Fitted classifier on one vector (array of double) per document."""
    need(df, features, label)
    vectors = df.select(F.col(label).cast("double").alias("label"), array_to_vector(features).alias("features"))
    vectors = vectors.persist()  # the fit passes over its input several times
    try:
        return LogisticRegression(maxIter=max_iter, regParam=reg).fit(vectors)
    finally:
        vectors.unpersist()


def linear(df: DataFrame, inputs: list[str], label: str = "label"):
    """Fitted least-squares regression; `coefficients` and `intercept` hold the result."""
    need(df, *inputs, label)
    rows = VectorAssembler(inputCols=inputs, outputCol="features").transform(df)
    return LinearRegression(labelCol=label, solver="normal").fit(rows)


def index_binarize(text: str = "test_string", number: str = "test_double", threshold: float = 0.5) -> Pipeline:
    """Unfitted pipeline: string index and threshold flag."""
    return Pipeline(
        stages=[
            StringIndexer(inputCol=text, outputCol=f"{text}_index"),
            Binarizer(threshold=threshold, inputCol=number, outputCol=f"{number}_bin"),
        ]
    )


def save_pipeline(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_pipeline(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def load_or_fit(path: str, estimator: Estimator, df: DataFrame) -> PipelineModel:
    """The pipeline stored at `path` if there is one, else one fitted now and stored there."""
    spark = df.sparkSession
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    if files.exists(folder):
        return load_pipeline(path)
    stages = estimator if isinstance(estimator, Pipeline) else Pipeline(stages=[estimator])
    model = stages.fit(df)
    save_pipeline(model, path)
    return model


def exact_match(df: DataFrame, prediction: str = "prediction", label: str = "label") -> DataFrame:
    """One row (accuracy)."""
    need(df, prediction, label)
    hit = (F.col(prediction).cast("double") == F.col(label).cast("double")).cast("double")
    return df.agg(scores.to_decimal(F.avg(hit), 6).alias("accuracy"))

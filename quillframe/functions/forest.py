"""Random-forest importances on assembled numeric features."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import StringIndexer, VectorAssembler
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillframe.columns import col, is_numeric, num
from quillframe.functions.profile import fit


def is_class_target(df: DataFrame, target: str) -> bool:
    """Few values, or text."""
    k = fit(df, k=F.count_distinct(col(target)))["k"]
    return k <= 10 or (k <= 20 and not is_numeric(df, target))


def labelled(df: DataFrame, features: Sequence[str], target: str, classify: bool) -> DataFrame:
    """(label, features) with positional feature names, complete rows only."""
    y = col(target).cast("string") if classify else num(target)
    rows = df.select(y.alias("_y"), *[num(c).alias(f"_{i}") for i, c in enumerate(features)]).na.drop()
    if classify:
        rows = StringIndexer(inputCol="_y", outputCol="label").fit(rows).transform(rows)
    else:
        rows = rows.withColumnRenamed("_y", "label")
    return rows


def importances(rows: DataFrame, positions: Sequence[int], classify: bool, trees: int, depth: int, seed: int) -> list[float]:
    data = VectorAssembler(inputCols=[f"_{i}" for i in positions], outputCol="features").transform(rows)
    kind = RandomForestClassifier if classify else RandomForestRegressor
    model = kind(numTrees=trees, maxDepth=depth, seed=seed, labelCol="label", featuresCol="features").fit(
        data.select("label", "features"))
    return [float(model.featureImportances[i]) for i in range(len(positions))]

"""Regressors over sampled records: every cell is a group of bounded size, and all of them are fitted in one job. Labels go in and come out in hours."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.functions.math import from_label, to_label
from tidewater.operators import trees as grown

#: Models by name: from training features, targets and weights to predictions for other features. More can be added.
MODELS = {"gradient_boosting": grown.boosted, "random_forest": grown.forest}
#: Models that fit several samples together faster than one by one, with the same results: from samples and their seeds to predictions.
TOGETHER = {"gradient_boosting": grown.boosted_each}

PARTS = 6  # of fits, for each shuffle partition


def assembled(rows: DataFrame, features: list[str], defaults: dict | None = None) -> DataFrame:
    """rows with the vector column features; nulls take their column's default, or 0."""
    filled = rows.fillna({f: (defaults or {}).get(f, 0.0) for f in features})
    return VectorAssembler(inputCols=features, outputCol="features").transform(filled)


def scaled(rows: DataFrame, features: list[str], defaults: dict | None = None) -> DataFrame:
    """rows with features scaled to mean 0 and deviation 1 in the column scaled."""
    made = assembled(rows, features, defaults)
    return StandardScaler(inputCol="features", outputCol="scaled", withMean=True, withStd=True).fit(made).transform(made)


def all_cells(samples: DataFrame, features: list[str], models: list[str], keys: list[str] | None = None, seed: int = 42, trees: int = 200, log_label: bool = True) -> DataFrame:
    """Predictions of all cells (keys, d, p, repeat) in samples by each model: keys, model, d, p, repeat, t, change_id, y_true, y_pred.

    A cell is one fit, in one task: it holds the days that so many sampled changes spend in one bin of a cycle, so its
    size follows from the design (dataset.split) and not from the tables. A group holds the cells of a distance and a
    repeat, as some models fit several faster; groups are spread over the cluster in one shuffle. Lost tasks are fitted
    again with the same result, as rows are put in order and draws follow from seed + repeat. Null features count as 0;
    a cell without training rows gives nothing.
    """
    cell = [*(keys or []), "d", "p", "repeat"]
    target = to_label(F.col("label")) if log_label else F.col("label")
    wanted = [*cell, "t", "change_id", "side", "label", "weight", *features]
    rows = samples.select(*wanted).fillna({"weight": 1.0, **dict.fromkeys(features, 0.0)}).withColumn("_target", target)
    rows = rows.withColumn("model", F.explode(F.array(*(F.lit(m) for m in models))))
    out = rows.select(*(keys or []), "model", "d", "p", "repeat", "t", "change_id", F.col("label").alias("y_true"), F.lit(0.0).alias("y_pred"))

    schema, names = out.schema, out.columns

    def fit(group: pd.DataFrame) -> pd.DataFrame:
        name, seeds = group.model.iloc[0], seed + int(group.repeat.iloc[0])
        group, samples, asked = group.sort_values(["p", "change_id", "t"], kind="stable"), [], []
        for _, rows in group.groupby("p"):
            train, ask = rows[rows.side == "train"], rows[rows.side == "eval"]
            if len(train) and len(ask):
                x, own = (part[features].to_numpy(np.float64) for part in (train, ask))
                samples.append((x, train["_target"].to_numpy(np.float64), train["weight"].to_numpy(np.float64), own))
                asked.append(ask)
        if not samples:
            return group.iloc[:0].rename(columns={"label": "y_true"}).assign(y_pred=0.0)[names]
        made = TOGETHER[name](samples, [seeds] * len(samples), trees) if name in TOGETHER else [MODELS[name](*s, seeds, trees) for s in samples]
        return pd.concat(asked).rename(columns={"label": "y_true"}).assign(y_pred=np.concatenate(made))[names]

    # More partitions than tasks at once, so that no core waits long for the last ones; a group is too long for chance to be fair.
    parts = PARTS * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    fitted = rows.repartition(parts, *(keys or []), "d", "repeat", "model").groupBy(*(keys or []), "d", "repeat", "model").applyInPandas(fit, schema)
    return fitted.withColumn("y_pred", from_label(F.col("y_pred"))) if log_label else fitted

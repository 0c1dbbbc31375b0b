"""Trained networks as functions of lines and clusters: a hook for whatever runs them.

A model is loaded once in each task by a function that is given, and called with Arrow batches turned into one matrix; the
library trains none. Rows stay where they are, so nothing is shuffled and a lost task only runs again."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Model = Callable[[np.ndarray], np.ndarray]


def predict(df: DataFrame, load: Callable[[], Model], features: Column | str, output: str = "embedding", normalise: bool = False, batch: int = 1024) -> DataFrame:
    """df with an array column of what the model gives for each row's feature array, at most `batch` rows a call;
    with normalise, of length 1 (a zero vector stays). load() gives the model: rows by features to rows by outputs.
    A null feature array has a null output and is not shown to the model."""

    @F.pandas_udf("array<float>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load()
        for part in parts:
            out = pd.Series([None] * len(part), dtype=object)
            known = np.flatnonzero(part.notna())
            for lo in range(0, len(known), batch):
                own = known[lo : lo + batch]
                found = np.asarray(model(np.stack([np.asarray(x, np.float32) for x in part.iloc[own]])), np.float32)
                if len(found) != len(own):
                    raise ValueError(f"the model gave {len(found)} rows for {len(own)}")
                if normalise:
                    size = np.linalg.norm(found, axis=1, keepdims=True)
                    found = found / np.where(size > 0, size, 1)
                for i, x in zip(own, found):
                    out.iloc[i] = x
            yield out

    return df.withColumn(output, run(F.col(features) if isinstance(features, str) else features))


def clusters_of_frames(frames: DataFrame, load: Callable[[], Model], features: str = "lines", background: int = 0) -> DataFrame:
    """frames with `clusters`: for each line of a padded frame (as batches.frame_inputs gives it, with `valid`) the class
    that the model rates highest; -1 for padding. The model gets a frame's lines in a row and gives lines by classes in a row."""
    flat = predict(frames.withColumn("_flat", F.flatten(features)), load, "_flat", "_rated", batch=16)
    n = F.size(features)
    rows = flat.withColumn("_width", (F.size("_rated") / n).cast("int"))
    rating = lambda i: F.slice("_rated", i * F.col("_width") + 1, F.col("_width"))
    best = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.when(F.get("valid", i), F.array_position(rating(i), F.array_max(rating(i))).cast("int") - 1).otherwise(-1))
    return rows.withColumn("clusters", best).drop("_flat", "_rated", "_width")

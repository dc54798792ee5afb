"""What the two classifiers share: Adam, and a bounded, repeatable sample of rows to fit on."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Adam:
    def __init__(self, values: dict[str, np.ndarray], rates: dict[str, float], rate: float):
        self.values, self.rates, self.step = values, {k: rates.get(k, rate) for k in values}, 0
        self.m = {k: np.zeros_like(v) for k, v in values.items()}
        self.v = {k: np.zeros_like(v) for k, v in values.items()}

    def update(self, gradients: dict[str, np.ndarray | tuple[np.ndarray, np.ndarray]], decay: float = 0.0) -> None:
        """A gradient of a table can be (rows, their gradients): then only those rows change, and decay."""
        self.step += 1
        for k, g in gradients.items():
            at, g = g if isinstance(g, tuple) else (slice(None), g)
            m, v = self.m[k][at], self.v[k][at]
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            self.m[k][at], self.v[k][at] = m, v
            change = (m / (1 - 0.9**self.step)) / (np.sqrt(v / (1 - 0.999**self.step)) + 1e-8)
            if decay and not isinstance(at, slice):
                change = change + decay / self.rates[k] * self.values[k][at]
            self.values[k][at] -= self.rates[k] * change


def held_out(id_col: str) -> Column:
    """One row in three, by its id; never learned from."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1


def sample(ids: DataFrame, id_col: str, most: int) -> DataFrame:
    """``most`` ids in the order of a hash: the same ones at every run and on any partitioning.  Only ids are sorted."""
    return ids.select(id_col).distinct().orderBy(F.xxhash64(F.lit("fit"), id_col), id_col).limit(most)


def texts_of(docs: DataFrame, ids: DataFrame, id_col: str, text_col: str) -> list:
    """(id, t) of the rows with one of the bounded number of ``ids``, by a broadcast of those; of a repeated id the least text."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("t")).filter(F.col("t").isNotNull())
    return rows.join(F.broadcast(ids.select(F.col(id_col).alias("id"))), "id", "left_semi").groupBy("id").agg(F.min("t").alias("t")).collect()

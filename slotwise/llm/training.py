"""Bounded training samples and a small optimiser."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slotwise.llm import runtime
from slotwise.llm.textblock import HELD_BYTES, give_back


#: Classes that a sample may have, and bytes of text that a model is fitted on: the task that fits holds no more.
MAX_CLASSES, TOTAL_BYTES = 20, 32 << 20


def labelled_sample(docs: DataFrame, labels: DataFrame, label: Column, *, per_class: int, max_bytes: int, keep: Column | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text, y) of at most ``per_class`` rows of each class, the least by a hash of their id.

    Rows with a null id or label, or a text of more than ``max_bytes``, are passed over; ids with
    several labels count with the least. More than ``MAX_CLASSES`` classes are an error. The ids are chosen
    first, so only bounded data meets the texts.
    """
    rows = labels.select(F.col(id_col).alias("id"), label.cast("int").alias("y")).where("id is not null and y is not null")
    if keep is not None:
        rows = rows.where(keep)
    rows = rows.groupBy("id").agg(F.min("y").alias("y"))
    classes = [r[0] for r in rows.select("y").distinct().orderBy("y").limit(MAX_CLASSES + 1).collect()]
    if len(classes) > MAX_CLASSES:
        raise ValueError(f"the labels have more than {MAX_CLASSES} classes")
    chosen = [(r["id"], r["y"]) for y in classes for r in rows.where(F.col("y") == y).orderBy(F.xxhash64(F.col("id").cast("string")), "id").limit(per_class).collect()]
    picked = docs.sparkSession.createDataFrame(chosen, "id " + docs.schema[id_col].dataType.simpleString() + ", y int")
    found = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).where(F.octet_length("text") <= max_bytes)
    return found.join(F.broadcast(picked), "id").select("id", "text", "y")  # at most per_class ids a class


def fit_on(sample: DataFrame, fit: Callable[[list[str], np.ndarray], Any], total_bytes: int = TOTAL_BYTES) -> Any:
    """What ``fit`` makes of the (bounded) sample, in a task of its own; only the model comes to the driver.

    Of a sample of more than ``total_bytes`` the rows first by a hash of their id are taken, as far as they fit.
    """
    runtime.ship(sample.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, left = [], total_bytes
        for batch in batches:
            size = np.asarray(pc.binary_length(batch.column(1))).astype(np.int64) if left > 0 else np.zeros(0, np.int64)
            fits = int(np.searchsorted(np.cumsum(size), left, "right"))
            rows += zip(*(c.to_pylist() for c in batch.slice(0, fits).columns), strict=True)
            left = left - int(size[:fits].sum()) if fits == len(size) else 0
        rows.sort(key=lambda r: (str(r[0]), r[1]))
        model = fit([r[1] for r in rows], np.array([r[2] for r in rows], np.int64))
        rows.clear()
        give_back(HELD_BYTES + 1)
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], ["model"])

    ordered = sample.repartition(1).sortWithinPartitions(F.xxhash64(F.col("id").cast("string"), F.lit(1)), "id", "text")
    made = ordered.mapInArrow(run, "model binary").first()
    return pickle.loads(made[0]) if made else fit([], np.zeros(0, np.int64))  # noqa: S301  our own bytes


class Adam:
    """Full-batch steps of the size ``rate`` at most, scaled by each parameter's recent gradients."""

    def __init__(self, n: int, rate: float):
        self.w, self._m, self._v, self._t, self.rate = np.zeros(n), np.zeros(n), np.zeros(n), 0, rate

    def step(self, g: np.ndarray) -> None:
        self._t += 1
        self._m += 0.1 * (g - self._m)
        self._v += 0.01 * (g * g - self._v)
        m, v = self._m / (1 - 0.9**self._t), self._v / (1 - 0.99**self._t)
        self.w -= self.rate * m / (np.sqrt(v) + 1e-10)


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * z))


def softplus(z: np.ndarray) -> np.ndarray:
    return np.maximum(z, 0) + np.log1p(np.exp(-np.abs(z)))

"""Held-out rows, bounded samples of labelled rows, and a small logistic fit shared by the classifiers."""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .words import slices


#: Tasks that share a bounded sample.
SAMPLE_TASKS = 32


def remainder(doc_id: str, by: int) -> Column:
    """crc32 of the id written as text, modulo `by`; a null id counts as the empty text."""
    return (F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % by).cast("int")


def sample(docs: DataFrame, labels: DataFrame, label: str, train, limit: int) -> DataFrame:
    """`text` and `label` of labelled training rows: all if there are at most `limit`, else the `limit` with the
    smallest hash of id and label, the same at every run. Null labels and ids are no labels."""
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", F.col(label).cast("int").alias("label"))
    chosen = known.where(train).orderBy(F.xxhash64("doc_id", F.lit(7)), "doc_id", "label").limit(limit)
    # ids of a bounded sample: at most `limit` rows are sent to the executors; an id that documents share has the smallest of their
    # texts, so there are no more texts than ids and labels
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text"))
    return texts.select("text", "label").repartition(SAMPLE_TASKS)


class Logistic:
    """Weights of a logistic score, fitted by Newton steps on standardised features with a small penalty."""

    def __init__(self, features: np.ndarray, labels: np.ndarray, penalty: float = 1.0, steps: int = 25) -> None:
        n, k = features.shape
        self.mean = features.mean(0) if n else np.zeros(k)
        spread = features.std(0) if n else np.ones(k)
        self.spread = np.where(spread > 1e-12, spread, 1.0)
        x = np.column_stack([np.ones(n), (features - self.mean) / self.spread])
        self.weights = np.zeros(k + 1)
        ridge = np.diag([1e-3] + [penalty] * k)
        for _ in range(steps if n else 0):
            p = self.of(x @ self.weights)
            hessian = (x * (p * (1 - p))[:, None]).T @ x + ridge
            move = np.linalg.solve(hessian, x.T @ (labels - p) - ridge @ self.weights)
            self.weights += np.clip(move, -4, 4)

    @staticmethod
    def of(z: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))

    def score(self, features: np.ndarray) -> np.ndarray:
        return self.of(self.weights[0] + (features - self.mean) / self.spread @ self.weights[1:])


def score(docs: DataFrame, model, keep: list[str] | None = None, out: str = "score") -> DataFrame:
    """`docs` with the model's score between 0 and 1 of each whole text (null: as empty) as column `out`. Every row comes out
    once, repeated ones and null ids too; `keep` names the columns wanted besides (all by default; a column
    called `out` is replaced). No shuffle."""
    keep = [c for c in (docs.columns if keep is None else keep) if c != out]
    sent = docs.sparkSession.sparkContext.broadcast(model)
    # a text that is kept is sent to the tasks once
    read = f"k{keep.index('text')}" if "text" in keep else "read"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, read):
                scores = sent.value.score(part.column(read).to_pylist())
                kept = [part.column(f"k{i}") for i in range(len(keep))]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(scores, pa.float64())], [*(f"k{i}" for i in range(len(keep))), "score"])

    chosen = docs.select(*(F.col(c).alias(f"k{i}") for i, c in enumerate(keep)))
    schema = "".join(f"{f.name} {f.dataType.simpleString()}, " for f in chosen.schema.fields) + "score double"
    chosen = chosen if read != "read" else docs.select(*(F.col(c).alias(f"k{i}") for i, c in enumerate(keep)), F.col("text").alias("read"))
    return chosen.mapInArrow(run, schema).toDF(*keep, out)

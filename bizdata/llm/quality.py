"""Text quality by compression with two dictionaries.

One zstandard dictionary is built from good labelled texts, one from bad ones. A text is compressed with each, in
blocks, since a dictionary helps the first bytes of a frame most. The difference of the two sizes over their sum,
with the rates themselves and the rate without a dictionary, becomes a calibrated score.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .labelled import Logistic, remainder, sample

#: Bounds of what is learned: labelled texts read, bytes of each class and of each text that a dictionary is built from,
#: dictionary bytes.
LABELLED_TEXTS = 6_000
BYTES_PER_CLASS = 4 << 20
BYTES_PER_TEXT = 64 << 10
DICTIONARY_BYTES = 64 << 10
BLOCK = 2048
LEVEL = 3
WIDTH = 9


def dictionary(texts: list[bytes]) -> bytes:
    """A dictionary built from blocks of the texts; from few bytes, the bytes themselves."""
    blocks = [t[a:a + BLOCK] for t in texts for a in range(0, len(t), BLOCK)]
    size = sum(map(len, blocks))
    try:
        return zstandard.train_dictionary(min(DICTIONARY_BYTES, max(1024, size // 16)), blocks).as_bytes()
    except zstandard.ZstdError:  # too few or too equal blocks for the builder
        return b"".join(blocks)[:DICTIONARY_BYTES] or b" " * 8


def excerpt(text: Column) -> Column:
    """Bytes of a text; of one of more than BYTES_PER_TEXT, blocks at even distances that fill as many."""
    raw, many = F.coalesce(text, F.lit("")).cast("binary"), BYTES_PER_TEXT // BLOCK
    last = F.floor(F.octet_length(raw) / BLOCK) - 1  # the last whole block
    parts = [F.substring(raw, (F.floor(last * k / (many - 1)) * BLOCK + 1).cast("int"), F.lit(BLOCK)) for k in range(many)]
    return F.when(F.octet_length(raw) <= BYTES_PER_TEXT, raw).otherwise(F.concat(*parts))


class Model:
    def __init__(self, good: bytes, bad: bytes, fit: Logistic | None = None) -> None:
        self.good, self.bad, self.fit = good, bad, fit
        self.compressors = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"compressors": None}  # made anew by each worker

    def build(self) -> None:
        made = []
        for raw in (self.good, self.bad):
            data = zstandard.ZstdCompressionDict(raw)
            data.precompute_compress(LEVEL)
            made.append(zstandard.ZstdCompressor(LEVEL, dict_data=data, write_content_size=False, write_dict_id=False, write_checksum=False))
        made.append(zstandard.ZstdCompressor(LEVEL, write_content_size=False, write_checksum=False))
        self.compressors = made

    def features(self, text: str | None) -> list[float]:
        if self.compressors is None:
            self.build()
        good, bad, plain = self.compressors
        raw = (text or "").encode()
        g = b = p = 0
        for at in range(0, len(raw), BLOCK):
            part = raw[at:at + BLOCK]
            g += len(good.compress(part))
            b += len(bad.compress(part))
            p += len(plain.compress(part))
        n = len(raw) + 16
        difference = (b - g) / max(1, b + g)
        size = np.log(n)
        return [difference, g / n, b / n, p / n, size, difference * size, difference ** 2, (p / n) ** 2, (p / n) * size]

    def score(self, texts: list[str | None]) -> np.ndarray:
        x = np.array([self.features(t) for t in texts]).reshape(-1, WIDTH)
        return self.fit.score(x) if self.fit is not None else Logistic.of(20 * x[:, 0])


def fit(docs: DataFrame, labels: DataFrame, train: Column | None = None, limit: int = LABELLED_TEXTS) -> Model:
    """Dictionaries and calibration from at most `limit` labelled rows that `train` admits (by default those with
    crc32(doc_id) mod 3 other than 1). Half of them (by a hash of the text) build the dictionaries, the other half
    calibrates, so no text is judged by a dictionary that holds it."""
    train = remainder("doc_id", 3) != 1 if train is None else train
    texts = sample(docs, labels, "quality", train, limit).dropDuplicates(["text", "label"]).persist()
    half = F.pmod(F.xxhash64(F.coalesce("text", F.lit(""))), F.lit(2)) == 0
    order = Window.partitionBy("label").orderBy("h", "text").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    built = (texts.where(half).withColumn("h", F.xxhash64("text", F.lit(1))).withColumn("part", excerpt(F.col("text")))
             .withColumn("sum", F.sum(F.octet_length("part")).over(order)).where(F.col("sum") <= BYTES_PER_CLASS)
             .select("part", "label").collect())
    raw = {k: [bytes(r["part"]) for r in built if r["label"] == k and r["part"]] for k in (0, 1)}
    model = Model(dictionary(raw[1]), dictionary(raw[0]))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [model.features(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.list_(pa.float64())), batch.column("label")], ["x", "label"])

    rows = texts.where(~half).mapInArrow(measure, "x array<double>, label int").toArrow()
    texts.unpersist()
    y = rows["label"].to_numpy().astype(float)
    x = np.array(rows["x"].to_pylist()).reshape(-1, WIDTH)
    model.fit = Logistic(x, y) if 0 < y.sum() < len(y) else None
    return model

"""Document quality: histogram gradient-boosted trees over statistics of a text.

One pass over the texts writes a small table of statistics; the model is fitted on a bounded sample of its labelled rows
(SAMPLE, taken by a hash of the id) and every row is scored from the table. Null and empty texts have statistics of 0 and a score
like any other; null ids pass through and are never labelled; repeated rows score alike; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import gbdt, scratch, textkit

#: The most labelled rows that the model is fitted on.
SAMPLE = 20_000

# Classes of bytes whose shares are statistics.
CLASSES = (b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t\r\x0b\x0c", b"\n", b".", b",;:", b"!", b"?", b"#*$%&<>", b"|", b"\"'()[]{}", b"-_/\\@=+~^`")
NAMES = (
    "log_bytes", "log_words", "word_bytes", "word_spread", "longest_word", "distinct_words", "top_word", "repeated_shingles", "words_a_line", "words_a_sentence",
    *[f"class_{i}" for i in range(len(CLASSES))], "high_bytes", "other_bytes",
)

_CLASS = np.full(256, len(CLASSES) + 1, np.int64)
_CLASS[128:] = len(CLASSES)
for _i, _c in enumerate(CLASSES):
    _CLASS[list(_c)] = _i


def statistics(column) -> np.ndarray:
    """A row of NAMES for each text, float32."""
    data, offsets = textkit.utf8(column)
    n, kinds = len(offsets) - 1, len(CLASSES) + 2
    out = np.zeros((n, len(NAMES)), np.float32)
    size = np.diff(offsets)
    shares = np.zeros((n, kinds))
    for a in range(0, len(data), textkit.PIECE):
        part = data[a : a + textkit.PIECE]
        lo, hi = np.searchsorted(offsets, [a, a + len(part)], side="right") - 1
        hi = min(hi, n - 1)
        inside = np.clip(offsets[lo : hi + 2] - a, 0, len(part))
        doc = np.repeat(np.arange(hi - lo + 1), np.diff(inside))
        shares[lo : hi + 1] += np.bincount(doc * kinds + _CLASS[part], minlength=(hi - lo + 1) * kinds).reshape(-1, kinds)
    words = textkit.Words(data, offsets)
    grams, first = textkit.shingles(words)
    count, length = np.diff(words.first), (words.end - words.start).astype(np.float64)
    for i in np.flatnonzero(count).tolist():
        a, b = words.first[i], words.first[i + 1]
        own = length[a:b]
        _, times = np.unique(words.hash[a:b], return_counts=True)
        g = first[i + 1] - first[i]
        out[i, 2:8] = own.mean(), own.std(), own.max(), len(times) / (b - a), times.max() / (b - a), 1 - len(np.unique(grams[first[i] : first[i + 1]])) / max(g, 1)
    out[:, 0], out[:, 1] = np.log1p(size), np.log1p(count)
    out[:, 8] = count / (shares[:, 4] + 1)
    out[:, 9] = count / (shares[:, 5] + shares[:, 7] + shares[:, 8] + 1)
    out[:, 10:] = shares / np.maximum(size, 1)[:, None]
    return out


def _rows(batches):
    for batch in batches:
        for a, b in textkit.pieces_of(batch.column(1)):
            part = batch.slice(a, b - a)
            x = statistics(part.column(1))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), len(NAMES)).cast(pa.list_(pa.float32()))], ["doc_id", "x"])


def table(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, x): the written table of statistics."""
    scratch.small_batches(docs.sparkSession)
    made = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(textkit.lean(_rows), "doc_id long, x array<float>")
    return scratch.table(made, "quality-statistics")


def sampled(labelled: DataFrame, key: str, most: int) -> DataFrame:
    """About `most` rows at most, by a hash of the key: the bound of what is collected, whatever the number of labels."""
    n = labelled.count()
    return labelled if n <= most else labelled.where(F.pmod(F.xxhash64(F.col(key)), F.lit(1 << 20)) < int((1 << 20) * 0.97 * most / n)).limit(most)


def fit(stats: DataFrame, labels: DataFrame, train: Column, most: int = SAMPLE) -> gbdt.Trees:
    """The model of labels (doc_id, y 0 or 1), from rows where `train` (of doc_id) holds."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col("y").isin(0, 1) & train).groupBy("doc_id").agg(F.max("y").alias("y"))
    rows = stats.join(sampled(known, "doc_id", most), "doc_id").select("y", "x").limit(2 * most).toArrow()
    x = np.asarray(rows["x"].combine_chunks().flatten(), np.float32).reshape(-1, len(NAMES))
    return gbdt.fit(x.astype(np.float64), np.asarray(rows["y"], np.float64))


def score(stats: DataFrame, model: gbdt.Trees) -> DataFrame:
    """(doc_id, score) of every row of the table."""

    def rows(batches):
        for batch in batches:
            x = np.asarray(batch.column(1).flatten(), np.float64).reshape(-1, len(NAMES))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.probability(x))], ["doc_id", "score"])

    return stats.mapInArrow(textkit.lean(rows), "doc_id long, score double")


def held_out(modulus: int, rest: int) -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus == rest, F.lit(False))


def op2(spark, sf_dir: str) -> DataFrame:
    stats = table(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", F.col("quality").alias("y"))
    found = score(stats, fit(stats, labels, ~held_out(3, 1)))
    return found.select("doc_id", held_out(3, 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))

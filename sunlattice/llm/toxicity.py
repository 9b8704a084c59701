"""Toxicity by multiple-instance learning: a document is toxic if one of its sentences is.

A sentence's chance comes from a logistic model of its hashed words, stems and pairs of neighbouring words, which speak for or against; a document's is
1 minus the product of the sentences' chances of being clean (noisy-or). Only document labels are known in training; the sentence scores locate the
offending sentences. Sentences end at . ! ? or a line's end.

Handling: null and empty texts have no sentence and score 0; null ids pass through; repeated rows score alike; a document whose labels contradict
each other counts as toxic; features of equal chi-square are taken by their number; further columns aren't read, whatever their names; an empty table gives an
empty result. Texts are taken in pieces of about textkit.PIECE bytes, a longer text alone: its words take some 90 bytes each.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import scratch, textkit
from .quality_classifier import held_out, sampled

#: The most labelled documents that the model is fitted on, and the most words that a fit takes (documents are taken by a hash until then).
SAMPLE = 12_000
MOST_WORDS = 12_000_000
#: Places for hashed features, and the most features that get a weight.
BUCKETS = 1 << 20
FEATURES = 2048
#: Besides a word itself, its first so many bytes are features: stems that take endings.
STEMS = (4, 5, 6, 7, 8, 10)

_END = np.zeros(256, bool)
_END[list(b".!?\n")] = True


@dataclass
class Sentences:
    """bucket: (words, 2 + STEMS) features, BUCKETS for none: a word, its stems, and it with the next word of its sentence; start: the word at which each sentence (with a word) starts;
    first: the number of sentences before each text; words: the words."""

    bucket: np.ndarray
    start: np.ndarray
    first: np.ndarray
    words: textkit.Words


def sentences(texts) -> Sentences:
    data, offsets = textkit.utf8(texts)
    words = textkit.Words(data, offsets, STEMS)
    border = np.flatnonzero(_END[data]) + 1
    at = np.unique(np.concatenate([np.searchsorted(words.start, border), words.first]))
    at = at[at < len(words.start)]
    with np.errstate(over="ignore"):
        pair = textkit.mix(words.hash * np.uint64(0x9E3779B97F4A7C15) + np.append(words.hash[1:], np.uint64(0))) | np.uint64(1)
    pair[np.append(at[1:], len(pair))[np.append(at[1:], len(pair)) > 0] - 1] = 0  # a sentence's last word has no next one
    bucket = np.stack([np.where(h == 0, BUCKETS, (h % np.uint64(BUCKETS)).astype(np.int64)) for h in (words.hash, *words.prefix, pair)], axis=1)
    return Sentences(bucket, at, np.searchsorted(at, words.first), words)


@dataclass
class Model:
    """weight: one for each bucket, and 0 for none."""

    weight: np.ndarray
    bias: float

    def margin(self, found: Sentences) -> np.ndarray:
        """Log odds of each sentence: the bias and its words' weights, each as often as it stands there."""
        if not len(found.start):
            return np.zeros(0)
        total = np.concatenate([[0], np.cumsum(self.weight[found.bucket].sum(axis=1, dtype=np.float64))])
        return self.bias + total[np.append(found.start[1:], len(found.bucket))] - total[found.start]

    def chance(self, found: Sentences) -> np.ndarray:
        """The noisy-or of the sentences of each text."""
        total = np.concatenate([[0], np.cumsum(_clean(self.margin(found)))])
        return np.clip(-np.expm1(total[found.first[1:]] - total[found.first[:-1]]), 0, 1)


def _clean(margin: np.ndarray) -> np.ndarray:
    """Log of the chance that a sentence is clean."""
    return -np.logaddexp(0, margin)


def _select(texts: pa.Array, y: np.ndarray) -> np.ndarray:
    """The features whose presence or absence goes with the label, by the chi-square of documents; FEATURES at most."""
    with_, toxic = np.zeros(BUCKETS + 1), np.zeros(BUCKETS + 1)
    for a, b in textkit.pieces_of(texts, textkit.PIECE):
        found = sentences(texts[a:b])
        doc = np.repeat(np.arange(b - a), np.diff(found.words.first))
        pairs = np.unique(doc[:, None] * np.int64(BUCKETS + 1) + found.bucket)
        feature = pairs % (BUCKETS + 1)
        with_ += np.bincount(feature, minlength=BUCKETS + 1)
        toxic += np.bincount(feature, y[a:b][pairs // (BUCKETS + 1)], minlength=BUCKETS + 1)
    n, n1 = len(y), y.sum()
    chi = n * (toxic * (n - n1) - (with_ - toxic) * n1) ** 2 / np.maximum(with_ * (n - with_) * n1 * (n - n1), 1e-9)
    chi[with_ < 5] = 0
    chi[BUCKETS] = 0
    best = np.argsort(-chi, kind="stable")[:FEATURES]
    return np.sort(best[chi[best] > 20])


def fit(texts: pa.Array, y: np.ndarray, steps: int = 200, rate: float = 0.2, l2: float = 0.3, bias: float = -6.0) -> Model:
    """Full-batch Adam on the documents' cross-entropy, from a start in which sentences are clean."""
    model = Model(np.zeros(BUCKETS + 1), bias)
    if not len(y) or y.min() == y.max():
        model.bias = 20.0 if len(y) and y.min() == 1 else -20.0
        return model
    used = _select(texts, y)
    place = np.full(BUCKETS + 1, -1)
    place[used] = np.arange(len(used))
    column, sentence, first, n_sentences = [], [], [], 0
    for a, b in textkit.pieces_of(texts, textkit.PIECE):
        found = sentences(texts[a:b])
        at = place[found.bucket]
        word, kind = np.nonzero(at >= 0)
        column.append(at[word, kind])
        sentence.append(np.searchsorted(found.start, word, side="right") - 1 + n_sentences)
        first.append(found.first[:-1] + n_sentences)
        n_sentences += len(found.start)
    column, sentence, first = map(np.concatenate, (column, sentence, first))
    has = np.diff(np.append(first, n_sentences)) > 0
    y, first = y[has].astype(np.float64), first[has]
    doc = np.repeat(np.arange(len(first)), np.diff(np.append(first, n_sentences)))
    w, b = np.zeros(len(used)), bias
    m, v = np.zeros(len(used) + 1), np.zeros(len(used) + 1)
    for step in range(1, steps + 1):
        margin = np.clip(b + np.bincount(sentence, w[column], n_sentences), -40, 40)
        clean = np.exp(np.add.reduceat(_clean(margin), first))
        # d loss / d margin of a sentence: its chance, times 1 in a clean document, times -clean / toxic in a toxic one
        pull = np.where(y == 1, -clean / np.maximum(1 - clean, 1e-12), 1.0)
        g_sentence = pull[doc] / (1 + np.exp(-margin)) / len(y)
        g = np.append(np.bincount(column, g_sentence[sentence], len(used)) + l2 / len(y) * w, g_sentence.sum())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        move = rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-9)
        w, b = w - move[:-1], b - move[-1]
    model.weight[used], model.bias = w, float(b)
    return model


def locate(model: Model, text: str | None, threshold: float = 0.5) -> list[tuple[int, int, float]]:
    """(first byte, end, chance) of the sentences of a text whose chance reaches the threshold; from its first word to its last."""
    found = sentences(pa.array([text], pa.string()))
    chance = 1 / (1 + np.exp(-model.margin(found)))
    stops = np.append(found.start, len(found.words.start))[1:]
    return [(int(found.words.start[a]), int(found.words.end[b - 1]), float(c)) for a, b, c in zip(found.start, stops, chance, strict=True) if c >= threshold]


def train(docs: DataFrame, labels: DataFrame, allowed: Column, key: str = "doc_id", text: str = "text", most: int = SAMPLE) -> Model:
    """The model of labels (doc_id, y 0 or 1) of documents for which `allowed` (of doc_id) holds."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col("y").isin(0, 1) & allowed).groupBy("doc_id").agg(F.max("y").alias("y"))
    chosen = sampled(known, "doc_id", most)
    rows = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text")).join(F.broadcast(chosen), "doc_id")
    size = F.sum(F.length(F.coalesce("text", F.lit(""))).cast("long"))
    share = MOST_WORDS * 6 / max(1, rows.agg(size).first()[0] or 0)
    if share < 1:
        rows = rows.where(F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(1 << 20)) < int(share * (1 << 20)))
    got = rows.select("y", "text").toArrow()
    return fit(got["text"].combine_chunks(), np.asarray(got["y"], np.int64))


def score(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text", threshold: float = 0.5) -> DataFrame:
    """(doc_id, score, n_offending, offending) of every text: the sentences whose chance reaches the threshold, as (start, end, chance) in code points, from the
    first word to the last."""
    scratch.small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast((model.weight.astype(np.float32), model.bias))
    spans = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("chance", pa.float64())]))

    def rows(batches):
        own = Model(*shared.value)
        for batch in batches:
            for a, b in textkit.pieces_of(batch.column(1)):
                part = batch.slice(a, b - a)
                found = sentences(part.column(1))
                margin = own.margin(found)
                over = np.flatnonzero(margin >= np.log(threshold / (1 - threshold)))
                text_of = np.searchsorted(found.first, over, side="right") - 1
                places: list[list[dict]] = [[] for _ in range(b - a)]
                if len(over):
                    data, offsets = textkit.utf8(part.column(1))
                    stops = np.append(found.start, len(found.words.start))[1:]
                    points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
                    at = lambda where, t: points[where] - points[offsets[t]]
                    starts, ends = at(found.words.start[found.start[over]], text_of), at(found.words.end[stops[over] - 1], text_of)
                    for t, s, e, m in zip(text_of.tolist(), starts.tolist(), ends.tolist(), margin[over].tolist(), strict=True):
                        places[t].append({"start": s, "end": e, "chance": 1 / (1 + np.exp(-m))})
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(own.chance(found)), pa.array(np.bincount(text_of, minlength=b - a)), pa.array(places, spans)], ["doc_id", "score", "n_offending", "offending"])

    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(textkit.lean(rows), "doc_id long, score double, n_offending long, offending array<struct<start: long, end: long, chance: double>>")


def op4(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", F.col("toxic").alias("y"))
    found = score(docs, train(docs, labels, ~held_out(5, 0)))
    return found.select("doc_id", held_out(5, 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "n_offending")

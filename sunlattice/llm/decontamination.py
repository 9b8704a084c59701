"""Benchmark decontamination: test items inside documents, by size-partitioned MinHash containment search.

An item is the set of its five-word shingles (of all its words, if fewer). Items are partitioned by size into tiers of powers of two; for a tier of
size s, documents are read as windows of two neighbouring blocks of s shingles, so an item that stands in a document stands in a window of about its own
size and their Jaccard is at least about 0.2, however long the document is. HASHES min-hashes of a window and an item, one of which is
equal, propose the pair (missed with a chance of 0.8^HASHES at worst); exact containment in the whole document decides. The minima of larger windows are
taken from those of smaller ones, so each shingle is hashed once for each function. Items of half the least block or less are looked for in windows of
one shingle, whose min-hash is the shingle itself under any function.

Items are held by every task, so different texts are taken in parts of PART_BYTES of text at most, one part's index at a time; more items are more passes.
What is looked for are passages: an item whose shingles stand in a document scattered, each far from the next, is proposed only by chance.
Handling: null texts and texts without words contain nothing and are contained in nothing; null ids pass through; repeated rows, and items of equal
texts, are found each on its own; further columns are kept by decontaminate(), whatever their names; there are no ties; empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from . import ngram_join, scratch, textkit

THRESHOLD = 0.8
HASHES = 64
LEAST_BLOCK = 8
#: The most bytes of items' texts that are searched for in one pass.
PART_BYTES = 16_000_000

_FACTORS = np.random.default_rng(19971).integers(1, 1 << 63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


@dataclass
class Tier:
    """Items of a size. values[k]: sorted min-hashes of function k, items[k]: whose they are; known[k]: a table over 16 of a min-hash's bits."""

    values: np.ndarray
    items: np.ndarray
    known: np.ndarray


@dataclass
class Index:
    """grams[i]: the distinct shingles of item i, of width[i] words; tiers: by width and block size; tiny: by width, the sorted shingles of
    items for windows of one, whose they are, and a table over 16 of their bits."""

    ids: list
    grams: list[np.ndarray]
    width: list[int]
    tiers: dict[int, dict[int, Tier]]
    tiny: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]


def _slot(v: np.ndarray) -> np.ndarray:
    return (v >> np.uint32(4)) & np.uint32(0xFFFF)


def build(ids: list, texts: pa.Array) -> Index:
    words = textkit.Words(*textkit.utf8(texts))
    size = np.diff(words.first)
    index, place = Index([], [], [], {}, {}), {}
    for width in range(1, textkit.SHINGLE + 1):
        own = np.flatnonzero((size >= width) if width == textkit.SHINGLE else (size == width))
        if not len(own):
            continue
        grams, first = textkit.shingles(words, width, short=False)
        for i in own.tolist():
            block = LEAST_BLOCK if 2 * (first[i + 1] - first[i]) > LEAST_BLOCK else 1
            while 1 < block < first[i + 1] - first[i]:
                block *= 2
            place.setdefault((width, block), []).append(len(index.ids))
            index.ids.append(ids[i])
            index.width.append(width)
            index.grams.append(np.unique(grams[first[i] : first[i + 1]]))
    for (width, block), items in place.items():
        sets = [index.grams[i] for i in items]
        if block == 1:
            values, whose = np.concatenate(sets), np.repeat(items, [len(x) for x in sets])
            order = np.argsort(values, kind="stable")
            known = np.zeros(1 << 16, bool)
            known[values >> np.uint64(48)] = True
            index.tiny[width] = values[order], whose[order], known
            continue
        low = (ngram_join.minima(np.concatenate(sets), np.concatenate([[0], np.cumsum([len(s) for s in sets])]), _FACTORS).T >> np.uint64(32)).astype(np.uint32)
        order = np.argsort(low, axis=1, kind="stable")
        values = np.take_along_axis(low, order, axis=1)
        known = np.zeros((HASHES, 1 << 16), bool)
        known[np.arange(HASHES)[:, None], _slot(values)] = True
        index.tiers.setdefault(width, {})[block] = Tier(values, np.array(items)[order], known)
    return index


def _starts(counts: np.ndarray, step: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For texts of so many elements, end to end: where blocks of `step` start, the text of each, and how many blocks each text has."""
    blocks = -(-counts // step)
    text = np.repeat(np.arange(len(counts)), blocks)
    within = np.arange(len(text)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    return np.repeat(np.cumsum(counts) - counts, blocks) + within * step, text, blocks


def _matches(values: np.ndarray, whose: np.ndarray, asked: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, item) of each asked value among the sorted values, as often as it stands there."""
    a, b = (np.searchsorted(values, asked, side=s) for s in ("left", "right"))
    n = b - a
    return np.repeat(text, n), whose[np.repeat(a - np.cumsum(n) + n, n) + np.arange(n.sum())]


def propose(index: Index, words: textkit.Words) -> tuple[np.ndarray, np.ndarray]:
    """(text, item) pairs of which a window's min-hash is an item's."""
    pairs = [np.zeros(0, np.int64)]
    for width in sorted({*index.tiers, *index.tiny}):
        tiers = index.tiers.get(width, {})
        grams, first = textkit.shingles(words, width, short=False)
        counts = np.diff(first)
        if width in index.tiny:
            values, whose, known = index.tiny[width]
            hit = np.flatnonzero(known[grams >> np.uint64(48)])
            text, found = _matches(values, whose, grams[hit], np.searchsorted(first, hit, side="right") - 1)
            pairs.append(np.unique(text * np.int64(len(index.ids)) + found))
        if not len(grams) or not tiers:
            continue
        at, text, counts = _starts(counts, LEAST_BLOCK)
        low = np.empty((HASHES, len(at)), np.uint32)
        with np.errstate(over="ignore"):
            for k, f in enumerate(_FACTORS):
                low[k] = np.minimum.reduceat(grams * f, at) >> np.uint64(32)
        block = LEAST_BLOCK
        while True:
            if block in tiers:
                tier = tiers[block]
                window = low.copy()
                beside = np.flatnonzero(text[1:] == text[:-1])
                window[:, beside] = np.minimum(low[:, beside], low[:, beside + 1])
                for k in range(HASHES):
                    hit = np.flatnonzero(tier.known[k][_slot(window[k])])
                    if not len(hit):
                        continue
                    where, found = _matches(tier.values[k], tier.items[k], window[k][hit], text[hit])
                    pairs.append(np.unique(where * np.int64(len(index.ids)) + found))
            if block >= max(tiers):
                break
            at, text, counts = _starts(counts, 2)
            low = np.minimum.reduceat(low, at, axis=1)
            block *= 2
    both = np.unique(np.concatenate(pairs))
    return both // max(len(index.ids), 1), both % max(len(index.ids), 1)


def contained(index: Index, texts, threshold: float = THRESHOLD) -> list[tuple[int, int, int]]:
    """(text, item, shared shingles) of all items of which the threshold's share of shingles is in a text."""
    words = textkit.Words(*textkit.utf8(texts))
    found, last, sets = [], -1, {}
    for t, i in zip(*(x.tolist() for x in propose(index, words)), strict=True):
        if t != last:
            last, sets = t, {}
        item, width = index.grams[i], index.width[i]
        if width not in sets:
            own = words.hash[words.first[t] : words.first[t + 1]]
            sets[width] = np.unique(_grams(own, width))
        shared = int(np.isin(item, sets[width], assume_unique=True).sum())
        if shared >= threshold * len(item) - 1e-9:
            found.append((t, i, shared))
    return found


def _grams(hashes: np.ndarray, width: int) -> np.ndarray:
    one = object.__new__(textkit.Words)
    one.hash, one.first = hashes, np.array([0, len(hashes)])
    return textkit.shingles(one, width, short=False)[0]


def _distinct(items: DataFrame, key: str, text: str) -> DataFrame:
    """(rep, text): each different text once, with its least key."""
    return items.select(F.col(key).alias("id"), F.col(text).alias("text")).where(F.col("text").isNotNull()).groupBy("text").agg(F.min("id").alias("rep"))


def indexes(items: DataFrame, key: str = "item_id", text: str = "text", part_bytes: int = PART_BYTES) -> Iterator[Index]:
    """The different items' indexes, one after the other, each of about part_bytes of text at most."""
    rows = _distinct(items, key, text)
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = -(-total // part_bytes) or 1
    for k in range(parts):
        got = rows.where(F.pmod(F.xxhash64("text"), F.lit(parts)) == k).orderBy("rep", "text").toArrow()
        yield build(got["rep"].to_pylist(), got["text"].combine_chunks())


def _passes(docs: DataFrame, items: DataFrame, item_key: str, item_text: str, part_bytes: int, one, chain: bool) -> list[DataFrame]:
    """one(docs, broadcast index) for each part of the items. With more parts than one each result is a written table, so that one index at a time is
    held; chain: a pass goes over what the one before left."""
    out: list[DataFrame] = []
    found = indexes(items, item_key, item_text, part_bytes)
    index = next(found)
    while index is not None:
        after = next(found, None)
        shared = docs.sparkSession.sparkContext.broadcast(index)
        made = one(docs, shared)
        if after is not None or out:
            made = scratch.table(made, "items-part", *(out if chain else ()))
            shared.unpersist()
        out = [made] if chain else [*out, made]
        docs, index = made if chain else docs, after
    return out


def search(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text", threshold: float = THRESHOLD, part_bytes: int = PART_BYTES) -> DataFrame:
    """(doc_id, item_id, n_item, n_shared, containment) of every item that is in a document; items of equal texts are each found. item_id has the items' own type."""
    scratch.small_batches(docs.sparkSession)
    kind = dict(items.dtypes)[item_key]
    arrow = to_arrow_type(items.schema[item_key].dataType)

    def one(docs: DataFrame, shared) -> DataFrame:
        def rows(batches):
            own = shared.value
            for batch in batches:
                ids = batch.column(0).to_pylist()
                for a, b in textkit.pieces_of(batch.column(1), textkit.PIECE):
                    if found := contained(own, batch.column(1).slice(a, b - a), threshold):
                        t, i, n = zip(*found, strict=True)
                        sizes = [len(own.grams[k]) for k in i]
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([ids[a + k] for k in t], pa.int64()), pa.array([own.ids[k] for k in i], arrow), pa.array(sizes, pa.int64()), pa.array(n, pa.int64()), pa.array([x / y for x, y in zip(n, sizes, strict=True)], pa.float64())],
                            ["doc_id", "item_id", "n_item", "n_shared", "containment"],
                        )

        return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(textkit.lean(rows), f"doc_id long, item_id {kind}, n_item long, n_shared long, containment double")

    found, *more = _passes(docs, items, item_key, item_text, part_bytes, one, chain=False)
    for part in more:
        found = found.unionByName(part)
    same = items.select(F.col(item_key).alias("other"), F.col(item_text).alias("text")).join(_distinct(items, item_key, item_text), "text").where(~F.col("other").eqNullSafe(F.col("rep"))).select("rep", "other")
    if same.isEmpty():
        return found
    found = scratch.table(found, "items-found")
    copies = found.join(same, found["item_id"].eqNullSafe(same["rep"])).select("doc_id", F.col("other").alias("item_id"), "n_item", "n_shared", "containment")
    return found.unionByName(copies)


def decontaminate(docs: DataFrame, items: DataFrame, text: str = "text", item_key: str = "item_id", item_text: str = "text", threshold: float = THRESHOLD, part_bytes: int = PART_BYTES) -> DataFrame:
    """docs without the rows in which an item is; whole rows, nothing is shuffled."""
    scratch.small_batches(docs.sparkSession)
    at = docs.columns.index(text)

    def one(docs: DataFrame, shared) -> DataFrame:
        def rows(batches):
            for batch in batches:
                for a, b in textkit.pieces_of(batch.column(at), textkit.PIECE):
                    keep = np.ones(b - a, bool)
                    keep[[t for t, _, _ in contained(shared.value, batch.column(at).slice(a, b - a), threshold)]] = False
                    yield batch.slice(a, b - a).filter(pa.array(keep))

        return docs.mapInArrow(textkit.lean(rows), docs.schema)

    return _passes(docs, items, item_key, item_text, part_bytes, one, chain=True)[0]


def op3(spark, sf_dir: str) -> DataFrame:
    return search(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))

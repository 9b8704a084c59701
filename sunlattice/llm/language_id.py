"""Language identification by partial matching: a byte context tree of variable order for each language.

A byte's cost under a language is its exact code length in bits: the longest context that the language has seen predicts it, or
escapes (method C: distinct followers / (followers + distinct followers)) to the next shorter one, down to a flat order over SYMBOLS. A text goes to
the language with the least total, whatever number of languages there is; the statistics are frozen after training. Small and capital ASCII letters count alike, digits count as
one symbol, spaces and line ends as another, other ASCII as a third. The trees of all languages are laid out as one array, so scoring a batch
is two look-ups a byte.

Trained on a bounded sample: about SAMPLE_BYTES bytes of each language, whole documents taken by a hash of the id and
text, one at least. Null texts and texts without a
letter are `und` with score 0; null languages teach nothing; without any labelled row everything is `und`; repeated rows score alike; an empty table
gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import scratch, textkit
from .quality_classifier import held_out

SAMPLE_BYTES = 6_000_000
ORDER = 3
#: A context that a language has seen less often predicts nothing of its own; the bound on contexts for each language.
LEAST = 8
MOST_CONTEXTS = 6_000
#: Trees of so many languages are in memory at once; texts are scored against the others in further passes.
AT_ONCE = 8

# symbols: 0 space (also before a text), 1 digit, 2 other ASCII, 3 to 28 letters, 29 to 156 bytes of 0x80 and more
SYMBOLS = 157
_SYMBOL = np.full(256, 2, np.int64)
_SYMBOL[[0x20, *range(9, 14)]] = 0
_SYMBOL[48:58] = 1
_SYMBOL[65:91] = _SYMBOL[97:123] = np.arange(3, 29)
_SYMBOL[128:] = np.arange(29, 157)


def symbols(data: np.ndarray, offsets: np.ndarray):
    """In runs of bytes a to b: (a, b, each byte's symbol, the number of its context of ORDER symbols); a text starts after spaces."""
    starts = offsets[:-1][np.diff(offsets) > 0]
    for a in range(0, len(data), textkit.PIECE):
        b, low = min(a + textkit.PIECE, len(data)), max(0, a - ORDER)
        own = _SYMBOL[data[low:b]]
        begins = starts[np.searchsorted(starts, low) : np.searchsorted(starts, b)] - low
        at = np.zeros(len(own), np.int64)
        for back in range(1, ORDER + 1):
            past = np.zeros(len(own), np.int64)
            past[back:] = own[:-back]
            for k in range(back):
                past[np.minimum(begins + k, len(own) - 1)[begins + k < len(own)]] = 0
            at += past * SYMBOLS ** (back - 1)
        yield a, b, own[a - low :], at[a - low :]


def _counts(batches):
    """(lang, code, n): how often each context and symbol stand in a language's texts."""
    total: dict[str, tuple[np.ndarray, np.ndarray]] = {}

    def add(lang, codes, n):
        if lang in total:
            codes, n = np.concatenate([total[lang][0], codes]), np.concatenate([total[lang][1], n])
            codes, where = np.unique(codes, return_inverse=True)
            n = np.bincount(where, n, len(codes)).astype(np.int64)
        total[lang] = codes, n

    for batch in batches:
        langs = batch.column(0).to_pylist()
        for lang in set(langs):
            texts = batch.column(1).take(pa.array([i for i, x in enumerate(langs) if x == lang]))
            for a, b in textkit.pieces_of(texts):
                for _, _, own, at in symbols(*textkit.utf8(texts[a:b])):
                    add(lang, *np.unique(at * SYMBOLS + own, return_counts=True))
    for lang, (codes, n) in total.items():
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(codes), pa.string()), pa.array(codes), pa.array(n)], ["lang", "code", "n"])


@dataclass
class Trees:
    """node: context of ORDER symbols -> row; bits: (row, symbol, language) code lengths. more: what grow() takes for each further part of the languages."""

    languages: list[str]
    node: np.ndarray
    bits: np.ndarray
    more: tuple[tuple, ...] = ()


def grow(languages: list[str], codes: list[np.ndarray], counts: list[np.ndarray]) -> Trees:
    """The trees of languages from their counts of (context, symbol)."""
    kept: list[dict[tuple[int, int], np.ndarray]] = []
    for code, n in zip(codes, counts, strict=True):
        tables: dict[tuple[int, int], np.ndarray] = {}
        for order in range(ORDER + 1):
            context, symbol = code // SYMBOLS % SYMBOLS**order, code % SYMBOLS
            key, where = np.unique(context * SYMBOLS + symbol, return_inverse=True)
            times = np.bincount(where, n, len(key))
            context, first, inverse = np.unique(key // SYMBOLS, return_index=True, return_inverse=True)
            seen = np.bincount(inverse, times)
            enough = np.flatnonzero(seen >= (LEAST if order else 0))
            enough = enough[np.argsort(-seen[enough], kind="stable")][:MOST_CONTEXTS]
            stop = np.append(first[1:], len(key))
            for i in enough.tolist():
                row = np.zeros(SYMBOLS)
                row[key[first[i] : stop[i]] % SYMBOLS] = times[first[i] : stop[i]]
                tables[order, int(context[i])] = row
        kept.append(tables)
    # a row for every context that any language has, ordered by order: a shorter context's bits are there before the longer one's
    contexts = sorted(set().union(*kept) | {(0, 0)})
    place = {c: i for i, c in enumerate(contexts)}
    bits = np.zeros((len(contexts), SYMBOLS, len(languages)), np.float32)
    for i, (order, context) in enumerate(contexts):
        parent = bits[place[order - 1, context % SYMBOLS ** (order - 1)]] if order and (order - 1, context % SYMBOLS ** (order - 1)) in place else None
        if order and parent is None:  # the shorter context was cut by MOST_CONTEXTS: its own shorter ones hold
            back = order - 1
            while (back, context % SYMBOLS**back) not in place:
                back -= 1
            parent = bits[place[back, context % SYMBOLS**back]]
        for k, tables in enumerate(kept):
            below = parent[:, k] if parent is not None else np.full(SYMBOLS, np.log2(SYMBOLS))
            row = tables.get((order, context))
            if row is None:
                bits[i, :, k] = below
                continue
            distinct, total = (row > 0).sum(), row.sum()
            bits[i, :, k] = np.where(row > 0, -np.log2(np.maximum(row, 1) / (total + distinct)), -np.log2(distinct / (total + distinct)) + below)
    node = np.zeros(SYMBOLS**ORDER, np.int32)
    for (order, context), i in place.items():  # longer contexts come later and overwrite
        node.reshape(-1, SYMBOLS**order)[:, context] = i
    return Trees(languages, node, bits)


def code_lengths(trees: Trees, texts) -> np.ndarray:
    """(texts, languages): total bits of each text."""
    data, offsets = textkit.utf8(texts)
    out = np.zeros((len(offsets) - 1, len(trees.languages)))
    flat = trees.bits.reshape(-1, len(trees.languages))
    for a, b, own, at in symbols(data, offsets):
        total = np.zeros((b - a + 1, len(trees.languages)))
        np.cumsum(flat[trees.node[at].astype(np.int64) * SYMBOLS + own], axis=0, dtype=np.float64, out=total[1:])
        inside = np.clip(offsets - a, 0, b - a)
        out += total[inside[1:]] - total[inside[:-1]]
    return out


def train(docs: DataFrame, allowed: Column, key: str = "doc_id", text: str = "text", lang: str = "lang", sample_bytes: int = SAMPLE_BYTES) -> Trees:
    """Trees of all languages of rows for which `allowed` (of doc_id) holds."""
    rows = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"), F.col(lang).alias("lang")).where(F.col("lang").isNotNull() & F.col("text").isNotNull() & allowed)
    whole = 1 << 30
    place = F.pmod(F.xxhash64("doc_id", "text"), F.lit(whole))
    sizes = {r["lang"]: (r["n"], r["least"]) for r in rows.groupBy("lang").agg(F.sum(F.octet_length("text")).alias("n"), F.min(place).alias("least")).collect()}
    if not sizes:
        return Trees([], np.zeros(SYMBOLS**ORDER, np.int32), np.zeros((1, SYMBOLS, 0), np.float32))
    # the document of the least hash is always taken: a language of few long documents has one
    large = {k: max(int(whole * sample_bytes / n), least + 1) for k, (n, least) in sizes.items() if n > sample_bytes}
    chosen = rows
    if large:
        share = F.map_from_arrays(F.array(*map(F.lit, large)), F.array(*map(F.lit, large.values())))
        chosen = rows.where(place < F.coalesce(F.element_at(share, F.col("lang")), F.lit(whole)))
    counts = chosen.select("lang", "text").mapInArrow(textkit.lean(_counts), "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n")).toArrow()
    names, code, n = np.array(counts["lang"].to_pylist(), object), np.asarray(counts["code"]), np.asarray(counts["n"])
    languages = sorted(set(names.tolist()))
    parts = [languages[i : i + AT_ONCE] for i in range(0, len(languages), AT_ONCE)]
    first, *more = [(part, [code[names == x] for x in part], [n[names == x] for x in part]) for part in parts]
    return replace(grow(*first), more=tuple(more))


def _has_letter(texts, lengths: np.ndarray) -> np.ndarray:
    data, offsets = textkit.utf8(texts)
    ascii_letter = np.concatenate([[0], np.cumsum(((data | 32) >= 97) & ((data | 32) <= 122))])
    found = ascii_letter[offsets[1:]] > ascii_letter[offsets[:-1]]
    for i in np.flatnonzero(~found & (lengths > 0)).tolist():
        found[i] = any(c.isalpha() for c in texts[i].as_py())
    return found


def predict(docs: DataFrame, trees: Trees, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score, bits_per_byte): score is the language's share of the likelihood, the others' code lengths being the rest.
    Each part of the languages is a pass that keeps the best language so far, its bits and the sum of all likelihoods over its own."""
    scratch.small_batches(docs.sparkSession)
    found = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    for k in range(len(trees.more) + 1):
        found = _pass(found, replace(trees, more=()) if k == 0 else grow(*trees.more[k - 1]), k == 0, k == len(trees.more))
        if k < len(trees.more):
            found = scratch.table(found, "languages")
    return found


def _pass(docs: DataFrame, trees: Trees, first: bool, last: bool) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(trees)

    def rows(batches):
        own = shared.value
        names = np.array([*own.languages, "und"], object)
        for batch in batches:
            for a, b in textkit.pieces_of(batch.column(1)):
                part = batch.slice(a, b - a)
                texts = part.column(1)
                if own.languages:
                    bits = code_lengths(own, texts)
                    best = bits.argmin(axis=1)
                    least = bits[np.arange(len(bits)), best]
                    total = np.exp2(np.maximum(least[:, None] - bits, -1000)).sum(axis=1)
                else:
                    best, least, total = np.zeros(len(texts), np.int64), np.zeros(len(texts)), np.ones(len(texts))
                name = names[best]
                if not first:
                    before, sum_before = part.column(3).to_numpy(), part.column(4).to_numpy()
                    low = np.minimum(least, before)
                    total = total * np.exp2(np.maximum(low - least, -1000)) + sum_before * np.exp2(np.maximum(low - before, -1000))
                    name, least = np.where(least < before, name, np.array(part.column(2).to_pylist(), object)), low
                if last:
                    sizes = np.diff(textkit.utf8(texts)[1])
                    known = _has_letter(texts, sizes) & bool(own.languages)
                    yield pa.RecordBatch.from_arrays(
                        [part.column(0), pa.array(np.where(known, name, "und").tolist(), pa.string()), pa.array(np.where(known, 1 / total, 0.0)), pa.array(np.where(known, least / np.maximum(sizes, 1), 0.0))],
                        ["doc_id", "lang_pred", "score", "bits_per_byte"],
                    )
                else:
                    yield pa.RecordBatch.from_arrays([part.column(0), texts, pa.array(name.tolist(), pa.string()), pa.array(least), pa.array(total)], ["doc_id", "text", "name", "least", "total"])

    return docs.mapInArrow(textkit.lean(rows), "doc_id long, lang_pred string, score double, bits_per_byte double" if last else "doc_id long, text string, name string, least double, total double")


def op7(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    found = predict(docs, train(docs, ~held_out(4, 2)))
    return found.select("doc_id", held_out(4, 2).alias("held_out"), "lang_pred", "score", "bits_per_byte")

"""Recall of op1's links against brute force: python -m tests.llm.measure_recall DIR...

Queries are the documents whose id is divisible by 20; each is compared with all documents through an index of every shingle. Prints, for each
folder, the links (other documents of a Jaccard of 0.8 or more) that the operator counted of those that there are.
"""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
import pyarrow.dataset as ds
from pyspark.sql import SparkSession

from sunlattice.llm import ngram_join, textkit

EVERY = 20


def links(ids: np.ndarray, texts: pa.Array, every: int = EVERY) -> dict[int, int]:
    """The other documents of a Jaccard of THRESHOLD or more, of each document whose id is divisible by every."""
    parts = [ngram_join.shingle_sets(texts.slice(a, b - a)) for a, b in textkit.pieces_of(texts)]
    sizes = np.concatenate([np.diff(first) for _, first in parts])
    grams = np.concatenate([g for g, _ in parts])
    first = np.concatenate([[0], np.cumsum(sizes)])
    order = np.argsort(grams, kind="stable")
    ranked, owner = grams[order], np.repeat(np.arange(len(sizes)), sizes)[order]
    out = {}
    for q in np.flatnonzero(ids % every == 0).tolist():
        own = grams[first[q] : first[q + 1]]
        low, high = np.searchsorted(ranked, own), np.searchsorted(ranked, own, side="right")
        shared = np.bincount(np.concatenate([np.zeros(0, np.int64), *[owner[a:b] for a, b in zip(low.tolist(), high.tolist(), strict=True)]]), minlength=len(sizes))
        like = (shared > 0) & (shared >= (ngram_join.THRESHOLD - 1e-12) * (sizes + sizes[q] - shared))
        out[int(ids[q])] = int(like.sum()) - bool(sizes[q])
    return out


def main() -> None:
    spark = SparkSession.builder.master("local[8]").config("spark.driver.memory", "8g").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    for folder in sys.argv[1:]:
        docs = ds.dataset(f"{folder}/documents.parquet").to_table(columns=["doc_id", "text"]).combine_chunks()
        there = links(docs.column("doc_id").to_numpy(), docs.column("text").cast(pa.large_string()).chunk(0))
        rows = ngram_join.op1(spark, folder).where(f"doc_id % {EVERY} = 0").select("doc_id", "n_links").collect()
        found = {r.doc_id: r.n_links for r in rows}
        exact, more = sum(there.values()), sum(max(0, found[k] - n) for k, n in there.items())
        met = sum(min(found[k], n) for k, n in there.items())
        same = sum(found[k] == n for k, n in there.items())
        print(f"{folder}: {len(there)} queries of {docs.num_rows} documents, {met} of {exact} links, {more} too many, {same} queries equal", flush=True)
    spark.stop()


if __name__ == "__main__":
    main()

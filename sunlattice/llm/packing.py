"""Packing of tokenized examples into sequences: vector bin packing by the dot-product heuristic.

A sequence has room for limits of tokens, segments and loss-bearing tokens at once. Of the examples that fit, the one goes in whose demand,
in shares of the limits, has the largest dot product with what is left. Where none fits, the largest one is cut to what is left; an example longer than a
sequence is cut into full ones first. What is left over at a partition's end is cut into sequences whose lengths are powers of two.

Each partition is packed as it is read, so nothing is shuffled and no more than WINDOW examples are held; a sequence's number is its partition's
number times 2^40 plus its place, the same in every attempt of a task over the same split; another split of the files gives other sequences.
Handling: null texts count as empty; null ids pass through; repeated rows are packed each on its own; of equally good examples the first waiting one goes
in; further columns aren't read, whatever their names; a text is encoded whole, CHARS characters at a time; an empty table gives no pieces.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import scratch, textkit

TOKENS = 2048
SEGMENTS = 256
#: Examples that wait for a place at a time, in each task.
WINDOW = 1024
#: Characters that are encoded at a time.
CHARS = 1 << 20
#: What ends a document.
END = 1


# Fixed value: the pattern that byte-level BPE splits words by.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Texts for which both ways must give the same ids before the faster is used.
PROBES = ("It's  a\t\ttest, don't;\n\n x=1_2 \u00e9t\u00e9 \u65e5\u672c \u00b2\u0663 <|endoftext|> ", "\x1c \x85\u3000\u200b a\u0301\u00ad\x00", "a" * 700 + " " * 9)


def _ranks(path: str) -> dict[bytes, int] | None:
    """The vocabulary of a tokenizer's file as ranks, if it is a plain byte-level BPE whose ids are in the order of its merges."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model, before = spec["model"], spec.get("pre_tokenizer") or {}
    plain = model.get("type") == "BPE" and before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space")
    if not plain or spec.get("normalizer") or model.get("dropout") or model.get("byte_fallback") or model.get("continuing_subword_prefix") or model.get("end_of_word_suffix") or model.get("ignore_merges"):
        return None
    # byte-level BPE writes a byte as the character of its number if that is printed, and the others, in order, as those from 256 on
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte = {chr(c): c for c in shown} | {chr(256 + i): c for i, c in enumerate(c for c in range(256) if c not in set(shown))}
    merged = ["".join(m.split(" ") if isinstance(m, str) else m) for m in model["merges"]]
    ids = [model["vocab"][c] for c in byte] + [model["vocab"][m] for m in merged]
    if any(a >= b for a, b in zip(ids[256:], ids[257:], strict=False)) or max(ids[:256]) >= min(ids[256:], default=1 << 60):
        return None
    return {bytes(byte[c] for c in token): i for token, i in zip([*byte, *merged], ids, strict=True)}


class Ids:
    """Ids of texts by a tokenizer's file, special tokens' strings being text like any other. A file of plain byte-level BPE is run by a faster
    encoder from the same merges, if it gives the same ids for PROBES; others are run by the tokenizer itself."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.border, self.fast = re.compile(r"(?<=\S)(?=\s)"), None
        if ranks := _ranks(path):
            fast = tiktoken.Encoding("packing", pat_str=WORDS, mergeable_ranks=ranks, special_tokens={})
            if all(fast.encode_ordinary(x) == self.slow(x).tolist() for x in PROBES):
                self.fast = fast

    def slow(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)

    def __call__(self, text: str) -> np.ndarray:
        if not self.fast:
            return self.slow(text)
        parts, a = [], 0
        while a < len(text):
            # a word never holds a space after another character, so a long text may be cut there
            b = len(text) if len(text) - a <= CHARS else (m.start() if (m := self.border.search(text, a + CHARS)) else len(text))
            parts.append(self.fast.encode_to_numpy(text[a:b], disallowed_special=()))
            a = b
        return parts[0] if len(parts) == 1 else np.concatenate([np.zeros(0, np.uint32), *parts])


_loaded: dict[str, Ids] = {}


def encoder(path: str) -> Ids:
    """Ids(path), loaded once in a process."""
    if path not in _loaded:
        _loaded[path] = Ids(path)
    return _loaded[path]


@dataclass
class Example:
    """Tokens start to start + size of a row, all of it until it is cut; bears: whether each bears loss, None where all do."""

    row: object
    ids: np.ndarray
    total: int
    start: int = 0
    bears: np.ndarray | None = None

    @property
    def size(self) -> int:
        return len(self.ids)

    @property
    def loss(self) -> int:
        return self.size if self.bears is None else int(self.bears.sum())

    def most(self, loss: int) -> int:
        """The most tokens from the first on that bear no more loss than that."""
        return loss if self.bears is None else int(np.searchsorted(np.cumsum(self.bears), loss, side="right"))

    def cut(self, size: int) -> tuple[Example, Example]:
        b = (None, None) if self.bears is None else (self.bears[:size], self.bears[size:])
        return Example(self.row, self.ids[:size], self.total, self.start, b[0]), Example(self.row, self.ids[size:], self.total, self.start + size, b[1])


def pack(examples: Iterable[Example], tokens: int = TOKENS, segments: int = SEGMENTS, loss: int | None = None, window: int = WINDOW, split_rest: bool = True) -> Iterator[list[Example]]:
    """Sequences, as lists of whole or cut examples in order. loss: the most loss-bearing tokens of a sequence (no limit but tokens).
    split_rest: a sequence that can't be filled is cut into some whose lengths are powers of two."""
    limits = np.array([tokens, segments, tokens if loss is None else loss], np.float64)
    if limits.min() < 1:
        raise ValueError("each limit must be 1 at least")
    waiting: list[Example | None] = []
    demand = np.zeros((0, 3))

    def need(x: Example) -> tuple[float, float, float]:
        return (x.size / limits[0], 1 / limits[1], x.loss / limits[2])

    def sequence() -> list[Example]:
        """The next sequence from the waiting ones; it is full unless they run out or the segments do."""
        left, out = np.ones(3), []
        while True:
            fits = (demand <= left + 1e-12).all(axis=1)
            if fits.any():
                k = int(np.where(fits, np.where(fits[:, None], demand, 0) @ left, -1).argmax())
                x, demand[k], waiting[k] = waiting[k], np.inf, None
            else:
                rest = np.rint(left * limits).astype(np.int64)
                k = int(np.where(np.isfinite(demand[:, 0]), demand[:, 0], -1).argmax()) if len(demand) else 0
                size = min(int(rest[0]), waiting[k].most(int(rest[2]))) if len(demand) and rest[1] > 0 and waiting[k] is not None else 0
                if size <= 0:
                    return out
                x, waiting[k] = waiting[k].cut(size)
                demand[k] = need(waiting[k])
            out.append(x)
            left = left - np.array(need(x))

    def powers(done: list[Example]) -> Iterator[list[Example]]:
        """done, in sequences whose lengths are powers of two."""
        rest = sum(x.size for x in done)
        while rest:
            room, out = 1 << (rest.bit_length() - 1), []
            rest -= room
            while room:
                x, after = done[0].cut(min(room, done[0].size))
                done[:1] = [after] if after.size else []
                out.append(x)
                room -= x.size
            yield out

    def drain(least: int) -> Iterator[list[Example]]:
        nonlocal waiting, demand
        waiting = [x for x in waiting if x is not None]
        demand = np.array([need(x) for x in waiting]).reshape(-1, 3)
        alive = len(waiting)
        while alive > least:
            done = sequence()
            alive = int(np.isfinite(demand[:, 0]).sum())
            yield from powers(done) if split_rest and sum(x.size for x in done) < tokens else [done]

    for x in examples:
        while x.size >= tokens:
            size = min(tokens, x.most(int(limits[2])))
            if size < tokens:
                break
            whole, x = x.cut(size)
            yield [whole]
        if x.size:
            waiting.append(x)
            if len(waiting) >= window:
                yield from drain(window // 2)
                waiting = [x for x in waiting if x is not None]
    yield from drain(0)


FIELDS = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, loss_tokens long"


def _table(sequences: Iterable[list[Example]], base: int, ids: bool = False, part: bool = False) -> Iterator[pa.RecordBatch]:
    names = [f.split()[0] for f in FIELDS.split(", ")] + ["ids"] * ids + ["part"] * part
    rows: list[tuple] = []

    def batch() -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True))
        out = [pa.array(c, pa.list_(pa.int64()) if name == "ids" else pa.int64()) for name, c in zip(names, columns, strict=True)]
        rows.clear()
        return pa.RecordBatch.from_arrays(out, names)

    for number, pieces in enumerate(sequences):
        at = 0
        for x in pieces:
            row, *own_part = x.row if part else (x.row,)
            rows.append((row, x.start, x.size, zlib.crc32(x.ids.astype("<u4").tobytes()), x.total, base + number, at, x.loss, *([x.ids] if ids else []), *own_part))
            at += x.size
        if len(rows) >= 4096:
            yield batch()
    if rows:
        yield batch()


def pack_documents(docs: DataFrame, vocabulary: str, key: str = "doc_id", text: str = "text", tokens: int = TOKENS, segments: int = SEGMENTS, loss: int | None = None, end: int = END, with_ids: bool = False) -> DataFrame:
    """The pieces of all documents: FIELDS, and ids (the piece's ids) if asked for. vocabulary: the tokenizer's file, in the same place on every machine.
    Every id bears loss. Each id of a document, and the one that ends it, lies in one piece; offsets have no gaps."""

    scratch.small_batches(docs.sparkSession)

    def rows(batches):
        encode = encoder(vocabulary)

        def examples():
            for batch in batches:
                for row, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                    ids = encode(text.as_py() or "")
                    yield Example(row, np.append(ids, np.uint32(end)), len(ids) + 1)

        yield from _table(pack(examples(), tokens, segments, loss), TaskContext.get().partitionId() << 40, with_ids)

    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(textkit.lean(rows), FIELDS + ", ids array<long>" * with_ids)


#: Turns of an example of pack_conversations(); a longer conversation is several examples.
TURNS = 64
#: Limits of instruction data: segments, and loss-bearing tokens, of a sequence.
EXAMPLES, LOSS = 16, 1024


def examples_of(turns: DataFrame) -> DataFrame:
    """(doc_id, part, turns): the turns of a conversation (conv_id, turn, role, text) in examples of about TURNS, in order; part numbers them.

    A conversation may hold any share of the rows, and a turn may stand any number of times or have no number: rows go to parts by their turn's number,
    and a part of more than 2 x TURNS rows is dealt by a hash of its rows, equal ones being told apart by their copy's number. So no list outgrows that by much."""
    whole = turns.select(F.col("conv_id").cast("long").alias("doc_id"), "turn", "role", "text").groupBy("doc_id", "turn", "role", "text").agg(F.count(F.lit(1)).alias("_n"))
    each = whole.withColumn("_c", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_n")))).drop("_n").withColumn("_p", F.coalesce(F.floor(F.col("turn") / TURNS), F.lit(-1)).cast("long"))
    crowded = whole.groupBy("doc_id", F.coalesce(F.floor(F.col("turn") / TURNS), F.lit(-1)).cast("long").alias("_p")).agg(F.sum("_n").alias("_k")).where(F.col("_k") > 2 * TURNS)
    same = each["doc_id"].eqNullSafe(crowded["doc_id"]) & (each["_p"] == crowded["_p"])
    dealt = each.join(crowded, same, "left").select(each["doc_id"], "turn", "role", "text", "_c", each["_p"], F.coalesce(F.pmod(F.xxhash64("turn", "role", "text", "_c"), F.ceil(F.col("_k") / TURNS)), F.lit(0)).alias("_s"))
    made = dealt.groupBy("doc_id", "_p", "_s").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text", "_c"))).alias("turns"))
    return made.select("doc_id", (F.col("_p") * 4294967296 + F.col("_s")).cast("long").alias("part"), "turns")


def pack_conversations(turns: DataFrame, vocabulary: str, tokens: int = TOKENS, segments: int = EXAMPLES, loss: int | None = LOSS, trains: str = "assistant", end: int = END) -> DataFrame:
    """The pieces of instruction data: FIELDS and part. An example is one of examples_of(), each turn ended by `end`; only the turns of the role `trains` bear loss.
    A sequence that a limit keeps from being full stays as it is, to be padded. Sequence numbers hold within one result; another split of the files gives others."""
    scratch.small_batches(turns.sparkSession)
    whole = examples_of(turns)

    def rows(batches):
        encode = encoder(vocabulary)

        def examples():
            for batch in batches:
                for row, k, said in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                    parts = [(np.append(encode(t["text"] or ""), np.uint32(end)), t["role"] == trains) for t in said.as_py()]
                    ids = np.concatenate([p for p, _ in parts])
                    yield Example((row, k), ids, len(ids), 0, np.repeat([b for _, b in parts], [len(p) for p, _ in parts]))

        yield from _table(pack(examples(), tokens, segments, loss, split_rest=False), TaskContext.get().partitionId() << 40, part=True)

    return whole.mapInArrow(textkit.lean(rows), FIELDS + ", part long")


def packing_conversations(spark, sf_dir: str) -> DataFrame:
    """All conversations as instruction data, under limits of tokens, segments and loss-bearing tokens."""
    return pack_conversations(spark.read.parquet(f"{sf_dir}/conversations.parquet"), default_vocabulary())


def default_vocabulary() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.json"))


def op10(spark, sf_dir: str) -> DataFrame:
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), default_vocabulary())

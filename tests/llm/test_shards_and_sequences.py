"""Shards, packing and the pipeline."""

import os
import random
import zlib

import numpy as np
import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

import corpus_pipeline
from sunlattice.llm import packing, pii, scratch, sharding
from tests.llm.helpers import CLASH, DATA, ODD, clashing, docs, shingles
from tests.llm.test_documents import brute_contained, brute_groups, measured

SMALL = f"{DATA}/sf0.001"
VOCABULARY = packing.default_vocabulary()


def whole(df):
    return sorted(map(repr, df.collect()))


def test_shards_round_trip(spark):
    store = sharding.ShardStore(spark, scratch.path(spark, "t"), target_bytes=60_000, base_bytes=2_000, fanout=3)
    arrivals = [clashing(docs(spark, [(i, f"text {i} " * (1 + i % 40)) for i in range(k * 90, k * 90 + 90)] + ODD)).repartition(3) for k in range(4)]
    for k, df in enumerate(arrivals):
        store.append(df, f"a{k}")
    assert store.append(arrivals[0], "a0").version == 4  # a batch that is there
    store.append(arrivals[0].limit(0), "none")
    wanted = sorted(x for df in arrivals for x in whole(df))
    assert whole(store.read()) == wanted
    before = store.manifest()
    after = store.compact()
    assert whole(store.read()) == wanted and whole(store.read(before.version)) == wanted and len(after.shards) < len(before.shards)
    tiers = [store.tier(s.bytes) for s in after.shards if s.bytes < store.target // 2]
    assert all(tiers.count(t) < 3 for t in tiers) and store.compact().version == after.version
    assert store.vacuum(keep=1) > 0 and whole(store.read()) == wanted and sum(s.rows for s in after.shards) == len(wanted)


def test_two_writers(spark):
    store = sharding.ShardStore(spark, scratch.path(spark, "t"))
    first = store.append(docs(spark, [(1, "a")]))
    lost = sharding.Manifest(first.version, first.schema, (), ())
    with pytest.raises(sharding.Conflict):
        store._commit(lost)
    assert store.read().count() == 1 and store.manifest() == first
    with pytest.raises(ValueError):
        store.append(docs(spark, [(1, "a")]).select("doc_id"))
    empty = sharding.ShardStore(spark, scratch.path(spark, "t"))
    empty.append(docs(spark, ODD).limit(0))
    assert empty.compact().shards == () and empty.read().count() == 0


def test_manifests_say_what_changed(spark, monkeypatch):
    """Every version can be read, by the writer and by another reader; only each fourth manifest is whole; what a kept version rests on isn't vacuumed."""
    monkeypatch.setattr(sharding, "EVERY", 4)
    at = scratch.path(spark, "t")
    store = sharding.ShardStore(spark, at, 1 << 20, 6, 1)
    wrote = [store.append(docs(spark, [(k, f"text {k}")]).coalesce(1), f"b{k}") for k in range(7)]
    wrote.append(store.compact())
    assert [m.version for m in wrote] == list(range(1, 9)) and len(wrote[-1].shards) < 7
    other = sharding.ShardStore(spark, at, 1 << 20, 6, 1)
    assert [other.manifest(m.version) for m in wrote] == wrote and other.manifest() == wrote[-1]
    assert [v for v in other.versions() if "shards" in other._load(v)] == [1, 5]
    assert all(len(other._load(v)["added"]) == 1 and not other._load(v)["removed"] for v in (2, 3, 4, 6, 7))
    # a writer that doesn't know the version before writes a whole one
    fresh = sharding.ShardStore(spark, at, 1 << 20, 6, 1)
    fresh._commit(sharding.Manifest(9, wrote[-1].schema, wrote[-1].shards, wrote[-1].batches))
    assert "shards" in other._load(9) and other.manifest().shards == wrote[-1].shards
    assert store.vacuum(keep=2) == 7 - len([s for s in wrote[6].shards if s in wrote[7].shards])
    assert store.versions() == [5, 6, 7, 8, 9] and sorted(r.doc_id for r in store.read(8).collect()) == list(range(7))
    assert store.append(docs(spark, [(0, "x")]), "b0").version == 9


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="no tables")
def test_shard_query_reads_back_every_document(spark):
    texts = {r["doc_id"]: r["text"] or "" for r in pq.read_table(f"{SMALL}/documents.parquet", columns=["doc_id", "text"]).to_pylist()}
    got = sharding.op6(spark, SMALL).collect()
    assert {r.doc_id: r.text_crc32 for r in got} == {i: zlib.crc32(t.encode()) for i, t in texts.items()} and len(got) == len(texts)


@pytest.fixture(scope="module")
def tokenizer():
    t = Tokenizer.from_file(VOCABULARY)
    t.encode_special_tokens = True
    return t


def test_ids_are_the_tokenizers(tokenizer):
    ids = packing.encoder(VOCABULARY)
    r = random.Random(1)
    odd = ["a\x1cb", "x  y\u0085z  q\n\n w", "½ ²x 3²", "don't  we'll\t\t x", "日本 語", "<|endoftext|> x", "", " ", "\n", "a\r\n b", " 　x", "﻿a", "\x1b x\x00y", "_a_ 1_2", "٣ 4"]
    odd += ["".join(f"a{chr(k)} {chr(k)}b" for k in range(j, min(j + 97, 0x110000)) if not 0xD800 <= k < 0xE000) for j in range(0, 0x110000, 97 * 41)]
    odd += ["".join(r.choice("ab '\n1é_-日 ") for _ in range(r.randint(1, 60))) for _ in range(1500)]
    for text in odd:
        assert ids(text).tolist() == tokenizer.encode(text, add_special_tokens=False).ids, repr(text)


def test_long_texts_are_cut_between_words(tokenizer, monkeypatch):
    monkeypatch.setattr(packing, "CHARS", 50)
    text = "some words  and\n\nnumbers 1234 " * 40 + "x" * 500 + " end"
    assert packing.Ids(VOCABULARY)(text).tolist() == tokenizer.encode(text, add_special_tokens=False).ids


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 90), max_size=60), st.integers(8, 40), st.integers(1, 6), st.booleans(), st.integers(4, 12))
def test_packing_keeps_limits_and_ids(sizes, tokens, segments, rest, window):
    r = random.Random(sum(sizes))
    examples, start = [], 0
    for i, n in enumerate(sizes):
        examples.append(packing.Example(i, np.arange(start, start + n, dtype=np.uint32), n, 0, np.array([r.random() < 0.5 for _ in range(n)], bool)))
        start += n
    loss = max(1, tokens // 3)
    seen = []
    for pieces in packing.pack(examples, tokens, segments, loss, window, rest):
        n = sum(p.size for p in pieces)
        assert 0 < n <= tokens and len(pieces) <= segments and sum(p.loss for p in pieces) <= loss
        if rest and n < tokens:
            assert n & (n - 1) == 0
        for p in pieces:
            assert (p.ids == examples[p.row].ids[p.start : p.start + p.size]).all()
            seen += p.ids.tolist()
    assert sorted(seen) == list(range(start))


def test_packed_documents(spark, tokenizer):
    rows = [*ODD, *[(20 + i, f"number {i} and more words " * (i * 7)) for i in range(60)]]
    df = packing.pack_documents(clashing(docs(spark, rows)).repartition(3), VOCABULARY, with_ids=True)
    pieces = df.collect()
    by, sequences = {}, {}
    for p in pieces:
        assert p.length == len(p.ids) and p.ids_crc32 == zlib.crc32(np.array(p.ids, "<u4").tobytes()) and p.loss_tokens == p.length
        by.setdefault(p.doc_id, []).append(p)
        sequences.setdefault(p.sequence_id, []).append(p)
    for i in {i for i, _ in rows}:
        texts = [t or "" for j, t in rows if j == i]
        own = sorted(by[i], key=lambda p: p.start)
        wanted = [[*tokenizer.encode(t, add_special_tokens=False).ids, 1] for t in texts]
        assert sum(p.length for p in own) == sum(map(len, wanted)) and {p.doc_tokens for p in own} == {len(w) for w in wanted}
        if len(texts) == 1:
            assert [k for p in own for k in p.ids] == wanted[0] and [p.start for p in own] == np.cumsum([0, *[p.length for p in own]])[:-1].tolist()
    padding = total = 0
    for s in sequences.values():
        s.sort(key=lambda p: p.offset)
        assert [p.offset for p in s] == np.cumsum([0, *[p.length for p in s]])[:-1].tolist()
        n = sum(p.length for p in s)
        assert n <= 2048 and len(s) <= packing.SEGMENTS
        total += n
        padding += 0 if n & (n - 1) == 0 else 2048 - n
    assert padding <= 0.01 * total
    assert packing.pack_documents(docs(spark, []).limit(0), VOCABULARY).count() == 0


def test_packed_conversations(spark, tokenizer):
    turns = [(c, t, ("system", "user", "assistant")[t % 3], f"turn {t} of {c} " * (t % 9)) for c in range(30) for t in range(1 + c % 7)] + [(77, t, "assistant", None if t == 5 else f"long {t}") for t in range(200)] + [(None, None, None, None)]
    df = packing.pack_conversations(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string"), VOCABULARY, loss=64)
    pieces = df.collect()
    sums = {}
    for p in pieces:
        n, loss = sums.get(p.sequence_id, (0, 0))
        sums[p.sequence_id] = n + p.length, loss + p.loss_tokens
    assert all(n <= 2048 and loss <= 64 for n, loss in sums.values())
    size = lambda t: len(tokenizer.encode(t or "", add_special_tokens=False).ids) + 1
    assert sum(p.length for p in pieces) == sum(size(t) for *_, t in turns) and sum(p.loss_tokens for p in pieces) == sum(size(t) for _, _, role, t in turns if role == "assistant")
    assert {p.part >> 32 for p in pieces if p.doc_id == 77} == {0, 1, 2, 3}


def test_hot_conversations(spark):
    turns = [(1, 0, "user", "same")] * 700 + [(1, None, "assistant", f"t{i}") for i in range(500)] + [(None, 3, "user", "x")] * 300 + [(2, t, "user", "y") for t in range(130)]
    got = packing.examples_of(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")).collect()
    assert sum(len(r.turns) for r in got) == len(turns) and max(len(r.turns) for r in got) <= 4 * packing.TURNS
    assert [len(r.turns) for r in sorted((r for r in got if r.doc_id == 2), key=lambda r: r.part)] == [64, 64, 2]
    assert len({(r.doc_id, r.part) for r in got}) == len(got)


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="no tables")
def test_conversations_pad_less_than_first_fit(spark):
    pieces = packing.packing_conversations(spark, SMALL).collect()
    sequences, whole = {}, {}
    for p in pieces:
        sequences.setdefault(p.sequence_id, []).append(p)
        whole.setdefault((p.doc_id, p.part), []).append(p)
    for s in sequences.values():
        assert sum(p.length for p in s) <= packing.TOKENS and len(s) <= packing.EXAMPLES and sum(p.loss_tokens for p in s) <= packing.LOSS
    # first fit of the same examples, whole, in their order; a longer one fills sequences of its own
    room = []
    for own in whole.values():
        need = np.array([sum(p.length for p in own) % packing.TOKENS, 1, sum(p.loss_tokens for p in own) % packing.LOSS])
        k = next((k for k, r in enumerate(room) if (r >= need).all()), None)
        if k is None:
            room.append(np.array([packing.TOKENS, packing.EXAMPLES, packing.LOSS]))
            k = -1
        room[k] = room[k] - need
    assert len(sequences) <= len(room) + sum(sum(p.length for p in own) // packing.TOKENS + sum(p.loss_tokens for p in own) // packing.LOSS for own in whole.values())


def test_two_writers_at_once(spark, tmp_path):
    """A writer whose version was taken commits the next one; a merge of files that are gone is given up."""
    a, b = (sharding.ShardStore(spark, str(tmp_path), 1 << 20, 2, 1) for _ in range(2))
    commit = a._commit

    def late(new):
        a._commit = commit
        b.append(docs(spark, [(9, "from b")]), "b")
        return commit(new)

    a.append(docs(spark, [(1, "one")]), "one")
    a._commit = late
    m = a.append(docs(spark, [(2, "two")]), "two")
    assert m.version == 3 and sorted(r.doc_id for r in a.read().collect()) == [1, 2, 9]

    def merged(new):
        a._commit = commit
        b.compact()
        return commit(new)

    a._commit = merged
    a.compact()
    assert sorted(r.doc_id for r in a.read().collect()) == [1, 2, 9]


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="no tables")
def test_pipeline_is_brute_force(spark, tokenizer):
    rows = [(r["doc_id"], r["text"]) for r in pq.read_table(f"{SMALL}/documents.parquet", columns=["doc_id", "text"]).to_pylist()]
    items = [(r["item_id"], r["text"]) for r in pq.read_table(f"{SMALL}/benchmark.parquet").to_pylist()]

    def keeps(t):
        n, chars, symbols, dup, repeat = measured(t)
        lines = sum(any(c not in " \t\n\x0b\x0c\r" for c in x) for x in (t or "").split("\n"))
        return n >= 10 and 100 * repeat <= 20 * n and 10 * symbols <= n and 10 * dup <= 3 * lines and 2 * n <= chars <= 40 * n

    rows = [(i, t) for i, t in rows if keeps(t)]
    groups = brute_groups(rows)
    rows = [(i, t) for i, t in rows if groups[i][0] == i]
    bad = {d for d, _ in brute_contained(items, rows)}
    rows = [(i, pii.redact(t, pii.model().spans(t))) for i, t in rows if i not in bad]
    wanted = {i: len(tokenizer.encode(t, add_special_tokens=False).ids) + 1 for i, t in rows}
    got = {}
    for p in corpus_pipeline.run(spark, SMALL).collect():
        got[p.doc_id] = got.get(p.doc_id, 0) + p.length
    assert got == wanted and len(shingles(rows[0][1])) > 0 and corpus_pipeline.ORACLE_SQL is None


def test_pipeline_on_odd_and_empty_tables(spark, tmp_path):
    for k, rows in enumerate((ODD, [])):
        at = str(tmp_path / str(k))
        docs(spark, rows).write.parquet(f"{at}/documents.parquet")
        spark.createDataFrame([(1, "x y z"), (2, None)], "item_id long, text string").limit(2 if rows else 0).write.parquet(f"{at}/benchmark.parquet")
        found = corpus_pipeline.run(spark, at)
        assert found.columns[:2] == ["doc_id", "start"] and (found.count() > 0 or not rows)
        for name, stage in corpus_pipeline.STAGES[:-1]:
            assert stage(spark, clashing(docs(spark, rows)), at).columns[:5] == ["doc_id", "text", "lang", "source", "n_chars"], name
    assert len(CLASH) == len(set(CLASH))

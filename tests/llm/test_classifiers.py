"""Quality, toxicity and language: held-out accuracy, odd rows, and the models against plain versions."""

import math
import os
import re
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from sunlattice.llm import gbdt, language_id, quality_classifier, toxicity
from tests.llm.helpers import DATA, ODD, clashing, docs

SMALL = f"{DATA}/sf0.1"
there = pytest.mark.skipif(not os.path.isdir(SMALL), reason="no tables")


def held(found, column, modulus, rest):
    labels = {r["doc_id"]: r[column] for r in pq.read_table(f"{SMALL}/labels.parquet").to_pylist()}
    out = []
    for r in found.collect():
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % modulus == rest) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5)
        if r.held_out and r.doc_id in labels:
            out.append((r.score, labels[r.doc_id]))
    return np.array([s for s, _ in out]), np.array([y for _, y in out])


@there
def test_quality_on_held_out_documents(spark):
    s, y = held(quality_classifier.op2(spark, SMALL), "quality", 3, 1)
    assert gbdt.auc(s, y) > 0.99 and ((s >= 0.5) == y).mean() > 0.98


@there
def test_toxicity_on_held_out_documents(spark):
    s, y = held(toxicity.op4(spark, SMALL), "toxic", 5, 0)
    assert gbdt.auc(s, y) > 0.95 and ((s >= 0.5) == y).mean() > 0.96


@there
def test_language_on_held_out_documents(spark):
    langs = {r["doc_id"]: r["lang"] for r in pq.read_table(f"{SMALL}/documents.parquet", columns=["doc_id", "lang"]).to_pylist()}
    rows = [r for r in language_id.op7(spark, SMALL).collect() if r.held_out]
    assert len(rows) > 2000 and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    assert np.mean([r.lang_pred == langs[r.doc_id] for r in rows]) > 0.995


def test_trees_find_a_rule_and_ties():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(3000, 5))
    y = ((x[:, 0] > 0.3) ^ (x[:, 3] < -0.2)).astype(float)
    model = gbdt.fit(x[:2000], y[:2000], trees=40, depth=3)
    assert gbdt.auc(model.margin(x[2000:]), y[2000:]) > 0.98
    # walked one row and tree at a time
    for row, margin in zip(x[:50], model.margin(x[:50]), strict=True):
        total = model.start
        for t in range(len(model.feature)):
            k = 0
            for _ in range(3):
                k = 2 * k + 1 + (row[model.feature[t, k]] > model.threshold[t, k])
            total += model.leaf[t, k - 7]
        assert total == pytest.approx(margin)
    assert len(set(gbdt.fit(np.ones((9, 2)), np.ones(9)).probability(np.ones((3, 2))))) == 1
    assert gbdt.fit(np.zeros((0, 2)), np.zeros(0)).probability(np.zeros((2, 2))).tolist() == [0.5, 0.5]
    assert gbdt.auc(np.array([1.0, 1.0, 0.0]), np.array([1, 0, 0])) == 0.75


def exhaustive(x, y, p, l2=1.0, least=1.0):
    """(gain, feature, cut) of the best split of all rows: every feature and every value."""
    g, h = y - p, p * (1 - p)
    best = (1e-9, None, None)
    for j in range(x.shape[1]):
        for cut in sorted(set(x[:, j].tolist()))[:-1]:
            left = x[:, j] <= cut
            hl, hr = h[left].sum(), h[~left].sum()
            if hl >= least and hr >= least:
                gain = g[left].sum() ** 2 / (hl + l2) + g[~left].sum() ** 2 / (hr + l2) - g.sum() ** 2 / (h.sum() + l2)
                if gain > best[0] + 1e-9:
                    best = gain, j, cut
    return best


def test_splits_are_the_best_of_all():
    rng = np.random.default_rng(8)
    for k in range(6):
        x = rng.integers(0, 12, (400, 4)).astype(float)
        y = ((x[:, k % 4] > 5) ^ (rng.random(400) < 0.2)).astype(float)
        tree = gbdt.fit(x, y, trees=1, depth=2)
        p = np.full(400, (y.sum() + 0.5) / 401)
        rows = [np.ones(400, bool)]
        _, j, cut = exhaustive(x, y, p)
        assert tree.feature[0, 0] == j and ((x[:, j] > tree.threshold[0, 0]) == (x[:, j] > cut)).all()
        rows = [x[:, j] <= cut, x[:, j] > cut]
        for node, own in enumerate(rows):
            gain, j2, cut2 = exhaustive(x[own], y[own], p[own])
            if j2 is not None:
                f, t = tree.feature[0, 1 + node], tree.threshold[0, 1 + node]
                left = x[own][:, f] <= t
                g, h = (y - p)[own], (p * (1 - p))[own]
                found = g[left].sum() ** 2 / (h[left].sum() + 1) + g[~left].sum() ** 2 / (h[~left].sum() + 1) - g.sum() ** 2 / (h.sum() + 1)
                assert found == pytest.approx(gain)


def test_classifiers_keep_apart_from_clashing_columns(spark):
    rows = [*ODD, *((20 + i, f"word{i} " * 30) for i in range(20))]
    labels = spark.createDataFrame([(i, i % 2) for i in range(4, 30)], "doc_id long, y int")
    plain, extra = docs(spark, rows), clashing(docs(spark, rows))
    for d in (plain, extra):
        stats = quality_classifier.table(d)
        q = sorted((r.doc_id or 0, round(r.score, 9)) for r in quality_classifier.score(stats, quality_classifier.fit(stats, labels, F.lit(True))).collect())
        t = sorted((r.doc_id or 0, round(r.score, 6)) for r in toxicity.score(d, toxicity.train(d, labels, F.lit(True))).collect())
        l = sorted((r.doc_id or 0, r.lang_pred, round(r.score, 6)) for r in language_id.predict(d, language_id.train(d, F.lit(True))).collect())
        if d is plain:
            first = q, t, l
    assert first == (q, t, l)


def test_quality_odd_rows(spark):
    stats = quality_classifier.table(docs(spark, ODD))
    labels = spark.createDataFrame([(5, 1), (6, 0), (6, 0), (None, 1), (7, None)], "doc_id long, y int")
    model = quality_classifier.fit(stats, labels, F.lit(True))
    got = quality_classifier.score(stats, model).collect()
    assert sorted((r.doc_id or 0) for r in got) == sorted((i or 0) for i, _ in ODD) and all(0 <= r.score <= 1 for r in got)
    assert len({r.score for r in got if r.doc_id == 6}) == 1 and len({r.score for r in got if r.doc_id in (1, 2)}) == 1
    empty = quality_classifier.table(docs(spark, ODD).limit(0))
    assert quality_classifier.score(empty, quality_classifier.fit(empty, labels.limit(0), F.lit(True))).count() == 0


def test_statistics_of_long_text_in_pieces(monkeypatch):
    texts = pa.array(["Ab, c!\n" * 3000, "", None, "$# " * 9])
    whole = quality_classifier.statistics(texts)
    monkeypatch.setattr(quality_classifier.textkit, "PIECE", 1000)
    assert np.allclose(whole, quality_classifier.statistics(texts)) and (whole[1] == whole[2]).all()


def test_noisy_or_and_places():
    good, bad = "a calm day by the sea. we walked home.", "a calm day. you are a vermin fool! we walked home."
    texts = pa.array([good, bad] * 40 + ["vermin", ""])
    model = toxicity.fit(texts, np.array([0, 1] * 40 + [1, 0]))
    found = toxicity.sentences(pa.array([bad, good, None, ""]))
    chance = 1 / (1 + np.exp(-model.margin(found)))
    plain = [1 - math.prod(1 - chance[a:b]) for a, b in zip(found.first, found.first[1:], strict=False)]
    assert model.chance(found) == pytest.approx(plain) and plain[0] > 0.5 > plain[1] and plain[2:] == [0, 0]
    places = toxicity.locate(model, bad)
    assert [bad[a:b] for a, b, _ in places] == ["you are a vermin fool"] and not toxicity.locate(model, good) and not toxicity.locate(model, None)


def plain_features(text):
    """{(kind, bytes)} by sentence: words, their first bytes, and pairs of neighbours."""
    out = []
    for part in re.split(r"[.!?\n]", text.lower()):
        w = re.findall(r"[a-z0-9]+", part)
        if w:
            out.append({("w", x) for x in w} | {(k, x[:k]) for x in w for k in toxicity.STEMS if len(x) >= k} | {("p", x, y) for x, y in zip(w, w[1:], strict=False)})
    return out


def test_chosen_features_are_those_of_the_chi_square():
    """Words and pairs for and against, against sets by hand: a bucket is chosen if one of its features has the chi-square."""
    rng = np.random.default_rng(3)
    vocabulary = [f"{a}{b}" for a in ("kal", "mur", "tes", "vin") for b in ("a", "o", "ira", "enta")]
    texts, y = [], []
    for k in range(300):
        w = rng.choice(vocabulary, 12).tolist()
        toxic = k % 3 == 0
        if toxic:
            w[4:6] = ["vermin", "fool"]
        elif rng.random() < 0.9:
            w[7] = "please"
        texts.append(" ".join(w[:6]) + ". " + " ".join(w[6:]))
        y.append(int(toxic))
    chosen = set(toxicity._select(pa.array(texts), np.array(y)).tolist())
    count, hits = {}, {}
    for text, label in zip(texts, y, strict=True):
        for f in set().union(*plain_features(text)):
            count[f] = count.get(f, 0) + 1
            hits[f] = hits.get(f, 0) + label
    n, n1 = len(y), sum(y)
    chi = {f: n * (hits[f] * (n - n1) - (c - hits[f]) * n1) ** 2 / (c * (n - c) * n1 * (n - n1)) for f, c in count.items() if 5 <= c < n}
    wanted = {f for f, v in chi.items() if v > 20}
    bucket = {}
    for word, kind in ((w, k) for w in ("vermin", "fool", "please", "kala") for k in ["w", *toxicity.STEMS]):
        found = toxicity.sentences(pa.array([word]))
        bucket["w" if kind == "w" else kind, word if kind == "w" else word[:kind]] = int(found.bucket[0, 0 if kind == "w" else 1 + toxicity.STEMS.index(kind)])
    bucket["p", "vermin", "fool"] = int(toxicity.sentences(pa.array(["vermin fool"])).bucket[0, -1])
    assert int(toxicity.sentences(pa.array(["vermin. fool"])).bucket[0, -1]) == toxicity.BUCKETS
    for f, b in bucket.items():
        if f in count and b != toxicity.BUCKETS:
            assert (b in chosen) == (f in wanted), f
    assert ("w", "please") in wanted and ("p", "vermin", "fool") in wanted


def test_the_fit_is_at_a_minimum():
    """The fitted weights have a loss that no small step along an axis lowers much; the loss is spelled out by hand."""
    texts = pa.array(["you vermin. a day", "a calm day. please come", "vermin here", "please. a sea", "a day. you fool vermin", "calm sea. please"] * 30)
    y = np.array([1, 0, 1, 0, 1, 0] * 30)
    model = toxicity.fit(texts, y, steps=800)

    def loss(weight, bias):
        m = toxicity.Model(weight, bias)
        found = toxicity.sentences(texts)
        chance = 1 / (1 + np.exp(-m.margin(found)))
        total = 0.0
        for k, (a, b) in enumerate(zip(found.first, found.first[1:], strict=False)):
            clean = math.prod(1 - chance[a:b])
            total -= math.log(1 - clean) if y[k] else math.log(clean)
        return total / len(y) + 0.3 / 2 / len(y) * (weight**2).sum()

    at = loss(model.weight, model.bias)
    for f in np.flatnonzero(model.weight)[:12]:
        for step in (-0.05, 0.05):
            moved = model.weight.copy()
            moved[f] += step
            assert loss(moved, model.bias) > at - 1e-4


def test_offending_sentences_are_located(spark):
    good, bad = "a calm day by the sea. we walked home.", "a calm day. you are a vermin fool! we walked home."
    model = toxicity.fit(pa.array([good, bad] * 40), np.array([0, 1] * 40))
    rows = [(1, good), (2, "日本 é. " + bad), (3, None), (4, bad + "\n" + bad), (5, "x. " * 40_000 + "you are a vermin fool")]
    got = {r.doc_id: r for r in toxicity.score(clashing(docs(spark, rows)), model).collect()}
    for i, text in rows:
        spans = [text[s.start : s.end] for s in got[i].offending]
        assert spans == ["you are a vermin fool"] * (text or "").count("vermin") and got[i].n_offending == len(spans) and all(s.chance >= 0.5 for s in got[i].offending)


def test_toxicity_odd_rows(spark):
    d, labels = docs(spark, ODD), spark.createDataFrame([(5, 1), (6, 0), (None, 1), (7, None)], "doc_id long, y int")
    got = toxicity.score(d, toxicity.train(d, labels, F.lit(True))).collect()
    assert len(got) == len(ODD) and all(0 <= r.score <= 1 for r in got)
    none = toxicity.score(d.limit(0), toxicity.train(d.limit(0), labels.limit(0), F.lit(True)))
    assert none.count() == 0


def plain_bits(tables, text):
    """The code length of a text, byte by byte, from counts of contexts of every order."""
    own = language_id._SYMBOL[np.frombuffer(text.encode(), np.uint8)].tolist()
    total, past = 0.0, [0, 0, 0, *own]
    for i, s in enumerate(own):
        context, bits = past[i : i + 3], None
        escaped = 0.0
        for order in range(3, -1, -1):
            row = tables.get((order, tuple(context[3 - order :])))
            if row is None or (order and sum(row.values()) < language_id.LEAST):
                continue
            n, d = sum(row.values()), len(row)
            if s in row:
                bits = escaped - math.log2(row[s] / (n + d))
                break
            escaped -= math.log2(d / (n + d))
        total += escaped + math.log2(language_id.SYMBOLS) if bits is None else bits
    return total


def test_code_lengths_are_exact():
    train = {"aa": ["the cat sat on the mat " * 9, "The dog. 12"], "bb": ["où est le chat là-bas? " * 9, "déjà"]}
    codes, counts, tables = [], [], []
    for texts in train.values():
        t = {}
        all_codes = []
        for text in texts:
            data, offsets = language_id.textkit.utf8(pa.array([text]))
            for _, _, own, at in language_id.symbols(data, offsets):
                all_codes.append(at * language_id.SYMBOLS + own)
            s = [0, 0, 0, *language_id._SYMBOL[data].tolist()]
            for i in range(3, len(s)):
                for order in range(4):
                    row = t.setdefault((order, tuple(s[i - order : i])), {})
                    row[s[i]] = row.get(s[i], 0) + 1
        code, n = np.unique(np.concatenate(all_codes), return_counts=True)
        codes.append(code)
        counts.append(n)
        tables.append(t)
    trees = language_id.grow(list(train), codes, counts)
    texts = ["the mat", "déjà vu?", "zebra 77", "", "x"]
    got = language_id.code_lengths(trees, pa.array(texts))
    for i, text in enumerate(texts):
        for k in range(2):
            assert got[i, k] == pytest.approx(plain_bits(tables[k], text), rel=1e-5)
    data, offsets = language_id.textkit.utf8(pa.array(texts))
    assert len(list(language_id.symbols(data, offsets))) == 1


def test_language_odd_rows(spark, monkeypatch):
    rows = [(i, t, "en" if i != 5 else None, "s", 0) for i, t in ODD]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.doc_id: r for r in language_id.predict(d, language_id.train(d, F.lit(True))).collect()}
    assert got[1].lang_pred == got[2].lang_pred == got[3].lang_pred == "und" and got[1].score == 0 and got[5].lang_pred == "en"
    assert {r.lang_pred for r in language_id.predict(d, language_id.train(d, F.lit(False))).collect()} == {"und"}
    assert language_id.predict(d.limit(0), language_id.train(d.limit(0), F.lit(True))).count() == 0
    big = pa.array(["wort " * 5000, "a"])
    trees = language_id.train(d, F.lit(True))
    whole = language_id.code_lengths(trees, big)
    monkeypatch.setattr(language_id.textkit, "PIECE", 777)
    assert np.allclose(whole, language_id.code_lengths(trees, big))


def test_every_language_is_learned(spark, monkeypatch):
    # 70 languages, each with a letter that no other has
    letter = [chr(0x4E00 + 67 * k) for k in range(70)]
    rows = [(i, f"{letter[i % 70]}{letter[i % 70]} und " * (40 + i % 70), f"l{i % 70:02}", "s", 0) for i in range(140)]
    d = spark.createDataFrame([*rows, (140, None, None, "s", 0)], "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.doc_id: r for r in language_id.predict(d, language_id.train(d, F.col("doc_id") < 70)).collect()}
    assert all(got[r[0]].lang_pred == r[2] for r in rows) and got[140].lang_pred == "und" and len(got) == 141
    # passes give what one array of all gives
    few = d.where("doc_id % 70 < 5")
    monkeypatch.setattr(language_id, "AT_ONCE", 70)
    once = sorted(map(tuple, language_id.predict(few, language_id.train(few, F.lit(True))).collect()))
    monkeypatch.setattr(language_id, "AT_ONCE", 2)
    parts = sorted(map(tuple, language_id.predict(few, language_id.train(few, F.lit(True))).collect()))
    assert [r[:2] for r in once] == [r[:2] for r in parts] and np.allclose([r[2:] for r in once], [r[2:] for r in parts])


def test_languages_of_few_long_documents_are_learned(spark):
    d = spark.createDataFrame([(i, f"wort{i % 2} " * 3000, "ab"[i % 2], "s", 0) for i in range(4)], "doc_id long, text string, lang string, source string, n_chars long")
    assert language_id.train(d, F.lit(True), sample_bytes=10).languages == ["a", "b"]

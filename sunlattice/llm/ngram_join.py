"""N-gram Jaccard self-join of documents by chosen paths (CPSJoin: Christiani, Pagh, Sivertsen 2018).

A text is the set of its five-word shingles. Texts with equal sets are one class; classes are embedded as COORDINATES min-hash tokens. A run splits the
classes by the values at sampled coordinates, again and again: classes that share a chosen token go to the same node. Small nodes, and large ones
whose members are alike, are compared all against all, in blocks; other large nodes are split further. Runs are repeated until pairs at the threshold are
met with the target recall. Within a node a sketch drops members without a partner, then the whole sets decide exactly.

Pairs are never written: a block gives each member's number of partners (a pair counts in the least node that both are in) and a forest of links, of which
the components are made. Handling: null ids and texts without words take no part: their class is their own id and they have no links. Repeated
rows count as copies; of equal ids the text's hash decides; further columns are kept by deduplicate() and not read by groups(), whatever their names; a text is
read whole, its words and shingles taking some 40 bytes a word; an empty table gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import scratch, textkit
from .components import components

THRESHOLD = 0.8
RECALL = 0.999
COORDINATES = 128
#: Coordinates sampled at a node, members of a node that is compared as it is, splits one below the other, and the average likeness from which a large node is compared in blocks.
SAMPLED = 4
SMALL = 1024
DEPTH = 5
ALIKE = 0.4
#: Classes and shingles of a block.
BLOCK = 1024
BLOCK_SHINGLES = 600_000
#: How far a pair's share of equal min-hashes may be below the threshold: four standard deviations.
SLACK = 4 * math.sqrt(THRESHOLD * (1 - THRESHOLD) / COORDINATES)
#: Ids of at most so many classes are broadcast when their texts are fetched, and so many members of large nodes when their sketches are; more are joined by a shuffle.
FETCH_BROADCAST = 500_000
MEMBERS_BROADCAST = 150_000
#: Bytes of a class's sketch: 16 bits of each min-hash. They tell members of a node apart; the first split goes by whole min-hashes.
SKETCH = 2 * COORDINATES

_rng = np.random.default_rng(20240229)
_FACTORS = _rng.integers(1, 1 << 63, COORDINATES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def runs(threshold: float = THRESHOLD, recall: float = RECALL) -> int:
    """Runs after which a pair at the threshold has been in one compared node with that probability."""
    once = (1 - (1 - threshold) ** SAMPLED) ** DEPTH
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - once)))


def shingle_sets(texts) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles of each text, sorted, and where each text's start."""
    grams, first = textkit.shingles(textkit.Words(*textkit.utf8(texts)))
    parts = [np.unique(grams[a:b]) for a, b in zip(first, first[1:], strict=False)]
    sizes = np.fromiter(map(len, parts), np.int64, len(parts))
    return np.concatenate([np.zeros(0, np.uint64), *parts]), np.concatenate([[0], np.cumsum(sizes)])


def set_keys(grams: np.ndarray, first: np.ndarray) -> np.ndarray:
    """(texts, 2) numbers that tell sets apart; 0, 0 of the empty set."""
    with np.errstate(over="ignore"):
        a = np.concatenate([[np.uint64(0)], np.cumsum(textkit.mix(grams ^ np.uint64(0x5851F42D4C957F2D)), dtype=np.uint64)])
        b = np.concatenate([[np.uint64(0)], np.cumsum(textkit.mix(grams + np.uint64(0x14057B7EF767814F)), dtype=np.uint64)])
        return np.stack([a[first[1:]] - a[first[:-1]], b[first[1:]] - b[first[:-1]]], axis=1)


def minima(grams: np.ndarray, first: np.ndarray, factors: np.ndarray = _FACTORS) -> np.ndarray:
    """(texts, factors) min-hashes; those of an empty set are all ones."""
    out = np.full((len(first) - 1, len(factors)), 0xFFFFFFFFFFFFFFFF, np.uint64)
    has = np.flatnonzero(np.diff(first))
    a = 0
    while a < len(has):  # some texts at a time, so that a factor's products stay in the cache
        b = max(a + 1, int(np.searchsorted(first[has], first[has[a]] + 32768)))
        part, starts = grams[first[has[a]] : first[has[b - 1] + 1]], first[has[a:b]] - first[has[a]]
        with np.errstate(over="ignore"):
            for k, f in enumerate(factors):
                out[has[a:b], k] = np.minimum.reduceat(part * f, starts)
        a = b
    return out


def roots(n_runs: int) -> list[int]:
    return [int(x) for x in np.random.default_rng(7).integers(1, 1 << 62, n_runs)]


def describe(low: np.ndarray, n_runs: int) -> np.ndarray:
    """Min-hashes as bytes of a class: the sketch, then the numbers of the nodes below each run's root."""
    sketch = ((low >> np.uint64(20)) & np.uint64(0xFFFF)).astype("<u2")
    below = [_children(np.full(len(low), r, np.uint64), low, SAMPLED)[0].astype("<u8") for r in roots(n_runs)]
    return np.concatenate([sketch.view(np.uint8).reshape(len(low), SKETCH), *[x.view(np.uint8).reshape(len(low), 8 * SAMPLED) for x in below]], axis=1)


def _sketches(column) -> np.ndarray:
    """(classes, COORDINATES) sketches of described classes."""
    rows = column.to_pylist()
    return np.frombuffer(b"".join(r[:SKETCH] for r in rows), "<u2").reshape(-1, COORDINATES)


def _binary(rows: np.ndarray) -> pa.Array:
    """Rows of numbers as binary values."""
    raw = np.ascontiguousarray(rows)
    width = raw.shape[1] * raw.itemsize
    return pa.Array.from_buffers(pa.binary(), len(raw), [None, pa.py_buffer((np.arange(len(raw) + 1) * width).astype(np.int32)), pa.py_buffer(raw)]) if len(raw) else pa.array([], pa.binary())


def sign(docs: DataFrame, n_runs: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, h, c, n, sig): a hash of the text, the class key (null for a text without words), number of shingles and description of every row; a written table."""

    def rows(batches):
        for batch in batches:
            for a, b in textkit.pieces_of(batch.column(1)):
                part = batch.slice(a, b - a)
                grams, first = shingle_sets(part.column(1))
                keys, size = _binary(set_keys(grams, first)), np.diff(first)
                keys = pa.array([k if n else None for k, n in zip(keys.to_pylist(), size.tolist(), strict=True)], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), keys, pa.array(size), _binary(describe(minima(grams, first), n_runs))], ["doc_id", "h", "c", "n", "sig"])

    scratch.small_batches(docs.sparkSession)
    whole = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"), F.xxhash64(F.col(text)).alias("h"))
    return scratch.table(whole.mapInArrow(textkit.lean(rows), "doc_id long, h long, c binary, n long, sig binary"), "signatures")


def _children(node: np.ndarray, sig: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """For each row, the numbers of the n nodes below its node: n coordinates, sampled by the node's number, and the row's values there."""
    with np.errstate(over="ignore"):
        # n different coordinates: a start and an odd stride
        start = textkit.mix(node ^ np.uint64(0xA0761D6478BD642F))
        stride = textkit.mix(node + np.uint64(0xE7037ED1A0B428DB)) | np.uint64(1)
        at = (start[:, None] + stride[:, None] * np.arange(n, dtype=np.uint64)[None, :]) % np.uint64(COORDINATES)
        value = np.take_along_axis(sig, at.astype(np.int64), axis=1).astype(np.uint64)
        return textkit.mix(textkit.mix(node)[:, None] * np.uint64(0x9FB21C651E98DF25) + textkit.mix(value ^ (at << np.uint64(56)))), np.repeat(np.arange(len(node)), n)


def _first_nodes(batches):
    for batch in batches:
        rows = batch.column("sig").to_pylist()
        if rows:
            node = np.frombuffer(b"".join(r[SKETCH:] for r in rows), "<i8").reshape(len(rows), -1)
            of = pa.array(np.repeat(np.arange(len(rows)), node.shape[1]))
            yield pa.RecordBatch.from_arrays([pa.array(node.ravel()), batch.column("c").take(of), batch.column("n").take(of)], ["node", "c", "n"])


def _next_nodes(batches):
    for batch in batches:
        if batch.num_rows:
            child, of = _children(batch.column("node").to_numpy().view(np.uint64), _sketches(batch.column("sig")), SAMPLED)
            yield pa.RecordBatch.from_arrays([pa.array(child.ravel().view(np.int64)), batch.column("c").take(pa.array(of)), batch.column("n").take(pa.array(of))], ["node", "c", "n"])


def _likeness(batches):
    """(node, coordinate and value) of 16 coordinates of each member."""
    for batch in batches:
        sig = _sketches(batch.column("sig"))[:, ::8].astype(np.int64) + (np.arange(16, dtype=np.int64) << 32)
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(batch.column("node").to_numpy(), 16)), pa.array(sig.ravel())], ["node", "v"])


def paths(classes: DataFrame) -> DataFrame:
    """(node, c, n, members, shingles) of every node that is to be compared: chosen paths from one root for each run. classes: (c, n, sig)."""
    active = scratch.table(classes.mapInArrow(textkit.lean(_first_nodes), "node long, c binary, n long"), "paths-0")
    done = []
    for depth in range(1, DEPTH + 1):
        # most nodes have one member; they go before anything else is counted
        alone = active.groupBy("node").agg(F.count(F.lit(1)).alias("members")).where("members > 1")
        inside = scratch.table(active.join(alone, "node"), f"inside-{depth}")
        # nodes of the same members are compared once
        marks = F.sum(F.xxhash64("c").cast("decimal(20,0)")).alias("f1"), F.bit_xor(F.xxhash64("c", F.lit(1))).alias("f2")
        sizes = inside.groupBy("node", "members").agg(F.sum("n").alias("shingles"), *marks)
        sizes = scratch.table(sizes.groupBy("members", "shingles", "f1", "f2").agg(F.min("node").alias("node")).select("node", "shingles", "members"), f"nodes-{depth}")
        some = inside.drop("members").join(sizes, "node")
        large = sizes.where(F.col("members") > SMALL)
        if depth == DEPTH or large.isEmpty():
            done.append(some.select("node", "c", "n", "members", "shingles"))
            break
        done.append(some.where(F.col("members") <= SMALL).select("node", "c", "n", "members", "shingles"))
        split = some.where(F.col("members") > SMALL)
        few = large.agg(F.sum("members")).first()[0] <= MEMBERS_BROADCAST
        wide = scratch.table(classes.select("c", "sig").join(F.broadcast(split) if few else split, "c"), f"large-{depth}")
        same = wide.mapInArrow(textkit.lean(_likeness), "node long, v long").groupBy("node", "v").agg(F.count(F.lit(1)).alias("k")).groupBy("node").agg(F.sum(F.col("k") * F.col("k")).alias("k2"))
        alike = scratch.table(large.join(same, "node").select("node", (F.col("k2") >= ALIKE * 16 * F.col("members") * F.col("members")).alias("alike")), f"alike-{depth}")
        marked = wide.join(alike, "node")
        done.append(marked.where("alike").select("node", "c", "n", "members", "shingles"))
        active = scratch.table(marked.where(~F.col("alike")).select("node", "c", "n", "sig").mapInArrow(textkit.lean(_next_nodes), "node long, c binary, n long"), f"paths-{depth}")
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return scratch.table(out, "compared")


def blocks(members: DataFrame) -> DataFrame:
    """members with (node, x, y): a node's members are dealt into blocks of about BLOCK classes and BLOCK_SHINGLES shingles by a hash, and each block meets each in a pair x <= y."""
    n = F.greatest(F.ceil(F.col("members") / BLOCK), F.ceil(F.col("shingles") / BLOCK_SHINGLES)).cast("int")
    dealt = members.withColumn("_n", F.least(n, F.col("members").cast("int"))).withColumn("own", F.pmod(F.xxhash64("c", "node"), F.col("_n")).cast("int"))
    dealt = dealt.withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    return dealt.withColumn("x", F.least("own", "_o")).withColumn("y", F.greatest("own", "_o")).drop("_n", "_o", "members", "shingles")


def _grouped(batches, names: list[str]):
    """Tables of the rows with equal values of names, from batches sorted by them."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.stack([batch.column(x).to_numpy() for x in names], axis=1)
        cuts = np.concatenate([[0], np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1, [len(keys)]]).tolist()
        for a, b in zip(cuts, cuts[1:], strict=False):
            if held and tuple(keys[a]) != last:
                yield pa.Table.from_batches(held).combine_chunks()
                held = []
            last = tuple(keys[a])
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _sketch(batches):
    """Members of a block pair with a partner there that the sketch doesn't exclude."""
    for group in _grouped(batches, ["node", "x", "y"]):
        sig, own = _sketches(group.column("sig").combine_chunks()), group.column("own").to_numpy()
        x, y = group.column("x")[0].as_py(), group.column("y")[0].as_py()
        least = math.floor((THRESHOLD - SLACK) * COORDINATES)
        keep = np.zeros(len(sig), bool)
        if len(sig) > 1:
            left, right = (np.arange(len(sig)),) * 2 if x == y else (np.flatnonzero(own == x), np.flatnonzero(own == y))
            equal = np.zeros((len(left), len(right)), np.uint8)
            for k in range(COORDINATES):
                equal += sig[left, k][:, None] == sig[right, k][None, :]
            like = equal >= least
            if x == y:
                np.fill_diagonal(like, False)
            keep[left[like.any(axis=1)]] = True
            keep[right[like.any(axis=0)]] = True
        if keep.any():
            yield group.select(["node", "c", "x", "y", "own"]).filter(pa.array(keep)).combine_chunks().to_batches()[0]


def jaccard(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Exact Jaccard of all left and right sets (sorted, distinct): shared elements are counted by products of incidence matrices."""
    sizes_l, sizes_r = np.fromiter(map(len, left), np.int64, len(left)), np.fromiter(map(len, right), np.int64, len(right))
    if len(left) == 1 and len(right) == 1:
        shared = np.array([[len(np.intersect1d(left[0], right[0], assume_unique=True))]], np.float64)
    else:
        a, b = np.concatenate(left), np.concatenate(right)
        row_a, row_b = np.repeat(np.arange(len(left)), sizes_l), np.repeat(np.arange(len(right)), sizes_r)
        # only elements on both sides can be shared
        values = np.intersect1d(a, b)
        at_a, at_b = np.searchsorted(values, a), np.searchsorted(values, b)
        in_a = values[np.minimum(at_a, len(values) - 1)] == a if len(values) else np.zeros(len(a), bool)
        in_b = values[np.minimum(at_b, len(values) - 1)] == b if len(values) else np.zeros(len(b), bool)
        at_a, row_a, at_b, row_b = at_a[in_a], row_a[in_a], at_b[in_b], row_b[in_b]
        shared, step = np.zeros((len(left), len(right))), max(1024, 4_000_000 // max(len(left), len(right)))
        order_a, order_b = np.argsort(at_a, kind="stable"), np.argsort(at_b, kind="stable")
        at_a, row_a, at_b, row_b = at_a[order_a], row_a[order_a], at_b[order_b], row_b[order_b]
        for low in range(0, len(values), step):
            p, q = np.searchsorted(at_a, [low, low + step]), np.searchsorted(at_b, [low, low + step])
            m = np.zeros((len(left), min(step, len(values) - low)), np.float32)
            o = np.zeros((len(right), m.shape[1]), np.float32)
            m[row_a[p[0] : p[1]], at_a[p[0] : p[1]] - low] = 1
            o[row_b[q[0] : q[1]], at_b[q[0] : q[1]] - low] = 1
            shared += m @ o.T
    return shared / (sizes_l[:, None] + sizes_r[None, :] - shared)


def _forest(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The least member of each one's component among the links i - j."""
    root = np.arange(n)
    while len(i):
        low = np.minimum(root[i], root[j])
        was = root.copy()
        np.minimum.at(root, root[i], low)
        np.minimum.at(root, root[j], low)
        while (root[root] != root).any():
            root = root[root]
        if (root == was).all():
            break
    return root


def _verify(batches):
    """(c, partners, documents, root): of each member of a block pair its partners that count there, their documents, and a member that it is linked with."""
    for group in _grouped(batches, ["node", "x", "y"]):
        n = group.num_rows
        if n < 2:
            continue
        c, own, copies = group.column("c").to_pylist(), group.column("own").to_numpy(), group.column("copies").to_numpy()
        node, x, y = (group.column(k)[0].as_py() for k in ("node", "x", "y"))
        sets = [np.frombuffer(v, np.uint64) for v in group.column("grams").to_pylist()]
        left, right = (np.arange(n),) * 2 if x == y else (np.flatnonzero(own == x), np.flatnonzero(own == y))
        if not len(left) or not len(right):
            continue
        linked = jaccard([sets[k] for k in left], [sets[k] for k in right]) >= THRESHOLD - 1e-12
        if x == y:
            np.fill_diagonal(linked, False)
        i, j = np.nonzero(linked)
        if not len(i):
            continue
        root = _forest(n, left[i], right[j])
        # a pair counts in the least node that both are in
        nodes = [np.array(v, np.int64) for v in group.column("nodes").to_pylist()]
        flat = np.concatenate(nodes)
        row = np.repeat(np.arange(n), [len(v) for v in nodes])[flat < node]
        smaller, column = np.unique(flat[flat < node], return_inverse=True)
        if len(smaller):
            m = np.zeros((n, len(smaller)), np.float32)
            m[row, column] = 1
            linked &= (m[left] @ m[right].T) == 0
        partners, documents = np.zeros(n, np.int64), np.zeros(n, np.int64)
        partners[left] += linked.sum(axis=1)
        documents[left] += linked @ copies[right]
        if x != y:
            partners[right] += linked.sum(axis=0)
            documents[right] += copies[left] @ linked
        some = np.flatnonzero((partners > 0) | (root != np.arange(n)))
        yield pa.RecordBatch.from_arrays([pa.array([c[k] for k in some], pa.binary()), pa.array(partners[some]), pa.array(documents[some]), pa.array([c[root[k]] for k in some], pa.binary())], ["c", "partners", "documents", "root"])


def _gram_rows(batches):
    for batch in batches:
        for a, b in textkit.pieces_of(batch.column(1)):
            grams, first = shingle_sets(batch.column(1).slice(a, b - a))
            keys = _binary(set_keys(grams, first))
            yield pa.RecordBatch.from_arrays([keys, pa.array([grams[p:q].tobytes() for p, q in zip(first, first[1:], strict=False)], pa.binary())], ["c", "grams"])


def _dealt(df: DataFrame) -> DataFrame:
    return df.repartition("node", "x", "y").sortWithinPartitions("node", "x", "y", "c")


def link(docs: DataFrame, key: str = "doc_id", text: str = "text", recall: float = RECALL) -> tuple[DataFrame, DataFrame]:
    """(signed, classes): sign(docs), and of every class (c) rep, its least id; copies, its documents; partners and documents, the other classes with a
    Jaccard of THRESHOLD or more and their documents; root, the least rep of its component."""
    signed = sign(docs, runs(THRESHOLD, recall), key, text)
    whole = signed.where(F.col("doc_id").isNotNull() & F.col("c").isNotNull())
    classes = scratch.table(whole.groupBy("c", "n").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.max("sig").alias("sig")), "classes")
    members = paths(classes.select("c", "n", "sig"))
    sketched = _dealt(blocks(members).join(classes.select("c", "sig"), "c")).mapInArrow(textkit.lean(_sketch), "node long, c binary, x int, y int, own int")
    left = scratch.table(sketched, "sketched")
    # blocks that are down to the same members are compared once; a block pair of a larger node stays
    marks = F.count(F.lit(1)).alias("k"), F.sum(F.xxhash64("c").cast("decimal(20,0)")).alias("f1"), F.bit_xor(F.xxhash64("c", F.lit(1))).alias("f2")
    whole_node = F.when((F.col("x") == 0) & (F.col("y") == 0), F.lit(0).cast("long")).otherwise(F.col("node"))
    once = left.groupBy("node", "x", "y").agg(*marks).groupBy("x", "y", whole_node.alias("w"), "k", "f1", "f2").agg(F.min("node").alias("node")).where("k > 1").select("node", "x", "y")
    # where a node has several block pairs, its first goes with the others
    left = left.join(once, ["node", "x", "y"])
    places = left.groupBy("c").agg(F.collect_list(F.struct("node", "x", "y", "own")).alias("places"), F.collect_set("node").alias("nodes"))
    wanted = scratch.table(places.join(classes.select("c", "rep", "copies"), "c"), "wanted")
    # the whole sets of the classes that are left
    ids = wanted.select("rep")
    few = ids.count() <= FETCH_BROADCAST
    texts = docs.select(F.col(key).cast("long").alias("rep"), F.col(text).alias("text")).join(F.broadcast(ids) if few else ids, "rep", "left_semi")
    grams = texts.mapInArrow(textkit.lean(_gram_rows), "c binary, grams binary").dropDuplicates(["c"])
    sets = wanted.drop("rep").join(grams, "c").select("c", "copies", "nodes", "grams", F.explode("places").alias("p")).select("c", "copies", "nodes", "grams", "p.*")
    found = scratch.table(_dealt(sets).mapInArrow(textkit.lean(_verify), "c binary, partners long, documents long, root binary"), "links")
    counted = found.groupBy("c").agg(F.sum("partners").alias("partners"), F.sum("documents").alias("documents"))
    rep = classes.select(F.col("c"), F.col("rep"))
    ends = found.where(F.col("c") != F.col("root")).select("c", "root").distinct().join(rep, "c").select(F.col("rep").alias("a"), F.col("root").alias("c")).join(rep, "c").select("a", F.col("rep").alias("b"))
    groups = components(ends)
    out = classes.select("c", "rep", "copies").join(counted, "c", "left").join(groups, F.col("rep") == F.col("node"), "left")
    return signed, out.select("c", "rep", "copies", F.coalesce("partners", F.lit(0)).alias("partners"), F.coalesce("documents", F.lit(0)).alias("documents"), F.coalesce("root", "rep").alias("root"))


#: Classes of more copies than this, in units of an even share of the rows among 4096 tasks, are joined by a broadcast: there are less than 4096 of them.
HOT_SHARE = 4096


def _joined(signed: DataFrame, classes: DataFrame) -> DataFrame:
    """signed with its rows' classes. Rows without a class go by themselves, and classes with a large share of the rows are broadcast, so no task gets more than its
    share of one key."""
    rows = classes.agg(F.sum("copies")).first()[0] or 0
    hot = classes.where(F.col("copies") > rows // HOT_SHARE + 1000)
    rest = classes.where(F.col("copies") <= rows // HOT_SHARE + 1000)
    has = F.col("doc_id").isNotNull() & F.col("c").isNotNull()
    known, none = signed.where(has), signed.where(~has)
    hot_keys = F.broadcast(hot.select("c"))
    big = known.join(F.broadcast(hot), "c")
    small = known.join(hot_keys, "c", "left_anti").join(rest, "c")
    return big.unionByName(small).unionByName(none, allowMissingColumns=True)


def groups(docs: DataFrame, key: str = "doc_id", text: str = "text", recall: float = RECALL) -> DataFrame:
    """A row for each of docs: doc_id, class_id (the least id of the documents linked with it by a chain of links), copy_id (the least id with the same set),
    n_links (other documents of Jaccard THRESHOLD or more, copies too) and n_linked_texts (different sets among them)."""
    zero = F.lit(0).cast("long")
    return _joined(*link(docs, key, text, recall)).select(
        "doc_id", F.coalesce("root", "doc_id").alias("class_id"), F.coalesce("rep", "doc_id").alias("copy_id"),
        F.coalesce(F.col("copies") - 1 + F.col("documents"), zero).alias("n_links"), F.coalesce("partners", zero).alias("n_linked_texts"),
    )


def deduplicate(docs: DataFrame, key: str = "doc_id", text: str = "text", recall: float = RECALL) -> DataFrame:
    """docs with one row of each group: that of the least id, of several rows of that id the one of the least hash of the text, once. Rows without an id or
    words stay. Rows are told apart by id and text, so an id that stands with several texts loses only those that are copies."""
    found = scratch.table(_joined(*link(docs, key, text, recall)).where(F.col("doc_id").isNotNull() & F.col("c").isNotNull()).select("doc_id", "h", F.col("root").alias("class_id")), "groups")
    taken = {c.lower() for c in docs.columns}
    away, mark, one = (next(n for n in (x, *(f"{x}_{i}" for i in range(len(taken) + 1))) if n not in taken) for x in ("_gone", "_text", "_copy"))
    # of the rows that have their group's id there is one in nearly all groups; the others are few
    first = found.where(F.col("doc_id") == F.col("class_id")).groupBy("class_id").agg(F.min("h").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    several = scratch.table(first, "several")
    lost = found.where(F.col("doc_id") != F.col("class_id")).select("doc_id", "h")
    again = found.where(F.col("doc_id") == F.col("class_id")).join(several, "class_id").where(F.col("h") != F.col("first")).select("doc_id", "h")
    gone = scratch.table(lost.unionByName(again).distinct().select(F.col("doc_id").alias(away), F.col("h").alias(mark)), "gone")
    few = gone.count() <= FETCH_BROADCAST
    same = (F.col(key).cast("long") == F.col(away)) & (F.xxhash64(F.col(text)) == F.col(mark))
    left = docs.join(F.broadcast(gone) if few else gone, same, "left_anti")
    if several.isEmpty():
        return left
    # rows of the same id and text
    ids = several.select(F.col("class_id").alias(one))
    has = F.length(F.coalesce(F.col(text), F.lit(""))) > 0
    twice = left.where(has).join(ids, F.col(key).cast("long") == F.col(one), "left_semi").dropDuplicates([key, text])
    return left.join(ids, (F.col(key).cast("long") == F.col(one)) & has, "left_anti").unionByName(twice)


def op1(spark, sf_dir: str) -> DataFrame:
    return groups(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))

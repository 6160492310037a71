"""MinHash near-dedup by bottom-k sketches from one hash function.

A text's set is that of its word shingles (``shingle`` words without ASCII case and punctuation; a shorter text is one shingle).
Texts with the same set, by two independent 64-bit fingerprints, are one node. The sketch of a node is the k least hashes of its set.

Candidates come from inverted lists of retained values, with the prefix principle: two sets as similar as the
threshold share at least ``needed`` retained values (exact for whole sets, three standard deviations below the mean
for cut sketches). With each node's values ordered by the length of their lists, it is enough to look at the first
(shared - needed + 1) of them. So values that a great many documents share, such as a licence passage, generate no pairs, values
of one document none either, and there is no cap on lists, candidates or partners.

Lists of at most ``BLOCK`` nodes are expanded into pairs, whose number is in proportion to the nodes. The union's bottom-k sketch filters them, and the exact
Jaccard coefficient of the whole sets decides. Both steps work on units of two blocks of about ``BLOCK`` nodes of a
neighbourhood: a sketch or text travels once for each unit, not for each pair.

Nodes of longer lists are placed in blocks of about ``WIDE`` nodes, whose whole sets are written once to the shared folder, by value. Two blocks that share such a list are
a unit, and so is each with itself; a task reads both and counts what every set shares with every other, so all its pairs are decided exactly, and only each node's links and one edge to
its part of the unit leave it. So no table has the pairs of a large group; comparing them still takes time in proportion to the square of its distinct sets.
A row of the result has its group and the number of its links.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from math import sqrt
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import shared
from . import textkit as K
from .components import components

SHINGLE, SKETCH, THRESHOLD, BLOCK = 5, 64, 0.5, 64
#: Nodes and values of a block of long lists. A value that more than DENSE pairs of sets of a unit share is counted by a matrix product, COLUMNS at once; others pair by pair, CODES at once.
WIDE, VALUES, DENSE, COLUMNS, CODES = 1024, 1 << 20, 3000, 1024, 1 << 21
_LAST = shared.LAST


def shingle_sets(data: np.ndarray, limits: np.ndarray, shingle: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, one text after the other, and their limits."""
    starts, ends, lim = K.words(data, limits, K.NOT_WORD)
    h = K.hashes(data, starts, ends, fold=True)
    own = K.owner(lim)
    g = K.grams(h, shingle)
    ok = own[: len(g)] == own[shingle - 1 :] if len(g) else np.zeros(0, bool)
    values, texts = g[ok], own[: len(g)][ok]
    short = np.flatnonzero((np.diff(lim) > 0) & (np.diff(lim) < shingle))
    if len(short):
        whole = []
        with np.errstate(over="ignore"):
            for i in short:
                x = np.uint64(lim[i + 1] - lim[i])
                for y in h[lim[i] : lim[i + 1]]:
                    x = K.mix(np.array([x * np.uint64(0xD6E8FEB86659FD93) + y]))[0]
                whole.append(x)
        values, texts = np.concatenate([values, np.array(whole, np.uint64)]), np.concatenate([texts, short])
    order = np.lexsort((values, texts))
    values, texts = values[order], texts[order]
    first = np.ones(len(values), bool)
    first[1:] = (values[1:] != values[:-1]) | (texts[1:] != texts[:-1])
    values, texts = values[first], texts[first]
    return values, np.searchsorted(texts, np.arange(len(limits)))


def sketches(docs: DataFrame, k: int = SKETCH, shingle: int = SHINGLE) -> DataFrame:
    """(id, h, f, g, n, sketch) of each row of docs that has a word: h is a hash of the text, f and g are fingerprints of its set, n its size.

    id is doc_id, and the greatest integer for null.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, limits = K.buffers(batch.column(2))
            for a, b in K.chunks(limits):
                values, lim = shingle_sets(data[limits[a] : limits[b]], limits[a : b + 1] - limits[a], shingle)
                n = np.diff(lim)
                with np.errstate(over="ignore"):
                    sums = np.concatenate([[np.uint64(0)], np.cumsum(K.mix(values ^ np.uint64(0xABCDEF1234567)), dtype=np.uint64)])
                    f = K.mix(sums[lim[1:]] - sums[lim[:-1]] + n.astype(np.uint64)).astype(np.int64)
                    sums = np.concatenate([[np.uint64(0)], np.cumsum(K.mix(values * np.uint64(0xD1342543DE82EF95) + np.uint64(0x2545F4914F6CDD1D)), dtype=np.uint64)])
                    g = K.mix(sums[lim[1:]] - sums[lim[:-1]]).astype(np.int64)
                keep = np.minimum(n, k)
                at = np.arange(keep.sum()) + np.repeat(lim[:-1] - (np.cumsum(keep) - keep), keep)
                has = np.flatnonzero(n > 0)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(keep)]), pa.int32()), pa.array(values[at].view(np.int64)))
                part = pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), pa.array(f), pa.array(g), pa.array(n, pa.int32()), lists], names=["id", "h", "f", "g", "n", "sketch"])
                yield part if len(has) == b - a else part.take(pa.array(has))

    inputs = {"id": shared.identifier(docs), "h": F.xxhash64(docs["text"]), "text": docs["text"]}
    return shared.apply_rows(docs, inputs, run, "id bigint, h bigint, f bigint, g bigint, n int, sketch array<bigint>")


def prefixes(nodes: DataFrame, threshold: float = THRESHOLD, k: int = SKETCH) -> DataFrame:
    """(v, f): the inverted lists of the values that each fingerprint has to be looked up by. Two that can be as similar as the threshold are in a list together.

    The lengths of the lists are counted with a combine before the shuffle and joined back, so a value that a great many nodes retain is a skewed join key, which adaptive execution splits.
    """
    cut = max(1, int(k * threshold - 3 * sqrt(k * threshold * (1 - threshold))))
    needed = F.least(F.lit(cut), F.ceil(F.col("n") * F.lit(threshold) - F.lit(1e-9)).cast("int"))
    postings = nodes.select("f", needed.alias("needed"), F.explode("sketch").alias("v"))
    lengths = nodes.select(F.explode("sketch").alias("v")).groupBy("v").agg(F.count(F.lit(1)).alias("length")).where("length > 1")
    listed = postings.join(lengths, "v")
    own = Window.partitionBy("f")  # at most k rows
    return (
        listed.withColumn("shared", F.count(F.lit(1)).over(own)).where("shared >= needed")
        .withColumn("place", F.row_number().over(own.orderBy("length", "v"))).where("place <= shared - needed + 1").select("v", "f")
    )


def in_blocks(lists: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(short, placed, units): the lists (v, f, block) of at most BLOCK nodes, (f, block) of each node of a longer list, and the pairs (x <= y) of blocks with such a list in common.

    A node's blocks are those of the longest of its lists, under the least fingerprint in it, so like nodes come together; which of them is chosen by hash.
    """
    lengths = lists.groupBy("v").agg(F.count(F.lit(1)).alias("length"), F.min("f").alias("least")).where(F.col("length") > BLOCK)
    long = shared.written(lists.join(lengths, "v"), "long")
    near = long.groupBy("f").agg(F.max(F.struct("length", "v", "least")).alias("most")).select("f", F.col("most.least").alias("label")).join(nodes.select("f", "n"), "f")
    sizes = near.groupBy("label").agg(F.greatest(F.ceil(F.count(F.lit(1)) / WIDE), F.ceil(F.sum("n") / VALUES)).alias("blocks"))
    placed = shared.written(near.join(sizes, "label").select("f", F.xxhash64("label", F.pmod(F.xxhash64("f"), "blocks")).alias("block")), "placed")
    at = long.join(placed, "f").select("v", "block").distinct()
    units = at.alias("x").join(at.alias("y"), F.expr("x.v = y.v and x.block <= y.block")).select(F.col("x.block").alias("x"), F.col("y.block").alias("y")).distinct()
    short = lists.join(lengths.select("v"), "v", "left_anti").join(placed, "f", "left").select("v", "f", "block")
    return short, placed, shared.written(units, "block-pairs")


def candidates(short: DataFrame, units: DataFrame) -> DataFrame:
    """Pairs (a < b) of fingerprints of a list (v, f, block), without those whose blocks are one of the units."""
    lists = shared.written(short, "postings")
    both = F.expr("x.block is not null and y.block is not null")
    pairs = lists.alias("x").join(lists.alias("y"), F.expr("x.v = y.v and x.f < y.f")).select(
        F.col("x.f").alias("a"), F.col("y.f").alias("b"), F.when(both, F.least("x.block", "y.block")).alias("x"), F.when(both, F.greatest("x.block", "y.block")).alias("y")
    )
    pairs = shared.written(pairs.distinct(), "pairs")
    return pairs.where("x is null").select("a", "b").unionByName(pairs.where("x is not null").join(units, ["x", "y"], "left_anti").select("a", "b"))


def in_units(pairs: DataFrame) -> DataFrame:
    """(unit, a, b): the pairs (a < b), with those of a neighbourhood in units of two blocks of about BLOCK nodes each. Blocks are made by hash from the size of the neighbourhood."""
    both = pairs.select("a", "b").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    near = shared.written(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("f"), F.least("a", "m").alias("label")), "labels")
    sizes = near.groupBy("label").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("blocks"))
    placed = near.join(sizes, "label").select("f", F.xxhash64("label", F.pmod(F.xxhash64("f"), "blocks")).alias("block"))
    p = pairs.join(placed.select(F.col("f").alias("a"), F.col("block").alias("ba")), "a").join(placed.select(F.col("f").alias("b"), F.col("block").alias("bb")), "b")
    return p.select(F.xxhash64(F.least("ba", "bb"), F.greatest("ba", "bb")).alias("unit"), "a", "b")


def _decided(pairs: DataFrame, values: DataFrame, sets, decide) -> DataFrame:
    """(unit, a, b, j) of the pairs (unit, a, b) for which decide, of the two nodes' sets, gives a j that isn't None.

    values: (f, value), one row a node; sets makes a list of sets from a column of values. A pair whose value is missing is an error.
    """
    kind = values.schema["value"].dataType.simpleString()
    wanted = pairs.select("unit", F.explode(F.array("a", "b")).alias("f")).distinct()
    zero = F.lit(0).cast("bigint")
    rows = wanted.join(values, "f").select("unit", "f", zero.alias("a"), zero.alias("b"), "value").unionByName(pairs.select("unit", zero.alias("f"), "a", "b", F.lit(None).cast(kind).alias("value")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, held = None, {}
        for batch in batches:
            units, fs, a, b = (batch.column(i).to_numpy() for i in range(4))
            valued = np.asarray(batch.column(4).is_valid())
            found: list[tuple[int, int, int, float]] = []
            for s, e, of in sets(batch.column(4)):
                for i in range(s, e):
                    if units[i] != unit:
                        unit, held = units[i], {}
                    if valued[i]:
                        held[fs[i]] = of(i)
                    elif (j := decide(held[a[i]], held[b[i]])) is not None:
                        found.append((unit, a[i], b[i], j))
            if found:
                columns = [pa.array(np.array(c, np.int64)) for c in list(zip(*found))[:3]]
                yield pa.RecordBatch.from_arrays([*columns, pa.array([r[3] for r in found], pa.float64())], names=["unit", "a", "b", "j"])

    # values of a unit come before its pairs
    return rows.repartition("unit").sortWithinPartitions("unit", F.col("value").isNull()).mapInArrow(run, "unit bigint, a bigint, b bigint, j double")


def _common(x: np.ndarray, y: np.ndarray) -> int:
    """How many values two sorted sets share."""
    z = np.concatenate([x, y])
    z.sort(kind="stable")
    return int((z[1:] == z[:-1]).sum())


def estimated(pairs: DataFrame, nodes: DataFrame, threshold: float = THRESHOLD, k: int = SKETCH) -> DataFrame:
    """Those of the pairs (unit, a, b) whose Jaccard coefficient, estimated from the bottom-k of the union, is within three standard deviations of the threshold."""
    least = threshold - 3 * sqrt(threshold * (1 - threshold) / k)

    def sets(column: pa.Array):
        at, flat = np.asarray(column.offsets), column.values.to_numpy().view(np.uint64)
        yield 0, len(column), lambda i: flat[at[i] : at[i + 1]].copy()

    def decide(x: np.ndarray, y: np.ndarray) -> float | None:
        z = np.concatenate([x, y])
        z.sort(kind="stable")
        twice = z[1:] == z[:-1]
        # the k-th distinct value ends the union's sketch
        kinds = np.cumsum(np.concatenate([[1], ~twice]))
        inside = int(np.searchsorted(kinds, k, "right"))
        size = int(kinds[inside - 1])
        j = int(twice[: inside - 1].sum()) / size
        return j if j >= least else None

    return _decided(pairs, nodes.select("f", F.col("sketch").alias("value")), sets, decide).select("unit", "a", "b")


def _texts(wanted: DataFrame, nodes: DataFrame, docs: DataFrame, broadcast_rows: int = 200_000) -> DataFrame:
    """(f, value): the texts of the nodes wanted (f). Rows of docs that repeat are the same node's; null texts are no node's."""
    involved = shared.written(wanted.join(nodes.select("f", "id", "h"), "f"), "involved")
    small = involved.count() <= broadcast_rows
    texts = docs.where("text is not null").select(shared.identifier(docs).alias("id"), F.xxhash64("text").alias("h"), "text")
    return texts.join(F.broadcast(involved) if small else involved, ["id", "h"]).select("f", F.col("text").alias("value"))


def verified(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, threshold: float = THRESHOLD, shingle: int = SHINGLE) -> DataFrame:
    """(a, b, jaccard) of those of the pairs (unit, a, b) whose whole sets reach the threshold."""
    texts = _texts(pairs.select(F.explode(F.array("a", "b")).alias("f")).distinct(), nodes, docs)

    def sets(column: pa.Array):
        data, limits = K.buffers(column)
        for s, e in K.chunks(limits):
            values, lim = shingle_sets(data[limits[s] : limits[e]], limits[s : e + 1] - limits[s], shingle)
            yield s, e, lambda i: values[lim[i - s] : lim[i - s + 1]].copy()  # noqa: B023

    def decide(x: np.ndarray, y: np.ndarray) -> float | None:
        if min(len(x), len(y)) < threshold * max(len(x), len(y)):
            return None
        same = _common(x, y)
        j = same / (len(x) + len(y) - same)
        return j if j >= threshold else None

    return _decided(pairs, texts, sets, decide).select("a", "b", F.col("j").alias("jaccard"))


class Block(NamedTuple):
    """Sets by value: f and n of each, the distinct values, where each one's rows begin and how many they are, and the rows (places in f)."""

    f: np.ndarray
    n: np.ndarray
    values: np.ndarray
    starts: np.ndarray
    counts: np.ndarray
    rows: np.ndarray

    @classmethod
    def of(cls, f: np.ndarray, n: np.ndarray, flat: np.ndarray) -> Block:
        order = np.argsort(flat, kind="stable")
        values, starts, counts = np.unique(flat[order], return_index=True, return_counts=True)
        return cls(f, n, values, starts.astype(np.int64), counts.astype(np.int64), np.repeat(np.arange(len(f)), n)[order])

    def write(self, system, path: str) -> None:
        """A later attempt of a task puts the same file in its place."""
        with system.open_output_stream(made := f"{path}.{uuid.uuid4().hex}") as out:
            out.write(np.array([len(self.f), len(self.values), len(self.rows)], np.int64).tobytes())
            for column in self:
                out.write(pa.py_buffer(np.ascontiguousarray(column)))
        system.move(made, path)

    @classmethod
    def read(cls, system, path: str) -> Block:
        with system.open_input_stream(path) as f:
            data = f.read()
        sets, values, rows = np.frombuffer(data, np.int64, 3)
        limits = np.cumsum([3, sets, sets, values, values, values, rows])
        f, n, v, *rest = (np.frombuffer(data, np.int64, e - s, 8 * s) for s, e in zip(limits[:-1], limits[1:]))
        return cls(f, n, v.view(np.uint64), *rest)


def _places(starts: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All places of the ranges of that start and length, and the range of each."""
    return np.arange(counts.sum()) + np.repeat(starts - (np.cumsum(counts) - counts), counts), np.repeat(np.arange(len(counts)), counts)


def in_common(x: Block, y: Block) -> np.ndarray:
    """How many values each set of x shares with each set of y."""
    at = np.minimum(np.searchsorted(y.values, x.values), len(y.values) - 1)
    i = np.flatnonzero(y.values[at] == x.values)
    j = at[i]
    xs, xn, ys, yn = x.starts[i], x.counts[i], y.starts[j], y.counts[j]
    same = np.zeros((len(x.f), len(y.f)), np.int64)
    dense = xn * yn > DENSE
    few, each = np.flatnonzero(~dense), np.cumsum((xn * yn)[~dense])
    at = 0
    while at < len(few):
        to = max(at + 1, int(np.searchsorted(each, (each[at - 1] if at else 0) + CODES, "right")))
        c = few[at:to]
        p, of = _places(np.zeros(len(c), np.int64), xn[c] * yn[c])
        row, column = np.divmod(p, yn[c][of])
        same += np.bincount(x.rows[xs[c][of] + row] * len(y.f) + y.rows[ys[c][of] + column], minlength=same.size).reshape(same.shape)
        at = to
    many = np.flatnonzero(dense)
    for at in range(0, len(many), COLUMNS):
        c = many[at : at + COLUMNS]
        sides = []
        for block, starts, counts in ((x, xs[c], xn[c]), (y, ys[c], yn[c])):
            p, of = _places(starts, counts)
            sides.append(side := np.zeros((len(block.f), len(c)), np.float32))
            side[block.rows[p], of] = 1
        same += (sides[0] @ sides[1].T).astype(np.int64)
    return same


def _roots(near: np.ndarray) -> np.ndarray:
    """The least node of each node's component, of a symmetric matrix."""
    root = np.full(len(near), -1)
    for s in range(len(near)):
        if root[s] < 0:
            front = np.array([s])
            while len(front):
                root[front] = s
                front = np.flatnonzero(near[front].any(0) & (root < 0))
    return root


def written_blocks(placed: DataFrame, nodes: DataFrame, docs: DataFrame, shingle: int = SHINGLE) -> str:
    """The folder with a file, a Block, for each block of placed (f, block), named by it. A node without a text is an error."""
    to = shared.scratch(docs.sparkSession, "blocks")
    system, at = shared.file_system(to)
    system.create_dir(at)
    rows = placed.join(_texts(placed.select("f"), nodes, docs), "f", "left").select("block", "f", "value")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, at = shared.file_system(to)
        block, held = None, {}

        def write() -> None:
            if held:
                n = np.array([len(x) for x in held.values()], np.int64)
                Block.of(np.array([*held], np.int64), n, np.concatenate([*held.values()])).write(system, f"{at}/{block}")
                held.clear()

        for batch in batches:
            blocks, fs = (batch.column(i).to_numpy() for i in range(2))
            if batch.column(2).null_count:
                raise ValueError("a text of the first pass is missing")
            data, limits = K.buffers(batch.column(2))
            for s, e in K.chunks(limits):
                values, lim = shingle_sets(data[limits[s] : limits[e]], limits[s : e + 1] - limits[s], shingle)
                for i in range(s, e):
                    if blocks[i] != block:
                        write()
                        block = blocks[i]
                    held[fs[i]] = values[lim[i - s] : lim[i - s + 1]].copy()
        write()
        K.release()
        yield from ()

    rows.repartition("block").sortWithinPartitions("block").mapInArrow(run, "block bigint").count()
    return to


def compared(units: DataFrame, folder: str, threshold: float = THRESHOLD, whole: bool = False) -> DataFrame:
    """(f, root, links) of the nodes that a unit (x, y) of blocks in the folder links: how many sets of it reach the threshold, and a node of its component in the unit. whole: the pairs (a, b, jaccard) instead."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, at = shared.file_system(folder)
        for batch in batches:
            for a, b in zip(*(batch.column(i).to_pylist() for i in range(2))):
                x = Block.read(system, f"{at}/{a}")
                y = x if a == b else Block.read(system, f"{at}/{b}")
                same = in_common(x, y)
                j = same / (x.n[:, None] + y.n - same)
                ok = j >= threshold
                if a == b:
                    np.fill_diagonal(ok, False)
                if whole:
                    p, q = np.nonzero(np.triu(ok) if a == b else ok)
                    columns = [np.minimum(x.f[p], y.f[q]), np.maximum(x.f[p], y.f[q]), j[p, q]]
                else:
                    f, near = x.f, ok
                    if a != b:
                        f, near = np.concatenate([x.f, y.f]), np.zeros((len(x.f) + len(y.f),) * 2, bool)
                        near[: len(x.f), len(x.f) :], near[len(x.f) :, : len(x.f)] = ok, ok.T
                    linked = np.flatnonzero(near.any(1))
                    near = near[np.ix_(linked, linked)]
                    columns = [f[linked], f[linked][_roots(near)], near.sum(1)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["a", "b", "jaccard"] if whole else ["f", "root", "links"])
        K.release()

    number = units.count()
    # few bytes, much work: the number of tasks is given, or adaptive execution would make one of them
    spread = units.repartition(max(1, min(number, max(int(units.sparkSession.conf.get("spark.sql.shuffle.partitions")), number // 32))))
    return spread.mapInArrow(run, "a bigint, b bigint, jaccard double" if whole else "f bigint, root bigint, links bigint")


def _found(docs: DataFrame, threshold: float, k: int, shingle: int, whole: bool) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """Members and edges (see similar) of short lists, and what compared gives for the units of long lists, None without any."""
    rows = shared.written(sketches(docs, k, shingle), "sketches")

    def noded(r: DataFrame) -> DataFrame:
        return shared.written(r.groupBy("f").agg(F.min(F.struct("id", "h", "n", "sketch")).alias("r"), (F.min("g") != F.max("g")).alias("clash")).select("f", "r.*", "clash"), "nodes")

    nodes = noded(rows)
    clash = nodes.where("clash").select("f", F.lit(True).alias("split"))
    if not clash.isEmpty():
        rows = shared.written(rows.join(clash, "f", "left").withColumn("f", F.expr("if(split, xxhash64(f, g), f)")).drop("split"), "sketches")
        nodes = noded(rows)
    short, placed, units = in_blocks(shared.written(prefixes(nodes, threshold, k), "prefixes"), nodes)
    near = shared.written(in_units(shared.written(candidates(short, units), "candidates")), "units")
    close = shared.written(estimated(near, nodes, threshold, k), "close")
    wide = None if placed.isEmpty() else shared.written(compared(units, written_blocks(placed, nodes, docs, shingle), threshold, whole), "compared")
    return rows.select("id", "h", "f"), verified(close, nodes, docs, threshold, shingle), wide


def similar(docs: DataFrame, threshold: float = THRESHOLD, k: int = SKETCH, shingle: int = SHINGLE) -> tuple[DataFrame, DataFrame]:
    """(members, edges): id, h, f of each row with words, and the verified pairs of fingerprints, all of them. Two sets that share f but not g get fingerprints of their own."""
    members, edges, wide = _found(docs, threshold, k, shingle, True)
    return members, edges if wide is None else edges.unionByName(wide)


def near_groups(docs: DataFrame, threshold: float = THRESHOLD, k: int = SKETCH, shingle: int = SHINGLE) -> DataFrame:
    """(id, h, group, n_links): every row's least identifier of its group of near copies, the connected component of pairs at or above the threshold, and how many other sets its set is linked to.

    Texts with the same shingle set are near copies. Null texts and texts without words are near copies of nothing and have no row here. Rows that repeat count once.
    """
    members, edges, wide = _found(docs, threshold, k, shingle, False)
    edges = shared.written(edges.select("a", "b"), "edges")
    counts = edges.select(F.explode(F.array("a", "b")).alias("node"), F.lit(1).cast("bigint").alias("links"))
    if wide is not None:
        counts = counts.unionByName(wide.select(F.col("f").alias("node"), "links"))
        edges = edges.unionByName(wide.select(F.col("f").alias("a"), F.col("root").alias("b")))
    links = counts.groupBy("node").agg(F.sum("links").alias("n_links"))
    roots = components(edges).join(links, "node")
    placed = members.distinct().join(roots, members["f"] == roots["node"], "left").select("id", "h", F.coalesce("root", "f").alias("root"), F.coalesce("n_links", F.lit(0).cast("bigint")).alias("n_links"))
    least = placed.groupBy("root").agg(F.min("id").alias("group"))
    return placed.join(least, "root").select("id", "h", "group", "n_links")


def mark(docs: DataFrame, broadcast_rows: int = 200_000, **settings) -> DataFrame:
    """Every row of docs as struct ``row`` with group_id, is_duplicate (whether near-dedup drops it) and n_links (see near_groups).

    Of each group the row with the least doc_id stays; a null doc_id comes last. Of rows that repeat doc_id and text one stays.
    A row without words is its own group. Of different texts of a group under its least identifier the one with the least hash stays.
    doc_id must be an integer column; other columns may have any name and type.
    """
    groups = shared.written(near_groups(docs, **settings), "groups")
    sizes = groups.groupBy("group").agg(F.count(F.lit(1)).alias("size"), F.min(F.struct("id", "h")).alias("first"))
    repeated = docs.where("text is not null").groupBy(shared.identifier(docs).alias("id"), F.xxhash64(docs["text"]).alias("h")).agg(F.count(F.lit(1)).alias("copies")).where("copies > 1")
    special = groups.join(sizes.where("size > 1"), "group").select("id", "h", "group", "n_links", (F.struct("id", "h") != F.col("first")).alias("drop"))
    special = special.join(repeated, ["id", "h"], "full").select("id", "h", F.coalesce("group", "id").alias("group"), "n_links", F.coalesce("drop", F.lit(False)).alias("drop"), (F.col("copies") > 1).alias("many"))
    special = shared.written(special, "special")
    small = special.count() <= broadcast_rows
    keyed = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), shared.identifier(docs).alias("id"), F.xxhash64(docs["text"]).alias("h"), docs["text"].isNull().alias("none"))
    hit = keyed.join(F.broadcast(special) if small else special, ["id", "h"], "left").withColumn("group", F.expr("if(none, id, coalesce(group, id))")).withColumn("n_links", F.expr("if(none, 0, coalesce(n_links, 0))"))
    simple = hit.where("none or many is null or drop").select("row", "group", F.expr("not none and coalesce(drop, false)").alias("is_duplicate"), "n_links")
    several = hit.where("not none and many and not drop")
    several = several.withColumn("p", F.row_number().over(Window.partitionBy("id", "h").orderBy(shared.in_order("row")))).select("row", "group", (F.col("p") > 1).alias("is_duplicate"), "n_links")
    return simple.unionByName(several).select("row", F.nullif("group", F.lit(_LAST)).alias("group_id"), "is_duplicate", "n_links")


def near_dedup(docs: DataFrame, **settings) -> DataFrame:
    """The rows of docs that near-dedup keeps, columns unchanged (see mark)."""
    return mark(docs, **settings).where("not is_duplicate").select("row.*")


def op8_near_dedup(spark, sf_dir: str) -> DataFrame:
    docs = shared.table(spark, sf_dir, "documents").select("doc_id", "text")
    return mark(docs).select("row.doc_id", "group_id", "is_duplicate", "n_links")


QUERIES = {"op8_near_dedup": op8_near_dedup}
SQL: dict[str, str] = {}

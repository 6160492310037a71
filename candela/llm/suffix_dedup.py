"""Suffix-array dedup: passages of ``min_words`` words or more that repeat across documents.

Words between ASCII white space are the symbols. Every window of min_words words is represented by the least hash of its
``GRAM``-word grams (its minimizer), so equal windows have equal minimizers; runs of windows with one minimizer are a piece. Only
minimizers that occur more than once can hold a repeat. A minimizer that more than ``HOT`` documents have, as those of a licence passage, is replaced by a hash of the
whole window for each of its windows: their places then spread over tasks, and the windows that straddle the passage's ends, each in one document alone, drop out.
Equal pieces are aggregated, in part before they are shuffled, to one text with its first place. So a task gets the distinct pieces of its minimizers, at most about ``HOT`` of them for each, and no window is looked at twice.

A task builds, for each collection of distinct pieces, the multi-document Burrows-Wheeler transform column-wise: round j inserts,
for every piece of at least j words, the suffix of its last j words at once, at the place that the previous rounds' order gives,
and updates the longest common prefixes there and at the follower, from range minima over the previous round's. The collection's
columns (transform, common prefixes, links, suffix numbers) are read from one sequential file in the shared folder and written to the
next in each round; a collection is bounded (``COLLECTION``), so a round holds it in memory in between. Intervals of suffixes with a common prefix of min_words or more are the repeated windows. Stretches of
windows with one keeper are joined back to all places of their piece, and merge to passages. The first occurrence, by (doc_id, place), is the keeper.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import shared
from . import textkit as K

MIN_WORDS, GRAM = 50, 12
#: Pieces are gathered to collections of about so many symbols; a minimizer's pieces are never parted.
COLLECTION = 1_200_000
#: A minimizer of more documents than this is parted by whole windows; raised with the corpus so that at most ``PARTED`` are broadcast.
HOT, PARTED = 50_000, 500_000
_LAST = shared.LAST
_SPACES = re.compile(rb"[\t-\r\x1c-\x20]+")


def pieces(data: np.ndarray, limits: np.ndarray, min_words: int = MIN_WORDS, gram: int = GRAM, hot: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
    """Pieces of texts: (text, minimizer, first word, windows), and the word starts, ends and limits. The windows of hot minimizers have their own hash instead."""
    gram = min(gram, min_words)
    starts, ends, lim = K.words(data, limits, K.SPACE)
    h = K.hashes(data, starts, ends)
    g = K.grams(h, gram)
    width = min_words - gram + 1
    low, size = g, 1
    while size * 2 <= width:  # least of windows of 2, 4, 8, ... grams
        low = np.minimum(low[: max(0, len(low) - size)], low[size:])
        size *= 2
    rest = width - size
    if rest:
        low = np.minimum(low[: max(0, len(low) - rest)], low[rest:])
    own = K.owner(lim)
    m = len(low)
    ok = own[:m] == own[min_words - 1 : min_words - 1 + m] if m else np.zeros(0, bool)
    at = np.flatnonzero(ok)
    if not len(at):
        none = np.zeros(0, np.int64)
        return none, np.zeros(0, np.uint64), none, none, starts, ends, lim
    low, text = low[at], own[at]
    if hot is not None and len(hot) and (parted := np.isin(low, hot)).any():
        low[parted] = K.mix(K.grams(h, min_words)[at[parted]])
    new = np.ones(len(at), bool)
    new[1:] = (low[1:] != low[:-1]) | (text[1:] != text[:-1])
    # a run longer than the width (a repeated minimizer) is cut, so that pieces stay short
    head = np.flatnonzero(new)
    offset = np.arange(len(at)) - np.repeat(head, np.diff(np.append(head, len(at))))
    head = np.flatnonzero(offset % width == 0)
    return text[head], low[head], at[head], np.diff(np.append(head, len(at))), starts, ends, lim


class Columns:
    """The collection's columns, in one sequential file per round in the shared folder."""

    KINDS = (("bwt", np.int32), ("lcp", np.int32), ("link", np.int32), ("piece", np.int32))

    def __init__(self, folder: str):
        self.system, base = shared.file_system(folder)
        self.base = f"{base}/bwt-{uuid.uuid4().hex}"
        self.system.create_dir(self.base)
        self.round, self.size = -1, 0

    def write(self, columns: list[np.ndarray]) -> None:
        with self.system.open_output_stream(f"{self.base}/{self.round + 1}") as out:
            for c, (_, kind) in zip(columns, self.KINDS):
                out.write(pa.py_buffer(np.ascontiguousarray(c, kind)))
        if self.round >= 0:
            self.system.delete_file(f"{self.base}/{self.round}")
        self.round, self.size = self.round + 1, len(columns[0])

    def read(self) -> list[np.ndarray]:
        with self.system.open_input_stream(f"{self.base}/{self.round}") as f:
            return [np.frombuffer(f.read(self.size * np.dtype(kind).itemsize), kind) for _, kind in self.KINDS]

    def close(self) -> None:
        self.system.delete_dir(self.base)


def _least(table: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Range minima over [a, b], a <= b, from a table of minima of windows of 1, 2, 4, ..."""
    level = np.frexp((b - a + 1).astype(np.float64))[1] - 1
    out = np.empty(len(a), np.int32)
    for k in np.unique(level):
        at = level == k
        out[at] = np.minimum(table[k][a[at]], table[k][b[at] - (1 << int(k)) + 1])
    return out


def collection_bwt(symbols: np.ndarray, limits: np.ndarray, columns: Columns) -> list[np.ndarray]:
    """[transform, common prefix with the suffix above, link, piece] of all suffixes of the pieces, in order.

    symbols are positive; 0 ends every piece, an earlier piece's end being the lesser, and ends don't count for common prefixes.
    link is the row of the suffix without its first symbol.
    """
    n = len(limits) - 1
    sizes = np.diff(limits)
    rows = np.arange(n, dtype=np.int64)  # of the pieces' last inserted suffixes
    last = np.where(sizes > 0, symbols[np.maximum(limits[1:] - 1, 0)] if len(symbols) else 0, 0)
    columns.write([last, np.zeros(n, np.int32), np.full(n, -1, np.int32), np.arange(n)])
    first = np.zeros(n, np.int64)  # first symbols by row; sorted, so runs stand for them
    for j in range(1, int(sizes.max(initial=0)) + 1):
        bwt, lcp, link, piece = columns.read()
        live = np.flatnonzero(sizes >= j)
        c = symbols[limits[live + 1] - j].astype(np.int64)
        p = rows[live]
        order = np.lexsort((p, c))
        live, c, p = live[order], c[order], p[order]
        # rows are ordered by (first symbol, link): place of the new ones among the old
        key = (first << 32) + link
        at = np.searchsorted(key, (c << 32) + p)
        table = [lcp]
        while 2 << (len(table) - 1) <= len(lcp):
            half = 1 << (len(table) - 1)
            table.append(np.minimum(table[-1][:-half], table[-1][half:]))
        # common prefix with the row above: an old one, or the new one before it
        size = len(at)
        above_link = np.where(at > 0, link[np.maximum(at - 1, 0)], -1).astype(np.int64)
        above_first = np.where(at > 0, first[np.maximum(at - 1, 0)], -1)
        mate = np.zeros(size, bool)
        mate[1:] = at[1:] == at[:-1]
        above_link[1:][mate[1:]] = p[:-1][mate[1:]]
        above_first[1:][mate[1:]] = c[:-1][mate[1:]]
        new_lcp = np.zeros(size, np.int32)
        same = np.flatnonzero(above_first == c)
        if len(same):
            new_lcp[same] = _least(table, above_link[same] + 1, p[same]) + 1
        # the old rows that now follow a new one
        tail = np.ones(size, bool)
        tail[:-1] = ~mate[1:]
        below = np.flatnonzero(tail & (at < len(bwt)))
        below = below[first[at[below]] == c[below]]
        lcp = lcp.copy()
        if len(below):
            lcp[at[below]] = _least(table, p[below] + 1, link[at[below]].astype(np.int64)) + 1
        # rows move down by what is inserted above them
        moved = np.searchsorted(at, np.arange(len(bwt)), "right")
        prev = np.where(sizes[live] > j, symbols[np.maximum(limits[live + 1] - j - 1, 0)], 0)
        shifted = lambda r: np.where(r >= 0, r + moved[np.maximum(r, 0)], -1)
        columns.write([np.insert(bwt, at, prev), np.insert(lcp, at, new_lcp), np.insert(shifted(link), at, shifted(p)), np.insert(piece, at, live)])
        first = np.insert(first, at, c)
        rows[live] = at + np.arange(size)
    return columns.read()


def suffix_sizes(link: np.ndarray) -> np.ndarray:
    """Symbols of each row's suffix."""
    size = np.zeros(len(link), np.int64)
    todo, at = np.flatnonzero(link >= 0), link.astype(np.int64)
    while len(todo):
        size[todo] += 1
        hop = at[todo]
        at[todo] = link[hop]
        todo = todo[at[todo] >= 0]
    return size


def repeated(symbols: np.ndarray, limits: np.ndarray, min_words: int, folder: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(window, piece, offset) of all windows of min_words symbols in the pieces; equal windows have one number."""
    columns = Columns(folder)
    try:
        _, lcp, link, piece = collection_bwt(symbols, limits, columns)
    finally:
        columns.close()
    size = suffix_sizes(link)
    at = np.flatnonzero(size >= min_words)
    # a shorter suffix between two rows has a shorter common prefix, so it ends an interval
    window = np.cumsum(lcp < min_words)[at]
    return window, piece[at].astype(np.int64), np.diff(limits)[piece[at]] - size[at]


def stretches(rows: list[tuple], min_words: int, folder: str) -> tuple[np.ndarray, ...]:
    """Repeated stretches of one collection: (row, first window, window after the last, keeper id, keeper h, keeper base), as arrays.

    rows: (id, h, place, many, text) of its distinct pieces: the first document and place of each, and whether another document has it. A window counts if two documents,
    told apart by (id, h), have it. Its keeper is its first place; the base of a stretch is the place that its piece would have there.
    """
    codes: dict[str, int] = {}
    flat: list[int] = []
    sizes = []
    for r in rows:
        w = [codes.setdefault(x, len(codes) + 1) for x in r[4].split(" ")]
        flat += w
        sizes.append(len(w))
    limits = np.concatenate([[0], np.cumsum(np.array(sizes, np.int64))])
    window, piece, offset = repeated(np.array(flat, np.int32), limits, min_words, folder)
    if not len(window):
        none = np.zeros(0, np.int64)
        return none, none, none, none, none, none
    ids, hs, places = (np.array([r[k] for r in rows], np.int64) for k in range(3))
    many = np.array([r[3] for r in rows], bool)
    order = np.lexsort((places[piece] + offset, hs[piece], ids[piece], window))
    window, piece, offset = window[order], piece[order], offset[order]
    new = np.ones(len(window), bool)
    new[1:] = window[1:] != window[:-1]
    begin, group = np.flatnonzero(new), np.cumsum(new) - 1
    first, last = piece[begin], piece[np.append(begin[1:], len(window)) - 1]
    across = (ids[first] != ids[last]) | (hs[first] != hs[last]) | np.logical_or.reduceat(many[piece], begin)
    keep = across[group]
    piece, offset, first, at = piece[keep], offset[keep], first[group][keep], offset[begin][group][keep]
    base = places[first] + at - offset
    order = np.lexsort((offset, piece))
    piece, offset, first, base = piece[order], offset[order], first[order], base[order]
    i, h = ids[first], hs[first]
    new = np.ones(len(piece), bool)
    new[1:] = (piece[1:] != piece[:-1]) | (offset[1:] != offset[:-1] + 1) | (i[1:] != i[:-1]) | (h[1:] != h[:-1]) | (base[1:] != base[:-1])
    a = np.flatnonzero(new)
    b = np.append(a[1:], len(piece)) - 1
    return piece[a], offset[a], offset[b[: len(a)]] + 1, i[a], h[a], base[a]


def repeats(docs: DataFrame, min_words: int = MIN_WORDS, gram: int = GRAM, broadcast_rows: int = 5_000, hot: int = HOT, parted: int = PARTED) -> DataFrame:
    """Passages of docs that repeat across documents: doc_id, start_word, end_word (exclusive), is_first, first_doc_id.

    A row is a stretch of one document in which every window of min_words words (any number from 1) also stands in another document. is_first: the
    stretch holds the first occurrences, those to keep; else first_doc_id has them. A document without such a passage has no row,
    so null, empty and short texts have none. Rows that repeat doc_id and text are one document; a null doc_id comes last. What repeats within one document only isn't reported.
    Other columns are ignored; doc_id must be an integer column.
    """
    if min_words < 1:
        raise ValueError(f"min_words must be 1 or more, not {min_words}")
    spark = docs.sparkSession
    folder = shared.folder(spark)
    key = {"id": shared.identifier(docs), "h": F.xxhash64(docs["text"]), "text": docs["text"]}
    base = docs.select(*[c.alias(n) for n, c in key.items()]).where("text is not null")

    def marks(parted_ones=None) -> DataFrame:
        def minimizers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            hot_ones = parted_ones.value if parted_ones else None
            for batch in batches:
                data, limits = K.buffers(batch.column(2))
                for a, b in K.chunks(limits):
                    text, low, *_ = pieces(data[limits[a] : limits[b]], limits[a : b + 1] - limits[a], min_words, gram, hot_ones)
                    order = np.lexsort((low, text))
                    text, low = text[order], low[order]
                    one = np.ones(len(low), bool)
                    one[1:] = (low[1:] != low[:-1]) | (text[1:] != text[:-1])
                    at = pa.array(text[one] + a)
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(low[one].view(np.int64))], names=["id", "h", "m"])

        return shared.written(base.mapInArrow(minimizers, "id bigint, h bigint, m bigint"), "marks")

    def common(m: DataFrame) -> DataFrame:
        """Minimizers of several documents and how many they are; the count is combined before the shuffle."""
        return shared.written(m.groupBy("m").agg(F.count(F.lit(1)).alias("docs")).where("docs > 1"), "common")

    marked = marks()
    several = common(marked)
    # of all minimizers' documents at most 1 / least can be of one that has more than least, so the list is bounded
    all_ = several.agg(F.sum("docs")).first()[0] or 0
    least = max(hot, all_ // parted)
    hottest = np.sort(np.array([r.m for r in several.where(F.col("docs") > least).select("m").collect()], np.int64).view(np.uint64))
    parted_ones = spark.sparkContext.broadcast(hottest) if len(hottest) else None
    if parted_ones:
        marked = marks(parted_ones)
        several = common(marked)
    # a document's list is bounded by its length
    wanted = shared.written(marked.join(several.select("m"), "m").groupBy("id", "h").agg(F.collect_set("m").alias("ms")), "minimizers")
    small = wanted.count() <= broadcast_rows
    texts = base.join(F.broadcast(wanted) if small else wanted, ["id", "h"]).select("id", "h", "text", "ms")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot_ones = parted_ones.value if parted_ones else None
        for batch in batches:
            data, limits = K.buffers(batch.column(2))
            lists = batch.column(3)
            at, values = np.asarray(lists.offsets), lists.values.to_numpy().view(np.uint64)
            for a, b in K.chunks(limits):
                part = data[limits[a] : limits[b]]
                text, low, start, count, starts, ends, _ = pieces(part, limits[a : b + 1] - limits[a], min_words, gram, hot_ones)
                # membership by (text, minimizer), both sides sorted
                own = np.repeat(np.arange(b - a), np.diff(at[a : b + 1])).astype(np.uint64)
                with np.errstate(over="ignore"):
                    have = np.unique(K.mix(values[at[a] : at[b]] + own * np.uint64(0x9E3779B97F4A7C15)))
                    ask = K.mix(low + text.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
                k = np.flatnonzero(np.isin(ask, have))
                if not len(k):
                    continue
                start, count, text, low = start[k], count[k], text[k], low[k]
                raw = part.tobytes()
                words = [_SPACES.sub(b" ", raw[starts[s] : ends[s + c + min_words - 2]]) for s, c in zip(start.tolist(), count.tolist())]
                keys = pa.array([blake2b(w, digest_size=16).digest() for w in words], pa.binary())
                first = np.searchsorted(starts, limits[a : b + 1] - limits[a])
                take = pa.array(text + a)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(take), batch.column(1).take(take), pa.array(low.view(np.int64)), keys, pa.array(start - first[text], pa.int64()), pa.array(count, pa.int64()), pa.array(words, pa.binary()).cast(pa.string())],
                    names=["id", "h", "m", "key", "start", "windows", "piece"],
                )

    found = shared.written(texts.mapInArrow(cut, "id bigint, h bigint, m bigint, key binary, start bigint, windows bigint, piece string"), "pieces", compression="zstd")
    document = F.struct("id", "h")
    distinct = found.groupBy("m", "key").agg(F.min(F.struct("id", "h", "start")).alias("f"), (F.min(document) != F.max(document)).alias("many"), F.min("windows").alias("windows"), F.min("piece").alias("piece"))
    distinct = distinct.select("m", "key", "f.id", "f.h", "f.start", "many", "windows", "piece")

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        keys: list[tuple[int, bytes]] = []
        size, last = 0, None

        def done() -> pa.RecordBatch:
            row, a, b, i, h, base = stretches(rows, min_words, folder)
            m, k = [keys[x][0] for x in row.tolist()], [keys[x][1] for x in row.tolist()]
            return pa.RecordBatch.from_arrays([pa.array(m, pa.int64()), pa.array(k, pa.binary()), *[pa.array(x, pa.int64()) for x in (a, b, i, h, base)]], names=["m", "key", "a", "b", "fid", "fh", "base"])

        for batch in batches:
            for m, k, i, h, s, many, c, t in zip(*[batch.column(x).to_pylist() for x in range(8)]):
                if m != last and size > COLLECTION:
                    yield done()
                    rows, keys, size = [], [], 0
                last = m
                size += c + min_words - 1
                rows.append((i, h, s, many, t))
                keys.append((m, k))
        if rows:
            yield done()

    solved = distinct.repartition("m").sortWithinPartitions("m", "key").mapInArrow(solve, "m bigint, key binary, a bigint, b bigint, fid bigint, fh bigint, base bigint")
    places = found.select("id", "h", "m", "key", "start").distinct().join(solved, ["m", "key"])
    parts = places.select(
        "id", "h", F.expr("start + a").alias("start"), F.expr(f"start + b + {min_words - 1}").alias("stop"), F.expr("id = fid and h = fh and start = base").alias("first"), F.col("fid").alias("first_id")
    )
    # passages that overlap or touch at a piece's end are one
    order = Window.partitionBy("id", "h", "first", "first_id").orderBy("start", "stop")
    islands = parts.withColumn("reach", F.max("stop").over(order.rowsBetween(Window.unboundedPreceding, -1))).withColumn("island", F.sum(F.when(F.col("start") <= F.col("reach"), 0).otherwise(1)).over(order))
    merged = islands.groupBy("id", "h", "first", "first_id", "island").agg(F.min("start").alias("start_word"), F.max("stop").alias("end_word"))
    none = lambda c: F.nullif(c, F.lit(_LAST))
    return merged.select(none(F.col("id")).alias("doc_id"), "start_word", "end_word", F.col("first").alias("is_first"), none(F.col("first_id")).alias("first_doc_id"))


def op2_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    return repeats(shared.table(spark, sf_dir, "documents").select("doc_id", "text"))


QUERIES = {"op2_suffix_dedup": op2_suffix_dedup}
SQL: dict[str, str] = {}

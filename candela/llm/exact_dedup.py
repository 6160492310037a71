"""Exact dedup by a log-structured merge index of content digests.

Memtables: each task gathers its (digest, identifier) entries, sorts and combines them, and flushes every ``MEMTABLE`` of them as a
sorted run, a Parquet file with a Bloom filter beside it, into the shared folder. Compaction is size-tiered: ``FAN`` runs of a level are merged
block by block, as they are sorted, to one run of the next level; it keeps the smallest identifier and the number of entries of each digest. A run of many entries is
parted by leading digest bits, each part a file and a task of its own, so merges need no shuffle and a task holds one block of each run. Lookups probe the filters
and open only the files whose filter says that they may have a digest. The index stays in its folder: another call can open it and look up another batch.

Digests with several entries are hits: only their rows are compared byte by byte with the kept row's text. A
digest that two different texts share costs time, never rows: its texts are then grouped by their bytes.

Tasks write files under names of their own and report them; only what is reported becomes part of the index, so a lost or repeated task leaves
an unused file and no more. The driver holds one line per file. Entries are 48 bytes, so the index is small against the texts. Hits are broadcast only when
their counted number fits ``broadcast_rows``; beyond it the join shuffles. A hot digest is one entry of each memtable, and a skewed join key with a
single row on the other side, which adaptive execution splits.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import asdict, dataclass

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import shared
from . import textkit as K

#: Entries of a memtable; runs that a merge takes; entries of one file of a run, about; entries of a block in a merge.
MEMTABLE, FAN, PART, BLOCK = 500_000, 8, 2_000_000, 65_536
_BITS, _HASHES = 12, 6  # of the filters: about 0.4 % false alarms
_LAST = shared.LAST
_SQL = """
SELECT doc_id, CASE WHEN text IS NULL THEN doc_id ELSE min(doc_id) OVER (PARTITION BY text) END AS keep_id,
       text IS NOT NULL AND doc_id <> min(doc_id) OVER (PARTITION BY text) AS is_duplicate
FROM documents
"""
_FILE = "path string, run string, level int, entries bigint, low binary, high binary"
_ENTRY = pa.schema([("digest", pa.binary()), ("keep_id", pa.int64()), ("n", pa.int64())])


def digest(text: Column, bits: int = 256) -> Column:
    """SHA-256, or its first bits (a multiple of 8), as binary."""
    return F.substring(F.unhex(F.sha2(text, 256)), 1, bits // 8)


@dataclass(frozen=True)
class File:
    """One file of a run: entries sorted by digest, from low to high (hexadecimal)."""

    path: str
    run: str
    level: int
    entries: int
    low: str
    high: str


Entries = tuple[np.ndarray, np.ndarray, np.ndarray]  # digests as fixed bytes, smallest identifiers, counts


def _digests(column: pa.Array) -> np.ndarray:
    """A column of digests of one length as numpy bytes, which sort and compare as the digests do."""
    data, limits = K.buffers(column)
    size = int(limits[1]) if len(column) else 1
    return np.frombuffer(data.tobytes(), f"S{size}")


def combined(parts: list[Entries]) -> Entries:
    """Entries sorted by digest, one for each: the smallest identifier and the sum of the counts."""
    d, i, n = (np.concatenate(x) for x in zip(*parts))
    order = np.argsort(d, kind="stable")
    d, i, n = d[order], i[order], n[order]
    first = np.ones(len(d), bool)
    first[1:] = d[1:] != d[:-1]
    at = np.flatnonzero(first)
    return (d[at], np.minimum.reduceat(i, at), np.add.reduceat(n, at)) if len(at) else (d, i, n)


def merged(runs: list[Iterator[Entries]]) -> Iterator[Entries]:
    """The k-way merge of sorted runs of distinct digests, block by block: all that is at most the least of the blocks' last digests is complete."""
    heads = [(next(r, None), r) for r in runs]
    live = [[h, r] for h, r in heads if h is not None]
    while live:
        cut = min(h[0][-1] for h, _ in live)
        parts = []
        for x in live:
            (d, i, n), r = x
            k = int(np.searchsorted(d, cut, "right"))
            parts.append((d[:k], i[:k], n[:k]))
            x[0] = (d[k:], i[k:], n[k:]) if k < len(d) else next(r, None)
        live = [x for x in live if x[0] is not None]
        yield combined(parts)


class Bloom:
    """A Bloom filter of digests, whose own bytes serve as hashes."""

    def __init__(self, bits: np.ndarray):
        self.bits = bits

    @staticmethod
    def _places(d: np.ndarray, size: int) -> Iterator[np.ndarray]:
        raw = np.frombuffer(d.tobytes(), np.uint8).reshape(len(d), d.dtype.itemsize)
        words = np.zeros((len(d), 16), np.uint8)
        words[:, : min(16, raw.shape[1])] = raw[:, -16:]
        a, b = K.mix(words.view(np.uint64)).T
        for k in range(_HASHES):
            with np.errstate(over="ignore"):
                yield (a + np.uint64(k) * (b | np.uint64(1))) % np.uint64(size)

    @classmethod
    def of(cls, blocks: list[np.ndarray]) -> Bloom:
        size = max(64, _BITS * sum(map(len, blocks)))
        bits = np.zeros(size, bool)
        for d in blocks:
            for at in cls._places(d, size):
                bits[at] = True
        return cls(bits)

    def may_have(self, d: np.ndarray) -> np.ndarray:
        hit = np.ones(len(d), bool)
        for at in self._places(d, len(self.bits)):
            hit &= self.bits[at]
        return hit

    def bytes(self) -> bytes:
        return len(self.bits).to_bytes(8, "little") + np.packbits(self.bits).tobytes()

    @classmethod
    def read(cls, data: bytes) -> Bloom:
        return cls(np.unpackbits(np.frombuffer(data, np.uint8, offset=8), count=int.from_bytes(data[:8], "little")).astype(bool))


def _write(folder: str, run: str, level: int, blocks: Iterator[Entries]) -> list[dict]:
    """Writes one file of a run and its filter; a line that tells of it, or none for no entries."""
    blocks = iter(blocks)
    first = next(blocks, None)
    if first is None:
        return []
    system, at = shared.file_system(f"{folder}/{uuid.uuid4().hex}.parquet")
    entries, last, keys = 0, first, []
    with system.open_output_stream(at) as out, pq.ParquetWriter(out, _ENTRY, write_statistics=["digest"]) as writer:
        block: Entries | None = first
        while block is not None:
            d, i, n = block
            data = pa.py_buffer(d.tobytes())
            limits = pa.py_buffer((np.arange(len(d) + 1, dtype=np.int32) * d.dtype.itemsize).tobytes())
            writer.write_batch(pa.RecordBatch.from_arrays([pa.BinaryArray.from_buffers(pa.binary(), len(d), [None, limits, data]), pa.array(i, pa.int64()), pa.array(n, pa.int64())], schema=_ENTRY))
            entries, last = entries + len(d), block
            keys.append(d)
            block = next(blocks, None)
    with system.open_output_stream(f"{at}.filter") as out:
        out.write(Bloom.of(keys).bytes())
    fixed = first[0].dtype.itemsize
    return [{"path": at, "run": run, "level": level, "entries": entries, "low": first[0][0].ljust(fixed, b"\0"), "high": last[0][-1].ljust(fixed, b"\0")}]


def _read(system, path: str, low: bytes, high: bytes | None, opened: list[str] | None = None) -> Iterator[Entries]:
    """Blocks of a file with low <= digest < high; row groups beyond are skipped by their statistics."""
    if opened is not None:
        opened.append(path)
    with system.open_input_file(path) as f:
        file = pq.ParquetFile(f)
        for g in range(file.num_row_groups):
            stats = file.metadata.row_group(g).column(0).statistics
            if stats is not None and stats.has_min_max and (stats.max < low or (high is not None and stats.min >= high)):
                continue
            for batch in file.iter_batches(BLOCK, row_groups=[g]):
                d, i, n = _digests(batch.column(0)), batch.column(1).to_numpy(), batch.column(2).to_numpy()
                a = int(np.searchsorted(d, np.bytes_(low))) if low else 0
                b = int(np.searchsorted(d, np.bytes_(high))) if high is not None else len(d)
                if a < b:
                    yield d[a:b], i[a:b], n[a:b]


class DigestIndex:
    """Sorted runs of (digest, keep_id, n) in levels in one folder, with a list of their files; an index that is there is opened."""

    def __init__(self, spark: SparkSession, path: str, memtable: int = MEMTABLE, fan: int = FAN, part: int = PART):
        self.spark, self.path, self.memtable, self.fan, self.part = spark, path, memtable, fan, part
        self.system, self.folder = shared.file_system(path)
        self.system.create_dir(self.folder)
        self.files: list[File] = []
        lists = sorted(x.path for x in self.system.get_file_info(shared.selector(self.folder)) if x.path.endswith(".list"))
        if lists:
            with self.system.open_input_stream(lists[-1]) as f:
                self.files = [File(**x) for x in json.loads(f.read())]
        self.version = len(lists)

    def _commit(self, files: list[File]) -> None:
        """The next list of files is written whole; a reader sees the former or the next one."""
        self.files, self.version = files, self.version + 1
        name = f"{self.folder}/{self.version:08d}"
        with self.system.open_output_stream(f"{name}.tmp") as out:
            out.write(json.dumps([asdict(f) for f in files]).encode())
        self.system.move(f"{name}.tmp", f"{name}.list")

    @staticmethod
    def _told(lines: DataFrame) -> list[File]:
        return [File(r["path"], r["run"], r["level"], r["entries"], r["low"].hex(), r["high"].hex()) for r in lines.collect()]

    def flush(self, entries: DataFrame) -> None:
        """Adds (digest, id) entries, none of them null; every memtable leaves a sorted run of level 0."""
        path, most = self.path, self.memtable

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: list[Entries] = []
            size = 0

            def out() -> Iterator[pa.RecordBatch]:
                lines = _write(path, uuid.uuid4().hex, 0, blocks_of(combined(held)))
                yield pa.RecordBatch.from_pylist(lines, schema)

            for batch in batches:
                if batch.num_rows:
                    d = _digests(batch.column(0))
                    held.append((d, batch.column(1).to_numpy(), np.ones(len(d), np.int64)))
                    size += len(d)
                if size >= most:
                    held = [combined(held)]
                    size = len(held[0][0])
                    if size >= most // 2:
                        yield from out()
                        held, size = [], 0
            if size:
                yield from out()

        schema = _lines_schema()
        self._commit([*self.files, *self._told(entries.select("digest", "id").mapInArrow(run, _FILE))])

    def _merge(self, groups: list[list[File]], level: int) -> list[File]:
        """A run of the given level from each group of files, in one job; a run has a part, and a task, for about ``part`` entries, by the leading digest bits."""
        works, path = [], self.path
        for files in groups:
            run, size = uuid.uuid4().hex, len(files[0].low) // 2
            bits = min(size * 8, (sum(f.entries for f in files) // self.part).bit_length())
            limits = [(k << (size * 8 - bits)).to_bytes(size, "big") for k in range(1 << bits)]
            for low, high in zip(limits, [*limits[1:], None]):
                of = [f.path for f in files if f.high >= low.hex() and (high is None or f.low < high.hex())]
                if of:
                    works.append((run, of, low, high))

        def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            system, _ = shared.file_system(path)
            for batch in batches:
                for run, paths, low, high in zip(*[c.to_pylist() for c in batch.columns]):
                    yield pa.RecordBatch.from_pylist(_write(path, run, level, merged([_read(system, p, low, high) for p in paths])), schema)

        schema = _lines_schema()
        tasks = self.spark.createDataFrame(works, "run string, paths array<string>, low binary, high binary").repartition(max(1, len(works)))
        return self._told(tasks.mapInArrow(go, _FILE))

    def runs(self, level: int) -> dict[str, list[File]]:
        out: dict[str, list[File]] = {}
        for f in self.files:
            if f.level == level:
                out.setdefault(f.run, []).append(f)
        return out

    def compact(self, fully: bool = False) -> None:
        """Merges each ``fan`` runs of a level to one of the next, level by level; fully: then all that is left to a single run."""
        level = 0
        while level <= max((f.level for f in self.files), default=-1):
            runs = sorted(self.runs(level).values(), key=lambda fs: fs[0].run)
            groups = [[f for fs in runs[k : k + self.fan] for f in fs] for k in range(0, len(runs) // self.fan * self.fan, self.fan)]
            if groups:
                self._replace([f for g in groups for f in g], self._merge(groups, level + 1))
            level += 1
        if fully and len({f.run for f in self.files}) > 1:
            self._replace(list(self.files), self._merge([list(self.files)], level))

    def _replace(self, old: list[File], new: list[File]) -> None:
        gone = {f.path for f in old}
        self._commit([f for f in self.files if f.path not in gone] + new)
        for p in gone:  # after the commit; a reader of the former list must be done
            self.system.delete_file(p)
            self.system.delete_file(f"{p}.filter")

    def several(self) -> DataFrame:
        """(digest, keep_id, n) of the digests with several entries; the index must be fully compacted."""
        if len({f.run for f in self.files}) > 1:
            raise ValueError("compact(fully=True) first")
        if not self.files:
            return self.spark.createDataFrame([], "digest binary, keep_id bigint, n bigint")
        return self.spark.read.schema("digest binary, keep_id bigint, n bigint").parquet(*[shared.address(self.path, f.path) for f in self.files]).where("n > 1")

    def lookup(self, digests: DataFrame) -> DataFrame:
        """(digest, keep_id) of those digests (a column digest, none null) that the index has, the smallest identifier of all runs.

        Digests are spread by their first bytes and sorted, so that a batch meets the files of a narrow range; the filters of these are probed, and a file that may have one is opened.
        """
        files, path = list(self.files), self.path
        if not files:
            return self.spark.createDataFrame([], "digest binary, keep_id bigint")
        listed = self.spark.sparkContext.broadcast(files)

        def as_column(d: np.ndarray) -> pa.Array:
            return pa.array([x.ljust(d.dtype.itemsize, b"\0") for x in d.tolist()], pa.binary())

        def distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    yield pa.RecordBatch.from_arrays([as_column(np.unique(_digests(batch.column(0))))], names=["digest"])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    d, i, _ = search(path, listed.value, np.unique(_digests(batch.column(0))))
                    yield pa.RecordBatch.from_arrays([as_column(d), pa.array(i, pa.int64())], names=["digest", "keep_id"])

        wanted = digests.select("digest").mapInArrow(distinct, "digest binary").repartition(F.substring("digest", 1, 2)).sortWithinPartitions("digest")
        return wanted.mapInArrow(run, "digest binary, keep_id bigint").groupBy("digest").agg(F.min("keep_id").alias("keep_id"))


def blocks_of(e: Entries) -> Iterator[Entries]:
    d, i, n = e
    for k in range(0, len(d), BLOCK):
        yield d[k : k + BLOCK], i[k : k + BLOCK], n[k : k + BLOCK]


def _lines_schema() -> pa.Schema:
    return pa.schema([("path", pa.string()), ("run", pa.string()), ("level", pa.int32()), ("entries", pa.int64()), ("low", pa.binary()), ("high", pa.binary())])


def search(path: str, files: list[File], wanted: np.ndarray, opened: list[str] | None = None) -> Entries:
    """The entries of sorted distinct digests in the files; a file is opened only if its filter may have one of them."""
    system, _ = shared.file_system(path)
    size = wanted.dtype.itemsize
    found: list[Entries] = [(wanted[:0], np.zeros(0, np.int64), np.zeros(0, np.int64))]
    for f in files:
        a, b = np.searchsorted(wanted, np.bytes_(bytes.fromhex(f.low))), np.searchsorted(wanted, np.bytes_(bytes.fromhex(f.high)), "right")
        if a >= b:
            continue
        with system.open_input_stream(f"{f.path}.filter") as stream:
            mine = wanted[a:b][Bloom.read(stream.read()).may_have(wanted[a:b])]
        if not len(mine):
            continue
        for d, i, n in _read(system, f.path, mine[0].ljust(size, b"\0"), None, opened):
            if d[0] > mine[-1]:
                break
            at = np.minimum(np.searchsorted(d, mine), len(d) - 1)
            hit = d[at] == mine
            found.append((d[at[hit]], i[at[hit]], n[at[hit]]))
    return combined(found)


def mark(docs: DataFrame, bits: int = 256, broadcast_rows: int = 400_000, index: DigestIndex | None = None, earlier: DataFrame | None = None) -> DataFrame:
    """Every row of docs as struct ``row``, with keep_id, and is_duplicate: whether exact dedup drops it.

    keep_id is the smallest doc_id of the rows with the same text; a null doc_id comes last. Of rows that repeat
    both doc_id and text one is not a duplicate. A null text equals no other; the empty text is a text. No row is lost.
    doc_id must be an integer column; other columns may have any name and type.

    index and earlier: an index of earlier batches and their rows (doc_id, text). A row whose text one of them has is a duplicate, and keep_id the smallest
    doc_id of all; the batch's digests join the index. Without them the index is a new one in the shared folder.
    """
    spark = docs.sparkSession
    keyed = docs.select(
        F.struct(*[docs[c] for c in docs.columns]).alias("row"), docs["text"].alias("text"), shared.identifier(docs).alias("id"), digest(docs["text"], bits).alias("digest"),
    )
    entries = keyed.where("digest is not null").select("digest", "id")
    old = None
    if index is not None and index.files:
        if earlier is None:
            raise ValueError("the texts of the earlier batches are needed to verify hits")
        old = shared.written(index.lookup(entries), "known")
        # bytes decide: earlier rows of the digests found, with their texts, one row for each text
        texts = earlier.select(shared.identifier(earlier).alias("old_id"), earlier["text"].alias("old_text"), digest(earlier["text"], bits).alias("digest")).where("digest is not null")
        old = shared.written(texts.join(old.select("digest"), "digest").groupBy("digest", "old_text").agg(F.min("old_id").alias("old_id")), "known-texts")
    batch = DigestIndex(spark, shared.scratch(spark, "digests"))
    batch.flush(entries)
    batch.compact(fully=True)
    hits = batch.several().select("digest", "keep_id")
    small = hits.count() <= broadcast_rows
    joined = keyed.join(F.broadcast(hits) if small else hits, "digest", "left")
    alone = joined.where("keep_id is null").select("row", "id", F.col("id").alias("keep_id"), F.lit(False).alias("is_duplicate"))

    hit = joined.where("keep_id is not null")
    # the kept text of each digest; one row per digest, so a hot digest stays on the other side of the join
    kept = hit.where("id = keep_id").groupBy("digest").agg(F.min("text").alias("kept_text"))
    checked = hit.join(kept, "digest").withColumn("same", F.expr("text = kept_text")).drop("kept_text")
    others = checked.where("same and id <> keep_id").select("row", "id", "keep_id", F.lit(True).alias("is_duplicate"))
    first = Window.partitionBy("digest").orderBy(shared.in_order("row"))
    keepers = checked.where("same and id = keep_id").withColumn("k", F.row_number().over(first)).select("row", "id", "keep_id", F.expr("k > 1").alias("is_duplicate"))
    # digest collisions: grouped by their bytes
    byte = Window.partitionBy("digest", "text").orderBy("id", shared.in_order("row"))
    collided = checked.where("not same").select("row", "id", F.first("id").over(byte).alias("keep_id"), (F.row_number().over(byte) > 1).alias("is_duplicate"))
    found = alone.unionByName(others).unionByName(keepers).unionByName(collided)
    if old is not None:
        mine = found.withColumn("digest", digest(F.col("row.text"), bits)).withColumn("text", F.col("row.text"))
        one = old.withColumnsRenamed({"digest": "old_digest"})
        found = mine.join(one, F.expr("digest = old_digest and text = old_text"), "left").select(
            "row", F.least("keep_id", F.coalesce("old_id", "keep_id")).alias("keep_id"), F.expr("is_duplicate or old_text is not null").alias("is_duplicate")
        )
    if index is not None:
        index.flush(entries)
        index.compact()
    return found.select("row", F.nullif("keep_id", F.lit(_LAST)).alias("keep_id"), "is_duplicate")


def exact_dedup(docs: DataFrame, **settings) -> DataFrame:
    """The rows of docs that exact dedup keeps, columns unchanged (see mark)."""
    return mark(docs, **settings).where("not is_duplicate").select("row.*")


def op4_exact_dedup(spark, sf_dir: str) -> DataFrame:
    docs = shared.table(spark, sf_dir, "documents").select("doc_id", "text")
    return mark(docs).select("row.doc_id", "keep_id", "is_duplicate")


QUERIES = {"op4_exact_dedup": op4_exact_dedup}
SQL = {"op4_exact_dedup": _SQL}

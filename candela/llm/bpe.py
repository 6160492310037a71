"""BPE encoding and decoding by a pair occurrence index.

The distinct pretokens of an Arrow batch form one array of symbols with links to their neighbours. An index maps each mergeable
pair, by its rank, to all its positions in the batch. Ranks that occur are applied in ascending order: all
positions of the pair are merged at once, and the pairs that arise at their neighbours join the lists of their own ranks. So the
cost follows the distinct pretokens and the ranks in use, not the words of the corpus; texts are then put together from the encoded pretokens.
The vocabulary is read from a file with merges (a tokenizers JSON of byte-level BPE) and is never trained here.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator
from functools import lru_cache
from itertools import compress, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared
from . import textkit as K
from .token_counts import PATTERN

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.json"
#: With more encoded pretokens than this, a worker forgets the less used half or more before the next run of rows.
CACHE = 150_000
#: Pretokens in one index, at most; bounds its memory.
INDEXED = 60_000
_NONE = np.int32(2**31 - 1)


def _byte_chars() -> dict[str, int]:
    """The printable stand-ins of byte-level vocabularies: printable Latin-1 bytes stand for themselves, the others follow from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = {chr(b): b for b in own}
    for i, b in enumerate(b for b in range(256) if b not in own):
        out[chr(256 + i)] = b
    return out


class Vocabulary:
    """Merges as sorted pair keys with rank and product, and the bytes of every id."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        ids, back = model["vocab"], _byte_chars()
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        keys = np.array([ids[a] << 32 | ids[b] for a, b in pairs], np.int64)
        made = np.array([ids[a + b] for a, b in pairs], np.int32)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], np.arange(len(keys), dtype=np.int32)[order]
        self.made, self.pair_of_rank = made, keys
        self.of_byte = np.zeros(256, np.int32)
        self.bytes = [b""] * (max(ids.values()) + 1)
        for token, i in ids.items():
            raw = [back.get(c) for c in token]
            self.bytes[i] = bytes(raw) if None not in raw else token.encode()
            if len(token) == 1 and None not in raw:
                self.of_byte[raw[0]] = i
        self.limits = np.concatenate([[0], np.cumsum([len(b) for b in self.bytes])]).astype(np.int64)
        self.flat = np.frombuffer(b"".join(self.bytes), np.uint8)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = (left.astype(np.int64) << 32) | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], _NONE)


@lru_cache(2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def encode_one(v: Vocabulary, symbols: list[int]) -> list[int]:
    """Merges the pair of the lowest rank, the leftmost first, until none is left."""
    rank = dict(zip(v.keys.tolist(), v.ranks.tolist()))
    while len(symbols) > 1:
        best, at = min((rank.get(a << 32 | b, _NONE), i) for i, (a, b) in enumerate(zip(symbols, symbols[1:])))
        if best == _NONE:
            break
        symbols[at : at + 2] = [int(v.made[best])]
    return symbols


def encode_pretokens(v: Vocabulary, pretokens: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Token ids of all pretokens, one after the other, and their n+1 limits."""
    sizes = np.fromiter(map(len, pretokens), np.int64, len(pretokens))
    limits = np.concatenate([[0], np.cumsum(sizes)])
    total = int(limits[-1])
    if not total:
        return np.zeros(0, np.int32), limits
    symbols = v.of_byte[np.frombuffer(b"".join(pretokens), np.uint8)]
    after = np.arange(1, total + 1, dtype=np.int32)
    after[limits[1:][sizes > 0] - 1] = -1
    before = np.arange(-1, total - 1, dtype=np.int32)
    before[limits[:-1][sizes > 0]] = -1
    alive = np.ones(total, bool)
    odd: set[int] = set()

    index: dict[int, list[np.ndarray]] = {}
    active: list[int] = []

    def add(at: np.ndarray, floor: int) -> None:
        """Puts the pairs that begin at these positions into the lists of their ranks."""
        ranks = v.rank(symbols[at], symbols[after[at]])
        ok = ranks != _NONE
        if not ok.all():
            at, ranks = at[ok], ranks[ok]
        if not len(at):
            return
        if int(ranks.min()) < floor:  # no trained vocabulary does this; such pretokens are done one by one
            odd.update((np.searchsorted(limits, at[ranks < floor], "right") - 1).tolist())
        order = np.argsort(ranks, kind="stable")
        at, ranks = at[order], ranks[order]
        cuts = np.flatnonzero(ranks[1:] != ranks[:-1]) + 1
        start = 0
        for stop in [*cuts.tolist(), len(at)]:
            r = int(ranks[start])
            if r in index:
                index[r].append(at[start:stop])
            else:
                index[r] = [at[start:stop]]
                heapq.heappush(active, r)
            start = stop

    add(np.flatnonzero(after >= 0).astype(np.int32), -1)
    while active:
        r = heapq.heappop(active)
        lists = index.pop(r)
        at = lists[0] if len(lists) == 1 else np.unique(np.concatenate(lists))
        left, right = divmod(int(v.pair_of_rank[r]), 1 << 32)
        nxt = after[at]
        at = at[alive[at] & (symbols[at] == left) & (nxt >= 0) & (symbols[nxt] == right)]
        if left == right and len(at) > 1:  # runs: every second one, from the left
            at = np.sort(at)
            starts = np.ones(len(at), bool)
            starts[1:] = after[at[:-1]] != at[1:]
            first = np.maximum.accumulate(np.where(starts, np.arange(len(at)), 0))
            at = at[(np.arange(len(at)) - first) % 2 == 0]
        if not len(at):
            continue
        gone = after[at]
        symbols[at] = v.made[r]
        alive[gone] = False
        nxt = after[gone]
        after[at] = nxt
        has = nxt >= 0
        before[nxt[has]] = at[has]
        prev = before[at]
        add(np.unique(np.concatenate([at[has], prev[prev >= 0]])), r)

    counts = np.add.reduceat(np.concatenate([alive, [False]]).astype(np.int64), np.minimum(limits[:-1], total))
    counts[sizes == 0] = 0
    out = symbols[alive]
    ends = np.concatenate([[0], np.cumsum(counts)])
    if odd:
        parts = [out[ends[i] : ends[i + 1]] for i in range(len(pretokens))]
        for i in odd:
            parts[i] = np.array(encode_one(v, v.of_byte[np.frombuffer(pretokens[i], np.uint8)].tolist()), np.int32)
        ends = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
        out = np.concatenate(parts)
    return out, ends


def ragged(values: np.ndarray, limits: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pieces of values with the given numbers, one after the other, and their sizes."""
    sizes = (limits[1:] - limits[:-1])[which]
    ends = np.cumsum(sizes)
    at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(limits[which] - (ends - sizes), sizes)
    return values[at], sizes


class Encoder:
    """Encodes batches of texts; keeps the pretokens that it has met, about CACHE of them at most, however many a batch has."""

    def __init__(self, path: str, pattern: str = PATTERN):
        import regex

        self.v, self.split = vocabulary(path), regex.compile(pattern).findall
        self.known: dict[str, int] = {}
        self.values, self.limits, self.uses = np.zeros(0, np.int32), np.zeros(1, np.int64), np.zeros(0, np.int64)

    def __call__(self, texts: pa.Array, most: int = 1_000_000) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """(first row, last row + 1, ids, limits by row) for runs of rows with about ``most`` bytes."""
        known, runs = self.known, []
        _, sizes = K.buffers(texts)
        for a, b in K.chunks(sizes, most):
            if not runs and len(known) > CACHE:
                known = self._forget(CACHE // 2)
            old, numbers, counts = len(known), [], []
            for i in range(a, b):
                parts = self.split(texts[i].as_py() or "")
                counts.append(len(parts))
                numbers.append(np.fromiter((known.setdefault(p, len(known)) for p in parts), np.int32, len(parts)))
            runs.append((a, b, np.concatenate(numbers) if numbers else np.zeros(0, np.int32), np.array(counts, np.int64)))
            if len(known) - (len(self.limits) - 1) + len(known) - old > INDEXED:  # one more such run wouldn't fit into an index
                yield from self._put(runs)
                runs = []
        yield from self._put(runs)

    def _forget(self, keep: int) -> dict[str, int]:
        """Keeps the pretokens that were used most."""
        kept = np.zeros(len(self.known), bool)
        kept[np.argsort(-self.uses, kind="stable")[:keep]] = True
        self.known = {p: i for i, p in enumerate(compress(self.known, kept.tolist()))}
        self.values, sizes = ragged(self.values, self.limits, np.flatnonzero(kept))
        self.limits, self.uses = np.concatenate([[0], np.cumsum(sizes)]), self.uses[kept]
        return self.known

    def _put(self, runs: list) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """Encodes the pretokens that are new, and gives the runs."""
        fresh = list(islice(self.known, len(self.limits) - 1, None))
        for i in range(0, len(fresh), INDEXED):
            values, limits = encode_pretokens(self.v, [p.encode() for p in fresh[i : i + INDEXED]])
            self.values = np.concatenate([self.values, values])
            self.limits = np.concatenate([self.limits, self.limits[-1] + limits[1:]])
        old, self.uses = self.uses, np.bincount(np.concatenate([np.zeros(0, np.int32), *(numbers for _, _, numbers, _ in runs)]), minlength=len(self.known))
        self.uses[: len(old)] += old
        for a, b, numbers, counts in runs:
            ids, sizes = ragged(self.values, self.limits, numbers)
            by_word = np.concatenate([[0], np.cumsum(sizes)])
            yield a, b, ids, by_word[np.concatenate([[0], np.cumsum(counts)])]


def decode_ids(v: Vocabulary, ids: np.ndarray, limits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all ids, and their limits by row."""
    data, sizes = ragged(v.flat, v.limits, ids)
    return data, np.concatenate([[0], np.cumsum(sizes)])[limits]


def encode(docs: DataFrame, path: str = VOCABULARY, pattern: str = PATTERN, carry: list[str] | None = None) -> DataFrame:
    """Each row of docs (its columns named in carry, or all) as struct ``row`` with tokens (array<int>), n_tokens, and round_trip: whether they decode to the text.

    A null text has null in all three, an empty one no tokens. Texts are encoded whole; special tokens' strings are ordinary text.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from encoded(batches)
        K.release()  # the encoder and the last batch are gone by now

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(at_task(), pattern)
        for batch in batches:
            text = batch.column(1)
            data, at = K.buffers(text)
            for a, b, ids, limits in encoder(text):
                null = np.asarray(text.slice(a, b - a).is_null())
                back, ends = decode_ids(encoder.v, ids, limits)
                want = data[at[a] : at[b]]
                same = np.diff(ends) == np.diff(at[a : b + 1])
                if len(back) == len(want) and same.all():
                    wrong = np.flatnonzero(back != want)
                    same[np.searchsorted(ends, wrong, "right") - 1] = False
                else:
                    same &= np.array([np.array_equal(back[ends[i] : ends[i + 1]], want[at[a + i] - at[a] : at[a + i + 1] - at[a]]) for i in range(b - a)], bool)
                tokens = pa.ListArray.from_arrays(pa.array(limits, pa.int32()), pa.array(ids, pa.int32()), mask=pa.array(null))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), tokens, pa.array(np.diff(limits), pa.int64(), mask=null), pa.array(same, mask=null)], names=["row", "tokens", "n_tokens", "round_trip"])

    at_task = shared.shipped(docs.sparkSession, path)
    row = docs.select(F.struct(*[docs[c] for c in (docs.columns if carry is None else carry)]).alias("row"), docs["text"].alias("text"))
    kind = row.schema["row"].dataType.simpleString()
    return row.mapInArrow(run, f"row {kind}, tokens array<int>, n_tokens bigint, round_trip boolean")


def decode(rows: DataFrame, path: str = VOCABULARY, column: str = "tokens") -> DataFrame:
    """The texts of an array<int> column, as one column text, row by row; null for null. Bytes that aren't UTF-8 become replacement characters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(at_task())
        for batch in batches:
            tokens = batch.column(0)
            out = []
            for i in range(len(tokens)):
                out.append(b"".join([v.bytes[t] for t in tokens[i].as_py()]).decode("utf-8", "replace") if tokens[i].is_valid else None)
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], names=["text"])

    at_task = shared.shipped(rows.sparkSession, path)
    return rows.select(rows[column].alias("tokens")).mapInArrow(run, "text string")


def op6_bpe(spark, sf_dir: str) -> DataFrame:
    docs = shared.table(spark, sf_dir, "documents").select("doc_id", "text")
    return encode(docs, carry=["doc_id"]).select("row.doc_id", "tokens", "n_tokens", "round_trip")


QUERIES = {"op6_bpe": op6_bpe}
SQL: dict[str, str] = {}

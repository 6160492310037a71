"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Words are runs of letters and digits without ASCII case. Features of a text are the set of hashes
(``bits`` wide) of its words, word pairs and pairs with one word between. Training runs in one task over
a bounded sample of labelled rows (``most`` rows and ``most_features`` features, those with the lowest hash of their identifier), with
a learning rate for each coordinate and L1 sparsity. The model is its non-zero weights, at most 2**bits of
them, and usually some hundreds; scoring broadcasts them and is one pass over the documents without a shuffle. The settings were chosen on a held-out fifth of the
labelled documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, StructField, StructType

from . import shared
from . import textkit as K


@dataclass(frozen=True)
class Settings:
    bits: int = 20
    alpha: float = 2.0
    beta: float = 1.0
    l1: float = 4.0
    l2: float = 1.0
    epochs: int = 3
    #: Bound on the labelled rows that are fitted; the least hashes of (doc_id, 7) are taken.
    most: int = 24_000
    #: Bound on their features in all, 4 bytes each in the task that learns; rows are taken in the same order until the next would exceed it.
    most_features: int = 40_000_000
    threshold: float = 0.4


_KINDS = ((1, 1), (2, 1), (2, 2))


def features(data: np.ndarray, limits: np.ndarray, bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each kind of feature: hashes and the texts that have them; repeats are the caller's."""
    starts, ends, lim = K.words(data, limits, K.NOT_WORD)
    h = K.hashes(data, starts, ends, fold=True)
    own = K.owner(lim)
    for kind, (n, step) in enumerate(_KINDS):
        g = K.grams(h, n, step)
        o = own[: len(g)]
        ok = o == own[(n - 1) * step :]
        with np.errstate(over="ignore"):
            g = K.mix(g + np.uint64(kind * 0x51ED27))
        yield (g >> np.uint64(64 - bits)).astype(np.int64)[ok], o[ok]


def fit(rows: list[tuple[np.ndarray, int]], s: Settings) -> tuple[np.ndarray, np.ndarray, float]:
    """FTRL-proximal over (feature indices, label) rows: indices and values of the non-zero weights, and the bias."""
    size = (1 << s.bits) + 1  # the last is the bias, without L1
    z, n = np.zeros(size), np.zeros(size)
    for _ in range(s.epochs):
        for x, y in rows:
            zx, nx = z[x], n[x]
            w = np.where(np.abs(zx) <= s.l1, 0.0, -(zx - np.sign(zx) * s.l1) / ((s.beta + np.sqrt(nx)) / s.alpha + s.l2))
            b = -z[-1] / ((s.beta + np.sqrt(n[-1])) / s.alpha + s.l2)
            g = 1 / (1 + np.exp(-np.clip(w.sum() + b, -35, 35))) - y
            root = np.sqrt(nx + g * g)
            z[x] = zx + g - (root - np.sqrt(nx)) / s.alpha * w
            n[x] = nx + g * g
            z[-1] += g - (np.sqrt(n[-1] + g * g) - np.sqrt(n[-1])) / s.alpha * b
            n[-1] += g * g
    at = np.flatnonzero(np.abs(z[:-1]) > s.l1)
    w = -(z[at] - np.sign(z[at]) * s.l1) / ((s.beta + np.sqrt(n[at])) / s.alpha + s.l2)
    return at, w, float(-z[-1] / ((s.beta + np.sqrt(n[-1])) / s.alpha + s.l2))


def train(docs: DataFrame, labels: DataFrame, s: Settings = Settings()) -> dict[int, float]:
    """Weights by feature; -1 is the bias.

    Rows with a null text, identifier or label are left out; a document labelled twice with both values counts as toxic. Of documents that share an identifier each is a row.
    Without labelled rows the model is empty and all scores are 0.
    """
    truth = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    # bounded: at most s.most rows, chosen by hash before any text moves
    there = docs.where("text is not null and doc_id is not null").select("doc_id")
    chosen = truth.join(there, "doc_id", "left_semi").withColumn("h", F.xxhash64("doc_id", F.lit(7))).orderBy("h", "doc_id").limit(s.most)
    sample = docs.where("text is not null").select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("h", "doc_id", F.col("toxic").cast("int").alias("toxic"), "text")

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, limits = K.buffers(batch.column(3))
            out = []
            for a, b in K.chunks(limits):
                l = limits[a : b + 1] - limits[a]
                f, o = (np.concatenate(p) for p in zip(*features(data[limits[a] : limits[b]], l, s.bits)))
                both = np.unique((o << s.bits) | f)
                f, o = both & ((1 << s.bits) - 1), both >> s.bits
                lim = np.searchsorted(o, np.arange(b - a + 1))
                out += [f[lim[i] : lim[i + 1]].astype(np.int32) for i in range(b - a)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(out, pa.list_(pa.int32()))], names=["h", "doc_id", "toxic", "x"])

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size, full = [], 0, False
        for batch in batches:
            y = batch.column(2).to_pylist()
            x = batch.column(3)
            for i in range(len(y)):
                f = x[i].values.to_numpy()
                full = full or len(rows) >= s.most or (bool(rows) and size + len(f) > s.most_features)
                if full:
                    break
                rows.append((f.copy(), y[i]))
                size += len(f)
        if rows:
            at, w, b = fit(rows, s)
            rows.clear()
            K.release()
            yield pa.RecordBatch.from_arrays([pa.array([*at.tolist(), -1], pa.int64()), pa.array([*w.tolist(), b], pa.float64())], names=["feature", "weight"])

    indexed = sample.mapInArrow(index, "h bigint, doc_id bigint, toxic int, x array<int>")
    # at most s.most rows in the one task that learns, in an order that doesn't depend on the partitions
    model = indexed.repartition(1).sortWithinPartitions("h", "doc_id", "x").mapInArrow(learn, "feature bigint, weight double")
    return {r.feature: r.weight for r in model.collect()}  # bounded by 2**bits + 1


def score(docs: DataFrame, weights: dict[int, float], s: Settings = Settings()) -> DataFrame:
    """docs and two columns: toxicity (probability, null for a null text) and toxic (toxicity >= threshold, false for null).

    An empty text gets the bias alone. Columns of docs that are called toxicity or toxic are replaced.
    """
    bias = weights.get(-1, -35.0)
    table = np.zeros(1 << s.bits, np.float32)
    for k, v in weights.items():
        if k >= 0:
            table[k] = v
    packed = docs.sparkSession.sparkContext.broadcast((np.flatnonzero(table).astype(np.int32), table[np.flatnonzero(table)]))
    size = 1 << s.bits

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, w = packed.value
        table = np.zeros(size, np.float32)
        table[at] = w
        for batch in batches:
            k = batch.schema.get_field_index("text")
            text = batch.column(k)
            data, limits = K.buffers(text)
            total = np.full(len(text), bias)
            for a, b in K.chunks(limits):
                l = limits[a : b + 1] - limits[a]
                for f, o in features(data[limits[a] : limits[b]], l, s.bits):
                    hit = table[f] != 0
                    both = np.unique((o[hit] << s.bits) | f[hit])
                    total[a:b] += np.bincount(both >> s.bits, table[both & (size - 1)], b - a)
            p = pa.array(1 / (1 + np.exp(-np.clip(total, -35, 35))), pa.float64(), mask=np.asarray(text.is_null()) if text.null_count else None)
            toxic = pa.array(np.nan_to_num(p.to_numpy(zero_copy_only=False), nan=0.0) >= s.threshold)
            yield pa.RecordBatch.from_arrays([*batch.columns, p, toxic], names=[*batch.schema.names, "toxicity", "toxic"])

    kept = docs.select(*[docs[c] for c in docs.columns if c.lower() not in ("toxicity", "toxic")])
    schema = StructType([*kept.schema.fields, StructField("toxicity", DoubleType()), StructField("toxic", BooleanType())])
    return kept.mapInArrow(run, schema)


def op3_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = shared.table(spark, sf_dir, "documents")
    weights = train(docs, shared.table(spark, sf_dir, "labels"))
    return score(docs.select("doc_id", "text"), weights).select("doc_id", "toxicity", "toxic")


QUERIES = {"op3_toxicity": op3_toxicity}
SQL: dict[str, str] = {}

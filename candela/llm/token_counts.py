"""Exact length histogram of a corpus under a tokenizer.

Documents are aggregated by encoded length; suffix sums over the distinct lengths then
answer, for every context limit, how many documents and tokens lie above it, how many
tokens stay if each text is cut at it, and any quantile. After the encoding the data is one
row per (group, distinct length), so its size is bounded by the longest text, not by the corpus.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator, Sequence
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import shared

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The split pattern of byte_bpe_50k.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@lru_cache(4)
def encoder(vocabulary: str, pattern: str):
    import tiktoken

    with open(vocabulary, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def token_counts(docs: DataFrame, by: Sequence[str] = (), vocabulary: str = VOCABULARY, pattern: str = PATTERN) -> DataFrame:
    """One row per row of docs: the columns of by, and n_tokens of its whole text.

    A null text has null n_tokens, an empty one 0. Repeated rows count each. Other columns are ignored.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(at(), pattern).encode_ordinary
        for batch in batches:
            text = batch.column(0)
            sizes: list[int | None] = []
            for i in range(len(text)):
                t = text[i].as_py()
                sizes.append(None if t is None else len(encode(t)))
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(sizes, pa.int64())], names=[*[f"g{i}" for i in range(len(by))], "n_tokens"])

    at = shared.shipped(docs.sparkSession, vocabulary)
    inputs = {"text": docs["text"]} | {f"g{i}": docs[c] for i, c in enumerate(by)}
    kinds = dict(docs.dtypes)
    schema = ", ".join([*[f"g{i} {kinds[c]}" for i, c in enumerate(by)], "n_tokens bigint"])
    out = shared.apply_rows(docs, inputs, count, schema)
    return out.select(*[F.col(f"g{i}").alias(c) for i, c in enumerate(by)], "n_tokens")


def length_histogram(lengths: DataFrame, by: Sequence[str] = (), length: str = "n_tokens") -> DataFrame:
    """Histogram of a length column with suffix sums: a row per group and distinct length L.

    n_docs, n_tokens: documents of exactly L tokens, and their tokens. docs_ge, tokens_ge: the
    same of L or more. docs_total, tokens_total: of the group. tokens_truncated: what is left
    with a context limit of L. cum_share: share of documents of at most L; the q-quantile is the least L with
    cum_share >= q. Null lengths are left out; a group of nulls only, or an empty table, gives no row; a null group is a group.
    """
    n = F.col("n_tokens")
    hist = (
        lengths.where(F.col(length).isNotNull()).groupBy(*by, F.col(length).alias("n_tokens_each")).agg(F.count(F.lit(1)).alias("n_docs"))
        .withColumn("n_tokens", F.col("n_tokens_each") * F.col("n_docs"))
    )
    group = Window.partitionBy(*by)
    down = group.orderBy(F.col("n_tokens_each").desc()).rowsBetween(Window.unboundedPreceding, 0)
    out = hist.select(
        *by, F.col("n_tokens_each").alias("length"), "n_docs", "n_tokens",
        F.sum("n_docs").over(down).alias("docs_ge"), F.sum(n).over(down).alias("tokens_ge"),
        F.sum("n_docs").over(group).alias("docs_total"), F.sum(n).over(group).alias("tokens_total"),
    )
    return out.withColumn("tokens_truncated", F.expr("tokens_total - tokens_ge + length * docs_ge")).withColumn("cum_share", F.expr("(docs_total - docs_ge + n_docs) / cast(docs_total as double)"))


def at_limits(histogram: DataFrame, limits: Sequence[int], by: Sequence[str] = ()) -> DataFrame:
    """For each context limit: documents and tokens over it, and the tokens kept when texts are cut at it."""
    spark = histogram.sparkSession
    at = spark.createDataFrame([(int(x),) for x in limits], "context bigint")
    over = F.col("length") > F.col("context")
    return (
        histogram.crossJoin(F.broadcast(at)).groupBy(*by, "context").agg(
            F.sum(F.when(over, F.col("n_docs")).otherwise(0)).alias("docs_over"),
            F.sum(F.when(over, F.col("n_tokens")).otherwise(0)).alias("tokens_over"),
            F.sum(F.least("length", "context") * F.col("n_docs")).alias("tokens_kept"),
        )
    )


def quantiles(histogram: DataFrame, levels: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """The least length whose share of documents at or below it reaches each level."""
    spark = histogram.sparkSession
    at = spark.createDataFrame([(float(x),) for x in levels], "level double")
    return histogram.crossJoin(F.broadcast(at)).where("cum_share >= level").groupBy(*by, "level").agg(F.min("length").alias("length"))


def op1_token_counts(spark, sf_dir: str) -> DataFrame:
    docs = shared.table(spark, sf_dir, "documents")
    return length_histogram(token_counts(docs, ["source"]), ["source"])


QUERIES = {"op1_token_counts": op1_token_counts}
SQL: dict[str, str] = {}

"""Mixing sources to target weights by Sainte-Laguë apportionment of equal-token blocks.

Tokens are words between white space, and each character of a script written without spaces. The documents of a source are dealt to shards by identifier (as many
as its tokens need at ``shard_tokens`` each, so no window holds more of a hot source than one shard) and cut, in the
order of identifiers, into blocks of ``block_tokens``; a document belongs to the block in which its first token lies.
Blocks go to the sources, each time to the one with the highest quotient weight / (2*got + 1). Unless a total is given, this ends where the
next block would be one that its source doesn't have: that is the largest mixture that meets the weights, and nothing more is dropped. The same rule deals a source's quota to its shards by their tokens. The blocks of a
shard are taken in the order of a seeded hash.

Texts are read once, for their tokens. Quotas need no row per block: where the largest mixture ends is one aggregation over the sources, and each source's quota follows from it alone;
with a given total, seats that are certain come from the continuous solution, and only some quotients for each name around the cut are ranked.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import shared

BLOCK_TOKENS, SHARD_TOKENS, SEED = 2_000, 4_000_000, 11
#: The production target: every source by its size, but none more than this share of the mixture.
MAX_SHARE = 0.3
#: Characters that are tokens of their own: kana, Han, Hangul, Thai, Lao, Khmer, Burmese.
SPACELESS = r"\x{3040}-\x{30FF}\x{3400}-\x{9FFF}\x{AC00}-\x{D7AF}\x{F900}-\x{FAFF}\x{20000}-\x{323AF}\x{E00}-\x{EFF}\x{1780}-\x{17FF}\x{1000}-\x{109F}"
_LAST = shared.LAST
_KEY = ["source_key", "id"]


def apportion(entries: DataFrame, group: list[str], name: str) -> DataFrame:
    """Sainte-Laguë within each group: entries has name, weight, blocks (the most it may get) and seats (of its group); adds n.

    Seats go to the highest weight / (2*j + 1), j < blocks; ties to the lower name. A weight of 0 or null gets none; seats beyond what all can take stay free.
    """
    e = entries.where("weight > 0 and blocks > 0")
    g = Window.partitionBy(*group)
    by_ratio = g.orderBy("ratio", name)
    up_to, after = by_ratio.rowsBetween(Window.unboundedPreceding, -1), by_ratio.rowsBetween(0, Window.unboundedFollowing)
    zero = F.lit(0.0)
    e = e.withColumn("ratio", F.expr("blocks / weight")).withColumn("names", F.count(F.lit(1)).over(g)).withColumn("total", F.sum("blocks").over(g))
    e = e.withColumn("full", F.coalesce(F.sum("blocks").over(up_to).cast("double"), zero)).withColumn("open", F.sum("weight").over(after))
    # filled: blocks given out when every name has had min(blocks, ratio * weight)
    e = e.withColumn("filled", F.expr("full + ratio * open"))

    def level(target: Column) -> Column:
        """t with sum(min(blocks, t * weight)) = target."""
        first = F.min(F.when(F.col("filled") >= target, F.struct("ratio", name, ((target - F.col("full")) / F.col("open")).alias("t")))).over(g)
        return first["t"]

    # rounding moves the sum by at most half a seat a name, so the cut lies between these two levels
    low = F.greatest(zero, F.col("seats") - F.col("names") / 2 - 1)
    high = F.col("seats") + F.col("names") / 2 + 1
    e = e.withColumn("t0", level(low)).withColumn("t1", F.when(high < F.col("total"), level(high)))
    seats_at = lambda t: F.greatest(F.lit(0).cast("bigint"), F.least(F.col("blocks"), F.ceil(F.col(t) * F.col("weight") - 0.5)))
    e = e.withColumn("sure", F.when(F.col("t0") > 0, seats_at("t0")).otherwise(F.lit(0).cast("bigint"))).withColumn("most", F.when(F.col("t1").isNotNull(), F.least(F.col("blocks"), seats_at("t1") + 1)).otherwise(F.col("blocks")))
    e = e.withColumn("left", F.col("seats") - F.sum("sure").over(g))
    near = e.where("most > sure").select(*group, name, "left", "weight", F.explode(F.sequence(F.col("sure"), F.col("most") - 1)).alias("got")).withColumn("quotient", F.expr("weight / (2 * got + 1)"))
    ranked = near.withColumn("place", F.row_number().over(g.orderBy(F.col("quotient").desc(), name, "got"))).where("place <= left")
    more = ranked.groupBy(*group, name).agg(F.count(F.lit(1)).alias("more"))
    keys = [*group, name]
    out = e.join(more.select(*[F.col(k).alias(f"_{k}") for k in keys], "more"), [F.col(k) == F.col(f"_{k}") for k in keys], "left")
    return out.select(*[c for c in entries.columns], (F.col("sure") + F.coalesce("more", F.lit(0).cast("bigint"))).alias("n")).where("n > 0")


def largest(sources: DataFrame, name: str) -> DataFrame:
    """sources (name, weight, blocks) with n: quotas by highest quotients up to the first that would ask a source for a block that it doesn't have; ties to the lower name.

    Weights of 0 or null get none, and a source without blocks ends the mixture before its first. Each row's n follows from the one limiting quotient, so nothing is sorted or gathered.
    """
    e = sources.where("weight > 0")
    # the first block that lacks: the highest quotient, of the lowest name
    top = e.agg(F.max(F.expr("weight / (2 * blocks + 1)")).alias("q"))
    lacking = e.join(F.broadcast(top), F.expr("weight / (2 * blocks + 1) = q")).agg(F.min(name).alias("lacking"), F.max("q").alias("q"))
    e = e.join(F.broadcast(lacking))  # one row
    before = lambda j: f"(weight / (2 * ({j}) + 1) > q or (weight / (2 * ({j}) + 1) = q and {name} < lacking))"
    e = e.withColumn("n", F.expr("greatest(0, cast(ceil((weight / q - 1) / 2) as bigint))"))
    # the quotients decide where rounding could
    e = e.withColumn("n", F.expr(f"case when {before('n')} then n + 1 when n > 0 and not {before('n - 1')} then n - 1 else n end"))
    return e.select(*sources.columns, F.expr("least(n, blocks)").alias("n")).where("n > 0")


def capped(sources: DataFrame, max_share: float) -> DataFrame:
    """sources (source_key, blocks) with weight: the blocks, but for the largest sources max_share of all weights. Where there are too few sources for that share, an equal one.

    At most 1 / max_share sources can be above it, so that many and one more are looked at; the others stay as they are.
    """
    size = sources.agg(F.sum("blocks").alias("all"), F.count(F.lit(1)).alias("sources")).first()
    if not size["sources"]:
        return sources.withColumn("weight", F.lit(0.0))
    share = max(max_share, 1 / size["sources"])
    top = sources.orderBy(F.col("blocks").desc(), "source_key").limit(int(1 / share) + 1).collect()
    rest, k = size["all"], 0
    while k < len(top) and 1 - k * share > 1e-9 and top[k]["blocks"] > share * rest / (1 - k * share) * (1 + 1e-9):
        rest -= top[k]["blocks"]
        k += 1
    if not k:
        return sources.withColumn("weight", F.col("blocks").cast("double"))
    # of the sources that share all equally the last has just its share, so it isn't above it and something is left
    high = share * rest / (1 - k * share)
    return sources.withColumn("weight", F.when(F.col("source_key").isin([r["source_key"] for r in top[:k]]), F.lit(high)).otherwise(F.col("blocks").cast("double")))


def keyed(docs: DataFrame) -> DataFrame:
    """Each row of docs as struct ``row``, with source_key, id and tokens. A null text has no tokens, a null doc_id comes last, a null source is a source of its own. doc_id must be an integer column."""
    tokens = F.size(F.filter(F.split(docs["text"], r"[ \t\n\r\f]+"), lambda w: w != ""))
    spaceless = F.length(docs["text"]) - F.length(F.regexp_replace(docs["text"], f"[{SPACELESS}]", ""))
    return docs.select(
        F.struct(*[docs[c] for c in docs.columns]).alias("row"), F.coalesce(F.concat(F.lit("s"), docs["source"]), F.lit("")).alias("source_key"),
        shared.identifier(docs).alias("id"), F.when(docs["text"].isNull(), 0).otherwise(tokens + spaceless).cast("bigint").alias("tokens"),
    )


def choose(sizes: DataFrame, weights: Mapping[str | None, float] | None = None, other: float = 0.0, max_share: float = MAX_SHARE, block_tokens: int = BLOCK_TOKENS, shard_tokens: int = SHARD_TOKENS, total: int | None = None, seed: int = SEED) -> DataFrame:
    """The chosen of (source_key, id, tokens) rows: source_key, id, shard, block, quota (of the shard); one row per (source_key, id).

    Rows that repeat an identifier within a source are one document. weights: by source, other for those that aren't named; 0 gives a source no block.
    Without weights they are the sources' blocks, those of the largest sources lowered to max_share of all weights (see capped). total: how many blocks are chosen in
    all, those with the highest quotients among the blocks that there are; None for the largest mixture that meets the weights (see largest).
    """
    spark = sizes.sparkSession
    need = sizes.groupBy("source_key").agg(F.greatest(F.lit(1).cast("bigint"), F.ceil(F.sum("tokens") / F.lit(float(shard_tokens)))).alias("shards"))
    one = sizes.groupBy(*_KEY).agg(F.sum("tokens").alias("tokens")).join(need, "source_key").withColumn("shard", F.expr("pmod(id, shards)"))
    before = Window.partitionBy("source_key", "shard").orderBy("id").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum("tokens").over(before), F.lit(0).cast("bigint"))
    at = shared.cut(one.withColumn("block", F.floor(start / F.lit(float(block_tokens)))).select(*_KEY, "shard", "block", "tokens"))
    blocks = at.groupBy("source_key", "shard", "block").agg(F.sum("tokens").alias("tokens"))
    shards = shared.cut(blocks.groupBy("source_key", "shard").agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("blocks")))
    sources = shards.groupBy("source_key").agg(F.sum("blocks").alias("blocks"))
    if weights is None:
        sources = capped(sources, max_share)
    else:
        given = spark.createDataFrame([(f"s{k}" if k is not None else "", float(v)) for k, v in weights.items()], "source_key string, weight double")
        sources = sources.join(F.broadcast(given), "source_key", "left").fillna({"weight": float(other)})  # as many rows as there are named weights
    quota = largest(sources, "source_key") if total is None else apportion(sources.withColumn("seats", F.lit(int(total)).cast("bigint")), [], "source_key")
    quota = quota.select("source_key", F.col("n").alias("seats"))
    quotas = apportion(shards.withColumn("weight", F.greatest(F.lit(1.0), F.col("tokens").cast("double"))).join(quota, "source_key"), ["source_key"], "shard").select("source_key", "shard", F.col("n").alias("quota"))
    h = F.md5(F.concat_ws("|", F.lit(str(seed)), "source_key", F.col("shard").cast("string"), F.col("block").cast("string")))
    order = Window.partitionBy("source_key", "shard").orderBy(h, "block")
    taken = blocks.join(quotas, ["source_key", "shard"]).withColumn("k", F.row_number().over(order)).where("k <= quota").drop("k", "tokens")
    return at.drop("tokens").join(taken, ["source_key", "shard", "block"])


def mix(docs: DataFrame, **settings) -> DataFrame:
    """The rows of docs whose block is chosen (see choose for the settings), columns unchanged, whatever their names and types. An empty table gives none."""
    rows = keyed(docs)
    chosen = choose(shared.cut(rows.select(*_KEY, "tokens")), **settings).select(*_KEY)
    return rows.drop("tokens").join(chosen, _KEY, "left_semi").select("row.*")


def op9_mixing(spark, sf_dir: str) -> DataFrame:
    docs = shared.table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    rows = shared.cut(keyed(docs).select("row.doc_id", "row.source", *_KEY, "tokens"))
    return rows.join(choose(rows.select(*_KEY, "tokens")), _KEY).select("doc_id", "source", "shard", "block", "tokens", "quota")


def sql(documents: str = "documents") -> str:
    """The rows of op9_mixing over a table or subquery with doc_id, source and text; every quotient is ranked."""
    return f"""
WITH base AS (
  SELECT doc_id, source, coalesce('s' || source, '') AS source_key, coalesce(doc_id, {_LAST}) AS id,
         CASE WHEN text IS NULL THEN 0 ELSE len(list_filter(regexp_split_to_array(text, '[ \\t\\n\\r\\f]+'), lambda w: w <> '')) + length(text) - length(regexp_replace(text, '[{SPACELESS}]', '', 'g')) END::BIGINT AS tokens
  FROM {documents}),
need AS (SELECT source_key, greatest(1, ceil(sum(tokens) / {SHARD_TOKENS}::DOUBLE))::BIGINT AS shards FROM base GROUP BY 1),
one AS (SELECT source_key, id, ((id % any_value(shards)) + any_value(shards)) % any_value(shards) AS shard, sum(tokens)::BIGINT AS tokens FROM base JOIN need USING (source_key) GROUP BY 1, 2),
placed AS (SELECT *, floor(coalesce(sum(tokens) OVER (PARTITION BY source_key, shard ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE / {BLOCK_TOKENS})::BIGINT AS block FROM one),
blocks AS (SELECT source_key, shard, block, sum(tokens)::BIGINT AS tokens FROM placed GROUP BY ALL),
shards AS (SELECT source_key, shard, sum(tokens)::BIGINT AS tokens, count(*) AS blocks FROM blocks GROUP BY ALL),
sized AS (SELECT source_key, sum(blocks)::BIGINT AS blocks FROM shards GROUP BY 1),
ranked AS (SELECT *, row_number() OVER (ORDER BY blocks DESC, source_key) AS r, (sum(blocks) OVER ())::BIGINT AS everything, greatest({MAX_SHARE}::DOUBLE, 1::DOUBLE / count(*) OVER ()) AS share,
  (sum(blocks) OVER (ORDER BY blocks DESC, source_key ROWS UNBOUNDED PRECEDING))::BIGINT - blocks AS above FROM sized),
levels AS (SELECT *, share * (everything - above) / (1 - (r - 1) * share) AS high, 1 - (r - 1) * share > 1e-9 AS possible FROM ranked),
cut AS (SELECT coalesce(min(r) FILTER (NOT (possible AND blocks > high * (1 + 1e-9))), count(*) + 1) AS r FROM levels),
sources AS (SELECT source_key, blocks, CASE WHEN r < (SELECT r FROM cut) THEN (SELECT high FROM levels WHERE r = (SELECT r FROM cut)) ELSE blocks::DOUBLE END AS weight FROM levels),
q1 AS (SELECT source_key, got, got = blocks AS lacking, weight / (2 * got + 1) AS quotient FROM (SELECT *, unnest(range(blocks + 1)) AS got FROM sources WHERE weight > 0)),
placed1 AS (SELECT *, row_number() OVER (ORDER BY quotient DESC, source_key, got) AS place FROM q1),
quota AS (SELECT source_key, count(*) AS seats FROM placed1 WHERE place < (SELECT min(place) FROM placed1 WHERE lacking) GROUP BY 1),
q2 AS (SELECT source_key, shard, seats, got, greatest(1, tokens)::DOUBLE / (2 * got + 1) AS quotient FROM (SELECT shards.*, quota.seats, unnest(range(blocks)) AS got FROM shards JOIN quota USING (source_key))),
quotas AS (SELECT source_key, shard, count(*) AS quota FROM (SELECT *, row_number() OVER (PARTITION BY source_key ORDER BY quotient DESC, shard, got) AS place FROM q2) WHERE place <= seats GROUP BY ALL),
chosen AS (SELECT source_key, shard, block, quota FROM (SELECT *, row_number() OVER (PARTITION BY source_key, shard ORDER BY md5('{SEED}|' || source_key || '|' || shard || '|' || block), block) AS k FROM blocks JOIN quotas USING (source_key, shard)) WHERE k <= quota)
SELECT doc_id, source, shard, block, base.tokens, quota FROM base JOIN placed USING (source_key, id) JOIN chosen USING (source_key, shard, block)
"""


QUERIES = {"op9_mixing": op9_mixing}
SQL = {"op9_mixing": sql()}

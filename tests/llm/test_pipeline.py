"""The corpus pipeline against a brute-force version of each stage."""

from __future__ import annotations

import random

import duckdb

import corpus_pipeline
from candela.llm import mixing, near_dedup, token_counts, toxicity

from .test_llm import documents, jaccard, prose


def corpus(spark, at):
    rng = random.Random(41)
    rows, toxic = [], set()
    for i in range(300):
        w = prose(rng, rng.randrange(30, 120)).split()
        if i % 6 == 0:
            toxic.add(i)
            for _ in range(4):
                w[rng.randrange(len(w))] = rng.choice(["vile", "scum"])
        rows.append((i, " ".join(w), "abc"[i % 7 // 3]))
    rows += [(300 + i, rows[7 * i + 1][1], "a") for i in range(20)]  # exact copies
    rows += [(400 + i, rows[7 * i + 2][1] + " one more end", "b") for i in range(20)]  # near copies
    rows += [(900, None, "a"), (901, "", None), (902, "", "b"), (None, "alone and without a number", "c")]
    documents(spark, rows).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i in toxic)) for i in range(0, 300)], "doc_id bigint, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    return rows


def test_pipeline_like_brute_force(spark, tmp_path):
    at = str(tmp_path)
    rows = corpus(spark, at)
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "exact dedup", "near dedup", "mixing", "bpe"] and corpus_pipeline.ORACLE_SQL is None
    docs, seen = spark.read.parquet(f"{at}/documents.parquet"), []
    columns = docs.columns
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, at).write.parquet(f"{at}/{k}")
        docs = spark.read.parquet(f"{at}/{k}")
        assert k == 4 or docs.columns == columns
        seen.append([(r.doc_id, r.text if k < 4 else r.tokens, r.source) for r in docs.collect()])

    weights = toxicity.train(documents(spark, rows), spark.read.parquet(f"{at}/labels.parquet"))
    bad = {r.doc_id for r in toxicity.score(documents(spark, rows), weights).where("toxic").collect()}
    assert bad >= {i for i in range(0, 300, 6)} and len(bad) < 60
    assert sorted(map(repr, seen[0])) == sorted(repr(r) for r in rows if r[0] not in bad)

    least = {}
    for i, t, _ in seen[0]:
        if t is not None:
            least[t] = min(least.get(t, 1 << 62), 1 << 62 if i is None else i)
    assert sorted(map(repr, seen[1])) == sorted(repr(r) for r in seen[0] if r[1] is None or least[r[1]] == (1 << 62 if r[0] is None else r[0]))

    kept: list = []
    for r in sorted(seen[1], key=lambda r: 1 << 62 if r[0] is None else r[0]):
        if not any(jaccard(r[1] or "", s[1] or "") >= near_dedup.THRESHOLD for s in kept):
            kept.append(r)
    assert sorted(map(repr, seen[2])) == sorted(map(repr, kept))

    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{at}/2/*.parquet'")
    want = con.execute(f"SELECT doc_id FROM ({mixing.sql()})").fetchall()
    assert sorted(repr(r[0]) for r in seen[3]) == sorted(repr(r[0]) for r in want)

    encode = token_counts.encoder(token_counts.VOCABULARY, token_counts.PATTERN).encode_ordinary
    assert sorted(map(repr, seen[4])) == sorted(repr((i, None if t is None else encode(t), s)) for i, t, s in seen[3])
    assert corpus_pipeline.run(spark, at).count() == len(seen[4])


def test_pipeline_of_nothing(spark, tmp_path):
    at = str(tmp_path)
    documents(spark, []).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    assert corpus_pipeline.run(spark, at).count() == 0

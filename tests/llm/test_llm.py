"""The operators of the llm subpackage against brute force, exact round trips and edge cases."""

from __future__ import annotations

import gzip
import math
import random
import re
from collections import Counter, defaultdict
from hashlib import sha256
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from candela.llm import bpe, components, exact_dedup, html_text, mixing, near_dedup, quality, suffix_dedup, token_counts, toxicity, warc
from candela.llm import textkit as K

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
WORDS = [f"w{i}" for i in range(400)]


def documents(spark, rows):
    """Rows of (doc_id, text[, source]) as a documents table."""
    return spark.createDataFrame([(r[0], r[1], "en", r[2] if len(r) > 2 else "web", len(r[1] or "")) for r in rows], SCHEMA)


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


EDGES = [(1, None), (2, ""), (3, "  \n "), (4, "a"), (4, "a"), (None, "a"), (5, "Zürich – naïve café 東京"), (6, "x " * 60_000)]


# token counts


def test_histogram_answers_every_limit(spark):
    lengths = [3, 3, 0, 7, 7, 7, 12, None]
    df = spark.createDataFrame([(x, "a") for x in lengths], "n_tokens bigint, source string")
    hist = token_counts.length_histogram(df, ["source"])
    known = [x for x in lengths if x is not None]
    rows = {r.length: r for r in hist.collect()}
    assert sorted(rows) == [0, 3, 7, 12]
    for n, r in rows.items():
        assert r.n_docs == known.count(n) and r.docs_ge == sum(x >= n for x in known) and r.tokens_ge == sum(x for x in known if x >= n)
        assert r.tokens_truncated == sum(min(x, n) for x in known) and r.docs_total == len(known)
    for r in token_counts.at_limits(hist, [0, 5, 7, 100]).collect():
        assert (r.docs_over, r.tokens_kept) == (sum(x > r.context for x in known), sum(min(x, r.context) for x in known))
    assert {r.level: r.length for r in token_counts.quantiles(hist, [0.1, 0.5, 1.0]).collect()} == {0.1: 0, 0.5: 7, 1.0: 12}


def test_token_counts_of_edges(spark):
    got = [r.n_tokens for r in token_counts.token_counts(documents(spark, EDGES)).collect()]
    encode = token_counts.encoder(token_counts.VOCABULARY, token_counts.PATTERN).encode_ordinary
    assert Counter(got) == Counter(None if t is None else len(encode(t)) for _, t in EDGES)
    assert token_counts.length_histogram(token_counts.token_counts(documents(spark, []))).count() == 0


# exact dedup


@pytest.mark.parametrize(("bits", "rows"), [(256, 400_000), (8, 0)])
def test_exact_dedup_like_brute_force(spark, bits, rows):
    rng = random.Random(1)
    texts = [prose(rng, 8) for _ in range(300)]
    data = [(i, rng.choice(texts)) for i in range(900)] + EDGES + [(7, None), (7, None)]
    least = {}
    for i, t in data:
        if t is not None:
            least[t] = min(least.get(t, 1 << 63), (1 << 63) if i is None else i)
    out = exact_dedup.mark(documents(spark, data), bits=bits, broadcast_rows=rows).select("row.doc_id", "row.text", "keep_id", "is_duplicate").collect()
    assert Counter((r.doc_id, r.text) for r in out) == Counter(data)
    kept = [r for r in out if not r.is_duplicate]
    assert Counter(r.text for r in kept if r.text is not None) == Counter(least.keys())
    assert all(r.keep_id == least[r.text] for r in out if r.text is not None)
    assert all(not r.is_duplicate for r in out if r.text is None)
    assert exact_dedup.exact_dedup(documents(spark, [])).count() == 0


def test_digest_index_over_two_batches(spark, tmp_path):
    """Five flushes over two batches, against a dictionary; the index is opened again from its folder."""
    rng = random.Random(43)
    keys = [sha256(bytes([k % 256, k // 256])).digest()[:30].ljust(32, b"\0") for k in range(400)]
    batches = [[(rng.choice(keys), rng.randrange(1000)) for _ in range(150)] for _ in range(5)]
    want: dict = {}

    def frame(rows):
        return spark.createDataFrame(rows, "digest binary, id bigint").repartition(2)

    at = str(tmp_path / "index")
    index = exact_dedup.DigestIndex(spark, at, memtable=60, fan=3, part=50)
    for rows in batches[:3]:
        index.flush(frame(rows))
    assert len({f.run for f in index.files}) > 3 and all(f.level == 0 for f in index.files)
    index.compact()
    assert max(f.level for f in index.files) >= 1
    again = exact_dedup.DigestIndex(spark, at, memtable=60, fan=3, part=50)
    assert again.files == index.files
    for rows in batches[:3]:
        for d, i in rows:
            want[d] = min(want.get(d, i), i)
    asked = [(d,) for d in keys] + [(keys[0],)]
    assert {bytes(r.digest): r.keep_id for r in again.lookup(spark.createDataFrame(asked, "digest binary")).collect()} == want
    for rows in batches[3:]:
        again.flush(frame(rows))
    again.compact(fully=True)
    assert len({f.run for f in again.files}) == 1 and len(again.files) > 1
    count = Counter(d for rows in batches for d, _ in rows)
    for rows in batches[3:]:
        for d, i in rows:
            want[d] = min(want.get(d, i), i)
    assert {bytes(r.digest): (r.keep_id, r.n) for r in again.several().collect()} == {d: (want[d], n) for d, n in count.items() if n > 1}
    assert sum(f.entries for f in again.files) == len(want)


def test_filter_miss_opens_no_run(spark, tmp_path):
    index = exact_dedup.DigestIndex(spark, str(tmp_path / "index"), memtable=100)
    have = [np.random.default_rng(k).bytes(32) for k in range(500)]
    index.flush(spark.createDataFrame([(d, 1) for d in have], "digest binary, id bigint").repartition(1))
    opened: list[str] = []
    size = [exact_dedup.Bloom.read(open(f"{f.path}.filter", "rb").read()) for f in index.files]
    rng, missing = np.random.default_rng(9), []
    while len(missing) < 20:
        d = np.array([rng.bytes(31) + b"x"], "S32")
        if not any(b.may_have(d)[0] for b in size):
            missing.append(d[0])
    assert len(exact_dedup.search(index.path, index.files, np.unique(np.array(missing, "S32")), opened)[0]) == 0 and not opened
    d, i, n = exact_dedup.search(index.path, index.files, np.unique(np.array(have, "S32")), opened)
    assert len(d) == len(set(have)) and opened


def test_second_batch_meets_the_first(spark, tmp_path):
    first = [(1, "a"), (2, "b"), (3, None), (4, "")]
    second = [(10, "b"), (11, "c"), (12, "c"), (13, None), (14, ""), (None, "a"), (0, "a")]
    index = exact_dedup.DigestIndex(spark, str(tmp_path / "index"))
    for bits in (256, 8):  # with 8 bits digests collide
        index = exact_dedup.DigestIndex(spark, str(tmp_path / f"index{bits}"))
        more = [(100 + k, f"t{k}") for k in range(300)]
        exact_dedup.mark(documents(spark, first + more), bits=bits, index=index).count()
        with pytest.raises(ValueError):
            exact_dedup.mark(documents(spark, second), bits=bits, index=index)
        out = exact_dedup.mark(documents(spark, second + [(900, "t7"), (901, "t7"), (902, "u")]), bits=bits, index=index, earlier=documents(spark, first + more)).select("row.doc_id", "row.text", "keep_id", "is_duplicate").collect()
        assert Counter(map(tuple, out)) == Counter([(10, "b", 2, True), (11, "c", 11, False), (12, "c", 11, True), (13, None, 13, False), (14, "", 4, True), (None, "a", 0, True), (0, "a", 0, True), (900, "t7", 107, True), (901, "t7", 107, True), (902, "u", 902, False)])
        assert sum(f.entries for f in index.files) > 0


def test_identifiers_that_are_no_integers_are_refused(spark):
    df = documents(spark, [(1, "a")]).withColumn("doc_id", F.lit("x"))
    for f in (exact_dedup.mark, suffix_dedup.repeats, near_dedup.mark, mixing.mix):
        with pytest.raises(TypeError):
            f(df)


def test_columns_of_any_type_stay(spark):
    df = documents(spark, [(1, "a b c"), (1, "a b c"), (2, "a b c")]).withColumn("m", F.create_map(F.lit("k"), F.rand(1))).withColumn("v", F.lit(None))
    for f in (exact_dedup.exact_dedup, near_dedup.near_dedup):
        assert [(r.doc_id, len(r.m)) for r in f(df).collect()] == [(1, 1)]


def test_clashing_columns_stay(spark):
    df = documents(spark, [(1, "a"), (2, "a"), (3, "b")]).withColumns({c: F.lit(9) for c in ("digest", "keep_id", "id", "h", "tokens", "shard", "row", "toxic", "group", "f")})
    for f in (exact_dedup.exact_dedup, near_dedup.near_dedup):
        out = f(df)
        assert out.columns == df.columns and sorted(r.doc_id for r in out.collect()) == [1, 3]
    assert mixing.mix(df).columns == df.columns and mixing.mix(df).count() == 3
    assert quality.apply_rules(df).count() == 3 and bpe.encode(df).count() == 3 and suffix_dedup.repeats(df).count() == 0
    assert set(toxicity.score(df, {-1: 0.0}).columns) == {*df.columns, "toxicity"}


# near dedup


def jaccard(a, b, n=5):
    def shingles(t):
        w = re.findall(r"[0-9a-zA-Z\x80-\U0010ffff]+", t.lower())
        return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} or ({tuple(w)} if w else set())

    x, y = shingles(a), shingles(b)
    return len(x & y) / len(x | y) if x and y else 0.0


def near_corpus():
    rng = random.Random(3)
    texts = []
    for _ in range(40):
        base = prose(rng, rng.choice([20, 80, 200])).split()
        texts.append(" ".join(base))
        for _ in range(rng.randrange(4)):
            w = base[:]
            for _ in range(rng.randrange(1, max(2, len(w) // 12))):
                w[rng.randrange(len(w))] = rng.choice(WORDS)
            texts.append(" ".join(w))
    shared = prose(rng, 60)
    texts += [prose(rng, 300) + " " + shared for _ in range(30)]  # a passage in common makes no copies
    base = prose(rng, 100).split()
    texts += [" ".join([*base[:k], rng.choice(WORDS), *base[k:]]) for k in range(0, 100, 2)]  # a larger group
    return texts


def test_near_pairs_like_brute_force(spark):
    texts = near_corpus()
    members, edges = near_dedup.similar(documents(spark, list(enumerate(texts))))
    of = defaultdict(list)
    for r in members.collect():
        of[r.f].append(r.id)
    found = {(min(x, y), max(x, y)): e.jaccard for e in edges.collect() for x in of[e.a] for y in of[e.b]}
    true = {(i, j): s for i in range(len(texts)) for j in range(i + 1, len(texts)) if (s := jaccard(texts[i], texts[j])) >= 0.5 and s < 1}
    assert all(abs(true[p] - s) < 1e-9 for p, s in found.items())
    assert len(found) >= 0.9 * len(true)
    clear = {p for p, s in true.items() if s >= 0.65}
    assert len(clear & found.keys()) >= 0.99 * len(clear)


def test_near_links_are_counted_and_units_are_many(spark, monkeypatch):
    """n_links against brute force, with blocks so small that a group has many units."""
    monkeypatch.setattr(near_dedup, "BLOCK", 4)
    rng = random.Random(47)
    base = prose(rng, 60).split()  # whole sets in the sketch, so the result is exact
    texts = [" ".join([*base[:k], f"x{k}", *base[k:]]) for k in range(0, 60, 2)] + [prose(rng, 50) for _ in range(30)]
    texts += [texts[0].upper(), texts[1] + "!", texts[3]]
    sets = {near_key(t) for t in texts}
    want = {i: sum(s != near_key(t) and jaccard(t, " ".join(s)) >= 0.5 for s in sets) for i, t in enumerate(texts)}
    out = near_dedup.mark(documents(spark, list(enumerate(texts)))).select("row.doc_id", "n_links", "group_id").collect()
    assert {r.doc_id: r.n_links for r in out} == want and max(want.values()) > 20
    assert {r.group_id for r in out if r.doc_id < 30 or r.doc_id >= 60} == {0}


def test_near_pairs_of_a_large_group_are_in_no_table(spark, monkeypatch):
    """A group of n sets gives tables in proportion to n, with all links and as many units as blocks need."""
    rng = random.Random(53)
    base, passage = prose(rng, 40).split(), prose(rng, 30)
    texts = [" ".join([*base[: k % 40], f"x{k}", f"y{k}", *base[k % 40 :]]) for k in range(400)]
    texts += [prose(rng, 40) + " " + passage for _ in range(100)]  # long lists of sets that aren't alike
    texts += [" ".join([*base[:39], "end", str(k), prose(rng, 30)]) for k in range(20)]  # half alike
    rows, written = {}, near_dedup.shared.written

    def counted(df, name, *a):
        out = written(df, name, *a)
        rows[name] = out.count()
        return out

    monkeypatch.setattr(near_dedup.shared, "written", counted)
    monkeypatch.setattr(near_dedup, "WIDE", 100, raising=False)
    out = near_dedup.mark(documents(spark, list(enumerate(texts)))).select("row.doc_id", "group_id", "n_links").collect()
    near = np.array([[i != j and jaccard(s, t) >= 0.5 for j, t in enumerate(texts)] for i, s in enumerate(texts)])
    assert {r.doc_id: r.n_links for r in out} == dict(enumerate(near.sum(1))) and near.sum() / 2 > 50_000
    root = list(range(len(texts)))
    for i, j in sorted(zip(*np.nonzero(near))):  # the first of a group is linked to all, or to one that is
        root[j] = min(root[i], root[j])
    assert {r.doc_id: r.group_id for r in out} == dict(enumerate(root))
    assert max(rows.values()) <= near_dedup.SKETCH * len(texts) and rows["candidates"] < len(texts), rows


def test_near_units_count_what_sets_share(monkeypatch):
    """Values pair by pair, in matrices and in both, in portions, against sets; and files of blocks."""
    rng = random.Random(59)
    held = [[set(rng.sample(range(50), rng.randrange(1, 25))) | {1 << 63} for _ in range(n)] for n in (9, 14)]
    x, y = (near_dedup.Block.of(np.arange(len(b)), np.array([len(s) for s in b]), np.concatenate([np.array(sorted(s), np.uint64) for s in b])) for b in held)
    for dense in (0, 20, 1000):
        for columns, codes in ((3, 7), (1024, 1 << 21)):
            for name, value in (("DENSE", dense), ("COLUMNS", columns), ("CODES", codes)):
                monkeypatch.setattr(near_dedup, name, value)
            assert near_dedup.in_common(x, y).tolist() == [[len(s & t) for t in held[1]] for s in held[0]]
            assert near_dedup.in_common(x, x).tolist() == [[len(s & t) for t in held[0]] for s in held[0]]


def test_near_blocks_are_read_as_written(tmp_path):
    block = near_dedup.Block.of(np.array([5, -3]), np.array([2, 1]), np.array([7, (1 << 64) - 1, 7], np.uint64))
    system, at = near_dedup.shared.file_system(str(tmp_path / "5"))
    for _ in range(2):
        block.write(system, at)
    again = near_dedup.Block.read(system, at)
    assert all((a == b).all() and a.dtype == b.dtype for a, b in zip(block, again)) and len(list(tmp_path.iterdir())) == 1


def near_key(t):
    return tuple(re.findall(r"[0-9a-z]+", t.lower()))


def test_sets_of_one_fingerprint_stay_apart(spark, monkeypatch):
    rows = near_dedup.sketches
    texts = ["one two three four five six", "seven eight nine ten eleven twelve", "one two three four five six"]
    monkeypatch.setattr(near_dedup, "sketches", lambda *a: rows(*a).withColumn("f", F.lit(5).cast("bigint")))
    out = near_dedup.mark(documents(spark, list(enumerate(texts)))).select("row.doc_id", "group_id").collect()
    assert {r.doc_id: r.group_id for r in out} == {0: 0, 1: 1, 2: 0}


def test_near_groups_and_edges(spark):
    rng = random.Random(5)
    base = prose(rng, 200)
    docs = [(10, base), (11, base + " tail"), (12, base.upper()), (3, prose(rng, 200)), *EDGES]
    out = near_dedup.mark(documents(spark, docs)).select("row.doc_id", "row.text", "group_id", "is_duplicate").collect()
    assert Counter((r.doc_id, r.text) for r in out) == Counter(docs)
    by = {r.doc_id: r for r in out if r.doc_id in (10, 11, 12, 3)}
    assert {by[i].group_id for i in (10, 11, 12)} == {10} and not by[10].is_duplicate and by[11].is_duplicate and by[12].is_duplicate
    assert sum(not r.is_duplicate for r in out if r.text == "a") == 1
    assert all(not r.is_duplicate for r in out if not (r.text or "").strip())
    assert near_dedup.near_dedup(documents(spark, [])).count() == 0


def test_components(spark):
    rng = random.Random(7)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(40)] + [(5, 5)]
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    linked = {x for a, b in edges if a != b for x in (a, b)}
    assert got == {x: find(x) for x in linked}


# suffix dedup


def repeated_words(docs, n=50):
    """For each document the words that lie in a window of n words that another document has too."""
    where = defaultdict(set)
    split = {i: (t or "").split() for i, t in docs}
    for i, w in split.items():
        for k in range(len(w) - n + 1):
            where[tuple(w[k : k + n])].add(i)
    out = defaultdict(set)
    for i, w in split.items():
        for k in range(len(w) - n + 1):
            if len(where[tuple(w[k : k + n])]) > 1:
                out[i].update(range(k, k + n))
    return out


@pytest.mark.parametrize("hot", [50_000, 3])
def test_repeated_passages_like_brute_force(spark, hot):
    rng = random.Random(11)
    passages = [prose(rng, n) for n in (50, 51, 75, 140, 400)]
    docs = []
    for i in range(60):
        parts = [prose(rng, rng.randrange(5, 120))]
        for _ in range(rng.randrange(3)):
            parts += [rng.choice(passages), prose(rng, rng.randrange(5, 40))]
        docs.append((i, rng.choice([" ", "  ", "\n"]).join(parts)))
    docs += [(100, passages[3]), (101, passages[3]), (102, "tick " * 300), (103, "tick " * 120), (104, " ".join(passages[0].split()[:49])), (105, None), (106, "")]
    got, first = defaultdict(set), defaultdict(set)
    for r in suffix_dedup.repeats(documents(spark, docs), hot=hot).collect():
        got[r.doc_id].update(range(r.start_word, r.end_word))
        if r.is_first:
            first[r.doc_id].update(range(r.start_word, r.end_word))
            assert r.first_doc_id == r.doc_id
        else:
            assert r.first_doc_id <= r.doc_id
    want = repeated_words(docs)
    assert {i: s for i, s in got.items() if s} == {i: s for i, s in want.items() if s}
    keeper = {}  # the first document and place of each repeated window
    for i, t in docs:
        w = (t or "").split()
        for k in range(len(w) - 49):
            keeper.setdefault(tuple(w[k : k + 50]), (i, k))
    stay = defaultdict(set)
    for i, k in keeper.values():
        if set(range(k, k + 50)) <= want[i]:
            stay[i].update(range(k, k + 50))
    assert {i: s for i, s in first.items() if s} == {i: s for i, s in stay.items() if s}
    assert all(i not in first for i in (101,)) and suffix_dedup.repeats(documents(spark, [])).count() == 0


@pytest.mark.parametrize("n", [1, 8, 300])
def test_repeats_of_any_length(spark, n):
    rng = random.Random(n)
    passage = prose(rng, 310)
    docs = [(1, prose(rng, 40) + " " + passage), (2, passage + " " + prose(rng, 40)), (3, prose(rng, 400)), (None, None), (4, "")]
    rows = suffix_dedup.repeats(documents(spark, docs).withColumns({"m": F.lit(1), "key": F.lit(2), "h": F.lit(3)}), min_words=n).collect()
    got = defaultdict(set)
    for r in rows:
        got[r.doc_id].update(range(r.start_word, r.end_word))
    assert {i: s for i, s in got.items() if s} == {i: s for i, s in repeated_words(docs, n).items() if s}
    if n == 300:
        assert sorted((r.doc_id, r.start_word, r.end_word, r.is_first) for r in rows) == [(1, 40, 350, True), (2, 0, 310, False)]
    with pytest.raises(ValueError):
        suffix_dedup.repeats(documents(spark, docs), min_words=0)


def test_long_common_prefixes(tmp_path):
    symbols = np.tile(np.arange(1, 601, dtype=np.int32), 2)
    columns = suffix_dedup.Columns(str(tmp_path))
    assert suffix_dedup.collection_bwt(symbols, np.array([0, 600, 1200]), columns)[1].max() == 600


def test_collection_transform(tmp_path):
    rng = np.random.default_rng(2)
    sizes = [5, 9, 1, 14, 7]
    symbols = rng.integers(1, 4, sum(sizes)).astype(np.int32)
    limits = np.concatenate([[0], np.cumsum(sizes)])
    columns = suffix_dedup.Columns(str(tmp_path))
    bwt, lcp, link, piece = suffix_dedup.collection_bwt(symbols, limits, columns)
    size = suffix_dedup.suffix_sizes(link)
    columns.close()
    suffixes = sorted((([(int(x), 0) for x in symbols[limits[p] + k : limits[p + 1]]] + [(0, p)]), p, k) for p in range(5) for k in range(sizes[p] + 1))
    assert piece.tolist() == [p for _, p, _ in suffixes]
    assert size.tolist() == [sizes[p] - k for _, p, k in suffixes]
    assert bwt.tolist() == [int(symbols[limits[p] + k - 1]) if k else 0 for _, p, k in suffixes]
    for i in range(1, len(suffixes)):
        a, b = ([x for x, _ in suffixes[j][0][:-1]] for j in (i - 1, i))
        assert lcp[i] == next((n for n, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))


# BPE


def test_bpe_like_tiktoken_and_back(spark):
    rng = random.Random(13)
    texts = [t for _, t in EDGES] + [prose(rng, 50), "aaaaaaaaaaaaaaaa aaa aa", "don't  stop\t\n\n42 apples!!! ", "\U0001f600‍ x", "".join(chr(rng.randrange(32, 0x2FFF)) for _ in range(500))]
    out = bpe.encode(documents(spark, list(enumerate(texts)))).select("row.doc_id", "tokens", "n_tokens", "round_trip").orderBy("doc_id").collect()
    reference = token_counts.encoder(token_counts.VOCABULARY, token_counts.PATTERN)
    for r, t in zip(out, texts):
        assert r.tokens == (None if t is None else reference.encode_ordinary(t)) and r.round_trip == (None if t is None else True)
    rows = spark.createDataFrame([(r.tokens,) for r in out], "tokens array<int>").coalesce(1)
    assert [r.text for r in bpe.decode(rows).collect()] == texts
    assert bpe.encode(documents(spark, [])).count() == 0


def test_pair_index_like_one_by_one():
    v = bpe.vocabulary(bpe.VOCABULARY)
    rng = random.Random(17)
    words = ["".join(rng.choice("abcdeinrst ") for _ in range(rng.randrange(0, 25))).encode() for _ in range(300)]
    ids, limits = bpe.encode_pretokens(v, words)
    for i, w in enumerate(words[:60]):
        assert ids[limits[i] : limits[i + 1]].tolist() == bpe.encode_one(v, v.of_byte[np.frombuffer(w, np.uint8)].tolist())


def test_bpe_forgets_and_gives_memory_back_within_a_batch(spark, monkeypatch):
    """A batch of any number of different pretokens is encoded in parts, none of which keeps more than a few runs' worth."""
    monkeypatch.setattr(bpe, "CACHE", 300)
    monkeypatch.setattr(bpe, "INDEXED", 100)
    rng = random.Random(37)
    texts = [" ".join(str(rng.randrange(10**6)) for _ in range(20)) if i % 7 else None for i in range(400)]
    encoder, reference = bpe.Encoder(bpe.VOCABULARY), token_counts.encoder(token_counts.VOCABULARY, token_counts.PATTERN)
    most, got, runs = 0, [], 0
    for a, b, ids, limits in encoder(pa.array(texts), 200):
        assert a == len(got) and len(limits) == b - a + 1
        got += [ids[x:y].tolist() for x, y in zip(limits, limits[1:])]
        most, runs = max(most, len(encoder.known), len(encoder.limits)), runs + 1
    assert got == [reference.encode_ordinary(t or "") for t in texts] and runs > 100
    assert most < 300 + 100 + 2 * 45  # 7,000 if all are kept to the end of the batch


def test_bpe_gives_rows_before_it_has_read_the_batch(monkeypatch):
    """So a task's memory doesn't grow with the rows of its batch, as in the pipeline's last stage."""
    monkeypatch.setattr(bpe, "INDEXED", 100)
    encoder, read = bpe.Encoder(bpe.VOCABULARY), []
    split = encoder.split
    encoder.split = lambda t: read.append(t) or split(t)
    rng = random.Random(41)
    texts = [" ".join("".join(rng.choices("abcdefgh", k=9)) for _ in range(8)) for _ in range(500)]
    given = 0
    for _, b, _, _ in encoder(pa.array(texts), 100):
        assert len(read) - given < 50  # all 500 if the batch is read first
        given = b
    assert given == len(read) == 500


# toxicity


def test_ftrl_learns_and_is_sparse(spark):
    rng = random.Random(19)
    rows, labels = [], []
    for i in range(600):
        bad = i % 4 == 0
        w = prose(rng, 30).split()
        if bad:
            w[rng.randrange(30)] = "vile"
            w[rng.randrange(30)] = "Scum"
        rows.append((i, " ".join(w)))
        labels.append((i, 1, int(bad)))
    docs = documents(spark, [*rows, (900, None), (901, ""), (None, "x")])
    truth = spark.createDataFrame([r for r in labels if r[0] % 5 < 3] + [(None, 1, 1), (2, None, None)], "doc_id bigint, quality int, toxic int")
    weights = toxicity.train(docs, truth)
    assert weights == toxicity.train(docs.repartition(3), truth)  # whatever the partitions
    assert len(weights) < 2_000
    got = {r.doc_id: r for r in toxicity.score(docs, weights).collect()}
    held = [r for r in labels if r[0] % 5 >= 3]
    assert sum(got[i].toxic == bool(t) for i, _, t in held) >= 0.97 * len(held)
    assert got[900].toxicity is None and got[900].toxic is False and got[901].toxic is False
    none = toxicity.train(docs, truth.where("false"))
    assert not any(r.toxic for r in toxicity.score(docs, none).collect())


def test_ftrl_like_plain_python():
    """fit against FTRL-proximal as published, one coordinate at a time."""
    rng = random.Random(67)
    s = toxicity.Settings(bits=6, alpha=0.5, beta=1.0, l1=0.7, l2=0.3, epochs=2)
    rows = [(np.array(sorted(rng.sample(range(64), rng.randrange(1, 12))), np.int32), rng.randrange(2)) for _ in range(200)]
    z, n = defaultdict(float), defaultdict(float)

    def weight(i):
        l1 = 0.0 if i == "bias" else s.l1
        if abs(z[i]) <= l1:
            return 0.0
        return -(z[i] - math.copysign(l1, z[i])) / ((s.beta + math.sqrt(n[i])) / s.alpha + s.l2)

    for _ in range(s.epochs):
        for x, y in rows:
            w = {i: weight(i) for i in [*x.tolist(), "bias"]}
            g = 1 / (1 + math.exp(-sum(w.values()))) - y
            for i, v in w.items():
                sigma = (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / s.alpha
                z[i] += g - sigma * v
                n[i] += g * g
    at, w, bias = toxicity.fit(rows, s)
    want = {i: weight(i) for i in range(64) if weight(i)}
    assert 0 < len(want) < 64 and dict(zip(at.tolist(), w.tolist())) == pytest.approx(want) and bias == pytest.approx(weight("bias"))


def test_toxicity_like_plain_python(spark):
    """Scores of whole texts, very long and clashing ones included, from the words one at a time; the sample is bounded as documented."""
    rng = random.Random(71)
    rows = [(i, prose(rng, 20) + (" vile scum" if i % 3 == 0 else "")) for i in range(120)]
    docs = documents(spark, [*rows, (500, prose(rng, 150_000) + " vile scum"), (500, "b"), (501, None)]).withColumns({"toxic": F.lit("t"), "h": F.lit(1), "x": F.lit(2), "feature": F.lit(3)})
    labels = spark.createDataFrame([(i, 1, int(i % 3 == 0)) for i in range(120)] + [(9_000 + i, 1, 1) for i in range(400)], "doc_id bigint, quality int, toxic int").withColumn("text", F.lit("clash"))
    s = toxicity.Settings(most=100)
    weights = toxicity.train(docs, labels, s)  # labels without a text take no place in the sample
    assert len(weights) > 1

    def features(t):
        data, limits = K.buffers(pa.array([t]))
        return {int(h) for f, _ in toxicity.features(data, limits, s.bits) for h in f}

    for r in toxicity.score(docs, weights, s).where("text is not null").collect():
        x = weights[-1] + sum(np.float32(weights.get(h, 0)) for h in features(r.text))
        assert r.toxicity == pytest.approx(1 / (1 + math.exp(-x)), rel=1e-5) and r.toxic == (r.toxicity >= s.threshold)
    few = toxicity.Settings(most=100, most_features=130)
    assert toxicity.train(docs, labels, few) == toxicity.train(docs, labels, toxicity.Settings(most=2, most_features=130))


def test_features_are_grams_and_skips():
    data, limits = K.buffers(pa.array(["One two, THREE", "", None, "one two three"]))
    f = [set(zip(*map(np.ndarray.tolist, x))) for x in toxicity.features(data, limits, 20)]
    assert [len(x) for x in f] == [6, 4, 2]
    for x in f:
        assert {h for h, o in x if o == 0} == {h for h, o in x if o == 3}


# WARC


def test_warc_assembly(spark):
    rows = [
        ("r1", "response", None, "u1", "d1", "application/http", "HTTP/1.1 404 Gone\r\nA: b\r\n\r\nbody"),
        ("q1", "request", "r1", "u1", "d1", "application/http", "GET / HTTP/1.1\r\n\r\n"),
        ("m1", "metadata", "q1", "u1", "d1", "application/warc-fields", "x: y"),
        ("m1", "metadata", "q1", "u1", "d1", "application/warc-fields", "x: y"),  # repeated
        ("r2", "response", "q2", "u2", "d2", "application/http", "HTTP/1.1 200 OK\r\n\r\n"),  # names its request
        ("q2", "request", None, "u2", "d2", "application/http", "GET /2 HTTP/1.1\r\n\r\n"),
        ("q3", "request", "lost", "u3", "d3", "application/http", "GET /3"),
        (None, "metadata", "r1", None, None, None, None),
        ("w", "warcinfo", None, None, "d0", "text", "info"), (None, None, None, None, None, None, None),
    ]
    df = spark.createDataFrame([(*r[:-1], r[-1] and r[-1].encode()) for r in rows], warc.RECORDS).withColumn("root", F.lit(1)).withColumn("cut", F.lit(2))
    out = {r.capture_id: r for r in warc.assemble(df).collect()}
    assert set(out) == {"r1", "r2", "lost"}
    assert out["r1"].http_status == 404 and out["r1"].response.payload == b"body" and [q.record_id for q in out["r1"].requests] == ["q1"]
    assert Counter(m.record_id for m in out["r1"].metadata) == Counter(["m1", None])
    assert [q.record_id for q in out["r2"].requests] == ["q2"] and out["lost"].response is None
    assert warc.assemble(df.where("false")).count() == 0


def test_warc_files(spark, tmp_path):
    def record(kind, rid, to, body):
        head = f"WARC/1.0\r\nWARC-Type: {kind}\r\nWARC-Record-ID: {rid}\r\n" + (f"WARC-Concurrent-To: {to}\r\n" if to else "") + f"Content-Type: application/http\r\nContent-Length: {len(body)}\r\n\r\n"
        return head.encode() + body + b"\r\n\r\n"

    raw = record("response", "<a>", None, b"HTTP/1.1 200 OK\r\n\r\nhi") + record("request", "<b>", "<a>", b"GET / HTTP/1.1\r\n\r\n")
    (tmp_path / "x.warc").write_bytes(raw)
    (tmp_path / "y.warc.gz").write_bytes(gzip.compress(record("metadata", "<c>", "<b>", b"k: v")))
    out = warc.assemble(warc.read_warc(spark, [str(tmp_path / "x.warc"), str(tmp_path / "y.warc.gz")])).collect()
    assert len(out) == 1 and out[0].response.payload == b"hi" and len(out[0].requests) == len(out[0].metadata) == 1


# quality rules


def test_quality_measures(spark):
    rows = documents(spark, [(1, None), (2, ""), (3, "the cat sat on the mat"), (4, "#### $$$$ ####"), (5, "A\nA\n\nA\nb"), (6, "WWW " * 20)])
    out = {r["doc_id"]: r for r in quality.apply_rules(rows).select("row.doc_id", *quality.MEASURES, "broken", "keep").collect()}
    assert out[1].broken == out[2].broken == "too_short,word_length" and out[3].keep and out[3].stop_word_ratio == 0.5
    assert "symbols" in out[4].broken and out[5].duplicate_line_ratio == 0.5 and "capitals" in out[6].broken
    plan = quality.apply_rules(rows)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan


# mixing


def test_apportionment_like_brute_force(spark):
    rng = random.Random(23)
    groups, want = [], {}
    for g in range(25):
        names = [(f"n{i}", rng.choice([0.0, 1.0, 2.0, 5.5, 100.0, 100.0]), rng.randrange(0, 40)) for i in range(rng.randrange(1, 7))]
        seats = rng.randrange(0, 90)
        quotients = sorted(((-w / (2 * j + 1), n, j) for n, w, b in names if w > 0 for j in range(b)))[:seats]
        want |= {(g, n): c for n, c in Counter(n for _, n, _ in quotients).items()}
        groups += [(g, n, w, b, seats) for n, w, b in names]
    df = spark.createDataFrame(groups, "g int, name string, weight double, blocks bigint, seats bigint")
    assert {(r.g, r.name): r.n for r in mixing.apportion(df, ["g"], "name").collect()} == want


def test_largest_mixture_like_brute_force(spark):
    rng = random.Random(53)
    for _ in range(12):
        names = [(f"n{i}", rng.choice([0.0, 1.0, 1.0, 2.0, 3.0, 5.5, 0.1]), rng.randrange(1, 40)) for i in range(rng.randrange(1, 8))]
        ranked = sorted((-w / (2 * j + 1), n, j, j == b) for n, w, b in names if w > 0 for j in range(b + 1))
        want: Counter = Counter()
        for _, n, _, lacking in ranked:
            if lacking:
                break
            want[n] += 1
        got = {r.name: r.n for r in mixing.largest(spark.createDataFrame(names, "name string, weight double, blocks bigint"), "name").collect()}
        assert got == dict(want), names


def test_shares_of_large_sources_are_capped(spark):
    for blocks, want in (([10, 10, 10, 10, 10], None), ([60, 10, 10, 10, 10], {"n0": 0.3 * 40 / 0.7}), ([60, 40, 5, 5, 5], {"n0": 0.3 * 15 / 0.4, "n1": 0.3 * 15 / 0.4}), ([7], None), ([9, 3], {"n0": 3.0}), ([40, 40, 20], {"n0": 20.0, "n1": 20.0}), ([7, 7, 7], None)):
        names = [(f"n{i}", b) for i, b in enumerate(blocks)]
        got = {r.source_key: r.weight for r in mixing.capped(spark.createDataFrame(names, "source_key string, blocks bigint"), 0.3).collect()}
        assert got == pytest.approx({n: float(b) for n, b in names} | (want or {}))


def test_mixing_like_sql(spark, tmp_path):
    import duckdb

    rng = random.Random(59)
    rows = [(i, prose(rng, rng.randrange(200, 900)), "aaaaaabc"[i % 8] if i % 11 else rng.choice(["d", None])) for i in range(500)] + [(3, "x", "a"), (3, "x", "a"), (None, None, None), (700, "", "d"), (701, "東京 " * 3000, "b")]
    documents(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = Counter(con.execute(mixing.sql()).fetchall())
    got = Counter(map(tuple, mixing.op9_mixing(spark, str(tmp_path)).collect()))
    assert (got - want, want - got) == (Counter(), Counter()) and 50 < sum(n for r, n in got.items() if r[1] == "a") < 340


def test_mixing_reaches_targets(spark):
    rng = random.Random(29)
    docs = documents(spark, [(i, prose(rng, 50), "abc"[i % 10 // 4]) for i in range(2_000)])
    settings = {"block_tokens": 500, "shard_tokens": 5_000}
    n = Counter(r.source for r in mixing.mix(docs, weights={"a": 1, "b": 1, "c": 1}, **settings).collect())
    assert n["c"] == 400 and abs(n["a"] - 400) < 12 and abs(n["b"] - 400) < 12  # the scarce source is whole
    n = Counter(r.source for r in mixing.mix(docs, weights={"a": 2, "b": 2}, other=1, **settings).collect())
    assert sum(n.values()) == 2_000  # weights as the sources are: all stays
    n = Counter(r.source for r in mixing.mix(docs, weights={"a": 1, "b": 1}, other=0, total=100, **settings).collect())
    assert set(n) == {"a", "b"} and abs(n["a"] - n["b"]) < 40 and abs(sum(n.values()) - 1_000) < 60
    out = mixing.mix(docs, **settings)
    assert out.exceptAll(docs).count() == 0
    assert mixing.mix(documents(spark, [])).count() == 0
    assert mixing.mix(documents(spark, [*EDGES, (9, "x", None)]), weights={None: 1, "web": 2}).count() == len(EDGES) + 1
    assert mixing.mix(documents(spark, EDGES)).count() == len(EDGES)  # one source
    tokens = [r.tokens for r in mixing.keyed(documents(spark, [(1, "two words"), (2, "東京 に行く ok"), (3, None), (4, "")])).orderBy("id").collect()]
    assert tokens == [2, 3 + 5, 0, 0]


# HTML


@pytest.mark.parametrize(
    ("html", "text"),
    [
        ("", ""), ("plain & simple", "plain & simple"), ("<p>one<p>two", "one\n\ntwo"), ("a<br>b", "a\nb"), ("<div>a</div><div>b</div>", "a\nb"),
        ("<ul><li>x<li>y</ul>", "- x\n- y"), ("<ol start=3><li>x<li>y</ol>", "3. x\n4. y"), ("<ul><li>x<ul><li>y</ul></ul>", "- x\n  - y"),
        ("<head><title>t</title></head><script>var a='<p>';</script><style>p{}</style><p>v</p>", "v"), ("<p hidden>n</p><p style='display:none'>n</p><p>v", "v"),
        ("<table><tr><td>a<td>bb<tr><td>ccc<td>d</table>", "a    bb\nccc  d"), ("<table><tr><th colspan=2>wide</th></tr><tr><td>a</td><td>b</td></tr></table>", "wide\na  b"),
        ("<pre>a\n  b</pre>", "a\n  b"), ("x < y &amp; z &lt;", "x < y & z <"), ("<p>a<!-- <p>b --> c", "a c"), ("a</p>b</nothing>", "ab"), ("<b>bo</b>ld <i> it </i>", "bold it"), ("<unclosed attr='", "<unclosed attr='"),
    ],
)
def test_rendering(html, text):
    assert html_text.render(html) == text


def test_html_survives_anything(spark):
    rng = random.Random(31)
    pieces = ["<p>", "</p>", "<table>", "<tr>", "<td>", "</table>", "<div hidden>", "</div>", "<li>", "<ul>", "text", "&amp", "<!--", "-->", "<", ">", "<script>", "</script>", "'", '"', "<b x='"]
    for _ in range(300):
        html_text.render("".join(rng.choice(pieces) for _ in range(60)))
    assert "deep" in html_text.render("<div>" * 3_000 + "deep")
    assert len(html_text.render("<p>w</p>" * 50_000)) > 100_000
    df = spark.createDataFrame([(1, "u", None), (2, None, "<p>a"), (2, None, "<p>a"), (None, "u", "")], "page_id bigint, url string, html string").withColumn("text", F.lit(0))
    assert Counter(r.text for r in html_text.html_text(df).collect()) == Counter([None, "a", "a", ""])
    assert html_text.html_text(df.where("false")).count() == 0


@pytest.mark.parametrize(("page", "want"), [
    ("<p>so <math><mi>x</mi><mo>=</mo><mn>2</mn><annotation>tex</annotation></math> holds", "so x=2 holds"),
    ("<svg><title>n</title><desc>n</desc><path d='M0'/><style>n</style>n<g><text x='1'>Sales <tspan>2024</tspan></text></g><text>Cost</text></svg>", "Sales 2024\nCost"),
    ("<svg>" + "<path d='M0'/>" * 300 + "<text>deep</text></svg><p>after", "deep\n\nafter"),
    ("<svg><path d='M0'><p>left open", "left open"),
    ("<p>at <select><option>a<option selected>b<option>c</select> end", "at b end"),
    ("<select><option disabled>n<option>a<option>b</select>", "a"),
    ("<select><option hidden selected>Choose<option>a</select>", "Choose"),
    ("<select multiple><optgroup label='G'><option>a<option>b</select>", "G\na\nb"),
    ("<div style='visibility:hidden'>n<p style='visibility:visible'>v</p>n</div>", "v"),
    ("<div style='display:none'>n<p style='visibility:visible'>n</p></div>v", "v"),
    ("<p style='backface-visibility:hidden'>v</p>", "v"),
    ("<svg style='visibility:hidden'><text>n</text><text style='visibility:visible'>v</text></svg>", "v"),
])
def test_html_visible_text_of_embedded_elements(page, want):
    from candela.llm import html_text

    assert html_text.render(page) == want


def test_warc_chains_and_several_references(spark, tmp_path):
    def record(kind, rid, to):
        named = "".join(f"WARC-Concurrent-To: {t}\r\n" for t in to)
        return f"WARC/1.1\r\nWARC-Type: {kind}\r\nWARC-Record-ID: {rid}\r\n{named}Content-Length: 1\r\n\r\nx\r\n\r\n".encode()

    parts = [("response", "<r>", []), ("request", "<q>", ["<r>"]), ("metadata", "<m1>", ["<q>"]), ("metadata", "<m2>", ["<m1>"]), ("metadata", "<m3>", ["<m2>"]), ("metadata", "<n>", ["<r>", "<gone>"]), ("metadata", "<o1>", ["<o2>"]), ("metadata", "<o2>", ["<o1>"])]
    (tmp_path / "z.warc").write_bytes(b"".join(record(*p) for p in parts))
    out = {r.capture_id: r for r in warc.assemble(warc.read_warc(spark, [str(tmp_path / "z.warc")])).collect()}
    assert [m.record_id for m in out["<r>"].metadata] == ["<m1>", "<m2>", "<m3>", "<n>"] and len(out["<r>"].requests) == 1
    assert set(out) == {"<r>", "<o1>", "<o2>"} and out["<o1>"].response is None


@pytest.mark.parametrize(("page", "want"), [
    ("<div>" * 10_000 + "<p hidden>SECRET</p>tail", "tail"),
    ("<table><tr><td rowspan=2>A<td>b<tr><td>c</table>", "A  b\n   c"),
    ("<table><tr><td>東京<td>x<tr><td>abcd<td>y</table>", "東京  x\nabcd  y"),
    ("<table><tr><td><p>a<p>b<td>c</table>", "a  c\n\nb"),
    ("<p title='a>b'>x</p><p don't>y", "x\n\ny"),
    ("<blockquote><p>a<p>b</blockquote>c", "  a\n\n  b\n\nc"),
])
def test_html_layout(page, want):
    assert html_text.render(page) == want


def test_html_is_linear_in_any_depth():
    import time

    began = time.time()
    assert html_text.render("<a " * 400_000).startswith("<a <a")
    assert time.time() - began < 1
    for piece, text in (("<div>", ""), ("<ul><li>", ""), ("<table><tr><td>x<td>", ""), ("<blockquote>q", ""), ("<svg>", ""), ("<p><table>", "")):
        out = html_text.render(piece * 20_000 + text + "<i hidden>SECRET</i>end")
        assert "SECRET" not in out and out.endswith("end") and len(out) < 60 * len(piece) * 20_000


class Visible(HTMLParser):
    """Words of well-formed pages in their order, without those of hidden elements."""

    def __init__(self):
        super().__init__()
        self.words, self.hidden = [], []

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        if tag not in html_text.VOID:
            self.hidden.append(bool(self.hidden and self.hidden[-1]) or "hidden" in a or "display:none" in (a.get("style") or "") or tag in ("script", "style"))

    def handle_endtag(self, tag):
        self.hidden.pop()

    def handle_data(self, data):
        if not (self.hidden and self.hidden[-1]):
            self.words += data.split()


def test_html_words_like_another_parser():
    rng = random.Random(37)
    count = 0

    def tree(depth):
        nonlocal count
        out = ""
        for _ in range(rng.randrange(1, 4)):
            count += 1
            kind = rng.randrange(8)
            if depth == 0 or kind < 3:
                out += rng.choice([f" w{count} ", f" w{count}&amp;x<br>", f"<!-- n{count} --> ", f"<script>n{count}</script> "])
            else:
                tag, inner = rng.choice(["div", "section", "b", "blockquote", "span"]), tree(depth - 1)
                how = rng.choice(["", "", " hidden", " style='display:none'", " class=\"a>b\""])
                out += f"<{tag}{how}>{inner}</{tag}> " if kind < 6 else f"<ul{how}><li>{inner}</li></ul> " if kind == 6 else f"<table{how}><tr><td>{inner}</td></tr></table> "
        return out

    for _ in range(200):
        page = tree(6)
        other = Visible()
        other.feed(page)
        assert [w for w in html_text.render(page).split() if w != "-"] == other.words, page


def test_warc_assembly_like_brute_force(spark):
    """Misses, repeats, chains, cycles, several references and responses that name their request."""
    rng = random.Random(61)
    rows = []
    for k in range(300):
        kind = rng.choice(["response", "request", "request", "metadata", "metadata", "revisit", "warcinfo"])
        to = " ".join(f"<{rng.randrange(330)}>" for _ in range(rng.choice([0, 1, 1, 1, 2]))) or None
        rows.append((f"<{k}>" if rng.random() < 0.97 else None, kind, to, f"u{k}", f"d{rng.randrange(9)}", rng.choice(["application/http", "text", None]), rng.choice([b"HTTP/1.1 200 OK\r\n\r\n\xff\xfe", b"plain", b"", None])))
    rows += rng.sample(rows, 20)
    main = [r for r in set(rows) if r[1] in warc.CAPTURES]
    others = [r for r in set(rows) if r[1] in ("request", "metadata")]
    parents = defaultdict(set)
    for r in others:
        if r[0]:
            parents[r[0]] |= set((r[2] or "").split())
    for r in main:
        if r[0]:
            for t in (r[2] or "").split():
                parents[t].add(r[0])
    level = {r[0]: r[0] for r in main if r[0]}
    roots, found = dict(level), {}
    while level:  # the nearest response, and of several the least
        new = {c: min(level[p] for p in ps if p in level and p != c) for c, ps in parents.items() if c not in found and any(p in level and p != c for p in ps)}
        found |= new
        level = new
    want = defaultdict(lambda: (set(), set()))
    for r in others:
        if r[0] or r[2]:
            want[found.get(r[0]) or (r[2] or "").split()[0] if found.get(r[0]) or r[2] else r[0]][r[1] == "metadata"].add((r[0], r[4], r[5], r[6]))
    for r in main:
        if r[0] or r[2]:
            want[r[0] or r[2].split()[0]]
    out = warc.assemble(spark.createDataFrame(rows, warc.RECORDS)).collect()
    whole = lambda b: None if b.payload is None and b.http_head is None else (b.http_head.encode() + b"\r\n\r\n" if b.http_head is not None else b"") + b.payload
    got = {r.capture_id: tuple({(b.record_id, b.warc_date, b.content_type, whole(b)) for b in part} for part in (r.requests, r.metadata)) for r in out}
    assert got == dict(want)
    assert {r.capture_id for r in out if r.response is not None} == set(roots) | {r[2].split()[0] for r in main if not r[0] and r[2]}


def test_warc_malformed(spark, tmp_path):
    good = b"WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <a>\r\nContent-Type: application/http\r\nContent-Length: 21\r\n\r\nHTTP/1.1 200 OK\r\n\r\n\xff\xfe\r\n\r\n"
    (tmp_path / "x.warc").write_bytes(b"junk\nmore\n" + good + b"WARC/1.0\r\nContent-Length: many\r\n\r\nlost\r\n" + good.replace(b"<a>", b"<b>"))
    (tmp_path / "y.warc.gz").write_bytes(gzip.compress(good.replace(b"<a>", b"<c>")) + gzip.compress(good * 500)[:40])
    records = warc.read_warc(spark, [str(tmp_path / "x.warc"), str(tmp_path / "y.warc.gz")])
    assert {bytes(r.block).strip() for r in records.where("record_id is null").collect()} >= {b"junk\nmore", b"lost"}
    out = {r.capture_id: r for r in warc.assemble(records).collect()}
    assert {"<a>", "<b>", "<c>"} <= set(out) and bytes(out["<b>"].response.payload) == b"\xff\xfe" and out["<a>"].http_status == 200

"""Bars, patterns, labels, macro, journal: small scenarios, properties, and queries against DuckDB."""

from __future__ import annotations

import lzma
import math
import os
import random
import struct

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from candela import catalog
from candela.functions import stats
from candela.functions.registry import resolve, select
from candela.operators import bars as B
from candela.operators import calendar as C
from candela.operators.asof import asof_join
from candela.operators.labels import trade_labels
from candela.plans import discovery as D
from candela.plans import journal as J
from candela.plans import learning as L
from candela.plans import mining as M
from candela.sources import formats, merge

DATA = "/root/testdata/sf0.001"
CANDLE = "symbol string, timeframe string, ts timestamp_ntz, open double, high double, low double, close double, volume double, ask_volume double, bid_volume double, tick_count bigint, source string"


def candles(spark, ohlc, symbol="X", start="2024-01-01", minutes=60, source="dukascopy"):
    at = pd.Timestamp(start)
    rows = [(symbol, f"{minutes // 60}h", (at + pd.Timedelta(minutes=minutes * i)).to_pydatetime(), *map(float, x), 10.0 + i % 7, 6.0, 4.0, 5, source) for i, x in enumerate(ohlc)]
    return spark.createDataFrame(rows, CANDLE)


def walk(n, seed=1):
    rng, p, out = random.Random(seed), 2000.0, []
    for _ in range(n):
        o = p
        p += rng.gauss(0, 5)
        out.append((o, max(o, p) + abs(rng.gauss(0, 2)), min(o, p) - abs(rng.gauss(0, 2)), p))
    return out


def column(df, name):
    return [r[0] for r in df.orderBy("ts").select(name).collect()]


def test_hammer_or_hanging_man(spark):
    last = (100.0, 100.6, 97.0, 100.5)
    fall = [(111 - i, 111.5 - i, 109.5 - i, 110 - i) for i in range(10)] + [last]
    rise = [(89 + i, 90.5 + i, 88.5 + i, 90 + i) for i in range(10)] + [last]
    for bars, want in ((fall, (True, False)), (rise, (False, True))):
        r = resolve(candles(spark, bars), ["hammer", "hanging_man"]).orderBy(F.desc("ts")).first()
        assert (r.hammer, r.hanging_man) == want


def test_flat_bar_and_rsi_of_gains(spark):
    df = resolve(candles(spark, [(100 + i, 100 + i, 100 + i, 100 + i) for i in range(16)]), ["bar_range", "doji", "body_ratio", "rsi"])
    r = df.orderBy(F.desc("ts")).first()
    assert (r.bar_range, r.doji, r.body_ratio, r.rsi) == (None, False, 0.0, None)


def test_swing_is_known_after_confirmation(spark):
    bars = [(100, 101, 99, 100)] * 8 + [(100, 120, 99, 100)] + [(100, 101, 99, 100)] * 12
    levels = column(resolve(candles(spark, bars), ["swing_high"]), "swing_high")
    assert levels.index(120.0) == 8 + 6


def test_round_number_at_the_middle(spark):
    assert column(resolve(candles(spark, [(2025, 2030, 2020, 2025)]), ["round_level"]), "round_level") == [2050.0]


def test_edge_fires_once(spark):
    df = resolve(candles(spark, walk(400)), ["trend_following_long_state", "trend_following_long", "smc_bos_bullish_state", "smc_bos_bullish"]).orderBy("ts").collect()
    for name in ("trend_following_long", "smc_bos_bullish"):
        before = False
        for r in df:
            assert r[name] == (r[f"{name}_state"] and not before)
            before = r[f"{name}_state"]


def test_no_value_looks_ahead(spark):
    bars = walk(260)
    names = [n for n in B.BAR_PATTERNS if not n.startswith("session")]
    full = select(candles(spark, bars), names).toPandas().sort_values("ts").reset_index(drop=True)
    part = select(candles(spark, bars[:230]), names).toPandas().sort_values("ts").reset_index(drop=True)
    pd.testing.assert_frame_equal(full.iloc[:230], part)


def test_sessions_follow_dst(spark):
    df = candles(spark, [(1, 1, 1, 1)] * (24 * 10), start="2024-03-05")
    got = {r.ts for r in resolve(df, ["session_new_york_open"]).where("session_new_york_open").collect()}
    assert pd.Timestamp("2024-03-08 13:00").to_pydatetime() in got and pd.Timestamp("2024-03-11 12:00").to_pydatetime() in got


@pytest.mark.parametrize(("ahead", "outcome", "bars"), [([(100, 110, 50, 100)], "loss", 0), ([(100, 101, 99, 100)] * 59 + [(100, 500, 99.5, 100)], "win", 59), ([(100, 101, 99, 100)] * 60 + [(100, 500, 99.5, 100)], "unresolved", None)])
def test_first_hit(spark, ahead, outcome, bars):
    flat = [(100, 101, 99, 100)] * 15
    r = trade_labels(candles(spark, flat + ahead + flat)).where("direction = 1 and bar_idx = 14").first()
    assert (r.outcome, r.bars_to_resolve) == (outcome, bars)


def test_labels_like_brute_force(spark):
    bars = walk(300, 5)
    got = {(r.bar_idx, r.direction, r.rr): (r.outcome, r.bars_to_resolve) for r in trade_labels(candles(spark, bars), (1.5, 4.0)).collect()}
    tr = [max(h - l, *(abs(x - bars[i - 1][3]) for x in (h, l))) if i else h - l for i, (_, h, l, _) in enumerate(bars)]
    want = {}
    for i in range(13, len(bars) - 1):
        risk, entry = 1.5 * sum(tr[i - 13 : i + 1]) / 14, bars[i + 1][0]
        for side in (1, -1):
            for rr in (1.5, 4.0):
                stop, target = entry - side * risk, entry + side * rr * risk
                want[i, side, rr] = ("unresolved", None)
                for k, (_, h, l, _) in enumerate(bars[i + 1 : i + 61]):
                    if (l <= stop) if side > 0 else (h >= stop):
                        want[i, side, rr] = ("loss", k)
                        break
                    if (h >= target) if side > 0 else (l <= target):
                        want[i, side, rr] = ("win", k)
                        break
    assert got == want


def test_labels_of_nothing_and_extra_columns(spark):
    empty = candles(spark, walk(3)).where("false")
    assert trade_labels(empty).count() == 0 and select(empty, ["rsi", "macd_hist", "doji"]).count() == 0
    assert trade_labels(candles(spark, walk(40)).withColumn("note", F.lit("x"))).count() > 0


def test_asof_both_ways(spark):
    left = spark.createDataFrame([("a", 1), ("a", 5), ("a", 9), ("b", 5), (None, 5), ("a", None)], "k string, t int")
    right = spark.createDataFrame([("a", 5, "x"), ("a", 5, "y"), ("a", 8, "z"), ("b", 6, "w"), (None, 1, "n"), ("a", None, "m")], "k string, u int, v string")
    back = {(r.k, r.t): r.v for r in asof_join(left, right, ["k"], "t", "u", ["v"]).collect()}
    ahead = {(r.k, r.t): r.v for r in asof_join(left, right, ["k"], "t", "u", ["v"], "forward").collect()}
    assert back == {("a", 1): None, ("a", 5): "y", ("a", 9): "z", ("b", 5): None, (None, 5): None, ("a", None): None}
    assert ahead == {("a", 1): "x", ("a", 5): "x", ("a", 9): None, ("b", 5): "w", (None, 5): None, ("a", None): None}


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_fills_run_from_the_start_of_a_frame(spark):
    """A frame up to the end of the partition is evaluated anew for each row."""
    left, right = spark.createDataFrame([("a", 1)], "k string, t int"), spark.createDataFrame([("a", 5, "x")], "k string, u int, v string")
    for direction in ("backward", "forward"):
        assert "unboundedfollowing" not in plan_of(asof_join(left, right, ["k"], "t", "u", ["v"], direction)).lower()


@pytest.mark.parametrize("sizes", [("1min", "5min", "15min", "1h", "4h", "1d"), ("5min", "4h"), ("1h",)])
def test_candles_of_all_sizes_take_one_scan(spark, sizes):
    from candela.sources import market

    df = market.candles(spark, DATA, sizes)
    assert plan_of(df).count("Relation [") == 1
    one = {tf: plain(market.resample(market.ticks(spark, DATA), tf).toPandas()) for tf in sizes}
    assert plain(df.toPandas()) == sorted(r for rows in one.values() for r in rows)


def test_candles_of_unusual_ticks(spark, tmp_path):
    """Equal times, no type, no volume, no value; times with a zone."""
    from candela.sources import market

    rows = [(1, f"2024-01-01 {t}", u, e, v, p) for t, u, e, v, p in [("00:00:01", 1, "a", 5.0, '{"k": 3}'), ("00:00:01", 1, "b", 4.0, '{"k": 4}'), ("00:00:59.9", 1, None, 9.0, None), ("00:01:00", 1, "a", 2.0, "{}"), ("03:59:59", 1, "a", None, '{"k": 1}'), ("04:00:00", 1, "b", 7.0, '{"k": 2}'), ("23:59:59", 1, "a", 1.0, '{"k": 9}')]]
    for kind in ("timestamp_ntz", "timestamp"):
        at = f"{tmp_path}/{kind}"
        spark.createDataFrame(rows, "event_id int, ts string, user_id int, event_type string, value double, props string").withColumn("ts", F.col("ts").cast(kind)).write.parquet(f"{at}/events.parquet")
        df = market.candles(spark, at, ("1min", "1h", "4h", "1d"))
        one = [r for tf in ("1min", "1h", "4h", "1d") for r in plain(market.resample(market.ticks(spark, at), tf).toPandas())]
        assert plain(df.toPandas()) == sorted(one) and len(one) > 10


def test_bars_are_resampled_once_a_query(spark, monkeypatch):
    from candela.plans import mining_queries as Q

    made, whole = [], Q.bars
    monkeypatch.setattr(Q, "bars", lambda *a: made.append(a) or whole(*a))
    for name in ("by_news", "by_regime", "grouping_sets_summary", "news_in_window", "rr_grid_expectancy"):
        made.clear()
        read = plan_of(Q.QUERIES[name](spark, DATA))
        assert len(made) == 1 and not any(f"/{t}.parquet" in read for t in ("events", "lineitem", "orders")), name


def test_upsert_gaps_and_updates(spark):
    a, b = candles(spark, [(1, 1, 1, 1)] * 3), candles(spark, [(2, 2, 2, 2)] * 4, source="mt_broker")
    for both in (a.unionByName(b), b.unionByName(a)):
        assert column(merge.upsert(both), "open") == [1.0, 1.0, 1.0, 2.0]
    new = a.where("hour(ts) = 1").withColumn("ask_volume", F.lit(99.0)).withColumn("bid_volume", F.lit(None).cast("double"))
    assert column(merge.update_columns(a, new, ["ask_volume", "bid_volume"]), "ask_volume") == [6.0, 99.0, 6.0]
    gap = candles(spark, [(1, 1, 1, 1)] * 2).unionByName(candles(spark, [(1, 1, 1, 1)], start="2024-01-03 08:00")).unionByName(candles(spark, [(1, 1, 1, 1)], start="2024-01-05 17:00"))
    assert [r.gap_hours for r in merge.gaps(gap).collect()] == [57.0]


def test_first_vintage(spark):
    df = spark.createDataFrame([("2024-01-01", {"20240101": ".", "20240201": "1.0", "20240301": "1.1"}), ("2024-02-01", {"20240301": ""})], "date string, vintages map<string,string>")
    assert [(r.date, r.value) for r in C.first_published(df).collect()] == [("2024-01-01", 1.0)]


def test_false_discovery(spark):
    df = spark.createDataFrame([("a", 0.001), ("b", 0.02), ("c", 0.03)], "name string, p_value double")
    assert stats.bh_accept(df).where("accepted").count() == 3
    assert stats.bh_accept(df, n_tested=100).where("accepted").count() == 0
    assert math.isclose(stats.binomial_tail(7, 10, 0.6), sum(math.comb(10, k) * 0.6**k * 0.4 ** (10 - k) for k in range(7, 11)))


def trade_rows(spark, outcomes, pattern="p", idx=0):
    rows = [("X", "1h", idx + i, pattern, 1, 0, o, 1.0 if o == "win" else -1.0, 4.0, 1.0, 3, 1, 1) for i, o in enumerate(outcomes)]
    return spark.createDataFrame(rows, "symbol string, timeframe string, bar_idx bigint, pattern string, direction int, hint int, outcome string, net_r double, rr double, risk double, bars_to_resolve bigint, min_resolved int, min_oos int")


def test_last_occurrences_are_out_of_sample(spark):
    r = M.graded(trade_rows(spark, ["win"] * 7 + ["loss"] * 3)).first()
    assert (r.samples, r.wins, r.oos_samples, r.oos_win_rate, r.qualifies) == (10, 7, 3, 0.0, False)


def test_combos_are_what_fires_together(spark):
    dim = M.pattern_dim(spark)
    assert M.combo_pairs(dim).count() == 2093 and dim.count() == 80
    f = spark.createDataFrame([("X", "1h", 1, "doji"), ("X", "1h", 1, "adx_trending"), ("X", "1h", 2, "doji")], "symbol string, timeframe string, bar_idx int, pattern string")
    assert [r.pattern for r in M.combo_events(f, M.combo_pairs(dim)).collect()] == ["combo__doji__adx_trending"]


def journal(spark, rows):
    full = [(str(i), (pd.Timestamp("2024-01-01") + pd.Timedelta(hours=i)).to_pydatetime(), "1h", p, "long", "open" if o is None else "resolved", o, 1, "london", 1.0) for i, (p, o) in enumerate(rows)]
    return spark.createDataFrame(full, "signal_id string, logged_at_utc timestamp_ntz, timeframe string, pattern string, direction string, status string, outcome string, confluence_count int, session_at_entry string, volatility_shock_ratio double")


def test_credibility(spark):
    rows = [("few", "win")] * 9 + [("bad", "win" if i % 5 < 2 else "loss") for i in range(200)] + [("good", "win" if i % 4 else "loss") for i in range(200)]
    lib = spark.createDataFrame([(p, "1h", "long", 0.65) for p in ("few", "bad")], "pattern string, timeframe string, direction string, mined_win_rate double")
    assert {r.pattern: r.label for r in J.scorecard(journal(spark, rows), lib).collect()} == {"few": "UNPROVEN", "bad": "DECAYING", "good": "CONFIRMED"}


@pytest.mark.parametrize(("rows", "why"), [([("p", "win")] * 5 + [("p", "loss")] * 8, "losing"), ([("p", "loss")] * 7 + [("p", "win")] + [("p", "loss")] * 7 + [("p", "win")] + [("p", "loss")] * 7 + [("p", "win")] + [("p", "loss")] * 7, "fallen"), ([("p", None)] * 6, "crowded")])
def test_breaker(spark, rows, why):
    r = J.circuit_breaker(journal(spark, rows)).first()
    assert r.tripped and [k for k in ("losing", "fallen", "crowded") if r[k]] == [why]


def test_vote(spark):
    active = spark.createDataFrame([("X", "1h", "a", 1, True, True), ("X", "15min", "b", -1, True, True), ("X", "15min", "c", -1, False, True)], "symbol string, timeframe string, pattern string, direction int, regime_ok boolean, coarse_ok boolean")
    lib = spark.createDataFrame([("a", "1h", 1, 200, 0.7, 2 / 3), ("b", "15min", -1, 200, 0.7, 0.5), ("c", "15min", -1, 200, 0.7, 0.9)], "pattern string, timeframe string, direction int, resolved bigint, win_rate double, wilson_lower double")
    none = spark.createDataFrame([], "pattern string, timeframe string, direction int")
    r = J.vote(active, lib, none).first()
    assert r.signal == "BUY" and math.isclose(r.agreement, 1 / 3) and r.primary_pattern == "a"
    assert J.vote(active, lib, spark.createDataFrame([("a", "1h", 1)], none.schema)).first().signal == "SELL"


def test_position_size(spark):
    plan = spark.createDataFrame([(5.0,)], "risk double")
    assert J.position_size(plan, 10_000, 1.0).first().units == 20.0
    with pytest.raises(ValueError):
        J.position_size(plan, 0, 1.0)
    with pytest.raises(Exception, match="positive"):
        J.position_size(spark.createDataFrame([(0.0,)], "risk double"), 1.0, 1.0).collect()


def test_purged_splits():
    assert list(L.purged_splits(600)) == [(s - 71, s, s + 100) for s in (100, 200, 300, 400, 500)]


def test_beam_finds_a_planted_pair(spark):
    rng, flags, labels = random.Random(3), [], []
    for i in range(2_000):
        a, b, c = (rng.random() < 0.5 for _ in range(3))
        flags += [("X", "1h", i, n) for n, on in (("slope_up_5", a), ("stoch_below_20", b), ("seasonality_month_1", c)) if on]
        labels.append(("X", "1h", i, 1, "win" if a and b and rng.random() < 0.95 else "loss" if rng.random() < 0.6 else "win"))
    f = spark.createDataFrame(flags, "symbol string, timeframe string, bar_idx bigint, primitive string")
    lab = spark.createDataFrame(labels, "symbol string, timeframe string, bar_idx bigint, direction int, outcome string")
    sizes = spark.createDataFrame([("X", "1h", 2_000)], "symbol string, timeframe string, n_bars bigint")
    best = D.beam_search(f, D.primitive_dim(spark, ["slope_up_5", "stoch_below_20", "seasonality_month_1"]), lab, sizes, depth=3).orderBy(F.desc("worst_era_score")).first()
    assert set(best.pattern.split("&")) >= {"slope_up_5", "stoch_below_20"} and best.worst_era_score > 0.6


def test_mann_whitney_like_brute_force(spark):
    rng = random.Random(9)
    t = [("X", "1h", i, "p", 1, rng.choice(["win", "loss"])) for i in range(60)]
    v = {i: float(rng.randrange(8)) for i in range(60)}
    trades = spark.createDataFrame(t, "symbol string, timeframe string, bar_idx bigint, pattern string, direction int, outcome string")
    long = spark.createDataFrame([("X", "1h", i, "f", x) for i, x in v.items()], "symbol string, timeframe string, bar_idx bigint, feature string, value double")
    r = D.mann_whitney(trades, long).first()
    w, l = [v[x[2]] for x in t if x[5] == "win"], [v[x[2]] for x in t if x[5] == "loss"]
    assert r.u == sum((a > b) + (a == b) / 2 for a in w for b in l)


def test_tick_files(spark, tmp_path):
    hour = pd.Timestamp("2024-02-03 04:00")
    raw = struct.pack(">3I2f", 1500, 2_000_500, 2_000_100, 1.5, 2.5) + struct.pack(">3I2f", 3_599_999, 2_001_000, 2_000_000, 1, 1)
    for h, content in ((hour, lzma.compress(raw)), (hour + pd.Timedelta(hours=1), b"")):
        at = tmp_path / formats.cache_path("XAUUSD", h)
        os.makedirs(at.parent, exist_ok=True)
        at.write_bytes(content)
    rows = formats.read_ticks(spark, str(tmp_path)).orderBy("ts").collect()
    assert [(r.ask, r.bid, round(r.mid, 3)) for r in rows] == [(2000.5, 2000.1, 2000.3), (2001.0, 2000.0, 2000.5)]
    assert rows[0].ts == pd.Timestamp("2024-02-03 04:00:01.5").to_pydatetime() and formats.url_path("A", hour) == "A/2024/01/03/04h_ticks.bi5"
    with pytest.raises(ValueError):
        formats.decode_hour("A/2024/02/03/04h_ticks.bi5", lzma.compress(b"123"))


def test_broker_files(spark, tmp_path):
    (tmp_path / "x.csv").write_text("# gmt_offset_seconds=7200\ntimestamp_server,open,high,low,close,volume\n2024.01.01 02:00:00,1,2,0.5,1.5,10\nbad,1,2,0,1,1\n2024.01.01 03:00:00,x,2,0,1,1\n")
    rows = formats.import_broker(spark, [str(tmp_path / "x.csv")], "XAUUSD", "1h").collect()
    assert [(r.ts, r.close, r.source) for r in rows] == [(pd.Timestamp("2024-01-01").to_pydatetime(), 1.5, "mt_broker")]


def test_candle_partitions_are_replaced(spark, tmp_path):
    at = str(tmp_path / "c")
    formats.write_candles(candles(spark, walk(5)).unionByName(candles(spark, walk(5), symbol="Y")), at)
    formats.write_candles(candles(spark, walk(2)), at)
    assert {(r.symbol, r["count"]) for r in formats.read_candles(spark, at).groupBy("symbol").count().collect()} == {("X", 2), ("Y", 5)}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{f}'")
    return con


def plain(df):
    df = df[sorted(df.columns)]
    text = df.apply(lambda c: c.map(lambda x: "" if pd.isna(x) else f"{float(x):.6g}" if isinstance(x, (int, float)) and not isinstance(x, bool) else str(x)))
    return sorted(map(tuple, text.to_numpy()))


@pytest.mark.parametrize("name", ["ohlc_resample_1h", "priority_upsert", "gap_detection", "rsi", "macd", "daily_pivots", "candlestick_double", "order_blocks", "session_events", "macro_deltas", "surprise_zscores", "trade_labels", "combo_pairs", "pattern_scorecard", "context_penalty", "circuit_breaker", "bh_correction", "cross_timeframe_context"])
def test_query_like_sql(spark, duck, name):
    assert plain(catalog.QUERIES[name](spark, DATA).toPandas()) == plain(duck.execute(catalog.SQL[name]).fetchdf())


@pytest.mark.parametrize("left", [[], ["corpus_pipeline.py"]])
def test_entry_without_the_llm_folders(tmp_path, left):
    import shutil
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    shutil.copytree(f"{root}/candela", tmp_path / "candela", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    for name in ["__spark_entry__.py", *left]:
        shutil.copy(f"{root}/{name}", tmp_path)
    say = [sys.executable, "-c", "import __spark_entry__ as e; q = e.queries(); print(len(q), 'pipeline' in q, set(e.oracle_sql()) - set(q))"]
    run = lambda: subprocess.run(say, cwd=tmp_path, capture_output=True, text=True, env=os.environ | {"PYTHONPATH": ""})
    out = run()
    assert out.stdout.split()[1:] == ["False", "set()"], out.stderr
    if not left:  # a module that the operators need is no reason to leave them out silently
        (tmp_path / "candela/llm").mkdir()
        (tmp_path / "candela/llm/__init__.py").write_text("")
        (tmp_path / "candela/llm/queries.py").write_text("import no_such_module")
        assert "no_such_module" in run().stderr


def test_whole_queries_take_every_candle_size(spark):
    symbols = {r[0] for r in spark.read.parquet(f"{DATA}/events.parquet").select("event_type").distinct().collect()} | {"ALL"}
    every = {(s, tf) for s in symbols for tf in ("1min", "5min", "15min", "1h", "4h", "1d")} | {("SHIP", "1d")}
    assert {(r.symbol, r.timeframe) for r in catalog.QUERIES["atr_all"](spark, DATA).select("symbol", "timeframe").distinct().collect()} == every
    assert {r.timeframe for r in catalog.entry(spark, DATA).select("timeframe").distinct().collect()} == {tf for _, tf in every}


def test_beam_search_gets_every_primitive(spark, monkeypatch):
    from candela.operators.primitives import PRIMITIVES
    from candela.plans import discovery_queries as Q

    seen = {}

    def search(flags, dim, labels, sizes, **settings):
        seen.update(names={r.primitive for r in dim.collect()}, families={r.family for r in flags.join(dim, "primitive").select("family").distinct().collect()}, ratios={r.rr for r in labels.select("rr").distinct().collect()}, settings=settings)
        return spark.createDataFrame([], "pattern string, direction int")

    monkeypatch.setattr(D, "beam_search", search)
    Q.beam_search(spark, DATA, ("1h",))
    assert seen["names"] == set(PRIMITIVES) and seen["ratios"] == {4.0} and seen["settings"] == {}
    # that fired on these tables: all families but those whose events may not occur
    assert seen["families"] >= {f for f, _ in PRIMITIVES.values()} - {"fundamental"}


def test_syntheses_are_registered_at_full_size(spark, monkeypatch):
    import inspect

    from candela.operators import features as X
    from candela.plans import discovery_queries as Q

    seen = []
    none = spark.createDataFrame([], "symbol string")
    monkeypatch.setattr(Q, "_inputs", lambda *a: (none, none, none))
    monkeypatch.setattr(Q.X, "features", lambda b, names=None: b)
    for name, found in (("synthesize", ([], 0)), ("synthesize_features", [])):
        settings = inspect.signature(getattr(D, name))
        monkeypatch.setattr(D, name, lambda *a, found=found, settings=settings, **k: seen.append(settings.bind(*a, **k)) or found)
        assert {k: settings.parameters[k].default for k in ("size", "generations", "survivors")} == {"size": 60, "generations": 3, "survivors": 12}
    Q.genetic_synthesis(spark, DATA), Q.feature_synthesis(spark, DATA)
    assert [set(s.arguments) for s in seen] == [{"bars", "labels", "sizes"}, {"features", "names", "labels", "sizes"}]
    assert seen[1].arguments["names"] == X.FEATURES and len(X.FEATURES) == 84


def test_false_discovery_runs_over_pairs(spark, monkeypatch):
    from candela.plans import mining_queries as Q

    dim = M.pattern_dim(spark).collect()
    pairs = M.combo_pairs(M.pattern_dim(spark)).collect()
    assert Q.trials(spark) == sum(1 if r.hint else 2 for r in [*dim, *pairs])
    rows = trade_rows(spark, ["win"] * 7 + ["loss"] * 3).unionByName(trade_rows(spark, ["win"] * 40, "combo__a__b"))
    asked = []
    monkeypatch.setattr(Q, "trades", lambda s, d, pairs=False, ratios=(4.0,), timeframes=(): asked.append((pairs, timeframes)) or rows)
    got = {r.name: r for r in Q.QUERIES["fdr_accept"](spark, DATA).collect()}
    assert asked == [(True, Q.ALL)]
    assert math.isclose(got["p/1"].p_value, sum(math.comb(10, k) * 0.6**k * 0.4 ** (10 - k) for k in range(7, 11)), abs_tol=1e-5)
    assert {n for n, r in got.items() if r.accepted} == {"combo__a__b/1"}


def test_autopsies_test_every_feature(spark, monkeypatch):
    from candela.operators import features as X
    from candela.plans import discovery_queries as Q

    asked = []
    monkeypatch.setattr(Q, "bars", lambda s, d, timeframes: candles(spark, walk(60)))
    monkeypatch.setattr(Q, "trades", lambda s, d, timeframes: asked.append(timeframes) or trade_rows(spark, ["win", "loss"] * 10, idx=35))
    monkeypatch.setattr(Q.D, "mann_whitney", lambda t, long, **k: long)
    monkeypatch.setattr(Q.D, "autopsy", lambda t, long, **k: long)
    monkeypatch.setattr(Q.D, "spearman_by_era", lambda long, labels, sizes: long)
    for name in ("mann_whitney_all", "mann_whitney_autopsy", "spearman_by_era_all"):
        got = {r.feature for r in catalog.QUERIES[name](spark, DATA).select("feature").distinct().collect()}
        assert {"f_macd_line_norm", "f_macd_hist_norm", "f_adx_14", "f_rsi_14"} <= got <= set(X.FEATURES)
    assert asked == [Q.ALL, Q.ALL]


def test_entry_bar_gives_the_regime(spark, monkeypatch):
    from candela.plans import mining_queries as Q

    b = candles(spark, walk(400, 5))
    regimes = {r.bar_idx: r.combined_regime for r in resolve(b, ["bar_idx", "combined_regime"]).collect()}
    assert any(regimes[i] != regimes[i + 1] for i in range(150, 399))
    rows = trade_rows(spark, ["win", "loss"] * 90, idx=150).withColumn("symbol", F.lit("X")).withColumn("timeframe", F.lit("1h"))
    monkeypatch.setattr(Q, "bars", lambda *a: b)
    monkeypatch.setattr(Q, "trades", lambda *a, **k: rows)
    got = {r.bar_idx: r.regime for r in Q.with_regime(spark, DATA).collect()}
    assert got == {i: regimes[i + 1] for i in range(150, 330)}


def planted(spark, n=4000, seed=3):
    """Flags of 1h and of half as many 4h bars, in which a and b together foretell a win to the long side, and c nothing."""
    rng = random.Random(seed)
    flags, labels = [], []
    for tf, size in (("1h", n), ("4h", n // 2)):
        for i in range(size):
            on = {x for x in ("a", "b", "c") if rng.random() < 0.5}
            flags += [("X", tf, i, x) for x in on]
            for side in (1, -1):
                won = rng.random() < (0.9 if side == 1 and {"a", "b"} <= on else 0.35)
                labels.append(("X", tf, i, side, 4.0, "win" if won else "loss", 4.0 if won else -1.0, 1.0, rng.randrange(9)))
    dim = spark.createDataFrame([("a", "one", 0), ("b", "two", 1), ("c", "three", 0)], "primitive string, family string, hint int")
    sizes = spark.createDataFrame([("X", "1h", n), ("X", "4h", n // 2)], "symbol string, timeframe string, n_bars bigint")
    f = spark.createDataFrame(flags, "symbol string, timeframe string, bar_idx bigint, primitive string")
    return f, dim, spark.createDataFrame(labels, "symbol string, timeframe string, bar_idx bigint, direction int, rr double, outcome string, net_r double, risk double, bars_to_resolve bigint"), sizes, flags, labels


def test_discovery_of_a_planted_pair(spark):
    f, dim, labels, sizes, flags, rows = planted(spark)
    out = {(r.timeframe, r.pattern, r.direction): r for r in D.discover(f, dim, labels, sizes, n_synthesis=10, least=0.3, better=0.01).collect()}
    discovered = {k for k, r in out.items() if r.discovered}  # with c in addition the edge is there too
    assert {("1h", "a&b", 1), ("4h", "a&b", 1)} <= discovered <= {(tf, p, 1) for tf in ("1h", "4h") for p in ("a&b", "a&b&c")}
    r = out["1h", "a&b", 1]
    both = sorted({i for _, tf, i, x in flags if tf == "1h" and x == "a"} & {i for _, tf, i, x in flags if tf == "1h" and x == "b"})
    won = {i for _, tf, i, side, _, o, *_ in rows if tf == "1h" and side == 1 and o == "win"}
    early = [i for i in both if i < 3000]
    assert (r.resolved, r.wins) == (len(early), len(won & set(early))) and r.confirm_resolved == len(both) - len(early) and r.full_resolved == len(both)
    n, wins = len(early), len(won & set(early))
    assert r.p_value == pytest.approx(stats.binomial_tail(wins, n, 0.6), abs=1e-12)
    assert (r.coarse_timeframe, r.coarse_qualifies, out["4h", "a&b", 1].coarse_timeframe) == ("4h", True, None)
    # depth 1: a and c on both sides, b on its own; depth 2 and 3 by hand from the parents that passed
    assert r.n_tested >= 10 + 5 + 2 and r.threshold == pytest.approx(r["rank"] * 0.05 / r.n_tested)
    none = D.discover(f.where("false"), dim, labels, sizes)
    assert none.count() == 0
    assert {(x.timeframe, x.n_tested) for x in D.searched(f.where("false"), dim, labels, sizes).tested.collect()} == {("1h", 5), ("4h", 5)}


def test_trials_are_counted(spark):
    """One parent, a to the long side, so that the extensions are known: b (its hint agrees) and c."""
    f, dim, labels, sizes, flags, rows = planted(spark)
    s = D.searched(f, dim, labels, sizes, least=0.0, width=1, depth=2, better=0.0, seeds=dim.where("primitive = 'a'"))
    assert {r.n_tested for r in s.tested.collect()} <= {2 + 2, 2 + 1} and s.found.count() == 2
    noise = D.discover(f, dim, labels.withColumn("outcome", F.lit("loss")), sizes, least=0.0, better=0.0)
    assert not any(r.discovered for r in noise.collect())


def test_live_check_and_exploration(spark):
    f, dim, labels, sizes, flags, rows = planted(spark, 400)
    patterns = spark.createDataFrame([("X", "1h", p, 1) for p in ("a", "a&b", "a&b&c", "b&a")], "symbol string, timeframe string, pattern string, direction int")
    last = {x for _, tf, i, x in flags if tf == "1h" and i == 399}
    assert {r.pattern for r in D.active_on_last_bar(patterns, f, sizes).collect()} == {p for p in ("a", "a&b", "a&b&c", "b&a") if set(p.split("&")) <= last}
    grid = labels.unionByName(labels.withColumn("rr", F.lit(2.0)).withColumn("net_r", F.expr("if(outcome = 'win', 2.0D, -1.0D)")))
    batches = [D.explored(D.searched(f, dim, labels, sizes, least=0.0, better=-1.0, depth=2, seeds=dim.where(F.col("primitive") == x)), grid) for x in "ab"]
    out = {(r.timeframe, r.pattern, r.direction): r for r in D.merge_explored(batches).collect()}
    r = out["1h", "a&b", 1]
    both = {i for _, tf, i, x in flags if tf == "1h" and x == "a"} & {i for _, tf, i, x in flags if tf == "1h" and x == "b"}
    nets = [net for _, tf, i, side, _, _, net, *_ in rows if tf == "1h" and side == 1 and i in both]
    assert (r.best_rr, r.tiers) == (4.0, 2) and r.best_net_r == pytest.approx(sum(nets) / len(nets), abs=1e-6)
    assert sum(k[1] == "a&b" and k[2] == 1 and k[0] == "1h" for k in out) == 1


def test_calibration_and_whole_ticks(spark):
    p = spark.createDataFrame([(x / 10, x % 2 == 0) for x in range(11)], "p double, won boolean")
    assert sum(r.n for r in J.calibration(p, 5).collect()) == 11
    assert J.calibration(p.where("false")).count() == 0 and [r.n for r in J.calibration(p.where("p = 0.3")).collect()] == [1]
    t = spark.createDataFrame([("X", pd.Timestamp("2024-01-01").to_pydatetime(), 2.0, 1.0, 5.0, 6.0, 1.5), ("X", pd.Timestamp("2024-01-01").to_pydatetime(), 1.0, 0.5, 7.0, 8.0, 0.75)], "symbol string, ts timestamp_ntz, ask double, bid double, ask_volume double, bid_volume double, mid double")
    assert [(r.ask, r.bid_volume) for r in merge.dedup_ticks(t).collect()] == [(1.0, 8.0)]


def test_constant_columns_are_left_out(spark):
    df = spark.createDataFrame([(1.0, None, 2.0), (1.0, None, 3.0)], "a double, b double, c double")
    assert L.usable(df, ["a", "b", "c"]) == ["c"] and L.usable(df.where("false"), ["a"]) == []


@pytest.mark.parametrize("trades", ["none", "one outcome", "both"])
def test_learning_from_any_outcomes(spark, monkeypatch, trades):
    """Over sf0.1 no trade of the daily series resolves; one outcome gives nothing to tell apart."""
    from candela.plans import live_queries as Q

    rng = random.Random(2)
    rows = [("S", "1d", i, *(rng.random() for _ in Q.NAMES), float(trades == "both" and rng.random() < 0.5), "win", 1.0) for i in range(400)]
    data = spark.createDataFrame(rows if trades != "none" else [], "symbol string, timeframe string, bar_idx bigint, " + ", ".join(f"{n} double" for n in Q.NAMES) + ", y double, outcome string, net_r double")
    monkeypatch.setattr(Q, "training_data", lambda *a: (data, 400))
    folds, rules = Q.purged_cv_gbt(spark, DATA), Q.distilled_rules(spark, DATA)
    assert folds.columns == ["symbol", "timeframe", "bar_idx", "p", "y", "outcome", "net_r"] and rules.columns == ["line", "rule", "fidelity"]
    assert (folds.count() > 0, rules.count() > 0) == ((trades == "both",) * 2)


def test_sliding_quantiles_are_those_of_spark(spark):
    """With unknown and equal values, in two series; both kinds of frame."""
    from candela.functions import registry as R

    rng = random.Random(4)
    names = []
    for k, (rows, end, least, q) in enumerate([(200, "1 PRECEDING", 30, 0.9), (200, "1 PRECEDING", 30, 0.3), (249, "CURRENT ROW", 125, 0.5), (19, "CURRENT ROW", 1, 0.7)]):
        f = f"({R.W} ROWS BETWEEN {rows} PRECEDING AND {end})"
        names += [R.define(f"test_q{x}_{k}", f"CASE WHEN count({x}) OVER {f} >= {least} THEN QUANTILE({x}, {q}) OVER {f} END") for x in ("u", "close")]
    b = candles(spark, walk(600, 2)).unionByName(candles(spark, walk(90, 3), symbol="Y"))
    df = spark.createDataFrame([(*r, rng.choice([None, *map(float, range(9))])) for r in b.collect()], CANDLE + ", u double")
    got = resolve(df, names)
    assert "percentile" not in plan_of(got)
    want = df.withColumns({n: F.expr(R.spark_sql(R.EXPRESSIONS[n])) for n in names})
    key = lambda rows: {(r.symbol, r.ts): [r[n] for n in names] for r in rows.collect()}
    assert key(got) == key(want) and sum(v is not None for row in key(want).values() for v in row) > 3000
    for n in names:
        del R.EXPRESSIONS[n]


def test_quantiles_of_queries_are_computed_by_series():
    from candela.functions import registry as R

    for e in (D.Expression("close", "mean", 5, True, 0.9), D.Expression("returns", "zscore", 20, False, 0.6)):
        e.defined()
    assert all(R._apart(e) for e in R.EXPRESSIONS.values() if "QUANTILE(" in e)


def test_series_are_made_in_few_narrow_rounds(spark, monkeypatch):
    """Recursive means of recursive means take two rounds, which carry no pattern."""
    from candela.functions import registry as R

    rounds, made = [], R.by_series
    monkeypatch.setattr(R, "by_series", lambda df, columns: rounds.append((set(df.columns), set(columns))) or made(df, columns))
    assert set(B.BAR_PATTERNS) <= set(resolve(candles(spark, walk(30)), ["bar_idx", *B.BAR_PATTERNS]).columns)
    assert [new for _, new in rounds] == [{"ema_12", "ema_26", "smooth_tr", "smooth_plus", "smooth_minus"}, {"macd_signal", "adx"}]
    assert not any({*B.BAR_PATTERNS, "sma_50", "swing_high"} & before for before, _ in rounds)

"""Named column expressions with resolved dependencies.

An expression is SQL over the columns of a bar and over other names. What a query needs is
found by closure, sorted into levels (a window over another name is a level further) and added level by level, so each
indicator is planned once, however many conditions use it, and all windows share one partitioning and one sort.

Some functions differ between dialects and are written as tokens: LAST_OF(x), FIRST_OF(x) ignore nulls, QUANTILE(x, q), LIST(x) and COUNT_BELOW(list, x), COUNT_EQUAL(list, x), and
LOCAL(ts, zone), UTC(ts, zone) convert between UTC and local time. A recursive mean is the token EWM(x, alpha) alone.

Two kinds are computed a series at a time in Python: recursive means, which Catalyst doesn't have, and quantiles of a sliding frame, for which Spark would sort the frame anew for each row.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

SERIES = ["symbol", "timeframe"]
W = "PARTITION BY symbol, timeframe ORDER BY ts"
_NAME = re.compile(r"\b[a-z_][a-z0-9_]*\b")
_EWM = re.compile(r"EWM\((\w+), ([\d./]+)\)")
_SLIDING = re.compile(rf"CASE WHEN count\((\w+)\) OVER \({W} ROWS BETWEEN (\d+) PRECEDING AND (1 PRECEDING|CURRENT ROW)\) >= (\d+) THEN QUANTILE\(\1, ([\d.]+)\) OVER \({W} ROWS BETWEEN \2 PRECEDING AND \3\) END")

EXPRESSIONS: dict[str, str] = {}


def define(name: str, expression: str) -> str:
    if EXPRESSIONS.get(name, expression) != expression:
        raise ValueError(f"{name} is defined twice")
    EXPRESSIONS[name] = expression
    return name


# building blocks of expressions


def lag(x: str, n: int = 1) -> str:
    return f"lag({x}, {n}) OVER ({W})"


def _frame(n: int, prior: bool) -> str:
    return f"({W} ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING)" if prior else f"({W} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def rolling(function: str, x: str, n: int, prior: bool = False, least: int | None = None) -> str:
    """function(x) of the n rows up to this one (prior: before this one); null below ``least`` (n) values."""
    f = _frame(n, prior)
    return f"CASE WHEN count({x}) OVER {f} >= {n if least is None else least} THEN {function}({x}) OVER {f} END"


def running(function: str, x: str) -> str:
    return f"{function}({x}) OVER ({W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"


def known_before(x: str) -> str:
    """The last value of x strictly before this row."""
    return f"LAST_OF({x}) OVER ({W} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"


def is_true(condition: str) -> str:
    return f"coalesce({condition}, false)"


def edge(name: str, condition: str) -> str:
    """Defines name as the first bar of each run of the condition."""
    define(f"{name}_state", is_true(condition))
    return define(name, f"{name}_state AND NOT coalesce({lag(f'{name}_state')}, false)")


# resolution


def spark_sql(e: str) -> str:
    e = re.sub(r"LAST_OF\((\w+)\)", r"last(\1, true)", e)
    e = re.sub(r"FIRST_OF\((\w+)\)", r"first(\1, true)", e)
    e = re.sub(r"QUANTILE\((\w+), ([\d.]+)\)", r"percentile(\1, \2)", e)
    e = re.sub(r"LIST\((\w+)\)", r"collect_list(\1)", e)
    e = re.sub(r"COUNT_BELOW\((\w+), (\w+)\)", r"size(filter(\1, v -> v < \2))", e)
    e = re.sub(r"COUNT_EQUAL\((\w+), (\w+)\)", r"size(filter(\1, v -> v = \2))", e)
    e = re.sub(r"LOCAL\((\w+), ('[\w/]+')\)", r"convert_timezone('UTC', \2, \1)", e)
    e = re.sub(r"UTC\((\w+), ('[\w/]+')\)", r"convert_timezone(\2, 'UTC', \1)", e)
    e = re.sub(r"WEEKDAY\((\w+)\)", r"weekday(\1)", e)
    return re.sub(r"SECONDS\((\w+)\)", r"unix_micros(cast(\1 as timestamp)) / 1000000.0D", e)


def duck_sql(e: str) -> str:
    e = re.sub(r"LAST_OF\((\w+)\)", r"last_value(\1 IGNORE NULLS)", e)
    e = re.sub(r"FIRST_OF\((\w+)\)", r"first_value(\1 IGNORE NULLS)", e)
    e = re.sub(r"QUANTILE\((\w+), ([\d.]+)\)", r"quantile_cont(\1, \2)", e)
    e = re.sub(r"LIST\((\w+)\)", r"list(\1)", e)
    e = re.sub(r"COUNT_BELOW\((\w+), (\w+)\)", r"len(list_filter(\1, lambda v: v < \2))", e)
    e = re.sub(r"COUNT_EQUAL\((\w+), (\w+)\)", r"len(list_filter(\1, lambda v: v = \2))", e)
    e = re.sub(r"LOCAL\((\w+), ('[\w/]+')\)", r"timezone(\2, timezone('UTC', \1))", e)
    e = re.sub(r"UTC\((\w+), ('[\w/]+')\)", r"timezone('UTC', timezone(\2, \1))", e)
    e = re.sub(r"SECONDS\((\w+)\)", r"epoch_us(\1) / 1000000.0", e)
    e = re.sub(r"WEEKDAY\((\w+)\)", r"((dayofweek(\1) + 6) % 7)", e)
    return _EWM.sub(rf"list_reduce(list(\1) OVER ({W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), lambda a, b: CASE WHEN a IS NULL THEN b ELSE a * (1 - (\2)::DOUBLE) + b * (\2)::DOUBLE END)", e)


def uses(name: str) -> set[str]:
    return {x for x in _NAME.findall(EXPRESSIONS[name]) if x in EXPRESSIONS and x != name}


def levels(names: Iterable[str], given: Iterable[str] = ()) -> list[list[str]]:
    """Everything the names need, in levels; given columns are there already."""
    given = set(given)
    depth: dict[str, int] = {}
    stack = [(n, False) for n in names if n not in given]
    while stack:
        n, ready = stack.pop()
        if n in depth:
            continue
        needs = uses(n) - given
        if ready:
            depth[n] = 1 + max((depth[x] for x in needs), default=-1)
        else:
            stack.append((n, True))
            stack += [(x, False) for x in needs if x not in depth]
    out: list[list[str]] = [[] for _ in range(1 + max(depth.values(), default=-1))]
    for n in sorted(depth):
        out[depth[n]].append(n)
    return out


def by_series(df: DataFrame, columns: dict[str, tuple]) -> DataFrame:
    """Adds columns made of the values of a series in the order of time, each series one Arrow group: name -> (column, alpha) is a recursive mean, seeded with the first value;
    name -> (column, rows, prior, least, q) the quantile of the known values of so many rows up to this one (prior: before this one), from ``least`` values on."""
    schema = StructType([*df.schema.fields, *[StructField(n, DoubleType()) for n in columns]])

    # these have no reference to this module, so workers need not find it
    def mean(x: pd.Series, alpha: float) -> pd.Series:
        return x.ewm(alpha=alpha, adjust=False).mean()

    def quantile(x: pd.Series, rows: int, prior: bool, least: int, q: float) -> np.ndarray:
        """Interpolated in the same steps as Spark's percentile."""
        r = (x.shift(1) if prior else x).rolling(rows, min_periods=least)
        low, high, at = (c.to_numpy() for c in (r.quantile(q, interpolation="lower"), r.quantile(q, interpolation="higher"), (r.count() - 1) * q))
        return np.where(low == high, low, (np.ceil(at) - at) * low + (at - np.floor(at)) * high)

    def run(t: pa.Table) -> pa.Table:
        order = np.argsort(t["ts"].to_numpy(), kind="stable")
        for n, (x, *args) in columns.items():
            values = np.empty(len(order))
            values[order] = (mean if len(args) == 1 else quantile)(pd.Series(t[x].cast("double").to_numpy()[order]), *args)
            t = t.append_column(n, pa.array(values, "double", from_pandas=True))
        return t

    return df.groupBy(*SERIES).applyInArrow(run, schema)


def resolve(df: DataFrame, names: Iterable[str]) -> DataFrame:
    """df with the named columns and all that they need.

    The series are spread by a fixed number of partitions: there is much work for few bytes in a series, so adaptive
    execution would put all of them in one task. What is made by series comes first, in as few rounds as its dependencies allow, with no columns but those that it needs: rows are
    shuffled again after each round, since Spark no longer knows how they lie. All windows after the last round keep its partitioning.
    """
    names = list(names)
    steps = levels(names, df.columns)
    apart = {n: a for level in steps for n in level if (a := _apart(EXPRESSIONS[n]))}
    spread = lambda x: x.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *SERIES)
    if any("OVER (" in EXPRESSIONS[n] for level in steps for n in level if n not in apart) or apart:
        df = spread(df)
    after: dict[str, int] = {}  # of each name, the rounds before it
    for n in (n for level in steps for n in level):
        after[n] = max((after[x] + (x in apart) for x in uses(n) if x in after), default=0)
    for k in sorted({after[n] for n in apart}):
        now = {n: apart[n] for n in apart if after[n] == k}
        df = spread(by_series(_plain(df, {x for n in now for x in uses(n)}), now))
    return _plain(df, names)


def _plain(df: DataFrame, names: Iterable[str]) -> DataFrame:
    """df with the names and what they need, level by level; nothing of it is made by series."""
    for level in levels(names, df.columns):
        df = df.withColumns({n: F.expr(spark_sql(EXPRESSIONS[n])) for n in level})
    return df


def _apart(e: str) -> tuple | None:
    """The column and arguments of what by_series computes."""
    if m := _EWM.fullmatch(e):
        return m[1], _number(m[2])
    if m := _SLIDING.fullmatch(e):
        prior = m[3] != "CURRENT ROW"
        return m[1], int(m[2]) + (not prior), prior, int(m[4]), float(m[5])
    return None


def _number(s: str) -> float:
    a, _, b = s.partition("/")
    return float(a) / float(b) if b else float(a)


def select(df: DataFrame, names: list[str], keys: tuple[str, ...] = ("symbol", "timeframe", "ts")) -> DataFrame:
    return resolve(df, names).select(*keys, *names)


def sql(base: str, names: list[str], keys: tuple[str, ...] = ("symbol", "timeframe", "ts"), given: Iterable[str] = (), rename: str | None = None) -> str:
    """DuckDB SQL of select() over the SQL of a table of bars."""
    ctes, last = [f"l0 AS ({base})"], "l0"
    for i, level in enumerate(levels(names, given), 1):
        ctes.append(f"l{i} AS MATERIALIZED (SELECT *, " + ", ".join(f"{duck_sql(EXPRESSIONS[n])} AS {n}" for n in level) + f" FROM {last})")
        last = f"l{i}"
    return "WITH " + ",\n".join(ctes) + f"\nSELECT {', '.join([*keys, *names])} FROM {last}"

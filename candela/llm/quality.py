"""Quality rules: a threshold table compiled into one Spark projection.

Measures are ratios of lengths, symbols, capitals, stop words and lines, all of built-in functions, so a
table of any number of rules is one pass over the documents, without a shuffle and without Python.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import shared

STOP_WORDS = (
    "the of and to in is that it for with as on be at by this have from or an are was "
    "der die das und zu den von mit ist des sich nicht auf für ein eine im dem "
    "le la les de et en un une que qui dans pour par sur est pas avec au du "
    "el los las y se del por con una su para es al lo como"
).split()
SYMBOLS = "#$%&*@^~|<>{}[]=+_\\/!"


@dataclass(frozen=True)
class Rule:
    """Rows with low <= measure <= high pass; rows with fewer than min_words words pass in any case."""

    name: str
    measure: str
    low: float | None = None
    high: float | None = None
    min_words: int = 0


#: The production table.
RULES = (
    Rule("too_short", "n_words", low=3),
    Rule("word_length", "mean_word_chars", low=2.0, high=14.0),
    Rule("symbols", "symbol_ratio", high=0.05),
    Rule("capitals", "upper_ratio", high=0.5, min_words=10),
    Rule("stop_words", "stop_word_ratio", low=0.05, min_words=30),
    Rule("repeated_lines", "duplicate_line_ratio", high=0.5),
)
MEASURES = ("n_chars", "n_words", "mean_word_chars", "symbol_ratio", "upper_ratio", "stop_word_ratio", "duplicate_line_ratio")


def measured(docs: DataFrame) -> DataFrame:
    """Each row of docs as struct ``row`` with the MEASURES of its text; a null text is measured as an empty one, whose ratios are 0.

    Words are what stands between ASCII white space; lines that are blank don't count.
    """
    text = F.coalesce(docs["text"], F.lit(""))
    not_symbol = "[" + "".join("\\" + c for c in SYMBOLS) + "]"
    base = docs.select(
        F.struct(*[docs[c] for c in docs.columns]).alias("row"), F.length(text).alias("chars"),
        F.filter(F.split(F.lower(text), r"[ \t\n\r\f]+"), lambda w: w != "").alias("words"),
        F.filter(F.split(text, "\n"), lambda x: F.trim(x) != "").alias("lines"),
        F.length(F.regexp_replace(text, not_symbol, "")).alias("plain"), F.length(F.regexp_replace(text, "[A-Z]", "")).alias("not_upper"),
    )
    counted = base.select(
        "row", "chars", "plain", "not_upper", F.size("words").alias("n"), F.size(F.filter("words", lambda w: w.isin(*STOP_WORDS))).alias("stop"),
        F.aggregate("words", F.lit(0), lambda a, w: a + F.length(w)).alias("letters"), F.size("lines").alias("line"), F.size(F.array_distinct("lines")).alias("line_kinds"),
    )
    ratio = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))
    c = F.col
    return counted.select(
        "row", c("chars").cast("bigint").alias("n_chars"), c("n").cast("bigint").alias("n_words"), ratio(c("letters"), c("n")).alias("mean_word_chars"),
        ratio(c("chars") - c("plain"), c("chars")).alias("symbol_ratio"), ratio(c("chars") - c("not_upper"), c("chars")).alias("upper_ratio"),
        ratio(c("stop"), c("n")).alias("stop_word_ratio"), ratio(c("line") - c("line_kinds"), c("line")).alias("duplicate_line_ratio"),
    )


def compile_rules(rules: tuple[Rule, ...] = RULES) -> Column:
    """The comma-separated names of the rules that a measured row breaks; empty where it breaks none."""
    checks = []
    for r in rules:
        bad = F.lit(False)
        if r.low is not None:
            bad = bad | (F.col(r.measure) < F.lit(r.low))
        if r.high is not None:
            bad = bad | (F.col(r.measure) > F.lit(r.high))
        if r.min_words:
            bad = bad & (F.col("n_words") >= F.lit(r.min_words))
        checks.append(F.when(bad, F.lit(r.name)))
    return F.concat_ws(",", *checks)


def apply_rules(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """measured(docs) with broken (names of broken rules) and keep. Every row comes back, repeated ones too."""
    return measured(docs).withColumn("broken", compile_rules(rules)).withColumn("keep", F.col("broken") == "")


def op7_quality_rules(spark, sf_dir: str) -> DataFrame:
    docs = shared.table(spark, sf_dir, "documents").select("doc_id", "text")
    return apply_rules(docs).select("row.doc_id", *[F.col(m) if m.startswith("n_") else F.round(m, 9).alias(m) for m in MEASURES], "broken", "keep")


def _sql() -> str:
    stop = ", ".join(f"'{w}'" for w in STOP_WORDS)
    symbols = "[" + "".join("\\" + c for c in SYMBOLS) + "]"
    checks = []
    for r in RULES:
        parts = [f"{r.measure} < {r.low}"] * (r.low is not None) + [f"{r.measure} > {r.high}"] * (r.high is not None)
        checks.append(f"CASE WHEN ({' OR '.join(parts)}) AND n_words >= {r.min_words} THEN '{r.name}' END")
    return f"""
WITH base AS (SELECT doc_id, coalesce(text, '') AS text, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[ \\t\\n\\r\\f]+'), lambda w: w <> '') AS words,
                     list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: trim(x, ' ') <> '') AS lines FROM documents),
measured AS (SELECT doc_id, length(text)::BIGINT AS n_chars, len(words)::BIGINT AS n_words,
  coalesce(list_sum(list_transform(words, lambda w: length(w)))::DOUBLE / nullif(len(words), 0), 0.0) AS mean_word_chars,
  coalesce((length(text) - length(regexp_replace(text, '{symbols}', '', 'g')))::DOUBLE / nullif(length(text), 0), 0.0) AS symbol_ratio,
  coalesce((length(text) - length(regexp_replace(text, '[A-Z]', '', 'g')))::DOUBLE / nullif(length(text), 0), 0.0) AS upper_ratio,
  coalesce(len(list_filter(words, lambda w: w IN ({stop})))::DOUBLE / nullif(len(words), 0), 0.0) AS stop_word_ratio,
  coalesce((len(lines) - len(list_distinct(lines)))::DOUBLE / nullif(len(lines), 0), 0.0) AS duplicate_line_ratio FROM base),
ruled AS (SELECT *, concat_ws(',', {', '.join(checks)}) AS broken FROM measured)
SELECT doc_id, n_chars, n_words, round(mean_word_chars, 9) AS mean_word_chars, round(symbol_ratio, 9) AS symbol_ratio, round(upper_ratio, 9) AS upper_ratio,
       round(stop_word_ratio, 9) AS stop_word_ratio, round(duplicate_line_ratio, 9) AS duplicate_line_ratio, broken, broken = '' AS keep FROM ruled
"""


QUERIES = {"op7_quality_rules": op7_quality_rules}
SQL = {"op7_quality_rules": _sql()}

"""Quality rules: a table of thresholds compiled into one projection. No user functions."""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import GAP, documents, once
from .registry import query

BLANKS = " \t\n\x0b\x0c\r"
SYMBOLS = r"[#*$%&|<>]"
WINDOW = 5

# Frequent function words of the languages the rules know.
STOP_WORDS = {
    "en": "the of and to in a is that it for was on as with be by this are at from",
    "de": "der die und in den von zu das mit sich des auf ist im dem nicht ein eine als auch",
    "fr": "de la le et les des en un du une que est pour qui dans par au sur pas plus",
    "es": "de la que el en y a los se del las un por con no una su para es al",
}


class Rule(NamedTuple):
    """A document fails if ``metric`` lies outside [low, high]; texts of under ``from_words`` words are not judged by it."""

    metric: str
    low: float | None
    high: float | None
    from_words: int


#: Metrics are SQL over the counts below. The bounds are wide: a rule is there for text that is plainly no prose.
RULES = (
    Rule("word_chars / n_words", 1.5, 25.0, 10),
    Rule("n_symbols / n_words", None, 0.4, 10),
    Rule("n_capitals / greatest(n_letters, 1)", None, 0.6, 10),
    Rule("n_letters / greatest(word_chars, 1)", 0.5, None, 10),
    Rule("n_stop_words / n_words", 0.01, None, 80),
    Rule("n_dup_lines / greatest(n_lines, 1)", None, 0.5, 10),
)


def counts(docs: DataFrame, stop_words: dict[str, str] = STOP_WORDS) -> DataFrame:
    """(doc_id and the counts the rules use) of every row of ``docs`` (doc_id, text); null texts count as empty.

    Equal 5-word windows are found by sorting their 64-bit hashes within the row; positions are only sorted in texts where
    a window recurs. No shuffle.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", text.alias("text"))
    trimmed = F.btrim("text", F.lit(BLANKS))
    listed = F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, GAP))
    rows = once(rows, words=listed, lines=F.filter(F.split("text", "\n"), lambda line: F.btrim(line, F.lit(BLANKS)) != ""))
    known = sorted({w for listed in stop_words.values() for w in listed.split()})
    words, n = F.col("words"), F.size("words")
    window = lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(WINDOW)])
    rows = once(rows, hashes=F.when(n >= WINDOW, F.transform(F.sequence(F.lit(0), n - WINDOW), window)).otherwise(F.array().cast("array<bigint>")))
    recurs = F.size(F.array_distinct("hashes")) < F.size("hashes")
    rows = once(rows, sorted=F.when(recurs, F.array_sort(F.transform("hashes", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    s = F.col("sorted")
    twin = lambda x, j: (F.get(s, j - 1)["h"] == x["h"]) | (F.get(s, j + 1)["h"] == x["h"])
    rows = once(rows, starts=F.array_sort(F.transform(F.filter(s, lambda x, j: F.coalesce(twin(x, j), F.lit(False))), lambda x: x["i"])))
    covered = F.aggregate(
        "starts", F.struct(F.lit(0).alias("end"), F.lit(0).alias("n")),
        lambda acc, i: F.struct((i + WINDOW).alias("end"), (acc["n"] + i + WINDOW - F.greatest(i, acc["end"])).alias("n")), lambda acc: acc["n"],
    )
    long = lambda column, name: column.cast("long").alias(name)
    return rows.select(
        "doc_id", long(n, "n_words"), (F.length("text") - F.regexp_count("text", F.lit(r"[\x20\x09-\x0D]"))).cast("long").alias("word_chars"),
        long(F.regexp_count("text", F.lit(SYMBOLS)), "n_symbols"), long(F.size("lines"), "n_lines"),
        long(F.size("lines") - F.size(F.array_distinct("lines")), "n_dup_lines"), long(F.coalesce(covered, F.lit(0)), "n_repeat_words"),
        long(F.length(F.regexp_replace("text", r"\P{L}+", "")), "n_letters"), long(F.regexp_count("text", F.lit(r"\p{Lu}")), "n_capitals"),
        long(F.size(F.filter(words, lambda w: F.lower(w).isin(known))), "n_stop_words"),
    )


def fails(rules: tuple[Rule, ...] = RULES) -> Column:
    """The table as one condition."""
    def one(rule: Rule) -> Column:
        value = F.expr(f"CASE WHEN n_words >= {int(max(rule.from_words, 1))} THEN {rule.metric} END")
        low = F.lit(False) if rule.low is None else value < rule.low
        high = F.lit(False) if rule.high is None else value > rule.high
        return F.coalesce(low | high, F.lit(False))

    return reduce(lambda a, b: a | b, [one(r) for r in rules], F.lit(False))


def judged(docs: DataFrame, rules: tuple[Rule, ...] = RULES, least_words: int = 10, most_repeats: int = 20) -> DataFrame:
    """``counts`` of every row with ``base_failed`` (too short or too repetitive) and ``kept`` (neither that nor a failed rule).

    Empty and null texts have no words and are not kept. Repeated rows are each judged.
    """
    base = (F.col("n_words") < least_words) | (100 * F.col("n_repeat_words") > most_repeats * F.col("n_words"))
    return counts(docs).withColumn("base_failed", base).withColumn("kept", ~F.col("base_failed") & ~fails(rules))


@query("op10_quality_rules")
def op10(spark, sf_dir):
    return judged(documents(spark, sf_dir)).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")

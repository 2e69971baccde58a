"""Quality rules as a short-circuit cascade: rules that reject most per unit of cost on a sample come first.

Everything is a DataFrame expression. Whichever order the sample suggests, a document is kept if and only if no
rule rejects it, so the order decides about time only.
"""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablelift.session import materialize

#: Rows of the sample that costs and rejections are estimated on, and how often each rule is timed.
SAMPLE_ROWS, TIMINGS = 1_000, 2

_SPACE = r"[\x20\x09-\x0D]+"
_SYMBOLS = r"[^#*$%&|<>]+"


@dataclass(frozen=True)
class Rule:
    """``rejects`` is true for a document that the rule rejects and never null."""

    name: str
    rejects: Column


def _per(part: Column, whole: Column) -> Column:
    """Share of the whole, 0 where the whole is 0."""
    return F.coalesce(F.try_divide(part.cast("double"), whole), F.lit(0.0))


def _matches(text: Column, outside: str) -> Column:
    """Characters that the negated class ``outside`` leaves over."""
    return F.length(F.regexp_replace(text, outside, ""))


#: Gopher-like rules over the measured columns (fixed thresholds). ``body`` is the text, empty for null.
def default_rules() -> tuple[Rule, ...]:
    body, words = F.col("body"), F.col("n_words")
    return (
        Rule("symbols", F.col("n_symbols") > F.lit(0.1) * words),
        Rule("duplicate_lines", _per(F.col("n_dup_lines"), F.col("n_lines")) > 0.5),
        Rule("word_length", (F.col("word_chars") > F.lit(15) * words) | (F.col("word_chars") < F.lit(2) * words)),
        Rule("exclamations", _matches(body, r"[^!]+") > F.lit(0.1) * words),
        Rule("capitals", _matches(body, r"[^A-Z]+") > F.lit(0.5) * F.col("word_chars")),
        Rule("digits", _matches(body, r"[^0-9]+") > F.lit(0.3) * F.col("word_chars")),
        Rule("no_letters", _matches(body, r"[\x00-\x40\x5B-\x60\x7B-\x7F]+") < F.lit(0.5) * F.col("word_chars")),
        Rule("ellipsis_lines", _per(F.regexp_count(body, F.lit(r"(?m)(?:\.\.\.|…)[ \t]*$")), F.col("n_lines")) > 0.3),
        Rule("markup", F.regexp_count(body, F.lit(r"(?i)lorem ipsum|</?(?:div|span|script|html)\b|function\s*\(")) > F.lit(0.02) * words),
    )


def _repeated_words(words: Column, windows: Column) -> Column:
    """Words in 3-word windows that occur twice or more. ``windows`` holds a hash per window in order."""
    placed = F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i")))

    def positions(ordered: Column) -> Column:
        def repeated(item: Column, place: Column) -> Column:
            after = F.get(ordered, place + 1)["h"].eqNullSafe(item["h"])
            return after | F.get(ordered, place - 1)["h"].eqNullSafe(item["h"])

        first = F.transform(F.filter(ordered, repeated), lambda item: item["i"])
        covered = F.array_union(first, F.array_union(F.transform(first, lambda i: i + 1), F.transform(first, lambda i: i + 2)))
        return F.size(covered).cast("long")

    # Sorting costs n log n however often a window repeats; most short texts need none.
    found = F.element_at(F.transform(F.array(F.sort_array(placed)), positions), 1)
    return F.when(F.size(F.array_distinct(windows)) == F.size(windows), F.lit(0).cast("long")).otherwise(found)


def measured(documents: DataFrame) -> DataFrame:
    """The counts that the base rules and the cascade use, beside all columns of ``documents``."""
    body = F.coalesce(F.col("text"), F.lit(""))
    split = documents.withColumn("body", body)
    split = split.withColumn("words", F.filter(F.split("body", _SPACE), lambda word: word != ""))
    split = split.withColumn("lines", F.filter(F.split("body", "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]")))
    size = F.size("words")
    # Zipped slices, not places inside a lambda: a filter on the result may be moved below and evaluated there, and
    # would split the text again at every place.
    count = F.greatest(size - 2, F.lit(0))
    zipped = F.arrays_zip(*(F.slice("words", F.lit(first), count).alias(f"w{first}") for first in (1, 2, 3)))
    hashed = F.transform(zipped, lambda three: F.xxhash64(three["w1"], three["w2"], three["w3"]))
    split = split.withColumn("windows", hashed)
    return split.select(
        *documents.columns,
        "body",
        size.cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace("body", _SYMBOLS, "")).cast("long").alias("n_symbols"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        _repeated_words(F.col("words"), F.col("windows")).alias("n_repeat_words"),
    )


def ordered_rules(documents: DataFrame, rules: tuple[Rule, ...], rows: int = SAMPLE_ROWS) -> tuple[Rule, ...]:
    """The rules by rejections per second on a sample of about ``rows`` rows, hashed over all of ``documents``."""
    share = rows / max(1, documents.count())
    draw = F.pmod(F.xxhash64("text"), F.lit(1 << 30)) < F.lit(int(min(1.0, share) * (1 << 30)))
    sample = materialize(measured(documents.select("text").filter(draw | F.lit(share >= 1))), "rules-sample")

    def timed(count: Column) -> tuple[float, int]:
        seconds, hits = [], 0
        for _ in range(TIMINGS):
            began = time.perf_counter()
            hits = sample.agg(count.alias("n")).first()["n"]
            seconds.append(time.perf_counter() - began)
        return min(seconds), hits

    idle, _ = timed(F.count_if(F.length("body") >= 0))
    scored = []
    for place, rule in enumerate(rules):
        seconds, hits = timed(F.count_if(rule.rejects))
        scored.append((-(hits + 0.5) / max(seconds - idle, 0.001), place))
    return tuple(rules[place] for _, place in sorted(scored))


def apply_rules(documents: DataFrame, rules: tuple[Rule, ...] | None = None, rows: int = SAMPLE_ROWS) -> DataFrame:
    """doc_id, the base counts, base_failed and kept of every whole text of ``documents`` (doc_id, text).

    A null text counts as empty: no words, so it fails. Repeated rows repeat; ties between windows or lines count
    every word and every line after the first; extra columns are ignored. An empty table gives no rows.
    """
    source = documents.select("doc_id", "text")
    chosen = ordered_rules(source, default_rules() if rules is None else rules, rows)
    base_failed = (F.col("n_words") < 50) | (F.lit(100) * F.col("n_repeat_words") > F.lit(50) * F.col("n_words"))
    # CASE stops at the first branch that holds: later rules cost nothing for a rejected document.
    verdict = F.when(base_failed, F.lit(False))
    for rule in chosen:
        verdict = verdict.when(rule.rejects, F.lit(False))
    return measured(source).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        base_failed.alias("base_failed"), verdict.otherwise(F.lit(True)).alias("kept"),
    )


#: The same counts and verdicts in DuckDB's SQL.
SQL = r"""
WITH split AS (
  SELECT doc_id, row_number() OVER () AS rid, coalesce(text, '') AS body,
         list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS lines
  FROM documents
), places AS (
  SELECT rid, unnest(range(1, len(words) - 1)) AS i, words FROM split
), windows AS (
  SELECT rid, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS w FROM places
), repeated AS (
  SELECT rid, i FROM windows QUALIFY count(*) OVER (PARTITION BY rid, w) > 1
), covered AS (
  SELECT rid, count(DISTINCT i + k) AS n FROM repeated, (VALUES (0), (1), (2)) AS t(k) GROUP BY rid
), counted AS (
  SELECT doc_id, body, len(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars,
         length(regexp_replace(body, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols, len(lines)::BIGINT AS n_lines,
         (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words
  FROM split LEFT JOIN covered USING (rid)
), judged AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM counted
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed OR n_symbols > 0.1 * n_words
            OR (n_lines > 0 AND n_dup_lines / n_lines > 0.5)
            OR word_chars > 15 * n_words OR word_chars < 2 * n_words
            OR length(regexp_replace(body, '[^!]+', '', 'g')) > 0.1 * n_words
            OR length(regexp_replace(body, '[^A-Z]+', '', 'g')) > 0.5 * word_chars
            OR length(regexp_replace(body, '[^0-9]+', '', 'g')) > 0.3 * word_chars
            OR length(regexp_replace(body, '[\x00-\x40\x5B-\x60\x7B-\x7F]+', '', 'g')) < 0.5 * word_chars
            OR (n_lines > 0 AND len(regexp_extract_all(body, '(?m)(?:\.\.\.|…)[ \t]*$')) / n_lines > 0.3)
            OR len(regexp_extract_all(body, '(?i)lorem ipsum|</?(?:div|span|script|html)\b|function\s*\(')) > 0.02 * n_words
       ) AS kept
FROM judged
"""

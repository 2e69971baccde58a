"""Personal data: regex, gazetteer and context labelers vote on candidate spans; EM weighs them.

Spans come from regular expressions and their places from the lengths of matches and of the text between them, all
in DataFrame functions. Labelers vote for, against or not at all. Counts per vote pattern over all documents (a
bounded table) feed expectation-maximisation of the labelers' reliabilities; its posteriors train a span classifier,
an additive model over span features that needs no labeler. Base spans are always kept; other candidates are kept
where the classifier says so.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Base kinds in order, with the patterns as defined, written so that a run of characters is tried once (fixed values).
#: \G lets a match begin where the last one ended, as plain leftmost matching would.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}

#: Cheap conditions without which a kind cannot occur.
_GATES = {"email": "@", "phone": "+"}

#: Further candidates of the method, looser than what it accepts.
EXTRA = {
    "secret": r"(?i)(?<![a-z0-9])(?:[a-z0-9_-]{0,20}(?:password|passwd|pwd|secret|token|api[_-]?key))[\x20\t]{0,3}[=:][\x20\t]{0,3}[\"']?[^\s\"',;]{6,}+",
    "key": r"(?<![A-Za-z0-9])(?:[A-Z]{4}[0-9A-Z]{16}|[0-9a-f]{32,}+|(?:sk|pk|ghp|xox[bp])[_-][A-Za-z0-9_-]{16,}+)(?![A-Za-z0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){3,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "number": r"(?<![\p{L}0-9.+-])\(?[0-9]{2,4}\)?[\x20.-][0-9]{3,4}[\x20.-][0-9]{3,4}(?![\p{L}0-9-])",
}

KINDS = (*BASE, *EXTRA)

#: Words before a span that speak for or against it, lower case (fixed values).
FOR_WORDS = r"\b(?:password|passwd|pwd|secret|token|key|login|phone|tel|call|fax|mobile|e-?mail|mail|contact|card|visa|iban|account|ssn|social|ip|host|address|reach|write)\b"
AGAINST_WORDS = r"\b(?:version|licen[sc]e|isbn|issn|doi|chapter|section|page|figure|table|rfc|build|release|copyright|example)\b"

#: Characters before a span that the context labelers read.
CONTEXT = 40
#: EM rounds, and the reliability that a labeler starts with.
ROUNDS, START = 60, 0.8
#: Posterior above which a candidate of the method is kept.
THRESHOLD = 0.5


@dataclass(frozen=True)
class PiiModel:
    """prior: share of true candidates; reliability: labeler to (hit rate, false alarm rate); weights: log odds."""

    prior: float
    reliability: dict = field(default_factory=dict)
    bias: float = 0.0
    weights: dict = field(default_factory=dict)


def _placed(text: Column, kind: str, pattern: str) -> Column:
    """Array of (kind, start, end, value, before) of all leftmost matches of a pattern, in code points."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    between = F.split(text, pattern, -1)
    empty = F.array().cast("array<struct<kind:string,start:int,end:int,value:string,before:string>>")

    def step(state: Column, item: Column) -> Column:
        start = state["at"] + F.length(item["gap"])
        end = start + F.length(item["value"])
        one = F.struct(
            F.lit(kind).alias("kind"),
            start.alias("start"),
            end.alias("end"),
            item["value"].alias("value"),
            F.right(item["gap"], F.lit(CONTEXT)).alias("before"),
        )
        return F.struct(end.alias("at"), F.concat(state["spans"], F.array(one)).alias("spans"))

    pieces = F.zip_with(found, F.slice(between, F.lit(1), F.size(found)), lambda value, gap: F.struct(value.alias("value"), gap.alias("gap")))
    spans = F.aggregate(pieces, F.struct(F.lit(0).alias("at"), empty.alias("spans")), step, lambda state: state["spans"])
    gate = F.contains(text, F.lit(_GATES[kind])) if kind in _GATES else text.rlike(pattern)
    return F.when(gate, spans).otherwise(empty)


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(value: Column) -> Column:
    """Whether the digits of a text pass the check of card numbers."""
    turned = F.split(F.reverse(_digits(value)), "")

    def part(digit: Column, place: Column) -> Column:
        number = F.coalesce(F.try_to_number(digit, F.lit("9")).cast("int"), F.lit(0))
        double = number * 2
        return F.when(place % 2 == 0, number).otherwise(F.when(double > 9, double - 9).otherwise(double))

    return F.aggregate(F.transform(turned, part), F.lit(0), lambda total, one: total + one) % 10 == 0


def _valid(span: Column) -> Column:
    """The rule that a base match must pass; true for other kinds."""
    value, kind = span["value"], span["kind"]
    octets = value.rlike(r"^0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?:\.0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])){3}$")
    size = F.length(_digits(value))
    return (
        F.when(kind == "ip", octets)
        .when(kind == "card", F.when((size >= 16) & (size <= 19), luhn(value)).otherwise(F.lit(False)))
        .when(kind == "phone", (size >= 8) & (size <= 15))
        .otherwise(F.lit(True))
    )


def _votes() -> dict:
    """Labelers over a span (value, before, kind): 1 for, 0 against, null for no vote."""

    def vote(name: str):
        def of(span: Column) -> Column:
            value, before, kind = span["value"], F.lower(span["before"]), span["kind"]
            mixed = value.rlike("[0-9]") & value.rlike("[A-Za-z]")
            digits = F.length(_digits(value))
            none = F.lit(None).cast("int")
            labelers = {
                # Regex: the strict form of the kind.
                "strict": F.when(kind == "email", value.rlike(r"^[A-Za-z0-9][A-Za-z0-9._%+-]*@(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,24}$").cast("int"))
                .when(kind == "secret", mixed.cast("int"))
                .when(kind == "key", value.rlike(r"^(?:AKIA|ASIA|[0-9a-f]{32,}|sk|pk|ghp|xox)").cast("int"))
                .when(kind == "ssn", (~value.rlike(r"^(?:000|666|9)|-00-|-0000$")).cast("int"))
                .when(kind == "number", value.rlike(r"^\(?[2-9][0-9]{2}\)?").cast("int"))
                .otherwise(none),
                # Regex: how much of the value is not an ordinary word.
                "dense": F.when(digits >= 6, 1).when(digits == 0, 0).otherwise(none),
                # Check digits, where the kind has them.
                "checked": F.when(kind.isin("card"), luhn(value).cast("int")).when(kind == "ip", _valid(span).cast("int")).otherwise(none),
                # Gazetteer of words that announce personal data, in the value's own label or just before it.
                "announced": F.when(before.rlike(FOR_WORDS) | F.lower(value).rlike(FOR_WORDS), 1).otherwise(none),
                # Context that numbers of other kinds stand in.
                "numbered": F.when(before.rlike(AGAINST_WORDS), 0).otherwise(none),
                # Context: the value is a word of its own and not part of a longer run.
                "alone": F.when(before.rlike(r"[\p{L}\p{N}_]$"), 0).when((before == "") | before.rlike(r"[\s(\"'=:,]$"), 1).otherwise(none),
                # Gazetteer of placeholder values.
                "placeholder": F.when(F.lower(value).rlike(r"(?:x{4,}|\*{3,}|changeme|your[_-]|<|\$\{|none|null|true|false)"), 0).otherwise(none),
            }
            return labelers[name]

        return of

    return {name: vote(name) for name in ("strict", "dense", "checked", "announced", "numbered", "alone", "placeholder")}


LABELERS = _votes()


def _features(span: Column) -> dict[str, Column]:
    """Few-valued features of a span, for the classifier; they read the value, not the votes."""
    value = span["value"]
    size, digits = F.length(value), F.length(_digits(value))
    return {
        "kind": span["kind"],
        "size": F.when(size < 8, "0").when(size < 12, "8").when(size < 16, "12").when(size < 24, "16").when(size < 48, "24").otherwise("48"),
        "digits": F.when(digits == 0, "0").when(digits < 6, "1").when(digits < 12, "6").otherwise("12"),
        "letters": F.when(value.rlike("[A-Z]") & value.rlike("[a-z]"), "Aa").when(value.rlike("[A-Z]"), "A").when(value.rlike("[a-z]"), "a").otherwise(""),
        "before": F.when(span["before"].rlike(r"(?i)" + AGAINST_WORDS), "-").when(span["before"].rlike(r"(?i)" + FOR_WORDS), "+").otherwise(""),
        "mark": F.when(value.rlike(r"[=:@]"), "=").otherwise(""),
    }


def _apart(span: Column) -> Column:
    """Whether no base span touches a span."""
    return ~F.exists("_base", lambda other: (other["start"] < span["end"]) & (span["start"] < other["end"]))


def _rest(span: Column) -> Column:
    """Array of the parts of a span that no base span covers, of the span's type."""
    covered = F.array_sort(F.transform("_base", lambda one: F.struct(one["start"].alias("start"), one["end"].alias("end"))))

    def part(start: Column, end: Column) -> Column:
        value = F.substr(span["value"], start - span["start"] + 1, end - start)
        return F.struct(span["kind"].alias("kind"), start.alias("start"), end.alias("end"), value.alias("value"), span["before"].alias("before"))

    def step(state: Column, other: Column) -> Column:
        gap = F.least(other["start"], span["end"])
        parts = F.when(gap > state["at"], F.concat(state["parts"], F.array(part(state["at"], gap)))).otherwise(state["parts"])
        return F.struct(F.greatest(state["at"], other["end"]).alias("at"), parts.alias("parts"))

    none = F.array().cast("array<struct<kind:string,start:int,end:int,value:string,before:string>>")
    start = F.struct(span["start"].alias("at"), none.alias("parts"))

    def last(state: Column) -> Column:
        return F.when(state["at"] < span["end"], F.concat(state["parts"], F.array(part(state["at"], span["end"])))).otherwise(state["parts"])

    return F.when(_apart(span), F.array(span)).otherwise(F.aggregate(covered, start, step, last))


def candidates(documents: DataFrame, valid: bool = True) -> DataFrame:
    """All columns of ``documents``, ``_base``: base matches, and ``_extra``: the method's candidates.

    A candidate that lies inside a candidate of more length, which no base span touches, goes. With ``valid`` base
    matches that fail their rule are no spans, and candidates that a base span touches stay whole, for the classifier;
    without it failed matches stay, as cases that the labelers can disagree on, and what touches a base span goes.
    """
    body = F.coalesce(F.col("text"), F.lit(""))
    with_body = documents.withColumn("_body", body)
    with_body = with_body.withColumns({f"_{kind}": _placed(F.col("_body"), kind, pattern) for kind, pattern in BASE.items()})
    if valid:
        with_body = with_body.withColumns({f"_{kind}": F.filter(f"_{kind}", _valid) for kind in BASE})
    with_body = with_body.withColumns({f"_{kind}": _placed(F.col("_body"), kind, pattern) for kind, pattern in EXTRA.items()})
    with_body = with_body.withColumn("_base", F.concat(*(F.col(f"_{kind}") for kind in BASE)))

    def outermost(span: Column) -> Column:
        return ~F.exists(
            "_free",
            lambda other: (other["start"] <= span["start"])
            & (span["end"] <= other["end"])
            & (other["end"] - other["start"] > span["end"] - span["start"]),
        )

    with_body = with_body.withColumn("_every", F.concat(*(F.col(f"_{kind}") for kind in EXTRA)))
    with_body = with_body.withColumn("_free", F.filter("_every", _apart))
    with_body = with_body.withColumn("_extra", F.filter("_every" if valid else "_free", outermost))
    return with_body.drop("_body", "_every", "_free", *(f"_{kind}" for kind in KINDS))


def learn(documents: DataFrame) -> PiiModel:
    """Reliabilities and classifier from the vote and feature patterns of all candidates of all documents.

    Only counts per pattern reach the driver: at most 3 ** labelers times the values of the features.
    """
    # The outer form keeps Spark from finding all spans once more below, to see whether there are any.
    spans = candidates(documents.select("text"), valid=False).select(F.explode_outer(F.concat("_base", "_extra")).alias("span"))
    spans = spans.filter(F.col("span").isNotNull())
    span = F.col("span")
    columns = [labeler(span).alias(f"v_{name}") for name, labeler in LABELERS.items()]
    columns += [value.alias(f"f_{name}") for name, value in _features(span).items()]
    patterns = spans.select(*columns).groupBy(*(f"v_{name}" for name in LABELERS), *(f"f_{name}" for name in _features(span)))
    return fit([row.asDict() for row in patterns.agg(F.count(F.lit(1)).alias("n")).toLocalIterator()])


def fit(patterns: list[dict]) -> PiiModel:
    """EM over vote patterns with counts ``n``, then the classifier on its posteriors. Without patterns, nothing is kept."""
    if not patterns:
        return PiiModel(0.0, {}, -10.0, {})
    patterns = sorted(patterns, key=lambda row: sorted((key, str(value)) for key, value in row.items()))
    prior, rates = 0.5, {name: (START, 1 - START) for name in LABELERS}

    def posterior(row: dict) -> float:
        odds = math.log(prior) - math.log(1 - prior)
        for name, (hit, alarm) in rates.items():
            vote = row[f"v_{name}"]
            if vote is not None:
                odds += math.log(hit / alarm) if vote else math.log((1 - hit) / (1 - alarm))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, odds))))

    total = sum(row["n"] for row in patterns)
    for _ in range(ROUNDS):
        chances = [posterior(row) for row in patterns]
        true = sum(p * row["n"] for p, row in zip(chances, patterns, strict=True))
        prior = min(0.99, max(0.01, (true + 1) / (total + 2)))
        for name in rates:
            voted = [(p, row["n"], row[f"v_{name}"]) for p, row in zip(chances, patterns, strict=True) if row[f"v_{name}"] is not None]
            weight = (sum(p * n for p, n, _ in voted), sum((1 - p) * n for p, n, _ in voted))
            yes = (sum(p * n for p, n, v in voted if v), sum((1 - p) * n for p, n, v in voted if v))
            # A prior of ten spans holds the start value where a labeler has hardly voted, and keeps "for" meaning for.
            hit = (yes[0] + 10 * START) / (weight[0] + 10)
            alarm = (yes[1] + 10 * (1 - START)) / (weight[1] + 10)
            rates[name] = (min(0.999, max(hit, alarm + 0.001)), max(0.0005, min(alarm, hit)))
    names = [key for key in patterns[0] if key.startswith("f_")]
    weights: dict[str, dict] = {name: {} for name in names}
    bias = math.log(prior / (1 - prior))
    chances = [posterior(row) for row in patterns]
    for _ in range(300):
        # Logistic regression on soft labels by coordinate Newton steps: one value of one feature at a time.
        for name in names:
            for value in sorted({row[name] for row in patterns}):
                slope, curve = 0.0, 1.0
                for p, row in zip(chances, patterns, strict=True):
                    if row[name] == value:
                        odds = bias + sum(weights[other].get(row[other], 0.0) for other in names)
                        guess = 1 / (1 + math.exp(-max(-30.0, min(30.0, odds))))
                        slope += row["n"] / total * 100 * (p - guess)
                        curve += row["n"] / total * 100 * guess * (1 - guess)
                weights[name][value] = weights[name].get(value, 0.0) + (slope - 0.01 * weights[name].get(value, 0.0)) / curve
    return PiiModel(prior, rates, bias, {name.removeprefix("f_"): values for name, values in weights.items()})


def _chance(model: PiiModel, span: Column) -> Column:
    odds = F.lit(model.bias)
    for name, value in _features(span).items():
        known = model.weights.get(name, {})
        step = F.lit(0.0)
        for text, weight in sorted(known.items()):
            step = F.when(value == text, F.lit(weight)).otherwise(step)
        odds = odds + step
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-odds))


def _marks(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def find_personal_data(documents: DataFrame, model: PiiModel) -> DataFrame:
    """Columns ``_base`` and ``_extra`` (arrays of spans: kind, start, end, value, before) beside those of ``documents``.

    ``_extra`` keeps the method's candidates that the classifier accepts; where base spans cover parts of one, the
    other parts are spans of their own. Null and empty texts have no spans.
    """
    kept = F.filter("_extra", lambda span: _chance(model, span) >= THRESHOLD)
    return candidates(documents).withColumn("_extra", F.flatten(F.transform(kept, _rest)))


def digest(documents: DataFrame, model: PiiModel) -> DataFrame:
    """doc_id, counts of the base kinds, base_sha256 and spans of every row of ``documents`` (doc_id, text).

    Repeated rows repeat, spans of one kind never overlap, extra columns are ignored, a null doc_id is kept.
    """
    found = find_personal_data(documents.select("doc_id", "text"), model)
    kinds = F.transform("_base", lambda span: span["kind"])
    counts = [(F.size(kinds) - F.size(F.array_remove(kinds, kind))).cast("long").alias(f"n_{kind}") for kind in BASE]
    return found.select(
        "doc_id", *counts, F.sha2(_marks(F.col("_base")).cast("binary"), 256).alias("base_sha256"),
        _marks(F.concat("_base", "_extra")).alias("spans"),
    )


def masked(documents: DataFrame, model: PiiModel) -> DataFrame:
    """``documents`` with every span of text replaced by its kind in angle brackets; a null text stays null.

    Overlapping spans are replaced as one, named after the first.
    """
    found = find_personal_data(documents, model)
    spans = F.array_sort(F.transform(F.concat("_base", "_extra"), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))

    def step(state: Column, span: Column) -> Column:
        gap = F.col("text").substr(state["at"] + 1, F.greatest(span["start"] - state["at"], F.lit(0)))
        new = F.array(F.concat(gap, F.lit("<"), span["kind"], F.lit(">")))
        inside = span["start"] < state["at"]
        parts = F.when(inside, state["parts"]).otherwise(F.concat(state["parts"], new))
        return F.struct(F.greatest(state["at"], span["end"]).alias("at"), parts.alias("parts"))

    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("parts"))
    done = F.aggregate(spans, start, step, lambda s: F.concat(F.array_join(s["parts"], ""), F.col("text").substr(s["at"] + 1, F.length("text"))))
    replaced = F.when(F.size(spans) == 0, F.col("text")).otherwise(done)
    return found.withColumn("text", replaced).select(*documents.columns)

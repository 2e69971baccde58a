"""Keys and foreign keys from one-row-per-column catalog rows, with coverage rules."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablelift.functions.catalog import has_field, optional_int, optional_text, pick
from tablelift.operators.catalog import richest
from tablelift.session import materialize

#: What tells constraints apart once ``identified`` has named them.
CONSTRAINT = ["table_id", "constraint_type", "constraint_key"]
FOREIGN_KEY = ["table_id", "constraint_key"]

# Fields that name a constraint, the first one with a value counts; fields that hold whole member lists,
# and fields that hold one member.
_NAMES = ("constraint_oid", "constraint_id", "constraint_name", "name")
_KEY_LISTS, _KEY_MEMBERS = ("columns", "column_names", "local_columns"), ("column_name", "local_column_name")
_LOCAL_LISTS, _LOCAL_MEMBERS = ("local_columns", "columns", "column_names"), ("local_column_name", "column_name")
_REFERENCED_LISTS = ("referenced_columns", "foreign_column_names")
_REFERENCED_MEMBERS = ("referenced_column_name", "foreign_column_name")
_SEQUENCES = ("key_sequence", "ordinal_position", "column_position")


def constraint_key(rows: DataFrame) -> Column:
    """The catalog's own identity of a constraint: its id, else its name; NULL when it has neither."""
    named = [optional_text(pick(rows, name)) for name in _NAMES if has_field(rows, name)]
    return F.coalesce(*named) if named else F.lit(None).cast("string")


def identified(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows with a ``constraint_key``, rows without any identity). Each row of the second is a constraint by itself."""
    keyed = rows.withColumn("constraint_key", constraint_key(rows))
    return keyed.filter(F.col("constraint_key").isNotNull()), keyed.filter(F.col("constraint_key").isNull())


def _listed(rows: DataFrame, lists: tuple[str, ...], members: tuple[str, ...]) -> Column:
    """Members that a row names: its list, in order, or else its single member."""
    one = optional_text(pick(rows, *members))
    single = F.when(one.isNotNull(), F.array(one)).otherwise(F.array().cast("array<string>"))
    if not has_field(rows, *lists):
        return single
    return F.when(F.size(pick(rows, *lists)) > 0, pick(rows, *lists)).otherwise(single)


def _sequence(rows: DataFrame) -> Column:
    return optional_int(pick(rows, *_SEQUENCES))


def _placed(sequence: Column, *values: Column | str) -> Column:
    """Order by sequence, rows without one last, then by the values."""
    return F.struct(sequence.isNull().alias("unplaced"), F.coalesce(sequence, F.lit(0)).alias("place"), *values)


def _is_text(value: Column) -> Column:
    return F.coalesce(value != "", F.lit(False))


def _members(rows: DataFrame, listed: Column, *keep: str | Column) -> DataFrame:
    """One row per member that a row names, with its place; a row that names none keeps one without a member."""
    frame = rows.select(*keep, listed.alias("listed"), _sequence(rows).alias("sequence"))
    names = [name for name in frame.columns if name not in ("listed", "sequence")]
    exploded = frame.select(*names, "listed", "sequence", F.posexplode_outer("listed").alias("position", "member"))
    at = _placed(F.col("sequence"), "listed", "position").alias("at")
    return exploded.select(*names, "member", "sequence", at)


def _ordered(members: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Distinct members per key, by their first place; ``members`` lie together by key.

    Each member is folded to its first place before anything is collected, so a constraint collects as many
    items as it has members, however often the catalog repeats them.
    """
    first = members.filter(F.col("member").isNotNull()).groupBy(*keys, "member").agg(F.min("at").alias("at"))
    ordered = first.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("at", "member"))).alias("members"))
    return ordered.select(*keys, F.col("members.member").alias(name))


def _ordered_sides(rows: DataFrame, *facts: Column) -> DataFrame:
    """Distinct local and referenced columns per foreign key, by their first place, and ``facts`` over its rows.

    ``rows`` hold a key, by which they lie together, both lists (``l`` and ``r``) and a ``sequence``. Both sides are folded in one pass,
    as in ``_ordered``. Of two rows at one place the local columns decide first, then the referenced ones, on both sides alike.
    """

    def items(side: int, listed: str) -> Column:
        return F.transform(listed, lambda member, place: F.struct(F.lit(side).alias("side"), place.alias("position"), member.alias("member")))

    # A row without members keeps one item, so that its key and its facts stay.
    none = F.array(F.struct(F.lit(2).alias("side"), F.lit(0).alias("position"), F.lit(None).cast("string").alias("member")))
    every = F.concat(items(0, "l"), items(1, "r"), none)
    exploded = rows.select("*", F.explode(every).alias("item"))
    at = _placed(F.col("sequence"), "l", "r", "item.position").alias("at")
    keyed = exploded.select(*FOREIGN_KEY, "item.side", "item.member", at, *facts)
    names = keyed.columns[len(FOREIGN_KEY) + 3 :]
    first = keyed.groupBy(*FOREIGN_KEY, "side", "member").agg(F.min("at").alias("at"), *[F.bool_and(name).alias(name) for name in names])
    known = F.col("member").isNotNull()
    listed = [
        F.array_sort(F.collect_list(F.when(known & (F.col("side") == side), F.struct("at", "member")))).alias(name)
        for side, name in enumerate(("local_columns", "referenced_columns"))
    ]
    per_key = first.groupBy(*FOREIGN_KEY).agg(*listed, *[F.bool_and(name).alias(name) for name in names])
    return per_key.withColumns({name: F.col(f"{name}.member") for name in ("local_columns", "referenced_columns")})


def key_constraints(rows: DataFrame) -> DataFrame:
    """One row per key with its distinct columns in sequence order, attributes from the richest row.

    Rows belong together by id, else by name; a row with neither is a key of its own. A row holds one column or a
    whole list of columns.
    """
    named, alone = identified(rows)
    sources = {name.lower() for name in (*_KEY_LISTS, *_KEY_MEMBERS, *_SEQUENCES)}
    attributes = [name for name in rows.columns if name.lower() not in (*sources, "table_id", "constraint_type", "constraint_key")]
    described = richest(named, CONSTRAINT).select(*CONSTRAINT, *attributes)
    # Rows meet before they are unpacked into members.
    met = named.repartition(*CONSTRAINT)
    members = _members(met, _listed(met, _KEY_LISTS, _KEY_MEMBERS), *CONSTRAINT)
    joined = described.join(_ordered(members, CONSTRAINT, "found"), CONSTRAINT, "left")
    none = F.array().cast("array<string>")
    head = ["table_id", "constraint_type", *attributes]
    own = _listed(alone, _KEY_LISTS, _KEY_MEMBERS)
    return joined.select(*head, F.coalesce("found", none).alias("columns")).unionByName(
        alone.select(*head, F.array_distinct(own).alias("columns"))
    )


def key_coverage(rows: DataFrame, constraint_type: str, *, strict: bool = False) -> DataFrame:
    """COMPLETE per table when every key of the type has its full, ordered membership.

    A key of one column needs no sequence, nor does one that some row lists as a whole. ``strict`` asks every row for an id, a
    column and a positive sequence.
    """
    kept = rows.filter(F.col("constraint_type") == constraint_type)
    named, alone = identified(kept)
    parts = []
    for frame, keys in ((named, CONSTRAINT), (alone, None)):
        listed = _listed(frame, _KEY_LISTS, _KEY_MEMBERS)
        member, sequence = F.col("member"), F.col("sequence")
        whole = member.isNotNull() & sequence.isNotNull()
        if strict:
            id_ = optional_text(pick(frame, "constraint_oid", "constraint_id")).isNotNull()
            whole = member.isNotNull() & F.coalesce(sequence > 0, F.lit(False)) & F.col("has_id")
        else:
            id_ = F.lit(True)
        if keys is None:
            # A row by itself names its members as a whole, or one of them.
            complete = (F.size(listed) > 0) & (id_ & F.coalesce(_sequence(frame) > 0, F.lit(False)) if strict else F.lit(True))
            parts.append(frame.select("table_id", complete.alias("complete")))
            continue
        met = frame.repartition(*keys)
        members = _members(met, listed, *keys, id_.alias("has_id"))
        per_member = members.groupBy(*keys, "member").agg(F.min("at").alias("at"), F.bool_and(whole).alias("whole"))
        facts = [F.count("member").alias("columns"), F.bool_and("whole").alias("whole")]
        has_lists = has_field(frame, *_KEY_LISTS) and not strict
        if has_lists:
            facts.append(F.array_sort(F.collect_list(F.when(member.isNotNull(), F.struct("at", "member")))).alias("members"))
        per_key = per_member.groupBy(*keys).agg(*facts)
        complete = F.col("whole") & (F.col("columns") > 0)
        if not strict:
            complete = complete | (F.col("columns") == 1)
        if has_lists:
            lists = frame.select(*keys, pick(frame, *_KEY_LISTS).alias("members")).filter(F.col("members").isNotNull())
            lists = lists.distinct().withColumn("explicit", F.lit(True))
            per_key = per_key.withColumn("members", F.col("members.member")).join(lists, [*keys, "members"], "left")
            complete = complete | ((F.col("columns") > 0) & F.col("explicit").isNotNull())
        parts.append(per_key.select("table_id", complete.alias("complete")))
    return _per_table(parts[0].unionByName(parts[1]))


def _per_table(per_constraint: DataFrame) -> DataFrame:
    return per_constraint.groupBy("table_id").agg(
        F.when(F.bool_and("complete"), "COMPLETE").otherwise("PARTIAL").alias("coverage")
    )


def foreign_key_pairs(rows: DataFrame) -> DataFrame:
    """The richest complete (local, referenced) pair per sequence; incomplete rows are dropped."""
    complete = (
        _is_text(F.col("local_column_name"))
        & _is_text(F.col("referenced_column_name"))
        & _is_text(F.col("referenced_table"))
        & F.coalesce(F.col("key_sequence") > 0, F.lit(False))
    )
    named, alone = identified(rows.filter(complete))
    return richest(named, [*FOREIGN_KEY, "key_sequence"]).unionByName(alone).drop("constraint_key")


def foreign_keys(rows: DataFrame) -> DataFrame:
    """One row per foreign key: local and referenced columns in sequence order, attributes from the richest row.

    As ``key_constraints``: rows belong together by id, else by name, and hold one pair or two lists.
    """
    named, alone = identified(rows)
    lists = {"local_columns": (_LOCAL_LISTS, _LOCAL_MEMBERS), "referenced_columns": (_REFERENCED_LISTS, _REFERENCED_MEMBERS)}
    sources = {name for group in (*lists.values(), (_SEQUENCES,)) for names in group for name in names}
    attributes = [name for name in rows.columns if name.lower() not in (*sources, "table_id", "constraint_key", "expected_column_count")]
    described = richest(named, FOREIGN_KEY).select(*FOREIGN_KEY, *attributes)
    met = named.repartition(*FOREIGN_KEY)
    sides = [_listed(met, *names).alias(side) for side, names in zip("lr", lists.values())]
    found = described.join(_ordered_sides(met.select(*FOREIGN_KEY, *sides, _sequence(met).alias("sequence"))), FOREIGN_KEY)
    own = [F.array_distinct(_listed(alone, *names)).alias(name) for name, names in lists.items()]
    columns = ["table_id", *attributes, *lists]
    return found.select(*columns).unionByName(alone.select("table_id", *attributes, *own))


def foreign_key_membership(rows: DataFrame) -> DataFrame:
    """COMPLETE per table when both sides of every foreign key are known, in order and equally long.

    Some row has to list both sides as they are, or hold the only pair; or each row has a place and every pair of the ordered sides
    was seen in a row.
    """
    keyed = rows.select(
        "table_id",
        constraint_key(rows).alias("constraint_key"),
        _listed(rows, _LOCAL_LISTS, _LOCAL_MEMBERS).alias("l"),
        _listed(rows, _REFERENCED_LISTS, _REFERENCED_MEMBERS).alias("r"),
        _sequence(rows).alias("sequence"),
    )
    # Written, because the sides and what the rows say of them read all rows again.
    keyed = materialize(keyed, "foreign-key-rows")
    base, alone = keyed.filter(F.col("constraint_key").isNotNull()), keyed.filter(F.col("constraint_key").isNull())
    by_itself = alone.select("table_id", ((F.size("l") > 0) & (F.size("l") == F.size("r"))).alias("complete"))

    # All rows of a key meet once; everything below stays where they are.
    base = base.repartition(*FOREIGN_KEY)
    level = F.size("l") == F.size("r")
    ordered = _ordered_sides(base, ((F.size("l") > 0) & level & F.col("sequence").isNotNull()).alias("placed"))
    ordered = ordered.select(*FOREIGN_KEY, F.col("local_columns").alias("l"), F.col("referenced_columns").alias("r"), "placed")

    # The ordered sides as one list and as pairs, and the lists and pairs that rows hold, fold together, which spares joins of the two.
    def items(paired: Column) -> Column:
        pairs = F.transform(F.arrays_zip("l", "r"), lambda pair: F.struct(F.lit(False).alias("whole"), F.array(pair["l"]).alias("l"), F.array(pair["r"]).alias("r")))
        lists = F.array(F.struct(F.lit(True).alias("whole"), "l", "r"))
        return F.explode(F.when(paired, F.concat(lists, pairs)).otherwise(lists)).alias("item")

    even = (F.size("l") > 0) & level
    none, yes = F.lit(None).cast("boolean"), F.lit(True)
    facts = [even.alias("even"), (F.size("l") == 1).alias("single"), "placed"]
    wanted = ordered.select(*FOREIGN_KEY, items(even), yes.alias("wanted"), F.lit(False).alias("seen"), F.lit(False).alias("covered"), *facts)
    no_facts = [none.alias(name) for name in ("even", "single", "placed")]
    seen = base.select(*FOREIGN_KEY, items(level), F.lit(False).alias("wanted"), yes.alias("seen"), F.col("sequence").isNotNull().alias("covered"), *no_facts)
    flags = ["wanted", "seen", "covered", "even", "single", "placed"]
    met = wanted.unionByName(seen).groupBy(*FOREIGN_KEY, "item").agg(*[F.max(flag).alias(flag) for flag in flags]).filter("wanted")
    whole = F.col("item.whole")
    per_key = met.groupBy(*FOREIGN_KEY).agg(
        *[F.max(flag).alias(flag) for flag in ("even", "single", "placed")],
        F.max(F.when(whole, F.col("seen"))).alias("explicit"),
        F.bool_and(F.when(~whole, F.col("seen"))).alias("paired"),
        F.bool_and(F.when(~whole, F.col("covered"))).alias("covered"),
    )
    known = (F.col("single") & F.col("paired")) | (F.col("placed") & F.col("covered"))
    if has_field(rows, *_LOCAL_LISTS, *_REFERENCED_LISTS):
        known = known | F.col("explicit")
    judged = per_key.select("table_id", F.coalesce(F.col("even") & known, F.lit(False)).alias("complete"))
    return _per_table(by_itself.unionByName(judged))


def _without_repeats(rows: DataFrame, keys: list[str], *values: Column) -> DataFrame:
    """Per key whether no value comes twice in any of the columns. Rows meet before they are unpacked into values."""
    items = F.array(*[F.struct(F.lit(n).alias("side"), value.cast("string").alias("value")) for n, value in enumerate(values)])
    times = rows.repartition(*keys).select(*keys, F.explode(items).alias("item")).groupBy(*keys, "item").agg(F.count(F.lit(1)).alias("times"))
    return times.groupBy(*keys).agg((F.max("times") == 1).alias("distinct"))


def foreign_key_coverage(rows: DataFrame) -> DataFrame:
    """COMPLETE per table when every foreign key has exactly its expected, distinct pairs, under an id of its own."""
    sequence, expected = F.col("key_sequence"), F.col("expected_column_count")
    local, referenced = F.col("local_column_name"), F.col("referenced_column_name")
    named, alone = identified(rows)
    per_key = named.groupBy(*FOREIGN_KEY).agg(
        F.count(F.lit(1)).alias("n"),
        F.bool_and(_is_text(optional_text(pick(named, "constraint_oid", "constraint_id")))).alias("has_id"),
        F.min(F.coalesce(expected, F.lit(-1))).alias("least"),
        F.max(F.coalesce(expected, F.lit(-1))).alias("most"),
        F.bool_and(_is_text(local) & _is_text(referenced)).alias("named"),
        F.bool_and(F.coalesce((sequence > 0) & (sequence <= expected), F.lit(False))).alias("in_range"),
    )
    distinct = _without_repeats(named, FOREIGN_KEY, sequence, local, referenced)
    complete = (
        F.col("has_id")
        & (F.col("least") == F.col("most"))
        & (F.col("most") > 0)
        & (F.col("n") == F.col("most"))
        & F.col("distinct")
        & F.col("named")
        & F.col("in_range")
    )
    judged = per_key.join(distinct, FOREIGN_KEY).select("table_id", complete.alias("complete"))
    return _per_table(judged.unionByName(alone.select("table_id", F.lit(False).alias("complete"))))


def zip_columns(constraints: DataFrame, keys: Sequence[str] = ("table_id", "constraint_id")) -> DataFrame:
    """Unnest two parallel arrays by position; a missing partner stays NULL."""
    zipped = F.arrays_zip("local_columns", "referenced_columns")
    return constraints.select(*keys, F.posexplode(zipped).alias("position", "pair")).select(
        *keys,
        (F.col("position") + 1).alias("key_sequence"),
        F.col("pair.local_columns").alias("local_column_name"),
        F.col("pair.referenced_columns").alias("referenced_column_name"),
    )


def referenced_keys(references: DataFrame, constraints: DataFrame) -> DataFrame:
    """Follow foreign key → referential rule → referenced key over one constraint table."""
    own = constraints.select("constraint_name", F.col("table_id"), "constraint_type")
    target = constraints.select(
        F.col("constraint_name").alias("referenced_constraint"), F.col("table_id").alias("referenced_table_id")
    )
    foreign = own.filter(F.col("constraint_type") == "FOREIGN KEY")
    return foreign.join(references, "constraint_name").join(target, "referenced_constraint", "left").select(
        "table_id", "constraint_name", "referenced_constraint", "referenced_table_id"
    )


def accept_primary_keys(headers: DataFrame, members: DataFrame, columns: DataFrame | None = None) -> DataFrame:
    """All-or-nothing primary-key membership per table.

    ``columns`` of a key is set when its members have exactly the positions 1..n,
    without a repeated position, column or row, and nothing contradicts the header;
    otherwise it is NULL and ``warning`` says why. ``members`` carry
    ``member_table_id``, the table they claim to belong to. Where the full column
    list of the tables is given, members have to be in it.
    """
    by_name = ["table_id", "constraint_name"]
    header_counts = headers.groupBy(*by_name).agg(
        F.count(F.lit(1)).alias("headers"), F.min("comment").alias("header_comment")
    )
    if columns is None:
        known = members.withColumn("known", F.lit(True))
    else:
        listed = columns.select("table_id", "column_name").distinct().withColumn("listed", F.lit(True))
        known = members.join(listed, ["table_id", "column_name"], "left").withColumn("known", F.col("listed").isNotNull())
    sequence, name = F.col("key_sequence"), F.col("column_name")
    readable = _is_text(name) & F.coalesce(sequence >= 1, F.lit(False))
    conflicting = F.coalesce(F.col("header_comment") != F.col("comment"), F.lit(False))
    stray = F.col("headers").isNull() | ~F.col("member_table_id").eqNullSafe(F.col("table_id"))
    per_key = known.join(header_counts, by_name, "left").groupBy(*by_name).agg(
        F.bool_or(stray).alias("unmatched"),
        F.bool_or(~readable).alias("unreadable"),
        F.bool_or(conflicting).alias("conflict"),
        F.bool_and("known").alias("known"),
        F.count(F.lit(1)).alias("n"),
        F.min(sequence).alias("low"),
        F.max(sequence).alias("high"),
    )
    per_key = per_key.join(_without_repeats(members, by_name, sequence, name), by_name)
    n = F.col("n")
    ordered = F.col("distinct") & (F.col("low") == 1) & (F.col("high") == n) & F.col("known")
    per_table = header_counts.join(per_key, by_name, "full").groupBy("table_id").agg(
        F.bool_or(F.col("headers") > 1).alias("repeated"),
        F.bool_or("unmatched").alias("unmatched"),
        F.bool_or("unreadable").alias("unreadable"),
        F.bool_or("conflict").alias("conflict"),
        F.bool_or(n.isNull()).alias("missing"),
        F.bool_and(ordered).alias("ordered"),
        F.count("n").alias("keys_with_members"),
    )

    def yes(flag: str) -> Column:
        return F.coalesce(F.col(flag), F.lit(False))

    warning = (
        F.when(yes("repeated"), "PRIMARY_KEY_MEMBERSHIP_PARTIAL")
        .when(F.col("keys_with_members") == 0, "PRIMARY_KEY_MEMBERSHIP_UNAVAILABLE")
        .when(yes("unmatched"), "PRIMARY_KEY_MEMBERSHIP_UNMATCHED")
        .when(yes("unreadable"), "PRIMARY_KEY_MEMBERSHIP_PARTIAL")
        .when(yes("conflict"), "PRIMARY_KEY_MEMBERSHIP_CONFLICT")
        .when(yes("missing"), "PRIMARY_KEY_MEMBERSHIP_UNAVAILABLE")
        .when(~yes("ordered"), "PRIMARY_KEY_MEMBERSHIP_PARTIAL")
    )
    judged = per_table.select("table_id", warning.alias("warning"))
    # Only accepted keys are collected: each has as many members as key columns.
    accepted = members.join(judged.filter(F.col("warning").isNull()), "table_id", "left_semi").groupBy(*by_name).agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("key_sequence", "column_name"))), lambda item: item["column_name"]
        ).alias("columns")
    )
    keys = headers.select(*by_name).distinct().join(judged, "table_id")
    return keys.join(accepted, by_name, "left").select(*by_name, "columns", "warning")

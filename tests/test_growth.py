"""What keeps tasks small and shuffles narrow while catalogs grow."""

from pyspark.sql import functions as F

from tablelift.functions.json import canonical_row
from tablelift.operators.catalog import mark_membership, richest
from tablelift.operators.constraints import foreign_key_membership, foreign_keys
from tablelift.operators.matching import special_scores, suggest_mappings
from tablelift.queries.catalogs import SOURCE_COLUMNS_SQL, TARGET_COLUMNS_SQL, on_spark
from tablelift.queries.matching import catalogs
from tablelift.session import small_partitions

ADVISORY = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
COLUMNS = (
    "table_id string, column_name string, ordinal_position int, canonical_type string, nullable boolean, character_length int,"
    " numeric_precision int, numeric_scale int, datetime_precision int"
)
FRAGMENTS = (
    "table_id string, constraint_id string, local_column_name string, referenced_column_name string, key_sequence int,"
    " local_columns array<string>, foreign_column_names array<string>"
)


def plan_of(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def test_tasks_hold_little_unless_the_session_says_otherwise(spark):
    before = spark.conf.get(ADVISORY)
    try:
        spark.conf.unset(ADVISORY)
        small_partitions(spark)
        assert spark.conf.get(ADVISORY) == "4m"
        spark.conf.set(ADVISORY, "32m")
        small_partitions(spark)
        assert spark.conf.get(ADVISORY) == "32m"
    finally:
        spark.conf.set(ADVISORY, before)


def test_rows_with_plain_lists_are_rendered_once(spark):
    rows = spark.createDataFrame([("b", ["x\"y", None, "é\u0001"], 1)], "name string, items array<string>, n int")
    text = rows.select(canonical_row(rows).alias("text"))
    assert "parse_json" not in plan_of(text)
    assert text.first()[0] == rows.select(F.to_json(F.parse_json(F.to_json(F.struct("items", "n", "name"), {"ignoreNullFields": "false"})))).first()[0]


def test_foreign_keys_read_their_rows_once_for_both_sides(spark):
    rows = spark.createDataFrame(
        [("t", "f", "b", "y", 2, None, None), ("t", "f", "a", "x", 1, None, None), ("t", "f", "a", "x", 1, None, None), ("t", "e", None, None, None, None, None)],
        FRAGMENTS,
    )
    found = foreign_keys(rows)
    assert plan_of(found).count("Scan ExistingRDD") == 3  # attributes, both sides, rows without a key
    assert {(row.constraint_id, *row.local_columns, *row.referenced_columns) for row in found.collect()} == {("f", "a", "b", "x", "y"), ("e",)}


def test_membership_coverage_of_every_kind(spark):
    rows = [
        ("placed", "k", "a", "x", 1, None, None), ("placed", "k", "b", "y", 2, None, None),
        ("unplaced", "k", "a", "x", None, None, None), ("unplaced", "k", "b", "y", 2, None, None),
        ("single", "k", "a", "x", None, None, None), ("listed", "k", None, None, None, ["a", "b"], ["x", "y"]),
        ("uneven", "k", None, None, 1, ["a", "b"], ["x"]), ("crossed", "k", "a", "y", 1, None, None),
        ("crossed", "k", "b", "x", 1, None, None), ("crossed", "k", "a", "x", 2, None, None), ("none", "k", None, None, 1, None, None),
        ("alone", None, "a", "x", None, None, None), ("both", None, "a", "x", None, None, None), ("both", None, "a", None, None, None, None),
    ]
    coverage = foreign_key_membership(spark.createDataFrame(rows, FRAGMENTS))
    # The written sides are read, not made again for each fact.
    assert "Scan ExistingRDD" not in plan_of(coverage)
    complete = {row.table_id for row in coverage.collect() if row.coverage == "COMPLETE"}
    assert complete == {"placed", "single", "listed", "crossed", "alone"}


def catalog(spark, prefix, names):
    rows = [(f"{prefix}{table}", name, place, "STRING", None, None, None, None, None) for table, name, place in names]
    return spark.createDataFrame(rows, COLUMNS)


def test_small_table_pairs_fold_without_sorting_their_comparisons(spark):
    source = catalog(spark, "s", [(1, "user_id", 1), (1, "name", 2), (1, "name", 2)])
    target = catalog(spark, "t", [(1, "user_id", 1), (1, "NAME", 3), (1, "na_me", 4)])
    pairs = spark.createDataFrame([("s1", "t1"), ("s1", "t2")], "source_table string, target_table string")
    found = suggest_mappings(source, target, pairs)
    assert "SortAggregate" not in plan_of(found)
    shown = {(row.target_table, row.source_column): (row.target_column, row.decision) for row in found.collect()}
    assert shown == {
        ("t1", "user_id"): ("user_id", "SUGGESTED"), ("t1", "name"): (None, "AMBIGUOUS"),
        ("t2", "user_id"): (None, "UNMATCHED"), ("t2", "name"): (None, "UNMATCHED"),
    }


def test_special_scores_are_alike_for_small_and_large_pairs(spark, monkeypatch):
    names = ["a_b", "A_B", "ab", "a-b", "c", "C"]
    source = catalog(spark, "s", [(1, name, n) for n, name in enumerate(names)] + [(1, "z", None)])
    target = catalog(spark, "t", [(1, name, n + 1) for n, name in enumerate(reversed(names))] + [(1, "z", None)])
    pairs = spark.createDataFrame([("s1", "t1")], "source_table string, target_table string")
    small = special_scores(source, target, pairs).collect()
    monkeypatch.setattr("tablelift.operators.matching.COMPARED", 0)
    large = special_scores(source, target, pairs).collect()
    assert len(small) > 7 and sorted(small) == sorted(large)
    monkeypatch.undo()
    assert sorted(special_scores(source, target, pairs.unionByName(pairs)).collect()) == sorted(2 * small)


def test_a_landed_document_is_rendered_once(spark):
    from tablelift.sinks.staging import stage, staging_database
    from uuid import uuid4

    rows = spark.createDataFrame([(1, '{"b":1,"a":2}'), (2, "{"), (3, None), (4, '{"a":1,"a":2}')], "n int, doc string")
    staged = stage(rows, uuid4(), staging_database(spark), json_columns=["doc"], quarantine=True)
    assert {tuple(row) for row in spark.table(staged.relation).collect()} == {(1, '{"a":2,"b":1}'), (3, None)}
    assert {tuple(row) for row in spark.table(staged.rejected).collect()} == {
        ("doc", "UNREADABLE_JSON", "{"), ("doc", "UNREADABLE_JSON", '{"a":1,"a":2}'),
    }


def test_facets_of_a_table_meet_in_one_shuffle(spark):
    from tablelift.operators.documents import _gathered

    lists = {
        "columns": (spark.createDataFrame([("t", 2), ("t", 1)], "table_id string, n int"), [F.col("n").alias("o")]),
        "checks": (spark.createDataFrame([("u", "c")], "table_id string, e string"), [F.col("e").alias("o")]),
    }
    found = _gathered(lists, {"c_columns": spark.createDataFrame([("t", "PARTIAL")], "table_id string, coverage string")})
    assert plan_of(found).count("Exchange") == 1
    rows = {row.table_id: ([item.n for item in row.columns], [item.e for item in row.checks], row.c_columns) for row in found.collect()}
    assert rows == {"t": ([1, 2], [], "PARTIAL"), "u": ([], ["c"], None)}


def test_relations_without_a_strategy_spread_over_tasks(spark):
    from tablelift.operators.catalog import partitions

    classes = spark.range(4000).selectExpr("id AS relation_id", "CASE WHEN id = 0 THEN 'p' ELSE 'r' END AS relkind")
    links = spark.sql("SELECT 1L AS child_id, 0L AS parent_id, 'IN (1)' AS partition_bound")
    strategies = spark.sql("SELECT 0L AS strategy_id, 'h' AS partstrat, 'KEY (a)' AS partition_key")
    settings = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {name: spark.conf.get(name) for name in settings}
    try:
        for name, value in settings.items():
            spark.conf.set(name, value)
        found = partitions(classes, links, strategies, True).withColumn("task", F.spark_partition_id()).collect()
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)
    assert {row.relation_id for row in found if row.partition_strategy == "HASH"} == {0, 1} and len(found) == 4000
    tasks = [row.task for row in found]
    assert max(tasks.count(task) for task in set(tasks)) < 2000


def shuffles(frame):
    return plan_of(frame).count("Exchange hashpartitioning")


def test_rows_of_a_foreign_key_meet_before_they_are_unpacked(spark):
    rows = spark.createDataFrame([("t", "f", "a", "x", 1, None, None), ("t", "f", None, None, 2, ["b", None], ["y"])], FRAGMENTS)
    found = foreign_keys(rows)
    # One for the attributes and one for both sides; members and JSON are made behind them.
    assert shuffles(found) == 2
    plan = plan_of(found)
    assert max(line.find("Exchange hashpartitioning") for line in plan.splitlines() if "Generate" in line) == -1
    assert [(row.local_columns, row.referenced_columns) for row in found.collect()] == [(["a", "b"], ["x", "y"])]


def test_richest_row_is_chosen_where_its_copies_meet(spark):
    rows = spark.createDataFrame([("t", "a", None, 2), ("t", "a", "x", 1), ("t", "a", "x", 3), (None, "a", None, None)], "table_id string, name string, note string, n int")
    kept = richest(rows, ["table_id", "name"])
    # What folds before the shuffle would carry the JSON of every row through it.
    below = plan_of(kept).split("Exchange hashpartitioning")[1]
    assert shuffles(kept) == 1 and "min_by" not in below
    assert {tuple(row) for row in kept.collect()} == {("t", "a", "x", 1), (None, "a", None, None)}


def test_membership_coverage_sends_its_rows_once(spark):
    rows = spark.createDataFrame([("t", "f", "a", "x", 1, None, None), ("t", "f", "b", "y", 2, None, None), ("u", "f", None, None, None, ["a", "b"], ["x"])], FRAGMENTS)
    found = foreign_key_membership(rows)
    # Rows for the ordered sides and for what rows say of them, which is the same shuffle, and one row per key for its table.
    assert shuffles(found) == 3
    assert {tuple(row) for row in found.collect()} == {("t", "COMPLETE"), ("u", "PARTIAL")}


def test_marks_of_a_table_leave_its_columns_where_they_are(spark):
    sides = "spark.sql.requireAllClusterKeysForCoPartition"
    before = spark.conf.get(sides), spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        small_partitions(spark)
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        columns = spark.createDataFrame([("t", "a"), ("t", "b"), ("u", "a"), (None, "a")], "table_id string, column_name string")
        coverage = spark.createDataFrame([("t", "COMPLETE"), ("u", "PARTIAL")], "table_id string, coverage string")
        members = spark.createDataFrame([("t", "a"), ("t", "a"), (None, "a")], "table_id string, column_name string")
        marked = mark_membership(mark_membership(columns, members, coverage, "one"), members, coverage, "two")
        # Columns once; per mark its coverage, its members to be distinct and to meet the columns.
        assert shuffles(marked) == 7
        assert {tuple(row) for row in marked.collect()} == {
            ("t", "a", True, True), ("t", "b", False, False), ("u", "a", None, None), (None, "a", None, None),
        }
    finally:
        spark.conf.set(sides, before[0])
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before[1])


def test_catalogs_are_made_from_one_written_build(spark, tmp_path):
    spark.createDataFrame([(1, 1, 1, 5.0), (1, 2, 2, 6.0), (1, 2, 3, 7.0), (None, 7, 4, 8.0), (2, 7, 1, None)], "l_orderkey long, l_partkey long, l_linenumber int, l_quantity double").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(1, "red box", 3), (2, "blue cup", 4), (7, "red box", None)], "p_partkey long, p_name string, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    spark.createDataFrame([(1,), (2,), (None,)], "o_orderkey long").write.parquet(f"{tmp_path}/orders.parquet")
    source, target, _ = catalogs(spark, str(tmp_path))
    for found, sql in ((source, SOURCE_COLUMNS_SQL), (target, TARGET_COLUMNS_SQL)):
        assert "lineitem" not in plan_of(found) and shuffles(found) == 0
        wanted = on_spark(spark, str(tmp_path), sql)
        assert found.count() > 0 and found.schema == wanted.schema
        assert found.exceptAll(wanted).isEmpty() and wanted.exceptAll(found).isEmpty()


def test_small_table_pairs_lie_by_source_table(spark):
    settings = "spark.sql.requireAllClusterKeysForCoPartition", "spark.sql.autoBroadcastJoinThreshold"
    before = [spark.conf.get(name) for name in settings]
    try:
        for name, value in zip(settings, ("false", "-1")):
            spark.conf.set(name, value)
        source = catalog(spark, "s", [(1, "user_id", 1), (2, "name", 1)])
        target = catalog(spark, "t", [(1, "user_id", 1), (1, "name", 2)])
        pairs = spark.createDataFrame([("s1", "t1"), ("s2", "t1")], "source_table string, target_table string")
        # Pairs and columns of both sides by table, and the target's columns by source table; those of the source stay.
        for found in (suggest_mappings(source, target, pairs), special_scores(source, target, pairs)):
            assert shuffles(found) == 5
        found = suggest_mappings(source, target, pairs)
        assert {(row.source_table, row.target_column) for row in found.collect()} == {("s1", "user_id"), ("s2", "name")}
    finally:
        for name, value in zip(settings, before):
            spark.conf.set(name, value)

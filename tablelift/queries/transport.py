"""Staging, publishing, audits and canonical JSON queries."""

from __future__ import annotations

import uuid
from dataclasses import replace

from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablelift.functions.json import canonical_json, fingerprint, request_hash
from tablelift.operators.audits import lossy_casts, null_violations
from tablelift.operators.projection import null_out
from tablelift.operators.reconcile import validate
from tablelift.plans.expressions import cast, copy_of
from tablelift.plans.limits import Endpoint
from tablelift.plans.plan import Approval, Plan
from tablelift.queries.data import (
    CUSTOMER_PLAN,
    CUSTOMER_SOURCE_SQL,
    CUSTOMER_TARGET_SQL,
    customer_source,
    report_sql,
    table,
)
from tablelift.queries.validation import ORACLES as VALIDATION_ORACLES
from tablelift.session import new_run_dir
from tablelift.sinks.publish import publish
from tablelift.sinks.staging import file_evidence, landed, stage, staging_database, totals, transfer
from tablelift.sources.tables import query, scan
from tablelift.streaming.load import batch_evidence, load_stream, loaded, read_files
from tablelift.workflow import full_run, load


def staged_customer(spark, sf_dir):
    """Customers written to a staging table and read back."""
    return stage(customer_source(spark, sf_dir), uuid.uuid4(), staging_database(spark)).frame(spark)


def target_table(spark) -> str:
    """A new, empty customer target with one column the plan does not fill."""
    name = f"{staging_database(spark)}.customer_{uuid.uuid4().hex}"
    spark.sql(
        f"CREATE TABLE {name} (customer_key DECIMAL(38,0), label STRING, c_nationkey INT, balance DECIMAL(18,2),"
        " segment STRING, origin STRING DEFAULT 'migration') USING parquet"
    )
    return name


def published_customer(spark, sf_dir):
    staged = stage(customer_source(spark, sf_dir), uuid.uuid4(), staging_database(spark))
    name = target_table(spark)
    publish(staged.frame(spark), CUSTOMER_PLAN, name)
    return spark.table(name)


def run_report(spark, sf_dir):
    _, _, result = full_run(
        spark, customer_source(spark, sf_dir), CUSTOMER_PLAN, target_table(spark), staging_database(spark), uuid.uuid4()
    )
    return result


def run_steps(spark, sf_dir):
    steps = load(
        customer_source(spark, sf_dir), CUSTOMER_PLAN, target_table(spark), staging_database(spark), uuid.uuid4()
    )
    return steps.select("step", "stage", "status", "rows", "plan_version")


def failed_run_report(spark, sf_dir):
    """A run whose staging name is taken: nothing is published, and the report must not pass."""
    source, run, database = customer_source(spark, sf_dir), uuid.uuid4(), staging_database(spark)
    target = target_table(spark)
    publish(source, CUSTOMER_PLAN, target)
    stage(source, run, database)
    return full_run(spark, source, CUSTOMER_PLAN, target, database, run)[2]


def repeated_run(spark, sf_dir):
    """The same run twice: its rows are in the target once, and the second call returns the first one's evidence."""
    source, run, database, target = customer_source(spark, sf_dir), uuid.uuid4(), staging_database(spark), target_table(spark)
    load(source, CUSTOMER_PLAN, target, database, run)
    again = load(source, CUSTOMER_PLAN, target, database, run)
    return again.select("step", "stage", "status", "rows", F.lit(spark.table(target).count()).alias("target_rows"))


def refused_run(spark, sf_dir):
    """A source with a NULL in a required column: the publish is refused, staging goes, the target stays empty."""
    plan = Plan("customer", "customer_target", tuple(
        replace(item, target_nullable=False) if item.target_column == "c_nationkey" else item for item in CUSTOMER_PLAN.approvals
    ))
    source = null_out(customer_source(spark, sf_dir), "c_nationkey", "7")
    target, database = target_table(spark), staging_database(spark)
    steps = load(source, plan, target, database, uuid.uuid4())
    return steps.select("step", "stage", "status", "rows", F.lit(spark.table(target).count()).alias("target_rows"))


def lineitem_evidence(spark, sf_dir):
    """Rows read against rows per written file of a staged lineitem."""
    source = table(spark, sf_dir, "lineitem")
    stored = stage(source, uuid.uuid4(), staging_database(spark)).frame(spark)
    return totals(source, file_evidence(stored))


def landed_embeddings(spark, sf_dir):
    """Staging types at work: arrays land as canonical JSON text, from which every value can be read back."""
    stored = landed(table(spark, sf_dir, "embeddings"))
    values = F.from_json("embedding", "array<float>")
    return stored.select("vec_id", "label", F.posexplode(values).alias("position", "value"))


def landed_nested(spark, sf_dir):
    """Structs with NULL fields and long decimals land with all fields and all digits."""
    item = F.struct(
        F.nullif(F.col("l_returnflag"), F.lit("N")).alias("flag"),
        ((F.col("l_orderkey") + 1).cast("decimal(38,0)") * F.lit("1000000000000000000000").cast("decimal(22,0)") + F.col("l_linenumber")).cast("decimal(38,0)").alias("number"),
    )
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", item.alias("item"))
    return landed(lines)


_GOOD_DOCUMENT = """concat('{"b": 12345678901234567890123456789012345678901234567890.50, "a": [1e400, -0.0, {"z": ', event_id, ', "k": "', event_type, '"}]}')"""
_DOCUMENTS_SQL = f"""
    SELECT event_id, CASE event_id % 10 WHEN 3 THEN '{{"a": 1' WHEN 5 THEN '{{"a": 1, "a": 2}}' WHEN 7 THEN '{{"a": NaN}}'
                                        WHEN 9 THEN NULL ELSE {_GOOD_DOCUMENT} END AS document,
           CASE WHEN event_id % 11 = 4 THEN CAST('NaN' AS DOUBLE) ELSE event_id / 2 END AS value
    FROM events
"""


def _staged_documents(spark, sf_dir):
    """Documents with long numbers, broken ones and numbers that are none, landed with a quarantine."""
    table(spark, sf_dir, "events").createOrReplaceTempView("events")
    rows = spark.sql(_DOCUMENTS_SQL).select("event_id", "document", F.struct("value").alias("reading"))
    return stage(rows, uuid.uuid4(), staging_database(spark), json_columns=["document"], quarantine=True)


def landed_documents(spark, sf_dir):
    return _staged_documents(spark, sf_dir).frame(spark)


def rejected_documents(spark, sf_dir):
    """Evidence of what did not land."""
    return spark.table(_staged_documents(spark, sf_dir).rejected).groupBy("column_name", "code", "raw_text").agg(
        F.count(F.lit(1)).alias("values")
    )


def transfer_outcomes(spark, sf_dir):
    """How transfers of one table end: permitted or not, with a hole, with broken documents, repeated, unreported."""
    database, source = staging_database(spark), customer_source(spark, sf_dir)
    reader, writer = Endpoint("elsewhere"), Endpoint(database, can_write=True)
    broken = source.withColumn("c_name", F.when(F.col("c_custkey") % 7 == 0, "{").otherwise("[]"))
    taken = uuid.uuid4()
    stage(source, taken, database)

    def no_report(*_):
        raise ConnectionError

    attempts = {
        "permitted": transfer(source, uuid.uuid4(), database, ends=(reader, writer), required=["c_custkey"]),
        "read only": transfer(source, uuid.uuid4(), database, ends=(reader, Endpoint(database))),
        "hole": transfer(source, uuid.uuid4(), database, required=["c_custkey", "c_mktsegment"]),
        "unreadable": transfer(broken, uuid.uuid4(), database, json_columns=["c_name"]),
        "set aside": transfer(broken, uuid.uuid4(), database, json_columns=["c_name"], quarantine=True),
        "taken": transfer(source, taken, database),
        "unreported": transfer(source, uuid.uuid4(), database, report=no_report),
    }
    rows = [
        (name, one.disposition, one.reason, *((one.staged.rows_written, one.staged.rows_rejected) if one.staged else (None, None)))
        for name, one in attempts.items()
    ]
    return spark.createDataFrame(rows, "attempt string, disposition string, reason string, rows_written bigint, rows_rejected bigint")


def json_events(spark, sf_dir):
    """Nested JSON written with unsorted keys and blanks, brought to canonical form and fingerprinted."""
    text = F.concat(
        F.lit('{ "z" : '), F.col("event_id").cast("string"), F.lit(', "props": '), "props",
        F.lit(', "a": [ 1, {"y": null, "b": "'), "event_type", F.lit('"} ] }'),
    )
    events = table(spark, sf_dir, "events").select("event_id", canonical_json(text).alias("document"))
    return events.select(
        "event_id",
        "document",
        fingerprint(F.col("document")).alias("document_sha256"),
        request_hash("LOAD_EVENT", F.col("document")).alias("request_sha256"),
    )


LOSSY_PLAN = Plan(
    "lineitem",
    "lineitem_small",
    tuple(
        Approval(
            source, "OVERRIDDEN", target, data_type, position, compatibility="LOSSY",
            transformation=cast(source, family), override_reason="Audited before the load.",
        )
        for position, (source, target, family, data_type) in enumerate(
            [
                ("l_quantity", "quantity", "INTEGER", T.IntegerType()),
                ("l_extendedprice", "price", "INTEGER", T.IntegerType()),
                ("l_partkey", "part", "INTEGER", T.ByteType()),
                ("l_shipdate", "shipped", "DATE", T.DateType()),
                ("l_orderkey", "order_text", "STRING", T.StringType()),
            ],
            start=1,
        )
    ),
)

EVENT_PLAN = Plan(
    "events",
    "event_copy",
    (
        Approval(
            "event_id", "APPROVED", "event_key", T.DecimalType(20, 0), 1,
            compatibility="SAFE", transformation=cast("event_id", "DECIMAL"),
        ),
        Approval(
            "event_type", "APPROVED", "kind", T.StringType(), 2,
            compatibility="EXACT", transformation=copy_of("event_type"),
        ),
    ),
)


def _streamed_events(spark, sf_dir):
    """Events split into eight files and loaded two files per micro-batch."""
    run = new_run_dir(spark, "stream")
    events = scan(table(spark, sf_dir, "events"), ["event_id", "event_type"])
    events.repartition(8, "event_id").write.parquet(f"{run}/in")
    stream = read_files(spark, f"{run}/in", events.schema, 2)
    load_stream(stream, EVENT_PLAN, f"{run}/out", f"{run}/state")
    return f"{run}/out"


def stream_rows(spark, sf_dir):
    """Everything the micro-batches wrote."""
    return loaded(spark, _streamed_events(spark, sf_dir))


def stream_counts(spark, sf_dir):
    """Totals over the batch evidence."""
    batches = batch_evidence(spark, _streamed_events(spark, sf_dir))
    return batches.agg(
        F.sum("rows_read").alias("rows_read"),
        F.sum("rows_written").alias("rows_written"),
        F.count(F.lit(1)).alias("batches"),
        F.max("batch_id").cast("int").alias("last_batch"),
    )


def null_checks(spark, sf_dir):
    orders = null_out(table(spark, sf_dir, "orders"), "o_orderstatus", "P")
    return null_violations(orders, ["o_orderkey", "o_custkey", "o_orderstatus"])


def capped_orders(spark, sf_dir):
    """An ad-hoc query whose request for 20,000 rows is lowered to the profile's 500."""
    return query(
        spark,
        "SELECT o_orderkey, o_totalprice FROM {orders} WHERE o_orderstatus = :status ORDER BY o_orderkey",
        {"status": "F"},
        max_rows=20_000,
        profile_rows=500,
        orders=table(spark, sf_dir, "orders"),
    )


QUERIES = {
    "stage_customer_roundtrip": staged_customer,
    "publish_insert_select": published_customer,
    "load_evidence_lineitem": lineitem_evidence,
    "staging_types_cast": landed_embeddings,
    "staging_nested_fields": landed_nested,
    "landing_documents": landed_documents,
    "landing_rejected": rejected_documents,
    "transfer_outcomes": transfer_outcomes,
    "failed_run_report": failed_run_report,
    "repeated_run": repeated_run,
    "refused_run": refused_run,
    "canonical_json_events": json_events,
    "not_null_assertion": null_checks,
    "lossy_cast_audit": lambda spark, sf: lossy_casts(table(spark, sf, "lineitem"), LOSSY_PLAN),
    "row_cap": capped_orders,
    "run_steps": run_steps,
    "reconcile_published_customer": lambda spark, sf: validate(
        customer_source(spark, sf), published_customer(spark, sf), CUSTOMER_PLAN
    ),
    "full_run_report": run_report,
    "stream_load_rows": stream_rows,
    "stream_load_counts": stream_counts,
}

_DOCUMENT = """concat('{"a":[1,{"b":"', event_type, '","y":null}],"props":', replace(props, ' ', ''), ',"z":',
    event_id, '}')"""

ORACLES = {
    "stage_customer_roundtrip": CUSTOMER_SOURCE_SQL,
    "publish_insert_select": f"SELECT *, 'migration' AS origin FROM ({CUSTOMER_TARGET_SQL}) AS t",
    "load_evidence_lineitem": """
        SELECT count(*) AS rows_read, count(*) AS rows_written, true AS complete FROM lineitem
    """,
    "staging_types_cast": """
        SELECT vec_id, label, CAST(unnest(range(len(embedding))) AS INTEGER) AS position, unnest(embedding) AS value
        FROM embeddings
    """,
    "staging_nested_fields": """
        SELECT l_orderkey, l_linenumber,
               concat('{"flag":', CASE WHEN l_returnflag = 'N' THEN 'null' ELSE concat('"', l_returnflag, '"') END, ',"number":',
                      l_orderkey + 1, right(concat('000000000000000000000', l_linenumber), 21), '}') AS item
        FROM lineitem
    """,
    "landing_documents": f"""
        SELECT event_id, CASE WHEN event_id % 10 <> 9 THEN
                   concat('{{"a":[1e400,-0.0,{{"k":"', event_type, '","z":', event_id,
                          '}}],"b":12345678901234567890123456789012345678901234567890.50}}') END AS document,
               concat('{{"value":', event_id / 2, '}}') AS reading
        FROM events WHERE event_id % 10 NOT IN (3, 5, 7) AND event_id % 11 <> 4
    """,
    "landing_rejected": f"""
        SELECT 'document' AS column_name, 'UNREADABLE_JSON' AS code, document AS raw_text, count(*) AS values
        FROM ({_DOCUMENTS_SQL}) AS d WHERE event_id % 10 IN (3, 5, 7) GROUP BY ALL
        UNION ALL SELECT 'reading', 'NOT_FINITE', '{{"value":"NaN"}}', count(*) FROM events WHERE event_id % 11 = 4
    """,
    "transfer_outcomes": """
        SELECT attempt, disposition, reason, CASE WHEN attempt = 'permitted' THEN n WHEN attempt = 'set aside' THEN n - b END AS rows_written,
               CASE WHEN attempt = 'permitted' THEN 0 WHEN attempt = 'set aside' THEN b END AS rows_rejected
        FROM (VALUES ('permitted', 'SUCCEEDED', NULL), ('read only', 'REFUSED', 'TRANSPORT_NOT_PERMITTED'),
                     ('hole', 'CONFIRMED_FAILED_CLEANED_UP', 'NULL_IN_REQUIRED_COLUMN'),
                     ('unreadable', 'CONFIRMED_FAILED_CLEANED_UP', 'UNREADABLE_VALUES'), ('set aside', 'SUCCEEDED', NULL),
                     ('taken', 'STAGING_EXISTS', 'STAGING_EXISTS'),
                     ('unreported', 'CONFIRMED_FAILED_CLEANED_UP', 'PROGRESS_REPORTING_FAILED')) AS a(attempt, disposition, reason),
             (SELECT count(*) AS n, count(*) FILTER (WHERE c_custkey % 7 = 0) AS b FROM customer) AS c
    """,
    "failed_run_report": """
        SELECT CAST(0 AS BIGINT) AS matched_count, CAST(0 AS BIGINT) AS mismatched_count, CAST(11 AS BIGINT) AS unavailable_count,
               'FAILED' AS status, 1 AS plan_version
    """,
    "repeated_run": """
        SELECT step, stage, 'SUCCEEDED' AS status, CASE WHEN stage <> 'CLEANING_UP' THEN n END AS rows, n AS target_rows
        FROM (VALUES (1, 'STAGING'), (2, 'EXECUTING'), (3, 'CLEANING_UP')) AS s(step, stage),
             (SELECT count(*) AS n FROM customer) AS c
    """,
    "refused_run": """
        SELECT step, stage, CASE WHEN stage = 'EXECUTING' THEN 'FAILED' ELSE 'SUCCEEDED' END AS status,
               CASE WHEN stage = 'STAGING' THEN n END AS rows, CAST(0 AS BIGINT) AS target_rows
        FROM (VALUES (1, 'STAGING'), (2, 'EXECUTING'), (3, 'CLEANING_UP')) AS s(step, stage),
             (SELECT count(*) AS n FROM customer) AS c
    """,
    "canonical_json_events": f"""
        SELECT event_id, document, sha256(document) AS document_sha256,
               sha256(concat('{{"command_type":"LOAD_EVENT","request":', document, '}}')) AS request_sha256
        FROM (SELECT event_id, {_DOCUMENT} AS document FROM events) AS d
    """,
    "not_null_assertion": """
        SELECT 'o_orderkey' AS column_name, count(*) FILTER (WHERE o_orderkey IS NULL) AS null_rows FROM orders
        UNION ALL SELECT 'o_custkey', count(*) FILTER (WHERE o_custkey IS NULL) FROM orders
        UNION ALL SELECT 'o_orderstatus', count(*) FILTER (WHERE nullif(o_orderstatus, 'P') IS NULL) FROM orders
    """,
    "lossy_cast_audit": """
        SELECT 'quantity' AS column_name, count(*) FILTER (WHERE trunc(l_quantity) <> l_quantity) AS lossy_rows
        FROM lineitem
        UNION ALL SELECT 'price', count(*) FILTER (WHERE trunc(l_extendedprice) <> l_extendedprice) FROM lineitem
        UNION ALL SELECT 'part', count(*) FILTER (WHERE l_partkey NOT BETWEEN -128 AND 127) FROM lineitem
        UNION ALL SELECT 'shipped', count(*) FILTER (WHERE date_trunc('day', l_shipdate) <> l_shipdate) FROM lineitem
        UNION ALL SELECT 'order_text', 0 FROM (SELECT 1) AS one
    """,
    "row_cap": """
        SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' ORDER BY o_orderkey LIMIT 500
    """,
    "run_steps": """
        SELECT step, stage, 'SUCCEEDED' AS status, CASE WHEN stage <> 'CLEANING_UP' THEN n END AS rows,
               1 AS plan_version
        FROM (VALUES (1, 'STAGING'), (2, 'EXECUTING'), (3, 'CLEANING_UP')) AS s(step, stage),
             (SELECT count(*) AS n FROM customer) AS c
    """,
    "reconcile_published_customer": VALIDATION_ORACLES["reconcile_customer"],
    "full_run_report": report_sql(VALIDATION_ORACLES["reconcile_customer"]),
    "stream_load_rows": "SELECT CAST(event_id AS DECIMAL(20, 0)) AS event_key, event_type AS kind FROM events",
    "stream_load_counts": "SELECT count(*) AS rows_read, count(*) AS rows_written, CAST(4 AS BIGINT) AS batches, 3 AS last_batch FROM events",
}

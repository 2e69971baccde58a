"""Transform, metrics and reconciliation queries."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablelift.operators.metrics import source_metrics, target_metrics
from tablelift.operators.projection import null_out, preview, project, with_unique_names
from tablelift.operators.reconcile import report, validate
from tablelift.plans.expressions import Expr, cast, coalesce, concat, literal, source_column
from tablelift.plans.plan import Approval, Plan
from tablelift.queries.data import (
    CUSTOMER_PLAN,
    CUSTOMER_SOURCE_SQL,
    CUSTOMER_TARGET_SQL,
    copy_plan,
    customer_source,
    metric_sql,
    reconcile_sql,
    report_sql,
    table,
)

CUSTOMER_COLUMNS = ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"]
CUSTOMER_TARGETS = ["customer_key", "label", "c_nationkey", "balance", "segment"]
CUSTOMER_VALUES = [
    "CAST(c_custkey AS DECIMAL(38, 0))",
    "concat_ws(' ', c_name, c_mktsegment)",
    "c_nationkey",
    "CAST(c_acctbal AS DECIMAL(18, 2))",
    "coalesce(c_mktsegment, 'UNKNOWN')",
]


def customer_target(spark, sf_dir):
    return project(customer_source(spark, sf_dir), CUSTOMER_PLAN)


def _one_column_plan(source: str, target: str, data_type: T.DataType, expr: Expr, *others: str) -> Plan:
    first = Approval(source, "APPROVED", target, data_type, 1, compatibility="EXACT", transformation=expr)
    return Plan("source", "target", (first, *[Approval(name) for name in others]))


def null_concat(spark, sf_dir, null_mode):
    plan = _one_column_plan(
        "c_name", "label", T.StringType(), concat("c_name", "c_mktsegment"), "c_mktsegment", "c_custkey"
    )
    return project(customer_source(spark, sf_dir), plan, null_mode=null_mode)


def nested_coalesce(spark, sf_dir):
    """Order status, else a nested fall-back chain ending in a literal."""
    source = null_out(null_out(table(spark, sf_dir, "orders"), "o_orderstatus", "P"), "o_orderpriority", "5-LOW")
    expr = coalesce("o_orderstatus", coalesce(source_column("o_orderpriority"), literal("NONE")))
    key = Approval(
        "o_orderkey", "APPROVED", "order_key", T.LongType(), 1,
        compatibility="EXACT", transformation=source_column("o_orderkey"),
    )
    plan = Plan(
        "orders",
        "order_state",
        (
            key,
            Approval(
                "o_orderstatus", "APPROVED", "state", T.StringType(), None,
                compatibility="EXACT", transformation=expr,
            ),
            Approval("o_orderpriority"),
        ),
    )
    return project(source, plan)


TYPED_EVENT_PLAN = Plan(
    "events",
    "event_facts",
    (
        Approval(
            "event_id", "APPROVED", "event_key", T.DecimalType(20, 0), 1,
            compatibility="SAFE", transformation=cast("event_id", "DECIMAL"),
        ),
        Approval(
            "ts", "OVERRIDDEN", "event_day", T.DateType(), 2, compatibility="INCOMPATIBLE",
            transformation=cast("ts", "DATE"), override_reason="Only the day is kept.",
        ),
        Approval(
            "user_id", "OVERRIDDEN", "user_text", T.StringType(), 3, compatibility="INCOMPATIBLE",
            transformation=cast("user_id", "STRING"), override_reason="Text key downstream.",
        ),
        Approval(
            "value", "OVERRIDDEN", "amount", T.DecimalType(18, 2), 4, compatibility="INCOMPATIBLE",
            transformation=cast("value", "DECIMAL"), override_reason="Cents.",
        ),
        Approval(
            "event_type", "APPROVED", "origin", T.StringType(), 5,
            compatibility="EXACT", transformation=literal("events"),
        ),
        Approval("props", "REJECTED"),
    ),
)


def lossy_orders(spark, sf_dir):
    """Orders, and a target that lost every hundredth order."""
    orders = table(spark, sf_dir, "orders")
    return orders, orders.filter(F.col("o_orderkey") % 100 != 0)


def reconcile_row_loss(spark, sf_dir):
    source, target = lossy_orders(spark, sf_dir)
    return validate(source, target, copy_plan(source, "orders", "orders_copy"))


def reconcile_null_injection(spark, sf_dir):
    source = table(spark, sf_dir, "orders")
    return validate(source, null_out(source, "o_orderstatus", "P"), copy_plan(source, "orders", "orders_copy"))


def reconcile_lineitem(spark, sf_dir):
    source = table(spark, sf_dir, "lineitem")
    return validate(source, source, copy_plan(source, "lineitem", "lineitem_copy"))


def reconcile_empty(spark, sf_dir):
    """A source whose rows are all filtered out: null counts are unavailable, not zero."""
    source = customer_source(spark, sf_dir).filter(F.col("c_custkey") < 0)
    return validate(source, project(source, CUSTOMER_PLAN), CUSTOMER_PLAN)


def report_statuses(spark, sf_dir):
    """Reports of a faithful copy, a copy with lost rows and an empty table."""
    customers = customer_source(spark, sf_dir)
    runs = {
        "copy": validate(customers, project(customers, CUSTOMER_PLAN), CUSTOMER_PLAN),
        "row_loss": reconcile_row_loss(spark, sf_dir),
        "empty": reconcile_empty(spark, sf_dir),
    }
    stacked = None
    for name, checked in runs.items():
        labelled = checked.withColumn("run", F.lit(name))
        stacked = labelled if stacked is None else stacked.unionByName(labelled)
    return report(stacked, plan_version=1, by=("run",))


def distinct_profile(spark, sf_dir):
    """Estimated distinct counts of all event columns, and whether they lie within four standard errors of the exact ones."""
    events = table(spark, sf_dir, "events")
    plan = copy_plan(events, "events", "events")
    guessed = target_metrics(events, plan, mode="approx").withColumnRenamed("value", "guess")
    within = F.abs(F.col("guess") - F.col("value")) <= 4 * 0.05 * F.col("value")
    return target_metrics(events, plan).join(guessed, "check_id").select("check_id", "value", within.alias("within"))


def duplicate_names(spark, sf_dir):
    """A join result with repeated column names, renamed so that every column can be addressed."""
    orders = table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("id"), F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("name")
    )
    return with_unique_names(orders)


def source_of(sf_name):
    return lambda spark, sf_dir: table(spark, sf_dir, sf_name)


_ORDERS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]
_LINEITEM = [
    "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
    "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate",
]

QUERIES = {
    "transform_customer": customer_target,
    "transform_null_concat": lambda spark, sf: null_concat(spark, sf, "propagate"),
    "transform_null_concat_skip": lambda spark, sf: null_concat(spark, sf, "skip"),
    "transform_nested_coalesce": nested_coalesce,
    "transform_event_casts": lambda spark, sf: project(table(spark, sf, "events"), TYPED_EVENT_PLAN),
    "transform_preview": lambda spark, sf: preview(
        customer_source(spark, sf).orderBy("c_custkey"), CUSTOMER_PLAN, 25
    ),
    "duplicate_result_names": duplicate_names,
    "metrics_source_customer": lambda spark, sf: source_metrics(customer_source(spark, sf), CUSTOMER_PLAN),
    "metrics_target_customer": lambda spark, sf: target_metrics(customer_target(spark, sf), CUSTOMER_PLAN),
    "reconcile_customer": lambda spark, sf: validate(
        customer_source(spark, sf), customer_target(spark, sf), CUSTOMER_PLAN
    ),
    "validation_report_customer": lambda spark, sf: report(
        validate(customer_source(spark, sf), customer_target(spark, sf), CUSTOMER_PLAN), plan_version=1
    ),
    "reconcile_orders_row_loss": reconcile_row_loss,
    "reconcile_orders_null_injection": reconcile_null_injection,
    "reconcile_lineitem_all": reconcile_lineitem,
    "reconcile_empty_incomplete": reconcile_empty,
    "report_statuses": report_statuses,
    "distinct_profile_events": distinct_profile,
}

_EVENTS = ["event_id", "ts", "user_id", "event_type", "value", "props"]
_PROFILE = " UNION ALL ".join(
    ["SELECT 'row_count' AS check_id, count(*) AS value, true AS within FROM events"]
    + [f"SELECT 'm{n:03d}_null_count', count(*) - count({name}), true FROM events" for n, name in enumerate(_EVENTS)]
    + [f"SELECT 'm{n:03d}_distinct_count', count(DISTINCT {name}), true FROM events" for n, name in enumerate(_EVENTS)]
)

_CUSTOMER_RECONCILED = reconcile_sql(
    CUSTOMER_SOURCE_SQL, CUSTOMER_TARGET_SQL, CUSTOMER_VALUES, CUSTOMER_COLUMNS, CUSTOMER_TARGETS
)
_ROW_LOSS = reconcile_sql(
    "SELECT * FROM orders", "SELECT * FROM orders WHERE o_orderkey % 100 <> 0", _ORDERS, _ORDERS, _ORDERS
)
_EMPTY_SOURCE = f"SELECT * FROM ({CUSTOMER_SOURCE_SQL}) AS c WHERE c_custkey < 0"
_EMPTY_TARGET = CUSTOMER_TARGET_SQL.replace("AS src", "AS src WHERE c_custkey < 0")
_EMPTY = reconcile_sql(_EMPTY_SOURCE, _EMPTY_TARGET, CUSTOMER_VALUES, CUSTOMER_COLUMNS, CUSTOMER_TARGETS)

ORACLES = {
    "distinct_profile_events": _PROFILE,
    "transform_customer": CUSTOMER_TARGET_SQL,
    "transform_null_concat": f"SELECT c_name || c_mktsegment AS label FROM ({CUSTOMER_SOURCE_SQL}) AS src",
    "transform_null_concat_skip": f"SELECT concat(c_name, c_mktsegment) AS label FROM ({CUSTOMER_SOURCE_SQL}) AS src",
    "transform_nested_coalesce": """
        SELECT o_orderkey AS order_key,
               coalesce(nullif(o_orderstatus, 'P'), nullif(o_orderpriority, '5-LOW'), 'NONE') AS state
        FROM orders
    """,
    "transform_event_casts": """
        SELECT CAST(event_id AS DECIMAL(20, 0)) AS event_key, CAST(ts AS DATE) AS event_day,
               CAST(user_id AS VARCHAR) AS user_text, CAST(value AS DECIMAL(18, 2)) AS amount, 'events' AS origin
        FROM events
    """,
    "transform_preview": CUSTOMER_TARGET_SQL + " ORDER BY c_custkey LIMIT 25",
    "duplicate_result_names": "SELECT o_custkey AS id, o_orderkey AS id_2, o_orderstatus AS name FROM orders",
    "metrics_source_customer": f"WITH src AS ({CUSTOMER_SOURCE_SQL}) {metric_sql('src', CUSTOMER_VALUES)}",
    "metrics_target_customer": f"WITH tgt AS ({CUSTOMER_TARGET_SQL}) {metric_sql('tgt', CUSTOMER_TARGETS)}",
    "reconcile_customer": _CUSTOMER_RECONCILED,
    "validation_report_customer": report_sql(_CUSTOMER_RECONCILED),
    "reconcile_orders_row_loss": _ROW_LOSS,
    "reconcile_orders_null_injection": reconcile_sql(
        "SELECT * FROM orders",
        "SELECT * REPLACE (nullif(o_orderstatus, 'P') AS o_orderstatus) FROM orders",
        _ORDERS, _ORDERS, _ORDERS,
    ),
    "reconcile_lineitem_all": reconcile_sql(
        "SELECT * FROM lineitem", "SELECT * FROM lineitem", _LINEITEM, _LINEITEM, _LINEITEM
    ),
    "reconcile_empty_incomplete": _EMPTY,
    "report_statuses": " UNION ALL ".join(
        f"SELECT '{run}' AS run, r.* FROM ({report_sql(checked)}) AS r"
        for run, checked in (("copy", _CUSTOMER_RECONCILED), ("row_loss", _ROW_LOSS), ("empty", _EMPTY))
    ),
}

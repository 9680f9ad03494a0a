"""Queries for the quality and anomaly report (§2.4)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import quality as Q
from .base import (CUSTOMER_NULLS_SQL, EVENTS_DUP_SQL, ORDERS_SPARSE_SQL, customer_with_nulls, events_dup,
                   orders_sparse, register, rnd, t)
from .profiling import CUST_TYPES, ORD_TYPES, _column_info_sql
from .sqlgen import r

EV_COLS = ["event_id", "ts", "user_id", "event_type", "value", "props"]
EV_CONST_SQL = f"(SELECT *, 'same' AS const_col FROM {EVENTS_DUP_SQL})"
EV_CONST_TYPES = dict(event_id="bigint", ts="timestamp_ntz", user_id="bigint", event_type="string",
                      value="double", props="string", const_col="string")


def events_const(spark, sf):
    return events_dup(spark, sf).withColumn("const_col", F.lit("same"))


def _missing_cells_sql(cols, src):
    return f"(SELECT {' + '.join(f'(count(*) - count({c}))' for c in cols)} FROM {src})"


def _score_sql(cols, src):
    n = f"(SELECT count(*) FROM {src})"
    d = f"({n} - (SELECT count(*) FROM (SELECT DISTINCT * FROM {src})))"
    m = _missing_cells_sql(cols, src)
    return (f"CASE WHEN {n} > 0 THEN greatest(0.0, least(100.0, 100 - 50 * CAST({m} AS DOUBLE) / ({n} * {len(cols)})"
            f" - 30 * CAST({d} AS DOUBLE) / {n})) END")


@register("quality_score", f"SELECT {r(_score_sql(EV_COLS, EVENTS_DUP_SQL))} AS quality_score")
def q_quality_score(spark, sf):
    return rnd(Q.quality_score(events_dup(spark, sf)))


@register("quality_profile", f"""
SELECT count(*) AS total_rows, 6 AS total_columns, {_missing_cells_sql(list(ORD_TYPES), ORDERS_SPARSE_SQL)} AS missing_values,
  3 AS numeric_columns, 2 AS categorical_columns, {r(_score_sql(list(ORD_TYPES), ORDERS_SPARSE_SQL))} AS quality_score
FROM {ORDERS_SPARSE_SQL}""")
def q_quality_profile(spark, sf):
    return rnd(Q.quality_profile(orders_sparse(spark, sf)))


_HM = f"""SELECT 'High Missing Values in ' || "column" AS anomaly_type, "column",
  'Column ' || "column" || ' has ' || CAST(round(missing_pct, 1) AS VARCHAR) || '% missing values' AS description,
  95 AS confidence, {r('missing_pct')} AS metric
FROM ({{info}}) WHERE missing_pct > 50"""


@register("anomaly_high_missing", _HM.format(info=_column_info_sql(list(ORD_TYPES), ORD_TYPES, ORDERS_SPARSE_SQL)))
def q_anomaly_high_missing(spark, sf):
    return rnd(Q.anomaly_high_missing(orders_sparse(spark, sf)))


def _dup_sql(src):
    return f"""SELECT 'Duplicate Rows Detected' AS anomaly_type, NULL::VARCHAR AS "column",
  'Found ' || CAST(d AS VARCHAR) || ' duplicate rows (' || CAST(round(d * 100.0 / n, 1) AS VARCHAR) || '% of dataset)'
  AS description, 100 AS confidence, CAST(d AS DOUBLE) AS metric
FROM (SELECT (SELECT count(*) FROM {src}) AS n,
  (SELECT count(*) FROM {src}) - (SELECT count(*) FROM (SELECT DISTINCT * FROM {src})) AS d) WHERE d > 0"""


@register("anomaly_duplicates", _dup_sql(EVENTS_DUP_SQL))
def q_anomaly_duplicates(spark, sf):
    return rnd(Q.anomaly_duplicates(events_dup(spark, sf)))


def _outlier_sql(cols, src):
    parts = []
    for c in cols:
        parts.append(f"""SELECT '{c}' AS "column", (SELECT count(*) FROM {src} x WHERE x.{c} < b.lb OR x.{c} > b.ub) AS oc,
  (SELECT count(*) FROM {src}) AS n
FROM (SELECT quantile_cont({c}, 0.25) - 1.5 * (quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25)) AS lb,
             quantile_cont({c}, 0.75) + 1.5 * (quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25)) AS ub FROM {src}) b""")
    body = " UNION ALL ".join(parts)
    return f"""SELECT 'Statistical Outliers in ' || "column" AS anomaly_type, "column",
  'Column ' || "column" || ' contains ' || CAST(oc AS VARCHAR) || ' potential outliers' AS description,
  80 AS confidence, CAST(oc AS DOUBLE) AS metric FROM ({body}) WHERE oc * 100.0 / n > 5.0"""


LI_NUM = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount",
          "l_tax"]


@register("anomaly_outliers", _outlier_sql(["event_id", "user_id", "value"], "events"))
def q_anomaly_outliers(spark, sf):
    return rnd(Q.anomaly_outliers(t(spark, sf, "events")))


def _const_sql(info):
    return f"""SELECT 'Constant Column: ' || "column" AS anomaly_type, "column",
  'Column ' || "column" || ' has only one unique value' AS description, 100 AS confidence,
  CAST(unique_count AS DOUBLE) AS metric FROM ({info}) WHERE unique_count = 1"""


@register("anomaly_constant", _const_sql(_column_info_sql(list(EV_CONST_TYPES), EV_CONST_TYPES, EV_CONST_SQL)))
def q_anomaly_constant(spark, sf):
    return rnd(Q.anomaly_constant(events_const(spark, sf)))


def _report_sql():
    info = _column_info_sql(list(EV_CONST_TYPES), EV_CONST_TYPES, EV_CONST_SQL)
    return "\nUNION ALL\n".join([
        _HM.format(info=info), _dup_sql(EV_CONST_SQL),
        _outlier_sql(["event_id", "user_id", "value"], EV_CONST_SQL), _const_sql(info)])


@register("anomaly_report", _report_sql())
def q_anomaly_report(spark, sf):
    return rnd(Q.anomaly_report(events_const(spark, sf)))


@register("column_recommendation", f"""
SELECT i."column", type, family, unique_count, {r('m.mn')} AS min, {r('m.mx')} AS max,
  CASE WHEN family = 'numeric' AND missing_pct < 5 THEN '{Q.RECOMMEND['numeric_good']}'
       WHEN family = 'numeric' AND missing_pct < 20 THEN '{Q.RECOMMEND['numeric_some']}'
       WHEN family = 'numeric' THEN '{Q.RECOMMEND['numeric_high']}'
       WHEN family = 'text' AND unique_count * 1.0 / rows > 0.8 THEN '{Q.RECOMMEND['text_high']}'
       WHEN family = 'text' AND unique_count < 10 THEN '{Q.RECOMMEND['text_low']}'
       WHEN family = 'text' THEN '{Q.RECOMMEND['text_medium']}'
       ELSE '{Q.RECOMMEND['other']}' END AS recommendation
FROM ({_column_info_sql(list(CUST_TYPES), CUST_TYPES, CUSTOMER_NULLS_SQL)}) i LEFT JOIN (
  SELECT 'c_custkey' AS "column", min(c_custkey) AS mn, max(c_custkey) AS mx FROM {CUSTOMER_NULLS_SQL}
  UNION ALL SELECT 'c_nationkey', min(c_nationkey), max(c_nationkey) FROM {CUSTOMER_NULLS_SQL}
  UNION ALL SELECT 'c_acctbal', min(c_acctbal), max(c_acctbal) FROM {CUSTOMER_NULLS_SQL}) m ON m."column" = i."column" """)
def q_column_recommendation(spark, sf):
    return rnd(Q.column_recommendation(customer_with_nulls(spark, sf)))

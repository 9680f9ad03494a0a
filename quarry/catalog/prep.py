"""Queries for exploration and preparation (§2.5)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import prep as R
from .base import (CUSTOMER_NULLS_SQL, EVENTS_DUP_SQL, EVENTS_NULLS_SQL, ORDERS_SPARSE_SQL, customer_with_nulls,
                   events_dup, events_with_nulls, orders_sparse, register, rnd, t)
from .profiling import ORD_TYPES, _column_info_sql
from .sqlgen import r, r_sig


@register("impute_median", f"""
SELECT event_id, {r('coalesce(value, (SELECT quantile_cont(value, 0.5) FROM ' + EVENTS_NULLS_SQL + '))')} AS value,
  event_type FROM {EVENTS_NULLS_SQL}""")
def q_impute_median(spark, sf):
    out = R.impute_median(events_with_nulls(spark, sf), ["value"])
    return rnd(out.select("event_id", "value", "event_type"))


_MODE_SQL = f"""(SELECT c_mktsegment FROM {CUSTOMER_NULLS_SQL} WHERE c_mktsegment IS NOT NULL
   GROUP BY c_mktsegment ORDER BY count(*) DESC, c_mktsegment LIMIT 1)"""


@register("impute_mode", f"""
SELECT c_custkey, coalesce(c_mktsegment, {_MODE_SQL}, 'Unknown') AS c_mktsegment FROM {CUSTOMER_NULLS_SQL}""")
def q_impute_mode(spark, sf):
    return R.impute_mode(customer_with_nulls(spark, sf), ["c_mktsegment"]).select("c_custkey", "c_mktsegment")


@register("impute_constant", f"""
SELECT c_custkey, coalesce(c_mktsegment, 'Unknown') AS c_mktsegment, c_name FROM {CUSTOMER_NULLS_SQL}""")
def q_impute_constant(spark, sf):
    return R.impute_constant(customer_with_nulls(spark, sf)).select("c_custkey", "c_mktsegment", "c_name")


@register("standardize_text", r"""
SELECT conv_id, turn, lower(regexp_replace(role, '^\s+|\s+$', '', 'g')) AS role,
  lower(regexp_replace(text, '^\s+|\s+$', '', 'g')) AS text FROM conversations""")
def q_standardize_text(spark, sf):
    return R.standardize_text(t(spark, sf, "conversations"))


@register("drop_duplicates", f"""
SELECT DISTINCT event_id, ts, user_id, event_type, round(value, 6) AS value, props FROM {EVENTS_DUP_SQL}""")
def q_drop_duplicates(spark, sf):
    return rnd(R.drop_duplicates(events_dup(spark, sf)))


_CLEAN_SRC = f"(SELECT * FROM {CUSTOMER_NULLS_SQL} UNION ALL SELECT * FROM {CUSTOMER_NULLS_SQL} WHERE c_custkey % 10 = 1)"


def customer_dup_nulls(spark, sf):
    c = customer_with_nulls(spark, sf)
    return c.unionByName(c.where(F.col("c_custkey") % 10 == 1))


@register("clean_table", rf"""
SELECT DISTINCT c_custkey, lower(regexp_replace(c_name, '^\s+|\s+$', '', 'g')) AS c_name,
  c_nationkey, round(c_acctbal, 6) AS c_acctbal,
  lower(regexp_replace(coalesce(c_mktsegment, (SELECT c_mktsegment FROM {_CLEAN_SRC} WHERE c_mktsegment IS NOT NULL
     GROUP BY c_mktsegment ORDER BY count(*) DESC, c_mktsegment LIMIT 1)), '^\s+|\s+$', '', 'g')) AS c_mktsegment
FROM {_CLEAN_SRC}""")
def q_clean_table(spark, sf):
    cleaned, _ = R.clean_table(customer_dup_nulls(spark, sf))
    return rnd(cleaned)


@register("clean_log", f"""
SELECT 'fill_mode' AS action, 'c_mktsegment' AS "column", count(*) - count(c_mktsegment) AS count,
  (SELECT c_mktsegment FROM {_CLEAN_SRC} WHERE c_mktsegment IS NOT NULL GROUP BY c_mktsegment
   ORDER BY count(*) DESC, c_mktsegment LIMIT 1) AS value FROM {_CLEAN_SRC}
UNION ALL SELECT 'standardize_text', 'c_name', NULL, NULL
UNION ALL SELECT 'standardize_text', 'c_mktsegment', NULL, NULL
UNION ALL SELECT 'drop_duplicates', NULL, (SELECT count(*) FROM {_CLEAN_SRC}) - (SELECT count(*) FROM (SELECT DISTINCT * FROM {_CLEAN_SRC})), NULL""")
def q_clean_log(spark, sf):
    _, log = R.clean_table(customer_dup_nulls(spark, sf))
    return log


def _iqr_sql(cols, src):
    parts = []
    for c in cols:
        parts.append(f"""SELECT '{c}' AS "column", q1, q3, q3 - q1 AS iqr, q1 - 1.5 * (q3 - q1) AS lb, q3 + 1.5 * (q3 - q1) AS ub,
  (SELECT count(*) FROM {src} x WHERE x.{c} < q1 - 1.5 * (q3 - q1) OR x.{c} > q3 + 1.5 * (q3 - q1)) AS outlier_count,
  (SELECT count(*) FROM {src}) AS n
FROM (SELECT quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.75) AS q3 FROM {src})""")
    return f"""SELECT "column", {r('q1')} AS q1, {r('q3')} AS q3, {r('iqr')} AS iqr, {r('lb')} AS lower_bound,
  {r('ub')} AS upper_bound, outlier_count, {r('outlier_count * 100.0 / n')} AS outlier_pct
FROM ({' UNION ALL '.join(parts)})"""


LI_NUM = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@register("outliers_iqr", _iqr_sql(["value", "user_id", "event_id"], EVENTS_NULLS_SQL))
def q_outliers_iqr(spark, sf):
    return rnd(R.outliers_iqr(events_with_nulls(spark, sf), ["event_id", "user_id", "value"]))


@register("outlier_rows", f"""
SELECT event_id, round(value, 6) AS value FROM events, (SELECT quantile_cont(value, 0.25) AS q1,
  quantile_cont(value, 0.75) AS q3 FROM events) b WHERE value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1)""")
def q_outlier_rows(spark, sf):
    return rnd(R.outlier_rows(t(spark, sf, "events"), "value").select("event_id", "value"))


def _box_sql(cols, src):
    parts = []
    for c in cols:
        parts.append(f"""SELECT '{c}' AS "column", {r('q1')} AS q1, {r('med')} AS median, {r('q3')} AS q3,
  {r(f'(SELECT min({c}) FROM {src} x WHERE x.{c} >= q1 - 1.5 * (q3 - q1) AND x.{c} <= q3 + 1.5 * (q3 - q1))')} AS whisker_low,
  {r(f'(SELECT max({c}) FROM {src} x WHERE x.{c} >= q1 - 1.5 * (q3 - q1) AND x.{c} <= q3 + 1.5 * (q3 - q1))')} AS whisker_high,
  (SELECT count(*) FROM {src} x WHERE x.{c} < q1 - 1.5 * (q3 - q1) OR x.{c} > q3 + 1.5 * (q3 - q1)) AS fliers
FROM (SELECT quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.5) AS med, quantile_cont({c}, 0.75) AS q3 FROM {src})""")
    return " UNION ALL ".join(parts)


@register("boxplot_stats", _box_sql(["value"], EVENTS_NULLS_SQL))
def q_boxplot_stats(spark, sf):
    return rnd(R.boxplot_stats(events_with_nulls(spark, sf), ["value"]))


@register("missing_report", f"""
SELECT "column", missing AS missing_count, missing_pct, type AS data_type FROM (
{_column_info_sql(list(ORD_TYPES), ORD_TYPES, ORDERS_SPARSE_SQL)})""")
def q_missing_report(spark, sf):
    return rnd(R.missing_report(orders_sparse(spark, sf)))


EV_PATTERN_SQL = f"(SELECT event_id, CASE WHEN event_id % 5 = 0 THEN NULL ELSE event_type END AS event_type, value FROM {EVENTS_NULLS_SQL})"


def events_pattern(spark, sf):
    e = events_with_nulls(spark, sf)
    return e.select("event_id", F.when(F.col("event_id") % 5 == 0, None).otherwise(F.col("event_type")).alias("event_type"),
                    "value")


@register("missing_pattern", f"""
SELECT (CASE WHEN event_id IS NULL THEN '1' ELSE '0' END) || (CASE WHEN event_type IS NULL THEN '1' ELSE '0' END)
  || (CASE WHEN value IS NULL THEN '1' ELSE '0' END) AS pattern,
  concat_ws(',', CASE WHEN event_id IS NULL THEN 'event_id' END, CASE WHEN event_type IS NULL THEN 'event_type' END,
    CASE WHEN value IS NULL THEN 'value' END) AS missing_columns, count(*) AS rows
FROM {EV_PATTERN_SQL} GROUP BY 1, 2""")
def q_missing_pattern(spark, sf):
    return R.missing_pattern(events_pattern(spark, sf))


@register("variance_importance", f"""
SELECT feature, {r_sig('v')} AS importance_score, {r('CASE WHEN mx <> 0 THEN v / mx ELSE 0.0 END')} AS normalized_score,
  CAST(row_number() OVER (ORDER BY v DESC NULLS LAST, feature) AS INTEGER) AS rank FROM (
  SELECT 'l_quantity' AS feature, var_samp(l_quantity) AS v, max(l_quantity) AS mx FROM lineitem
  UNION ALL SELECT 'l_extendedprice', var_samp(l_extendedprice), max(l_extendedprice) FROM lineitem
  UNION ALL SELECT 'l_discount', var_samp(l_discount), max(l_discount) FROM lineitem
  UNION ALL SELECT 'l_tax', var_samp(l_tax), max(l_tax) FROM lineitem)""")
def q_variance_importance(spark, sf):
    return rnd(R.variance_importance(t(spark, sf, "lineitem"), LI_NUM), sig=("importance_score",))


@register("transform_log", """
SELECT event_id, round(value, 6) AS value, user_id, round(CASE WHEN value > -1 THEN ln(1 + value) END, 6) AS value_log
FROM events""")
def q_transform_log(spark, sf):
    e = t(spark, sf, "events").select("event_id", "value", "user_id")
    return rnd(R.transform_log(e, ["value", "user_id"]))


@register("transform_standardize", f"""
SELECT event_id, round(value, 6) AS value,
  {r('(value - (SELECT avg(value) FROM events)) / (SELECT stddev_samp(value) FROM events)')} AS value_standardized
FROM events""")
def q_transform_standardize(spark, sf):
    e = t(spark, sf, "events").select("event_id", "value")
    return rnd(R.transform_standardize(e, ["value"]))


@register("transform_label_encode", """
SELECT p_partkey, p_type, p_brand,
  CAST(dense_rank() OVER (ORDER BY coalesce(p_type, 'missing')) - 1 AS INTEGER) AS p_type_encoded,
  CAST(dense_rank() OVER (ORDER BY coalesce(p_brand, 'missing')) - 1 AS INTEGER) AS p_brand_encoded FROM part""")
def q_transform_label_encode(spark, sf):
    p = t(spark, sf, "part").select("p_partkey", "p_type", "p_brand")
    return R.transform_label_encode(p, ["p_type", "p_brand"])


@register("transform_table", f"""
SELECT p_partkey, round(p_retailprice, 6) AS p_retailprice, p_type,
  {r('(p_partkey - (SELECT avg(p_partkey) FROM part)) / (SELECT stddev_samp(p_partkey) FROM part)')} AS p_partkey_standardized,
  {r('(p_retailprice - (SELECT avg(p_retailprice) FROM part)) / (SELECT stddev_samp(p_retailprice) FROM part)')} AS p_retailprice_standardized,
  CAST(dense_rank() OVER (ORDER BY coalesce(p_type, 'missing')) - 1 AS INTEGER) AS p_type_encoded FROM part""")
def q_transform_table(spark, sf):
    p = t(spark, sf, "part").select("p_partkey", "p_retailprice", "p_type")
    out, _ = R.transform_table(p)
    return rnd(out)


@register("transform_changes", """
SELECT * FROM (VALUES ('standardize', 'p_partkey', 'p_partkey_standardized'),
  ('standardize', 'p_retailprice', 'p_retailprice_standardized'), ('label_encode', 'p_type', 'p_type_encoded'))
  v(action, "column", new_column)""")
def q_transform_changes(spark, sf):
    p = t(spark, sf, "part").select("p_partkey", "p_retailprice", "p_type")
    _, log = R.transform_table(p)
    return log


# ids above 2**53 that differ by one, each twice: as doubles they would be one row
_BIG_SQL = "(SELECT c_custkey + 9007199254740992 AS id, c_mktsegment FROM customer UNION ALL SELECT c_custkey + 9007199254740992, c_mktsegment FROM customer)"


@register("clean_table_bigint", f"SELECT DISTINCT id, lower(c_mktsegment) AS c_mktsegment FROM {_BIG_SQL}")
def q_clean_table_bigint(spark, sf):
    c = t(spark, sf, "customer").select((F.col("c_custkey") + F.lit(9007199254740992)).alias("id"), "c_mktsegment")
    return R.clean_table(c.unionByName(c))[0]

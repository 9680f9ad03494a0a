"""Queries for sources (§2.1), column metadata (§2.2) and profiling (§2.3)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import profile as P
from ..sources import io
from ..session import ensure_checkpoint_dir
from .base import (CUSTOMER_NULLS_SQL, EVENTS_DUP_SQL, EVENTS_NULLS_SQL, ORDERS_SPARSE_SQL, customer_with_nulls,
                   events_dup, events_with_nulls, orders_sparse, register, rnd, t)
from .sqlgen import exact_mean, r, union_per_column

LI_NUM = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
          "l_discount", "l_tax"]
LI_ALL = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount",
          "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]
LI_TYPES = dict(l_orderkey="bigint", l_partkey="bigint", l_suppkey="bigint", l_linenumber="int",
                l_quantity="double", l_extendedprice="double", l_discount="double", l_tax="double",
                l_returnflag="string", l_linestatus="string", l_shipdate="timestamp_ntz")
FAM = dict(bigint="numeric", int="numeric", double="numeric", string="text", timestamp_ntz="datetime")

# ------------------------------------------------------------------ §2.1 sources


@register("read_table", """
SELECT o_orderkey, o_custkey, o_orderstatus, round(o_totalprice, 6) AS o_totalprice, o_orderdate, o_orderpriority
FROM orders""")
def q_read_table(spark, sf):
    return rnd(io.read_table(spark, f"{sf}/orders.parquet", fmt="parquet"))


@register("dataset_overview", """
SELECT count(*) AS rows, 6 AS columns,
  'o_orderkey,o_custkey,o_orderstatus,o_totalprice,o_orderdate,o_orderpriority' AS column_names FROM orders""")
def q_dataset_overview(spark, sf):
    return P.dataset_overview(t(spark, sf, "orders"))


@register("preview", """
SELECT * FROM (SELECT o_orderkey, o_custkey, o_orderstatus, round(o_totalprice, 6) AS o_totalprice, o_orderdate,
  o_orderpriority FROM orders ORDER BY o_orderkey LIMIT 10)""")
def q_preview(spark, sf):
    return rnd(io.preview(t(spark, sf, "orders"), ["o_orderkey"], 10))


@register("write_csv", """
SELECT CAST(l_orderkey AS BIGINT) AS l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber,
  round(l_quantity, 6) AS l_quantity, round(l_extendedprice, 6) AS l_extendedprice, l_returnflag, l_shipdate
FROM lineitem""")
def q_write_csv(spark, sf):
    src = t(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice",
                                           "l_returnflag", "l_shipdate")
    path = io.write_csv(src, f"{ensure_checkpoint_dir(spark)}/csv-{uuid.uuid4().hex}")
    return rnd(io.read_table(spark, path, fmt="csv"))


@register("read_table_csv", """
SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE c_mktsegment END AS segment_name,
  CASE WHEN c_custkey % 5 <> 0 THEN c_custkey % 2 = 0 END AS even, round(c_acctbal, 6) AS acct_bal,
  TIMESTAMP '2024-01-01' + INTERVAL 1 DAY * (c_custkey % 28) AS day FROM customer""")
def q_read_table_csv(spark, sf):
    k = F.col("c_custkey")
    src = t(spark, sf, "customer").select(
        "c_custkey", F.when(k % 3 == 0, "NA").otherwise(F.col("c_mktsegment")).alias("segment.name"),
        F.when(k % 5 == 0, "n/a").when(k % 2 == 0, "True").otherwise("False").alias("even"),
        F.col("c_acctbal").alias("acct.bal"),
        F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), (k % 28).cast("int")), "yyyy-MM-dd").alias("day"))
    path = f"{ensure_checkpoint_dir(spark)}/csv-{uuid.uuid4().hex}"
    src.write.option("header", True).csv(path)  # as another tool would write it: missing tokens, booleans, dates, dots
    return rnd(io.read_table(spark, path, fmt="csv"))


@register("column_info_negzero", """SELECT 'v' AS "column", 1 AS unique_count FROM events HAVING count(*) > 0""")
def q_column_info_negzero(spark, sf):
    e = t(spark, sf, "events").select(F.when(F.col("event_id") % 2 == 0, F.lit(-0.0)).otherwise(F.lit(0.0)).alias("v"))
    return P.column_info(e).select("column", "unique_count")


@register("sample_n", """
SELECT o_orderkey, o_custkey, round(o_totalprice, 6) AS o_totalprice FROM orders
ORDER BY md5(concat('42', CAST(o_orderkey AS VARCHAR))), o_orderkey LIMIT 1000""")
def q_sample_n(spark, sf):
    return rnd(io.sample_n(t(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice"),
                           1000, ["o_orderkey"]))


@register("cap_rows", """
SELECT doc_id, length(text) AS n FROM documents ORDER BY doc_id LIMIT 100""")
def q_cap_rows(spark, sf):
    d = io.cap_rows(t(spark, sf, "documents"), 100, ["doc_id"])
    return d.select("doc_id", F.length("text").alias("n"))


# ------------------------------------------------------------------ §2.2 column metadata

_CI_TEMPLATE = ("SELECT '{c}' AS \"column\", {i} AS position, count(*) - count({c}) AS missing, "
                "count(DISTINCT {c}) AS unique_count, count(*) AS rows FROM {src}")


def _column_info_sql(cols, types, src):
    body = union_per_column(cols, _CI_TEMPLATE, src)
    tcase = " ".join(f"WHEN '{c}' THEN '{types[c]}'" for c in cols)
    fcase = " ".join(f"WHEN '{c}' THEN '{FAM[types[c]]}'" for c in cols)
    return f"""SELECT "column", CAST(position AS INTEGER) AS position, CASE "column" {tcase} END AS type,
  CASE "column" {fcase} END AS family, rows, missing, {r('missing * 100.0 / rows')} AS missing_pct, unique_count
FROM ({body})"""


@register("column_info", _column_info_sql(LI_ALL, LI_TYPES, "lineitem"))
def q_column_info(spark, sf):
    return rnd(P.column_info(t(spark, sf, "lineitem")))


CUST_TYPES = dict(c_custkey="bigint", c_name="string", c_nationkey="int", c_acctbal="double", c_mktsegment="string")
CUST = list(CUST_TYPES)


def _info_sql_cust():
    return _column_info_sql(CUST, CUST_TYPES, CUSTOMER_NULLS_SQL)


@register("column_info_nulls", _info_sql_cust())
def q_column_info_nulls(spark, sf):
    return rnd(P.column_info(customer_with_nulls(spark, sf)))


@register("target_suitability", f"""
SELECT "column", type, unique_count, tt IS NOT NULL AS is_target_suitable, tt AS target_type FROM (
 SELECT *, CASE WHEN family = 'numeric' AND unique_count BETWEEN 2 AND 20 THEN 'classification'
   WHEN family = 'numeric' AND unique_count > 20 THEN 'regression'
   WHEN family = 'text' AND unique_count BETWEEN 2 AND 50 THEN 'classification' END AS tt
 FROM ({_column_info_sql(LI_ALL, LI_TYPES, 'lineitem')}))""")
def q_target_suitability(spark, sf):
    return P.target_suitability(P.column_info(t(spark, sf, "lineitem")))


@register("feature_potential", f"""
SELECT "column", type, missing, {r('missing_pct')} AS missing_pct, unique_count,
 CASE WHEN family = 'numeric' AND unique_count < 5 THEN 'Medium'
      WHEN family = 'numeric' AND missing_pct > 50 THEN 'Low'
      WHEN family = 'text' AND unique_count > rows * 0.8 THEN 'Low' ELSE 'High' END AS fe_potential
FROM ({_info_sql_cust()})""")
def q_feature_potential(spark, sf):
    return rnd(P.feature_potential(P.column_info(customer_with_nulls(spark, sf))))


ORD_TYPES = dict(o_orderkey="bigint", o_custkey="bigint", o_orderstatus="string", o_totalprice="double",
                 o_orderdate="timestamp_ntz", o_orderpriority="string")


@register("column_quality_grade", f"""
SELECT "column", {r('missing_pct')} AS missing_pct,
 CASE WHEN missing_pct > 50 THEN 'Poor' WHEN missing_pct > 20 THEN 'Fair' ELSE 'Good' END AS quality
FROM ({_column_info_sql(list(ORD_TYPES), ORD_TYPES, ORDERS_SPARSE_SQL)})""")
def q_column_quality_grade(spark, sf):
    return rnd(P.column_quality_grade(P.missing_info(orders_sparse(spark, sf))))


def _sample_sql(cols, key, k, src):
    parts = [f"""SELECT '{c}' AS "column", list(v ORDER BY rn) AS sample_values FROM (
  SELECT CAST({c} AS VARCHAR) AS v, row_number() OVER (ORDER BY {key}) AS rn FROM {src} WHERE {c} IS NOT NULL
  QUALIFY rn <= {k})""" for c in cols]
    return "\nUNION ALL\n".join(parts)


@register("sample_values", "SELECT \"column\", array_to_string(sample_values, '|') AS sample_values FROM ("
          + _sample_sql(["c_name", "c_nationkey", "c_mktsegment"], "c_custkey", 3, CUSTOMER_NULLS_SQL) + ")")
def q_sample_values(spark, sf):
    sv = P.sample_values(customer_with_nulls(spark, sf), ["c_custkey"], 3, ["c_name", "c_nationkey", "c_mktsegment"])
    return sv.select("column", F.array_join("sample_values", "|").alias("sample_values"))


@register("text_suitability", """
SELECT "column", round(avg(length(v)), 6) AS avg_length, avg(length(v)) > 10 AS is_text FROM (
  SELECT 'text' AS "column", text AS v, row_number() OVER (ORDER BY conv_id, turn) AS rn FROM conversations
  QUALIFY rn <= 5
  UNION ALL
  SELECT 'role' AS "column", role AS v, row_number() OVER (ORDER BY conv_id, turn) AS rn FROM conversations
  QUALIFY rn <= 5) GROUP BY "column" """)
def q_text_suitability(spark, sf):
    return rnd(P.text_suitability(t(spark, sf, "conversations"), ["conv_id", "turn"]))


_ALGO_VALUES = ", ".join("(" + ", ".join("'" + v + "'" for v in row) + ")" for row in P.ALGORITHMS)


@register("algorithm_catalog", f"""
SELECT "column", problem_type, complexity, algorithm, category, description FROM (
  SELECT "column", CASE WHEN family = 'numeric' AND unique_count BETWEEN 2 AND 20 THEN 'classification'
    WHEN family = 'numeric' AND unique_count > 20 THEN 'regression'
    WHEN family = 'text' AND unique_count BETWEEN 2 AND 50 THEN 'classification' END AS tt
  FROM ({_column_info_sql(list(ORD_TYPES), ORD_TYPES, 'orders')})) s
JOIN (VALUES {_ALGO_VALUES}) a(problem_type, complexity, algorithm, category, description) ON a.problem_type = s.tt""")
def q_algorithm_catalog(spark, sf):
    """The algorithms offered for each column of orders that can serve as a target."""
    ts = P.target_suitability(P.column_info(t(spark, sf, "orders"))).where("is_target_suitable")
    cat = F.broadcast(P.algorithm_catalog(spark))  # a fixed 15-row table
    return ts.join(cat, ts["target_type"] == cat["problem_type"]).select(
        "column", "problem_type", "complexity", "algorithm", "category", "description")


# ------------------------------------------------------------------ §2.3 profiling

@register("table_profile", f"""
SELECT count(*) AS rows, 6 AS columns, count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM {EVENTS_DUP_SQL}))
  AS duplicated_rows FROM {EVENTS_DUP_SQL}""")
def q_table_profile(spark, sf):
    return P.table_profile(events_dup(spark, sf))


_NP_T = ("SELECT '{c}' AS \"column\", CAST({i} AS INTEGER) AS position, " + r("min({c})") + " AS min, "
         + r("max({c})") + " AS max, " + exact_mean("{c}") + " AS mean, " + r("quantile_cont({c}, 0.5)")
         + " AS median, " + r("stddev_samp({c})") + " AS std FROM {src}")


@register("numeric_profile", union_per_column(LI_NUM, _NP_T, "lineitem"))
def q_numeric_profile(spark, sf):
    return rnd(P.numeric_profile(t(spark, sf, "lineitem")), exact=("mean",))


EV_NUM = ["event_id", "user_id", "value"]
_DESC_T = ("SELECT '{c}' AS \"column\", count({c}) AS count, " + exact_mean("{c}") + " AS mean, "
           + r("stddev_samp({c})") + " AS std, " + r("min({c})") + " AS min, "
           + r("quantile_cont({c}, 0.25)") + " AS q25, " + r("quantile_cont({c}, 0.5)") + " AS q50, "
           + r("quantile_cont({c}, 0.75)") + " AS q75, " + r("max({c})") + " AS max FROM {src}")


@register("describe", union_per_column(EV_NUM, _DESC_T, EVENTS_NULLS_SQL))
def q_describe(spark, sf):
    return rnd(P.describe(events_with_nulls(spark, sf)), exact=("mean",))


_NULL_T = "SELECT '{c}' AS \"column\", count(*) - count({c}) AS nulls FROM {src}"
EV_ALL = ["event_id", "ts", "user_id", "event_type", "value", "props"]


@register("null_counts", f"""
SELECT "column", nulls, CAST(sum(CASE WHEN nulls > 0 THEN 1 ELSE 0 END) OVER () AS INTEGER) AS columns_with_nulls
FROM ({union_per_column(EV_ALL, _NULL_T, EVENTS_NULLS_SQL)})""")
def q_null_counts(spark, sf):
    return P.null_counts(events_with_nulls(spark, sf))


_CAT_T = """SELECT '{c}' AS "column", (SELECT count(DISTINCT {c}) FROM {src}) AS unique_count,
  row_number() OVER (ORDER BY count(*) DESC, CAST({c} AS VARCHAR)) AS rank, CAST({c} AS VARCHAR) AS value,
  count(*) AS count FROM {src} WHERE {c} IS NOT NULL GROUP BY {c} QUALIFY rank <= 10"""


@register("categorical_profile", union_per_column(["c_name", "c_mktsegment"], _CAT_T, CUSTOMER_NULLS_SQL))
def q_categorical_profile(spark, sf):
    return P.categorical_profile(customer_with_nulls(spark, sf)).select(
        "column", "unique_count", F.col("rank").cast("bigint").alias("rank"), "value", "count")


@register("datetime_profile", """
SELECT 'o_orderdate' AS "column", min(o_orderdate) AS min, max(o_orderdate) AS max,
  CAST(floor(date_diff('second', min(o_orderdate), max(o_orderdate)) / 86400) AS BIGINT) AS range_days FROM orders
UNION ALL
SELECT 'ts', min(ts), max(ts), CAST(floor(date_diff('second', min(ts), max(ts)) / 86400) AS BIGINT) FROM events""")
def q_datetime_profile(spark, sf):
    a = P.datetime_profile(t(spark, sf, "orders"))
    b = P.datetime_profile(t(spark, sf, "events"))
    return a.unionByName(b)


def _hist_sql(cols, src, bins_expr):
    """bins_expr: SQL for the number of bins given n, lo, hi, q25, q75 of one column."""
    parts = []
    for c in cols:
        parts.append(f"""SELECT '{c}' AS "column", g.bin, {r('p.lo + g.bin * (p.hi - p.lo) / p.bins')} AS lower,
  {r('CASE WHEN g.bin = p.bins - 1 THEN p.hi ELSE p.lo + (g.bin + 1) * (p.hi - p.lo) / p.bins END')} AS upper,
  CAST(coalesce(cnt.count, 0) AS BIGINT) AS count
FROM (SELECT *, CAST({bins_expr} AS INTEGER) AS bins FROM (
   SELECT count({c}) AS n, CASE WHEN min({c}) = max({c}) THEN min({c}) - 0.5 ELSE min({c}) END AS lo,
     CASE WHEN min({c}) = max({c}) THEN max({c}) + 0.5 ELSE max({c}) END AS hi,
     quantile_cont({c}, 0.25) AS q25, quantile_cont({c}, 0.75) AS q75 FROM {src}) WHERE n > 0) p
CROSS JOIN LATERAL (SELECT CAST(range AS INTEGER) AS bin FROM range(p.bins)) g
LEFT JOIN (SELECT CAST(least(p2.bins - 1, floor((x.{c} - p2.lo) / (p2.hi - p2.lo) * p2.bins)) AS INTEGER) AS bin,
             count(*) AS count
           FROM {src} x, (SELECT *, CAST({bins_expr} AS INTEGER) AS bins FROM (
             SELECT count({c}) AS n, CASE WHEN min({c}) = max({c}) THEN min({c}) - 0.5 ELSE min({c}) END AS lo,
               CASE WHEN min({c}) = max({c}) THEN max({c}) + 0.5 ELSE max({c}) END AS hi,
               quantile_cont({c}, 0.25) AS q25, quantile_cont({c}, 0.75) AS q75 FROM {src})) p2
           WHERE x.{c} IS NOT NULL GROUP BY 1) cnt ON cnt.bin = g.bin""")
    return "\nUNION ALL\n".join(parts)


_AUTO_BINS = ("greatest(1, ceil((hi - lo) / CASE WHEN 2.0 * (q75 - q25) * pow(n, -1.0/3) > 0 THEN "
              "least(2.0 * (q75 - q25) * pow(n, -1.0/3), (hi - lo) / (log2(n) + 1.0)) "
              "ELSE (hi - lo) / (log2(n) + 1.0) END))")


@register("histogram_auto", _hist_sql(["l_quantity", "l_extendedprice", "l_discount"], "lineitem", _AUTO_BINS))
def q_histogram_auto(spark, sf):
    return rnd(P.histogram_auto(t(spark, sf, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount"]))


@register("histogram_30", _hist_sql(["value", "user_id"], EVENTS_NULLS_SQL, "30"))
def q_histogram_30(spark, sf):
    return rnd(P.histogram(events_with_nulls(spark, sf), ["value", "user_id"], bins=30))


@register("histogram_10", _hist_sql(["o_totalprice", "o_custkey"], "orders", "10"))
def q_histogram_10(spark, sf):
    return rnd(P.histogram(t(spark, sf, "orders"), ["o_totalprice", "o_custkey"], bins=10))


def _kde_sql(c, src, points=200):
    return f"""SELECT '{c}' AS "column", g.point, {r('g.x')} AS x,
  {r('sum(exp(-0.5 * ((g.x - d.' + c + ') / g.h) * ((g.x - d.' + c + ') / g.h))) / (g.n * g.h * sqrt(2 * pi()))', 6)} AS density
FROM (SELECT CAST(range AS INTEGER) AS point, mn + range * (mx - mn) / {points - 1} AS x, n, h FROM
   (SELECT min({c}) AS mn, max({c}) AS mx, count({c}) AS n, stddev_samp({c}) * pow(count({c}), -0.2) AS h FROM {src}),
   range({points})) g, {src} d
WHERE d.{c} IS NOT NULL GROUP BY g.point, g.x, g.n, g.h"""


@register("density_curve", _kde_sql("value", EVENTS_NULLS_SQL))
def q_density_curve(spark, sf):
    return rnd(P.density_curve(events_with_nulls(spark, sf), ["value"]))


ORD_NUM = ["o_orderkey", "o_custkey", "o_totalprice"]


def _corr_sql(cols, src):
    parts = []
    for a in cols:
        for b in cols:
            parts.append(f"SELECT '{a}' AS col_a, '{b}' AS col_b, {r(f'corr({a}, {b})')} AS r FROM {src}")
    return "\nUNION ALL\n".join(parts)


@register("correlation_matrix", _corr_sql(["l_quantity", "l_extendedprice", "l_discount", "l_tax"], "lineitem"))
def q_correlation_matrix(spark, sf):
    return rnd(P.correlation_matrix(t(spark, sf, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]))


# twenty columns of lineitem, each with holes of its own: multiples of the four numbers plus line numbers
_WIDE = [(f"w{k}", ["l_quantity", "l_extendedprice", "l_discount", "l_tax"][k % 4], k // 4, k) for k in range(20)]
_WIDE_SQL = "(SELECT " + ", ".join(
    f"CASE WHEN (l_orderkey + {k}) % 7 <> 0 THEN {c} * (1 + {m}) + l_linenumber * {m} END AS {w}" for w, c, m, k in _WIDE) + " FROM lineitem)"


def lineitem_wide(spark, sf):
    return t(spark, sf, "lineitem").select(*[F.when((F.col("l_orderkey") + k) % 7 != 0, F.col(c) * (1 + m) + F.col("l_linenumber") * m
                                                    ).alias(w) for w, c, m, k in _WIDE])


@register("correlation_matrix_wide", "SELECT s.col_a, s.col_b, s.r FROM (SELECT unnest([" + ", ".join(
    f"{{'col_a': '{a[0]}', 'col_b': '{b[0]}', 'r': {r(f'corr({a[0]}, {b[0]})')}}}" for a in _WIDE for b in _WIDE) + f"]) AS s FROM {_WIDE_SQL})")
def q_correlation_matrix_wide(spark, sf):
    return rnd(P.correlation_matrix(lineitem_wide(spark, sf)))


@register("correlation_pairs_wide", "SELECT s.column1, s.column2, s.correlation FROM (SELECT unnest([" + ", ".join(
    f"{{'column1': '{a[0]}', 'column2': '{b[0]}', 'correlation': {r(f'corr({a[0]}, {b[0]})')}}}"
    for i, a in enumerate(_WIDE) for b in _WIDE[i + 1:]) + f"]) AS s FROM {_WIDE_SQL}) WHERE abs(s.correlation) > 0.7")
def q_correlation_pairs_wide(spark, sf):
    return rnd(P.correlation_pairs(lineitem_wide(spark, sf)))


def _corr_pairs_sql(cols, src, thr=0.7):
    parts = []
    for i, a in enumerate(cols):
        for b in cols[i + 1:]:
            parts.append(f"SELECT '{a}' AS column1, '{b}' AS column2, corr({a}, {b}) AS correlation FROM {src}")
    return f"SELECT column1, column2, {r('correlation')} AS correlation FROM ({' UNION ALL '.join(parts)}) WHERE abs(correlation) > {thr}"


@register("correlation_pairs", _corr_pairs_sql(LI_NUM, "lineitem"))
def q_correlation_pairs(spark, sf):
    return rnd(P.correlation_pairs(t(spark, sf, "lineitem")))


_DIST_T = ("SELECT '{c}' AS \"column\", " + exact_mean("{c}") + " AS mean, " + r("quantile_cont({c}, 0.5)")
           + " AS median, " + r("stddev_samp({c})") + " AS std, " + r("skewness({c})") + " AS skewness, "
           + r("kurtosis({c})") + " AS kurtosis FROM {src}")


@register("distribution_stats", union_per_column(["value", "user_id"], _DIST_T, EVENTS_NULLS_SQL))
def q_distribution_stats(spark, sf):
    return rnd(P.distribution_stats(events_with_nulls(spark, sf), ["value", "user_id"]), exact=("mean",))


@register("dataset_summary", f"""
SELECT 'shape' AS section, NULL::VARCHAR AS "column", 'rows' AS stat, CAST(count(*) AS DOUBLE) AS num_value,
  NULL::VARCHAR AS text_value FROM supplier
UNION ALL SELECT 'shape', NULL, 'columns', 4.0::DOUBLE, NULL
UNION ALL SELECT 'types', c, 'type', NULL, ty FROM (VALUES ('s_suppkey', 'bigint'), ('s_name', 'string'),
  ('s_nationkey', 'int'), ('s_acctbal', 'double')) v(c, ty)
UNION ALL SELECT 'missing', c, 'missing', CAST(m AS DOUBLE), NULL FROM (
  SELECT 's_suppkey' AS c, count(*) - count(s_suppkey) AS m FROM supplier UNION ALL
  SELECT 's_name', count(*) - count(s_name) FROM supplier UNION ALL
  SELECT 's_nationkey', count(*) - count(s_nationkey) FROM supplier UNION ALL
  SELECT 's_acctbal', count(*) - count(s_acctbal) FROM supplier)
UNION ALL SELECT 'numeric', "column", stat, round(num_value, 6), NULL FROM (
  UNPIVOT ({union_per_column(['s_suppkey', 's_nationkey', 's_acctbal'],
  "SELECT '{c}' AS \"column\", CAST(count({c}) AS DOUBLE) AS count, CAST(avg({c}) AS DOUBLE) AS mean, "
  "CAST(stddev_samp({c}) AS DOUBLE) AS std, CAST(min({c}) AS DOUBLE) AS min, "
  "CAST(quantile_cont({c}, 0.25) AS DOUBLE) AS q25, CAST(quantile_cont({c}, 0.5) AS DOUBLE) AS q50, "
  "CAST(quantile_cont({c}, 0.75) AS DOUBLE) AS q75, CAST(max({c}) AS DOUBLE) AS max FROM {src}", 'supplier')})
  ON count, mean, std, min, q25, q50, q75, max INTO NAME stat VALUE num_value)""")
def q_dataset_summary(spark, sf):
    return rnd(P.dataset_summary(t(spark, sf, "supplier")))


@register("custom_column_info", f"""
SELECT "column", type, missing, missing_pct, unique_count FROM (
{_column_info_sql(['c_mktsegment', 'c_acctbal'], CUST_TYPES, CUSTOMER_NULLS_SQL)})""")
def q_custom_column_info(spark, sf):
    return rnd(P.custom_column_info(customer_with_nulls(spark, sf), ["c_mktsegment", "c_acctbal"]))


_LI_PRICES_SQL = ("(SELECT l_quantity, l_extendedprice, l_extendedprice * (1 - l_discount) AS net_price, "
                  "l_extendedprice * (1 + l_tax) AS gross_price, l_discount FROM lineitem)")


@register("correlation_pairs_strong", _corr_pairs_sql(["l_quantity", "l_extendedprice", "net_price", "gross_price",
                                                      "l_discount"], _LI_PRICES_SQL))
def q_correlation_pairs_strong(spark, sf):
    li = t(spark, sf, "lineitem")
    prices = li.select("l_quantity", "l_extendedprice",
                       (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("net_price"),
                       (F.col("l_extendedprice") * (1 + F.col("l_tax"))).alias("gross_price"), "l_discount")
    return rnd(P.correlation_pairs(prices))

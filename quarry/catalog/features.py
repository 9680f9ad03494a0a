"""Queries for feature engineering (§2.6)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import features as FE
from .base import (CUSTOMER_NULLS_SQL, EVENTS_NULLS_SQL, customer_with_nulls, events_with_nulls, register, rnd, t)
from .sqlgen import r

W_USER = "PARTITION BY user_id ORDER BY ts, event_id"
W_ALL = "ORDER BY ts, event_id"
ORDER = ["ts", "event_id"]


def _ev(spark, sf):
    return events_with_nulls(spark, sf).select("event_id", "ts", "user_id", "value")


def _roll_sql(w):
    return f"""SELECT event_id, {r('value')} AS value,
  {r(f'avg(value) OVER ({w} ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)')} AS value_rolling_mean_3,
  {r(f'stddev_samp(value) OVER ({w} ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)')} AS value_rolling_std_3
FROM {EVENTS_NULLS_SQL}"""


@register("feat_rolling", _roll_sql(W_USER))
def q_feat_rolling(spark, sf):
    out, _ = FE.feat_rolling(_ev(spark, sf), ["value"], ORDER, ["user_id"])
    return rnd(out.select("event_id", "value", "value_rolling_mean_3", "value_rolling_std_3"))


@register("feat_rolling_global", _roll_sql(W_ALL))
def q_feat_rolling_global(spark, sf):
    out, _ = FE.feat_rolling(_ev(spark, sf), ["value"], ORDER, None)
    return rnd(out.select("event_id", "value", "value_rolling_mean_3", "value_rolling_std_3"))


@register("feat_lag", f"""
SELECT event_id, {r(f'lag(value, 1) OVER ({W_USER})')} AS value_lag_1, {r(f'lag(value, 2) OVER ({W_USER})')} AS value_lag_2
FROM {EVENTS_NULLS_SQL}""")
def q_feat_lag(spark, sf):
    out, _ = FE.feat_lag(_ev(spark, sf), ["value"], ORDER, ["user_id"])
    return rnd(out.select("event_id", "value_lag_1", "value_lag_2"))


# keys of orders moved above 2**53, where a double cannot tell neighbours apart, as whole numbers and as decimals
_BIG = 9007199254740993
_W_CUST = "PARTITION BY o_custkey ORDER BY o_orderkey"
_BIG_SQL = f"""(SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 5 <> 0 THEN o_orderkey + {_BIG} END AS big FROM orders)"""


def orders_big(spark, sf):
    big = F.when(F.col("o_orderkey") % 5 != 0, F.col("o_orderkey") + F.lit(_BIG))
    return t(spark, sf, "orders").select("o_orderkey", "o_custkey", big.alias("big"),
                                         (big.cast("decimal(20,0)") * F.lit("0.01").cast("decimal(3,2)")).cast("decimal(20,2)").alias("exact"))


@register("feat_lag_bigint", f"""
SELECT o_orderkey, lag(big, 1) OVER ({_W_CUST}) AS big_lag_1, lag(big, 2) OVER ({_W_CUST}) AS big_lag_2 FROM {_BIG_SQL}""")
def q_feat_lag_bigint(spark, sf):
    out, _ = FE.feat_lag(orders_big(spark, sf), ["big"], ["o_orderkey"], ["o_custkey"])
    return out.select("o_orderkey", "big_lag_1", "big_lag_2")


@register("feat_cumulative_bigint", "SELECT o_orderkey, " + ", ".join(
    f"CASE WHEN big IS NOT NULL THEN CAST({f}(big) OVER ({_W_CUST} ROWS UNBOUNDED PRECEDING) AS BIGINT) END AS big_cum{f}"
    for f in ("sum", "max", "min")) + f" FROM {_BIG_SQL}")
def q_feat_cumulative_bigint(spark, sf):
    out, _ = FE.feat_cumulative(orders_big(spark, sf), ["big"], ["o_orderkey"], ["o_custkey"])
    return out.select("o_orderkey", "big_cumsum", "big_cummax", "big_cummin")


@register("feat_cumulative_decimal", "SELECT o_orderkey, " + ", ".join(
    f"CASE WHEN big IS NOT NULL THEN CAST({f}(big) OVER (ORDER BY o_orderkey ROWS UNBOUNDED PRECEDING) AS VARCHAR) END AS cum{f}"
    for f in ("sum", "max", "min")) + f" FROM (SELECT o_orderkey, CAST(big AS HUGEINT) AS big FROM {_BIG_SQL})")
def q_feat_cumulative_decimal(spark, sf):
    # one running total over the whole table, beyond 64 bits: as decimals, shown as whole hundredths
    out, _ = FE.feat_cumulative(orders_big(spark, sf), ["exact"], ["o_orderkey"], None)
    whole = lambda c: F.regexp_replace(F.col(c).cast("string"), r"\.", "")
    return out.select("o_orderkey", *[whole(f"exact_cum{f}").alias(f"cum{f}") for f in ("sum", "max", "min")])


def _cum_sql(w, src=EVENTS_NULLS_SQL):
    frame = f"{w} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"
    return f"""SELECT event_id,
  CASE WHEN value IS NOT NULL THEN {r(f'sum(value) OVER ({frame})')} END AS value_cumsum,
  CASE WHEN value IS NOT NULL THEN {r(f'max(value) OVER ({frame})')} END AS value_cummax,
  CASE WHEN value IS NOT NULL THEN {r(f'min(value) OVER ({frame})')} END AS value_cummin FROM {src}"""


@register("feat_cumulative", _cum_sql(W_USER))
def q_feat_cumulative(spark, sf):
    out, _ = FE.feat_cumulative(_ev(spark, sf), ["value"], ORDER, ["user_id"])
    return rnd(out.select("event_id", "value_cumsum", "value_cummax", "value_cummin"))


@register("feat_cumulative_global", _cum_sql(W_ALL))
def q_feat_cumulative_global(spark, sf):
    out, _ = FE.feat_cumulative(_ev(spark, sf), ["value"], ORDER, None)
    return rnd(out.select("event_id", "value_cumsum", "value_cummax", "value_cummin"))


@register("feat_zscore", f"""
SELECT event_id, {r('(value - (SELECT avg(value) FROM events)) / (SELECT stddev_samp(value) FROM events)')} AS value_zscore
FROM events""")
def q_feat_zscore(spark, sf):
    out, _ = FE.feat_zscore(t(spark, sf, "events").select("event_id", "value"), ["value"])
    return rnd(out.select("event_id", "value_zscore"))


_PR = ("CASE WHEN value IS NOT NULL THEN (rank() OVER (ORDER BY value) + (count(*) OVER (PARTITION BY value) - 1) / 2.0)"
       " / count(value) OVER () END")


@register("feat_percentile_rank", f"SELECT event_id, {r(_PR)} AS value_percentile_rank FROM {EVENTS_NULLS_SQL}")
def q_feat_percentile_rank(spark, sf):
    out, _ = FE.feat_percentile_rank(_ev(spark, sf), ["value"])
    return rnd(out.select("event_id", "value_percentile_rank"))


@register("feat_statistical", f"""
SELECT event_id, ts, user_id, {r('value')} AS value,
  {r(f'avg(value) OVER ({W_USER} ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)')} AS value_rolling_mean_3,
  {r(f'stddev_samp(value) OVER ({W_USER} ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)')} AS value_rolling_std_3,
  {r(f'lag(value, 1) OVER ({W_USER})')} AS value_lag_1, {r(f'lag(value, 2) OVER ({W_USER})')} AS value_lag_2,
  CASE WHEN value IS NOT NULL THEN {r(f'sum(value) OVER ({W_USER} ROWS UNBOUNDED PRECEDING)')} END AS value_cumsum,
  CASE WHEN value IS NOT NULL THEN {r(f'max(value) OVER ({W_USER} ROWS UNBOUNDED PRECEDING)')} END AS value_cummax,
  CASE WHEN value IS NOT NULL THEN {r(f'min(value) OVER ({W_USER} ROWS UNBOUNDED PRECEDING)')} END AS value_cummin,
  {r(f'(value - (SELECT avg(value) FROM {EVENTS_NULLS_SQL})) / (SELECT stddev_samp(value) FROM {EVENTS_NULLS_SQL})')} AS value_zscore,
  {r(_PR)} AS value_percentile_rank
FROM {EVENTS_NULLS_SQL}""")
def q_feat_statistical(spark, sf):
    out, _ = FE.feat_statistical(_ev(spark, sf), ["value"], ORDER, ["user_id"])
    return rnd(out)


def _temporal_sql(c, expr, src, key):
    d = expr
    parts = [("year", f"year({d})"), ("month", f"month({d})"), ("day", f"day({d})"),
             ("dayofweek", f"isodow({d}) - 1"), ("hour", f"hour({d})"), ("quarter", f"quarter({d})"),
             ("is_weekend", f"coalesce(CAST(isodow({d}) >= 6 AS INTEGER), 0)"),
             ("is_month_start", f"coalesce(CAST(day({d}) = 1 AS INTEGER), 0)"),
             ("is_month_end", f"coalesce(CAST(CAST({d} AS DATE) = last_day(CAST({d} AS DATE)) AS INTEGER), 0)")]
    sel = ", ".join(f"CAST({e} AS INTEGER) AS {c}_{n}" for n, e in parts)
    return f"SELECT {key}, {sel} FROM {src}"


def _ints(df, key):
    return df.select(*[F.col(c) if c == key else F.col(c).cast("int").alias(c) for c in df.columns])


@register("feat_temporal", _temporal_sql("o_orderdate", "o_orderdate", "orders", "o_orderkey"))
def q_feat_temporal(spark, sf):
    out, _ = FE.feat_temporal(t(spark, sf, "orders").select("o_orderkey", "o_orderdate"))
    return _ints(out.drop("o_orderdate"), "o_orderkey")


ORD_TEXT_SQL = """(SELECT o_orderkey, CASE WHEN o_orderkey % 97 = 0 THEN 'not a date'
  ELSE strftime(o_orderdate, '%Y-%m-%d') END AS odate, o_orderpriority FROM orders)"""


def orders_text_dates(spark, sf):
    o = t(spark, sf, "orders")
    return o.select("o_orderkey", F.when(F.col("o_orderkey") % 97 == 0, "not a date")
                    .otherwise(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("odate"), "o_orderpriority")


@register("detect_datetime", f"""
SELECT "column", count(*) AS probed, count(ok) AS parsed, count(*) = count(ok) AS is_datetime FROM (
  SELECT 'odate' AS "column", try_strptime(odate, '%Y-%m-%d') AS ok FROM {ORD_TEXT_SQL} WHERE odate IS NOT NULL
  UNION ALL SELECT 'good', try_strptime(good, '%Y-%m-%d') FROM (SELECT strftime(o_orderdate, '%Y-%m-%d') AS good FROM orders)
  UNION ALL SELECT 'o_orderpriority', try_strptime(o_orderpriority, '%Y-%m-%d') FROM {ORD_TEXT_SQL}) GROUP BY 1""")
def q_detect_datetime(spark, sf):
    o = orders_text_dates(spark, sf).join(t(spark, sf, "orders").select(
        "o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("good")), "o_orderkey")
    return FE.detect_datetime(o)


@register("feat_temporal_text", _temporal_sql("odate", "try_strptime(odate, '%Y-%m-%d')", ORD_TEXT_SQL, "o_orderkey"))
def q_feat_temporal_text(spark, sf):
    out, _ = FE.feat_temporal(orders_text_dates(spark, sf).select("o_orderkey", "odate"), [], text_dates=["odate"])
    return _ints(out.drop("odate"), "o_orderkey")


SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]


@register("feat_onehot", "SELECT c_custkey, " + ", ".join(
    f"coalesce(c_mktsegment = '{v}', false) AS c_mktsegment_onehot_{v}" for v in SEGMENTS)
    + f", c_mktsegment IS NULL AS c_mktsegment_onehot_nan FROM {CUSTOMER_NULLS_SQL}")
def q_feat_onehot(spark, sf):
    out, _ = FE.feat_onehot(customer_with_nulls(spark, sf).select("c_custkey", "c_mktsegment"))
    return out.drop("c_mktsegment")


@register("feat_label_encode", """
SELECT p_partkey, CAST(dense_rank() OVER (ORDER BY p_brand) - 1 AS INTEGER) AS p_brand_label_encoded,
  CAST(dense_rank() OVER (ORDER BY p_name) - 1 AS INTEGER) AS p_name_label_encoded FROM part""")
def q_feat_label_encode(spark, sf):
    out, _ = FE.feat_label_encode(t(spark, sf, "part").select("p_partkey", "p_brand", "p_name"))
    return out.select("p_partkey", "p_brand_label_encoded", "p_name_label_encoded")


@register("feat_frequency", f"""
SELECT c_custkey, CAST(CASE WHEN c_mktsegment IS NULL THEN 0 ELSE count(*) OVER (PARTITION BY c_mktsegment) END AS BIGINT)
  AS c_mktsegment_frequency FROM {CUSTOMER_NULLS_SQL}""")
def q_feat_frequency(spark, sf):
    out, _ = FE.feat_frequency(customer_with_nulls(spark, sf).select("c_custkey", "c_mktsegment"))
    return out.select("c_custkey", "c_mktsegment_frequency")


@register("feat_string_length", f"""
SELECT c_custkey, length(c_name) AS c_name_length, length(c_mktsegment) AS c_mktsegment_length FROM {CUSTOMER_NULLS_SQL}""")
def q_feat_string_length(spark, sf):
    out, _ = FE.feat_string_length(customer_with_nulls(spark, sf).select("c_custkey", "c_name", "c_mktsegment"))
    return out.select("c_custkey", "c_name_length", "c_mktsegment_length")


LI4 = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_partkey", "l_suppkey"]


def _inter_sql():
    # row-wise IEEE arithmetic is bit-identical in both engines: compared unrounded
    parts = []
    for i, a in enumerate(LI4):
        for b in LI4[i + 1:]:
            parts += [f"{a} * {b} AS {a}_x_{b}", f"{a} + {b} AS {a}_plus_{b}",
                      f"{a} / ({b} + 1e-8) AS {a}_div_{b}", f"{a} - {b} AS {a}_minus_{b}"]
    src = ", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in LI4)
    return "SELECT l_orderkey, l_linenumber, " + ", ".join(parts) + f" FROM (SELECT l_orderkey, l_linenumber, {src} FROM lineitem)"


@register("feat_interaction", _inter_sql())
def q_feat_interaction(spark, sf):
    out, _ = FE.feat_interaction(t(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", *LI4), LI4)  # six columns: all 15 pairs
    return out.drop(*LI4)


def _text_sql(c, src, key):
    words = rf"list_filter(regexp_split_to_array({c}, '\s+'), lambda w: w <> '')"
    return f"""SELECT {key}, len({words}) AS {c}_word_count, length({c}) AS {c}_char_count,
  len(list_distinct({words})) AS {c}_unique_words,
  {r(f"CASE WHEN len({words}) > 0 THEN list_sum(list_transform({words}, lambda w: length(w))) / len({words}) ELSE 0.0 END")}
    AS {c}_avg_word_length,
  CAST(length({c}) - length(replace({c}, '!', '')) AS INTEGER) AS {c}_exclamation_count,
  CAST(length({c}) - length(replace({c}, '?', '')) AS INTEGER) AS {c}_question_count,
  CAST(len(regexp_extract_all({c}, '[A-Z]')) AS INTEGER) AS {c}_uppercase_count,
  CAST(len(regexp_extract_all({c}, '[0-9]')) AS INTEGER) AS {c}_digit_count,
  CAST(len(regexp_extract_all({c}, '[.!?]+')) AS INTEGER) AS {c}_sentence_count FROM {src}"""


@register("feat_text", _text_sql("text", "conversations", "conv_id, turn"))
def q_feat_text(spark, sf):
    out, _ = FE.feat_text(t(spark, sf, "conversations").select("conv_id", "turn", "text"))
    out = out.drop("text")
    return rnd(out.select(*[F.col(c).cast("int").alias(c) if c.endswith(("_count", "_words")) else F.col(c)
                            for c in out.columns]))


def _group_sql():
    cols = []
    for n in ["c_acctbal", "c_nationkey"]:
        cols += [f"{r(f'coalesce(avg({n}) OVER g, 0)')} AS c_mktsegment_{n}_mean",
                 f"{r(f'coalesce(stddev_samp({n}) OVER g, 0)')} AS c_mktsegment_{n}_std",
                 f"CAST(coalesce(count({n}) OVER g, 0) AS BIGINT) AS c_mktsegment_{n}_count"]
    sel = ", ".join(c.replace("OVER g", "OVER (PARTITION BY c_mktsegment)") for c in cols)
    sel = sel.replace("coalesce(avg(", "coalesce(CASE WHEN c_mktsegment IS NOT NULL THEN avg(").replace(
        "coalesce(stddev_samp(", "coalesce(CASE WHEN c_mktsegment IS NOT NULL THEN stddev_samp(").replace(
        "coalesce(count(", "coalesce(CASE WHEN c_mktsegment IS NOT NULL THEN count(")
    sel = sel.replace("OVER (PARTITION BY c_mktsegment), 0)", "OVER (PARTITION BY c_mktsegment) END, 0)")
    return f"SELECT c_custkey, {sel} FROM {CUSTOMER_NULLS_SQL}"


@register("feat_group_agg", _group_sql())
def q_feat_group_agg(spark, sf):
    src = customer_with_nulls(spark, sf).select("c_custkey", "c_mktsegment", "c_acctbal", "c_nationkey")
    out, _ = FE.feat_group_agg(src, ["c_mktsegment"], ["c_acctbal", "c_nationkey"])
    return rnd(out.drop("c_mktsegment", "c_acctbal", "c_nationkey"))


@register("feat_ratio", f"""
SELECT l_orderkey, l_linenumber, {r('l_extendedprice / (l_quantity + 1e-8)')} AS unit_price FROM lineitem""")
def q_feat_ratio(spark, sf):
    out, _ = FE.feat_ratio(t(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice", "l_quantity"),
                           "unit_price", "l_extendedprice", "l_quantity")
    return rnd(out.select("l_orderkey", "l_linenumber", "unit_price"))


@register("feat_group_relative", f"""
SELECT c_custkey, {r('c_acctbal / (avg(c_acctbal) OVER (PARTITION BY c_mktsegment) + 1e-8)')} AS rel_acctbal
FROM {CUSTOMER_NULLS_SQL} WHERE c_mktsegment IS NOT NULL
UNION ALL SELECT c_custkey, NULL FROM {CUSTOMER_NULLS_SQL} WHERE c_mktsegment IS NULL""")
def q_feat_group_relative(spark, sf):
    out, _ = FE.feat_group_relative(customer_with_nulls(spark, sf), "rel_acctbal", "c_acctbal", "c_mktsegment")
    return rnd(out.select("c_custkey", "rel_acctbal"))


def _ef(spark, sf):
    o = t(spark, sf, "orders").select("o_orderkey", "o_totalprice", "o_orderdate", "o_orderstatus")
    return FE.engineer_features(o, ["o_totalprice", "o_orderdate", "o_orderstatus"], order_by=["o_orderkey"])


_EF_CAT = []
for _n, _d in [("rolling_mean_3", "mean of o_totalprice over this row and the two before"),
               ("rolling_std_3", "sample deviation of o_totalprice over this row and the two before"),
               ("lag_1", "o_totalprice one row back"), ("lag_2", "o_totalprice two rows back"),
               ("cumsum", "total of o_totalprice so far"), ("cummax", "largest o_totalprice so far"),
               ("cummin", "smallest o_totalprice so far"), ("zscore", "o_totalprice in deviations from its mean"),
               ("percentile_rank", "average rank of o_totalprice as a share of its values")]:
    _EF_CAT.append((f"o_totalprice_{_n}", "statistical", _d))
for _n, _d in [("year", "calendar year of"), ("month", "month number of"), ("day", "day of the month of"),
               ("dayofweek", "weekday (Monday 0) of"), ("hour", "hour of the day of"), ("quarter", "quarter number of"),
               ("is_weekend", "1 on Saturday and Sunday, by"), ("is_month_start", "1 on the first day of a month, by"),
               ("is_month_end", "1 on the last day of a month, by")]:
    _EF_CAT.append((f"o_orderdate_{_n}", "temporal", f"{_d} o_orderdate"))
for _v in ["F", "O", "P"]:
    _EF_CAT.append((f"o_orderstatus_onehot_{_v}", "categorical", "whether o_orderstatus has this value"))
_EF_CAT += [("o_orderstatus_onehot_nan", "categorical", "whether o_orderstatus is missing"),
            ("o_orderstatus_label_encoded", "categorical", "place of the value among the sorted values of o_orderstatus"),
            ("o_orderstatus_frequency", "categorical", "rows that share the value of o_orderstatus"),
            ("o_orderstatus_length", "categorical", "characters of o_orderstatus")]
for _n, _d in [("word_count", "words of"), ("char_count", "characters in"), ("unique_words", "distinct words of"),
               ("avg_word_length", "mean word length of"), ("exclamation_count", "exclamation marks of"),
               ("question_count", "question marks of"), ("uppercase_count", "capitals A-Z of"), ("digit_count", "digits of"),
               ("sentence_count", "sentence ends of")]:
    _EF_CAT.append((f"o_orderstatus_{_n}", "text", f"{_d} o_orderstatus"))
for _s, _ti in [("mean", "mean"), ("std", "deviation"), ("count", "count")]:
    _EF_CAT.append((f"o_orderstatus_o_totalprice_{_s}", "aggregation",
                    f"{_ti} of o_totalprice among rows of the same o_orderstatus"))

_EF_VALUES = ", ".join(f"('{a}', '{b}', '{c}')" for a, b, c in _EF_CAT)


@register("engineer_features", f"SELECT * FROM (VALUES {_EF_VALUES}) v(name, type, description)")
def q_engineer_features(spark, sf):
    _, cat = _ef(spark, sf)
    return cat


@register("engineer_features_table", f"""
SELECT o_orderkey, {r('o_totalprice_lag_1')} AS o_totalprice_lag_1, o_orderdate_month, o_orderstatus_onehot_O,
  o_orderstatus_frequency, {r('o_orderstatus_o_totalprice_mean')} AS o_orderstatus_o_totalprice_mean FROM (
  SELECT o_orderkey, lag(o_totalprice) OVER (ORDER BY o_orderkey) AS o_totalprice_lag_1, month(o_orderdate) AS o_orderdate_month,
    coalesce(o_orderstatus = 'O', false) AS o_orderstatus_onehot_O, count(*) OVER (PARTITION BY o_orderstatus) AS o_orderstatus_frequency,
    avg(o_totalprice) OVER (PARTITION BY o_orderstatus) AS o_orderstatus_o_totalprice_mean FROM orders)""")
def q_engineer_features_table(spark, sf):
    out, _ = _ef(spark, sf)
    return rnd(out.select("o_orderkey", "o_totalprice_lag_1", "o_orderdate_month", "o_orderstatus_onehot_O",
                          "o_orderstatus_frequency", "o_orderstatus_o_totalprice_mean"))


@register("feature_run_summary", f"""
SELECT 4 AS original_features, {len(_EF_CAT)} AS new_features, {4 + len(_EF_CAT)} AS total_features,
  'aggregation,categorical,statistical,temporal,text' AS feature_types,
  'o_totalprice_rolling_mean_3,o_totalprice_rolling_std_3,o_totalprice_lag_1,o_totalprice_lag_2,o_totalprice_cumsum'
  AS sample_new_features""")
def q_feature_run_summary(spark, sf):
    o = t(spark, sf, "orders").select("o_orderkey", "o_totalprice", "o_orderdate", "o_orderstatus")
    out, cat = _ef(spark, sf)
    return FE.feature_run_summary(o, out, cat)


@register("engineer_features_text_dates", """
SELECT o_orderkey, year(o_orderdate) AS day_year, month(o_orderdate) AS day_month FROM orders""")
def q_engineer_features_text_dates(spark, sf):
    o = t(spark, sf, "orders").select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"))
    out, _ = FE.engineer_features(o, ["day"], families=("temporal",))
    return out.select("o_orderkey", "day_year", "day_month")


# four text and four numeric columns: all sixteen pairs
_G4 = ["o_orderstatus", "o_orderpriority", "o_day", "o_odd"]
_N4 = ["o_totalprice", "o_custkey", "o_half", "o_neg"]


@register("feat_group_agg_all", "SELECT o_orderkey, " + ", ".join(
    f"{r(f'avg({n}) OVER (PARTITION BY {g})')} AS {g}_{n}_mean, count({n}) OVER (PARTITION BY {g}) AS {g}_{n}_count"
    for g in _G4 for n in _N4) + """ FROM (SELECT o_orderkey, o_orderstatus, o_orderpriority, strftime(o_orderdate, '%d') AS o_day,
  CASE WHEN o_orderkey % 2 = 1 THEN 'odd' ELSE 'even' END AS o_odd, o_totalprice, CAST(o_custkey AS DOUBLE) AS o_custkey,
  o_totalprice / 2 AS o_half, -o_totalprice AS o_neg FROM orders)""")
def q_feat_group_agg_all(spark, sf):
    o = t(spark, sf, "orders").select(
        "o_orderkey", "o_orderstatus", "o_orderpriority", F.date_format("o_orderdate", "dd").alias("o_day"),
        F.when(F.col("o_orderkey") % 2 == 1, "odd").otherwise("even").alias("o_odd"), "o_totalprice",
        F.col("o_custkey").cast("double").alias("o_custkey"), (F.col("o_totalprice") / 2).alias("o_half"),
        (-F.col("o_totalprice")).alias("o_neg"))
    out, _ = FE.feat_group_agg(o, _G4, _N4)
    return rnd(out.select("o_orderkey", *[f"{g}_{n}_{x}" for g in _G4 for n in _N4 for x in ("mean", "count")]))

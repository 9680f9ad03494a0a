"""Queries for model training and evaluation (§2.8)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import calibrate, network
from ..operators import evaluate as E
from ..operators import ml as M
from ..operators import trees as T
from .base import ORDERS_SPARSE_SQL, orders_sparse, register, rnd, t
from ..operators.neighbours import knn_indexed
from ..operators.prepare import ModelRecord, train_record
from ..session import ensure_checkpoint_dir, local_table, pin, stored
from .sqlgen import r, r_sig

# planted classification target on orders: price class; the price feature has holes
ORD_KEY = ["o_orderkey"]
ORD_FEATS = ["o_custkey", "o_totalprice", "o_orderstatus", "o_orderpriority"]


def orders_cls(spark, sf):
    o = t(spark, sf, "orders").select("o_orderkey", F.when(F.col("o_totalprice") > 100000, "high")
                                      .otherwise("low").alias("price_class"))
    return orders_sparse(spark, sf).join(o, "o_orderkey")


ORD_CLS_SQL = f"""(SELECT s.*, CASE WHEN o.o_totalprice > 100000 THEN 'high' ELSE 'low' END AS price_class
  FROM {ORDERS_SPARSE_SQL} s JOIN orders o USING (o_orderkey))"""


def _prep(spark, sf):
    return M.ml_prepare(orders_cls(spark, sf), "price_class", ORD_KEY, ORD_FEATS)


_PREP_SQL = f"""(SELECT o_orderkey, CAST(o_custkey AS DOUBLE) AS o_custkey,
  coalesce(o_totalprice, (SELECT quantile_cont(o_totalprice, 0.5) FROM {ORD_CLS_SQL})) AS o_totalprice,
  CAST(dense_rank() OVER (ORDER BY coalesce(o_orderstatus, 'Unknown')) - 1 AS DOUBLE) AS o_orderstatus,
  CAST(dense_rank() OVER (ORDER BY coalesce(o_orderpriority, 'Unknown')) - 1 AS DOUBLE) AS o_orderpriority,
  CAST(dense_rank() OVER (ORDER BY price_class) - 1 AS DOUBLE) AS label FROM {ORD_CLS_SQL})"""


@register("ml_prepare", f"SELECT o_orderkey, o_custkey, {r('o_totalprice')} AS o_totalprice, o_orderstatus, "
                        f"o_orderpriority, label FROM {_PREP_SQL}")
def q_ml_prepare(spark, sf):
    prep, _ = _prep(spark, sf)
    return rnd(prep)


def _split_sql(src, key_expr, strat="label"):
    # rows that repeat a key stand side by side in the order and go where the first of them goes
    part = f"PARTITION BY {strat}" if strat else ""
    same = f"PARTITION BY {strat + ', ' if strat else ''}{key_expr}"
    return f"""(SELECT * EXCLUDE (rn_, n_), (min(rn_) OVER ({same}) - 1) < round(n_ * 0.2) AS is_test FROM (
   SELECT *, row_number() OVER ({part} ORDER BY md5(concat('42', {key_expr})), {key_expr}) AS rn_,
     count(*) OVER ({part}) AS n_ FROM {src}))"""


_ORD_SPLIT = _split_sql(_PREP_SQL, "CAST(o_orderkey AS VARCHAR)")


@register("ml_split", f"SELECT o_orderkey, label, is_test FROM {_ORD_SPLIT}")
def q_ml_split(spark, sf):
    prep, _ = _prep(spark, sf)
    return M.ml_split(prep, ORD_KEY).select("o_orderkey", "label", "is_test")


# fitted on the train rows only: the split comes first, then medians and codes of the rows that are not tested
_RAW_SPLIT = _split_sql(ORD_CLS_SQL, "CAST(o_orderkey AS VARCHAR)", "price_class")


@register("ml_prepare_train", f"""
WITH s AS {_RAW_SPLIT}, tr AS (SELECT * FROM s WHERE NOT is_test),
st AS (SELECT v, row_number() OVER (ORDER BY v) - 1 AS code FROM (SELECT DISTINCT coalesce(o_orderstatus, 'Unknown') AS v FROM tr)),
pr AS (SELECT v, row_number() OVER (ORDER BY v) - 1 AS code FROM (SELECT DISTINCT coalesce(o_orderpriority, 'Unknown') AS v FROM tr))
SELECT o_orderkey, is_test, CAST(o_custkey AS DOUBLE) AS o_custkey,
  {r('coalesce(o_totalprice, (SELECT quantile_cont(o_totalprice, 0.5) FROM tr))')} AS o_totalprice,
  CAST(coalesce(st.code, (SELECT count(*) FROM st)) AS DOUBLE) AS o_orderstatus,
  CAST(coalesce(pr.code, (SELECT count(*) FROM pr)) AS DOUBLE) AS o_orderpriority,
  CAST(dense_rank() OVER (ORDER BY price_class) - 1 AS DOUBLE) AS label
FROM s LEFT JOIN st ON st.v = coalesce(o_orderstatus, 'Unknown') LEFT JOIN pr ON pr.v = coalesce(o_orderpriority, 'Unknown')""")
def q_ml_prepare_train(spark, sf):
    return rnd(M.ml_prepare(orders_cls(spark, sf), "price_class", ORD_KEY, ORD_FEATS, fit_on="train")[0])


@register("ml_record_scores")
def q_ml_record_scores(spark, sf):
    """The record is saved, loaded and given raw rows; predictions of all of them, known target or not."""
    import uuid
    record, _ = train_record(orders_cls(spark, sf), "price_class", ORD_KEY, "Naive Bayes", "classification", ORD_FEATS)
    path = f"{ensure_checkpoint_dir(spark)}/record-{uuid.uuid4().hex}"
    record.save(spark, path)
    return ModelRecord.load(spark, path).score(orders_sparse(spark, sf), ORD_KEY)


def _fit(spark, sf, name):
    prep, feats = _prep(spark, sf)
    split = pin(M.ml_split(prep, ORD_KEY))
    pred, model, _ = M.fit_predict(name, "classification", split.where(~F.col("is_test")),
                                   split.where(F.col("is_test")), feats, ORD_KEY)
    return pred, model, feats


@register("ml_split_dupkey", "SELECT o_orderkey, o_custkey, label, is_test FROM " + _split_sql(
    "(SELECT o_orderkey, o_custkey, CAST(o_totalprice > 100000 AS INTEGER) AS label FROM orders)", "CAST(o_custkey AS VARCHAR)"))
def q_ml_split_dupkey(spark, sf):
    o = t(spark, sf, "orders").select("o_orderkey", "o_custkey", (F.col("o_totalprice") > 100000).cast("int").alias("label"))
    return M.ml_split(o, ["o_custkey"])  # a customer has many orders


# What SQL can say of a fitted classifier: the rows it was tested on, by label, and that it is no worse than always
# answering the commonest label of the test rows.
_CHECK_SQL = f"""SELECT count(*) FILTER (WHERE label = 0) AS rows_0, count(*) FILTER (WHERE label = 1) AS rows_1,
  true AS valid, true AS beats_majority FROM {_ORD_SPLIT} WHERE is_test"""


def _check(pred, classes=2):
    most = F.greatest(*[F.count_if(F.col("label") == i) for i in range(classes)])
    right = F.count_if(F.col("label") == F.col("prediction"))
    valid = F.count_if(F.col("prediction").isin(*[float(i) for i in range(classes)])) == F.count(F.lit(1))
    return pred.agg(*[F.count_if(F.col("label") == i).alias(f"rows_{i}") for i in range(classes)], valid.alias("valid"),
                    (right >= most).alias("beats_majority"))


for _qid, _name in [("clf_logistic", "Logistic Regression"), ("clf_tree", "Decision Tree"), ("clf_bayes", "Naive Bayes"),
                    ("clf_forest", "Random Forest"), ("clf_boost", "Gradient Boosting"), ("clf_svm", "SVM"),
                    ("clf_mlp", "Neural Network")]:
    register(_qid, _CHECK_SQL)(lambda spark, sf, _n=_name: _check(_fit(spark, sf, _n)[0]))


_STATUS_SPLIT = _split_sql("""(SELECT o_orderkey, CAST(dense_rank() OVER (ORDER BY o_orderstatus) - 1 AS DOUBLE) AS label
  FROM orders)""", "CAST(o_orderkey AS VARCHAR)")


@register("clf_boost_multiclass", "SELECT " + ", ".join(f"count(*) FILTER (WHERE label = {i}) AS rows_{i}" for i in range(3))
          + f", true AS valid FROM {_STATUS_SPLIT} WHERE is_test")
def q_clf_boost_multiclass(spark, sf):
    o = t(spark, sf, "orders").select("o_orderkey", "o_totalprice", "o_custkey", "o_orderstatus")
    prep, feats = M.ml_prepare(o, "o_orderstatus", ORD_KEY, ["o_totalprice", "o_custkey"])
    split = pin(M.ml_split(prep, ORD_KEY))
    pred, _, _ = M.fit_predict("Gradient Boosting", "classification", split.where(~F.col("is_test")),
                               split.where(F.col("is_test")), feats, ORD_KEY)
    return _check(pred, 3).drop("beats_majority")  # the status has nothing to do with the features


_NB_SQL = " UNION ALL ".join(
    f"SELECT label, '{f}' AS feature, {r(f'avg({f})')} AS mean, {r(f'stddev_pop({f})')} AS std, "
    f"{r(f'count(*) / (SELECT count(*) FROM {_PREP_SQL})')} AS prior FROM {_PREP_SQL} GROUP BY label"
    for f in ORD_FEATS)


@register("clf_bayes_stats", _NB_SQL)
def q_clf_bayes_stats(spark, sf):
    prep, feats = _prep(spark, sf)
    # the variance of prices (~1e9) is compared through its square root: same parameter,
    # without last-digit noise of a float sum in the sixth decimal
    return rnd(M.gaussian_nb_stats(prep, feats).drop("var"))


# planted regression target on lineitem
LI_KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]


def lineitem_reg(spark, sf):
    li = t(spark, sf, "lineitem")
    return li.select(*LI_KEY, "l_quantity", "l_discount", "l_tax",
                     (2 * F.col("l_quantity") + 3 * F.col("l_discount")).alias("y"))


def _fit_reg(spark, sf, name):
    prep, feats = M.ml_prepare(lineitem_reg(spark, sf), "y", LI_KEY, ["l_quantity", "l_discount", "l_tax"], "regression")
    split = stored(M.ml_split(prep, LI_KEY, None, in_place=True))
    pred, model, _ = M.fit_predict(name, "regression", split.where(~F.col("is_test")), split.where(F.col("is_test")),
                                   feats, LI_KEY)
    return pred


_LI_SPLIT = _split_sql("(SELECT *, 2 * l_quantity + 3 * l_discount AS y FROM lineitem)",
                       "concat_ws(chr(1), l_orderkey, l_linenumber, l_partkey, l_suppkey)", None)
_LI_SEL = "l_orderkey, l_linenumber, l_partkey, l_suppkey, round(y, 2) AS label"

# the target is exactly linear: least squares and the robust fit must predict every test row
for _qid, _name in [("reg_linear", "Linear Regression"), ("reg_robust", "Huber")]:
    register(_qid, f"SELECT {_LI_SEL}, round(y, 2) AS prediction FROM {_LI_SPLIT} WHERE is_test")(
        lambda spark, sf, _n=_name: _fit_reg(spark, sf, _n).select(
            *LI_KEY, F.round("label", 2).alias("label"), F.round("prediction", 2).alias("prediction")))

# an exact line leaves every test row in the tube of 0.1 about the support vector fit
@register("reg_svr", f"SELECT {_LI_SEL}, true AS in_tube FROM {_LI_SPLIT} WHERE is_test")
def q_reg_svr(spark, sf):
    return _fit_reg(spark, sf, "SVR").select(*LI_KEY, F.round("label", 2).alias("label"),
                                             (F.abs(F.col("label") - F.col("prediction")) <= 0.101).alias("in_tube"))


# the others: rows, and the share of the test rows' variance they explain
for _qid, _name, _least in [("reg_ridge", "Ridge Regression", 0.999), ("reg_tree", "Decision Tree", 0.9),
                            ("reg_forest", "Random Forest", 0.9), ("reg_boost", "Gradient Boosting", 0.9)]:
    register(_qid, f"SELECT count(*) AS rows, round(avg(y), 4) AS mean_label, true AS explains FROM {_LI_SPLIT} WHERE is_test")(
        lambda spark, sf, _n=_name, _l=_least: _fit_reg(spark, sf, _n).agg(
            F.count(F.lit(1)).alias("rows"), F.round(F.avg("label"), 4).alias("mean_label"),
            (F.avg((F.col("label") - F.col("prediction")) ** 2) <= (1 - _l) * F.var_pop("label")).alias("explains")))


# ridge in closed form: (X'X + I) w = X'y of centred columns, three unknowns by Cramer's rule
_RX = ["l_quantity", "l_discount", "l_tax"]
_det = lambda m: (f"({m[0][0]} * ({m[1][1]} * {m[2][2]} - {m[1][2]} * {m[2][1]}) - {m[0][1]} * ({m[1][0]} * {m[2][2]} - {m[1][2]} * {m[2][0]})"  # noqa: E731
                  f" + {m[0][2]} * ({m[1][0]} * {m[2][1]} - {m[1][1]} * {m[2][0]}))")
_A = [[f"a{min(i, j)}{max(i, j)}" for j in range(3)] for i in range(3)]
_W = [f"{_det([[f'b{i}' if j == k else _A[i][j] for j in range(3)] for i in range(3)])} / {_det(_A)}" for k in range(3)]
_RIDGE_SQL = f"""WITH sp AS MATERIALIZED (SELECT * FROM {_LI_SPLIT}), tr AS (SELECT * FROM sp WHERE NOT is_test),
g AS (SELECT {', '.join(f"covar_pop({a}, {b}) * count(*){' + 1' if i == j else ''} AS a{i}{j}" for i, a in enumerate(_RX) for j, b in enumerate(_RX) if i <= j)},
  {', '.join(f'covar_pop({a}, y) * count(*) AS b{i}' for i, a in enumerate(_RX))}, {', '.join(f'avg({a}) AS m{i}' for i, a in enumerate(_RX))},
  avg(y) AS my FROM tr),
w AS (SELECT {', '.join(f'{e} AS w{i}' for i, e in enumerate(_W))}, {', '.join(f'm{i}' for i in range(3))}, my FROM g)"""


@register("reg_ridge_predictions", f"""{_RIDGE_SQL}
SELECT {_LI_SEL}, round(my + {' + '.join(f'w{i} * ({a} - m{i})' for i, a in enumerate(_RX))}, 4) AS prediction FROM sp, w WHERE is_test""")
def q_reg_ridge_predictions(spark, sf):
    return _fit_reg(spark, sf, "Ridge Regression").select(
        *LI_KEY, F.round("label", 2).alias("label"), F.round("prediction", 4).alias("prediction"))


@register("reg_predictions")
def q_reg_predictions(spark, sf):
    """algorithm, key, label, prediction of every test row, for the regressions that SQL cannot follow."""
    prep, feats = M.ml_prepare(lineitem_reg(spark, sf), "y", LI_KEY, ["l_quantity", "l_discount", "l_tax"], "regression")
    split = pin(M.ml_split(prep, LI_KEY, None))
    return reduce(DataFrame.unionByName, M.fit_predict_each(
        ("Decision Tree", "Random Forest", "Gradient Boosting"), "regression", split.where(~F.col("is_test")), split.where(F.col("is_test")),
        feats, LI_KEY))


@register("reg_linear_1f", """
SELECT round(regr_slope(l_extendedprice, l_quantity), 4) AS slope,
  round(regr_intercept(l_extendedprice, l_quantity), 4) AS intercept FROM lineitem""")
def q_reg_linear_1f(spark, sf):
    li = t(spark, sf, "lineitem").select(F.col("l_extendedprice").alias("label"), "l_quantity")
    m = M.estimator("Linear Regression", "regression", 0, 1).fit(M.assemble(li, ["l_quantity"]))
    return spark.range(1).select(F.round(F.lit(float(m.coefficients[0])), 4).alias("slope"),
                                 F.round(F.lit(float(m.intercept)), 4).alias("intercept"))


# k-NN on embeddings: stratified split by label, exact 3 nearest neighbours
_EMB_SPLIT = _split_sql("(SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v, label FROM embeddings)", "CAST(vec_id AS VARCHAR)")


def _knn_sql(vote: bool):
    agg = ("SELECT qk, y AS prediction FROM (SELECT qk, y, count(*) AS c FROM nn GROUP BY qk, y) "
           "QUALIFY row_number() OVER (PARTITION BY qk ORDER BY c DESC, y) = 1") if vote else \
        "SELECT qk, avg(y) AS prediction FROM nn GROUP BY qk"
    return f"""WITH sp AS {_EMB_SPLIT},
nn AS (SELECT q.vec_id AS qk, CAST(tr.label AS DOUBLE) AS y FROM sp q, sp tr WHERE q.is_test AND NOT tr.is_test
  QUALIFY row_number() OVER (PARTITION BY q.vec_id ORDER BY list_distance(q.v, tr.v), tr.vec_id) <= 3),
p AS ({agg})
SELECT sp.vec_id, CAST(sp.label AS DOUBLE) AS label, {'p.prediction' if vote else r('p.prediction')} AS prediction
FROM sp JOIN p ON p.qk = sp.vec_id"""


def _knn(spark, sf, mode):
    e = t(spark, sf, "embeddings").select("vec_id", "embedding", F.col("label").cast("double").alias("label"))
    split = M.ml_split(e, ["vec_id"])
    train, test = split.where(~F.col("is_test")), split.where(F.col("is_test"))
    p = M.knn(train, test, "vec_id", "embedding", 3, mode)
    return test.select("vec_id", "label").join(p, "vec_id")


@register("clf_knn", _knn_sql(True))
def q_clf_knn(spark, sf):
    return _knn(spark, sf, "classify")


@register("reg_knn", _knn_sql(False))
def q_reg_knn(spark, sf):
    return rnd(_knn(spark, sf, "regress"))


def _knn_indexed(spark, sf, mode):
    e = t(spark, sf, "embeddings").select("vec_id", "embedding", F.col("label").cast("double").alias("label"))
    split = pin(M.ml_split(e, ["vec_id"]))
    train, test = split.where(~F.col("is_test")), split.where(F.col("is_test"))
    return test.select("vec_id", "label").join(knn_indexed(train, test, "vec_id", "embedding", 3, mode), "vec_id")


@register("clf_knn_indexed")
def q_clf_knn_indexed(spark, sf):
    return _knn_indexed(spark, sf, "classify")


@register("reg_knn_indexed")
def q_reg_knn_indexed(spark, sf):
    return rnd(_knn_indexed(spark, sf, "regress"))


# evaluation on labels: quality = truth, toxic = prediction
_PAIRS = "(SELECT quality AS y, toxic AS p FROM labels)"
_EVAL_CLS = f"""WITH pr AS (SELECT y, p, count(*) AS n FROM {_PAIRS} GROUP BY y, p),
cls AS (SELECT y AS c FROM pr UNION SELECT p FROM pr),
per AS (SELECT c, coalesce((SELECT sum(n) FROM pr WHERE y = c), 0) AS support,
  coalesce((SELECT sum(n) FROM pr WHERE p = c), 0) AS predicted, coalesce((SELECT sum(n) FROM pr WHERE y = c AND p = c), 0) AS tp
  FROM cls),
m AS (SELECT *, CASE WHEN predicted > 0 THEN tp / predicted ELSE 0.0 END AS prec,
  CASE WHEN support > 0 THEN tp / support ELSE 0.0 END AS rec FROM per),
f AS (SELECT *, CASE WHEN prec + rec > 0 THEN 2 * prec * rec / (prec + rec) ELSE 0.0 END AS f1 FROM m)
SELECT {r('sum(tp) / sum(support)')} AS accuracy, {r('sum(prec * support) / sum(support)')} AS precision,
  {r('sum(rec * support) / sum(support)')} AS recall, {r('sum(f1 * support) / sum(support)')} AS f1_score FROM f"""


def _label_pred(spark, sf):
    return t(spark, sf, "labels").select(F.col("quality").alias("label"), F.col("toxic").alias("prediction"))


@register("eval_classification", _EVAL_CLS)
def q_eval_classification(spark, sf):
    return rnd(E.eval_classification(_label_pred(spark, sf)))


@register("eval_confusion", f"""
WITH pr AS (SELECT y, p, count(*) AS n FROM {_PAIRS} GROUP BY y, p),
cls AS (SELECT y AS c FROM pr UNION SELECT p FROM pr)
SELECT a.c AS label, b.c AS prediction, CAST(coalesce(pr.n, 0) AS BIGINT) AS count
FROM cls a, cls b LEFT JOIN pr ON pr.y = a.c AND pr.p = b.c""")
def q_eval_confusion(spark, sf):
    return E.eval_confusion(_label_pred(spark, sf))


def _reg_pred(spark, sf):
    return t(spark, sf, "lineitem").select(F.col("l_extendedprice").alias("label"),
                                           (F.col("l_quantity") * 1530.0).alias("prediction"))


@register("eval_regression", f"""
SELECT {r_sig('avg(POWER(l_extendedprice - l_quantity * 1530.0, 2))')} AS mse,
  {r_sig('sqrt(avg(POWER(l_extendedprice - l_quantity * 1530.0, 2)))')} AS rmse,
  {r('1 - sum(POWER(l_extendedprice - l_quantity * 1530.0, 2)) / (var_pop(l_extendedprice) * count(*))')} AS r2_score
FROM lineitem""")
def q_eval_regression(spark, sf):
    return rnd(E.eval_regression(_reg_pred(spark, sf)), sig=("mse", "rmse"))


@register("eval_actual_vs_predicted", """
SELECT l_extendedprice AS actual, l_quantity * 1530.0 AS predicted,
  (SELECT least(min(l_extendedprice), min(l_quantity * 1530.0)) FROM lineitem) AS line_min,
  (SELECT greatest(max(l_extendedprice), max(l_quantity * 1530.0)) FROM lineitem) AS line_max FROM lineitem""")
def q_eval_actual_vs_predicted(spark, sf):
    return E.eval_actual_vs_predicted(_reg_pred(spark, sf))


# ---- predictions, splits, importances and metrics themselves

def _gini(n, n1):
    return f"(({n} - {n1}) * CAST({n} - {n1} AS DOUBLE) + {n1} * CAST({n1} AS DOUBLE)) / {n}"


def _tree_sql(depth=3, least=10, bins=64):
    """CTEs of a tree grown level by level on the train rows: splits s0, s1, ... and rows r0, r1, ... with their node."""
    long = " UNION ALL ".join(f"SELECT {j} AS f, {c} AS v FROM sp WHERE NOT is_test" for j, c in enumerate(ORD_TREE))
    out = f"""WITH sp AS MATERIALIZED (SELECT * FROM {_ORD_SPLIT}),
vc AS (SELECT f, v, count(*) AS k FROM ({long}) GROUP BY f, v),
rk AS (SELECT f, v, k, sum(k) OVER (PARTITION BY f ORDER BY v) - k AS before, sum(k) OVER (PARTITION BY f) AS n,
  count(*) OVER (PARTITION BY f) AS d, max(v) OVER (PARTITION BY f) AS top FROM vc),
cuts AS MATERIALIZED (SELECT f, v AS cut FROM rk WHERE v < top AND (d <= {bins} OR floor(before * {bins} / n) < floor((before + k) * {bins} / n))),
r0 AS MATERIALIZED (SELECT o_orderkey, is_test, CAST(label AS BIGINT) AS label, [{", ".join(ORD_TREE)}] AS x, 1 AS node FROM sp)"""
    for d in range(depth):
        out += f""",
t{d} AS (SELECT node, count(*) AS n, sum(label) AS n1 FROM r{d} WHERE NOT is_test AND node >= {1 << d} GROUP BY node HAVING count(*) >= {least}),
l{d} AS (SELECT r.node, c.f, c.cut, count(*) AS nl, sum(r.label) AS l1 FROM r{d} r JOIN cuts c ON r.x[c.f + 1] <= c.cut
  WHERE NOT r.is_test GROUP BY 1, 2, 3),
s{d} AS MATERIALIZED (SELECT node, f, cut, n, gain FROM (SELECT t.node, f, cut, n, {_gini('n', 'n1')} AS whole,
    {_gini('nl', 'l1')} + {_gini('(n - nl)', '(n1 - l1)')} - {_gini('n', 'n1')} AS gain FROM l{d} JOIN t{d} t USING (node) WHERE nl < n)
  QUALIFY row_number() OVER (PARTITION BY node ORDER BY gain DESC, f, cut) = 1 AND gain > 1e-9 * greatest(1, whole)),
r{d + 1} AS MATERIALIZED (SELECT o_orderkey, is_test, label, x, CASE WHEN s.f IS NULL THEN r.node
  ELSE 2 * r.node + CAST(r.x[s.f + 1] > s.cut AS INTEGER) END AS node FROM r{d} r LEFT JOIN s{d} s ON s.node = r.node)"""
    return out


ORD_TREE = ["o_custkey", "o_totalprice", "o_orderstatus", "o_orderpriority"]


def _ord_split(spark, sf):
    prep, feats = _prep(spark, sf)
    split = pin(M.ml_split(prep, ORD_KEY))
    return split.where(~F.col("is_test")), split.where(F.col("is_test")), feats


@register("clf_tree_splits", _tree_sql() + " " + " UNION ALL ".join(
    f"SELECT node, [{', '.join(repr(c) for c in ORD_TREE)}][f + 1] AS feature, {r('cut')} AS threshold, CAST(n AS BIGINT) AS rows, {r('gain')} AS gain "
    f"FROM s{d}" for d in range(3)))
def q_clf_tree_splits(spark, sf):
    train, _, feats = _ord_split(spark, sf)
    model = T.fit(train, feats, classes=2, **M.TREES["Decision Tree"])
    # at most 2 ** depth - 1 rows
    return rnd(local_table(spark, [s[2:] for s in model.splits()], "node int, feature string, threshold double, rows long, gain double"))


@register("clf_tree_predictions", _tree_sql() + """,
leaf AS (SELECT node, CAST(sum(label) * 2 > count(*) AS DOUBLE) AS prediction FROM r3 WHERE NOT is_test GROUP BY node)
SELECT o_orderkey, CAST(label AS DOUBLE) AS label, prediction FROM r3 JOIN leaf USING (node) WHERE is_test""")
def q_clf_tree_predictions(spark, sf):
    return _fit(spark, sf, "Decision Tree")[0]


_BAYES_F = ", ".join(f"avg({c}) AS m{j}, var_pop({c}) AS v{j}" for j, c in enumerate(ORD_TREE))
_BAYES_TERM = " + ".join(f"ln(2 * pi() * (v{j} + eps)) + ({c} - m{j}) * ({c} - m{j}) / (v{j} + eps)" for j, c in enumerate(ORD_TREE))


@register("clf_bayes_predictions", f"""
WITH sp AS MATERIALIZED (SELECT * FROM {_ORD_SPLIT}), tr AS (SELECT * FROM sp WHERE NOT is_test),
e AS (SELECT 1e-9 * greatest({', '.join(f'var_samp({c})' for c in ORD_TREE)}) AS eps, count(*) AS n FROM tr),
p AS (SELECT label AS y, ln(count(*)) AS nc, {_BAYES_F} FROM tr GROUP BY label)
SELECT o_orderkey, label, y AS prediction FROM (SELECT o_orderkey, label, y, nc - ln(n) - 0.5 * ({_BAYES_TERM}) AS score
  FROM sp, p, e WHERE is_test) QUALIFY row_number() OVER (PARTITION BY o_orderkey ORDER BY score DESC, y) = 1""")
def q_clf_bayes_predictions(spark, sf):
    return _fit(spark, sf, "Naive Bayes")[0]


@register("clf_predictions")
def q_clf_predictions(spark, sf):
    """algorithm, o_orderkey, label, prediction of every test row, for the classifiers that SQL cannot follow."""
    train, test, feats = _ord_split(spark, sf)
    names = ("Logistic Regression", "Random Forest", "Gradient Boosting", "SVM", "Neural Network")
    return reduce(DataFrame.unionByName, M.fit_predict_each(names, "classification", train, test, feats, ORD_KEY))


@register("clf_mlp_probabilities")
def q_clf_mlp_probabilities(spark, sf):
    """o_orderkey, label, prediction and the chance of each class, of every test row."""
    train, test, feats = _ord_split(spark, sf)
    return _chances(network.fit_network(train, feats, 2).transform(test))


@register("clf_svm_probabilities")
def q_clf_svm_probabilities(spark, sf):
    train, test, feats = _ord_split(spark, sf)
    return _chances(calibrate.fit_calibrated(train, feats, 2).transform(test))


def _chances(pred):
    return rnd(pred.select("o_orderkey", "label", "prediction", F.col("probability")[0].alias("p_0"), F.col("probability")[1].alias("p_1")))


@register("ml_feature_importance_values")
def q_ml_feature_importance_values(spark, sf):
    _, model, feats = _fit(spark, sf, "Random Forest")
    return M.ml_feature_importance(model, feats, spark)


@register("ml_feature_importance", "SELECT 4 AS features, 1.0::DOUBLE AS total, 'o_totalprice' AS first, true AS sorted")
def q_ml_feature_importance(spark, sf):
    _, model, feats = _fit(spark, sf, "Random Forest")
    rows = M.ml_feature_importance(model, feats, spark).agg(
        F.count(F.lit(1)).cast("int").alias("features"), F.round(F.sum("importance"), 6).alias("total"),
        F.max_by("feature", "importance").alias("first"), F.collect_list("importance").alias("i"))
    return rows.select("features", "total", "first", (F.col("i") == F.reverse(F.array_sort("i"))).alias("sorted"))


def _run(spark, sf):
    return M.ml_run(orders_cls(spark, sf), "price_class", ORD_KEY, "Decision Tree", "classification", ORD_FEATS)


@register("ml_run_metrics", _tree_sql() + """,
leaf AS (SELECT node, CAST(sum(label) * 2 > count(*) AS BIGINT) AS p FROM r3 WHERE NOT is_test GROUP BY node),
pr AS (SELECT label AS y, p, count(*) AS n FROM r3 JOIN leaf USING (node) WHERE is_test GROUP BY 1, 2),
per AS (SELECT c, coalesce((SELECT sum(n) FROM pr WHERE y = c), 0) AS support, coalesce((SELECT sum(n) FROM pr WHERE p = c), 0) AS predicted,
  coalesce((SELECT sum(n) FROM pr WHERE y = c AND p = c), 0) AS tp FROM (VALUES (0), (1)) v(c)),
m AS (SELECT *, CASE WHEN predicted > 0 THEN tp / predicted ELSE 0.0 END AS prec, CASE WHEN support > 0 THEN tp / support ELSE 0.0 END AS rec FROM per)
SELECT 'Decision Tree' AS algorithm, (SELECT count(*) FROM r0 WHERE NOT is_test) AS train_size, (SELECT count(*) FROM r0 WHERE is_test) AS test_size,
""" + f"""  {r('sum(tp) / sum(support)')} AS accuracy, {r('sum(prec * support) / sum(support)')} AS precision,
  {r('sum(rec * support) / sum(support)')} AS recall,
  {r('sum(CASE WHEN prec + rec > 0 THEN 2 * prec * rec / (prec + rec) ELSE 0.0 END * support) / sum(support)')} AS f1_score FROM m""")
def q_ml_run_metrics(spark, sf):
    return rnd(_run(spark, sf)[0].select("algorithm", F.col("train_size").cast("long").alias("train_size"),
                                         F.col("test_size").cast("long").alias("test_size"), "accuracy", "precision", "recall", "f1_score"))


@register("ml_run", f"""
SELECT 'Decision Tree' AS algorithm, 'classification' AS problem_type, count(*) FILTER (WHERE NOT is_test) AS train_size,
  count(*) FILTER (WHERE is_test) AS test_size, true AS metrics_in_range, true AS beats_majority FROM {_ORD_SPLIT}""")
def q_ml_run(spark, sf):
    metrics, pred, _ = _run(spark, sf)
    scores = ["accuracy", "precision", "recall", "f1_score"]
    row = metrics.select("algorithm", "problem_type", F.col("train_size").cast("long").alias("train_size"),
                         F.col("test_size").cast("long").alias("test_size"),
                         F.least(*scores).between(0, 1).alias("metrics_in_range"))
    return row.join(F.broadcast(_check(pred).select("beats_majority")))  # one row each


# the tree can tell the class where the price is known, and answers the commoner class where it is not
_RULE_ACC = f"""(SELECT avg(CASE WHEN (label = 0) = known_high THEN 1.0 ELSE 0.0 END) AS accuracy FROM (
  SELECT s.label, CASE WHEN o.o_orderkey % 3 = 0 THEN o.o_totalprice > 100000 ELSE (SELECT count(*) FILTER (
    WHERE o_totalprice > 100000) * 2 >= count(*) FROM orders WHERE o_orderkey % 3 <> 0) END AS known_high
  FROM {_ORD_SPLIT} s JOIN orders o USING (o_orderkey) WHERE s.is_test))"""


@register("ml_findings", f"""
SELECT CASE WHEN accuracy > 0.9 THEN 'Excellent performance' WHEN accuracy > 0.8 THEN 'Good performance'
  WHEN accuracy > 0.7 THEN 'Moderate performance' ELSE 'Poor performance' END || ' achieved with Decision Tree'
  AS performance_assessment,
  CASE WHEN accuracy > 0.9 THEN 'Model is ready for deployment' WHEN accuracy > 0.8 THEN 'Consider minor tuning for improvement'
  WHEN accuracy > 0.7 THEN 'Try feature engineering or different algorithms'
  ELSE 'Needs significant improvement - check data quality' END AS recommendation,
  'No feature importance available' AS feature_insights FROM {_RULE_ACC}""")
def q_ml_findings(spark, sf):
    metrics, _, _ = _run(spark, sf)
    return E.ml_findings(metrics, "classification", "Decision Tree")

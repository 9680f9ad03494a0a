"""Registry of named queries: a Spark callable and (when SQL can express it) a DuckDB oracle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
DIGITS = 6


def register(name: str, sql: str | None = None):
    def deco(fn):
        if name in QUERIES:
            raise KeyError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql.strip()
        return fn
    return deco


def t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return table(spark, sf_dir, name)


def round_sig(c, digits: int = 10):
    """Round to ``digits`` significant digits with exact powers of ten only (same IEEE steps as the
    oracle's ``r_sig``): large float aggregates keep their last-digit noise below the grid."""
    e = F.floor(F.log10(F.abs(c))) - (digits - 1)
    up = F.round(c / F.pow(F.lit(10.0), e)) * F.pow(F.lit(10.0), e)
    down = F.round(c * F.pow(F.lit(10.0), -e)) / F.pow(F.lit(10.0), -e)
    return F.when(c.isNull() | (c == 0), c).when(e >= 0, up).otherwise(down)


def rnd(df: DataFrame, digits: int = DIGITS, exact: tuple[str, ...] = (), sig: tuple[str, ...] = ()) -> DataFrame:
    """Round every float column so both engines agree on the last digits of float sums.

    Columns in ``exact`` hold exactly computed decimals (e.g. means from decimal sums): they are
    rounded half-up on their decimal value, as the oracle does with integer arithmetic.
    """
    out = []
    for f in df.schema.fields:
        if f.name in sig:
            out.append(round_sig(F.col(f.name).cast("double")).alias(f.name))
        elif f.name in exact:
            dec = F.col(f.name).cast("string").try_cast("decimal(38,12)")
            out.append(F.coalesce(F.round(dec, digits).cast("double"), F.round(F.col(f.name), digits)).alias(f.name))
        elif isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            out.append(F.round(F.col(f.name).cast("double"), digits).alias(f.name))
        else:
            out.append(F.col(f.name))
    return df.select(*out)


# Derived inputs, built the same way in the oracle SQL (see FIXTURES.md).
def events_with_nulls(spark, sf):
    e = t(spark, sf, "events")
    return e.select("event_id", "ts", "user_id", "event_type",
                    F.when(F.col("event_id") % 7 == 0, None).otherwise(F.col("value")).alias("value"), "props")


EVENTS_NULLS_SQL = """(SELECT event_id, ts, user_id, event_type,
  CASE WHEN event_id % 7 = 0 THEN NULL ELSE value END AS value, props FROM events)"""


def customer_with_nulls(spark, sf):
    c = t(spark, sf, "customer")
    return c.select("c_custkey", "c_name", "c_nationkey", "c_acctbal",
                    F.when(F.col("c_custkey") % 5 == 0, None).otherwise(F.col("c_mktsegment")).alias("c_mktsegment"))


CUSTOMER_NULLS_SQL = """(SELECT c_custkey, c_name, c_nationkey, c_acctbal,
  CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE c_mktsegment END AS c_mktsegment FROM customer)"""


def orders_sparse(spark, sf):
    o = t(spark, sf, "orders")
    return o.select("o_orderkey", "o_custkey", "o_orderstatus",
                    F.when(F.col("o_orderkey") % 3 != 0, None).otherwise(F.col("o_totalprice")).alias("o_totalprice"),
                    "o_orderdate", "o_orderpriority")


ORDERS_SPARSE_SQL = """(SELECT o_orderkey, o_custkey, o_orderstatus,
  CASE WHEN o_orderkey % 3 <> 0 THEN NULL ELSE o_totalprice END AS o_totalprice,
  o_orderdate, o_orderpriority FROM orders)"""


def events_dup(spark, sf):
    e = t(spark, sf, "events")
    return e.unionByName(e.where(F.col("event_id") % 50 == 0))


EVENTS_DUP_SQL = "(SELECT * FROM events UNION ALL SELECT * FROM events WHERE event_id % 50 = 0)"

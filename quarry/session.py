"""Session helpers: one place that knows about configuration and the checkpoint folder."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def get_spark(master: str | None = None, shuffle_partitions: int | None = None,
              app_name: str = "quarry") -> SparkSession:
    """Build (or reuse) a session with the settings every operator assumes.

    On a cluster the caller's configuration wins: we only fill in values that are unset.
    """
    b = SparkSession.builder.appName(app_name)
    if master:
        b = b.master(master)
    conf = {
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder, honouring ``spark.checkpoint.dir``.

    A folder of our own is only created in local mode (tests); on a cluster the job must be
    given a shared folder, because a machine-local one does not survive executor loss.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf_dir = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if conf_dir:
        sc.setCheckpointDir(conf_dir)
        return sc.getCheckpointDir()
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a shared folder before running on a cluster")
    path = tempfile.mkdtemp(prefix="quarry-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
    sc.setCheckpointDir(path)
    return sc.getCheckpointDir()


def pin(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the checkpoint folder and cut its lineage.

    Used where later steps depend on a partition layout (``spark_partition_id``) that must not
    change if a stage is recomputed after an executor is lost.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame, name: str = "table") -> DataFrame:
    """``df`` written to the checkpoint folder as compressed columns and read back: its lineage is cut.

    Takes a fraction of what ``pin`` takes on disk, and later steps read only their columns. Partitions are the
    reader's, so use ``pin`` where a layout must not change.
    """
    path = f"{ensure_checkpoint_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, min_partitions: int | None = None) -> DataFrame:
    """Round-robin repartition only when a bare file scan has fewer splits than the cluster has cores.

    A large input already arrives in thousands of splits (no-op, no shuffle); a small file with
    one row group would otherwise run its whole map side, e.g. text parsing, in one task. Call it
    on a scan only: on a plan with a shuffle, counting partitions would run that shuffle.
    """
    want = min_partitions or df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(want) if df.rdd.getNumPartitions() < want else df


def local_table(spark: SparkSession, rows, schema) -> DataFrame:
    """A small table from driver-side rows as one local relation (an Arrow table, no expression per cell).

    Only for tables bounded by the schema or the partition count: columns, classes, statistics.
    """
    import pyarrow as pa
    from pyspark.sql import types as T
    from pyspark.sql.pandas.types import to_arrow_schema
    st = schema if isinstance(schema, T.StructType) else T._parse_datatype_string(schema)
    st = T.StructType([T.StructField(f.name, f.dataType) for f in st.fields])
    if not rows:
        return spark.createDataFrame([], st)
    arrow = to_arrow_schema(st)
    cols = list(zip(*rows))
    return spark.createDataFrame(pa.table([pa.array(list(c), f.type) for c, f in zip(cols, arrow)], schema=arrow), st)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table by name. ``quarry.spread`` (off unless the session sets it) spreads files of one split."""
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    return spread(df) if spark.conf.get("quarry.spread", "false") == "true" else df

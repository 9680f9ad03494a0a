"""Batched calls to an external text model, with the rule's answer where the model gives none.

``mapInArrow`` streams batches of texts through a caller-supplied ``provider(list[str])``, which returns a list of
dicts (or that list as JSON text), one answer a text. Every row carries its own rule answer, computed by the native
expressions of ``operators.text``; the provider's answer replaces it, and ``answered_by`` says which one a row holds.

With a ``store``, a folder that all executors see, equal texts are sent once and an answer is never asked for again: a
task writes each call's answers to the store's journal as they come, so a retried task reads them there; when all calls
are done Spark writes the answers under their texts' hashes and the journal goes. Later runs read them and send new texts only.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyarrow import fs as files
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from .text import TASKS, _keys, texts

Provider = Callable[[list[str]], "list[dict] | str"]

# texts per provider call for each task (fixed values)
BATCH_SIZES = {"sentiment": 10, "classification": 10, "entity_extraction": 5, "summarization": 1,
               "language_detection": 20, "keyword_extraction": 1}

#: fields of an answer; the rule operators return columns of these names
OUTPUT = {
    "sentiment": "sentiment string, confidence double",
    "classification": "category string, confidence double",
    "entity_extraction": "entities array<struct<entity:string,type:string,start:int,end:int>>",
    "summarization": "summary string, compression_ratio double",
    "language_detection": "language string, language_code string, confidence double",
    "keyword_extraction": "keywords array<string>, phrases array<string>",
}


def parse_answers(raw, n: int) -> list[dict] | None:
    """The n answers of a call (JSON text or a list of dicts); None if they are not that."""
    if isinstance(raw, (str, bytes)):
        try:
            raw = json.loads(raw)
        except ValueError:
            return None
    if isinstance(raw, dict):
        raw = [raw]
    return raw if isinstance(raw, list) and len(raw) == n and all(isinstance(a, dict) for a in raw) else None


def _folder(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


class Journal:
    """Answers of single calls, each in a file named after the call's texts. Used inside tasks."""

    def __init__(self, folder: str):
        if folder.startswith("file:/") and not folder.startswith("file://"):
            folder = "file://" + folder.removeprefix("file:")
        self.fs, self.folder = files.FileSystem.from_uri(folder)
        self.fs.create_dir(self.folder, recursive=True)

    def path(self, hashes: Sequence[str]) -> str:
        return f"{self.folder}/{hashlib.sha256(','.join(hashes).encode()).hexdigest()}"

    def get(self, hashes: Sequence[str]) -> list[pa.Array] | None:
        path = self.path(hashes)
        if self.fs.get_file_info(path).type == files.FileType.NotFound:
            return None
        with self.fs.open_input_file(path) as f:
            return pa.ipc.open_stream(f).read_all().combine_chunks().to_batches()[0].columns

    def put(self, hashes: Sequence[str], answers: list[pa.Array]) -> None:
        path = self.path(hashes)
        part = f"{path}.{uuid.uuid4().hex}"  # a half-written file is never taken for an answer
        batch = pa.RecordBatch.from_arrays(answers, [str(i) for i in range(len(answers))])
        with self.fs.open_output_stream(part) as f, pa.ipc.new_stream(f, batch.schema) as out:
            out.write_batch(batch)
        self.fs.move(part, path)


def _stored(asked: DataFrame, ask: Callable[[list[str]], "list[pa.Array] | None"], fields: Sequence[T.StructField], size: int,
            store: str) -> DataFrame:
    """_h, <fields> of every text of ``asked`` (_h, _text) that the provider has answered, now or in an earlier run."""
    spark = asked.sparkSession
    done, journal = f"{store.rstrip('/')}/answers", f"{store.rstrip('/')}/journal"
    schema = T.StructType([T.StructField("_h", T.StringType()), *fields])
    names = [f.name for f in schema.fields]
    asked = asked.dropDuplicates(["_h"])
    fs, at = _folder(spark, done)
    if fs.exists(at):
        asked = asked.join(spark.read.schema(schema).parquet(done).select("_h"), "_h", "left_anti")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        told = Journal(journal)
        for batch in batches:
            for start in range(0, batch.num_rows, size):
                rows = batch.slice(start, size)
                hashes = rows.column(0).to_pylist()
                got = told.get(hashes)
                if got is None:
                    got = ask(rows.column(1).to_pylist())
                    if got is None:  # nothing is stored: a later run asks again
                        continue
                    told.put(hashes, got)
                yield pa.RecordBatch.from_arrays([rows.column(0), *got], names)

    # a fixed number of parts in the order of the hashes: a retried task makes the same calls
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    asked.repartition(tasks, "_h").sortWithinPartitions("_h").mapInArrow(run, schema).write.mode("append").parquet(done)
    fs, at = _folder(spark, journal)
    fs.delete(at, True)
    return spark.read.schema(schema).parquet(done).dropDuplicates(["_h"])  # two runs at a time may both have asked


def batch_inference(df: DataFrame, key: str | Sequence[str], text: str, task: str, provider: Provider | None = None,
                    batch_size: int | None = None, store: str | None = None) -> DataFrame:
    """key..., <task fields>, answered_by ('model' or 'rule'): one provider call per ``batch_size`` texts.

    A call that raises, or whose answer is not one object a text with values of the right types, leaves its
    batch to the rule. Without a ``store`` the provider is called whenever the result is computed, once a row. With one
    (a folder of this task and provider only) it is called at once, for texts that the store does not hold; a text
    may be sent twice only where two attempts of a task run at the same time, or an executor is lost within a call.
    """
    if task not in OUTPUT:
        raise ValueError(f"no model output schema for task {task!r}")
    ks = _keys(key)
    fields = T._parse_datatype_string(OUTPUT[task]).fields
    size = batch_size or BATCH_SIZES[task]
    t = texts(df, key, text).select(*ks, F.col("text"), F.col("text").alias("_text"))
    ruled = TASKS[task](t, [*ks, "_text"], "text").select(
        *ks, "_text", *[F.col(f.name).cast(f.dataType).alias(f.name) for f in fields])
    if provider is None:
        return ruled.select(*ks, *[f.name for f in fields], F.lit("rule").alias("answered_by"))
    kinds = [to_arrow_type(f.dataType) for f in fields]

    def ask(items: list[str]) -> list[pa.Array] | None:
        try:
            answers = parse_answers(provider(items), len(items))
            return answers and [pa.array([a.get(f.name) for a in answers], k) for f, k in zip(fields, kinds)]
        except Exception:  # noqa: BLE001 - the rule answers this batch, and answered_by says so
            return None

    if store is not None:
        asked = t.select(F.sha2("text", 256).alias("_h"), F.col("text").alias("_text"))
        told = _stored(asked, ask, fields, size, store).select("_h", F.struct(*[f.name for f in fields]).alias("_told"))
        held = F.col("_told").isNotNull()
        return ruled.withColumn("_h", F.sha2("_text", 256)).join(told, "_h", "left").select(
            *ks, *[F.when(held, F.col("_told")[f.name]).otherwise(F.col(f.name)).alias(f.name) for f in fields],
            F.when(held, "model").otherwise("rule").alias("answered_by"))

    def run(batches):
        at = len(ks)
        for batch in batches:
            for start in range(0, batch.num_rows, size):
                rows = batch.slice(start, size)
                got = ask(rows.column(at).to_pylist())
                values = got or [c.cast(k) for c, k in zip(rows.columns[at + 1:], kinds)]
                by = pa.array(["model" if got else "rule"] * rows.num_rows)
                yield pa.RecordBatch.from_arrays([*rows.columns[:at], *values, by], names)

    schema = T.StructType([*[t.schema[k] for k in ks], *fields, T.StructField("answered_by", T.StringType())])
    names = [f.name for f in schema.fields]
    return ruled.mapInArrow(run, schema)

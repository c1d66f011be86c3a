"""Tables that outlive a lost executor, and the tables that the queries read."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LONG_MAX = (1 << 63) - 1
#: Rows of one Arrow batch.
BATCH_ROWS = 2048


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where it is unset, a local master gets a temporary folder; a cluster must name one."""
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if folder is None:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="permaway-llm-"))
        folder = sc.getCheckpointDir()
    return folder.rstrip("/")


def durable(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet under the shared folder and read it back: lineage is cut, and no executor holds the only copy."""
    folder = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


class Scratch:
    """Durable tables of one operator. `result` writes the last one and removes the others, so that none outlives its use."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.folders = spark, []

    def table(self, df: DataFrame, name: str) -> DataFrame:
        folder = f"{shared_folder(self.spark)}/{name}-{uuid.uuid4().hex}"
        self.folders.append(folder)
        df.write.parquet(folder)
        return self.spark.read.schema(df.schema).parquet(folder)

    def drop(self) -> None:
        """Remove the tables written so far."""
        for folder in self.folders:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
        self.folders = []

    def result(self, df: DataFrame, name: str) -> DataFrame:
        done = durable(df, name)
        self.drop()
        return done


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def map_batches(df: DataFrame, work: Callable[[pa.RecordBatch], Iterator[dict]], schema: str) -> DataFrame:
    """Rows of `work` for each Arrow batch of df; `work` yields columns by name. schema: "name type, name type"."""
    names = [x.split(" ")[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for columns in work(batch):
                yield pa.RecordBatch.from_arrays([columns[x] if isinstance(columns[x], pa.Array) else pa.array(columns[x]) for x in names], names)

    return df.mapInArrow(run, schema)


def text_column(work: Callable[..., Iterator[dict]], schema: str) -> Callable[..., Column]:
    """A struct column of what `work` yields, in order, for an Arrow array of texts and others of the same length."""
    names = [x.split(" ")[0] for x in schema.split(", ")]

    @F.arrow_udf(schema)
    def run(texts: pa.Array, *others: pa.Array) -> pa.Array:
        parts = list(work(texts, *others)) if len(texts) else []
        if not parts:
            return pa.StructArray.from_arrays([pa.array([], kinds[x]) for x in names], names)
        return pa.StructArray.from_arrays([pa.concat_arrays([part[x] for part in parts]) for x in names], names)

    kinds = {x.split(" ")[0]: {"long": pa.int64(), "double": pa.float64(), "string": pa.string()}[x.split(" ")[1]] for x in schema.split(", ")}
    return run


def list_array(offsets, values: pa.Array) -> pa.Array:
    """An array column from the offsets of its rows in the values."""
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values)


def short_batches(spark: SparkSession) -> None:
    """Let workers take at most BATCH_ROWS rows at once in this session: rows hold texts, and a batch is held several times over."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


def text_of(documents: DataFrame) -> DataFrame:
    """Only the columns that operators use, so that others cannot clash with theirs."""
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def text_hash() -> Column:
    """Tells rows apart that repeat an id."""
    return F.xxhash64(F.col("text").cast("string"))

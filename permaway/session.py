"""Session settings, chunk sizes and durable intermediate tables."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession

# Bytes of input that a range chunk stands for (see operators.scan and operators.fold): at least, and at most where that
# would make more chunks than MOST_CHUNKS, as each leaves a state.
CHUNK_BYTES, LARGE_CHUNK_BYTES, MOST_CHUNKS = 32 << 20, 1 << 30, 20_000


def build_session(app: str = "permaway", cores: str = "*") -> SparkSession:
    """A local session with the settings the library expects."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        # Without call sites per column, building a wide plan is several times faster.
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.driver.memory", "16g")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )


def chunk_count(df: DataFrame, size: int | None = None) -> int:
    """How many range chunks the rows of ``df`` are cut into: by the bytes its plan reads, which costs no job.

    At least one for each shuffle partition; ``spark.permaway.chunks`` sets another number. ``size`` sets a chunk's bytes.
    """
    conf = df.sparkSession.conf
    fixed = conf.get("spark.permaway.chunks", None)
    if fixed:
        return int(fixed)
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(leaves.apply(i).stats().sizeInBytes()) for i in range(leaves.size())]
    known = sum(x for x in sizes if x < 1 << 60)  # a leaf without statistics counts as nothing
    return max(int(conf.get("spark.sql.shuffle.partitions", "200")), -(-known // (size or chunk_bytes(known))))


def chunk_bytes(known: int) -> int:
    """Bytes of a chunk of an input of so many bytes."""
    return min(max(CHUNK_BYTES, -(-known // MOST_CHUNKS)), LARGE_CHUNK_BYTES)


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder of the cluster; a temporary one only on a local master."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    path = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        path = tempfile.mkdtemp(prefix="permaway-checkpoint-")
    sc.setCheckpointDir(path)
    return path


def durable(df: DataFrame) -> DataFrame:
    """Write ``df`` to the checkpoint folder and cut its lineage.

    The partitions of the result are the partitions of ``df`` in the same
    order, and a lost executor re-reads them instead of computing them anew.
    """
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)

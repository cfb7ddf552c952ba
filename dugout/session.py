"""Session defaults and lineage cutting."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "dugout", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the defaults that this package assumes (ANSI on, UTC, AQE on)."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
        "spark.ui.enabled": "false",
    }
    for k, v in {**defaults, **conf}.items():
        b = b.config(k, v)
    return b.getOrCreate()


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder; a folder of our own only where none is set and all tasks run on this machine."""
    sc = spark.sparkContext
    have = sc.getCheckpointDir()
    if have:
        return have
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        d = tempfile.mkdtemp(prefix="dugout-checkpoint-")
    sc.setCheckpointDir(d)
    return d


@contextmanager
def _tidy(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of what is planned and run within are deleted as soon as it has run, instead of when the driver happens to collect its garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder and forget its lineage."""
    ensure_checkpoint_dir(df.sparkSession)
    with _tidy(df.sparkSession):
        return df.select("*").checkpoint(eager=True)  # planned anew, or the setting would come too late


def spread(df: DataFrame) -> DataFrame:
    """``df`` over at least as many partitions as there are cores, before a CPU-bound step. An input that already has
    them, as every large one does, is left as it is; only a small one is shuffled."""
    n = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= n else df.repartition(n)


def evenly(df: DataFrame) -> DataFrame:
    """``cut(df)`` over at least as many partitions as there are cores, for a frame that a model passes over many times: AQE packs
    the last shuffle of a small one into a single partition, and the fit would run on one core."""
    d = cut(df)
    s = spread(d)
    return d if s is d else cut(s)


def stage(df: DataFrame) -> DataFrame:
    """``df`` written as a table in the shared checkpoint folder and read back: like ``cut``, but packed and read by
    column, for wide frames that are read several times."""
    path = f"{ensure_checkpoint_dir(df.sparkSession).rstrip('/')}/table-{uuid.uuid4().hex}"
    with _tidy(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def unsent(df: DataFrame) -> DataFrame:
    """``df`` marked for joins by sort-merge, never through the driver. For frames that grow with the data and of whose size the planner knows too little
    to broadcast them: it takes exploded rows, and those of a Python step, for as small as what they come from, and a packed table for its size in the file."""
    return df.hint("merge")


def long_rows(spark: SparkSession, most: int = 1000) -> None:
    """Fewer rows in an Arrow batch, for steps whose rows may be long texts; a smaller setting is kept."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    have = int(spark.conf.get(key, "10000"))
    if have <= 0 or have > most:
        spark.conf.set(key, str(most))


def slices(texts: list[str], characters: int = 4_000_000) -> Iterator[tuple[int, int]]:
    """(first, behind the last) of runs of texts of at most so many characters in all, or of one longer text."""
    first, size = 0, 0
    for i, t in enumerate(texts):
        if i > first and size + len(t) > characters:
            yield first, i
            first, size = i, 0
        size += len(t)
    if first < len(texts):
        yield first, len(texts)

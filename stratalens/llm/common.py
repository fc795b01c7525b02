"""What several operators share: tables in the shared folder, bounded batches, measured broadcasts."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: What join_small() broadcasts at most.
BROADCAST_BYTES = 8 << 20
#: Bounds of an Arrow batch.
BATCH_ROWS, BATCH_BYTES = 1000, 4 << 20
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_own: dict[str, str] = {}
#: Tables of stored() and stored_buckets(): name in the catalogue, if any, by path.
_written: dict[str, str] = {}
MAX_BUCKETS = 100_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or in local mode, where that is unset, one of our own."""
    if found := spark.conf.get("spark.checkpoint.dir", None):
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if "dir" not in _own:
        _own["dir"] = tempfile.mkdtemp(prefix="stratalens-")
        atexit.register(shutil.rmtree, _own["dir"], True)
    return "file://" + _own["dir"]


def new_path(spark: SparkSession, name: str) -> str:
    """A new place in the shared folder."""
    path = f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    _written[path] = ""
    return path


@contextmanager
def _cleaned(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of a write go when it ends; nothing reads them again."""
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEANUP, before)


def stored(df: DataFrame, name: str) -> DataFrame:
    """`df` written as Parquet in the shared folder and read back: lineage ends there, and a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = new_path(spark, name)
    with _cleaned(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def stored_buckets(df: DataFrame, name: str, by: list[str]) -> DataFrame:
    """`df` written in buckets by the hash of columns: joins on these columns do not move it again.

    There are as many buckets as the session has shuffle partitions, at most MAX_BUCKETS.
    """
    spark = df.sparkSession
    n = min(MAX_BUCKETS, max(1, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    path, table_name = new_path(spark, name), f"stratalens_{uuid.uuid4().hex}"
    with _cleaned(spark):
        df.repartition(n, *by).write.format("parquet").option("compression", "zstd").bucketBy(n, *by).option("path", path).saveAsTable(table_name)
    _written[path] = table_name
    return spark.table(table_name)


@contextmanager
def collecting() -> Iterator[list[str]]:
    """Gives, once left, the paths of the tables written inside."""
    before, found = set(_written), []
    yield found
    found += [p for p in _written if p not in before]


def settle(spark: SparkSession, before: set[str], *keep: DataFrame) -> None:
    """Deletes the tables written since `before` (a snapshot of written()) that none of `keep` reads: what a long operator is done with."""
    release(spark, [p for p in _written if p not in before], *keep)


def written() -> set[str]:
    return set(_written)


def release(spark: SparkSession, paths: list[str], *keep: DataFrame) -> None:
    """Deletes tables of stored(), stored_buckets() and new_path(), but those that one of `keep` reads; `paths` keeps what stays."""
    used = [f for d in keep for f in d.inputFiles()] if paths else []
    held = {f.rsplit("/", 1)[0].split("/")[-1] for f in used}
    for path in [p for p in paths if p.split("/")[-1] not in held]:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        if name := _written.pop(path, ""):
            spark.sql(f"DROP TABLE IF EXISTS {name}")
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
        paths.remove(path)


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of at most BATCH_ROWS rows and BATCH_BYTES bytes, where the session has not chosen smaller ones: whole texts are long."""
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        now = spark.conf.get(key)
        if not str(now).isdigit() or int(now) > most or int(now) <= 0:
            spark.conf.set(key, str(most))


def in_arrow(df: DataFrame, rows, schema: str) -> DataFrame:
    """df.mapInArrow in small batches."""
    small_batches(df.sparkSession)
    return df.mapInArrow(rows, schema)


def bytes_of(df: DataFrame) -> int:
    """The bytes of a table's values, from one aggregation: lengths of strings and binaries, 8 for any other."""
    wide = [c for c, t in df.dtypes if t in ("string", "binary")]
    each = sum((F.coalesce(F.octet_length(c), F.lit(0)) for c in wide), F.lit(8 * len(df.columns)))
    return df.select(each.cast("long").alias("n")).agg(F.sum("n")).first()[0] or 0


def join_small(big: DataFrame, small: DataFrame, on: list[str], how: str = "left", max_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Join that broadcasts `small` only when its measured bytes are at most `max_bytes`; beyond that it shuffles both sides."""
    if bytes_of(small) <= max_bytes:
        small = F.broadcast(small)
    return big.join(small, on, how)

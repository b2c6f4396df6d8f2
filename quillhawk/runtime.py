"""Session, staging and size-checked join helpers shared by every operator."""

from __future__ import annotations

import hashlib
import io
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A join side is broadcast only when its counted rows stay at or below this.
BROADCAST_ROWS = 2_000_000

_staged: list[str] = []
_shipped: set[str] = set()
_own_dirs: dict[str, str] = {}
_files: dict[tuple[str, str], str] = {}


def local_session(cpus: str = "8", memory: str = "8g") -> SparkSession:
    """A session for tests and benches; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("quillhawk")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", memory)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.adaptive.enabled", "true")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as ``spark.checkpoint.dir`` names it.

    Without that setting a local master gets a temporary folder of its own; any other master is refused, since a folder
    of one machine would lose tables with that machine.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir") or _own_dirs.get(spark.sparkContext.applicationId)
    if not found:
        if spark.sparkContext.master != "local" and not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = _own_dirs[spark.sparkContext.applicationId] = "file://" + tempfile.mkdtemp(prefix="quillhawk-")
    return found


def put_shared(spark: SparkSession, name: str, data: bytes) -> str:
    """Writes ``data`` under a fresh name in the shared folder and returns its path."""
    path = f"{shared_dir(spark)}/quillhawk/{uuid.uuid4().hex[:12]}/{name}"
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    out = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(at)
    out.write(data)
    out.close()
    return path


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors, once per application, so that Python stages can import it anywhere."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = Path(__file__).resolve().parent
    if root.is_dir() and Path(__file__).is_file():
        held = io.BytesIO()
        with zipfile.ZipFile(held, "w") as z:
            for f in sorted(root.rglob("*.py")):
                z.write(f, f.relative_to(root.parent))
        spark.sparkContext.addPyFile(put_shared(spark, f"{root.name}.zip", held.getvalue()))
    _shipped.add(app)


def ship_file(spark: SparkSession, path: str) -> str:
    """Sends a file of the driver to every executor through the shared folder, once; returns the name to open by ``shipped``."""
    key = (spark.sparkContext.applicationId, path)
    if key not in _files:
        data = Path(path).read_bytes()
        name = f"{hashlib.sha256(data).hexdigest()[:16]}-{Path(path).name}"
        spark.sparkContext.addFile(put_shared(spark, name, data))
        _files[key] = name
    return _files[key]


def shipped(name: str) -> str:
    """Where a task finds a file that ``ship_file`` sent."""
    return SparkFiles.get(name)


def map_arrow(df: DataFrame, function: Callable, schema) -> DataFrame:
    """``df.mapInArrow`` with the package sent along."""
    ship(df.sparkSession)
    return df.mapInArrow(function, schema)


#: Bytes of one shuffle partition aimed at by ``stage``.
PARTITION_BYTES = 64 << 20


#: Spark deletes a command's shuffle files as it ends, instead of when the driver collects its garbage.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stage(df: DataFrame, name: str, codec: str = "snappy", shuffled: int = 0, tidy: bool = False) -> DataFrame:
    """Writes ``df`` to the shared folder and reads it back: cuts the lineage and survives lost executors.

    With ``shuffled``, the bytes that its largest shuffle will carry, the write runs with enough shuffle partitions that
    none exceeds ``PARTITION_BYTES`` on average; adaptive execution joins those that stay small. With ``tidy`` the
    write's shuffle files are deleted at its end.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/quillhawk/{name}-{uuid.uuid4().hex[:12]}"
    before = spark.conf.get("spark.sql.shuffle.partitions")
    wanted = max(int(before), -(-shuffled // PARTITION_BYTES))
    cleanup = spark.conf.get(_CLEANUP, "false")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", str(wanted))
        if tidy:
            spark.conf.set(_CLEANUP, "true")
        df.write.option("compression", codec).parquet(path)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.set(_CLEANUP, cleanup)
    _staged.append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.staged_at = path
    return out


def unstage(*tables: DataFrame) -> None:
    """Deletes tables that ``stage`` returned, once nothing reads them any more."""
    for df in tables:
        spark = df.sparkSession
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(df.staged_at)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
        _staged.remove(df.staged_at)


def release_staged(spark: SparkSession, since: int = 0) -> None:
    """Deletes the tables staged so far, or those after the first ``since``; results that read them must have been consumed."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    while len(_staged) > since:
        path = jvm.org.apache.hadoop.fs.Path(_staged.pop())
        path.getFileSystem(conf).delete(path, True)


@contextmanager
def staging(spark: SparkSession) -> Iterator[None]:
    """A scope that owns the tables staged within it and deletes them at its end; consume or write results inside."""
    since = len(_staged)
    try:
        yield
    finally:
        release_staged(spark, since)


def broadcast_if_small(df: DataFrame, rows: int, limit: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint when it has at most ``limit`` rows, else as it is (a shuffle join follows)."""
    return F.broadcast(df) if rows <= limit else df


def first_wins(df: DataFrame, key: str, order: str, columns: list[str]) -> DataFrame:
    """Of the rows with one ``key`` only the one with the smallest ``order`` stays; ``columns`` come out.

    Only ``key`` and ``order`` are shuffled. The keys that occur more than once are staged and counted; up to
    ``BROADCAST_ROWS`` of them are broadcast, more are joined by a shuffle. Rows with a null key or a null order are no
    records. Rows that repeat key and order count once.
    """
    k, o = "__qh_key", "__qh_order"
    pairs = df.select(F.col(key).alias(k), F.col(order).alias(o)).where(f"{k} is not null and {o} is not null")
    firsts = (
        pairs.groupBy(k, o).agg(F.count(F.lit(1)).alias("m"))
        .groupBy(k).agg(F.min(o).alias("__qh_first"), F.max("m").alias("__qh_m"), F.count(F.lit(1)).alias("n"))
        .where("n > 1 or __qh_m > 1").drop("n")
    )
    firsts = stage(firsts, "firsts")
    sizes = firsts.agg(F.count(F.lit(1)), F.coalesce(F.max("__qh_m"), F.lit(1))).first()
    wanted = list(dict.fromkeys(columns))
    rows = df.select(F.col(key).alias(k), F.col(order).alias(o), *[F.col(c).alias(f"__qh_c{i}") for i, c in enumerate(wanted)]).where(f"{k} is not null and {o} is not null")
    if sizes[0]:
        rows = rows.join(broadcast_if_small(firsts, sizes[0]), k, "left").where(f"__qh_first is null or {o} = __qh_first")
        if sizes[1] > 1:
            rows = rows.where("coalesce(__qh_m, 1) = 1").unionByName(rows.where("__qh_m > 1").dropDuplicates([k]))
    return rows.select(*[F.col(f"__qh_c{i}").alias(c) for i, c in enumerate(wanted)])


def number_rows(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """Adds ``name``: 0, 1, 2, ... in the order of the columns, without sorting everything in one task.

    Rows are range-partitioned and staged with their partition; counts per partition give the offsets. Equal rows get
    their numbers in no fixed order among themselves.
    """
    from pyspark.sql import Window

    ranged = stage(df.repartitionByRange(*order).withColumn("__qh_part", F.spark_partition_id()), "ranged")
    counts = ranged.groupBy("__qh_part").agg(F.count(F.lit(1)).alias("__qh_n"))
    before = F.sum("__qh_n").over(Window.orderBy("__qh_part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select("__qh_part", F.coalesce(before, F.lit(0)).alias("__qh_before"))  # one row a partition
    within = F.row_number().over(Window.partitionBy("__qh_part").orderBy(*order)) - 1
    return ranged.join(F.broadcast(offsets), "__qh_part").withColumn(name, F.col("__qh_before") + within).drop("__qh_part", "__qh_before")

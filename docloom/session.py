"""Session helpers: building a session, loading tables, cutting lineage."""

from __future__ import annotations

import os
import tempfile
import threading
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def get_session(master: str = "local[*]", app: str = "docloom", shuffle_partitions: int = 8,
                extra: dict | None = None) -> SparkSession:
    """Session tuned for local runs; on a cluster pass the cluster master and
    size ``shuffle_partitions`` so each shuffle partition stays in the
    100-200 MB range (AQE coalesces small ones)."""
    b = (
        SparkSession.builder.master(master).appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.sql.mapKeyDedupPolicy", "LAST_WIN")
    )
    for k, v in (extra or {}).items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    return spark


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``docloom`` importable in Python workers (pandas UDFs, mapInPandas)
    wherever they run: zip the package once per application and register it
    with ``addPyFile``, which distributes it to every executor."""
    import zipfile

    sc = spark.sparkContext
    app = sc.applicationId
    if app in _SHIPPED:
        return
    pkg = os.path.dirname(os.path.abspath(__file__))
    root = os.path.dirname(pkg)
    path = os.path.join(tempfile.mkdtemp(prefix="docloom-pyfiles-"), f"docloom-{uuid.uuid4().hex[:8]}.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for dirpath, _, files in os.walk(pkg):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(dirpath, f)
                    z.write(full, os.path.relpath(full, root))
    sc.addPyFile(path)
    _SHIPPED.add(app)


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Use the shared checkpoint folder the cluster names in
    ``spark.checkpoint.dir``. Where none is set, a local session gets a fresh
    scratch folder; on a cluster that folder would not be shared, so it is an
    error."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf_dir = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not conf_dir:
        if not sc.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        conf_dir = tempfile.mkdtemp(prefix="docloom-ckpt-")
    sc.setCheckpointDir(conf_dir)
    return sc.getCheckpointDir() or conf_dir


#: Shuffle files of an execution go when it ends; else they stay until the driver collects its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialize(df: DataFrame, name: str = "stage") -> DataFrame:
    """Cut lineage by writing a parquet table into the shared checkpoint
    folder and reading it back (survives executor loss).

    Used between dependent stages (retrieval hops) so a lost executor does
    not recompute earlier hops and the plan stays small. A single write job:
    an eager ``checkpoint()`` of an uncached plan computes it twice (once to
    count, once to write the checkpoint files). What the write shuffled is
    deleted when it ends.
    """
    return _staged(df, name)


def materialize_by(df: DataFrame, by: str, name: str = "stage") -> DataFrame:
    """:func:`materialize` with a folder for every value of the column ``by``."""
    return _staged(df, name, by)


def _staged(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    spark = df.sparkSession
    base = ensure_checkpoint_dir(spark)
    path = os.path.join(base, "docloom-stages", f"{name}-{uuid.uuid4().hex}")
    old = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        writer = df.write.mode("errorifexists")
        (writer.partitionBy(by) if by else writer).parquet(path)
    finally:
        if old is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, old)
    if getattr(_SCOPE, "paths", None) is not None:
        _SCOPE.paths.append(path)
    out = spark.read.parquet(path)
    out._stage = path
    return out


def stage_path(df: DataFrame) -> str:
    """Where :func:`materialize` wrote this table."""
    return df._stage


def release(*stages: DataFrame) -> None:
    """Delete tables of :func:`materialize` from which nothing is read any more."""
    for df in stages:
        _delete(df.sparkSession, stage_path(df))


def _delete(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


_SCOPE = threading.local()


@contextmanager
def stage_scope(spark: SparkSession):
    """The tables that :func:`materialize` writes inside are deleted at the
    end. For work that ends in a write (a micro-batch): whatever was made
    lazily from those tables must have been written by then."""
    outer, _SCOPE.paths = getattr(_SCOPE, "paths", None), []
    try:
        yield
    finally:
        made, _SCOPE.paths = _SCOPE.paths, outer
        for path in made:
            _delete(spark, path)


# Tables whose rows carry CPU-heavy per-row work (text). Vector scans are numpy-vectorised per partition
# and each partition emits k rows per query, so they are not spread.
SPREAD_SPLITS = 8
HEAVY_TABLES = {"documents", "conversations", "events", "pages"}


#: Rows that a task of a spread table has, about; twice as many are a reason to spread it.
SPREAD_ROWS = 100_000


def spread(df: DataFrame, factor: int = 2) -> DataFrame:
    """Round-robin repartition of an input that has a handful of splits only
    (e.g. one file of one row group), or splits of very many rows (a narrow
    table packs millions of rows in a split), so that its per-row work is dealt
    out. Other tables of ``SPREAD_SPLITS`` splits or more are not reshuffled,
    however large the cluster is."""
    splits, rows = df.rdd.getNumPartitions(), df.count()
    if splits < SPREAD_SPLITS or rows > 2 * SPREAD_ROWS * splits:
        return df.repartition(max(SPREAD_SPLITS * factor, -(-rows // SPREAD_ROWS)))
    return df


#: What travels to Python at once; texts are long, and memory on both sides grows with a batch.
BATCH_ROWS, BATCH_BYTES = 1_000, 4 << 20


def small_batches(spark: SparkSession) -> None:
    """Arrow batches have at most ``BATCH_ROWS`` rows and about ``BATCH_BYTES``
    from now on (a session that sets less keeps that)."""
    for key, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        if not 0 < _number(spark.conf.get(f"spark.sql.execution.arrow.{key}")) <= most:
            spark.conf.set(f"spark.sql.execution.arrow.{key}", str(most))


def _number(setting: str) -> int:
    """A setting's number; sizes may end in b, k, m or g."""
    digits, unit = setting.lower().rstrip("b").rstrip("kmg"), setting.lower().rstrip("b")[-1:]
    return int(digits) << {"k": 10, "m": 20, "g": 30}.get(unit, 0)


def read_table(spark: SparkSession, sf_dir: str, name: str, columns: list[str] | None = None,
               spread_rows: bool | None = None) -> DataFrame:
    df = spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))
    df = df.select(*columns) if columns else df
    if spread_rows if spread_rows is not None else name in HEAVY_TABLES:
        df = spread(df)
    return df


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder under the checkpoint directory (see
    :func:`ensure_checkpoint_dir`; on a cluster always the shared one)."""
    base = ensure_checkpoint_dir(spark)
    return os.path.join(base, "docloom-scratch", f"{name}-{uuid.uuid4().hex}")

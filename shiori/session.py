"""Session helpers: table loading, durable lineage cuts and guarded broadcasts."""

from __future__ import annotations

import os
import tempfile
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Upper bounds, in rows and in bytes as JSON, of what `small()` is willing to mark for broadcast.
BROADCAST_ROWS, BROADCAST_BYTES = 200_000, 64 << 20


def build_session(app: str = "shiori", cores: str = "*", partitions: int = 8) -> SparkSession:
    """Local session for tests and benches; clusters bring their own session."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", os.environ.get("SHIORI_DRIVER_MEMORY", "6g"))
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One parquet table of the corpus directory."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """Folder all executors share. The cluster names it in spark.checkpoint.dir; only
    where that is unset and all tasks run in this process a temporary folder is made."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    current = spark.sparkContext._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("name a folder that all executors share in spark.checkpoint.dir")
    made = tempfile.mkdtemp(prefix="shiori-")
    spark.sparkContext.setCheckpointDir(made)
    return made


def settle(df: DataFrame) -> DataFrame:
    """Compute once and cut the lineage on reliable storage (never on executors)."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """Compute once into a compressed table in the shared folder and read that: for tables of
    texts, which checkpoints would hold uncompressed, and where a join needs sizes."""
    import uuid

    spark = df.sparkSession
    path = f"{shared_dir(spark)}/stored-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast hint behind a check: `df` is measured first, and a side of more than `limit`
    rows or BROADCAST_BYTES is left to a shuffled join. Measuring is an aggregation, no
    gathering of rows in one task."""
    size = df.select(F.octet_length(F.to_json(F.struct("*"))).alias("b")).agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("b"), F.lit(0)).alias("b")).first()
    return F.broadcast(df) if size["n"] <= limit and size["b"] <= BROADCAST_BYTES else df


def ship(spark: SparkSession) -> None:
    """Make this package importable in Python workers: a zip is added to the context
    once; the driver serves it to every executor."""
    import zipfile
    from pathlib import Path

    context = spark.sparkContext
    if getattr(context, "_shiori_shipped", False):
        return
    root = Path(__file__).resolve().parent
    target = os.path.join(tempfile.mkdtemp(prefix="shiori-pkg-"), "shiori_pkg.zip")
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    context.addPyFile(target)
    context._shiori_shipped = True


def release(spark: SparkSession) -> None:
    """Let the driver drop what finished jobs left: their plans, shuffle files and checkpoints.
    Spark removes those only once the driver's garbage is collected, which a long loop of
    small jobs does too late."""
    import gc

    gc.collect()
    spark.sparkContext._jvm.System.gc()


@contextmanager
def fixed_plans(spark: SparkSession, partitions: int, compiled: bool = True):
    """Run plans of known size with `partitions` shuffle partitions and without adaptive
    execution, whose threads and plan versions weigh on the driver in long loops. The caller
    splits hot keys itself. Their plans aren't described at length, which the driver would keep.
    Few rows are interpreted rather than compiled for: a loop of many such plans would compile
    more classes than Spark keeps, and compile them again each time around."""
    want = {"spark.sql.adaptive.enabled": "false", "spark.sql.shuffle.partitions": str(partitions), "spark.sql.maxPlanStringLength": "2000"}
    if not compiled:
        want |= {"spark.sql.codegen.wholeStage": "false", "spark.sql.codegen.factoryMode": "NO_CODEGEN"}
    before = {k: spark.conf.get(k) for k in want}
    for k, v in want.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def _files(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    """Whether there is a file or folder, on whatever storage the path names."""
    fs, p = _files(spark, path)
    return fs.exists(p)


def modified(spark: SparkSession, path: str) -> int:
    """When a file or folder was last changed, in milliseconds; 0 if there is none."""
    fs, p = _files(spark, path)
    return fs.getFileStatus(p).getModificationTime() if fs.exists(p) else 0


def mark(spark: SparkSession, path: str) -> None:
    """Make an empty folder, as a mark of a finished step."""
    fs, p = _files(spark, path)
    fs.mkdirs(p)


def listed(spark: SparkSession, path: str) -> list[str]:
    """Names of what a folder holds; none if there is no folder."""
    fs, p = _files(spark, path)
    return sorted(f.getPath().getName() for f in fs.listStatus(p)) if fs.exists(p) else []


def remove(spark: SparkSession, path: str) -> None:
    """Delete a file or folder of a path the caller made."""
    fs, p = _files(spark, path)
    fs.delete(p, True)

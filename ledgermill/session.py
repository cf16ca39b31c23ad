"""Session settings, reliable checkpoints and table access."""

from __future__ import annotations

import atexit
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


#: Spark 4.1 takes a union of equally partitioned inputs as partitioned like them, though adaptive execution may coalesce
#: each input's partitions in its own way; groups then come out in pieces (seen in reranked(): 4,248 rows for 1,428).
UNION_PARTITIONING = "spark.sql.unionOutputPartitioning"


def get_session(cpus: str = "*", memory: str = "8g", partitions: int = 8) -> SparkSession:
    """A local session for tests and the benchmark; on a cluster the caller's session is used as it is."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("ledgermill")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.adaptive.enabled", "true")
        .config(UNION_PARTITIONING, "false")
        .getOrCreate()
    )


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder the cluster names in spark.checkpoint.dir.

    Where it is unset, a local master gets a temporary folder; any other master raises, as a folder of the driver's own
    disk would lose rows that executors write.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    named = sc.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="ledgermill-ckpt-")
    sc.setCheckpointDir(named)
    return sc.getCheckpointDir()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write df to the shared checkpoint folder and read it from there, so a lost executor costs no recomputation.

    A Parquet table rather than DataFrame.checkpoint(): the latter carries statistics and constraints along, which grow
    with every round of an iteration until planning takes longer than running. The tables go when scratch() ends, or
    else with the process.
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/ledgermill-{uuid.uuid4().hex}"
    if not _written:
        atexit.register(_remove_written, spark)
    _written.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


_written: list[str] = []


def _remove_written(spark: SparkSession, keep: int = 0) -> None:
    try:
        jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        while len(_written) > keep:
            where = jvm.org.apache.hadoop.fs.Path(_written[-1])
            where.getFileSystem(conf).delete(where, True)
            _written.pop()
    except Exception:  # the session may be gone already; its folder is then the cluster's to clean
        pass


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Removes the tables that cut_lineage writes inside the block; results must be saved before it ends."""
    before = len(_written)
    try:
        yield
    finally:
        _remove_written(spark, before)


def ship_package(spark: SparkSession) -> None:
    """Send this package to the session's Python workers, once a context, so that it need not be installed on them."""
    sc = spark.sparkContext
    if getattr(sc, "_ledgermill_shipped", False):
        return
    sc._ledgermill_shipped = True
    root = Path(__file__).resolve().parent
    where = Path(tempfile.mkdtemp(prefix="ledgermill-pkg-")) / "ledgermill_package.zip"
    with zipfile.ZipFile(where, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    sc.addPyFile(str(where))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a data folder; Parquet keeps pushdown and pruning. Prepares the session for this package's operators."""
    ship_package(spark)
    if spark.conf.get(UNION_PARTITIONING, None) != "false":  # unset, Spark's own default of true holds
        spark.conf.set(UNION_PARTITIONING, "false")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")

"""Session settings, scratch tables and text helpers that the operators share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: Characters that count as white space when a text is trimmed or tested for being blank.
SPACE = " \t\n\r\x0b\x0c"


def local_session(cpus: int | str = "*", partitions: int = 8, app: str = "auditlake") -> SparkSession:
    """A local session as tests and the bench use it; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def trimmed(c: Column | str) -> Column:
    return F.trim(F.col(c) if isinstance(c, str) else c, F.lit(SPACE))


def filled(c: Column | str) -> Column:
    """True where a text is neither null nor blank; never null."""
    return F.coalesce(F.length(trimmed(c)) > 0, F.lit(False))


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


_own_roots: dict[str, str] = {}


def scratch_root(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir. Only a local master may go without one and gets a temporary
    folder of this machine; elsewhere the executors would each write to a disk of their own, so it is an error."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root
    context = spark.sparkContext
    if not (context.master == "local" or context.master.startswith("local[")):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if context.applicationId not in _own_roots:
        _own_roots[context.applicationId] = root = "file://" + tempfile.mkdtemp(prefix="auditlake-")
        atexit.register(_remove, spark, root)
    return _own_roots[context.applicationId]


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the JVM may be gone by then
        pass


class Scratch:
    """Tables of one query in the shared folder. A table that was written cuts the lineage and outlives any executor."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.path = f"{scratch_root(spark)}/auditlake/{uuid.uuid4().hex}"
        self.n = 0
        atexit.register(_remove, spark, self.path)

    def keep(self, df: DataFrame, **seen: Column) -> DataFrame:
        """Writes the rows and gives them back, read from the file. Aggregates in `seen` are taken while the rows are written,
        without a job of their own, and stand in the kept table's `seen`."""
        self.n += 1
        path = f"{self.path}/{self.n}"
        observed = Observation() if seen else None
        (df.observe(observed, *[c.alias(n) for n, c in seen.items()]) if seen else df).write.parquet(path)
        kept = self.spark.read.schema(df.schema).parquet(path)
        kept._scratch_path, kept.seen = path, observed.get if seen else {}
        return kept

    def keep_rows(self, df: DataFrame) -> tuple[DataFrame, int]:
        """The kept table and how many rows it has."""
        kept = self.keep(df, rows=F.count(F.lit(1)))
        return kept, kept.seen["rows"]

    def drop(self, df: DataFrame) -> None:
        """Removes a kept table that nothing reads any more."""
        _remove(self.spark, df._scratch_path)

"""Session helpers shared by all operators: shared-folder tables, package shipping, salting."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PACKAGE = os.path.dirname(os.path.abspath(__file__))


def local_session(app: str = "noteforge", cpus: int | str = "*", **conf: str) -> SparkSession:
    """A local session for tests and the bench; clusters bring their own."""
    builder = SparkSession.builder.master(f"local[{cpus}]").appName(app)
    defaults = {
        "spark.sql.shuffle.partitions": "8",
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        "spark.driver.memory": "8g",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.showConsoleProgress": "false",
    }
    for key, value in (defaults | conf).items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir; only a local session gets one of its own where it is unset."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="noteforge-shared-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def _own_dir(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/noteforge/{spark.sparkContext.applicationId}"


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the application's part of the shared folder."""
    return f"{_own_dir(spark)}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame, name: str = "t", partition_by: list[str] | None = None) -> DataFrame:
    """Write df to the shared folder and read it back: lineage ends there, and any executor may be lost."""
    path = scratch(df.sparkSession, name)
    writer = df.write
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_cuts(spark: SparkSession) -> None:
    """Remove what this application wrote to the shared folder (others' tables stay); call it when the results are stored."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_own_dir(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def cut_all(*frames: DataFrame) -> list[DataFrame]:
    """cut several tables at the same time."""
    with ThreadPoolExecutor(len(frames)) as pool:
        return list(pool.map(cut, frames))


def ship(spark: SparkSession) -> None:
    """Make the package importable in Python workers of any cluster (once per context)."""
    sc = spark.sparkContext
    if getattr(sc, "_noteforge_shipped", False):
        return
    path = os.path.join(tempfile.mkdtemp(prefix="noteforge-"), "noteforge_pkg.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for root, _, files in os.walk(PACKAGE):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(root, f)
                    z.write(full, os.path.relpath(full, os.path.dirname(PACKAGE)))
    sc.addPyFile(path)
    sc._noteforge_shipped = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a data directory (a Parquet file or a directory of part files)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows of one key from which a join splits it.
HOT_ROWS = 100_000


def salted_join(rows: DataFrame, groups: DataFrame, keys: list[str], id_col: str, hot: int = HOT_ROWS, how: str = "inner") -> DataFrame:
    """Join many rows to one row per key without sending a hot key to one task.

    Keys with more than `hot` rows (at most rows / hot of them) are split by id_col into parts
    of about that size, and their group rows repeated once a part; other rows move once. Rows
    with a null key match nothing and are spread by id_col.
    """
    many = F.broadcast(rows.groupBy(*keys).agg(F.count("*").alias("_n")).where(F.col("_n") > hot).select(*keys, F.ceil(F.col("_n") / hot).cast("int").alias("_parts")))
    parts = F.coalesce("_parts", F.lit(1))
    no_key = F.greatest(*[F.col(k).isNull() for k in keys], F.lit(False))
    left = rows.join(many, keys, "left").withColumn("_salt", F.pmod(F.xxhash64(id_col), F.when(no_key, 1 << 20).otherwise(parts)).cast("int")).drop("_parts")
    right = groups.join(many, keys, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), parts - 1))).drop("_parts")
    return left.join(right, [*keys, "_salt"], how).drop("_salt")

"""Files and directories of any file system that Spark can reach, by its Hadoop client."""

from __future__ import annotations

from pyspark.sql import SparkSession


def _path(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _path(spark, path)
    return fs.exists(p)


def delete(spark: SparkSession, path: str) -> None:
    fs, p = _path(spark, path)
    fs.delete(p, True)


def rename(spark: SparkSession, old: str, new: str) -> None:
    """Moves a file or directory; an existing target or a failed move is an error."""
    fs, p = _path(spark, old)
    target = _path(spark, new)[1]
    if fs.exists(target):
        raise FileExistsError(new)
    fs.mkdirs(target.getParent())
    if not fs.rename(p, target):
        raise OSError(f"cannot move {old} to {new}")


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A whole small file: written beside the target, then put in its place."""
    fs, p = _path(spark, path)
    fs.mkdirs(p.getParent())
    temporary = _path(spark, f"{p.getParent()}/.{p.getName()}.tmp")[1]
    out = fs.create(temporary, True)
    try:
        out.write(bytearray(text.encode("utf-8")))
    finally:
        out.close()
    fs.delete(p, False)
    if not fs.rename(temporary, p):
        raise OSError(f"cannot write {path}")


def read_text(spark: SparkSession, path: str) -> str:
    """A whole small file."""
    fs, p = _path(spark, path)
    stream = fs.open(p)
    try:
        return bytes(stream.readAllBytes()).decode("utf-8")
    finally:
        stream.close()

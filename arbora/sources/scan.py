"""Source trees as the files relation, and the filters of a scan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from arbora.functions import text

# Names that are left out wherever they stand in a path.
EXCLUDED = (r"^\..*", r".*\.pyc$", r".*\.pyo$", r".*\.swp$", r".*~$", r"^__pycache__$", r"^node_modules$")
VIRTUAL = (".venv", "venv", "env")


def kept_names(path: Column) -> Column:
    """Whether no component of a path is an excluded name."""
    pattern = "|".join(EXCLUDED)
    return ~F.exists(F.filter(F.split(path, "/"), lambda p: p != ""), lambda p: p.rlike(pattern) & (p != ".pylintrc"))


def outside(paths: DataFrame, prefixes: list[str], column: str = "rel_path") -> DataFrame:
    """Paths that neither are nor lie under any of a few prefixes."""
    for prefix in prefixes:
        paths = paths.where(~((F.col(column) == prefix) | F.startswith(column, F.lit(prefix.rstrip("/") + "/"))))
    return paths


def relative(path: Column, root: str) -> Column:
    """The path below a root; null outside it."""
    root = root.rstrip("/") + "/"
    return F.when(F.startswith(path, F.lit(root)), F.substring(path, F.lit(len(root) + 1), F.length(path)))


def read_tree(spark: SparkSession, root: str, exclude: list[str] | None = None, encoding: str | None = None) -> DataFrame:
    """path, rel_path, mtime, size, source, encoding, content_hash of every Python file under a root.

    Names, prefixes and virtual environments are filtered on paths alone, before any content is decoded.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.py").load(root)
    plain = F.regexp_replace("path", r"^file:/+", "/")
    rows = files.withColumn("rel_path", relative(plain, root.removeprefix("file://"))).where("rel_path is not null").where(kept_names(F.col("rel_path")))
    rows = outside(rows, [*(exclude or []), *VIRTUAL])
    return text.decode(rows, "content", encoding).select("path", "rel_path", F.col("modificationTime").alias("mtime"), F.col("length").alias("size"), "source", "encoding", F.substring(F.sha2("content", 256), 1, 16).alias("content_hash"))


def from_rows(spark: SparkSession, rows: dict[str, str]) -> DataFrame:
    """rel_path, source from a few texts in memory."""
    return spark.createDataFrame(list(rows.items()), "rel_path string, source string")

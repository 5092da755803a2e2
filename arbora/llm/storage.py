"""Where operators put tables that cut lineage.

Every such table goes to the folder the cluster names in
``spark.checkpoint.dir``; only where that is unset (tests, a laptop) a folder
of this session's own is used.  Tables are written by Spark's committer, so a
lost executor costs the tasks it ran and nothing else.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bits of a filter for each value, and at most: 8 MB, in rows of 64 bits.
BITS, MOST_BITS = 16, 1 << 26

_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The shared folder for intermediate tables, without a trailing slash."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        _OWN[app] = "file://" + tempfile.mkdtemp(prefix="arbora-")
    return _OWN[app]


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/arbora/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """Write ``df`` as Parquet to the shared folder and read it back; also the path, for :func:`drop`."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def drop(spark: SparkSession, path: str) -> None:
    """Delete an intermediate table that no later plan reads."""
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def no_rows(spark: SparkSession, schema: str) -> DataFrame:
    """An empty table that needs no Python: one from a list starts a second kind of Python workers, which then stay on every executor."""
    return spark.range(0).select(F.from_json(F.lit(None).cast("string"), schema).alias("row")).select("row.*")


def free_name(df: DataFrame, wanted: str) -> str:
    """A column name like the wanted one that ``df`` does not have, in whatever case."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted


def marked(rows: DataFrame, key: str, wanted: DataFrame, name: str) -> DataFrame:
    """``rows`` with a flag ``name``, false only where ``key`` is no value of ``wanted``'s one column, which has its type.

    So rows that a join would drop need not be exchanged for it.  The flags come from a broadcast filter of one hash, a
    sixteenth of the other rows have one too, and more where the bits run out; the join decides.
    """
    bits = min(MOST_BITS, 64 << (BITS * wanted.count() // 64).bit_length())
    place = lambda c: F.xxhash64(c).bitwiseAND(F.lit(bits - 1))
    word = lambda c: F.call_function("shiftright", place(c), F.lit(6))
    bit = lambda c: F.call_function("shiftleft", F.lit(1).cast("long"), place(c).bitwiseAND(F.lit(63)).cast("int"))
    at, held = free_name(rows, "filter_word"), free_name(rows, "filter_bits")
    words = wanted.groupBy(word(wanted.columns[0]).alias(at)).agg(F.bit_or(bit(wanted.columns[0])).alias(held))
    flag = F.coalesce(F.col(held).bitwiseAND(bit(key)) != 0, F.lit(False))
    return rows.join(F.broadcast(words), word(key) == F.col(at), "left").withColumn(name, flag).drop(at, held)

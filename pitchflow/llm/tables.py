"""Small helpers shared by the operators: shared tables, words, free column names."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The characters that separate words, in Java regex and as a plain string.
SPACE_CLASS = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"
#: Session settings, put in where unset: a query's shuffle files go when the query has ended, not when the
#: driver collects its garbage, and what the driver keeps of a plan's text is bounded.
SETTINGS = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.maxPlanStringLength": "65536"}
#: Folder by application, for local sessions without ``spark.checkpoint.dir``.
_own: dict[str, str] = {}
SPACES = " \t\n\x0b\x0c\r"
#: Stands for a null key, after all others.
LAST = (1 << 63) - 1


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share (``spark.checkpoint.dir``). Only a local session may go without: it gets a new one."""
    found = spark.conf.get("spark.checkpoint.dir", None) or _own.get(spark.sparkContext.applicationId)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        # the setting cannot be changed in a running session, so the choice is kept here
        found = _own[spark.sparkContext.applicationId] = tempfile.mkdtemp(prefix="spark-")
    return found.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/pitchflow-{name}-{uuid.uuid4().hex}"


def _write(df: DataFrame, path: str) -> DataFrame:
    spark = df.sparkSession
    for name, value in SETTINGS.items():
        if spark.conf.get(name, None) is None:
            spark.conf.set(name, value)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` as a Parquet table in the shared folder and reads it back.

    The result no longer depends on shuffle files or executors; a lost executor costs one task's reread.
    """
    return _write(df, shared_path(df.sparkSession, name))


class Scratch:
    """Written tables of one run of an operator, which go one by one when nothing reads them any more."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.paths: dict[str, str] = {}

    def write(self, df: DataFrame, name: str) -> DataFrame:
        self.paths[name] = shared_path(self.spark, name)
        return _write(df, self.paths[name])

    def drop(self, *names: str) -> None:
        """Deletes tables; whatever was derived from them must have been written before."""
        hadoop = self.spark.sparkContext._jvm.org.apache.hadoop.fs
        for name in names:
            path = hadoop.Path(self.paths.pop(name))
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def word_count(text: Column) -> Column:
    """Number of words; a null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def free_name(df: DataFrame, wanted: str) -> str:
    """``wanted``, with underscores in front until no column of ``df`` has the name (case does not count)."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted = f"_{wanted}"
    return wanted


def key_name(key: str, *new: str) -> str:
    """The key's name in a result, with underscores in front until it is none of the new columns' (case does not count)."""
    while key.lower() in {n.lower() for n in new}:
        key = f"_{key}"
    return key


def fresh(df: DataFrame, *columns: str) -> DataFrame:
    """``df`` without columns that an operator is about to add."""
    wanted = {c.lower() for c in columns}
    return df.drop(*[c for c in df.columns if c.lower() in wanted])


def order_of(key: str) -> Column:
    """A whole-number key as the place of its rows in the order of the corpus; see ``row_id`` for null keys."""
    return F.coalesce(F.col(key).cast("long"), F.lit(LAST))


def row_id(key: str, text: str) -> Column:
    """A row's identity, which reruns reproduce: a hash of key and text. Only rows that repeat both share it.

    It is negative if there is a key and not if the key is null, so ``order_of`` and the identity together
    put null keys after the largest key.
    """
    found = F.col(key).cast("long")
    h = F.xxhash64(found, F.col(text))
    return F.when(found.isNull(), h.bitwiseAND(F.lit(LAST))).otherwise(h.bitwiseOR(F.lit(-LAST - 1)))

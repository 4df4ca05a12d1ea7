"""Raw season files, the league catalog, and the stored match tables."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _exists(spark: SparkSession, path: str) -> bool:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place)


def read_csv(spark: SparkSession, path: str, columns: str, encoding: str | None = None) -> DataFrame:
    """Typed columns of a CSV file with a header; quoted fields may hold commas and line breaks.

    Rows with more fields than the header go; short rows end in nulls; what does not fit its type is
    null. Without ``encoding`` the file is read as UTF-8, or, if it is not valid UTF-8, as
    Latin-1 (then long rows are kept and cut).
    """
    latin = encoding is None and not spark.read.text(path).where(~F.is_valid_utf8("value")).isEmpty()
    chosen = encoding or ("ISO-8859-1" if latin else "UTF-8")
    plain = spark.read.option("encoding", chosen).option("multiLine", True).option("escape", '"').option("ignoreLeadingWhiteSpace", False)
    first = plain.csv(path).limit(1).collect()
    names = [(n or "").strip("\ufeff\r ") for n in first[0]] if first else []
    held, more = [n or f"_blank{i}" for i, n in enumerate(names)], "_more"
    raw = ", ".join(f"`{n}` string" for n in [*held, more, "_row"])
    # a row that is too long does not fit the schema and is kept as it stands in _row; so one field more is allowed, and noticed
    parsed = plain.option("header", True).option("enforceSchema", True).option("columnNameOfCorruptRecord", "_row").schema(raw).csv(path) if names else None
    wanted = spark.createDataFrame([], columns).schema
    if parsed is None:
        return spark.createDataFrame([], wanted)
    kept = parsed if latin else parsed.where(F.col(more).isNull())
    return kept.select(*[(F.col(f"`{f.name}`").try_cast(f.dataType) if f.name in held else F.lit(None).cast(f.dataType)).alias(f.name) for f in wanted])


def season_url(template: str, year: int) -> str:
    """``template`` holds one place for the season's code, such as 0506."""
    return template.format(f"{year % 100:02d}{(year + 1) % 100:02d}")


def read_seasons(spark: SparkSession, paths: dict[int, str], columns: str) -> DataFrame | None:
    """Season files by starting year, joined by column name. A season without a file is left out; other errors
    (a file system that cannot be reached, a file that cannot be read) are raised. None if no season is there."""
    found = [read_csv(spark, path, columns).withColumn("Season", F.lit(year)) for year, path in sorted(paths.items()) if _exists(spark, path)]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), found) if found else None


def read_extra(spark: SparkSession, path: str, columns: str) -> DataFrame | None:
    """The one file of an extra league; any error in reaching it gives None."""
    try:
        return read_csv(spark, path, columns) if _exists(spark, path) else None
    except (Py4JJavaError, PySparkException):
        return None


def save_league(df: DataFrame, root: str, league_id: str) -> None:
    """Seasons of one league; only the seasons in ``df`` are overwritten."""
    rows = df.withColumn("league_id", F.lit(league_id))
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("league_id", "season").parquet(root)


def load_league(spark: SparkSession, root: str, league_id: str) -> DataFrame | None:
    """The stored table of a league, or None."""
    if not _exists(spark, root):
        return None
    rows = spark.read.parquet(root).where(F.col("league_id") == league_id)
    return None if rows.isEmpty() else rows.drop("league_id")


def league_catalog(spark: SparkSession, path: str) -> DataFrame:
    """Rows of a catalog file {"leagues": [...]}."""
    return spark.read.option("multiLine", True).json(path).select(F.explode("leagues").alias("x")).select("x.*")


def surviving(index: DataFrame, listing: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Index entries whose folder is still there."""
    return index.join(listing, list(keys), "left_semi")

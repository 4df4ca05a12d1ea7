"""Nested match documents: keyed collections, arrays to objects, flat exports."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pitchflow.functions.columns import category_key
from pitchflow.operators.tables import filed

# The nested document.
SCHEMA = (
    "match_id string, stage string, date string, status string, home struct<name:string,image:string>, away struct<name:string,image:string>, "
    "result struct<home:string,away:string,regulationTime:string,penalties:string>, information array<struct<category:string,value:string>>, "
    "statistics array<struct<category:string,homeValue:string,awayValue:string>>"
)


def last_per_key(df: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """The last row of each key; sums up before it shuffles, so a hot key is no hot task."""
    whole = F.struct(*df.columns)
    return df.groupBy(F.col(key).alias("_key")).agg(F.max_by(whole, F.struct(*order)).alias("row")).select("row.*")


def last_wins(entries: Column, key: str) -> Column:
    """``key`` and ``entry`` of the entries of an array of structs whose key does not come again later, in order. Each key is worked out once."""
    keyed = F.transform(entries, lambda e: F.struct(category_key(e[key]).alias("key"), e.alias("entry")))
    last = lambda all_: F.filter(all_, lambda e, i: ~F.array_contains(F.slice(all_["key"], i + 2, F.size(all_)), e["key"]))
    return F.get(F.transform(F.array(keyed), last), F.lit(0))


def information_map(information: Column) -> Column:
    """category -> value; of equal categories the last counts."""
    return F.map_from_entries(F.transform(last_wins(information, "category"), lambda e: F.struct(e["key"], e["entry"]["value"])))


def statistics_map(statistics: Column) -> Column:
    """category -> home and away value."""
    value = lambda e: F.struct(e["homeValue"].alias("home"), e["awayValue"].alias("away"))
    return F.map_from_entries(F.transform(last_wins(statistics, "category"), lambda e: F.struct(e["key"], value(e["entry"]))))


def pair_siblings(flat: Column) -> Column:
    """[category, value, category, value, ...] -> structs; a last category without a value has a null one."""
    pairs = F.transform(F.sequence(F.lit(0), F.greatest(F.size(flat) - 1, F.lit(0)), F.lit(2)), lambda i: F.struct(F.get(flat, i).alias("category"), F.get(flat, i + 1).alias("value")))
    return F.when(F.size(flat) > 0, pairs).otherwise(F.slice(pairs, 1, 0))


def _leaves(df: DataFrame) -> DataFrame:
    """match_id, leaves: field and value of each leaf that a document may have, fields once."""
    leaf = lambda name, value: F.struct(F.lit(name).alias("field"), value.alias("value"))
    plain = [leaf(c, F.col(c)) for c in ("stage", "status", "date", "home.name", "home.image", "away.name", "away.image", "result.home", "result.away", "result.regulationTime", "result.penalties")]
    info = F.transform(last_wins(F.col("information"), "category"), lambda e: F.struct(F.concat(F.lit("information."), e["key"]).alias("field"), e["entry"]["value"].alias("value")))
    stats = F.flatten(F.transform(last_wins(F.col("statistics"), "category"), lambda e: F.array(*[F.struct(F.concat(F.lit("statistics."), e["key"], F.lit(f".{side}")).alias("field"), e["entry"][f"{side}Value"].alias("value")) for side in ("home", "away")])))
    nothing = F.array().cast("array<struct<field:string,value:string>>")
    return df.select("match_id", F.concat(F.array(*plain), F.coalesce(info, nothing), F.coalesce(stats, nothing)).alias("leaves"))


def flat_rows(df: DataFrame) -> DataFrame:
    """match_id, field, value: one row for each leaf that a document may have, null if it has not, with dotted field names."""
    return _leaves(df).select("match_id", F.explode("leaves").alias("leaf")).select("match_id", "leaf.field", "leaf.value")


#: The order of a flat table's columns; information and statistics follow by name.
FLAT_ORDER = ("stage", "status", "date", "home.name", "home.image", "away.name", "away.image", "result.home", "result.away", "result.regulationTime", "result.penalties")


def flat_table(df: DataFrame) -> DataFrame:
    """One row per document, a column for each field that any document has. Documents are worked out once; field names are read first.

    Columns come as documents nest them. If a document comes several times its largest values count.
    """
    rows = filed(_leaves(df), "leaves")
    named = rows.select(F.explode("leaves").alias("leaf")).where("leaf.value is not null")
    found = {r["field"] for r in named.select("leaf.field").distinct().collect()}  # the names of the result's columns
    fields = [f for f in FLAT_ORDER if f in found] + sorted(found.difference(FLAT_ORDER))
    values = rows.select("match_id", F.map_from_entries("leaves").alias("values")).select("match_id", *[F.col("values")[f].alias(f) for f in fields])
    # a row for each document, not for each leaf, is shuffled
    return values.groupBy("match_id").agg(*[F.max(f"`{f}`").alias(f) for f in fields]) if fields else rows.select("match_id").distinct()


def json_text(df: DataFrame) -> DataFrame:
    """match_id and the document as JSON text; nulls are left out."""
    return df.select("match_id", F.to_json(F.struct(*[c for c in df.columns if c != "match_id"])).alias("document"))


def _framed(kind: str) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Lines of one file: an object keyed by id, or an array of documents that hold their ids; two spaces a level."""
    begin, end = ("{", "}") if kind == "json" else ("[", "]")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        waiting = None  # the last document, until it is known whether a comma follows
        for frame in frames:
            out = []
            for key, text in zip(frame["match_id"], frame["document"], strict=True):
                out.append(begin if waiting is None else f"{waiting},")
                document = json.loads(text)
                made = json.dumps(document if kind == "json" else {"matchId": key, **document}, indent=2, ensure_ascii=False).replace("\n", "\n  ")
                waiting = f"  {json.dumps(key, ensure_ascii=False)}: {made}" if kind == "json" else f"  {made}"
            yield pd.DataFrame({"value": out})
        if waiting is not None:
            yield pd.DataFrame({"value": [waiting, end]})

    return run


#: File types and the ends of their names.
EXTENSIONS = {"json": ".json", "json-array": ".array.json", "csv": ".csv"}


def file_name(name: str, kind: str) -> str:
    """``name`` with the extension of its file type; another type is an error."""
    if kind not in EXTENSIONS:
        raise ValueError(f"no file type {kind}")
    return name + EXTENSIONS[kind]


def write_documents(df: DataFrame, path: str, kind: str, *, files: int = 1) -> str:
    """Writes documents below ``path`` plus the type's extension, which is returned.

    'json': each file is one object keyed by match id; 'json-array': each is one array of documents
    with ``matchId`` inside; 'csv': flat, with a header. Documents are dealt to ``files`` files by
    id and stream through their writers, so a file is never held whole; of a document that comes
    several times the last in order of its text stays. No documents give no file.
    """
    target = file_name(path, kind)
    if kind == "csv":
        flat_table(df).withColumnRenamed("match_id", "matchId").coalesce(files).write.mode("overwrite").option("header", True).csv(target)
        return target
    rows = last_per_key(json_text(df), "match_id", ("document",)).repartition(files, "match_id").sortWithinPartitions("match_id")
    rows.mapInPandas(_framed(kind), "value string").write.mode("overwrite").text(target)
    return target

"""Links, lists and match documents of saved pages."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from pitchflow.functions import columns as X
from pitchflow.operators.documents import pair_siblings
from pitchflow.sources.html import Element, Reader

#: Rows whose pages' trees are held at once.
PAGES = 500
#: An anchor: its attributes and its body.
ANCHOR = r"(?is)<a\b([^>]*)>(.*?)</a>"
HREF = r"""(?i)\bhref\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)"""


def links(pages: DataFrame) -> DataFrame:
    """page_id, position (from 0), url, name of every anchor with an address; tags in names are left out."""
    attributes, bodies = (F.regexp_extract_all("html", F.lit(ANCHOR), F.lit(i)) for i in (1, 2))
    both = F.transform(F.arrays_zip(attributes.alias("a"), bodies.alias("b")), lambda x: F.struct(F.regexp_extract(x["a"], HREF, 1).alias("u"), F.trim(F.regexp_replace(x["b"], "<[^>]*>", "")).alias("name")))
    found = pages.select("page_id", F.posexplode(F.filter(both, lambda x: x["u"] != "")).alias("position", "x"))
    return found.select("page_id", "position", F.regexp_replace("x.u", "^[\"']|[\"']$", "").alias("url"), "x.name")


def headings(pages: DataFrame) -> DataFrame:
    """page_id, title, language, number of paragraphs."""
    lang = F.nullif(F.regexp_extract("html", r'<html\b[^>]*\blang="([^"]*)"', 1), F.lit(""))
    return pages.select("page_id", F.trim(F.regexp_extract("html", r"(?s)<title>(.*?)</title>", 1)).alias("title"), lang.alias("lang"), F.regexp_count("html", F.lit("<p>")).cast("long").alias("n_paragraphs"))


# ---------------------------------------------------------------- readers of a page's tree


def _read(pages: DataFrame, key: str, schema: str, *readers: tuple[str, Callable[[Element], dict[str, Any]]]) -> DataFrame:
    """``key`` and the fields that the readers find, each in its column's page: each page is read once, in one pass over the rows, and they stay in their partitions."""
    kind = pages.schema[key].dataType.simpleString()
    made = to_arrow_schema(StructType.fromDDL(f"`{key}` {kind}, {schema}"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read_all = [Reader(find) for _, find in readers]
        for batch in batches:
            for at in range(0, batch.num_rows, PAGES):
                some = batch.slice(at, PAGES)
                rows = [{} for _ in range(some.num_rows)]
                for i, read in enumerate(read_all, 1):
                    for row, text in zip(rows, some.column(i).to_pylist(), strict=True):
                        row |= read(text)
                yield pa.RecordBatch.from_arrays([some.column(0), *[pa.array([r.get(f.name) for r in rows], f.type) for f in list(made)[1:]]], names=made.names)

    columns = [F.col(column).alias(f"html_{i}") for i, (column, _) in enumerate(readers)]
    return pages.select(key, *columns).mapInArrow(run, f"`{key}` {kind}, {schema}")


def _items(pages: DataFrame, key: str, fields: str, read: Callable[[Element], list[dict[str, Any]]]) -> DataFrame:
    found = _read(pages, key, f"items array<struct<{fields}>>", ("html", lambda page: {"items": read(page)}))
    return found.select(key, F.posexplode("items").alias("position", "item")).select(key, "position", "item.*")


def _anchor(e: Element, *, with_id: bool = False) -> dict[str, Any]:
    return {"name": e, "url": (e, "href")} | ({"id": (e, "id")} if with_id else {})


def countries(pages: DataFrame, key: str = "page_id") -> DataFrame:
    """key, position, name, url, id of the countries in the left menu."""

    def read(page: Element) -> list[dict[str, Any]]:
        menu = page.first(id="category-left-menu")
        return [_anchor(a, with_id=True) for d in (menu.children if menu else []) if d.tag == "div" for inner in d.children if inner.tag == "div" for a in inner.children if a.tag == "a"]

    return _items(pages, key, "name:string,url:string,id:string", read)


def leagues(pages: DataFrame, country_id: str, key: str = "page_id") -> DataFrame:
    """key, position, name, url of the leagues that follow a country's entry in the menu."""

    def read(page: Element) -> list[dict[str, Any]]:
        entry = page.first(id=country_id)
        return [_anchor(a) for s in (entry.following() if entry else []) if s.tag == "span" for a in s.children if a.tag == "a"]

    return _items(pages, key, "name:string,url:string", read)


def seasons(pages: DataFrame, key: str = "page_id") -> DataFrame:
    """key, position, name, url of the seasons in a league's archive."""
    return _items(pages, key, "name:string,url:string", lambda page: [_anchor(a) for d in page.all("div", "archive__season") for a in d.children if a.tag == "a"])


def match_links(pages: DataFrame, key: str = "page_id") -> DataFrame:
    """key, position, id, url of the matches listed on a page; pages of one list are read together, as saved."""

    def read(page: Element) -> list[dict[str, Any]]:
        found = page.all("", "event__match", "event__match--static", "event__match--twoLine")
        return [{"element": (e, "id"), "url": (a, "href") if (a := e.first("a", "eventRowLink")) else None} for e in found]

    return _items(pages, key, "element:string,url:string", read).select(key, "position", X.link_id(F.col("element")).alias("id"), "url")


def all_links(*lists: DataFrame) -> DataFrame:
    """Fixtures and results one after another, repeats kept; no link in any of them is an error."""
    out = lists[0]
    for more in lists[1:]:
        out = out.unionByName(more)
    if out.isEmpty():
        raise ValueError("no match links found")
    return out


# ---------------------------------------------------------------- match documents

_SIDE = "name:string,image:string"
_SUMMARY = f"headers array<string>, start string, state string, home struct<{_SIDE}>, away struct<{_SIDE}>, scores array<string>, full_time string, labels array<struct<label:string,beside:string>>, pairs array<string>"
_STATISTICS = "blocks array<struct<category:string,homeValue:string,awayValue:string>>"


def _summary(page: Element) -> dict[str, Any]:
    def side(name: str) -> dict[str, Any]:
        box = page.first("", f"duelParticipant__{name}") or Element("", {})
        image = box.first("", "participant__image")
        return {"name": box.first("", "participant__participantName", "participant__overflow"), "image": (image, "src") if image else None}

    score = page.first("", "detailScore__wrapper") or Element("", {})
    table = page.first("div", data_testid="wcl-summaryMatchInformation")
    return {
        "headers": page.all("span", data_testid="wcl-scores-overline-03"),
        "start": page.first("", "duelParticipant__startTime"),
        "state": page.first("", "fixedHeaderDuel__detailStatus"),
        "home": side("home"),
        "away": side("away"),
        "scores": [e for e in score.all("span") if not e.is_a("", ("detailScore__divider",))],
        "full_time": page.first("", "detailScore__fullTime"),
        "labels": [{"label": e, "beside": next(iter(e.following()), None)} for e in page.all(data_testid="wcl-scores-overline-02")],
        "pairs": [e for e in (table.children if table else []) if e.tag == "div"],
    }


def _statistics(page: Element) -> dict[str, Any]:
    blocks = []
    for block in page.all("div", data_testid="wcl-statistics"):
        values = [s for v in block.all("div", data_testid="wcl-statistics-value") for s in v.children if s.tag == "strong"]
        blocks.append({"category": block.first("div", data_testid="wcl-statistics-category"), "homeValue": values[0] if values else None, "awayValue": values[1] if len(values) > 1 else None})
    return {"blocks": blocks}


def match_documents(pages: DataFrame, key: str = "match_id", summary: str = "summary", statistics: str = "statistics") -> DataFrame:
    """The nested document of each match from its saved summary and statistics pages; what a page lacks is null.

    A page without a state is of a match that has not started.
    """
    found = _read(pages, key, f"{_SUMMARY}, {_STATISTICS}", (summary, _summary), (statistics, _statistics))
    shootout = F.get(F.filter("labels", lambda x: F.lower(x["label"]) == "penalties"), F.lit(0))["beside"]
    clean = lambda e, f: X.clean_information(e[f])
    return found.select(
        F.col(key).cast("string").alias("match_id"),
        X.stage_of(F.get("headers", F.lit(2))).alias("stage"),
        F.col("start").alias("date"),
        X.status_or_default(F.col("state")).alias("status"),
        "home",
        "away",
        F.struct(F.get("scores", F.lit(0)).alias("home"), F.get("scores", F.lit(1)).alias("away"), X.regulation_time(F.col("full_time")).alias("regulationTime"), F.regexp_replace(shootout, r"\s+", "").alias("penalties")).alias("result"),
        F.transform(pair_siblings(F.col("pairs")), lambda e: F.struct(clean(e, "category").alias("category"), clean(e, "value").alias("value"))).alias("information"),
        F.col("blocks").alias("statistics"),
    )

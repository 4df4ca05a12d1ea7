"""Saved pages: nested tags, entities, missing parts, lists; documents as files."""

import json
import os

import pytest

from pitchflow.operators import documents
from pitchflow.sources import html, pages


def test_tree():
    page = html.parse("<div id='a'>x &amp; <b>y</b><br/>z<script>no</script><p>one<p>two</div></i><span>after</span>")
    assert page.first(id="a").text() == "x & y zonetwo" and [e.tag for e in page.children] == ["div", "span"]
    assert html.parse(None).text() == ""


def test_lists(spark):
    menu = "<div id='category-left-menu'><div><div><a id='c1' href='/x/'> A <i>b</i></a></div><div><a id='c2' href='/y/'>C</a></div></div><a>no</a></div>"
    leagues = "<div><a id='c1'>A</a><span><a href='/x/l1/'>L1</a></span><b></b><span><a href='/x/l2/'>L2</a></span></div>"
    archive = "<div class='archive__season big'><a href='/s1/'>2020</a></div><div class='archive__season'><a href='/s2/'>2019</a><p><a>no</a></p></div>"
    match = "<div id='g_1_abc' class='event__match event__match--static event__match--twoLine'><p><a class='eventRowLink' href='/m'></a></p></div><div id='g_1_d' class='event__match--twoLine event__match event__match--static'></div>"
    df = spark.createDataFrame([(1, menu), (2, leagues), (3, archive), (4, match), (5, None)], "page_id long, html string")
    got = lambda d: [tuple(r)[1:] for r in d.orderBy("page_id", "position").collect()]
    assert got(pages.countries(df)) == [(0, "A b", "/x/", "c1"), (1, "C", "/y/", "c2")]
    assert got(pages.leagues(df.where("page_id = 2"), "c1")) == [(0, "L1", "/x/l1/"), (1, "L2", "/x/l2/")]
    assert got(pages.seasons(df)) == [(0, "2020", "/s1/"), (1, "2019", "/s2/")]
    links = pages.match_links(df)
    assert got(links) == [(0, "abc", "/m"), (1, "d", None)]
    assert pages.all_links(links, links).count() == 4
    with pytest.raises(ValueError, match="no match links"):
        pages.all_links(links.where("false"))


def test_anchors_of_any_form(spark):
    df = spark.createDataFrame([(1, "<A class=x HREF='/a'>one <b>two</b></A><a name='n'>no</a><a href=\"/b\">\n three</a><a href=/c/d id=x>four</a><a href=''>no address</a>")], "page_id long, html string")
    assert [tuple(r) for r in pages.links(df).orderBy("position").collect()] == [(1, 0, "/a", "one two"), (1, 1, "/b", "\n three"), (1, 2, "/c/d", "four"), (1, 3, "", "no address")]


def test_documents_of_bare_pages_and_files(spark, tmp_path):
    summary = "<div class='detailScore__wrapper'><span>2</span><span class='detailScore__divider'>-</span><span>1</span></div><span class='detailScore__fullTime'>(1\n-1)</span><i data-testid='wcl-scores-overline-02'>Penalties</i><i>4 - 3</i><div data-testid='wcl-summaryMatchInformation'><div>Referee:</div><div>A: B</div><div>Left</div></div>"
    df = spark.createDataFrame([("m1", summary, None), ("m2", None, "<div data-testid='wcl-statistics'><div data-testid='wcl-statistics-category'>Shots</div><div data-testid='wcl-statistics-value'><strong>1</strong></div></div>")], "match_id string, summary string, statistics string")
    found = pages.match_documents(df)
    one, two = found.orderBy("match_id").collect()
    assert tuple(one["result"]) == ("2", "1", "1 -1", "4-3") and one["status"] == "NOT STARTED" and one["stage"] is None
    assert [tuple(x) for x in one["information"]] == [("Referee", "A B"), ("Left", None)] and [tuple(x) for x in two["statistics"]] == [("Shots", "1", None)]

    def read(path):
        parts = sorted(f for f in os.listdir(path) if f.startswith("part-"))
        return [t for t in ((path + "/" + f) for f in parts) if os.path.getsize(t)]

    keyed = [json.load(open(f)) for f in read(documents.write_documents(found, str(tmp_path / "k"), "json"))]
    assert len(keyed) == 1 and sorted(keyed[0]) == ["m1", "m2"] and keyed[0]["m1"]["result"]["home"] == "2" and "stage" not in keyed[0]["m1"]
    listed = [x for f in read(documents.write_documents(found.union(found), str(tmp_path / "a"), "json-array", files=3)) for x in json.load(open(f))]
    assert sorted(x["matchId"] for x in listed) == ["m1", "m2"]
    table = spark.read.option("header", True).csv(documents.write_documents(found, str(tmp_path / "c"), "csv"))
    assert table.columns[:2] == ["matchId", "status"] and table.count() == 2
    with pytest.raises(ValueError, match="no file type"):
        documents.write_documents(found, str(tmp_path / "x"), "xml")

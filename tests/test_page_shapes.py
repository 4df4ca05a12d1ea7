"""Pages of equal markup are read as if each were parsed, but are not parsed."""

import random
import time

from pitchflow.sources import html, pages

TEXTS = ["", "x", " a  b\n", "&amp; &lt;b&gt; &copy", "a < b", "3 > 2", 'say "hi" > x', "<i>", "&am", "&#65;", "it's", "<!-- c -->", "1&amp;", "é ü", "</div>"]
PAGES = [
    "<!DOCTYPE html><html><head><title>{}</title><script>if (a) {} else '<div>'</script></head><body><div id='m'>{}<b>{}</b><br/>{}<p>one<p>{}</div></i>{}</body></html>",
    "<div id='m'><a class='k' href='{}'>{}</a><img src=\"{}\" alt='x'>{}<style>p > a {}</style></div>",
    "<div id='m' title='{}'>{}<textarea>{}</textarea></div><a href={}>{}</a>{}",
    "<!-- {} --><div id='m'>{}<a href='x' title=\"a>b\">{}</a><script>{}</script>{}</div><script>{}",
    "<p title='a>{}<div id='m'>{}</div><b c=\"{}><i id='m'>x</i>{}<br / id=m>",
    "<A ID='m' HREF='{}'>{}<a href='{}' src='{}'>{}</A>",
]


def _find(page):
    box = page.first(id="m")
    return {"box": box, "links": [(a, "href") for a in page.all("a")], "images": [(i, "src") for i in page.all("img")], "hidden": page.all("script"), "none": None, "all": page, "in": [{"text": e} for e in (box.children if box else [])]}


def _filled(rnd, page):
    while "{}" in page:
        page = page.replace("{}", rnd.choice(TEXTS), 1)
    return page


def test_equal_markup_is_read_as_parsed(monkeypatch):
    rnd = random.Random(5)
    for held in (50_000, 30):
        monkeypatch.setattr(html, "HELD", held)
        read = html.Reader(_find)
        for _ in range(4_000):
            page = _filled(rnd, rnd.choice(PAGES))
            assert read(page) == html.said(_find(html.parse(page))), page
        assert read(None) == html.said(_find(html.parse(None)))


def test_only_the_first_pages_of_a_markup_are_parsed(monkeypatch):
    n, parse = [], html.parse
    monkeypatch.setattr(html, "parse", lambda x: n.append(1) or parse(x))
    read = html.Reader(pages._summary)
    got = [read(f"<script>x = '<b>';</script><div class='duelParticipant__home'><img class='participant__image' src='/{i}.png'></div><p class='duelParticipant__startTime'>{i} &amp; {i}</p>") for i in range(50)]
    assert [(r["home"]["image"], r["start"]) for r in got] == [(f"/{i}.png", f"{i} & {i}") for i in range(50)]
    assert len(n) == 2


def test_penalties_stand_beside_the_first_label_that_says_so(spark):
    mark = "<i data-testid='wcl-scores-overline-02'>"
    df = spark.createDataFrame([(1, f"<p>{mark}AET</i><i>9</i></p><p>{mark} PENALTIES </i><i>4 - 3</i></p><p>{mark}Penalties</i><i>1</i></p>", None), (2, f"<p>{mark}AET</i><i>9</i></p>", None), (3, f"<p>{mark}Penalties</i></p>", None)], "match_id long, summary string, statistics string")
    assert [r["p"] for r in pages.match_documents(df).orderBy("match_id").selectExpr("result.penalties as p").collect()] == ["4-3", None, None]


def test_long_scripts_are_read_in_one_pass():
    read, began = html.Reader(_find), time.time()
    for i in range(4):
        page = f"<div id='m'>{i}</div><script>{'{"k": ' * 100_000}{i}</script><a href='/{i}'>x</a>"
        assert read(page)["links"] == [f"/{i}"]
    assert time.time() - began < 20 and len(read.shapes) == 1 and None not in read.shapes.values()

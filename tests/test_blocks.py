"""Event blocks of pages: nesting, unclosed tags, titles, places, categories."""

import pytest

from eventloom.functions import extract as ex
from eventloom.operators import blocks


def _blocks(spark, *pages):
    df = spark.createDataFrame(list(enumerate(pages)), "page_id long, html string")
    return [tuple(r) for r in blocks.event_blocks(df).orderBy("page_id", "block").select("page_id", "time_text", "title", "venue", "unlinked", "category").collect()]


def test_a_block_holds_a_heading_or_is_an_event(spark):
    page = """<html><body><h1>Programm</h1><div class="list">
    <article><h3>Jazz <b>am</b> Abend</h3><p>20:00 Uhr</p><address>Tonne,<br>Keller</address><a href="/x">Mehr</a> Konzert</article>
    <div class="big EVENT"><span class="time"> 19.30 bis 22.00 </span><span class="title">Lesung &amp; mehr</span><a href="https://facebook.com/x">fb</a>
      <a href="/ort"> Café<i> Mitte</i></a> ( Theater )</div></div></body></html>"""
    got = _blocks(spark, page)
    assert got == [
        (0, "20:00 Uhr", "Jazz am Abend", "Tonne, Keller", "Jazz am Abend 20:00 Uhr Tonne, Keller Konzert", "Konzert"),
        (0, "19.30 bis 22.00", "Lesung & mehr", "CaféMitte", "19.30 bis 22.00 Lesung & mehr ( Theater )", "Theater"),
    ]


def test_scripts_styles_comments_and_dates_are_no_times(spark):
    page = "<div class=event><script>var t='20:00'; <p>21:00</p></script><style>a{b:10:20}</style><!-- 22:00 --><p>am 21.08.2026</p><p>Film</p></div>"
    assert _blocks(spark, page, None, "", "plain 20:15") == [(3, "20:15", None, None, "plain 20:15", None)]


def test_a_block_counts_once_with_its_first_time(spark):
    page = '<div class="event"><p>Start 18:00</p><p>Ende 23:00</p><p class="Title"> </p><p class="x title">Name</p></div>'
    assert _blocks(spark, page) == [(0, "18:00", "Name", None, "Start 18:00 Ende 23:00 Name", None)]


def test_unclosed_and_stray_tags(spark):
    page = '<ul><li class="event"><h2>Eins<p>20:00</ul></div></p><div class="event"><h2>Zwei</h2><b>21:00<i>x</b>y</i><a>Ort</a></div><p>22:00'
    got = _blocks(spark, page)
    assert [g[:3] for g in got] == [(0, "20:00", "Eins 20:00"), (0, "21:00", "Zwei"), (0, "22:00", "Eins 20:00")]
    assert got[1][3:5] == ("Ort", "Zwei 21:00 x y")


def test_at_most_six_steps_up(spark):
    deep = lambda n: "<div class='event'>" + "<div>" * n + "20:00" + "</div>" * n + "<h1>T</h1></div>"
    assert [g[2] for g in _blocks(spark, deep(5))] == ["T"]
    assert [g[2] for g in _blocks(spark, deep(6))] == ["T"]  # the sixth step ends at it, unchecked
    assert [g[2] for g in _blocks(spark, deep(7))] == [None]


def test_nested_blocks_keep_their_own_titles(spark):
    page = '<section class="event"><h2>Fest</h2><p>10:00</p><div class="event"><h3>Band</h3><p>20:00</p><a href="/b">Bühne</a></div></section>'
    assert [g[1:4] for g in _blocks(spark, page)] == [("10:00", "Fest", "Bühne"), ("20:00", "Band", "Bühne")]


def test_links_inside_links_and_hints(spark):
    page = '<div class="event"><p>20:00</p><a href="/a">Theater <b>Burg</b></a><a href="mailto:x">m</a><p>( Sonstiges )</p></div><div class="event"><p>9:00</p><a href=/t>Theater</a><p>große PARTY, Kunst</p></div>'
    assert [g[3:] for g in _blocks(spark, page)] == [("TheaterBurg", "20:00 ( Sonstiges )", None), ("Theater", "9:00 große PARTY, Kunst", "Party")]


def test_long_pages(spark):
    page = "<body>" + '<div class="event"><h3>T</h3><p>20:00</p></div>' * 4000
    assert len(_blocks(spark, page)) == 4000


@pytest.mark.parametrize("raw,want", [("a &amp;lt; b", "a &lt; b"), ("&#228;&#xE4;&#8364;", "ää€"), ("&#; &#x; &#99999999; &x", "&#; &#x; &#99999999; &x"), ("M&uuml;ller", "Müller"), (None, None)])
def test_references(spark, raw, want):
    df = spark.createDataFrame([(raw,)], "t string")
    assert df.select(ex.unescaped(df.t)).first()[0] == want

"""Queries of event blocks on pages, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators import blocks
from ..sources import tables
from .catalog import query

#: The test pages hold no times. Each gets one behind its own heading, and behind the page a block of one of five shapes.
_PAGES = """bx as (select page_id, concat(replace(coalesce(html, ''), '</h1>', '</h1><p>Beginn 19:30 Uhr</p>'), case page_id % 5
  when 0 then concat('<div class="row EVENT"><span class="title">Abend<br>', page_id, '</span> 20:00 <a href="https://facebook.com/x">fb</a><a href="/ort/1">Saal<b> ', page_id % 9, '</b></a> ( konzert )</div>')
  when 1 then concat('<section><h2>Lesung <i>Nr</i> ', page_id, '</h2><ul><li><b>18.30 bis 20.00</b><li>heute</ul><address>Haus ', page_id % 50, ' &amp; Hof</address><a href="/x">Theater</a></section></div>')
  when 2 then '<script>var t="20:00";</script><!-- 20:00 --><div class="event"><p>am 21.08.2026</div>'
  when 3 then '<div class="event"><p>Film und Theater<div class="x"><i>21:15</i></div><a>Kino</a> um 23:00</div>'
  else concat('<div class="event"><h3>Fest ', page_id, '</h3><p>10:00</p><div class="event"><h4>Band</h4>11:00 ( Sonstiges )</div></div>') end) as html from pages)"""
_H1 = """trim(replace(replace(replace(replace(regexp_extract(html, '<h1>([^<]*)</h1>', 1), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&amp;', '&'))"""
_WANT = f"""select page_id, 0 as block, '19:30 Uhr' as time_text, {_H1} as title, null as venue, null as unlinked, null as category from pages where html like '%</h1>%'
  union all select page_id, 1, '20:00', 'Abend ' || page_id, 'Saal' || page_id % 9, 'Abend ' || page_id || ' 20:00 ( konzert )', 'Konzert' from pages where page_id % 5 = 0
  union all select page_id, 1, '18.30 bis 20.00', 'Lesung Nr ' || page_id, 'Haus ' || page_id % 50 || ' & Hof',
    'Lesung Nr ' || page_id || ' 18.30 bis 20.00 heute Haus ' || page_id % 50 || ' & Hof', 'Lesung' from pages where page_id % 5 = 1
  union all select page_id, 1, '21:15', null, 'Kino', 'Film und Theater 21:15 um 23:00', 'Film' from pages where page_id % 5 = 3
  union all select page_id, 1, '10:00', 'Fest ' || page_id, null, 'Fest ' || page_id || ' 10:00 Band 11:00 ( Sonstiges )', null from pages where page_id % 5 = 4
  union all select page_id, 2, '11:00', 'Band', null, 'Band 11:00 ( Sonstiges )', null from pages where page_id % 5 = 4"""


def blocks_of(spark: SparkSession, d: str) -> DataFrame:
    tables.read_table(spark, d, "pages").createOrReplaceTempView("pages")
    return blocks.event_blocks(spark.sql(f"with {_PAGES} select * from bx"))


def _block_query(name: str, *cols: str, where: str = "true") -> None:
    picked = ", ".join(("page_id", "block", *cols))
    query(name, f"select {picked} from ({_WANT}) where {where}")(lambda spark, d: blocks_of(spark, d).where(where).select("page_id", "block", *cols))


_block_query("ext1_event_blocks", "time_text")
_block_query("ext3_block_titles", "title")
_block_query("ext4_block_venues", "venue")
# A page's own article is checked by the other three; its text is the page's.
_block_query("ext5_block_texts", "unlinked", "category", where="block > 0")

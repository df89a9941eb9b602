"""Event blocks of listing pages: a tree from the tag stream, and what stands in each block.

A page becomes a row a token, dealt by page once; everything after is windows over a page's tokens. Closing
tags meet opening ones by name and level; an element that is never closed ends where the one around it
ends, a stray closing tag counts for nothing, and ends that cross are taken in order. So elements nest, the
running sum of openings and ends is the depth, and the elements around a token are the last openings of each
lesser depth before it. Scripts, styles and comments are no text. Built-in functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import extract as ex
from ..functions import text as tx

TOKEN = (
    r"(?is)<!--.*?(?:-->|\z)|<(script|style)\b.*?(?:</\1\s*+>|\z)"
    r"""|</?[a-z][^>"']*+(?:"[^"]*+"[^>"']*+|'[^']*+'[^>"']*+)*+>|</?[a-z][^>]*+>|<[!?][^>]*+>|[^<]++|<"""
)
TAG = r"^(</?)([a-zA-Z][^\s/>]*)"
# Elements without content, and links that never name a place.
VOID = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr")
HEADINGS = ("h1", "h2", "h3", "h4")
NO_PLACE = ("facebook", "twitter", "whatsapp", "mailto", ".ics", "reservix", "eventim")
#: What an event's category may be called in running text, first match first.
CATEGORY_HINTS = ("Konzert", "Party", "Kunst", "Festival", "Film", "Theater", "Lesung", "Gespräch", "Diskussion")
FAR = 1 << 30
HOPS = 6
#: Characters of html that a task takes; its tokens are sorted several times, so its memory is some hundred times that.
TASK_CHARS = 4 << 20


def by_page(pages: DataFrame) -> DataFrame:
    """Pages dealt by page to as many tasks as their html asks for, so that a task's memory does not grow with the table."""
    chars = pages.agg(F.coalesce(F.sum(F.length("html")), F.lit(0))).first()[0]
    least = int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return pages.repartition(max(least, -(-chars // TASK_CHARS)), "page_id")


def attribute(tag: Column, name: str) -> Column:
    """An attribute's value; null if the tag has none of that name."""
    rx = rf"""(?is)^<[a-z][^>]*?\s{name}\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""
    return F.when(F.rlike(tag, F.lit(rx)), F.concat(*[F.regexp_extract(tag, rx, g) for g in (1, 2, 3)]))


def has_class(tag: Column, name: str) -> Column:
    """Whether one of the classes is ``name`` in any case."""
    return F.coalesce(F.array_contains(F.split(F.lower(F.trim(attribute(tag, "class"))), r"\s+"), name), F.lit(False))


def tokens(pages: DataFrame) -> DataFrame:
    """(page_id, pos, kind, name, token): kind "open", "close" or "text"; position -1 opens the page itself."""
    html = F.coalesce("html", F.lit(""))
    every = F.concat(F.array(F.lit("<page>")), F.regexp_extract_all(html, F.lit(TOKEN), F.lit(0)))
    each = by_page(pages).select("page_id", F.posexplode(every).alias("at", "token"))
    t, name = F.col("token"), F.lower(F.regexp_extract("token", TAG, 2))
    silent = (name != "") & (name.isin("script", "style", *VOID) | t.endswith("/>"))
    kind = F.when(t.startswith("</") & (name != ""), "close").when(name != "", "open").when(~t.rlike(r"^<[!?]"), "text")
    got = each.select("page_id", (F.col("at") - 1).alias("pos"), kind.alias("kind"), name.alias("name"), "token", silent.alias("silent"))
    return got.where("kind is not null and not silent").drop("silent")


def tree(tokens_: DataFrame) -> DataFrame:
    """Tokens with depth; openings know their end, and the number of headings and texts before both.

    Adds depth (elements open, an opening's own among them), e (position of the end), texts (number of texts before),
    e_texts and e_headings (those before the end) and headings.
    """
    page = Window.partitionBy("page_id")
    named = Window.partitionBy("page_id", "name").orderBy("pos")
    step = F.when(F.col("kind") == "open", 1).when(F.col("kind") == "close", -1).otherwise(0)
    rows = tokens_.withColumn("s", F.sum(step).over(named))
    rows = rows.withColumn("low", F.least(F.lit(0), F.min("s").over(named)))
    before = F.coalesce(F.lag("low").over(named), F.lit(0))
    rows = rows.withColumn("stray", (F.col("kind") == "close") & (F.col("low") < before))
    # An opening's level is its own count, a closing tag's that of the opening it meets.
    rows = rows.where("not stray").withColumn("level", F.col("s") - F.col("low") + F.when(F.col("kind") == "close", 1).otherwise(0))
    level = Window.partitionBy("page_id", "name", "level").orderBy("pos")
    rows = rows.withColumn("closed", (F.col("kind") == "open") & (F.coalesce(F.lead("kind").over(level), F.lit("")) == "close"))
    # Openings without an end: it is the next end of a closed element that was open there.
    running = page.orderBy("pos")
    rows = rows.withColumn("d", F.sum(F.when(F.col("closed"), 1).when(F.col("kind") == "close", -1).otherwise(0)).over(running))
    rows = rows.withColumn("key", F.col("d") + F.when(F.col("kind") == "close", 1).otherwise(0))
    # What follows is read backwards: a frame that only grows costs one step a row.
    after = Window.partitionBy("page_id", "key").orderBy(F.desc("pos")).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("end", F.last(F.when(F.col("kind") == "close", F.col("pos")), ignorenulls=True).over(after))
    own = F.struct(F.col("pos").alias("pos"), F.lit(1).alias("turn"), F.col("kind").alias("kind"))
    implied = F.struct(F.coalesce("end", F.lit(FAR)).alias("pos"), F.lit(0).alias("turn"), F.lit("close").alias("kind"))
    both = F.when((F.col("kind") == "open") & ~F.col("closed"), F.array(own, implied)).otherwise(F.array(own))
    rows = rows.select("page_id", "name", "token", F.explode(both).alias("x")).select("page_id", "name", "token", "x.*")
    # Implied ends may share a place: rows, not values, are counted.
    running = page.orderBy("pos", "turn").rowsBetween(Window.unboundedPreceding, 0)
    opened, closing = F.col("kind") == "open", F.col("kind") == "close"
    rows = rows.withColumn("depth", F.sum(F.when(opened, 1).when(closing, -1).otherwise(0)).over(running))
    rows = rows.withColumn("text", F.when(F.col("kind") == "text", F.nullif(tx.strip(ex.unescaped(F.col("token"))), F.lit(""))))
    rows = rows.withColumns({"texts": F.count("text").over(running), "headings": F.count(F.when(opened & F.col("name").isin(*HEADINGS), 1)).over(running)})
    rows = rows.withColumn("key", F.col("depth") + F.when(closing, 1).otherwise(0))
    after = Window.partitionBy("page_id", "key").orderBy(F.desc("pos"), F.desc("turn")).rowsBetween(Window.unboundedPreceding, -1)
    end = F.last(F.when(closing, F.struct(F.col("pos").alias("e"), F.col("texts").alias("e_texts"), F.col("headings").alias("e_headings"))), ignorenulls=True)
    return rows.withColumn("end", F.when(opened, end.over(after))).where(~closing).select("page_id", "pos", "kind", "name", "token", "text", "depth", "texts", "headings", "end.*")


def _following(tree_: DataFrame) -> DataFrame:
    """Openings with the ranges of texts that may give a block's title and place: the first such element after them."""
    after = Window.partitionBy("page_id").orderBy(F.desc("pos")).rowsBetween(Window.unboundedPreceding, -1)
    span = F.struct("pos", F.col("texts").alias("lo"), F.col("e_texts").alias("hi"))
    opened, said = F.col("kind") == "open", F.col("e_texts") > F.col("texts")
    href = F.lower(F.coalesce(attribute(F.col("token"), "href"), F.lit("")))
    place = (F.col("name") == "a") & said & ~F.exists(F.array(*map(F.lit, NO_PLACE)), lambda p: F.contains(href, p))
    wanted = {
        "heading": F.col("name").isin(*HEADINGS),
        "titled": has_class(F.col("token"), "title") & said,
        "address": F.col("name") == "address",
        "place": place,
    }
    marked = tree_.withColumns({k: F.when(opened & v, span) for k, v in wanted.items()})
    return marked.withColumns({k: F.last(k, ignorenulls=True).over(after) for k in wanted})


def event_blocks(pages: DataFrame) -> DataFrame:
    """(page_id, block, time_text, title, venue, text, unlinked, category): the blocks around time-like texts, in page order.

    A block is the nearest element around such a text, at most ``HOPS`` up, that holds a heading (h1 to h4) or has the
    class "event"; where none does, the one ``HOPS`` up, or the page. A block counts once, with its first time. Its title is
    its first heading, else its first element of class "title" that says something; its venue the first address, else the
    first link that leads to no network or ticket shop; ``unlinked`` its text without links' labels; category what stands in
    parentheses there or else the first of ``CATEGORY_HINTS`` in it. A null html is a page without blocks.
    """
    nodes = _following(tree(tokens(pages)))
    event = (F.col("e_headings") > F.col("headings")) | has_class(F.col("token"), "event")
    fields = ("pos", "e", "texts", "e_texts", "heading", "titled", "address", "place")
    element = F.struct(*fields, event.alias("event"))
    timed = F.when(F.col("kind") == "text", ex.time_text(F.col("text")))
    # Each time looks for the last opening before it at its own depth and at up to six lesser ones.
    hops = F.filter(F.transform(F.sequence(F.lit(0), F.lit(HOPS)), lambda h: F.struct(h.alias("hop"), (F.col("depth") - h).alias("key"))), lambda x: x["key"] >= 1)
    keys = F.when(F.col("kind") == "open", F.array(F.struct(F.lit(-1).alias("hop"), F.col("depth").alias("key")))).when(timed.isNotNull(), hops)
    probes = nodes.select("page_id", F.col("pos").alias("at"), timed.alias("time_text"), F.when(F.col("kind") == "open", element).alias("el"), F.explode(keys).alias("k"))
    before = Window.partitionBy("page_id", "k.key").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    around = probes.withColumn("el", F.last("el", ignorenulls=True).over(before)).where("k.hop >= 0")
    fit = F.when(F.col("el.event") & (F.col("k.hop") < HOPS), F.col("k.hop")).otherwise(100 - F.col("k.hop"))
    nearest = around.groupBy("page_id", "at", "time_text").agg(F.min_by("el", fit).alias("el"))
    blocks = nearest.groupBy("page_id", F.col("el.pos").alias("pos")).agg(F.min_by("time_text", "at").alias("time_text"), F.first("el").alias("el"), F.min("at").alias("at"))
    order = F.array_sort(F.collect_list(F.struct("at", "time_text", "el")))
    per_page = blocks.groupBy("page_id").agg(order.alias("blocks"))
    # A page's texts in order, and for each how many links are open around it.
    linked = Window.partitionBy("page_id").orderBy("pos")
    ends = F.max(F.when((F.col("kind") == "open") & (F.col("name") == "a"), F.col("e"))).over(linked)
    texts = nodes.withColumn("linked", F.coalesce(ends > F.col("pos"), F.lit(False))).where("text is not null")
    texts = texts.groupBy("page_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "text", "linked"))), lambda x: F.struct(x["text"].alias("t"), x["linked"].alias("linked"))).alias("said"))
    both = per_page.join(texts, "page_id").select("page_id", F.posexplode(F.transform("blocks", lambda b: _told(b, F.col("said")))).alias("block", "b"))
    told = both.select("page_id", "block", "b.*")
    return told.withColumn("category", category(F.col("unlinked")))


def _told(block: Column, said: Column) -> Column:
    el = block["el"]

    def texts(span: Column, lo: str = "lo", hi: str = "hi") -> Column:
        return F.slice(said, span[lo] + 1, span[hi] - span[lo])

    def inside(name: str, sep: str = " ") -> Column:
        own = (el[name]["pos"] > el["pos"]) & (el[name]["pos"] < el["e"])
        return F.when(own, F.array_join(F.transform(texts(el[name]), lambda x: x["t"]), sep))

    whole = texts(el, "texts", "e_texts")
    bare = F.array_join(F.transform(F.filter(whole, lambda x: ~x["linked"]), lambda x: x["t"]), " ")
    venue = F.coalesce(F.nullif(inside("address"), F.lit("")), inside("place", ""))
    # A heading counts even if it says nothing; the class "title" only where there is no heading.
    title = F.coalesce(inside("heading"), inside("titled"))
    return F.struct(
        block["time_text"].alias("time_text"),
        title.alias("title"),
        venue.alias("venue"),
        F.array_join(F.transform(whole, lambda x: x["t"]), " ").alias("text"),
        bare.alias("unlinked"),
    )


def category(text: Column) -> Column:
    """The hint that stands in parentheses (any other word there: null), else the first hint that the text holds."""
    put = ex.paren_category(text)
    exact = F.coalesce(*[F.when(F.lower(put) == h.lower(), F.lit(h)) for h in CATEGORY_HINTS])
    held = F.coalesce(*[F.when(F.contains(F.lower(text), F.lit(h.lower())), F.lit(h)) for h in CATEGORY_HINTS])
    return F.when(put.isNotNull(), exact).otherwise(held)

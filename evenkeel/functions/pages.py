"""Sections of HTML pages and of markdown: headings, anchors, tables of contents, and the text under them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evenkeel.functions.grammar import slug

HEADING = r"(?s)<h[1-6][^>]*>.*?</h[1-6]>"
# Named entities and what they stand for; the ampersand comes last.
ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&"))


def plain(html: Column) -> Column:
    """Text without tags, entities resolved, white space collapsed."""
    out = F.regexp_replace(html, r"(?s)<[^>]*>", "")
    for name, value in ENTITIES:
        out = F.replace(out, F.lit(name), F.lit(value))
    return F.trim(F.regexp_replace(out, r"[ \t\r\n]+", " "))


def sections(pages: DataFrame, most: int = 220) -> DataFrame:
    """page_id, place, heading, anchor, snippet: the lead-in and every heading with what follows it."""
    heads = F.concat(F.array(F.lit("")), F.regexp_extract_all("html", F.lit(f"({HEADING})"), 1))
    rows = pages.select("page_id", F.posexplode(F.arrays_zip(heads.alias("head"), F.split("html", HEADING).alias("body"))).alias("place", "s"))
    heading = plain(F.coalesce(F.col("s.head"), F.lit("")))
    out = rows.select("page_id", "place", heading.alias("heading"), slug(heading).alias("anchor"), F.substr(plain(F.col("s.body")), F.lit(1), F.lit(most)).alias("snippet"))
    return out.where("heading <> '' or snippet <> ''")


FENCE, ATX = r"^ {0,3}(`{3,}|~{3,})(.*)$", r"^ {0,3}(#{1,6})(?:[ \t]+(.*?))??(?:[ \t]+#+)?[ \t]*$"


def markdown_plain(text: Column) -> Column:
    """Running text of markdown: without marks of quotes, lists, tables, links, emphasis and code; white space collapsed."""
    out = F.regexp_replace(text, r"(?m)^ {0,3}(?:`{3,}[^`\n]*|~{3,}.*)$", " ")
    out = F.regexp_replace(out, r"(?m)^[ \t]*\|?(?:[ \t]*:?-+:?[ \t]*\|)+[ \t:-]*$", " ")
    out = F.regexp_replace(out, r"(?m)^[ \t]*(?:>[ \t]?)*(?:[-*+][ \t]+|\d+[.)][ \t]+)?", "")
    out = F.regexp_replace(out, r"!?\[([^\]]*)\]\([^)]*\)", "$1")
    return F.trim(F.regexp_replace(F.translate(out, "|`*_", " "), r"\s+", " "))


def markdown_headings(text: Column) -> Column:
    """line (from 0), level and raw text of every heading; a line inside a code fence is none.

    Lines that may open a fence, close one or be a heading are folded in order, with the open
    fence as state; a fence ends with at least as many of its own marks and nothing else.
    """
    lines = F.transform(F.split(text, "\\r?\\n"), lambda line, k: F.struct(k.alias("line"), line.alias("text")))
    some = F.filter(lines, lambda x: x["text"].rlike(FENCE) | x["text"].rlike(ATX))
    kind = "struct<fence:string,heads:array<struct<line:int,level:int,raw:string>>>"
    start = F.struct(F.lit("").alias("fence"), F.array().alias("heads")).cast(kind)

    def step(state: Column, x: Column) -> Column:
        marks, rest = F.regexp_extract(x["text"], FENCE, 1), F.regexp_extract(x["text"], FENCE, 2)
        opens = (state["fence"] == "") & (marks != "") & ~(F.startswith(marks, F.lit("`")) & F.contains(rest, F.lit("`")))
        closes = (state["fence"] != "") & F.startswith(marks, state["fence"]) & (F.trim(rest) == "")
        fence = F.when(opens, marks).when(closes, "").otherwise(state["fence"])
        head = F.struct(x["line"].alias("line"), F.length(F.regexp_extract(x["text"], ATX, 1)).alias("level"), F.regexp_extract(x["text"], ATX, 2).alias("raw"))
        is_head = (state["fence"] == "") & (marks == "")
        return F.struct(fence.alias("fence"), F.when(is_head, F.concat(state["heads"], F.array(head))).otherwise(state["heads"]).alias("heads")).cast(kind)

    return F.aggregate(some, start, step)["heads"]


def markdown_sections(pages: DataFrame, most: int = 220) -> DataFrame:
    """page_id, place, level, heading, anchor, parent, snippet: the lead-in (level 0) and every heading with the text up to the next.

    An anchor that an earlier heading of the page has gets its number after it. parent is the place of the
    nearest earlier heading of a lower level, so that rows of some levels make a nested table of contents.
    A null text has no sections.
    """
    heads = F.concat(F.array(F.struct(F.lit(-1).alias("line"), F.lit(0).alias("level"), F.lit("").alias("raw"))), markdown_headings(F.col("text")))
    rows = pages.where("text is not null").select("page_id", F.split("text", "\\r?\\n").alias("lines"), heads.alias("heads"))
    ends = F.transform("heads", lambda h, k: F.struct(h.alias("h"), F.coalesce(F.get(F.col("heads"), k + 1)["line"], F.size("lines")).alias("to")))
    rows = rows.select("page_id", "lines", F.posexplode(ends).alias("place", "s"))
    begin = F.col("s.h.line") + 1
    body = F.array_join(F.slice("lines", begin + 1, F.col("s.to") - begin), "\n")
    raw = F.col("s.h.raw")
    rows = rows.select("page_id", "place", F.col("s.h.level").alias("level"), markdown_plain(raw).alias("heading"), F.when(F.col("place") > 0, F.coalesce(F.nullif(slug(F.translate(raw, "`*_[]()", "")), F.lit("")), F.lit("section"))).alias("slug"), F.substr(markdown_plain(body), F.lit(1), F.lit(most)).alias("snippet"))
    page = Window.partitionBy("page_id").orderBy("place")
    nth = F.row_number().over(Window.partitionBy("page_id", "slug").orderBy("place"))
    before = [F.last(F.when(F.col("level") == k, F.col("place")), ignorenulls=True).over(page) for k in range(1, 6)]
    rows = rows.withColumns({"nth": nth} | {f"before_{k + 1}": b for k, b in enumerate(before)})
    parent = F.array_max(F.array(*(F.when(F.col("level") > k, F.col(f"before_{k}")) for k in range(1, 6))))
    anchor = F.concat("slug", F.when(F.col("nth") > 1, F.concat(F.lit("-"), F.col("nth").cast("string"))).otherwise(""))
    out = rows.select("page_id", "place", "level", "heading", F.coalesce(anchor, F.lit("")).alias("anchor"), parent.alias("parent"), "snippet")
    return out.where("heading <> '' or snippet <> ''")


def contents(sections: DataFrame, least: int = 2, most: int = 3) -> DataFrame:
    """page_id, place, level, heading, anchor and parent of the headings of some levels: a table of contents."""
    return sections.where((F.col("level") >= least) & (F.col("level") <= most)).select("page_id", "place", "level", "heading", "anchor", "parent")

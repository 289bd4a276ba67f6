"""Main text of web pages by consensus of a host's pages.

1. Each page is cut into blocks under containers (body, div, article, section, main, cells),
   named by a generalised path of tags and classes: numbers and hash-like names are
   replaced, so that `div.post-17` and `div.post-18` are one. Blocks in menus, headers,
   footers, sidebars, notices, adverts, forms, scripts, styles and reader comments, known
   by tag, role or class, are left out.
2. A page scores its containers by text outside links (more in an article) and votes for
   the smallest that holds four fifths of it.
3. Spark counts votes and occurrences for each host and path; a path's rating is its share
   of votes where it occurs.
4. Every page is extracted again under its path of the highest rating; a page without any
   rated path keeps its own choice.

Counts are combined before the shuffle, so a host of any size is no large task. A host has
at most 100 rated paths (each has a hundredth of the votes); the rated paths are broadcast
while their measured number is under `most_broadcast`, else joined by shuffle.

Defined results. A null or empty html has an empty text; a null url belongs to the empty
host. Pages repeat as given and vote each time. Broken markup is read as browsers do:
paragraphs, items and cells close each other, stray end tags do nothing, what isn't closed
ends with the page. Ties of rating go to the deeper path, then to the smaller hash. An
empty table has no rows. Extra columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from html import unescape

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evenkeel.llm.url_filter import host_and_path
from evenkeel.sources.tables import materialize

MOST_BROADCAST = 200_000
SHARE = 0.8
SEEN = 0.2
IN_ARTICLE = 4

_TOKEN = re.compile(r"""<!--(?:-?>|.*?(?:--!?>|\Z))|<[!?][^>]*+(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*+)((?:=\s*+(?:"[^"]*+"|'[^']*+')|[^>])*+)(?:>|\Z)""", re.S)
_ATTRIBUTE = re.compile(r"""([^\s=/>"']++)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s>]++)))?""")
_NAME_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")

CONTAINERS = frozenset("body div article section main td th center".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
BLOCKS = CONTAINERS - {"td", "th"} | HEADINGS | frozenset(
    "address aside blockquote caption dd details dialog dir dl dt fieldset figcaption figure footer form header hgroup hr html legend li menu nav ol p pre search summary table tbody tfoot thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
DROPPED = frozenset("nav aside footer menu search dialog noscript template svg object canvas audio video select button datalist output".split())
ROLES = frozenset("navigation banner contentinfo complementary search menu menubar toolbar alert alertdialog dialog form".split())
#: Parts of class names and ids.
BOILERPLATE = frozenset(
    """ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation menu breadcrumb breadcrumbs
    footer sidebar aside cookie cookies consent gdpr notice notices notification notifications alert popup modal overlay newsletter subscribe signup login search
    share sharing social widget widgets toolbar pagination pager masthead topbar""".split()
)
COMMENTS = frozenset("comment comments commentlist respond reply replies disqus discussion related recommended recommendations trending".split())
LAYOUT = frozenset("has with no without is".split())
#: An element of one kind ends open ones of these kinds, up to the nearest element that holds it.
ENDS = {"li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"table", "tr"}), "th": ({"td", "th"}, {"table", "tr"})}


@dataclass
class Frame:
    """What holds inside an open element."""

    tag: str
    node: int
    dropped: bool = False
    soft: tuple[int, ...] = ()
    heading: bool = False
    title_only: bool = False
    article: bool = False


@dataclass
class Page:
    """Blocks (node, heading, chars in links, text, doubtful elements around it) and containers (parent, path, depth) of a page."""

    blocks: list[tuple[int, bool, int, str, tuple[int, ...]]] = field(default_factory=list)
    parents: list[int] = field(default_factory=lambda: [-1])
    paths: list[int] = field(default_factory=lambda: [1])
    depths: list[int] = field(default_factory=lambda: [0])
    articles: set[int] = field(default_factory=set)


def general(name: str) -> str:
    """A class name without its numbers and what looks like a hash."""
    parts = re.split(r"([-_])", name)
    return "".join("*" if len(re.findall(r"\d+|[^\W\d]+", p)) > 2 else re.sub(r"\d+", "#", p) for p in parts)


def _kind(tag: str, about: dict[str, str]) -> str:
    """comment, boilerplate, header or nothing, as tag, role, class and id tell."""
    if about.get("role", "").lower() in ROLES:
        return "boilerplate"
    found = "header" if tag == "header" else "boilerplate" if tag == "form" else ""
    for name in f"{about.get('class', '')} {about.get('id', '')}".split():
        parts = [p.lower() for p in _NAME_PART.findall(name)]
        if not parts or parts[0] in LAYOUT:
            continue
        if not COMMENTS.isdisjoint(parts):
            return "comment"
        if not BOILERPLATE.isdisjoint(parts):
            found = "boilerplate"
        elif "header" in parts and not found:
            found = "header"
    return found


def parse(html: str) -> Page:
    page, nodes = Page(), {}
    stack = [Frame("body", 0)]
    lifted: set[int] = set()
    pieces: list[str] = []
    open_tags: Counter[str] = Counter()
    linked, in_link, n_soft, at = 0, False, 0, 0

    def flush() -> None:
        nonlocal linked
        text = " ".join("".join(pieces).split())
        top = stack[-1]
        if text:
            page.blocks.append((top.node, top.heading, linked, text, top.soft))
        pieces.clear()
        linked = 0

    def pop_to(depth: int) -> None:
        if any(f.tag in BLOCKS for f in stack[depth:]):
            flush()
        open_tags.subtract(f.tag for f in stack[depth:])
        del stack[depth:]

    while at < len(html):
        token = _TOKEN.search(html, at)
        text = html[at : token.start() if token else len(html)]
        top = stack[-1]
        if text and not top.dropped and (top.heading or not top.title_only):
            pieces.append(unescape(text) if "&" in text else text)
            linked += len(text.strip()) if in_link else 0
        if not token:
            break
        at = token.end()
        tag = (token[2] or "").lower()
        if not tag or tag in ("html", "body"):
            continue
        if token[1]:
            if tag == "a":
                in_link = False
            elif tag in ("td", "th"):
                pieces.append(" ")
            for k in range(len(stack) - 1, 0, -1) if open_tags[tag] else ():
                if stack[k].tag == tag:
                    pop_to(k)
                    break
                if stack[k].tag in ("td", "th", "table") and tag not in ("td", "th", "tr", "tbody", "thead", "tfoot", "table"):
                    break
            if tag in BLOCKS:
                flush()
                in_link = False
            continue
        if tag == "br":
            pieces.append(" ")
        elif tag == "a":
            in_link = True
        elif tag in RAW:
            end = re.compile(rf"</{tag}(?=[\s/>])", re.I).search(html, at)
            at = end.start() if end else len(html)
            continue
        if tag in BLOCKS:
            flush()
            if stack[-1].tag == "p" or stack[-1].tag in HEADINGS and tag in HEADINGS:
                pop_to(len(stack) - 1)
        if tag in VOID:
            continue
        if tag in ENDS:
            closed, holders = ENDS[tag]
            for k in range(len(stack) - 1, 0, -1) if any(open_tags[t] for t in closed) else ():
                if stack[k].tag in holders:
                    break
                if stack[k].tag in closed:
                    pop_to(k)
            if tag in ("td", "th"):
                pieces.append(" ")
        if tag not in BLOCKS and tag not in CONTAINERS and tag not in DROPPED:
            continue  # inline elements change nothing
        above = stack[-1]
        frame = Frame(tag, above.node, above.dropped or tag in DROPPED, above.soft, above.heading or tag in HEADINGS, above.title_only, above.article)
        about = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTRIBUTE.finditer(token[3])}
        kind = _kind(tag, about)
        if kind == "header":
            if above.article or not {"entry", "post", "article"}.isdisjoint(_NAME_PART.findall(about.get("class", ""))):
                frame.title_only = True
            else:
                kind = "boilerplate"
        if kind == "comment" or tag == "article" and above.article:
            frame.dropped = True
        elif kind == "boilerplate":
            n_soft += 1
            frame.soft = (*above.soft, n_soft)
        elif tag in ("article", "main") and not frame.dropped:
            lifted.update(frame.soft)  # what holds the article is a layout, whatever its name
        if tag in CONTAINERS:
            label = ".".join([tag, *sorted(map(general, about.get("class", "").split()))])
            frame.node = nodes.setdefault((above.node, label), len(page.parents))
            if frame.node == len(page.parents):
                page.parents.append(above.node)
                page.paths.append(xxhash.xxh64_intdigest(label, page.paths[above.node]) >> 1)
                page.depths.append(page.depths[above.node] + 1)
            if tag == "article" and not kind:
                frame.article = True
                page.articles.add(frame.node)
        stack.append(frame)
        open_tags[tag] += 1
    flush()
    page.blocks = [b for b in page.blocks if lifted.issuperset(b[4])]
    return page


def scores(page: Page) -> tuple[list[float], list[float]]:
    """For each container, the weight of its text and of its headings; links weigh against it."""
    n = len(page.parents)
    inside = [False] * n
    for k in range(1, n):
        inside[k] = k in page.articles or inside[page.parents[k]]
    text, titles = [0.0] * n, [0.0] * n
    for node, heading, linked, block, _ in page.blocks:
        worth = max(len(block) - 2 * linked, 0) * (IN_ARTICLE if inside[node] else 1)
        (titles if heading else text)[node] += worth
    for k in range(n - 1, 0, -1):
        text[page.parents[k]] += text[k]
        titles[page.parents[k]] += titles[k]
    return text, titles


def choice(page: Page, text: list[float], titles: list[float]) -> int:
    """The smallest container with most of the text; an article as a whole; else with the headings above."""
    weight = text if text[0] else titles
    best = 0
    for k in range(1, len(weight)):
        if weight[k] >= SHARE * weight[0] > 0 and page.parents[k] == best and best not in page.articles:
            best = k
    if best not in page.articles:
        above = best
        while above and titles[above] == titles[best] and text[page.parents[above]] == text[best]:
            above = page.parents[above]
        if titles[above] > titles[best]:
            best = above
    return best


def candidates(pages: DataFrame) -> DataFrame:
    """host, path, depth, votes and seen (pages that hold a fifth of their text under it)."""
    host, _ = host_and_path(F.col("url").cast("string"))
    rows = pages.select(host.alias("host"), F.col("html").cast("string").alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: dict[tuple[str, int], list[int]] = {}
            for host, html in zip(batch.column("host").to_pylist(), batch.column("html")):
                page = parse(html.as_py() or "")
                text, titles = scores(page)
                both = [a + b for a, b in zip(text, titles)]
                mine = choice(page, text, titles)
                for k, weight in enumerate(both):
                    if both[0] and (weight >= SEEN * both[0] or k == mine):
                        row = found.setdefault((host, page.paths[k]), [page.depths[k], 0, 0])
                        row[1] += k == mine
                        row[2] += 1
            columns = list(zip(*((*key, *row) for key, row in found.items()))) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.int64()))], ["host", "path", "depth", "votes", "seen"])

    counts = rows.mapInArrow(run, "host string, path long, depth int, votes long, seen long")
    return counts.groupBy("host", "path").agg(F.max("depth").alias("depth"), F.sum("votes").alias("votes"), F.sum("seen").alias("seen"))


def winning_paths(found: DataFrame, least_votes: int = 2, least_pct: int = 1) -> DataFrame:
    """host and its rated paths: those with votes enough, and the share of votes where they occur."""
    pages = found.groupBy("host").agg(F.sum("votes").alias("pages"))
    kept = found.where(F.col("votes") >= least_votes).join(pages, "host").where(100 * F.col("votes") >= least_pct * F.col("pages"))
    rated = F.struct((F.col("votes") / (F.col("seen") + 2)).alias("rating"), "depth", "path")
    return kept.groupBy("host").agg(F.collect_list(rated).alias("rated"))


def main_text(html: str, rated: list[dict]) -> str:
    """The page's blocks under its path of the highest rating."""
    page = parse(html)
    known = {r["path"]: (r["rating"], r["depth"], -r["path"]) for r in rated}
    mine = [k for k in range(len(page.paths)) if page.paths[k] in known]
    best = max(mine, key=lambda k: known[page.paths[k]]) if mine else choice(page, *scores(page))
    under = [k == best for k in range(len(page.parents))]
    for k in range(best + 1, len(under)):
        under[k] = under[page.parents[k]]
    return "\n".join(block for node, _, _, block, _ in page.blocks if under[node])


def extract(pages: DataFrame, most_broadcast: int = MOST_BROADCAST) -> DataFrame:
    """page_id, url, text and n_chars of every page."""
    rated = materialize(winning_paths(candidates(pages)), "html-paths")
    n = rated.agg(F.sum(F.size("rated"))).first()[0] or 0
    host, _ = host_and_path(F.col("url").cast("string"))
    rows = pages.select("page_id", "url", F.col("html").cast("string").alias("html"), host.alias("host"))
    rows = rows.join(F.broadcast(rated) if n <= most_broadcast else rated, "host", "left").drop("host")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(html.as_py() or "", rated.as_py() or []) for html, rated in zip(batch.column("html"), batch.column("rated"))]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string())], ["page_id", "url", "text"])

    out = rows.mapInArrow(run, rows.select("page_id", "url", F.lit("").alias("text")).schema)
    return out.withColumn("n_chars", F.char_length("text").cast("long"))

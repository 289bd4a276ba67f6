"""URL filters: a blocked Bloom filter before an exact hash join, in DataFrame functions only.

Listed URLs are kept in canonical form. Each sets one bit in each of the eight 32-bit
words of one block; the filter is a table of blocks (about `bits_per_url` bits for each
listed URL, so it follows the list). Blocks are broadcast while their number, which the
list's size fixes, is under `most_blocks`; beyond it they are joined by shuffle. URLs
whose eight bits are all set are possible hits; only these go to an exact join with the
list, which removes the false positives.

Rules (a host with its subdomains, and a path prefix) come before the list; of the rules
that fit, the longest wins.

`listed_urls` makes a list from crawled pages: canonical URLs under which the pages' html,
summed over http and https, www. and m., index pages and parameters, is full of noise marks,
or whose host has a listed label. A page may so be blocked for what its other addresses show.

Defined results. A url that is null or has no `://` has an empty host and path, fits no
rule and is in no list. Repeated urls are judged alike. An empty list blocks nothing.
Extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evenkeel.sources.tables import materialize

WORDS = 8
MOST_BLOCKS = 1 << 16
#: Marks that are noise in running text, and the share of them from which a URL is listed.
NOISE, NOISE_PCT = "#*$%|", 2
#: Host labels whose pages are listed.
LISTED_LABELS = ("spam-farm", "adult-x", "free-bets")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path


RULES = (
    Rule("net", "/", "block"),
    Rule("example.net", "/en/", "allow"),
    Rule("example.com", "/de/", "block"),
    Rule("org", "/fr/", "allow"),
)


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, F.lit("://"))
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substr(rest, F.char_length(host) + 1), r"^[^?#]*", 0)
    empty = F.lit("")
    return F.coalesce(F.translate(host, UPPER, LOWER), empty), F.coalesce(path, empty)


def canonical(host: Column, path: Column) -> Column:
    """Host without a leading www. or m., path without an index page, .html or closing slash; null without a host."""
    bare = F.regexp_replace(host, r"^(www|m)\.", "")
    return F.when(host != "", F.concat(bare, F.regexp_replace(path, r"(/index)?(\.html?)?/*$", "")))


def fitting(host: Column, path: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """The longest rule that fits, as a struct of name and verdict, or null."""
    found = None
    for rule in sorted(rules, key=lambda r: (-len(r.name), r.name)):
        fits = ((host == rule.host) | F.endswith(host, F.lit("." + rule.host))) & F.startswith(path, F.lit(rule.path))
        value = F.struct(F.lit(rule.name).alias("rule"), F.lit(rule.verdict).alias("verdict"))
        found = F.when(fits, value) if found is None else found.when(fits, value)
    return found


def _place(url: Column, blocks: int) -> tuple[Column, list[Column]]:
    """The url's block, and its mask in each word of it."""
    spread = F.xxhash64(url, F.lit(1))
    at = lambda k: F.shiftrightunsigned(spread, 5 * k).bitwiseAND(F.lit(31)).cast("int")
    masks = [F.call_function("shiftleft", F.lit(1).cast("long"), at(k)) for k in range(WORDS)]
    return F.pmod(F.xxhash64(url), F.lit(blocks)), masks


def n_blocks(listed: int, bits_per_url: int = 16) -> int:
    return max(1, -(-listed * bits_per_url // (32 * WORDS)))


def bloom(listed: DataFrame, blocks: int) -> DataFrame:
    """block and its words w0..w7, from a column `listed` of canonical URLs."""
    block, masks = _place(F.col("listed"), blocks)
    set_ = listed.select(block.alias("block"), *(m.alias(f"w{k}") for k, m in enumerate(masks)))
    return set_.groupBy("block").agg(*(F.bit_or(f"w{k}").alias(f"w{k}") for k in range(WORDS)))


def possible(urls: DataFrame, filter_: DataFrame, blocks: int, most_blocks: int = MOST_BLOCKS) -> DataFrame:
    """All rows of `urls` (with a column canonical) and `maybe`: the filter has all bits of it."""
    block, masks = _place(F.col("canonical"), blocks)
    side = F.broadcast(filter_) if blocks <= most_blocks else filter_
    hit = F.lit(True)
    for k, mask in enumerate(masks):
        hit &= F.col(f"w{k}").bitwiseAND(mask) != 0
    joined = urls.withColumn("block", F.when(F.col("canonical").isNotNull(), block)).join(side, "block", "left")
    return joined.select(*urls.columns, F.coalesce(hit & F.col("canonical").isNotNull(), F.lit(False)).alias("maybe"))


def judge(pages: DataFrame, listed: DataFrame, rules: tuple[Rule, ...] = RULES, most_blocks: int = MOST_BLOCKS) -> DataFrame:
    """page_id, host, path, rule, listed and verdict of every page; `listed` has distinct canonical URLs."""
    host, path = host_and_path(F.col("url"))
    urls = pages.select("page_id", host.alias("host"), path.alias("path"))
    urls = urls.select("*", canonical(F.col("host"), F.col("path")).alias("canonical"), fitting(F.col("host"), F.col("path"), rules).alias("fit"))
    listed = materialize(listed, "url-list")
    blocks = n_blocks(listed.count())
    marked = possible(urls, bloom(listed, blocks), blocks, most_blocks)
    # the exact join sees possible hits only; the rest needs none
    exact = marked.where("maybe").join(listed, F.col("canonical") == F.col("listed"), "left")
    rest = marked.where("not maybe").withColumn("listed", F.lit(None).cast("string"))
    both = exact.unionByName(rest)
    on_list = F.col("listed").isNotNull()
    verdict = F.coalesce(F.col("fit.verdict"), F.when(on_list, "block").otherwise("allow"))
    return both.select("page_id", "host", "path", F.col("fit.rule").alias("rule"), on_list.alias("listed"), verdict.alias("verdict"))


def listed_urls(pages: DataFrame, labels: tuple[str, ...], noise_pct: int = NOISE_PCT) -> DataFrame:
    """Distinct canonical URLs (`listed`) of noisy content, or of hosts with one of the labels; a null html is empty."""
    host, path = host_and_path(F.col("url"))
    chars = F.coalesce(F.char_length("html"), F.lit(0))
    noise = chars - F.coalesce(F.char_length(F.translate("html", NOISE, "")), F.lit(0))
    urls = pages.select(host.alias("host"), path.alias("path"), chars.cast("long").alias("chars"), noise.cast("long").alias("noise"))
    bad = F.exists(F.split("host", r"\."), lambda part: part.isin(*labels))
    sums = urls.groupBy(canonical(F.col("host"), F.col("path")).alias("listed")).agg(F.sum("chars").alias("chars"), F.sum("noise").alias("noise"), F.bool_or(bad).alias("bad"))
    return sums.where(F.col("listed").isNotNull() & (F.col("bad") | (100 * F.col("noise") > noise_pct * F.col("chars")))).select("listed")


SQL = r"""
WITH r AS (SELECT page_id, html, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, html, regexp_extract(rest, '^[^/?#]*') AS raw, rest FROM r),
u AS (SELECT page_id, html, coalesce(translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
  coalesce(regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*'), '') AS path FROM h),
c AS (SELECT *, CASE WHEN host <> '' THEN regexp_replace(host, '^(www|m)\.', '') || regexp_replace(path, '(/index)?(\.html?)?/*$', '') END AS canonical FROM u),
l AS (SELECT canonical FROM c WHERE canonical IS NOT NULL GROUP BY canonical
  HAVING bool_or(list_has_any(string_split(host, '.'), ['spam-farm', 'adult-x', 'free-bets'])) OR 100 * sum(length(html) - length(translate(html, '#*$%|', ''))) > 2 * sum(length(html))),
m AS (SELECT c.*, l.canonical IS NOT NULL AS listed, CASE
  WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/de/') THEN 'example.com/de/'
  WHEN (host = 'example.net' OR host LIKE '%.example.net') AND starts_with(path, '/en/') THEN 'example.net/en/'
  WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/fr/') THEN 'org/fr/'
  WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/') THEN 'net/' END AS rule
  FROM c LEFT JOIN l ON l.canonical = c.canonical)
SELECT page_id, host, path, rule, listed, CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow'
  WHEN listed THEN 'block' ELSE 'allow' END AS verdict FROM m
"""

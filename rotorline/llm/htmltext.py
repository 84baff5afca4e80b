"""Main text of web pages by consensus host paths.

A page is read tag by tag into blocks of text, each under its chain of containers. A container's path is its tags with
their classes from the body down, digits generalised, so that pages of one template agree. Menus, page headers and
footers, sidebars, notices, adverts, forms, scripts, styles and reader comments are known by tag, class, id or role
and give no blocks.

1. ``proposals``: each page scores its containers by the text below them that is not link text and goes down from the
   body as long as one container holds ``SHARE`` of it. The path it stops at is the page's vote.
2. ``winners``: votes are counted per host in Spark; most votes win, then most text, then the path itself.
3. ``extract``: each page is read again and gives the blocks below the winning path of its host. A page on which that
   path has less than ``LEAST`` of what its own proposal has follows its own proposal.

The winners are one row per host, written to the shared folder; their join with the pages is left to Spark, which
sends small tables around and sorts and splits large ones.

Edge cases: a null or empty html gives empty text; a page that breaks off keeps what came before, text in unclosed
markup included; a null url is the empty host; repeated pages vote and come out as often as they occur; an empty table
gives no rows. Columns other than ``page_id``, ``url`` and ``html`` are not looked at.
"""

from __future__ import annotations

import html as entities
import re
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rotorline.llm.base import fresh_path, table
from rotorline.llm.urlfilter import host_of

SHARE, LEAST = 0.7, 0.5

# What HTML calls its elements, and names that pages commonly give to parts around the article.
SKIPPED = frozenset("script style noscript template textarea iframe object embed svg math canvas select button head title audio video map".split())
AROUND = frozenset("nav aside footer form dialog menu".split())
VOID = frozenset("area base br col hr img input link meta param source track wbr".split())
CONTAINERS = frozenset("body main article section div td center".split())
BLOCKS = CONTAINERS | frozenset("p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr caption blockquote pre figure figcaption header footer nav aside form address details summary fieldset hr html".split())
NAMES_AROUND = frozenset("""
ad ads advert adverts advertisement advertising adsbygoogle adslot alert banner breadcrumb breadcrumbs comment comments complementary consent contentinfo cookie
cookies disqus footer form gdpr login masthead menu menus modal nav navbar navigation newsletter notice notices notification outbrain pager pagination popup
promo promotion recommended related replies respond search share sharing sidebar sidebars signup social sponsor sponsored subscribe subscription taboola
toolbar widget widgets
""".split())
COMMENT_NAMES = frozenset("comment comments disqus replies respond".split())
CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+(?:>|\Z)"
    r"|<(?P<close>/?)(?P<tag>[a-zA-Z][a-zA-Z0-9:-]*+)(?P<rest>(?:[^<>\"']++|\"[^\"]*+\"|'[^']*+')*+)(?:>|\Z)"
    r"|<(?P<close2>/?)(?P<tag2>[a-zA-Z][a-zA-Z0-9:-]*+)(?P<rest2>[^>]*+)(?:>|\Z)", re.DOTALL)
ATTRIBUTE = re.compile(r"([a-zA-Z-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.IGNORECASE)
WORDS = re.compile(r"[a-z0-9]+")

Block = tuple[str, int, str]


def named(attributes: dict[str, str]) -> list[str]:
    """The words in class, id and role; a word after has, with or no says nothing about the element itself."""
    text = " ".join(attributes.get(k, "") for k in ("class", "id", "role"))
    words = WORDS.findall(re.sub(r"([a-z])([A-Z])", r"\1 \2", text).lower())
    return [w for i, w in enumerate(words) if not (i and words[i - 1] in ("has", "with", "no"))]


def is_around(tag: str, attributes: dict[str, str], rest: str, in_article: bool) -> bool:
    words = named(attributes)
    if tag in ("html", "body", "main"):
        return False
    if tag == "article":
        return any(w in COMMENT_NAMES for w in words)
    if tag in AROUND or any(w in NAMES_AROUND for w in words):
        return True
    if (tag == "header" or "header" in words) and not in_article:
        return True
    return HIDDEN.search(attributes.get("style", "")) is not None or attributes.get("aria-hidden") == "true" or re.search(r"(?:^|\s)hidden(?:\s|$)", rest) is not None


def label(tag: str, attributes: dict[str, str]) -> str:
    classes = sorted(re.sub(r"\d+", "#", c) for c in attributes.get("class", "").lower().split())
    return ".".join([tag, *classes])


def blocks_of(html: str | None) -> list[Block]:
    """(text, characters of link text, path) of the blocks outside of what is around the article, in page order."""
    out: list[Block] = []
    if not html:
        return out
    # Open elements: tag, whether dropped, path, whether in an article.
    stack: list[tuple[str, bool, str, bool]] = [("", False, "", False)]
    parts: list[str] = []
    linked, links, at = 0, 0, 0

    def end_block():
        nonlocal linked
        if parts:
            text = " ".join(entities.unescape("".join(parts)).split())
            if text:
                out.append((text, min(linked, len(text)), stack[-1][2]))
            parts.clear()
        linked = 0

    def take(text):
        nonlocal linked
        if text and not stack[-1][1]:
            parts.append(text)
            if links:
                linked += len(text)

    while True:
        m = TOKEN.search(html, at)
        take(html[at:m.start() if m else len(html)])
        if not m:
            break
        at = m.end()
        tag = (m["tag"] or m["tag2"] or "").lower()
        if not tag:
            continue
        closing, rest = m["close"] or m["close2"], m["rest"] if m["tag"] else m["rest2"]
        if tag in SKIPPED:
            if not closing and not rest.rstrip().endswith("/") and tag != "embed":
                stop = re.compile(rf"</{tag}\b[^>]*(?:>|\Z)", re.IGNORECASE).search(html, at)
                if stop:
                    at = stop.end()
                elif tag in ("script", "style", "textarea"):
                    break
            continue
        if tag == "a":
            links = 0 if closing else 1
        if tag in VOID or tag not in BLOCKS and tag not in AROUND:
            if tag == "hr":
                end_block()
            elif tag == "br":
                take(" ")
            elif tag in CLOSED_BY:
                take(" ")
            elif not closing and tag not in VOID and tag != "a" and rest and (attributes := {k.lower(): x or y or z for k, x, y, z in ATTRIBUTE.findall(rest)}) \
                    and is_around(tag, attributes, rest, stack[-1][3]):
                end_block()
                stack.append((tag, True, stack[-1][2], stack[-1][3]))
            elif closing and stack[-1][0] == tag:
                stack.pop()
            continue
        end_block()
        if closing:
            depth = next((i for i in range(len(stack) - 1, 0, -1) if stack[i][0] == tag), 0)
            if depth:
                del stack[depth:]
            continue
        shut = CLOSED_BY.get(tag, set()) | {"p"}
        for i in range(len(stack) - 1, 0, -1):
            if stack[i][0] in shut:
                del stack[i:]
            elif stack[i][0] in BLOCKS:
                break
        attributes = {k.lower(): x or y or z for k, x, y, z in ATTRIBUTE.findall(rest)}
        _, dropped, path, in_article = stack[-1]
        dropped = dropped or is_around(tag, attributes, rest, in_article)
        if tag in CONTAINERS:
            path = f"{path}/{label(tag, attributes)}"
        stack.append((tag, dropped, path, in_article or tag in ("article", "main")))
    end_block()
    return out


def weights(blocks: list[Block]) -> dict[str, int]:
    """Text that is not link text below every container path."""
    below: dict[str, int] = defaultdict(int)
    for text, linked, path in blocks:
        score = max(0, len(text) - 2 * linked)
        steps = path.split("/")
        for i in range(1, len(steps) + 1):
            below["/".join(steps[:i])] += score
    return below


def proposal(blocks: list[Block], share: float = SHARE) -> tuple[str, int]:
    """The path at which a page's text divides, and the text below it."""
    below = weights(blocks)
    here = ""
    while True:
        children = [p for p in below if p.startswith(here + "/") and "/" not in p[len(here) + 1:]]
        best = max(children, key=lambda p: (below[p], p), default=None)
        if best is None or below[best] < share * below[here] or not below[best]:
            return here, below.get(here, 0)
        here = best


def under(blocks: list[Block], path: str) -> list[str]:
    return [text for text, _, at in blocks if at == path or at.startswith(path + "/")]


def main_text(html: str | None, path: str | None) -> str:
    """The blocks below the host's path, or the page's own when the host's has too little here."""
    blocks = blocks_of(html)
    own, most = proposal(blocks)
    if path is not None and weights(blocks).get(path, 0) >= LEAST * most:
        own = path
    return "\n".join(under(blocks, own))


def _voted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        votes = [proposal(blocks_of(x.as_py())) for x in batch.column("html")]
        yield pa.RecordBatch.from_arrays(
            [batch.column("host"), pa.array([p for p, _ in votes], pa.string()), pa.array([n for _, n in votes], pa.int64())], names=["host", "path", "size"])


def proposals(pages: DataFrame) -> DataFrame:
    """host, path, size of every page."""
    return pages.select(host_of(F.col("url")).alias("host"), F.col("html").cast("string").alias("html")).mapInArrow(_voted, "host string, path string, size long")


def winners(votes: DataFrame) -> DataFrame:
    """host, path."""
    counted = votes.where("size > 0").groupBy("host", "path").agg(F.count("*").alias("votes"), F.sum("size").alias("size"))
    return counted.groupBy("host").agg(F.max(F.struct("votes", "size", "path"))["path"].alias("path"))


def _extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [main_text(h.as_py(), p.as_py()) for h, p in zip(batch.column("html"), batch.column("path"), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string())], names=["page_id", "url", "text"])


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text."""
    spark = pages.sparkSession
    kept = fresh_path(spark, "host-paths")
    winners(proposals(pages)).write.parquet(kept)
    rows = pages.select("page_id", "url", F.col("html").cast("string").alias("html"), host_of(F.col("url")).alias("host"))
    met = rows.join(spark.read.schema("host string, path string").parquet(kept), "host", "left").select("page_id", "url", "html", "path")
    return met.mapInArrow(_extracted, f"page_id {met.schema['page_id'].dataType.simpleString()}, url string, text string")


def op2_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))

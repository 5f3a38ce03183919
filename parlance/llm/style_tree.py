"""Main text of web pages by a site style tree.

Every page is read into a DOM of structural elements.  The DOMs of a host are merged into
one style tree: a tree node is a path of elements (tag, class words), and it gathers over
the host's pages how its *presentation* (the sequence of its children) and its *content*
(all text below it) are distributed.  With m pages, l different presentations and entropies
of base m, the importance of a node is

    (1 - DECAY**l) * H(presentation) + DECAY**l * H(content)

so a menu that is built alike and says the same on all pages has 0, an article near 1, and
anything that is on one page only has 1.  A branch of importance below ``LEAST_IMPORTANCE``
is removed from every page with all that is below it.  Pages of equal content count once, so
that copies of a page do not make its article look like boilerplate.

What varies from page to page and still is no main text (reader comments, forms, related
articles, adverts that change) has importance 0 by a prior on its element's names, and
where a page marks its article or main element, blocks outside it have importance 0 too.
The three parts can be switched off one by one (``extract``), which tests use to show what
each decides.

Pages of one host are never gathered: the tree is made of counts with partial sums before
the shuffle, and only the low branches are joined back to the pages that have them.

Defined cases: null or empty html gives an empty text; a null url or one without a host is
the host ""; a page cut off inside a tag loses that tag only; unknown references stay as
they are; repeated rows give repeated rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import html as entities
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parlance.llm import bytekit as bk
from parlance.llm.cluster import checkpointed

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>?|</?[a-zA-Z][^\s/>]*(?:\"[^\"]*\"|'[^']*'|[^\"'>])*>|</?[a-zA-Z][^<]*\Z|</?[a-zA-Z][^<>]*>?|<|[^<]+", re.S)
NAME = re.compile(r"</?([a-zA-Z][^\s/>]*)")
ATTRIBUTE = re.compile(r"""([^\s=/>"']+)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""")
#: Fixed lists: element kinds of HTML, and words that mark what is not main text.
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("button canvas iframe noscript object script select style svg template textarea title".split())
NOISE_TAGS = frozenset("aside dialog footer form menu nav".split())
NOISE_WORDS = frozenset(
    "ad ads advert advertisement advertising adverts alert aside banner breadcrumb breadcrumbs comment commentlist comments complementary consent contentinfo cookie cookies copyright dialog disclaimer disqus footer gdpr header legal login masthead menu modal nav navbar navigation newsletter notice notices pager pagination popup promo promoted recommended related replies reply respond search share sharing sidebar sidenav signup social sponsor sponsored subscribe toolbar topbar widget".split()
)
MAIN_WORDS = frozenset("article main".split())
#: An open element of the key is closed by the start of one of the values.
CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "tbody", "tfoot"}, "td": {"td", "th", "tr", "tbody", "tfoot"}, "th": {"td", "th", "tr", "tbody", "tfoot"}}
LEAST_IMPORTANCE, DECAY, LINKED_SHARE = 0.2, 0.9, 0.5


def _digest(*parts: str) -> int:
    return int.from_bytes(hashlib.blake2b("\0".join(parts).encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big", signed=True)


class Element:
    __slots__ = ("tag", "path", "noise", "main")

    def __init__(self, tag: str, path: str, noise: bool, main: bool):
        self.tag, self.path, self.noise, self.main = tag, path, noise, main


class Block:
    __slots__ = ("path", "text", "noise", "main", "linked")

    def __init__(self, path: str, text: str, noise: bool, main: bool, linked: float):
        self.path, self.text, self.noise, self.main, self.linked = path, text, noise, main, linked


def _open(tag: str, token: str, parent: Element | None) -> Element:
    words: list[str] = []
    hidden = False
    if " " in token or "\n" in token or "\t" in token:
        for key, value in ATTRIBUTE.findall(token):
            key, value = key.lower(), value.strip("\"'").lower()
            if key in ("class", "id", "role"):
                words += re.findall(r"[a-z]+", value)
            hidden |= (key == "aria-hidden" and value == "true") or (key == "style" and "display:none" in value.replace(" ", ""))
        hidden |= bool(re.search(r"\shidden(?=[\s/>])", token))
    main = (parent.main if parent else False) or tag in ("article", "main") or bool(tag in BLOCKS and MAIN_WORDS & set(words) and not NOISE_WORDS & set(words))
    noise = (parent.noise if parent else False) or hidden or tag in NOISE_TAGS or (tag == "header" and not (parent and parent.main)) or (tag not in ("html", "body", "main") and bool(NOISE_WORDS & set(words)))
    label = tag + "".join("." + w for w in sorted(set(words)))
    return Element(tag, f"{parent.path}/{label}" if parent else label, noise, main)


def blocks(page: str) -> list[Block]:
    """The text blocks of a page in order, with the style tree path of each."""
    out: list[Block] = []
    stack: list[Element] = []
    text: list[str] = []
    linked = 0
    in_link = False

    def flush() -> None:
        nonlocal linked
        if text:
            words = " ".join("".join(text).split())
            if words:
                top = stack[-1] if stack else Element("", "", False, False)
                out.append(Block(top.path, words, top.noise, top.main, linked / max(1, sum(map(len, text)))))
            text.clear()
        linked = 0

    at, end = 0, len(page)
    while at < end:
        m = TOKEN.match(page, at)
        token = m[0]
        at = m.end()
        if token[0] != "<" or token == "<":
            some = entities.unescape(token)
            text.append(some)
            linked += len(some) * in_link
            continue
        if token[1] in "!?":
            continue
        tag = NAME.match(token)[1].lower()
        if token[-1] != ">":
            continue  # the page ends inside this tag
        if token[1] == "/":
            if tag == "a":
                in_link = False
            if any(e.tag == tag for e in stack):
                flush()
                while stack.pop().tag != tag:
                    pass
            continue
        if tag == "br":
            text.append(" ")
        elif tag == "a":
            in_link = True
        if tag in RAW:
            close = re.compile(f"</{tag}\\b[^>]*>?", re.I).search(page, at)
            at = close.end() if close else end
            continue
        if tag in BLOCKS:
            flush()
            if stack and stack[-1].tag == "p":
                stack.pop()
            while stack and tag in CLOSED_BY.get(stack[-1].tag, ()):
                stack.pop()
            if tag not in VOID and not token.endswith("/>"):
                stack.append(_open(tag, token, stack[-1] if stack else None))
        elif tag not in VOID and not token.endswith("/>") and " " in token:
            e = _open(tag, token, stack[-1] if stack else None)
            if e.noise and not (stack and stack[-1].noise):
                flush()
                stack.append(e)
    flush()
    return out


def branches(path: str) -> list[str]:
    """The path of a block and of all elements around it."""
    parts = path.split("/")
    return ["/".join(parts[: k + 1]) for k in range(len(parts))]


def main_text(found: list[Block], low: frozenset[int], prior: bool = True, main: bool = True) -> str:
    """The blocks of important branches joined."""
    known: dict[str, bool] = {}

    def important(path: str) -> bool:
        if path not in known:
            known[path] = not any(_digest(x) in low for x in branches(path))
        return known[path]

    kept = [b for b in found if not (prior and b.noise) and (not low or important(b.path))]
    if main and any(b.main for b in kept):
        kept = [b for b in kept if b.main]
    elif prior:
        kept = [b for b in kept if b.linked < LINKED_SHARE]
    return "\n\n".join(b.text for b in kept)


def _host():
    return F.coalesce(F.lower(F.regexp_extract("url", r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]+)", 1)), F.lit(""))


def tree_nodes(found: list[Block]) -> tuple[dict[str, tuple[int, int]], int]:
    """For each style tree node of a page what its presentation and its content are, and the page's content."""
    shape: dict[str, list[str]] = {}
    content: dict[str, list[str]] = {}
    for b in found:
        around = branches(b.path)
        for outer, inner in zip(around, [*around[1:], "#"], strict=True):
            shape.setdefault(outer, []).append(inner.rsplit("/", 1)[-1])
            content.setdefault(outer, []).append(b.text)
    nodes = {path: (_digest(*shape[path]), _digest(*content[path])) for path in shape}
    return nodes, _digest(*(b.text for b in found))


def style_rows(pages: DataFrame) -> DataFrame:
    """One row for each style tree node of a page: page_id, row_key, host, path, presentation, content, and the page's content."""
    kind = pages.schema["page_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for i, page in enumerate(batch.column(3)):
                nodes, whole = tree_nodes(blocks(page.as_py() or ""))
                rows += [(i, _digest(path), shape, content, whole) for path, (shape, content) in nodes.items()]
            at, path, shape, content, whole = zip(*rows, strict=True) if rows else ((),) * 5
            at = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(k).take(at) for k in range(3)), *(pa.array(x, pa.int64()) for x in (path, shape, content, whole))], ["page_id", "row_key", "host", "path", "presentation", "content", "whole"])

    return bk.map_arrow(bk.bounded_batches(pages), run, f"page_id {kind}, row_key long, host string, path long, presentation long, content long, whole long")


def importance(rows: DataFrame) -> DataFrame:
    """The style tree: host, path, pages (of different content) and importance, 0 to 1."""
    one = rows.select("host", "path", "presentation", "content", "whole").distinct()
    counts = one.groupBy("host", "path", "presentation", "content").agg(F.count(F.lit(1)).alias("c"))
    both = counts.select("host", "path", "c", F.explode(F.array(F.struct(F.lit(0).alias("kind"), F.col("presentation").alias("value")), F.struct(F.lit(1).alias("kind"), F.col("content").alias("value")))).alias("v"))
    kinds = both.groupBy("host", "path", "v").agg(F.sum("c").cast("double").alias("c"))
    of = lambda kind, x: F.sum(F.when(F.col("v.kind") == kind, x).otherwise(F.lit(0.0)))
    log = F.col("c") * F.ln("c")
    nodes = kinds.groupBy("host", "path").agg(of(0, F.col("c")).alias("pages"), of(0, F.lit(1.0)).alias("styles"), of(0, log).alias("s0"), of(1, log).alias("s1"))
    entropy = lambda s: F.greatest(F.lit(0.0), (F.ln("pages") - F.col(s) / F.col("pages")) / F.ln("pages"))
    part = F.pow(F.lit(DECAY), F.col("styles"))
    return nodes.select("host", "path", "pages", F.when(F.col("pages") > 1, (1 - part) * entropy("s0") + part * entropy("s1")).otherwise(1.0).alias("importance"))


def extract(pages: DataFrame, entropy: bool = True, prior: bool = True, main: bool = True) -> DataFrame:
    """page_id, url, text and n_chars of every page; the flags switch off the tree, the prior on names and the article's element."""
    pages = pages.select("page_id", F.xxhash64("url", "html").alias("row_key"), _host().alias("host"), "html", "url")
    kind, url = (pages.schema[c].dataType.simpleString() for c in ("page_id", "url"))
    rows = checkpointed(style_rows(pages.select("page_id", "row_key", "host", "html")))
    low = importance(rows).where((F.col("importance") < LEAST_IMPORTANCE) & F.lit(entropy)).select("host", "path")
    marks = rows.join(low, ["host", "path"]).groupBy(F.col("page_id").alias("m_id"), F.col("row_key").alias("m_key")).agg(F.collect_set("path").alias("low"))  # a page's own paths

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        z = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            packed = pa.array([z.compress(x.as_buffer().to_pybytes() if x.is_valid else b"") for x in batch.column(3)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), packed], ["page_id", "row_key", "url", "packed"])

    packed = bk.map_arrow(bk.bounded_batches(pages.select("page_id", "row_key", "url", "html")), pack, f"page_id {kind}, row_key long, url {url}, packed binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        z = zstandard.ZstdDecompressor()
        for batch in batches:
            texts = [main_text(blocks(z.decompress(x.as_py()).decode()), frozenset(l.as_py() or ()), prior, main) for x, l in zip(batch.column(2), batch.column(3), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    both = packed.join(marks, packed["page_id"].eqNullSafe(marks["m_id"]) & (packed["row_key"] == marks["m_key"]), "left").select("page_id", "url", "packed", "low")
    return bk.map_arrow(both, run, f"page_id {kind}, url {url}, text string, n_chars long")

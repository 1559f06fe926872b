"""Main text of web pages: page structure first, repeated runs of a host's token streams where there is none."""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, lookup

#: Tokens of a run that counts as long, and distinct pages of a host that make it boilerplate.
RUN, PAGES = 8, 2
_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[(.*?)\]\]>|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:"[^"]*"|'[^']*'|[^'">])*)>""", re.S)
_RAW = {k: re.compile(rf"</{k}\s*>", re.I) for k in ("script", "style", "textarea", "title", "noscript", "template", "iframe", "xmp", "noembed", "noframes")}
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
_CHROME = frozenset("head nav header footer aside form button select option menu dialog svg canvas object audio video map".split())
_CLOSES_P = _BLOCK - {"body", "html", "caption", "td", "th", "tr", "tbody", "thead", "tfoot", "dd", "dt", "li", "legend", "summary"}
_HINT = re.compile(r"""\b(?:class|id|role|aria-label)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_WORDS = re.compile(r"[a-z]+")
_HINTS = frozenset("ad ads advert adverts advertisement advertising sponsor sponsored promo banner cookie cookies consent gdpr notice newsletter subscribe popup modal sidebar menu nav navbar navigation breadcrumb breadcrumbs pagination pager comment comments disqus reply replies respond related recommended share sharing social widget toolbar masthead contentinfo complementary search dialog alert skip footer header".split())
#: Words that may stand beside those in one name, as in ``comment-list``; ``share-prices`` has another and says nothing.
_BESIDE = frozenset("list lists box block bar section container wrapper wrap area thread form links link buttons button posts post signup slot unit inner outer top bottom left right site page main global primary secondary and to".split())
_HIDDEN = re.compile(r"""\bhidden\b|display\s*:\s*none""", re.I)
#: Inside an article only these are judged by their names: a paragraph or table there is text, whatever its class.
_BOXES = frozenset("div section ul ol details dl".split())


def _named_chrome(attrs: str) -> bool:
    """Whether a class, id or role is made of words for what is no article."""
    for m in _HINT.finditer(attrs):
        for name in (m[1] or m[2] or m[3] or "").lower().split():
            words = set(_WORDS.findall(name))
            if words & _HINTS and words <= _HINTS | _BESIDE:
                return True
    return False


def _is_chrome(name: str, attrs: str, within: bool) -> bool:
    if name in _CHROME:
        return True
    if not attrs or name in ("article", "main", "body", "html"):
        return False
    return (not within or name in _BOXES) and _named_chrome(attrs) or bool(_HIDDEN.search(re.sub(r"\"[^\"]*\"|'[^']*'", lambda q: q[0] if "display" in q[0] else "", attrs)))


def blocks(page: str) -> tuple[list[str], bool]:
    """Blocks of the article of one page, or of all that is no chrome; whether there was an article or main element.

    A header inside the article gives its headings and no more.
    """
    found: dict[str, list[str]] = {"article": [], "main": [], "": []}
    stack: list[tuple[str, bool]] = []
    skip = 0
    inside = {"article": 0, "main": 0}
    text: list[str] = []

    def flush() -> None:
        if text:
            line = " ".join(entities.unescape("".join(text)).split())
            text.clear()
            if line:
                for kind in ("article", "main"):
                    if inside[kind]:
                        found[kind].append(line)
                found[""].append(line)

    def pop() -> None:
        nonlocal skip
        name, chrome = stack.pop()
        skip -= chrome
        if name in _HEADINGS and lifted and lifted[-1][0] == len(stack):
            skip = lifted.pop()[1]
        kind = _kind.get(name)
        if kind:
            inside[kind] -= 1

    at, seen = 0, {"article": False, "main": False}
    lifted: list[tuple[int, int]] = []  # headings of an article's header: their depth, and what to skip after them
    while True:
        m = _TAG.search(page, at)
        if not skip:
            text.append(page[at : m.start() if m else len(page)])
        if not m:
            break
        at = m.end()
        if m[1] is not None and not skip:
            text.append(m[1].replace("&", "&amp;"))
        if m[3] is None:
            continue
        name, attrs = m[3].lower(), m[4]
        if m[2]:
            if any(x == name for x, _ in stack):
                if name in _BLOCK:
                    flush()
                while stack[-1][0] != name:
                    pop()
                pop()
            elif name in _BLOCK:
                flush()
            continue
        if name in _RAW:
            end = _RAW[name].search(page, at)
            at = end.end() if end else len(page)
            continue
        if name in _BLOCK:
            flush()
            if name in _CLOSES_P and any(x == "p" for x, _ in stack[-8:]):
                while stack and any(x == "p" for x, _ in stack[-8:]):
                    pop()
            elif name == "li" and stack and stack[-1][0] == "li":
                pop()
        elif name == "br" and not skip:
            text.append(" ")
        if name in _VOID or attrs.endswith("/") and name not in _BLOCK:
            continue
        within = bool(inside["article"] or inside["main"])
        chrome = _is_chrome(name, attrs, within)
        if name in _HEADINGS and skip == 1 and within and any(x == "header" and c for x, c in stack):
            lifted.append((len(stack), skip))
            skip = 0
        stack.append((name, chrome))
        skip += chrome
        kind = _kind.get(name)
        if kind:
            inside[kind] += 1
            seen[kind] = seen[kind] or not skip
    flush()
    kind = "article" if seen["article"] else "main" if seen["main"] else ""
    return found[kind], bool(kind)


_kind = {"article": "article", "main": "main"}
_HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))


def _structured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The text of pages with an article; null of those without."""
    for batch in batches:
        found = [blocks(h.as_py() or "") for h in batch.column(2)]
        texts = ["\n".join(lines) if framed else None for lines, framed in found]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], names=["page_id", "url", "text"])


def _streams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of pages without an article and, at each token, the hash of the run that begins there; runs go on over blocks."""
    from xxhash import xxh64_intdigest

    for batch in batches:
        lines, runs, rows = [], [], []
        for i, h in enumerate(batch.column(2)):
            found, framed = blocks(h.as_py() or "")
            if framed:
                continue
            rows.append(i)
            tokens = " ".join(found).split()
            lines.append(found)
            runs.append([xxh64_intdigest("\x1f".join(tokens[i : i + RUN]).encode("utf-8", "surrogatepass")) - (1 << 63) for i in range(len(tokens) - RUN + 1)])
        batch = batch.take(pa.array(rows, pa.int64()))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(lines, pa.list_(pa.string())), pa.array(runs, pa.list_(pa.int64()))], names=["page_id", "url", "lines", "runs"])


def _unique_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = []
        for lines, starts in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
            sizes = [len(x.split()) for x in lines]
            covered = np.zeros(sum(sizes), bool)
            for s in starts or []:
                covered[s : s + RUN] = True
            kept, at = [], 0
            for line, n in zip(lines, sizes, strict=True):
                left = [w for w, c in zip(line.split(), covered[at : at + n], strict=True) if not c]
                at += n
                if left:
                    kept.append(" ".join(left))
            texts.append("\n".join(kept))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], names=["page_id", "url", "text"])


def without_host_runs(pages: DataFrame, min_pages: int = PAGES) -> DataFrame:
    """Text of pages without an article: what runs of RUN tokens and more share with other pages of the host goes.

    The suffixes of all token streams of a host that begin with the same RUN tokens stand together in its suffix
    array; here they meet by the hash of those tokens, in the shuffle, so no host has to fit into one task. The union
    of such runs is what maximal repeats of at least RUN tokens cover. A page repeated as a whole is boilerplate by
    this rule: equal streams are counted as one page, and the first alone would not do, so all of them stay.
    """
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^(?:[a-zA-Z][\w+.-]*:)?//([^/?#]*)", 1))
    kind = pages.schema["page_id"].dataType.simpleString()
    streams = pages.mapInArrow(_streams, f"page_id {kind}, url string, lines array<string>, runs array<bigint>")
    streams = checkpoint(streams.withColumn("host", host).withColumn("body", F.xxhash64("lines")).withColumn("row", F.monotonically_increasing_id()))
    at = streams.select("row", "host", "body", F.posexplode("runs").alias("start", "run"))
    shared = at.groupBy("host", "run").agg(F.count(F.lit(1)).alias("n"), F.min("body").alias("x"), F.max("body").alias("y"))
    shared = shared.where(F.col("x") != F.col("y"))
    if min_pages > 2:
        bodies = at.select("host", "run", "body").distinct().groupBy("host", "run").agg(F.count(F.lit(1)).alias("bodies")).where(F.col("bodies") >= min_pages)
        shared = shared.join(bodies, ["host", "run"])
    shared = checkpoint(shared.select("host", "run", "n"))
    covered = lookup(at.select("row", "start", "host", "run"), shared.withColumn("hit", F.lit(True)), ["host", "run"], "n", "row").where("hit").groupBy("row").agg(F.collect_list("start").alias("starts"))
    return streams.join(covered, "row", "left").select("page_id", "url", "lines", "starts").mapInArrow(_unique_runs, f"page_id {kind}, url string, text string")


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_pages: int = PAGES) -> DataFrame:
    """page_id, url, text of each row of ``pages``; text is empty for null, empty or textless html.

    A page with an article element (else a main element) outside of chrome gives the blocks in it, less chrome: menus,
    headers, footers, sidebars, notices, adverts, forms, scripts, styles, reader comments. Any other page gives the
    blocks that are no chrome, less the runs that other pages of its host have too. The parser decides which it is, so
    an article in a comment is none. Repeated rows give repeated rows, an empty table none; a page is parsed whole,
    however long. Columns but the three are not read.
    """
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    kind = pages.schema[id_col].dataType.simpleString()
    one = rows.mapInArrow(_structured, f"page_id {kind}, url string, text string").where("text is not null")
    out = one.unionByName(without_host_runs(rows, min_pages))
    return out.select(F.col("page_id").alias(id_col), F.col("url").alias(url_col), "text")


def op5_html_extraction(spark, sf_dir: str) -> DataFrame:
    return main_text(spark.read.parquet(f"{sf_dir}/pages.parquet")).withColumn("n_chars", F.length("text").cast("long"))

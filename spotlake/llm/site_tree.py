"""Main text of web pages by site style trees.

The pages of one host are merged to a style tree: a node is a path of block elements (each with its tag and a
number for its class and id). A path in which text stands keeps, over the host's pages, which contents it has had
and how often it stands in a page. Pages of a host that agree in their four longest blocks are copies and count once.

* Content importance: 1 - sum(log n) / (l log m), for l contents of which each is on n of the host's m pages;
  0 for what is on all pages, 1 for what is on one.
* Presentation importance: a path's own is the larger of W and sqrt(W D), where W is the path's part in the
  information of the host (characters, weighted as above) and D = 1 - exp(-entropy of its numbers of occurrences in
  a page). A path takes the largest of the paths that stand directly in one of the elements around it, so the
  heading or quotation in an article counts with the paragraphs there. It is 0 for paths in elements that declare
  by tag, role, hiding or a name of their own that they aren't the article, and 1 on hosts of fewer than ``FEW`` pages.

A branch whose mean of both is below ``LEAST`` is removed from the host's pages. The decision is the host's alone.

Trees are never held whole: they are counts by (host, path, content), summed up before they are shuffled, so a
host with a third of all pages is not gathered anywhere. A page is parsed twice rather than written: for the tree,
and for its blocks, which are compressed and meet the page's own removed paths by the page's key.

Defined results: null or empty html, or nothing left, gives an empty string; pages with a null url have a tree of
their own; repeated rows are pages of their own and get equal results; an empty table gives an empty result;
further columns are dropped, whatever their names. Broken markup is read as browsers do in the common cases:
unclosed elements end with their parent, stray end tags are ignored. Elements nested deeper than ``DEPTH`` keep their
text but have no paths of their own, as browsers limit the depth too.
"""

from __future__ import annotations

import html as entities
import re

import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, tune

LEAST, FEW, SALTS, DEPTH = 0.6, 5, 16, 256
#: Elements of HTML by how they are read.
BLOCK = {*"address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead title tr ul".split()}
RAW = {*"script style noscript template iframe object svg math textarea select button canvas audio video title".split()}
MARKUP = {*"noscript template object svg math select button canvas audio video".split()}
ASIDE = {*"head nav footer aside form menu dialog search".split()}
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
ROLES = {*"navigation banner contentinfo complementary search dialog alert menu menubar form".split()}
#: Whole class names or ids by which an element declares what it is.
DECLARED = {*"ad ads advert advertisement banner breadcrumb breadcrumbs comment-list comments comments-area consent cookie-banner cookie-notice disqus_thread footer masthead menu modal navbar newsletter notice pagination popup related respond share sidebar site-footer site-header sponsored".split()}
_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^"'>]|"[^"]*"|'[^']*')*+)>""", re.S)
#: What ends an element that is skipped: its end tag, wherever it stands; in those that hold markup, not in a comment.
_END = {t: re.compile(("" if t in MARKUP else "(?!)") + rf"<!--.*?(?:-->|\Z)|(</{t}(?=[\s/>])[^>]*>)", re.I | re.S) for t in RAW}
#: The beginning of a tag that the page ends in.
_UNFINISHED = re.compile(r"<[a-zA-Z/!?]")
_ATTR = re.compile(r"""(class|id|role|hidden|aria-hidden|style)\b(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
_DIGITS = re.compile(r"\d+")
_SPACE = re.compile(r"\s+")
_CLASS = "array<struct<path:string,declared:boolean,times:int,features:array<int>,chars:array<int>>>"


def declares(tag: str, attrs: dict[str, str], around: list[tuple[str, str, bool]]) -> bool:
    """Whether an element says itself that it is no part of the article."""
    if tag in ASIDE or "hidden" in attrs or attrs.get("aria-hidden") == "true" or attrs.get("role", "").lower() in ROLES:
        return True
    if tag == "header" and not any(t in ("article", "main") for t, _, _ in around):
        return True
    if "display:none" in attrs.get("style", "").replace(" ", "").lower():
        return True
    names = f"{attrs.get('class', '')} {attrs.get('id', '')}".lower().split()
    return tag not in ("html", "body", "main", "article", "h1") and not DECLARED.isdisjoint(names)


def blocks(page: str | None) -> list[tuple[str, str, bool]]:
    """Blocks of a page in order: (path, text, whether an element around it declares itself no article)."""
    out: list[tuple[str, str, bool]] = []
    stack: list[tuple[str, str, bool]] = []  # tag, path, declared
    text: list[str] = []
    page, at = page or "", 0

    def flush():
        if text:
            t = _SPACE.sub(" ", entities.unescape("".join(text))).strip()
            text.clear()
            if t:
                out.append((stack[-1][1] if stack else "", t, bool(stack) and stack[-1][2]))

    def pop(tags: set[str], within: set[str]):
        for i in range(len(stack) - 1, -1, -1):
            if stack[i][0] in tags:
                del stack[i:]
                return
            if stack[i][0] in within:
                return

    while m := _TAG.search(page, at):
        end, tag, attrs = m.group(1), m.group(2), m.group(3)
        if m.start() > at:
            text.append(page[at : m.start()])
        at = m.end()
        if not tag:
            continue
        tag = tag.lower()
        if tag in RAW:
            if tag in ("svg", "math", "textarea", "select", "button") or tag not in BLOCK:
                text.append(" ")
            if not end and not attrs.endswith("/"):
                at = next((e.end() for e in _END[tag].finditer(page, at) if e.group(1)), len(page))
            continue
        if tag == "br":
            text.append(" ")
        if tag not in BLOCK:
            continue
        flush()
        if end:
            pop({tag}, set())
            continue
        pop({"p"}, {"td", "th", "li", "div", "article", "section", "body"})
        if tag in CLOSES:
            pop(CLOSES[tag], {"ul", "ol", "dl", "table", "menu"})
        if tag == "hr":
            continue
        found = {a.lower(): b or c or d for a, b, c, d in _ATTR.findall(attrs)} if attrs else {}
        above = stack[-1] if stack else ("", "", False)
        path = above[1]
        if len(stack) < DEPTH:
            own = " ".join(_DIGITS.sub("#", found[k].strip()) for k in ("class", "id") if found.get(k))
            name = f"{tag}.{xxhash.xxh32_hexdigest(own.encode('utf-8', 'replace'))}" if own else tag
            path = f"{path}>{name}" if path else name
        stack.append((tag, path, above[2] or declares(tag, found, stack)))
    if at < len(page):
        text.append(page[at:] if page[at:].rstrip().endswith(">") else _UNFINISHED.split(page[at:], maxsplit=1)[0])
    flush()
    return out


def feature(text: str) -> int:
    """A content's number within its path, of 32 bits: a chance meeting of two only counts one of them twice."""
    return xxhash.xxh32_intdigest(text.encode("utf-8", "replace")) - (1 << 31)


def identity(found: list[tuple[str, str, bool]]) -> int:
    """Equal for pages that are copies: of the four longest blocks."""
    longest = sorted({t for _, t, _ in found}, key=lambda t: (-len(t), t))[:4]
    return xxhash.xxh3_64_intdigest("\0".join(longest).encode("utf-8", "replace")) - (1 << 63)


def leaves(found: list[tuple[str, str, bool]]) -> list[dict]:
    """A page's part in the tree: each path with text, how often it stands, and its contents once each."""
    out: dict[tuple[str, bool], dict] = {}
    for path, text, declared in found:
        leaf = out.setdefault((path, declared), {"path": path, "declared": declared, "times": 0, "contents": {}})
        leaf["times"] += 1
        leaf["contents"][feature(text)] = len(text)
    return [{"path": x["path"], "declared": x["declared"], "times": x["times"], "features": [*x["contents"]], "chars": [*x["contents"].values()]} for x in out.values()]


def path_number(path: str, declared: bool) -> int:
    """As ``_path_number`` gives it for columns."""
    n = xxhash.xxh64_intdigest((path + ("!" if declared else "")).encode(), 42)
    return n - (1 << 64) if n >> 63 else n


def _path_number(path: Column, declared: Column) -> Column:
    return F.xxhash64(F.concat(path, F.when(declared, "!").otherwise("")))


def keyed(pages: DataFrame) -> DataFrame:
    """The pages by two numbers that tell rows apart, with their host."""
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[a-zA-Z][\w+.-]*://([^/?#]*)", 1))
    nulls = [F.isnull(c) for c in ("page_id", "url", "html")]
    keys = [F.xxhash64(F.lit(i), *nulls, "page_id", "url", "html").alias(f"k{i}") for i in (1, 2)]
    return pages.select(*keys, "page_id", "url", host.alias("host"), "html")


def trees(rows: DataFrame) -> DataFrame:
    """k1, k2, host, page (identity), leaves of every row."""

    def run(batches):
        kind = pa.list_(pa.struct([("path", pa.string()), ("declared", pa.bool_()), ("times", pa.int32()), ("features", pa.list_(pa.int32())), ("chars", pa.list_(pa.int32()))]))
        for b in batches:
            found = [blocks(h) for h in b.column(3).to_pylist()]
            cols = [b.column(0), b.column(1), b.column(2), pa.array([identity(f) for f in found], pa.int64()), pa.array([leaves(f) for f in found], kind)]
            yield pa.RecordBatch.from_arrays(cols, ["k1", "k2", "host", "page", "leaves"])

    return rows.select("k1", "k2", "host", "html").mapInArrow(run, f"k1 long, k2 long, host string, page long, leaves {_CLASS}")


def importance(tree: DataFrame) -> DataFrame:
    """host, path, declared, content, presentation, importance of every path, from ``trees``."""
    once = tree.groupBy("host", "page").agg(F.min_by("leaves", F.struct("k1", "k2")).alias("leaves"))
    pages = once.groupBy("host").agg(F.count(F.lit(1)).alias("m"))
    leaf = once.select("host", F.explode("leaves").alias("x")).select("host", "x.*")
    keys = ["host", "path", "declared"]
    contents = leaf.select(*keys, F.explode(F.arrays_zip("features", "chars")).alias("f")).groupBy(*keys, "f.features").agg(F.count(F.lit(1)).alias("n"), F.max("f.chars").alias("c"))
    contents = contents.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("l"), F.sum(F.log("n")).alias("logs"), F.sum("c").alias("chars"), F.sum(F.col("c") * F.log("n")).alias("lost")
    )
    times = leaf.groupBy(*keys, "times").agg(F.count(F.lit(1)).alias("n"))
    times = times.groupBy(*keys).agg(F.sum("n").alias("on"), F.sum(F.col("n") * F.log("n")).alias("nlogn"))
    times = times.select(*keys, (1 - F.exp(F.col("nlogn") / F.col("on") - F.log("on"))).alias("varied"))
    # One row a path: written, as it is read several times below.
    by = cut(contents.join(times, keys).join(pages, "host"))
    log_m = F.log(F.greatest("m", F.lit(2)))
    by = by.withColumn("content", F.greatest(F.lit(0.0), 1 - F.col("logs") / (F.col("l") * log_m))).withColumn("info", F.greatest(F.lit(0.0), F.col("chars") - F.col("lost") / log_m))
    by = by.join(by.groupBy("host").agg(F.sum("info").alias("whole")), "host")
    w = F.col("info") / F.greatest("whole", F.lit(1.0))
    own = F.when(F.col("declared"), 0.0).otherwise(F.greatest(w, F.sqrt(w * F.greatest("varied", F.lit(0.0)))))
    parts = F.split("path", ">")
    upper = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, F.lit(1), i), ">"))
    by = by.select(*keys, "m", "content", own.alias("own"), upper.alias("above")).withColumn("parent", F.element_at("above", -1))
    direct = by.groupBy("host", F.col("parent").alias("at")).agg(F.max("own").alias("most"))
    context = by.select(*keys, F.explode("above").alias("at")).join(direct, ["host", "at"]).groupBy(*keys).agg(F.max("most").alias("most"))
    shown = F.when(F.col("declared"), 0.0).when(F.col("m") < FEW, 1.0).otherwise(F.col("most")).alias("presentation")
    out = by.join(context, keys).select(*keys, "content", shown)
    return out.withColumn("importance", (F.col("content") + F.col("presentation")) / 2)


def removed(tree: DataFrame) -> DataFrame:
    """k1, k2, gone: for each page that has some, the numbers of its paths that go."""
    low = importance(tree).where(F.col("importance") < LEAST).select("host", _path_number(F.col("path"), F.col("declared")).alias("number"))
    low = low.select("host", "number", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    numbers = F.transform("leaves", lambda x: _path_number(x["path"], x["declared"]))
    at = tree.select("k1", "k2", "host", F.pmod("k1", F.lit(SALTS)).cast("int").alias("salt"), F.explode(numbers).alias("number")).distinct()
    return at.join(low, ["host", "number", "salt"]).groupBy("k1", "k2").agg(F.collect_list("number").alias("gone"))


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    tune(pages.sparkSession)
    rows = keyed(pages)
    gone = removed(cut(trees(rows)))

    def packed(batches):
        small = zstandard.ZstdCompressor(3)
        for b in batches:
            found = [blocks(h) for h in b.column(4).to_pylist()]
            texts = [small.compress("\n".join(t for _, t, _ in f).encode("utf-8", "replace")) for f in found]
            at = pa.array([[path_number(p, d) for p, _, d in f] for f in found], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array(texts, pa.binary()), at], ["k1", "k2", "page_id", "url", "texts", "at"])

    def kept(batches):
        whole = zstandard.ZstdDecompressor()
        for b in batches:
            at, gone = (b.column(b.schema.get_field_index(c)).to_pylist() for c in ("at", "gone"))
            out = []
            for t, a, g in zip(b.column(b.schema.get_field_index("texts")).to_pylist(), at, gone, strict=True):
                g = set(g or ())
                out.append("\n".join(x for x, n in zip(whole.decompress(t).decode().split("\n"), a, strict=False) if n not in g))
            cols = [b.column(b.schema.get_field_index(c)) for c in ("page_id", "url")]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(out, pa.string()), pa.array([len(x) for x in out], pa.int64())], ["page_id", "url", "text", "n_chars"])

    kind = pages.schema["page_id"].dataType.simpleString()
    found = rows.select("k1", "k2", "page_id", "url", "html").mapInArrow(packed, f"k1 long, k2 long, page_id {kind}, url string, texts binary, at array<long>")
    return found.join(gone, ["k1", "k2"], "left").mapInArrow(kept, f"page_id {kind}, url string, text string, n_chars long")

"""Main text of web pages with a site style tree.

A page is read into nested block elements. The pages of one host are merged: each element path (tags with class and id)
is a node of the host's tree, the sequences of child tags below it are its presentations, and the text blocks at it are
its contents. With m pages of a host at a node,
  presentation importance = - sum p log_m p over the shares p of its presentations,
  content importance of a text = 1 - log_m n, where n pages hold it (the entropy of its spread over pages),
  node importance = (1 - g^k) * presentation + g^k * content, k presentations, g = DAMPING, content the mean over the
  texts in its branch.
Branches and texts whose importance is at most LEAST_IMPORTANCE are removed, on hosts of every size. Pages with equal text
(without what is marked) are copies and count once in m and n; all importances are 1 at m = 1.

What an element says about itself comes first: nav, footer, aside, form, script, style and the like, and class or id
words such as ad, sidebar, cookie or comment, are removed in any case: the tree can tell what a site repeats, but not a
menu or advert whose text is new on every page. If a page has an article (or main) element that
isn't so marked, its main text lies there. The tree decides inside it as everywhere, but for near copies: texts that most
pages of a host share because they are versions of one article look to the tree like a menu. So each branch or text that
would go is weighed over all pages of its host that hold it in an article. If most of them would lose the larger part of
their article, it is what these articles say, and stays on all of them; else it goes from all, from short pages as well.

How the work is dealt: pages are parsed where they are read, and once more for the weighing on hosts where something goes. Only (host, path, hash) rows are shuffled, summed map-side,
so a host with a third of all pages is a third of the summands and not of a task. A host's removals are few (each is on
m^(1 - LEAST_IMPORTANCE) of the host's m pages at least, so there are at most m^LEAST_IMPORTANCE times as many as a page
has texts), and come back by broadcast while the written table is below BROADCAST_BYTES,
else by a join on host and salt.

Nulls and odd rows: a null or empty html gives an empty text and 0 characters. A null or odd url counts as the host "".
Unclosed and misnested tags end where a browser would end them or at the end of the page. Repeated rows give repeated
results. Whole pages are read, however long; text of unknown tags is kept. Further columns, of whatever name, are left
aside; an empty table gives an empty one.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table, write_read, written_bytes

DAMPING = 0.9
LEAST_IMPORTANCE = 0.1
BROADCAST_BYTES = 32 << 20
SALTS = 16

BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html "
    "li main menu nav noscript ol p pre section summary table tbody td tfoot th thead tr ul caption head".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content the parser takes as it stands, up to their end tag.
RAW = "script|style|textarea|title|iframe"
#: Other elements whose content is no text of the page; they nest, and may be self-closed.
SKIPPED = frozenset("template svg annotation annotation-xml select button canvas audio video".split())
FOREIGN = ("svg",)
NOISE_TAGS = frozenset("nav footer aside form menu dialog head".split())
#: A class or id is a mark of noise if it is such a word, or is made of such words and plain words only.
NOISE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising banner sponsor sponsored promo promotion sidebar nav navbar navigation menu breadcrumb breadcrumbs footer masthead cookie cookies consent notice notices "
    "alert popup modal newsletter subscribe signup login share social related recommended comment comments disqus replies respond form toolbar pager pagination widget".split()
)
PLAIN_WORDS = frozenset(
    "site page main top bottom left right upper lower primary secondary global local header head inner outer box bar list item items block section area container wrapper wrap slot unit group row col column "
    "button buttons link links icon icons post posts article articles thread title text message side global mobile desktop".split()
)
NOISE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar".split())
TOKEN = re.compile(
    r"<!--(?:>|->|.*?-->|.*\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>[^\"'>]*(?:(?:\"[^\"]*\"|'[^']*')[^\"'>]*)*)>"
    r"|<(?P<end2>/?)(?P<tag2>[a-zA-Z][^\s/>]*)(?P<attrs2>[^>]*)>"
    r"|<[!?/][^>]*>",
    re.S | re.I,
)
RAW_END = {tag: re.compile(rf"</{tag}(?=[\s/>])[^>]*>", re.I) for tag in RAW.split("|")}
ATTR = re.compile(r"(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
#: Start tags that end an open element of the named kinds.
ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th")}
HOST = r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)"


class Element:
    __slots__ = ("kids", "main", "noise", "path", "skipped", "tag")

    def __init__(self, tag: str, path: str, main: bool, noise: bool, skipped: bool = False):
        self.tag, self.path, self.main, self.noise, self.skipped, self.kids = tag, path, main, noise, skipped, []


def marked(label: str) -> bool:
    """Whether a class or id says that an element is no main text."""
    for name in label.lower().split():
        words = [w for w in re.split(r"[-_]+", name) if w and not w.isdigit()]
        if any(w in NOISE_WORDS for w in words) and all(w in NOISE_WORDS or w in PLAIN_WORDS for w in words):
            return True
    return False


def blocks(page: str, styles: list[tuple[str, str]] | None = None) -> list[tuple[str, str, bool, bool]]:
    """The text blocks of a page in order: (path, text, in article, marked as noise). styles gets (path, child tags) of every element."""
    root = Element("", "", False, False)
    stack, found, words, at = [root], [], [], 0

    def flush() -> None:
        if words:
            text = " ".join(entities.unescape("".join(words)).split())
            words.clear()
            if text:
                top = next(e for e in reversed(stack) if not e.skipped)
                found.append((top.path, text, top.main, top.noise))

    def close(n: int) -> None:
        for e in stack[n:]:
            if styles is not None and not e.skipped:
                styles.append((e.path, " ".join(e.kids)))
        del stack[n:]

    while m := TOKEN.search(page, at):
        if m.start() > at and not stack[-1].skipped:
            words.append(page[at : m.start()])
        at = m.end()
        tag = (m["tag"] or m["tag2"] or "").lower()
        ends = bool(m["end"] or m["end2"])
        attrs = m["attrs"] or m["attrs2"] or ""
        if tag in RAW_END and not ends:
            if not (attrs.endswith("/") and any(e.tag in FOREIGN for e in stack)):
                shut = RAW_END[tag].search(page, at)
                at = shut.end() if shut else len(page)
        elif tag == "br":
            if not stack[-1].skipped:
                words.append(" ")
        elif tag not in BLOCKS and tag not in SKIPPED and tag != "foreignobject":
            continue
        elif ends:
            for n in range(len(stack) - 1, 0, -1):
                if stack[n].tag == tag:
                    if not stack[n].skipped:
                        flush()
                    close(n)
                    break
                if stack[n].tag in ("template", "object") or (tag == "p" and stack[n].tag in SKIPPED):
                    break
            else:
                if not stack[-1].skipped:
                    flush()
        elif tag in SKIPPED or tag == "foreignobject":
            above = stack[-1]
            if not attrs.endswith("/") and (tag != "foreignobject" or above.skipped):
                stack.append(Element(tag, above.path, above.main, above.noise, True))
        else:
            while stack[-1].tag in FOREIGN:  # a block ends a foreign element that was left open
                close(len(stack) - 1)
            above = stack[-1]
            if above.skipped:
                if tag not in VOID:
                    stack.append(Element(tag, above.path, above.main, above.noise, True))
                continue
            flush()
            if stack[-1].tag == "p":
                close(len(stack) - 1)
            for n in range(len(stack) - 1, 0, -1):
                if stack[n].tag in ENDS.get(tag, ()):
                    close(n)
                    break
                if stack[n].tag in ("ul", "ol", "dl", "table", "div", "article", "section", "nav"):
                    break
            if tag == "body" and len(stack) > 1 and stack[-1].tag == "head":
                close(len(stack) - 1)
            above = stack[-1]
            above.kids.append(tag)
            if tag in VOID:
                continue
            named = {k.lower(): (a or b or c) for k, a, b, c in ATTR.findall(attrs)}
            label = f"{named.get('class', '')} {named.get('id', '')}".strip()
            main = above.main or tag in ("article", "main") or named.get("role", "").lower() in ("article", "main")
            noise = (
                above.noise
                or tag in NOISE_TAGS
                or (tag in ("header", "noscript") and not above.main)
                or (bool(label) and tag not in ("html", "body", "article", "main") and marked(label))
                or named.get("role", "").lower() in NOISE_ROLES
            )
            stack.append(Element(tag, f"{above.path}>{tag}" + (f".{label}" if label else ""), main, noise))
    if not stack[-1].skipped:
        words.append(page[at:])
    flush()
    close(1)
    return found


def _hash(text: str) -> int:
    return xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass")) - (1 << 63)


def _own(found: list[tuple[str, str, bool, bool]]) -> tuple[list[tuple[str, str]], bool]:
    """(path, text) of the blocks that the main text may be made of, those of the article alone where there is one, and whether there is one."""
    inside = any(main and not noise for _, _, main, noise in found)
    return [(path, text) for path, text, main, noise in found if not noise and (main or not inside)], inside


def _takers(path: str, text: str, bad_paths: set[str], bad_texts: set[int]) -> list[tuple[str | None, int | None]]:
    """What the host's tree takes a block for: branches (path, None) and texts (None, hash)."""
    by: list[tuple[str | None, int | None]] = [(p, None) for p in bad_paths if path == p or path.startswith(p + ">")]
    if bad_texts and (h := _hash(f"{path}\n{text}")) in bad_texts:
        by.append((None, h))
    return by


def main_text(page: str, bad_paths: set[str] = frozenset(), bad_texts: set[int] = frozenset()) -> str:
    """The main text of one page, given what its host's tree removes: branches by path, texts by the hash of path and text."""
    return "\n".join(text for path, text in _own(blocks(page))[0] if not _takers(path, text, bad_paths, bad_texts))


def _features(pages: DataFrame) -> DataFrame:
    """(host, path, kind, feature, page): a row for each presentation (P) and text (C) of each page and one for the page (M), as hashes; page is that of its text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                rows: list[tuple[str, str, str, int, int]] = []
                for host, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    styles: list[tuple[str, str]] = []
                    found = blocks(page or "", styles)
                    whole_text = _hash("\n".join(t for _, t, _, noise in found if not noise))
                    texts = {(p, "C", _hash(f"{p}\n{t}")) for p, t, _, _ in found}
                    rows += [(host, *x, whole_text) for x in texts | {(p, "P", _hash(s)) for p, s in styles} | {("", "M", 0)}]
                if rows:
                    kinds = (pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64())
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["host", "path", "kind", "feature", "page"])

    return pages.select("host", "html").mapInArrow(run, "host string, path string, kind string, feature long, page long")


def style_tree(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The merged trees of all hosts: nodes (host, path, m, importance) and contents (host, path, text, n, m, importance), text a hash. pages: (host, html)."""
    counted = write_read(
        _features(pages).distinct().groupBy("host", "path", "kind", "feature").agg(F.count("*").alias("n")), "features"
    )
    # a host's nodes are dealt to SALTS tasks, so a host with most pages isn't one task's
    salt = F.pmod(F.xxhash64("path"), F.lit(SALTS)).cast("int")
    hosts = counted.where("kind = 'M'").select("host", F.col("n").alias("m"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    seen = counted.where("kind <> 'M'").withColumn("salt", salt).join(hosts.hint("merge"), ["host", "salt"]).drop("salt")
    log_m, n = F.log(F.col("m").cast("double")), F.col("n").cast("double")
    alone = F.col("m") == 1
    contents = seen.where("kind = 'C'").select("host", "path", F.col("feature").alias("text"), "n", "m", F.when(alone, 1.0).otherwise(1 - F.log(n) / log_m).alias("importance"))
    # with p = n / total, the sum of -p log p is log total - (sum of n log n) / total: sums only, made map-side
    sums = seen.where("kind = 'P'").groupBy("host", "path").agg(F.max("m").alias("m"), F.sum(n).alias("total"), F.sum(n * F.log(n)).alias("nlogn"), F.count("*").alias("k"))
    shown = sums.select("host", "path", "m", "k", F.when(alone, 1.0).otherwise((F.log("total") - F.col("nlogn") / F.col("total")) / log_m).alias("shown"))
    steps = F.split("path", ">")
    above = F.explode(F.transform(F.sequence(F.lit(2), F.size(steps)), lambda i: F.array_join(F.slice(steps, 1, i), ">")))
    said = (
        contents.groupBy("host", "path").agg(F.sum(F.col("n") * F.col("importance")).alias("s"), F.sum("n").alias("n"))
        .where("path <> ''")
        .select("host", above.alias("path"), "s", "n")
        .groupBy("host", "path")
        .agg((F.sum("s") / F.sum("n")).alias("said"))
    )
    fade = F.pow(F.lit(DAMPING), F.col("k"))
    nodes = shown.join(said.hint("merge"), ["host", "path"]).select("host", "path", "m", ((1 - fade) * F.col("shown") + fade * F.col("said")).alias("importance"))
    return nodes, contents


def _by_host(rows: DataFrame, name: str) -> DataFrame:
    """(host, bad_paths, bad_texts) from (host, p, t), written."""
    return write_read(rows.groupBy("host").agg(F.collect_set("p").alias("bad_paths"), F.collect_set("t").alias("bad_texts")), name)


def _meet(pages: DataFrame, out: DataFrame, how: str) -> DataFrame:
    """pages with what goes on their host; out is a written table."""
    if written_bytes(out) < BROADCAST_BYTES:
        return pages.join(F.broadcast(out), "host", how)
    salted = out.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return pages.withColumn("salt", F.pmod(F.xxhash64("page_id"), F.lit(SALTS)).cast("int")).join(salted.hint("merge"), ["host", "salt"], how)


def _weighed(met: DataFrame) -> DataFrame:
    """(host, p, t, page, heavy): for each page with an article what goes from it, and whether the article loses the larger part of its text to all that goes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                rows: list[tuple[str, str | None, int | None, int, bool]] = []
                for host, page, paths, texts in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                    found = blocks(page or "")
                    own, inside = _own(found)
                    if not inside:
                        continue
                    bad_paths, bad_texts = set(paths), set(texts)
                    taken = [(len(text), _takers(path, text, bad_paths, bad_texts)) for path, text in own]
                    heavy = 2 * sum(n for n, by in taken if by) > sum(n for n, _ in taken)
                    whole_text = _hash("\n".join(t for _, t, _, noise in found if not noise))
                    rows += [(host, p, t, whole_text, heavy) for p, t in {x for _, by in taken for x in by}]
                if rows:
                    kinds = (pa.string(), pa.string(), pa.int64(), pa.int64(), pa.bool_())
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["host", "p", "t", "page", "heavy"])

    return met.select("host", "html", "bad_paths", "bad_texts").mapInArrow(run, "host string, p string, t long, page long, heavy boolean")


def removals(pages: DataFrame) -> DataFrame:
    """One row (host, bad_paths, bad_texts) for each host from which the tree removes something, written. pages: (page_id, host, html)."""
    nodes, contents = style_tree(pages)
    low = F.col("importance") <= LEAST_IMPORTANCE
    paths = nodes.where(low & (F.size(F.split("path", ">")) > 3)).select("host", F.col("path").alias("p"), F.lit(None).cast("long").alias("t"))
    texts = contents.where(low).select("host", F.lit(None).cast("string").alias("p"), F.col("text").alias("t"))
    found = write_read(paths.unionByName(texts), "low")
    weighed = _weighed(_meet(pages, _by_host(found, "low_by_host"), "inner")).distinct()
    copies = weighed.groupBy("host", "p", "t").agg(F.count("*").alias("n"), F.count_if("heavy").alias("n_heavy")).where("2 * n_heavy > n")
    x, y = found.alias("x"), copies.alias("y").hint("merge")
    same = (F.col("x.host") == F.col("y.host")) & F.col("x.p").eqNullSafe(F.col("y.p")) & F.col("x.t").eqNullSafe(F.col("y.t"))
    return _by_host(x.join(y, same, "left_anti"), "removals")


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text) for each row of pages."""
    kind = pages.schema[id_col].dataType.simpleString()
    own = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.lower(F.regexp_extract(F.coalesce(F.col(url_col), F.lit("")), HOST, 1)).alias("host"), F.col(html_col).alias("html"))
    met = _meet(own, removals(own), "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                texts = [main_text(h or "", set(p or ()), set(t or ())) for h, p, t in zip(*(batch.column(i).to_pylist() for i in (2, 3, 4)), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], names=["page_id", "url", "text"])

    return met.select("page_id", "url", "html", "bad_paths", "bad_texts").mapInArrow(run, f"page_id {kind}, url string, text string")


def op7_html_text(spark, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages")).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))

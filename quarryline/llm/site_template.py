"""Operator 11: HTML extraction by removal of site templates.

What a site repeats on its pages is its template. The first pass hashes the
element subtrees of every page; Spark counts, for each host and hash, the
different main texts that it stands beside; subtrees that stand beside many
are the host's template. The second pass deletes them, then what a plain rule
knows as no part of an article (``DROPPED``, ``MARKS``), as no count finds the
menu of a host with two pages. What is left of the page's ``article``
elements, else of its ``main``, else of its body, is the text.

Different main texts are counted, not pages, so copies of one page make
nothing a template. Outside the main element MIN_PAGES main texts and SHARE of
the host's pages are enough. Within it only boxes (``BOXES``) are counted and
IN_MAIN of the host's pages are asked for, so passages that many articles
share, paragraphs above all, stay. A subtree counts only on pages of which it
is less than half of the text.

A page sends each of its subtrees once, and what is shuffled is summed by task
first, so a hot host or subtree gathers nothing. The templates are broadcast
while they number ``AT_ONCE`` or fewer, 16 bytes each; beyond that the subtrees
of each page are joined with them, and the page by its own key with its few
hits. Both ways give the same rows.

Defined results: a null or empty page has an empty text; a null url, or one
without a host, has no template, and the rules alone hold; equal rows give
equal rows; page ids may be null or tie; an empty table works; other columns
are ignored. Unclosed elements end with their parent, a ``p`` with the next
block, and a rule's element that was never closed keeps an article within it.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarryline.llm.shared import written

#: A subtree beside so many main texts, and in this share of the host's pages, is a template; within the main element a larger share.
MIN_PAGES, SHARE, IN_MAIN = 3, 0.005, 0.5
#: Templates that are broadcast at once.
AT_ONCE = 200_000
#: Elements that are no part of an article, wherever they stand; ``header`` outside of one only.
DROPPED = frozenset("nav footer aside form button select option input label dialog menu head title textarea script style noscript template iframe svg canvas object video audio".split())
#: Words of a class, id or role that mark such an element, inline ones too, also in the plural.
MARKS = frozenset(
    "nav navbar navigation menu breadcrumb breadcrumbs masthead banner footer contentinfo copyright sidebar complementary ad ads advert adverts advertisement advertising sponsor sponsored promo promotion "
    "cookie cookies consent gdpr notice notification alert popup modal overlay newsletter subscribe signup login search share sharing social related recommended comment comments disqus replies respond pagination pager toolbar topbar subnav submenu skip disclaimer widget".split()
)
#: Class names with these first words speak of something else.
NOT_MARKED = frozenset("no has with without".split())
#: Names of a page's own header, beside the element of that name.
HEADERS = frozenset("header site-header page-header top-header global-header".split())
RAW = frozenset("script style textarea title noscript iframe".split())
IN_HEAD = frozenset("base link meta title style script noscript template".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
BOXES = frozenset("div section aside figure table".split())
#: An open element of the first kind ends where one of the second begins.
ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^>\"']++)*+|[^>]*)>|<[a-zA-Z/!?][^>]*\Z", re.S)
NAMED = re.compile(r"\b(class|id|role)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", re.I)
ROLE = re.compile(r"\brole\s*=\s*[\"']?main\b", re.I)
WORDS = re.compile(r"[a-z]+")


def marked(attributes: str, in_main: bool = True) -> bool:
    """Whether a class, id or role has a word of MARKS, or outside of the main element names the page's header."""
    for _, value in NAMED.findall(attributes):
        for name in value.lower().strip("\"'").split():
            words = WORDS.findall(name)
            if words and words[0] not in NOT_MARKED and any(w in MARKS or w[-1] == "s" and w[:-1] in MARKS for w in words) or name in HEADERS and not in_main:
                return True
    return False


def walk(html: str, closed) -> tuple[list, list, list]:
    """(runs, articles, mains): the page's texts with None for a block's end, and the ranges of its main elements.

    ``closed(tag, attributes, hash, runs, start, length, in_main, own_end)`` is
    called at the end of each element that is not inline, innermost first; its
    texts are runs[start:], of ``length`` characters before any was deleted,
    and it may delete them. The hash covers names and texts, not attributes.
    """
    from html import unescape

    from xxhash import xxh64_digest

    runs, articles, mains, in_main, chars = [], [], [], 0, 0
    stack, open_tags = [("", "", 0, [], False, 0)], {}

    def end(own: bool) -> None:
        nonlocal in_main
        tag, attributes, start, parts, main, before = stack.pop()
        open_tags[tag] -= 1
        digest = xxh64_digest(tag.encode("utf-8", "replace") + b"".join(parts))
        stack[-1][3].append(digest)
        if tag in INLINE:
            if attributes and marked(attributes):
                del runs[start:]
            return
        in_main -= main
        closed(tag, attributes, digest, runs, start, chars - before, in_main > 0, own)
        if len(runs) == start:
            for ranges in (articles, mains):  # those within went with it
                while ranges and ranges[-1][0] >= start:
                    ranges.pop()
        elif main:
            (articles if tag == "article" else mains).append((start, len(runs)))
        runs.append(None)

    def text(piece: str) -> None:
        nonlocal chars
        piece = unescape(piece) if "&" in piece else piece
        runs.append(piece)
        if words := " ".join(piece.split()):
            chars += len(words)
            stack[-1][3].append(xxh64_digest(words.encode("utf-8", "replace")))

    def end_within(others: tuple, passed) -> None:
        """Open elements of those names end, as far as only inline ones and ``passed`` stand above them."""
        at = len(stack) - 1
        while stack[at][0] in INLINE or stack[at][0] in passed:
            at -= 1
        while stack[at][0] in others:
            at -= 1
            while stack[at][0] in INLINE or stack[at][0] in passed:
                at -= 1
        while len(stack) > at + 1 and any(open_tags.get(x) for x in others):
            end(False)

    position, size = 0, len(html)
    while found := TAG.search(html, position):
        if found.start() > position:
            text(html[position : found.start()])
        position, tag = found.end(), (found[2] or "").lower()
        if not tag:
            continue
        if found[1]:
            if open_tags.get(tag):
                if tag in INLINE:  # ends no block
                    at = len(stack) - 1
                    while stack[at][0] in INLINE and stack[at][0] != tag:
                        at -= 1
                    if stack[at][0] != tag:
                        continue
                while stack[-1][0] != tag:
                    end(False)
                end(True)
            continue
        if tag not in INLINE:
            if open_tags.get("head") and tag not in IN_HEAD:
                while open_tags["head"]:
                    end(False)
            others = ENDS.get(tag, ())
            if any(open_tags.get(x) for x in others):
                end_within(others, ("p",))
            if open_tags.get("p"):
                end_within(("p",), ())
            runs.append(None)
        if tag in VOID:
            continue
        if tag in RAW:  # nothing in it is markup, and none of it is kept
            stop = re.compile(rf"</{tag}(?=[\s/>])[^>]*>", re.I).search(html, position)
            position = stop.end() if stop else size
            continue
        main = tag in ("article", "main") and not marked(found[3]) or tag not in INLINE and "main" in found[3] and ROLE.search(found[3]) is not None
        stack.append((tag, found[3], len(runs), [], main, chars))
        open_tags[tag] = open_tags.get(tag, 0) + 1
        in_main += main
    if position < size:
        text(html[position:])
    while len(stack) > 1:
        end(False)
    return runs, articles, mains


def by_rule(tag: str, attributes: str, in_main: bool) -> bool:
    """Whether an element is dropped whatever its host's pages have."""
    if tag in DROPPED or tag == "header" and not in_main:
        return True
    return bool(attributes) and tag not in ("html", "body", "main") and marked(attributes, in_main)


def main_runs(runs: list, articles: list, mains: list) -> list:
    """The texts of the outermost articles, else of the main element, else all."""
    ranges, out, upto = articles or mains, [], 0
    if not ranges:
        return runs
    for start, stop in sorted(ranges, key=lambda x: (x[0], -x[1])):
        if start >= upto:
            out += [None, *runs[start:stop]]
            upto = stop
    return out


def joined(runs: list) -> str:
    """The blocks' texts: white space within one becomes one space, and so does the end of each."""
    words, block = [], []
    for run in [*runs, None]:
        if run is not None:
            block.append(run)
        elif block:
            words += "".join(block).split()
            block = []
    return " ".join(words)


def extract(html: str, template=None) -> tuple[str, int]:
    """(text, subtrees deleted by count) of one page; ``template(hash, in_main)`` tells what its host repeats."""
    inner, gone = 0, 0

    def closed(tag, attributes, digest, runs, start, length, in_main, own):
        nonlocal inner, gone
        if tag in ("article", "main"):
            inner = len(runs)
        if length and template and counted(tag, in_main) and template(digest, in_main):
            gone += 1
            del runs[start:]
        elif by_rule(tag, attributes, in_main) and (own or inner <= start):
            del runs[start:]

    return joined(main_runs(*walk(html, closed))), gone


def counted(tag: str, in_main: bool) -> bool:
    return tag in BOXES if in_main else tag not in ("html", "body", "main", "article")


def subtrees(html: str) -> tuple[set, bytes]:
    """({(hash, in the main element)} of less than half of the text, hash of the main text) of one page."""
    from xxhash import xxh64_digest

    found, total = [], 0

    def closed(tag, attributes, digest, runs, start, length, in_main, own):
        nonlocal total
        if length and counted(tag, in_main):
            found.append((digest, in_main, length))
        total = max(total, length)
        if by_rule(tag, attributes, in_main) and own:
            del runs[start:]

    text = joined(main_runs(*walk(html, closed)))
    return {(d, m) for d, m, n in found if 2 * n < total}, xxh64_digest(text.encode("utf-8", "replace"))


# ---------------------------------------------------------------- Spark


def host_of(url: Column) -> Column:
    """The host in lower case, without user and port; null where there is none."""
    found = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    return F.when(found != "", found)


def _key(host: str, digest: bytes, in_main: bool) -> bytes:
    from xxhash import xxh128_digest

    return xxh128_digest(host.encode("utf-8", "replace") + (b"\x01" if in_main else b"\x00") + digest)


def _strings(column) -> list[str | None]:
    return [None if x is None else x.decode("utf-8", "replace") for x in column.cast("binary").to_pylist()]


def site_templates(pages: DataFrame, *, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """key: the templates of all hosts, each by a hash of its host, its subtree and whether it stands in the main element."""
    rows = pages.select(host_of(F.col(url_col)).alias("host"), F.col(html_col).alias("html")).where("host IS NOT NULL AND html IS NOT NULL")

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            hosts, flags, keys, beside = [], [], [], []
            for host, html in zip(_strings(batch.column(0)), _strings(batch.column(1)), strict=True):
                found, main = subtrees(html)
                for digest, in_main in found:
                    hosts.append(host)
                    flags.append(in_main)
                    keys.append(_key(host, digest, in_main))
                    beside.append(int.from_bytes(main, "big", signed=True))
            yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(flags, pa.bool_()), pa.array(keys, pa.binary()), pa.array(beside, pa.int64())], names=["host", "in_main", "key", "beside"])

    seen = rows.mapInArrow(run, "host string, in_main boolean, key binary, beside long")
    counts = seen.distinct().groupBy("key", "host", "in_main").agg(F.count("*").alias("n")).where(F.col("n") >= MIN_PAGES)
    sizes = rows.groupBy("host").agg(F.count("*").alias("pages"))
    enough = F.col("n") >= F.col("pages") * F.when(F.col("in_main"), F.lit(IN_MAIN)).otherwise(F.lit(SHARE))
    return counts.join(sizes, "host").where(enough).select("key")


def _texts(rows: DataFrame, keep: list[str], known) -> DataFrame:
    """``keep``, text, n_chars and n_recurring for rows of keep, __host, __html and perhaps __hits; ``known()`` gives the broadcast templates."""
    at, width, own = len(keep), len(keep) + 2, known is None

    def run(batches):
        import pyarrow as pa

        every = None if own else known.value
        for batch in batches:
            texts, counts = [], []
            hits = batch.column(width).to_pylist() if own else [every] * batch.num_rows
            for host, html, mine in zip(_strings(batch.column(at)), _strings(batch.column(at + 1)), hits, strict=True):
                mine = frozenset(mine or ()) if own else mine
                template = (lambda digest, in_main, h=host, m=mine: _key(h, digest, in_main) in m) if host is not None and mine else None
                text, gone = extract(html or "", template)
                texts.append(text.encode("utf-8", "replace").decode())
                counts.append(gone)
            sizes = [len(x) for x in texts]
            yield pa.RecordBatch.from_arrays([*batch.columns[:at], pa.array(texts, pa.string()), pa.array(sizes, pa.int64()), pa.array(counts, pa.int64())], names=[*keep, "text", "n_chars", "n_recurring"])

    return rows.mapInArrow(run, rows.select(*keep, F.lit("").alias("text"), F.lit(0).cast("long").alias("n_chars"), F.lit(0).cast("long").alias("n_recurring")).schema)


def main_texts(pages: DataFrame, *, keep: tuple[str, ...] = ("page_id", "url"), url_col: str = "url", html_col: str = "html", at_once: int = AT_ONCE) -> DataFrame:
    """``keep`` (none of them text, n_chars or n_recurring), the main text, its code points, and how many subtrees were deleted as repeated."""
    templates = written(site_templates(pages, url_col=url_col, html_col=html_col), "site-templates")
    named = [F.col(c) for c in keep]
    rows = pages.select(*named, host_of(F.col(url_col)).alias("__host"), F.col(html_col).alias("__html"))
    if templates.count() <= at_once:
        every = frozenset(bytes(r[0]) for r in templates.collect())  # at_once keys of 16 bytes at most
        return _texts(rows, list(keep), pages.sparkSession.sparkContext.broadcast(every))
    own = rows.select("*", F.xxhash64("__host", "__html").alias("__a"), F.sha1(F.col("__html").cast("binary")).alias("__b"))
    sent = own.select("__a", "__b", "__host", "__html").where("__host IS NOT NULL AND __html IS NOT NULL")

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            a, b, keys = [], [], []
            columns = [batch.column(0).to_pylist(), batch.column(1).to_pylist(), _strings(batch.column(2)), _strings(batch.column(3))]
            for x, y, host, html in zip(*columns, strict=True):
                mine = {_key(host, *z) for z in subtrees_of(html)}
                a += [x] * len(mine)
                b += [y] * len(mine)
                keys += mine
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.string()), pa.array(keys, pa.binary())], names=["__a", "__b", "key"])

    hits = sent.mapInArrow(run, "__a long, __b string, key binary").join(templates, "key", "left_semi").groupBy("__a", "__b").agg(F.collect_set("key").alias("__hits"))
    met = own.join(hits, ["__a", "__b"], "left").select(*rows.columns, "__hits")
    return _texts(met, list(keep), None)


def subtrees_of(html: str) -> set:
    """Every (hash, in the main element) that a template may be, of whatever share of the page."""
    found = set()
    walk(html, lambda tag, attributes, digest, runs, start, length, in_main, own: found.add((digest, in_main)) if length and counted(tag, in_main) else None)
    return found


def op11_site_template(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_texts(spark.read.parquet(f"{sf_dir}/pages.parquet"))

"""Main text of web pages by their structure and by differencing with the pages nearest by URL.

Pages of a host are ordered by path. A page's partners are the nearest pages before and after it whose content differs:
copies of an article stand on neighbouring pages and would delete each other. All text lines of a page, menus included,
are aligned with a partner's by longest common subsequence. Lines shared with both partners are deleted, and those shared
with the nearer one, unless these are over half of what is left: then the partner is a near copy. Markup settles
what differencing can't: lines in ``article`` or ``main`` (or else in an element named like content) stay, shared or not,
and lines in menus, forms, notices and the like go, shared or not.

Only hashes of lines are ordered and aligned; texts are read again when it is known which lines go.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import small_batches, written
from .url_filter import host_of, path_of

# Element names of HTML by their role.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe textarea title svg math object canvas audio video".split())
APART = frozenset("nav footer aside form button select dialog menu head".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
#: Elements that end an open paragraph no further than their own start.
HOLDERS = frozenset("article aside blockquote body dd div dl fieldset figure footer form header li main nav ol section table tbody td th tr ul".split())
SAME = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: Words in class, id or role that tell what isn't the article.
NAMES = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs captcha comment comments consent cookie cookies copyright disclaimer disqus footer gdpr header legal login masthead menu modal nav navbar navigation newsletter notice notices overlay pager pagination popup promo promotion recommended related replies respond share sharing sidebar signup skip social sponsor sponsored subscribe tags toc toolbar widget".split()
)
#: Names that give the article away where there is no article or main element.
CONTENT = re.compile(r"(?:^|\s)(?:(?:main|article|post|entry|story|page)[-_]?(?:content|body|text)|content|article|post|entry|story)(?:\s|$)")

TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+>|[^>]*>)""", re.S)
ATTRIBUTE = re.compile(r"""\b(class|id|role|hidden|aria-hidden)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))""", re.I)
SPLIT = re.compile(r"[^a-z0-9]+")
#: Up to this many bits an alignment keeps its table; larger ones divide and conquer.
TABLE_BITS = 1 << 28
#: Pages that are ordered in one task, about.
PART = 20_000
#: Up to this many lines to delete are sent to every executor; more meet their pages by a shuffle, in so many salts.
BROADCAST_LINES, SALTS = 500_000, 16


@dataclass(slots=True)
class Line:
    """A block's text. role 2: in an article or main element; 1: in an element named like content; 0: elsewhere; -1: apart."""

    text: str
    role: int


def _role(name: str, attributes: str, above: int) -> int:
    if above < 0:
        return above
    if name in APART or (name == "header" and above < 2):
        return -1
    role = 2 if name in ("article", "main") else above
    if "=" not in attributes:
        return role
    for key, *values in ATTRIBUTE.findall(attributes):
        value = "".join(values).lower()
        if key.lower() in ("hidden", "aria-hidden"):
            if value == "true":
                return -1
        elif name not in ("html", "body", "article", "main") and NAMES.intersection(SPLIT.split(value)):
            return -1
        elif key.lower() == "role" and value == "main":
            role = 2
        elif role == 0 and CONTENT.search(value):
            role = 1
    return role


def page_lines(page: str) -> list[Line]:
    """The blocks of a page in order, those apart (menus, forms, ...) included; scripts and the like are no blocks."""
    lines: list[Line] = []
    stack: list[tuple[str, int]] = []
    role, buffer, at = 0, [], 0

    def flush() -> None:
        if buffer:
            text = "".join(buffer)
            text = " ".join((html.unescape(text) if "&" in text else text).split())
            if text:
                lines.append(Line(text, role))
            buffer.clear()

    find = TAG.search
    while m := find(page, at):
        if m.start() > at:
            buffer.append(page[at : m.start()])
        at = m.end()
        name = m[2]
        if not name:
            continue
        name = name.lower()
        if name in RAW:
            if m[1] or m[3].endswith("/>"):
                continue
            close = re.compile(rf"</{name}(?=[\s/>])[^>]*>", re.I).search(page, at)
            at = close.end() if close else len(page)
            continue
        if name == "br":
            buffer.append(" ")
            continue
        inline = name in INLINE
        if not inline:
            flush()
        if m[1]:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == name:
                    if inline and any(n not in INLINE for n, _ in stack[k + 1 :]):
                        break
                    if role != (below := stack[k - 1][1] if k else 0):
                        flush()
                    del stack[k:]
                    role = below
                    break
            continue
        if name in VOID:
            continue
        if not inline:  # ends an open paragraph, or the item before
            ends = SAME.get(name, {"p"}) if name != "p" else {"p"}
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] in ends or stack[k][0] == "p":
                    del stack[k:]
                    role = stack[-1][1] if stack else 0
                    break
                if stack[k][0] in HOLDERS and name not in SAME or stack[k][0] in ("ul", "ol", "dl", "table"):
                    break
        if m[3].endswith("/>") and inline:
            continue
        new = _role(name, m[3], role)
        if new != role:
            flush()
        stack.append((name, new))
        role = new
    if at < len(page):
        rest = page[at:]
        cut = re.search(r"<[a-zA-Z/!][^<]*\Z", rest)  # a tag that the page's end cuts off
        buffer.append(rest[: cut.start()] if cut else rest)
    flush()
    return lines


def _row(a: list, b: list) -> tuple[list[int], int]:
    """Bit vectors of the alignment after each line of ``a``: a zero at bit j is a step up at line j of ``b``."""
    where: dict = {}
    for j, x in enumerate(b):
        where[x] = where.get(x, 0) | 1 << j
    full = (1 << len(b)) - 1
    v, kept = full, []
    for x in a:
        hit = v & where.get(x, 0)
        v = (v + hit | v - hit) & full
        kept.append(v)
    return kept, full


def _steps(v: int, n: int) -> list[int]:
    """Lengths of the common subsequence for each prefix of ``b``."""
    out, total = [0], 0
    for c in reversed(format(v, f"0{n}b")) if n else "":
        total += c == "0"
        out.append(total)
    return out


def shared(a: list, b: list) -> set[int]:
    """Places in ``a`` of the lines of one longest common subsequence with ``b``, by bit-parallel dynamic programming."""
    found: set[int] = set()
    todo = [(0, len(a), 0, len(b))]
    while todo:
        lo, hi, left, right = todo.pop()
        while lo < hi and left < right and a[lo] == b[left]:
            found.add(lo)
            lo, left = lo + 1, left + 1
        while lo < hi and left < right and a[hi - 1] == b[right - 1]:
            hi, right = hi - 1, right - 1
            found.add(hi)
        if lo == hi or left == right:
            continue
        x, y = a[lo:hi], b[left:right]
        if len(x) == 1:
            if x[0] in y:
                found.add(lo)
            continue
        if len(x) * len(y) <= TABLE_BITS:
            kept, full = _row(x, y)
            i, j = len(x) - 1, len(y) - 1
            while i >= 0 and j >= 0:
                above = kept[i - 1] if i else full
                if kept[i] >> j & 1:
                    j -= 1  # no step up at j
                elif above >> j & 1:
                    found.add(lo + i)
                    i, j = i - 1, j - 1
                else:
                    i -= 1
            continue
        mid = len(x) // 2
        first = _steps(_last(x[:mid], y), len(y))
        second = _steps(_last(x[mid:][::-1], y[::-1]), len(y))
        cut = max(range(len(y) + 1), key=lambda j: first[j] + second[len(y) - j])
        todo += [(lo, lo + mid, left, left + cut), (lo + mid, hi, left + cut, right)]
    return found


def _last(a: list, b: list) -> int:
    where: dict = {}
    for j, x in enumerate(b):
        where[x] = where.get(x, 0) | 1 << j
    full = v = (1 << len(b)) - 1
    for x in a:
        hit = v & where.get(x, 0)
        v = (v + hit | v - hit) & full
    return v


def free_lines(roles: list[int]) -> list[int]:
    """Places of the lines that differencing decides on: neither apart nor in the article by the author's markup."""
    top = max(max(roles, default=0), 1)
    return [i for i, role in enumerate(roles) if 0 <= role < top]


def main_text(lines: list[Line], drop: list[int]) -> str:
    """The text of a page without the lines apart and those at the places ``drop``."""
    gone = set(drop)
    return "\n\n".join(x.text for i, x in enumerate(lines) if x.role >= 0 and i not in gone)


@dataclass(slots=True)
class Page:
    """What is aligned of a page: hashes, roles and lengths of its lines."""

    key: int
    path: str
    content: int
    hashes: list[int]
    roles: list[int]
    sizes: list[int]
    foreign: bool = False


def template_lines(page: Page, before: Page | None, after: Page | None) -> list[int]:
    """Places of the page's lines that differencing with its partners deletes."""
    free = free_lines(page.roles)
    near = [x for x in (before, after) if x is not None]
    if not free or not near:
        return []
    if len(near) == 2 and _common(after.path, page.path) > _common(before.path, page.path):
        near.reverse()
    hits = [shared(page.hashes, x.hashes) for x in near]
    if len(hits) == 1:
        return [i for i in free if i in hits[0]]
    both = [i for i in free if i in hits[0] and i in hits[1]]
    rest = [i for i in free if not (i in hits[0] and i in hits[1])]
    once = [i for i in rest if i in hits[0]]
    copy = 2 * sum(page.sizes[i] for i in once) > sum(page.sizes[i] for i in rest)
    return both if copy else sorted(both + once)


def _common(a: str, b: str) -> int:
    n = min(len(a), len(b))
    for k in range(n):
        if a[k] != b[k]:
            return k
    return n


def _hash(text: str) -> int:
    return int.from_bytes(xxhash.xxh3_64_digest(text.encode("utf-8", "surrogatepass")), "big", signed=True)


ORDER = ["host", "path", "page_id", "key"]
LINED = "key long, host string, path string, page_id long, content long, hashes array<long>, roles array<int>, sizes array<int>"


def extract_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Main text of every page: page_id, url, text (empty if none) and n_chars.

    Null html is an empty page, an empty table gives no rows; other columns don't matter, whatever their names. Pages with
    a null URL, or one without ``://``, count as one host. Pages of one path are ordered by id (null first) and hash of
    the row. Repeated rows have equal texts and are no partners of each other. A page whose host has no page of other
    content keeps all lines that markup doesn't give away; with one partner alone, all lines shared with it go. Very long
    pages are aligned by divide and conquer. Results don't depend on partitions.
    """
    spark = pages.sparkSession
    small_batches(spark)
    url = F.col(url_col)
    base = pages.select(F.col(id_col).cast("long").alias("page_id"), url.alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("html"))
    base = base.withColumn("key", F.xxhash64("page_id", "url", "html"))

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes, roles, sizes, content = [], [], [], []
            for page in batch.column("html"):
                lines = page_lines(page.as_py())
                hashes.append([_hash(x.text) for x in lines])
                roles.append([x.role for x in lines])
                sizes.append([len(x.text) for x in lines])
                top = max(max(roles[-1], default=0), 1)
                own = [h for h, r in zip(hashes[-1], roles[-1]) if r == top] or [h for h, r in zip(hashes[-1], roles[-1]) if r >= 0]
                content.append(int.from_bytes(xxhash.xxh3_64_digest(repr(own)), "big", signed=True))
            numbers = pa.list_(pa.int32())
            columns = [*(batch.column(c) for c in ("key", "host", "path", "page_id")), pa.array(content, pa.int64()), pa.array(hashes, pa.list_(pa.int64())), pa.array(roles, numbers), pa.array(sizes, numbers)]
            yield pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in LINED.split(", ")])

    lined = base.select("key", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), "page_id", "html").mapInArrow(parse, LINED)
    lined = written(lined, "pages-lines")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-lined.count() // PART))
    ordered = lined.dropDuplicates(["key"]).repartitionByRange(parts, *ORDER).sortWithinPartitions(*ORDER)
    ordered = written(ordered.withColumn("part", F.spark_partition_id()), "pages-ordered")
    rows = ordered.withColumn("foreign", F.lit(False)).unionByName(_from_other_parts(ordered).withColumn("foreign", F.lit(True)))
    rows = rows.repartitionByRange(parts, "part").sortWithinPartitions("part", *ORDER)

    def difference(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, drops = [], []

        def finish(run: list[Page], before: Page | None, after: Page | None) -> None:
            for page in run:
                if not page.foreign and (drop := template_lines(page, before, after)):
                    keys.append(page.key), drops.append(drop)

        at, before, run = None, None, []
        for batch in batches:
            for row in batch.to_pylist():
                page = Page(row["key"], row["path"], row["content"], row["hashes"], row["roles"], row["sizes"], row["foreign"])
                if at != (at := (row["part"], row["host"])):
                    finish(run, before, None)
                    before, run = None, [page]
                elif page.content == run[0].content:
                    run.append(page)
                else:
                    finish(run, before, page)
                    before, run = run[-1], [page]
            if keys:
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(drops, pa.list_(pa.int32()))], ["key", "gone"])
                keys, drops = [], []
        finish(run, before, None)
        if keys:
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(drops, pa.list_(pa.int32()))], ["key", "gone"])

    gone = written(rows.mapInArrow(difference, "key long, gone array<int>").withColumnRenamed("key", "_key"), "pages-gone")
    many = gone.agg(F.coalesce(F.sum(F.size("gone")), F.lit(0))).first()[0] > BROADCAST_LINES
    match = F.col("key") == F.col("_key")
    if many:  # a page may be repeated very often: its rows are salted by their task
        gone = gone.withColumn("_salt", F.explode(F.array(*[F.lit(i) for i in range(SALTS)])))
        base = base.withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(SALTS)))
        match = match & (F.col("salt") == F.col("_salt"))

    @F.arrow_udf("string")
    def text_of(parts: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for html_, drop in parts:
            yield pa.array([main_text(page_lines(h.as_py()), d or []) for h, d in zip(html_, drop.to_pylist())], pa.string())

    joined = base.join(gone if many else F.broadcast(gone), match, "left")
    return joined.select("page_id", "url", text_of("html", "gone").alias("text")).withColumn("n_chars", F.length("text").cast("long"))


def _from_other_parts(ordered: DataFrame) -> DataFrame:
    """For each part the two pages before it and after it, on the host, that its first and last pages may need.

    These are the page next to the part and the next one whose content differs from that page's. A part's own edges, four
    rows a part, are enough to find them.
    """
    here, row = ordered.select("part", "content", *ORDER), F.struct(*ORDER, "content", "part")
    edges = here.groupBy(F.col("part").alias("_part")).agg(F.min(row).alias("f1"), F.max(row).alias("l1"))
    other = lambda e: (F.col("host") == F.col(f"{e}.host")) & (F.col("content") != F.col(f"{e}.content"))
    seconds = here.join(edges, F.col("part") == F.col("_part")).groupBy("part").agg(F.min(F.when(other("f1"), row)).alias("f2"), F.max(F.when(other("l1"), row)).alias("l2"))
    either = edges.join(seconds, F.col("part") == F.col("_part"), "left")
    every = either.select(F.explode(F.array("f1", "f2", "l1", "l2")).alias("e")).where("e IS NOT NULL").select("e.*").distinct()
    along = Window.partitionBy("host").orderBy("path", "page_id", "key")
    change_back, change_on = F.lag("content").over(along) != F.col("content"), F.lead("content").over(along) != F.col("content")
    every = every.withColumn("_pd", F.when(change_back, F.lag("key").over(along))).withColumn("_nd", F.when(change_on, F.lead("key").over(along)))
    every = every.withColumn("_pd", F.last("_pd", True).over(along.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_nd", F.first("_nd", True).over(along.rowsBetween(0, Window.unboundedFollowing)))
    needs = F.array(F.lag("key").over(along), F.lead("key").over(along), F.lag("_pd").over(along), F.lead("_nd").over(along))
    needed = every.select(F.col("part").alias("_to"), needs.alias("_needs")).select("_to", F.explode("_needs").alias("_key")).where("_key IS NOT NULL").distinct()
    found = needed.join(ordered, F.col("_key") == F.col("key")).where("part <> _to")
    return found.select(*[c for c in ordered.columns if c != "part"], F.col("_to").alias("part")).select(*ordered.columns)

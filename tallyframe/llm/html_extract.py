"""Main text of web pages by nearest-URL page differencing.

Pages of one host are ordered by URL path; each page is paired with the neighbour
that shares the longer path prefix. The text lines of the two pages, those of menus
and footers included, are aligned by longest common subsequence, and the lines they
share are deleted: menus and notices come back on the next page, an article doesn't.

Differencing alone gives wrong results where menus, adverts and footers differ from
page to page, or near copies of an article stand on one host. So markup decides what
the alignment leaves: lines in containers that are no content (navigation, header,
footer, aside, form, advert, comment and notice) go even where they differ, and lines
in an article or main element stay even where they are shared. Copies, and near copies
by NEAR of their characters, are not differenced against each other: a page is paired
with its other neighbour then, or keeps its lines.

Only line hashes and sizes are written and sorted for the pairing; pages that lose no
line to it are not shuffled. The order is total (host, path, url, page) and pairing
works over a range partitioning of it, so a host that holds a third of all pages is
spread over tasks; up to four rows of line hashes a partition find the outer
neighbours, which the driver deals out.

Edge cases: a null html, or one without text, gives the empty text; a null url is
the empty host and path; a page without a neighbour on its host loses no line by
differencing; pages with one id and url are told apart by a hash of their html;
repeated rows and copies lose no line to one another; of neighbours with equally long
prefixes the earlier one is taken; a very long page is one row, and its alignment is
halved until a part's table is TABLE_BITS; unclosed and stray tags are read as browsers
would; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import KeySet, Scratch, cut, slices, table, tidy

# Elements of HTML by role, and words of class, id and role attributes that mark no content;
# ASIDE_WORDS do so on an article or main element too, LINE_WORDS on elements that hold a line.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript template".split())
NOISE = frozenset("nav header footer aside form script style head noscript template iframe svg canvas button select option textarea dialog menu object math audio video title".split())
MAIN = frozenset("article main".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
NOISE_WORDS = frozenset("ad ads adv advert adverts advertisement banner sponsor sponsored promo promotion cookie cookies consent gdpr notice notices alert nav navbar navigation menu breadcrumb breadcrumbs sidebar aside footer header masthead comment comments disqus replies reply share sharing social related recommended newsletter subscribe popup modal login signup search widget toolbar pagination pager copyright".split())
ASIDE_WORDS = frozenset("ad ads advert advertisement sponsored promo comment comments reply replies disqus related".split())
LINE = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre td th li dd dt figure figcaption span a b i em strong small code".split())
LINE_WORDS = frozenset("ad ads adv advert adverts advertisement sponsor sponsored promo promotion cookie cookies consent gdpr notice notices breadcrumb breadcrumbs comment comments disqus share sharing newsletter subscribe copyright".split())
#: Words that begin a class name which tells what stands beside the element.
BESIDE = frozenset("with without has no not".split())
NOISE_ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog menu menubar toolbar".split())

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>|</?([a-zA-Z][^\s/>]*)((?:[^\"'>]|\"[^\"]*\"|'[^']*')*)>|[^<]+|<", re.S)
_ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_SPACE = re.compile(r"\s+")
_WORD = re.compile(r"[^a-z0-9]+")
#: What a line is: open to differencing, in an article, or in a container that is no content.
OPEN, SAFE, MARKED = 0, 1, 2
#: Share of the characters of two pages' content that makes them near copies.
NEAR = 0.9
#: Bits of an alignment's table that is kept whole; larger ones are halved first.
TABLE_BITS = 1 << 26


def _is_noise(name: str, attributes: str) -> bool:
    if name in NOISE:
        return True
    if not attributes.strip() or name in ("html", "body"):
        return False
    found = {k.lower(): html.unescape(a or b or c or "").lower() for k, a, b, c in _ATTRIBUTE.findall(attributes)}
    if "hidden" in found or found.get("aria-hidden") == "true" or found.get("role") in NOISE_ROLES:
        return True
    if "display:none" in found.get("style", "").replace(" ", ""):
        return True
    names = f"{found.get('class', '')} {found.get('id', '')}".split()
    # An article may be a reader's comment or an advert; other words of its class say nothing against it.
    against = ASIDE_WORDS if name in MAIN else LINE_WORDS if name in LINE else NOISE_WORDS
    parts = [[w for w in _WORD.split(n) if w] for n in names]
    return any(p and p[0] not in BESIDE and not against.isdisjoint(p) for p in parts)


def text_lines(page: str) -> list[tuple[str, int]]:
    """(line, what it is) for each block of text, in page order; character references
    decoded, white space as one space."""
    lines: list[tuple[str, int]] = []
    words: list[str] = []
    aside: list[str] = []
    stack: list[tuple[str, bool, bool]] = []  # name, noise, main: as they hold inside
    noise = main = False
    skip_to = 0

    def close() -> None:
        for said, what in ((words, SAFE if main else OPEN), (aside, MARKED)):
            line = _SPACE.sub(" ", html.unescape("".join(said))).strip() if said else ""
            if line:
                lines.append((line, what))
            said.clear()

    for token in _TOKEN.finditer(page):
        if token.start() < skip_to:
            continue
        name = (token[1] or "").lower()
        if not name:
            said = token[0]
            if said == "<" or said[0] != "<":
                (aside if noise else words).append(said)
            elif said.startswith("<![CDATA["):
                (aside if noise else words).append(said[9:].removesuffix("]]>"))
            continue
        if name in BLOCK:
            close()
        elif name == "br":
            words.append(" ")
        if token[0][1] == "/":
            at = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == name), None)
            if at is not None:
                if name not in BLOCK and any(stack[i][0] in BLOCK for i in range(at + 1, len(stack))):
                    stack.pop(at)  # an inline element closed across a block: only its own mark goes
                else:
                    del stack[at:]
                noise, main = (any(s[1] for s in stack), any(s[2] for s in stack))
            continue
        if name in VOID or token[2].endswith("/") and name not in BLOCK:
            continue
        if name in RAW:
            end = re.compile(rf"</{name}\s*>", re.I).search(page, token.end())
            skip_to = end.end() if end else len(page)
            continue
        if name == "p":
            at = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] in ("p", "article", "div", "td", "li", "section", "main", "body")), None)
            if at is not None and stack[at][0] == "p":
                del stack[at:]
        elif name in ("li", "option", "tr", "td", "th", "dt", "dd") and stack and stack[-1][0] == name:
            stack.pop()
        stack.append((name, _is_noise(name, token[2]), name in MAIN or 'role="main"' in token[2]))
        noise, main = any(s[1] for s in stack), any(s[2] for s in stack)
    close()
    return lines


def _rows_of(a: list[int], where: dict[int, int], full: int) -> Iterator[int]:
    """Bit rows of the alignment table, one for each element of a: a zero bit is a step up."""
    row = full
    for x in a:
        hit = row & where.get(x, 0)
        row = ((row + hit) | (row - hit)) & full
        yield row


def common_lines(a: list[int], b: list[int], table_bits: int = TABLE_BITS) -> list[tuple[int, int]]:
    """Index pairs of a longest common subsequence, by bit-parallel rows; tables above
    table_bits are halved by Hirschberg's scheme first."""
    left = set(b)
    ia = [i for i, x in enumerate(a) if x in left]
    left = {a[i] for i in ia}
    ib = [j for j, x in enumerate(b) if x in left]
    same = 0
    while same < min(len(ia), len(ib)) and a[ia[same]] == b[ib[same]]:
        same += 1
    out = list(zip(ia[:same], ib[:same], strict=True))
    ia, ib, tail = ia[same:], ib[same:], []
    while ia and ib and a[ia[-1]] == b[ib[-1]]:
        tail.append((ia.pop(), ib.pop()))
    x, y = [a[i] for i in ia], [b[j] for j in ib]
    if x and y:
        if len(x) * len(y) <= table_bits or len(x) == 1:
            pairs = _traced(x, y)
        else:
            pairs = _halved(x, y, table_bits)
        out += [(ia[i], ib[j]) for i, j in pairs]
    return out + tail[::-1]


def _places(y: list[int]) -> tuple[dict[int, int], int]:
    where: dict[int, int] = {}
    for j, v in enumerate(y):
        where[v] = where.get(v, 0) | 1 << j
    return where, (1 << len(y)) - 1


def _traced(x: list[int], y: list[int]) -> list[tuple[int, int]]:
    where, full = _places(y)
    rows = [full, *_rows_of(x, where, full)]
    i, j, pairs = len(x), len(y), []
    while i and j:
        if rows[i] >> (j - 1) & 1:
            j -= 1
        elif rows[i - 1] >> (j - 1) & 1:
            # The step at j came with element i: it is matched to the step's place.
            if x[i - 1] == y[j - 1]:
                pairs.append((i - 1, j - 1))
                i, j = i - 1, j - 1
            else:
                j -= 1
        else:
            i -= 1
    return pairs[::-1]


def _lengths(x: list[int], y: list[int]) -> list[int]:
    """Length of the longest common subsequence of x and each prefix of y."""
    where, full = _places(y)
    row = full
    for row in _rows_of(x, where, full):
        pass
    steps = np.unpackbits(np.frombuffer((~row & full).to_bytes(len(y) // 8 + 1, "little"), np.uint8), bitorder="little")[: len(y)]
    return [0, *np.cumsum(steps).tolist()]


def _halved(x: list[int], y: list[int], table_bits: int) -> list[tuple[int, int]]:
    mid = len(x) // 2
    ahead, behind = _lengths(x[:mid], y), _lengths(x[mid:][::-1], y[::-1])
    cut_at = max(range(len(y) + 1), key=lambda j: ahead[j] + behind[len(y) - j])
    first = common_lines(x[:mid], y[:cut_at], table_bits)
    return first + [(i + mid, j + cut_at) for i, j in common_lines(x[mid:], y[cut_at:], table_bits)]


def place(url: str | None) -> tuple[str, str]:
    """(host, path with query) of a URL."""
    try:
        parts = urlsplit(url or "")
        return (parts.hostname or ""), parts.path + ("?" + parts.query if parts.query else "")
    except ValueError:
        return "", url or ""


def _prefix(a: str, b: str) -> int:
    n = 0
    for x, y in zip(a, b, strict=False):
        if x != y:
            break
        n += 1
    return n


def near_copies(one: tuple, other: tuple) -> bool:
    """Whether two pages' content (hashes, sizes, kinds) is the same but for a few characters."""
    x, y = ([(h, n) for h, n, k in zip(*page, strict=True) if k != MARKED] for page in (one, other))
    if [h for h, _ in x] == [h for h, _ in y]:
        return True
    total, both = max(sum(n for _, n in x), sum(n for _, n in y)), Counter(h for h, _ in y)
    same = 0
    for h, n in x:
        if both[h]:
            both[h] -= 1
            same += n
    return same >= NEAR * total


def _deleted(own: tuple, other: list[int]) -> tuple[list[int], int, int]:
    """What shared_lines() tells of a page with the outline own, paired with the lines of other."""
    both = {i for i, _ in common_lines(own[0], other)}
    gone, at, shared, marked = [], 0, 0, 0
    for i, kind in enumerate(own[2]):
        if kind == OPEN and i in both:
            gone.append(at)
        shared += kind != SAFE and i in both
        marked += kind == MARKED and i not in both
        at += kind != MARKED
    return gone, shared, marked


def shared_lines(outline: DataFrame) -> DataFrame:
    """(page, gone, shared, marked): indices among a page's content lines of those that its
    neighbour has too, how many unprotected lines differencing deletes, and how many only markup does.

    outline: page (a long), host, path, url, lines, sizes, kinds (arrays).
    """
    order = ["host", "path", "url", "page"]
    # The sorted rows are written, so that partitions and their ends stay as they are.
    sorted_rows = cut(outline.orderBy(*order)).withColumn("part", F.spark_partition_id())
    columns = ["part", "host", "path", "page", "lines", "sizes", "kinds"]

    def content(lines: list, kinds: list) -> list:
        return [(h, k) for h, k in zip(lines, kinds, strict=True) if k != MARKED]

    def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        """(part, host, path, page, outline, content) of each row."""
        for batch in slices(batches):
            for part, host, path, page, *parts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                yield part, host, path, page, tuple(parts), content(parts[0], parts[2])

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The first and last row, and between them those next to them that are no copy of theirs."""
        first = second = last = inner = None
        differ = lambda a, b: (a[1], a[5]) != (b[1], b[5])
        for row in rows_of(batches):
            first = first or row
            if second is None and differ(row, first):
                second = row
            if last is not None and differ(row, last):
                inner = last
            last = row
        found = [row for row in (first, second, inner, last) if row is not None]
        if found:
            made = [[row[k] for row in found] for k in range(4)] + [[row[4][k] for row in found] for k in range(3)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(made, _KINDS, strict=True)], names=columns)

    schema = "part int, host string, path string, page long, lines array<long>, sizes array<int>, kinds array<tinyint>"
    edge: dict[int, list] = {}
    for row in sorted_rows.select(*columns).mapInArrow(ends, schema).toLocalIterator():
        whole = tuple(list(row[k]) for k in columns[4:])
        edge.setdefault(row["part"], []).append((*row[:4], whole, content(whole[0], whole[2])))
    parts = sorted(edge)

    def beyond(start: tuple, rest: Iterator[list]) -> tuple | None:
        """The first row after start, on its host, that is no copy of it."""
        for rows in rest:
            for row in rows:
                if row[1] != start[1] or row[5] != start[5]:
                    return row if row[1] == start[1] else None
        return None

    outer = {p: (beyond(edge[p][0], (edge[q][::-1] for q in reversed(parts[:i]))), beyond(edge[p][-1], (edge[q] for q in parts[i + 1 :]))) for i, p in enumerate(parts)}
    edge.clear()

    @tidy
    def pair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = held = after = None
        copies: list[tuple[str, int]] = []

        def settle(after: tuple | None) -> list[tuple[int, list[int], int, int]]:
            """Pair held and its copies, which stand next to each other, with the rows around them."""
            near = [x for x in (before, after) if x is not None and x[1] == held[1] and not near_copies(held[4], x[4])]
            found: dict[int, tuple[list[int], int, int]] = {}
            done = []
            for path, page in copies:
                k = max(range(len(near)), key=lambda k: _prefix(near[k][2], path), default=-1)
                if k not in found:
                    found[k] = _deleted(held[4], near[k][4][0] if near else [])
                done.append((page, *found[k]))
            return done

        for row in rows_of(batches):
            if held is None:
                before, after = outer.get(row[0], (None, None))
            elif row[1] != held[1] or row[5] != held[5]:
                yield _pairs(settle(row))
                before, copies, held = (held[0], held[1], copies[-1][0], copies[-1][1], *held[4:]), [], None
            held = held or row
            copies.append((row[2], row[3]))
        if held is not None:
            yield _pairs(settle(after))

    return sorted_rows.select(*columns).mapInArrow(pair, "page long, gone array<int>, shared int, marked int")


_KINDS = (pa.int32(), pa.string(), pa.string(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int8()))
_FOUND = (pa.int64(), pa.list_(pa.int32()), pa.int32(), pa.int32())


def _pairs(done: list[tuple[int, list[int], int, int]]) -> pa.RecordBatch:
    columns = zip(*done, strict=True) if done else [[]] * len(_FOUND)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _FOUND, strict=True)], names=["page", "gone", "shared", "marked"])


def _outline(keyed: DataFrame) -> DataFrame:
    """What shared_lines() takes, of keyed(page, url, html)."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh64_intdigest
        for batch in slices(batches):
            places, lines, sizes, kinds = [], [], [], []
            for url, page in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                found = text_lines(page or "")
                places.append(place(url))
                lines.append(np.array([digest(t.encode("utf-8", "replace")) for t, _ in found], np.uint64).view(np.int64))
                sizes.append([len(t) for t, _ in found])
                kinds.append([k for _, k in found])
            hosts, paths = zip(*places, strict=True)
            made = [batch.column(0), pa.array(hosts, pa.string()), pa.array(paths, pa.string()), batch.column(1)]
            yield pa.RecordBatch.from_arrays([*made, *(pa.array(c, t) for c, t in zip((lines, sizes, kinds), _KINDS[4:], strict=True))], names=["page", "host", "path", "url", "lines", "sizes", "kinds"])

    return keyed.select("page", "url", "html").mapInArrow(run, "page long, host string, path string, url string, lines array<long>, sizes array<int>, kinds array<tinyint>")


def _keyed(pages: DataFrame, id_col: str, url_col: str, html_col: str) -> DataFrame:
    return pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"), F.xxhash64(F.col(id_col).cast("string"), url_col, html_col).alias("page"))


def line_report(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row: lines that differencing deletes (shared), and those that only markup does (marked).
    Of copies that follow each other the first one's lines stand for all."""
    with Scratch(pages.sparkSession) as scratch:
        return cut(shared_lines(scratch.table(_outline(_keyed(pages, id_col, url_col, html_col)))).agg(F.sum("shared").alias("shared"), F.sum("marked").alias("marked")))


def extract_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per input row: page_id, url, text, n_chars."""
    keyed, spark = _keyed(pages, id_col, url_col, html_col), pages.sparkSession
    with Scratch(spark) as scratch:
        found = shared_lines(scratch.table(_outline(keyed))).where(F.size("gone") > 0)
        # Repeated rows share their key and their lines.
        found = cut(found.groupBy("page").agg(F.max("gone").alias("gone")))
    known = spark.sparkContext.broadcast(KeySet.of(found, "page"))

    def texts(batch: pa.RecordBatch, gone_of: list) -> pa.RecordBatch:
        said = []
        for page, gone in zip(batch.column(2).to_pylist(), gone_of, strict=True):
            out, content = set(gone or ()), [t for t, k in text_lines(page or "") if k != MARKED]
            said.append("\n".join(t for i, t in enumerate(content) if i not in out) if out else "\n".join(content))
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(said, pa.string()), pa.array([len(t) for t in said], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    @tidy
    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Pages that lose no line to differencing."""
        for batch in slices(batches):
            batch = batch.filter(pa.array(~known.value.has(batch.column(3).to_numpy(zero_copy_only=False))))
            yield texts(batch, [None] * batch.num_rows)

    @tidy
    def maybe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            yield batch.filter(pa.array(known.value.has(batch.column(3).to_numpy(zero_copy_only=False))))

    @tidy
    def rest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            yield texts(batch, batch.column(3).to_pylist())

    kind = keyed.schema["page_id"].dataType.simpleString()
    out = f"page_id {kind}, url string, text string, n_chars long"
    changed = keyed.mapInArrow(maybe, keyed.schema).join(found, "page", "left").select("page_id", "url", "html", "gone")
    return keyed.mapInArrow(whole, out).unionByName(changed.mapInArrow(rest, out))


def op1_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(table(spark, sf_dir, "pages"))

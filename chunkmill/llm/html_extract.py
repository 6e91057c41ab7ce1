"""Main text of HTML pages by differencing each page with its nearest neighbours by URL.

Pages are put in order of host and path; every page is paired with the one before and the one after it
on its host. The pair's text lines are aligned by their longest common
subsequence, and shared lines outside an article element are deleted: a template repeats from page to page, a text doesn't.
What a neighbour can't show (a menu or notice that is different on every page) then goes by the
page's own markup: navigation, header, footer, sidebar, form and advert elements. Lines inside an
article or main element are never deleted for being shared, as copies of an article
under several URLs share all of it. Where a page has such an element, differencing tells whether it holds the text: unmarked lines
outside it that no neighbour shares are kept if they are more text than the articles (teasers beside a body), else
they go. With no neighbour but copies to tell, the article is the text.

Pairing moves 64-bit line hashes, never text: the pages are read once for the hashes and once for
the text, and only the deletions are joined back (broadcast below a checked size, else shuffled).

Pages of a host with equal lines count as one, so neighbours differ. A neighbour that shares more than half of what the
host's template leaves (lines on ten paths of the host, or on half of them and three) is a revised copy, and only the
template's lines go on its evidence. On a host with two texts there is no template to see: sharing more than half
counts as a copy. Only the aligned places go, not every line of that text.

Defined cases: null html gives an empty text; null URLs form one host of their own; elements end where HTML ends them (void ones at once, list items, cells and paragraphs at the next
one or with their parent, other unclosed ones with their parent or the page); html, body, article and main are never
boilerplate, whatever their class; repeated rows are extracted each for itself; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import html as html_lib
import re
from bisect import bisect_left

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ordering import with_row_index
from .common import arrow_schema, stored
from .url_filter import host_path

# Fixed sets of element names and class words.
RAW = frozenset("script style noscript template textarea iframe svg math object canvas title".split())
BOILERPLATE = frozenset("nav header footer aside form button select dialog menu".split())
CONTAINER = frozenset("article main".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th "
    "thead title tr ul".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
CLASS_WORDS = frozenset(
    "ad ads adv advert advertisement adverts banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer "
    "header masthead menu modal nav navbar navigation newsletter notice popup promo promoted sidebar sponsor sponsored "
    "subscribe toolbar widget".split())

VOID = frozenset("area base br col embed frame hr img input link meta param source track wbr".split())
WHOLE = frozenset("html head body article main".split())  # hold the page or its text whatever their class says
# HTML's implied ends: an opening tag ends these open elements, up to the nearest element that holds them
_CELLS, _ROWS = frozenset("td th".split()), frozenset("td th tr".split())
_PARTS = _ROWS | frozenset("thead tbody tfoot caption colgroup".split())
_TABLE, _SCOPE = frozenset(["table"]), frozenset("table td th caption button".split())
ENDS = {"li": (frozenset(["li"]), frozenset("ul ol menu".split()) | _SCOPE), "option": (frozenset(["option"]), frozenset(["select"])),
        **dict.fromkeys(("dt", "dd"), (frozenset("dt dd".split()), frozenset(["dl"]) | _SCOPE)),
        **dict.fromkeys(("td", "th"), (_CELLS, _TABLE)), "tr": (_ROWS, _TABLE),
        **dict.fromkeys(("thead", "tbody", "tfoot"), (_PARTS, _TABLE))}
TABLE_PARTS = _PARTS | _TABLE
ENDS_P = BLOCK - TABLE_PARTS - frozenset("body head html legend option title".split()) | _TABLE

TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:"[^"]*"|'[^']*'|[^'">])*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*+)>|<[!?/][^>]*+>""", re.S)
ATTRIBUTE = re.compile(r"""(?<![\w:-])(class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.I)
SELF_CLOSED = re.compile(r"""(?:^|[\s"']|^[^=]*)/\Z""")  # the slash isn't the end of a bare attribute value

UNDECIDED, ARTICLE, DROPPED = 0, 1, 2
TEMPLATE_PATHS = 10  # a line on so many paths of a host, or on half of them (three at least), is the site's, not a copy's
BROADCAST_ROWS = 50_000  # more pages with deletions than this are joined by a shuffle


def _boilerplate(name: str, attributes: str) -> bool:
    if name in BOILERPLATE:
        return True
    if attributes:
        for kind, value in ATTRIBUTE.findall(attributes):
            for token in value.strip("\"'").lower().split():
                # a class or id counts if all of it is such words: cookie-banner does, article-header and has-sidebar don't
                if token in ROLES if kind.lower() == "role" else CLASS_WORDS.issuperset(re.split("[-_]+", token.strip("-_"))):
                    return True
    return False


def lines(page: str) -> list[tuple[str, int]]:
    """Text lines (blocks, white space folded) of a page in order, each UNDECIDED, in the ARTICLE or DROPPED
    by the page's own markup."""
    out: list[tuple[str, int]] = []
    text: list[str] = []
    open_: list[str] = []  # open elements, outermost first
    count: dict[str, int] = {}  # of them by name
    inside: list[int] = []  # places in open_ of article and main elements outside boilerplate
    skip = -1  # place in open_ of the boilerplate element that drops the text
    at = 0

    def end_line():
        if text:
            line = " ".join(html_lib.unescape("".join(text)).split())
            text.clear()
            if line:
                out.append((line, DROPPED if skip >= 0 else ARTICLE if inside else UNDECIDED))

    def place(names, within):
        """Place of the innermost open element of ``names`` that no element of ``within`` hides, or -1."""
        if any(count.get(n) for n in names):
            for i in range(len(open_) - 1, -1, -1):
                if open_[i] in names:
                    return i
                if open_[i] in within:
                    break
        return -1

    def end(i):
        """Ends the open elements from place ``i`` on."""
        nonlocal skip
        if i < 0:
            return
        if i <= skip or inside and i <= inside[-1]:
            end_line()
        for n in open_[i:]:
            count[n] -= 1
        del open_[i:]
        if i <= skip:
            skip = -1
        while inside and i <= inside[-1]:
            inside.pop()

    while True:
        m = TOKEN.search(page, at)
        if m is None:
            text.append(page[at:])
            end_line()
            return out
        if m.start() > at:
            text.append(page[at:m.start()])
        at = m.end()
        name = m[2] or m[5]
        if name is None:
            continue  # comment, doctype, processing instruction
        name, closing, attributes = name.lower(), bool(m[1] or m[4]), m[3] or m[6] or ""
        if name == "br":
            text.append(" ")
            continue
        if name in BLOCK:
            end_line()
        if closing:
            if name not in VOID and name not in ("html", "body", "head") and count.get(name):
                # a closing tag reaches past table cells only for parts of tables, an inline one not past a block
                end(place((name,), _TABLE if name in TABLE_PARTS and name != "table" else () if name == "table" else
                          _SCOPE - {name} if name in BLOCK or name in BOILERPLATE else BLOCK))
            continue
        closed = attributes.endswith("/") and SELF_CLOSED.search(attributes) is not None
        if name in RAW and not (closed and name in ("svg", "math")):
            end_ = re.compile(rf"</{name}\b[^>]*>", re.I).search(page, at)
            end_line()
            at = end_.end() if end_ else len(page)
            continue
        if name in ENDS_P and count.get("p"):
            end(place(("p",), _SCOPE))
        if name in ENDS:
            names, within = ENDS[name]
            while (i := place(names, within)) >= 0:
                end(i)
        if name in VOID or closed:
            continue
        if skip < 0:
            if name not in WHOLE and not (inside and name == "header") and _boilerplate(name, attributes):
                end_line()
                skip = len(open_)
        elif name == "main" or name == "article" and open_[skip] == "form" and BOILERPLATE.isdisjoint(open_[skip + 1:]):
            skip = -1  # a form or box round the whole page
        if name in CONTAINER and skip < 0:
            inside.append(len(open_))
        open_.append(name)
        count[name] = count.get(name, 0) + 1


def line_hash(line: str) -> int:
    return int.from_bytes(hashlib.blake2b(line.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def common_lines(a: list, b: list) -> list[int]:
    """Positions in ``a`` of a longest common subsequence with ``b`` (matching pairs in order of ``a``; the last
    position in ``b`` of the best run of each length is kept)."""
    where: dict = {}
    for j, x in enumerate(b):
        where.setdefault(x, []).append(j)
    tails: list[int] = []  # smallest end position in b of a run of each length
    ends: list[tuple] = []  # (i, j, previous entry) of those runs
    for i, x in enumerate(a):
        for j in reversed(where.get(x, ())):
            k = bisect_left(tails, j)
            entry = (i, ends[k - 1] if k else None)
            if k == len(tails):
                tails.append(j)
                ends.append(entry)
            else:
                tails[k], ends[k] = j, entry
    out, entry = [], ends[-1] if ends else None
    while entry:
        out.append(entry[0])
        entry = entry[1]
    return out[::-1]


_GONE = "host string, same long, places array<long>, differs boolean"
_LINES = "key long, host string, path string, hashes array<long>, zones array<int>, same long"


def _hash_lines(batches):
    import pyarrow as pa

    schema = arrow_schema(_LINES)
    for batch in batches:
        hashes, zones, same = [], [], []
        for page in batch.column("html").to_pylist():
            found = lines(page or "")
            hashes.append([line_hash(x) for x, _ in found])
            zones.append([z for _, z in found])
            same.append(line_hash(repr((hashes[-1], zones[-1]))))
        yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("host"), batch.column("path"), pa.array(hashes, pa.list_(pa.int64())),
                                          pa.array(zones, pa.list_(pa.int32())), pa.array(same, pa.int64())], schema=schema)


def _compare(batches):
    """Per pair: the page's lines outside an article (places) that go because the neighbour shares them. If more than half of what
    markup and the host's template leave of either page is shared, they are copies (``differs`` is false): only template lines go."""
    import pyarrow as pa

    schema = arrow_schema(_GONE)
    for batch in batches:
        rows = []
        for host, same, own, zones, often, other, rest in zip(*(batch.column(c).to_pylist() for c in (
                "host", "same", "hashes", "zones", "often", "other", "rest")), strict=True):
            often = set(often or ())
            aligned = common_lines(own, other)
            hit = [i for i in aligned if zones[i] != ARTICLE]
            alike = sum(zones[i] != DROPPED and own[i] not in often for i in aligned)
            left = sum(z != DROPPED and h not in often for h, z in zip(own, zones, strict=True))
            copy = rest is not None and 2 * alike > max(left, rest)
            rows.append({"host": host, "same": same, "places": [i for i in hit if own[i] in often] if copy else hit, "differs": not copy})
        yield pa.RecordBatch.from_pylist(rows, schema=schema)


def _keyed(pages: DataFrame) -> DataFrame:
    src = pages.select("page_id", "url", F.col("html").cast("string").alias("html"))
    return src.withColumn("key", F.xxhash64("page_id", "url", "html"))


def shared_lines(pages: DataFrame) -> DataFrame:
    """``key`` of each page that loses lines, and their ``places`` among its lines. Pages with unmarked lines beside an article have a
    row, too, if they were compared with another text than a copy (``differs``)."""
    host, path = host_path(F.col("url"))
    src = _keyed(pages).select("key", host.alias("host"), path.alias("path"), "html")
    narrow = stored(src.mapInArrow(_hash_lines, _LINES), "page-lines")
    # pages of a host with equal lines are one, so that neighbours differ
    texts = narrow.groupBy("host", "same").agg(F.min("path").alias("path"), F.first("hashes").alias("hashes"), F.first("zones").alias("zones"))
    ranked = stored(with_row_index(texts, ["host", "path", "same"], "nr"), "page-ranks")
    undecided = F.exists("zones", lambda z: z == UNDECIDED)
    outside = F.transform(F.filter(F.arrays_zip("hashes", "zones"), lambda x: x["zones"] != ARTICLE), lambda x: x["hashes"])
    # template lines: on how many paths of the host, over its distinct texts (only for hosts that have something undecided)
    hosts = ranked.filter(undecided).select("host").distinct()
    paths = ranked.join(hosts, "host").select("host", "path", F.explode(F.array_distinct(outside)).alias("line")).distinct()
    counts = paths.groupBy("host", "line").agg(F.count("*").alias("n")).filter("n >= 3")
    total = ranked.select("host", "path").distinct().groupBy("host").agg(F.count("*").alias("total"))
    often = counts.join(total, "host").filter((F.col("n") >= TEMPLATE_PATHS) | (2 * F.col("n") >= F.col("total"))).select("host", "line")
    open_ = ranked.join(hosts, "host").select("nr", "host", F.explode(F.array_distinct("hashes")).alias("line"))
    often = open_.join(often, ["host", "line"]).groupBy("nr").agg(F.collect_list("line").alias("often"))
    marked = ranked.join(often, "nr", "left").withColumn("often", F.coalesce("often", F.array().cast("array<long>")))
    own = F.filter(F.arrays_zip("hashes", "zones"), lambda x: x["zones"] != DROPPED)
    rest = F.when(F.exists("zones", lambda z: z != DROPPED), F.size(F.filter(F.transform(own, lambda x: x["hashes"]), lambda h: ~F.array_contains("often", h))))
    near = marked.select("host", F.explode(F.array(F.col("nr") - 1, F.col("nr") + 1)).alias("nr"), F.col("hashes").alias("other"),
                         rest.cast("long").alias("rest"))
    pairs = marked.filter(F.exists("zones", lambda z: z != ARTICLE)).join(near, ["host", "nr"])
    found = pairs.select("host", "same", "hashes", "zones", "often", "other", "rest").mapInArrow(_compare, _GONE)
    gone = found.groupBy("host", "same").agg(F.array_distinct(F.flatten(F.collect_list("places"))).alias("places"), F.max("differs").alias("differs"))
    pages_ = narrow.select("key", "host", "same", (undecided & F.array_contains("zones", ARTICLE)).alias("beside")).distinct()
    return pages_.join(gone, ["host", "same"]).filter((F.size("places") > 0) | F.col("beside") & F.col("differs")).select("key", "places", "differs")


def _texts(batches):
    import pyarrow as pa

    schema = arrow_schema("page_id long, url string, text string, n_chars long")
    for batch in batches:
        texts = []
        for page, deleted, differs in zip(batch.column("html"), *(batch.column(c).to_pylist() for c in ("deleted", "differs")), strict=True):
            gone = set(deleted or ())
            left = [(x, z) for i, (x, z) in enumerate(lines(page.as_py() or "")) if z != DROPPED and i not in gone]  # shared, then marked lines go
            size = {k: sum(len(x) for x, z in left if z == k) for k in (UNDECIDED, ARTICLE)}
            if size[ARTICLE] and not (differs and size[UNDECIDED] > size[ARTICLE]):
                left = [(x, z) for x, z in left if z == ARTICLE]
            texts.append("\n\n".join(x for x, _ in left))
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()),
                                          pa.array([len(t) for t in texts], pa.int64())], schema=schema)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), "html")
    deleted = shared_lines(pages).withColumnRenamed("places", "deleted")
    deleted = stored(deleted, "deleted-lines")
    if deleted.count() <= BROADCAST_ROWS:
        deleted = F.broadcast(deleted)
    src = _keyed(pages).join(deleted, "key", "left").select("page_id", "url", "html", "deleted", "differs")
    return src.mapInArrow(_texts, "page_id long, url string, text string, n_chars long")


def query(spark, sf_dir):
    from .common import table

    return extract(table(spark, sf_dir, "pages", "page_id", "url", "html"))

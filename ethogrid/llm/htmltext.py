"""Main text of web pages by deducing the template that pages of one host share (operator 4)."""

from __future__ import annotations

import html as _html
import re
import zlib
from collections import Counter
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ethogrid.llm.common import table, written

GROUP = 256  # distinct pages of a host whose occurrence vectors are compared at once, on average at most
GROUP_BYTES = 8 << 20  # and their html
BROADCAST = 100_000  # hosts with several parts that are broadcast at most
SUPPORT = 0.5  # share of the group's pages that hold the tokens of a valid class
LEAST_SIZE = 2  # tokens of a valid class
MAIN_PAGES = 3  # pages that a block of an article stands on before it counts as template

RAW = frozenset("script style noscript template textarea iframe svg object canvas select title".split())
ENDLESS = frozenset("script style textarea title".split())  # reach to the page's end if nothing closes them; "/>" doesn't
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that say where text stands; others (p, b, h1, li ...) only shape it.
CONTAINERS = frozenset(
    "html head body nav header footer aside article main section div ul ol dl form fieldset table figure details dialog menu button".split()
)
BLOCKS = CONTAINERS | frozenset("p h1 h2 h3 h4 h5 h6 li dt dd tr td th thead tbody tfoot caption blockquote pre address hr figcaption summary center legend xmp".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
DROPPED = frozenset("head nav header footer aside form dialog menu button".split())
DROPPED_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert".split())
_WORDS = (
    r"(?:ad|ads|advert\w*|adsense|banner|sponsor\w*|promo\w*|sidebar|side|menu|nav|navbar|navigation|breadcrumbs?|footer|header|masthead|"
    r"comments?|respond|disqus|replies|notices?|cookies?|consent|gdpr|alert|popup|modal|overlay|share|sharing|social|related|recommended|"
    r"newsletter|subscribe|subscription|signup|login|search|widget|pagination|pager|toolbar|skip)"
)
_MARKS = re.compile(rf"(?:^|[\s_-]){_WORDS}(?:$|[\s_-])")  # outside of articles parts of names count,
_NAMES = re.compile(rf"(?:^|\s)(?!header|masthead){_WORDS}(?:$|\s)")  # inside whole names only, and an article's own heading stays
_NAME = re.compile(r"/?([a-zA-Z][^\s/<>]*)")
_STOP = re.compile(r"[<>\"']")
_ATTR = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)


class Paths:
    """Numbers of container paths: 0 is outside of all, each other one a container's name within another path. So a token carries one number however deep it stands."""

    def __init__(self):
        self.numbers: dict[tuple[int, str], int] = {}
        self.steps: list[tuple[int, str]] = [(0, "")]

    def within(self, outer: int, name: str) -> int:
        n = self.numbers.get((outer, name))
        if n is None:
            n = self.numbers[outer, name] = len(self.steps)
            self.steps.append((outer, name))
        return n


PATHS = Paths()  # where a caller names none


@dataclass
class Token:
    """A tag, or a text node (``tag`` empty). ``key`` tells tokens apart: the number of their path, and the tag with class and id or the text."""

    tag: str
    closing: bool
    key: tuple
    dropped: bool  # inside an element that never holds main text
    main: bool  # inside an article or main element
    text: str = ""
    path: int = 0
    heading: bool = False  # inside h1 to h6


NOWHERE = ("", "", False, False, 0)


def markup(page: str):
    """(begin, end, tag, closing, attributes) of every tag in order, in time linear in the page; other markup has an empty tag.

    A tag ends at the first ``>`` outside of quotes; if a ``<`` or the end comes before, its own ``<`` is text. The contents of raw elements
    belong to their opening tag; one that nothing closes is empty, or reaches to the end if it is one of ``ENDLESS``.
    """
    at, missing = 0, set()

    def find(what: str, start: int) -> int:
        k = -1 if what in missing else page.find(what, start)
        if k < 0:
            missing.add(what)
        return k

    while (a := page.find("<", at)) >= 0:
        at = a + 1
        if page.startswith("<!--", a):
            end = find("-->", a + 4)
            at = len(page) if end < 0 else end + 3
            yield a, at, "", False, ""
            continue
        if page.startswith(("<!", "<?"), a):
            cdata = page.startswith("<![CDATA[", a)
            end = find("]]>", a) + 3 if cdata and find("]]>", a) >= 0 else find(">", a) + 1
            if end:
                yield a, end, "", False, ""
                at = end
            continue
        name = _NAME.match(page, at)
        if not name:
            continue
        k = name.end()
        while m := _STOP.search(page, k):
            if m[0] in "<>":
                break
            k = find(m[0], m.end()) + 1
            if not k:
                m = None
                break
        if not m or m[0] == "<":
            continue
        tag, closing, attributes, at = name[1].lower(), page[a + 1] == "/", page[name.end() : m.start()], m.end()
        if not closing and (tag in RAW or tag == "xmp") and not (attributes.endswith("/") and tag not in ENDLESS):
            end = None if tag in missing else re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
            if end and tag == "xmp":
                inner, at = page[at : end.start()], end.end()
                yield a, at, tag, False, inner
                continue
            if end:
                at = end.end()
            else:
                missing.add(tag)
                at = len(page) if tag in ENDLESS else at
        yield a, at, tag, closing, attributes


def tokens(page: str | None, paths: Paths = PATHS) -> list[Token]:
    """Tags and text nodes of a page in order; comments and the contents of raw elements are left out. Pages whose tokens are compared share ``paths``."""
    out: list[Token] = []
    stack: list[tuple[str, str, bool, bool, int]] = []  # (tag, name with class, id and role, dropped, main, path within)
    open_ = Counter()  # of the stack's tags
    at, page, heading = 0, page or "", ""
    path = 0

    def text(t: str) -> None:
        if t:
            _, _, dropped, main, _ = stack[-1] if stack else NOWHERE
            out.append(Token("", False, (path, "", " ".join(t.split())), dropped, main, t, path, bool(heading)))

    for begin, end, tag, closing, attributes in markup(page):
        text(_html.unescape(page[at:begin]))
        at = end
        if not tag or (tag in RAW and not closing):
            continue
        if tag == "xmp" and not closing:
            out.append(Token(tag, False, (path, "<", tag), *(stack[-1] if stack else NOWHERE)[2:4], "", path))
            text(attributes)
            closing = True
        if tag in HEADINGS:
            heading = "" if closing else tag
        elif tag in BLOCKS:
            heading = ""
        name, dropped, main = tag, False, False
        if not closing and tag in CONTAINERS:
            attrs = {k.lower(): (a or b or c).lower() for k, a, b, c in _ATTR.findall(attributes)}
            name = re.sub(r"\d+", "N", f"{tag}|{attrs.get('class', '')} {attrs.get('id', '')}|{attrs.get('role', '')}")
            up = stack[-1] if stack else NOWHERE
            dropped, main, _ = inside(up[2], up[3], name)
        if tag in CONTAINERS and closing:
            while open_[tag]:
                inner = stack.pop()
                open_[inner[0]] -= 1
                if inner[0] == tag:
                    name = inner[1]
                    break
            path = stack[-1][4] if stack else 0
        top = stack[-1] if stack else NOWHERE
        out.append(Token(tag, closing, (path, "/" if closing else "<", name), top[2] or dropped, top[3] or main, "", path))
        if tag in CONTAINERS and not closing:
            path = paths.within(path, name)
            stack.append((tag, name, dropped, main, path))
            open_[tag] += 1
    text(_html.unescape(page[at:]))
    return by_block(out)


def inside(dropped: bool, main: bool, name: str) -> tuple[bool, bool, bool]:
    """(dropped, main, named) of a container called ``name``, given those around it; ``named``: an article's block whose name says that it holds something else."""
    tag, marks, role = name.split("|", 1)[0], name.split("|", 1)[1].rsplit("|", 1)[0].strip(), name.rsplit("|", 1)[1]
    named = main and tag not in ("article", "main") and bool(_NAMES.search(marks))
    gone = tag in DROPPED or role in DROPPED_ROLES or (not main and tag not in ("html", "body", "article", "main") and bool(_MARKS.search(marks)))
    if tag == "header" and main and not dropped:
        gone = False  # an article's own heading
    return dropped or gone, main or tag in ("article", "main") or role == "main", named


def by_block(page: list[Token]) -> list[Token]:
    """Inside articles a text node is told apart by the text of its whole block, so that no link or bold word goes from a sentence."""
    run: list[Token] = []
    for t in [*page, Token("p", True, (), False, False)]:
        if not t.tag and t.main and t.text.strip():
            run.append(t)
        elif run and t.tag in BLOCKS:
            whole = " ".join("".join(x.text for x in run).split())
            for i, x in enumerate(run):
                x.key = (x.path, "", whole, i)
            run = []
    return page


@dataclass
class Template:
    """Keys of the tokens in valid equivalence classes, and how the classes nest: class -> class whose slot holds it.

    ``shared`` has the keys that half of the pages (two at least) show to be template: a page alone shows nothing. Containers say what a slot holds only where their opening tags are tokens of a
    valid class, or where they lie in a slot of such a one; without classes nothing is labelled.
    """

    keys: set
    classes: list
    parent: dict
    shared: set = field(default_factory=set)
    paths: Paths = field(default_factory=lambda: PATHS, repr=False)
    known: dict = field(default_factory=lambda: {0: (False, False, False, False)}, repr=False)

    def slot(self, path: int) -> tuple[bool, bool, bool, bool]:
        """(dropped, main, named, within) of the slot in the containers of ``path``; within: some of them is the template's. Each path is looked at once."""
        todo = []
        while path not in self.known:
            todo.append(path)
            path = self.paths.steps[path][0]
        for path in reversed(todo):
            outer, name = self.paths.steps[path]
            dropped, main, named, within = self.known[outer]
            key = (outer, "<", name)
            own = key in self.keys
            if own or (within and name.split("|", 1)[0] in DROPPED):
                dropped, main, here = inside(dropped, main, name)
                named = named or (here and key in self.shared)
            self.known[path] = dropped, main, named, within or own
        return self.known[path]


def deduce(pages: list[list[Token]], support: float = SUPPORT, least: int = LEAST_SIZE, paths: Paths = PATHS) -> Template:
    """Template of pages of one host.

    Tokens with one occurrence vector (how often each page has them) form an equivalence class. A class is valid if at least
    ``least`` tokens share it, enough pages hold it, and its tokens come in one order on every page, round after round; where they don't, the two tags of an element are a class of their own.
    Two pages are enough for tags, which nobody writes twice by chance with all their containers; texts must stand on ``support`` of the pages. A class lies in the slot of another if, on the first page with both, all its tokens fall between two neighbouring
    tokens of one round of the other; a class that overlaps another without nesting is dropped, the larger stays.
    Inside articles a block of text is a template token too, if ``MAIN_PAGES`` pages at least hold it: what two pages say may be a quotation.
    """
    n = len(pages)
    quoted = {t.key for page in pages for t in page if t.main and not t.tag and t.text.strip()}
    vectors: dict[tuple, dict[int, int]] = {}
    for i, page in enumerate(pages):
        for key, c in Counter(t.key for t in page).items():
            vectors.setdefault(key, {})[i] = c
    groups: dict[tuple, list] = {}
    for key, v in vectors.items():
        enough = (2 if n > 1 else 1) if key[1] else max(MAIN_PAGES if key in quoted else 2, support * n)
        if len(v) >= enough:
            groups.setdefault(tuple(sorted(v.items())), []).append(key)
    found = []
    for vector, keys in groups.items():
        if len(keys) < least:
            continue
        wanted = set(keys)
        first = None
        for i, c in vector:
            seq = [t.key for t in pages[i] if t.key in wanted]
            round_ = seq[: len(keys)]
            if first is None:
                first = round_
            if round_ != first or any(seq[j : j + len(keys)] != first for j in range(0, c * len(keys), len(keys))):
                first = None
                break
        if first:
            found.append((vector, first))
        else:  # ordered subsets: tags of one element
            for k in keys:
                if k[1] == "<" and (close := (k[0], "/", k[2])) in wanted:
                    found.append((vector, [k, close]))
    found.sort(key=lambda x: (-len(x[0]), -len(x[1]), str(x[1][0])))
    kept, parent = [], {}
    spans: list[tuple[int, list[int]]] = []
    for vector, keys in found:
        page = vector[0][0]
        where = {k: [] for k in keys}
        for j, t in enumerate(pages[page]):
            if t.key in where:
                where[t.key].append(j)
        mine = sorted(j for v in where.values() for j in v)
        holder, ok = None, True
        for c, (on, marks) in enumerate(spans):
            if on != page or not marks:
                continue
            inside = [m for m in marks if mine[0] < m < mine[-1]]
            if not inside:
                holder = c
            elif len(vector) and sum(x for _, x in vector) == len(vector) and len(inside) < len(marks) and not (marks[0] < mine[0] or mine[-1] < marks[-1]):
                ok = False
        if ok:
            parent[len(kept)] = holder
            kept.append(keys)
            spans.append((page, mine))
    flat = {k for keys in kept for k in keys}
    return Template(flat, kept, parent, {k for k in flat if len(vectors[k]) >= max(2, support * n)}, paths)


def main_text(page: list[Token], template: Template) -> str:
    """Text of the slots that the template leaves, but for those that its containers label as something else; one line a block.

    Where the page has slots of text in an article or main element of the template, only those count. What the template does not know
    labels nothing: without a template all text stays. Blocks inside of an article whose names say that they hold something else are dropped if they
    belong to the template, and their headings stay.
    """
    labels = {p: template.slot(p) for p in {t.path for t in page if not t.tag}}
    data = [t for t in page if not t.tag and t.text.strip() and not labels[t.path][0] and t.key not in template.keys]
    data = [t for t in data if t.heading or not labels[t.path][2]]
    any_main = any(labels[t.path][1] for t in data)
    chosen = {id(t) for t in data if labels[t.path][1] or not any_main}
    blocks, now = [], []
    for t in page:
        if t.tag in BLOCKS:
            blocks.append("".join(now))
            now = []
        elif t.tag == "br":
            now.append(" ")
        elif not t.tag and (id(t) in chosen or (now and not t.text.strip())):
            now.append(t.text)
    blocks.append("".join(now))
    return "\n".join(x for x in (" ".join(b.split()) for b in blocks) if x)


def unlike(pages: list[list[Token]]) -> list[list[Token]]:
    """The first of the pages with the same text outside of dropped elements: copies are no evidence of a template."""
    return list({tuple(" ".join(t.text.split()) for t in p if not t.tag and not t.dropped and t.text.strip()): p for p in reversed(pages)}.values())[::-1]


def extract_group(pages: list[str | None]) -> list[str]:
    """Main text of each page; the template is deduced from what is distinct among them, in an order that does not depend on theirs."""
    paths = Paths()
    parsed = {p: tokens(p, paths) for p in sorted({p or "" for p in pages})}
    template = deduce(unlike(list(parsed.values())), paths=paths)
    texts = {p: main_text(x, template) for p, x in parsed.items()}
    return [texts[p or ""] for p in pages]


def host_of(url):
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def dealt_pages(pages: DataFrame, group: int = GROUP) -> DataFrame:
    """``pages`` with ``host``, ``c`` (hash of the html) and ``part``: parts of a host hold ``group`` distinct pages at most, on average.

    A host has one part for each ``group`` distinct pages or ``GROUP_BYTES`` begun, and a page's part follows from its html. So copies share one,
    and parts depend on the pages of the host only. Hosts with more than one part are counted, and broadcast if they are ``BROADCAST`` at most.
    """
    rows = pages.select("page_id", "url", host_of(F.col("url")).alias("host"), F.coalesce("html", F.lit("")).alias("html")).withColumn("c", F.xxhash64("html"))
    sizes = rows.select("host", "c", F.octet_length("html").alias("size")).distinct().groupBy("host")
    sizes = sizes.agg(F.greatest(F.ceil(F.count("*") / group), F.ceil(F.sum("size") / GROUP_BYTES)).alias("parts")).where("parts > 1")
    big = written(sizes.withColumnRenamed("host", "__host"), "hosts")
    if big.count() <= BROADCAST:
        big = F.broadcast(big)
    return rows.join(big, F.col("host") == F.col("__host"), "left").withColumn("part", F.pmod(F.xxhash64("c"), F.coalesce("parts", F.lit(1))).cast("int")).drop("__host", "parts")


def extract_text(pages: DataFrame, group: int = GROUP) -> DataFrame:
    """(page_id, url, text, n_chars) for every row of ``pages`` (page_id, url, html).

    Templates are deduced for the parts of hosts that ``dealt_pages`` makes, each from its distinct pages, so a host with very many pages
    is spread over partitions and no text depends on the number of partitions. Range partitions never cut a part. Only one shuffle moves
    pages, compressed. Null or empty html gives an empty text. A url without a host, or null, groups with others like it. Repeated rows
    each get the text. Other columns are ignored.
    """

    def squeeze(batches):
        for b in batches:
            data = [zlib.compress(h.encode("utf-8", "surrogatepass"), 1) for h in b.column(5).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(data, pa.binary())], ["page_id", "url", "host", "part", "c", "z"])

    def run(batches):
        ids, urls, at, htmls, host = [], [], [], [], None  # copies come one after the other and are held once

        def solve():
            found = extract_group([zlib.decompress(z).decode("utf-8", "surrogatepass") for z in htmls])
            for i in range(0, len(ids), GROUP):
                texts = [found[k] for k in at[i : i + GROUP]]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[i : i + GROUP], pa.int64()), pa.array(urls[i : i + GROUP], pa.string()), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                    ["page_id", "url", "text", "n_chars"],
                )

        for b in batches:
            for page, url, h, part, z in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if htmls and (h, part) != host:
                    yield from solve()
                    ids, urls, at, htmls = [], [], [], []
                host = (h, part)
                ids.append(page)
                urls.append(url)
                if not htmls or htmls[-1] != z:
                    htmls.append(z)
                at.append(len(htmls) - 1)
        if htmls:
            yield from solve()

    spark = pages.sparkSession
    rows = dealt_pages(pages, group).select("page_id", "url", "host", "part", "c", "html")
    rows = rows.mapInArrow(squeeze, "page_id long, url string, host string, part int, c long, z binary")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartitionByRange(n, "host", "part").sortWithinPartitions("host", "part", "c").select("page_id", "url", "host", "part", "z")
    return dealt.mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of ``pages``."""
    return extract_text(table(spark, sf_dir, "pages"))

"""HTML extraction (operator 4): equivalence-class template deduction over the pages of a host.

Tokens are the pages' slots, an element path such as `body/div.wrap/article/p` and every path above it,
and the texts that stand in a slot. The occurrence vector of a token says on which pages of its host it
stands. Equal vectors are found without gathering pages: each page adds its hash to a 64-bit sum per
(host, token), and tokens of equal sums over equally many pages are one equivalence class. Classes on at
least MIN_PAGES pages of different contents are valid (copies of a page are one page; contents are
marked as bits of SEEN words, and a word with MIN_PAGES bits proves as many contents, so a token's sums have a fixed size;
four contents go unproved with a chance of 1 in 10**8). A class is nested in the nearest slot above that
stands on more pages. Text in the class of its slot or of a slot above is on every page that has that slot:
it is the host's template. All other text of a slot is data.

The slot to extract is deduced from the classes too: of the slots that occur once on each of their pages (tuples;
slots that repeat on a page are sets), the deepest one that holds over half of the host's data, link text aside,
and all data headings of the highest level (so a title stays with its article).

Extraction drops the template's texts and, by name, what is never an article (menus, headers, footers, sidebars,
notices, adverts, forms, scripts, styles, reader comments). It keeps what is left inside the deduced slot; marks
(`article`, `main`, role main) break ties: a page that marks its article keeps the mark, which may be narrower or
wider than the slot. Pages without either keep all that is left but slots whose text is mostly links.

Sums are partial before they are shuffled, so a host with a third of all pages is no hot group. Small templates go to
the workers once, by host; beyond BROADCAST_BYTES each page's own tokens meet them in a join on (host, token), so no
row ever holds more of a template than its page does.

Defined cases: null or empty html gives the empty text; unclosed and misnested markup is closed as
browsers do for paragraphs, list items and cells; text of any length is kept; null urls form one host;
repeated rows get equal rows; the input's other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrymap.llm.common import materialize, texts_of, tidy

BROADCAST_BYTES = 8 << 20
DEPTH = 24
MIN_PAGES, LINK_SHARE, MAIN_SHARE = 4, 0.6, 0.5
SEEN = 8  # words that mark the contents of a token's pages
HELD = 100_000  # tokens a batch of partial sums

# Element and class names of HTML pages.
MARKS = frozenset("article main".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var".split())
NEVER = frozenset("head script style noscript template nav header footer aside form button select textarea iframe svg object canvas menu dialog".split())
NAMED = frozenset(
    "ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion menu nav navbar navigation breadcrumb breadcrumbs header masthead footer "
    "sidebar aside widget widgets related recommended comment comments disqus reply replies cookie cookies consent notice notices alert popup modal newsletter subscribe "
    "subscription signup login share sharing social form search pagination pager copyright legal disclaimer".split()
)
ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog".split())
MAIN_NAMED = frozenset("article articlebody content entry post story main".split())
CLOSED_BY = {
    "li": ("li", ("ul", "ol", "menu")), "dt": ("dt dd", ("dl",)), "dd": ("dt dd", ("dl",)), "tr": ("tr td th", ("table",)), "td": ("td th", ("tr", "table")), "th": ("td th", ("tr", "table")), "option": ("option", ("select",)),
}

TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<(script|style|textarea|title)\b(?:[^>"']|"[^"]*"|'[^']*')*+>.*?(?:</\1\s*>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|<[!?][^>]*>""", re.S | re.I)
ATTRIBUTE = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
NAME = re.compile(r"[^a-z]+")
LABEL = re.compile(r"[^a-z0-9]+|\d{3,}")  # long numbers are ids of pages, not of slots


class Block(NamedTuple):
    path: str
    text: str
    links: int
    named: bool  # in an element that is no article by its name
    main: bool  # in the page's marked article
    likely: bool  # in an element named like an article
    top: str  # path of the first DEPTH elements
    elements: tuple[int, ...]  # serial numbers of the elements of `path`


class Element(NamedTuple):
    tag: str
    label: str
    named: bool
    main: bool
    likely: bool
    link: bool  # a link, or within one
    serial: int = 0


def opened(tag: str, attributes: str, parent: Element | None) -> Element:
    named, main, likely, label = tag in NEVER, tag in MARKS, False, tag
    for key, a, b, c in ATTRIBUTE.findall(attributes) if attributes else ():
        value = (a or b or c).lower()
        names = set(NAME.split(value)) - {""}
        if key.lower() == "role":
            named |= bool(names & ROLES)
            main |= "main" in names
        else:
            # <body class="home has-sidebar"> and the like describe the page, not the element.
            named |= tag not in ("html", "body", "article", "main") and bool(names & NAMED) or tag == "article" and bool(names & {"comment", "comments"})
            likely |= bool(names & MAIN_NAMED)
            label += "." + "-".join(sorted(set((LABEL if key.lower() == "class" else NAME).split(value)) - {""}))
    if parent is not None:
        named, main, likely = named or parent.named, main or parent.main, likely or parent.likely
    return Element(tag, label, named, main, likely, tag == "a" or parent is not None and parent.link)


def slot_path(labels: list[str]) -> str:
    """Path of an element; of more than DEPTH labels the first ones are one label, their hash, so different slots keep different paths."""
    if len(labels) > DEPTH:
        labels = ["~" + xxhash.xxh64_hexdigest("/".join(labels[:-DEPTH])), *labels[-DEPTH:]]
    return "/".join(labels)


def blocks(page: str) -> list[Block]:
    """Text blocks of a page in order."""
    out: list[Block] = []
    stack: list[Element] = []
    parts: list[str] = []
    links = serial = 0

    def end() -> None:
        nonlocal links
        if parts:
            text = " ".join(entities.unescape("".join(parts)).split())
            if text:
                top = stack[-1] if stack else Element("", "", False, False, False, False)
                slots = [e for e in stack if e.tag not in INLINE]
                labels, serials = [e.label for e in slots], [e.serial for e in slots]
                elements = (*serials[-DEPTH - 1 : -DEPTH], *serials[-DEPTH:])
                out.append(Block(slot_path(labels), text, min(links, len(text)), top.named, top.main, top.likely, "/".join(labels[:DEPTH]), elements))
            parts.clear()
            links = 0

    at = 0
    for m in TAG.finditer(page):
        if m.start() > at:
            piece = page[at : m.start()]
            parts.append(piece)
            if stack and stack[-1].link:
                links += len(piece)
        at = m.end()
        tag = (m[3] or m[6] or "").lower()
        if not tag:
            continue
        if m[2] or m[5]:  # an end tag
            if tag in VOID or not any(e.tag == tag for e in stack):
                continue
            if tag not in INLINE:
                end()
            while stack.pop().tag != tag:
                pass
            continue
        if tag in VOID:
            if tag == "hr":
                end()
            else:
                parts.append(" ")
            continue
        if tag not in INLINE:
            end()
            names, bounds = CLOSED_BY.get(tag, ("", ()))
            names = names.split()
            for k in range(len(stack) - 1, -1, -1):
                if stack[k].tag == "p" or stack[k].tag in names:
                    del stack[k:]
                elif stack[k].tag not in INLINE and (not names or stack[k].tag in bounds):
                    break
        if tag == "body":
            stack[:] = [e for e in stack if e.tag == "html"]
        serial += 1
        stack.append(opened(tag, m[4] or m[7] or "", stack[-1] if stack else None)._replace(serial=serial))
    if at < len(page):
        parts.append(page[at:])
    end()
    return out


def text_token(path: str, text: str) -> str:
    """A text in a slot as a token; a slot itself is its path, which holds no line break."""
    return f"{path}\n{xxhash.xxh64_hexdigest(text.encode('utf-8', 'surrogatepass'))}"


def main_text(found: list[Block], template: frozenset[str] | set[str], main: str | None = None) -> str:
    """The article's blocks but the template's texts, joined; slots of links count only on pages without a marked article."""
    left = [b for b in found if not b.named]
    marked = any(b.main for b in left)
    if template:
        left = [b for b in left if text_token(b.path, b.text) not in template]
    if marked:
        return "\n".join(b.text for b in left if b.main)
    left = [b for b in left if b.path not in template]
    if main is not None and any(within(b.top, main) for b in left):
        left = [b for b in left if within(b.top, main)]
    elif any(b.likely for b in left):
        left = [b for b in left if b.likely]
    return "\n".join(b.text for b in left)


def within(path: str, slot: str) -> bool:
    return path == slot or path.startswith(slot + "/")


def mix(page: int) -> int:
    return page >> 8  # sums of 2**7 partial sums and more wrap alike


def content_of(found: list[Block]) -> int:
    """Hash of a page's own texts, as a bit in each of SEEN words: copies of one article differ in menus, link lists and adverts at most."""
    own = [b.text for b in found if not b.named and b.links < LINK_SHARE * len(b.text)]
    content = xxhash.xxh64_intdigest("\n".join(own).encode("utf-8", "surrogatepass"))
    return sum(1 << (64 * k + (content >> 6 * k & 63)) for k in range(SEEN))


def prefixes(path: str) -> list[str]:
    """The path and those above it."""
    parts = path.split("/")
    return ["/".join(parts[:n]) for n in range(len(parts), 0, -1)]


def page_tokens(found: list[Block]) -> dict[str, tuple[int, int, int]]:
    """Tokens of a page with their (elements, characters, characters of links): slots at any depth, and texts in slots."""
    elements: dict[str, set[int]] = {}
    sizes: dict[str, list[int]] = {}
    texts: dict[str, tuple[int, int, int]] = {}
    for x in found:
        for slot, serial in zip(prefixes(x.path), reversed(x.elements or (0,))):
            elements.setdefault(slot, set()).add(serial)
        size = sizes.setdefault(x.path, [0, 0])
        size[0] += len(x.text)
        size[1] += x.links
        token = text_token(x.path, x.text)
        n, chars, links = texts.get(token, (0, 0, 0))
        texts[token] = (n + 1, chars + len(x.text), links + x.links)
    return {slot: (len(some), *sizes.get(slot, (0, 0))) for slot, some in elements.items()} | texts


SEEN_COLUMNS = [f"seen{k}" for k in range(SEEN)]


def token_rows(df: DataFrame, html_col: str) -> DataFrame:
    """Partial sums per (host, token) and up to HELD tokens."""
    names = ["host", "token", "vector", "pages", "times", "chars", "links", *SEEN_COLUMNS]

    def rows(held: dict[tuple[str, str], list]) -> pa.RecordBatch:
        *columns, contents = zip(*held.values())
        seen = np.frombuffer(b"".join(c.to_bytes(8 * SEEN, "little") for c in contents), np.int64).reshape(-1, SEEN)
        arrays = [pa.array([k[0] for k in held], pa.string()), pa.array([k[1] for k in held], pa.string()), *(pa.array(c, pa.int64()) for c in columns), *(pa.array(seen[:, k]) for k in range(SEEN))]
        return pa.RecordBatch.from_arrays(arrays, names=names)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            held: dict[tuple[str, str], list] = {}
            for host, page in zip(b.column(0).to_pylist(), texts_of(b.column(1))):
                found = blocks(page)
                key, content = mix(xxhash.xxh64_intdigest(page.encode("utf-8", "surrogatepass"))), content_of(found)
                for token, sizes in page_tokens(found).items():
                    row = held.setdefault((host, token), [0, 0, 0, 0, 0, 0])
                    row[0] = (row[0] + key) & ((1 << 56) - 1)
                    row[1] += 1
                    for k, n in enumerate(sizes, 2):
                        row[k] += n
                    row[5] |= content
                if len(held) >= HELD:
                    yield rows(held)
                    held = {}
            if held:
                yield rows(held)

    return df.select("host", html_col).mapInArrow(tidy(run), "host string, token string, " + ", ".join(f"{c} long" for c in names[2:]))


def slots_above(path: str) -> Column:
    """The slot of a path and all slots above it, as `prefixes`."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))


def templates(df: DataFrame, html_col: str = "html") -> DataFrame:
    """(host, path, token, class, parent_class, pages, times, chars, links, boilerplate): tokens of the valid classes of every host, nested.

    `times` counts the elements of a slot, or how often a text stands in it, over all pages. A text is boilerplate
    if its class is that of its slot or of a slot above; `parent_class` is the class of the nearest slot that stands
    on more pages.
    """
    sizes = ("pages", "times", "chars", "links")
    found = token_rows(df, html_col).groupBy("host", "token").agg(
        F.sum(F.col("vector") % (1 << 40)).alias("vector"), *(F.sum(c).alias(c) for c in sizes), F.greatest(*(F.bit_count(F.bit_or(c)) for c in SEEN_COLUMNS)).alias("contents")
    )
    # Partial sums are cut at different pages for tokens of one class, so the sum is reduced again.
    valid = materialize(found.filter(F.col("contents") >= MIN_PAGES).withColumn("class", F.xxhash64(F.col("vector") % (1 << 40), "pages")).drop("contents", "vector"), "template-tokens")
    valid = valid.withColumn("path", F.substring_index("token", "\n", 1)).withColumn("is_text", F.col("token").contains("\n"))
    up = valid.filter(~F.col("is_text")).select("host", F.col("token").alias("up"), F.col("class").alias("up_class"), F.col("pages").alias("up_pages"))
    nested = valid.withColumn("up", F.explode(slots_above("path"))).join(up, ["host", "up"])
    wider = F.col("up_pages") > F.col("pages")
    out = nested.groupBy("host", "path", "token", "class", *sizes, "is_text").agg(
        F.bool_or(F.col("up_class") == F.col("class")).alias("same"), F.max_by(F.when(wider, F.col("up_class")), F.when(wider, F.length("up"))).alias("parent_class")
    )
    linked = (F.col("chars") > 0) & (F.col("links") >= LINK_SHARE * F.col("chars"))
    return out.select("host", "path", "token", "class", "parent_class", *sizes, F.when(F.col("is_text"), F.col("same")).otherwise(linked).alias("boilerplate"))


def main_slots(found: DataFrame) -> DataFrame:
    """(host, main): the slot that holds a host's article, from `templates`; hosts without such a slot have no row.

    Data of a slot are its characters less links and boilerplate texts. Slots that hold over MAIN_SHARE of a host's data
    lie within each other, so the longest path of them is the deepest.
    """
    single = F.col("times") == F.col("pages")
    slots = found.filter((F.col("token") == F.col("path")) & ~F.col("path").startswith("~"))
    fixed = found.filter((F.col("token") != F.col("path")) & F.col("boilerplate")).groupBy("host", "path").agg(F.sum(F.col("chars") - F.col("links")).alias("fixed"))
    level = F.regexp_extract("path", r"(?:^|/)h([1-6])(?:\.[^/]*)?$", 1)
    data = slots.filter(~F.col("boilerplate")).join(fixed, ["host", "path"], "left").withColumn("data", F.col("chars") - F.col("links") - F.coalesce("fixed", F.lit(0))).filter("data > 0")
    data = data.select("host", "path", "data", F.when(single & (level != ""), level.cast("int")).alias("level"))
    whole = data.groupBy("host").agg(F.sum("data").alias("all_data"), F.min("level").alias("title"))
    data = data.join(whole, "host").withColumn("heads", (F.coalesce(F.col("level") == F.col("title"), F.lit(False))).cast("int"))
    heads = data.groupBy("host").agg(F.sum("heads").alias("all_heads"))
    held = data.withColumn("slot", F.explode(slots_above("path"))).groupBy("host", "slot").agg(F.sum("data").alias("data"), F.sum("heads").alias("heads"), F.first("all_data").alias("all_data"))
    held = held.filter(F.col("data") > MAIN_SHARE * F.col("all_data")).join(heads, "host").filter("heads = all_heads")
    tuples = slots.filter(single).select("host", F.col("path").alias("slot"))
    return held.join(tuples, ["host", "slot"]).groupBy("host").agg(F.max_by("slot", F.length("slot")).alias("main"))


def own_templates(pages: DataFrame, found: DataFrame, html_col: str) -> DataFrame:
    """(__host, __page, __slots, __main): of a host's template, the tokens that a page has itself."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for host, key, page in zip(b.column(0), b.column(1), texts_of(b.column(2))):
                tokens = list(page_tokens(blocks(page)))
                yield pa.RecordBatch.from_arrays([pa.array([host.as_py()] * len(tokens), pa.string()), pa.array([key.as_py()] * len(tokens), pa.int64()), pa.array(tokens, pa.string())], names=["__host", "__page", "token"])

    rows = pages.select("__host", "__page", html_col).mapInArrow(tidy(run), "__host string, __page long, token string")
    hits = rows.join(found.withColumnRenamed("host", "__host"), ["__host", "token"])
    return hits.groupBy("__host", "__page").agg(F.collect_set(F.when(F.col("boilerplate"), F.col("token"))).alias("__slots"), F.max(F.when(F.col("main"), F.col("token"))).alias("__main"))


def extract_main_text(df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, url, text, n_chars) of every page."""
    pages = df.select(F.col(id_col), F.col(url_col), F.col(html_col), F.coalesce(F.lower(F.regexp_extract(url_col, r"^[A-Za-z][\w+.-]*://(?:[^/?#@]*@)?([^/:?#]*)", 1)), F.lit("")).alias("__host"))
    tokens = materialize(templates(pages.withColumnRenamed("__host", "host"), html_col), "templates")
    main = main_slots(tokens).select("host", F.col("main").alias("token"), F.lit(True).alias("main"))
    found = tokens.filter("boilerplate").select("host", "token", "boilerplate").join(main, ["host", "token"], "full")
    found = materialize(found.select("host", "token", F.coalesce("boilerplate", F.lit(False)).alias("boilerplate"), F.coalesce("main", F.lit(False)).alias("main")), "template")
    size = found.agg(F.sum(F.octet_length("host") + F.octet_length("token"))).first()[0] or 0
    hosts: dict[str, tuple[set[str], str | None]] = {}
    if size <= BROADCAST_BYTES:
        for r in found.collect():
            slots, slot = hosts.get(r["host"], (set(), None))
            if r["boilerplate"]:
                slots.add(r["token"])
            hosts[r["host"]] = slots, r["token"] if r["main"] else slot
        pages = pages.withColumns({"__slots": F.lit(None).cast("array<string>"), "__main": F.lit(None).cast("string")})
    else:
        pages = pages.withColumn("__page", F.xxhash64(html_col))
        pages = pages.join(own_templates(pages, found, html_col), ["__host", "__page"], "left")

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            texts = []
            for page, host, own, slot in zip(texts_of(b.column(2)), *(b.column(k).to_pylist() for k in (3, 4, 5))):
                slots, slot = hosts.get(host, (frozenset(own or ()), slot))
                texts.append(main_text(blocks(page), slots, slot))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[id_col, url_col, "text", "n_chars"])

    kind = df.schema[id_col].dataType.simpleString()
    return pages.select(id_col, url_col, html_col, "__host", "__slots", "__main").mapInArrow(tidy(run), f"{id_col} {kind}, {url_col} string, text string, n_chars long")

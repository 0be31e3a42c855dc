"""Main text of web pages by equivalence-class template deduction.

Tokens are elements, told apart by their path of tags with class and id, and whole text
nodes under their path.  The occurrence vector of a token lists its number of occurrences on
each page of its host; tokens with one vector form an equivalence class.  Vectors are never
built: the support, the total and an exclusive-or of hashes of (page, number) stand for
them, which add up over any split of the pages, so a host may hold any share of the rows.

A class is valid if its support is MIN_SHARE of the host's pages (and MIN_PAGES at least)
and it nests: the parent of each token belongs to a valid class that occurs wherever the
token does.  Valid classes nested into each other are the host's template; what a page holds
between template tokens are its slots, named by the deepest template element around them.

Text nodes of the template itself (the same words on the same place of the host's pages) are
boilerplate.  Inside an article or main element they must stand on MAIN_SHARE of the host's
pages, MAIN_PAGES at least, since copies of an article also share their words; and if nothing
else is left there, the page is such a copy and they stay.

What template text leaves is judged slot by slot, with names as tie-breakers: slots of
navigation, headers, footers, side bars, notices, adverts, forms and comments go by their
element or class names, for their words may change from page to page; if the page has an
article or main element, the slots outside it go as well, unless one of them holds OUTSIDE
times its text (then the element is a teaser beside the text proper); else slots that are
mostly links go.  What remains is the text, block by block.  Hosts with too few pages have no
template; there only the names are left.

Defined results: null or empty html, and pages without text, give the empty string with 0
characters; unclosed and stray tags are read as browsers do; repeated pages count as pages;
a null url belongs to the host ''; other columns are ignored; nothing is capped.
"""

from __future__ import annotations

import html as html_lib
import re
from collections.abc import Iterator
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpointed, slices, table

MIN_PAGES, MIN_SHARE = 3, 0.3
MAIN_PAGES, MAIN_SHARE = 5, 0.8
#: A slot outside the main element outweighs it from so many times its text, and from so many characters.
OUTSIDE, OUTSIDE_CHARS = 3, 200
#: Tokens (8 bytes) and hosts (100) of all templates up to this many bytes are broadcast; beyond, they are joined by host.
BROADCAST_BYTES = 32 << 20
#: (host, token) counts that a task holds before it hands them on.
HELD_TOKENS = 400_000

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("address article aside blockquote body br caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead title tr ul".split())
RAW = frozenset("script style noscript template textarea svg iframe object select button".split())
#: Elements that are no main text wherever they stand.
CHROME = frozenset("head title nav footer aside form menu dialog".split()) | RAW
CHROME_NAME = re.compile(r"(?:^|[\s_-])(?:ads?|advert\w*|sponsor\w*|banner|promo\w*|nav|navbar|navigation|menu|breadcrumbs?|footer|header|masthead|sidebar|side-bar|widget|cookies?|consent|gdpr|notice|alert|popup|modal|overlay|subscribe|newsletter|signup|login|share|sharing|social|related|recommended|comments?|replies|respond|disqus|pagination|pager|toolbar|skip)(?:$|[\s_-])", re.I)
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu".split())
MAIN = frozenset(("article", "main"))
CLOSES_P = BLOCK - frozenset("br body html head title option caption tbody td tfoot th thead tr li dd dt".split())
LEXER = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(?P<cdata>.*?)\]\]>|<(?P<raw>script|style|noscript|template|textarea|svg|iframe|object|select|button)\b(?>[^>\"']+|\"[^\"]*\"|'[^']*'|[\"'])*>.*?(?:</(?P=raw)\s*>|\Z)|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?>[^>\"']+|\"[^\"]*\"|'[^']*'|[\"'])*)>|<[!?][^>]*>", re.S | re.I)
ATTRIBUTE = re.compile(r"""\b(class|id|role|hidden|aria-hidden)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
SPACE = re.compile(r"\s+")


def hash64(*parts) -> int:
    return int.from_bytes(blake2b("\x1f".join(map(str, parts)).encode("utf-8", "replace"), digest_size=8).digest(), "big", signed=True)


class Element:
    """Tag with its names; equal elements under equal parents are one object."""

    __slots__ = ("children", "chrome", "link", "main", "parent", "path", "tag", "texts")

    def __init__(self, tag: str, names: str, role: str, hidden: bool, parent: Element | None):
        self.tag, self.parent = tag, parent
        self.path = hash64(parent.path if parent else 0, tag, names)
        inherited_main = bool(parent and parent.main)
        self.main = inherited_main or tag in MAIN or role == "main"
        own = tag in CHROME or hidden or role in ROLES or (tag == "header" and not inherited_main) or bool(names and tag not in ("html", "body", "article", "main") and CHROME_NAME.search(names))
        self.chrome = own or bool(parent and parent.chrome)
        self.link = tag == "a" or bool(parent and parent.link)
        self.children: dict[tuple, Element] = {}
        self.texts: dict[str, int] = {}


class Parser:
    """Walks pages; elements are shared between the pages of a task."""

    def __init__(self):
        self.root = Element("", "", "", False, None)
        self.made = 0

    def child(self, parent: Element, tag: str, attrs: str) -> Element:
        key = (tag, attrs) if "class" in attrs or "id" in attrs or "role" in attrs or "hidden" in attrs.lower() else (tag, "")
        found = parent.children.get(key)
        if found is None:
            values = {m[1].lower(): (m[2] or "").strip("\"'") for m in ATTRIBUTE.finditer(key[1])}
            names = SPACE.sub(" ", f"{values.get('class', '')} {values.get('id', '')}".strip())
            hidden = "hidden" in values or values.get("aria-hidden", "").lower() == "true"
            found = Element(tag, re.sub(r"\d+", "0", names), values.get("role", "").lower(), hidden, parent)
            if self.made > 50_000:
                return found  # not shared any more: memory stays bounded
            parent.children[key] = found
            self.made += 1
        return found

    def walk(self, source: str) -> Iterator[tuple[str, Element, str]]:
        """('open', element, ''), ('text', element, raw text), ('break', element, '') in page order."""
        here, at, depth = self.root, 0, 0
        for m in LEXER.finditer(source):
            if m.start() > at:
                yield "text", here, source[at : m.start()]
            at = m.end()
            tag = m["tag"]
            if tag is None:
                if m["cdata"]:
                    yield "text", here, m["cdata"]
                continue
            tag = tag.lower()
            if m["end"]:
                up = here
                while up.parent is not None and up.tag != tag:
                    up = up.parent
                if up.parent is not None:
                    here = up.parent
                if tag in BLOCK:
                    yield "break", here, ""
                continue
            if tag in VOID:
                if tag in BLOCK:
                    yield "break", here, ""
                continue
            here = self._implied(here, tag)
            here = self.child(here, tag, m["attrs"])
            yield "open", here, ""
            if tag in BLOCK:
                yield "break", here, ""
        if at < len(source):
            yield "text", here, source[at:]

    @staticmethod
    def _implied(here: Element, tag: str) -> Element:
        """The element that ``tag`` opens in, after the ends that it implies."""
        closes, stop = (("p",), ("button", "table", "td", "th")) if tag in CLOSES_P else ((tag,), ("ul", "ol", "menu")) if tag == "li" else (("dd", "dt"), ("dl",)) if tag in ("dd", "dt") else ((tag, "th", "td") if tag in ("td", "th") else ("tr", "td", "th"), ("table",)) if tag in ("td", "th", "tr") else (("option",), ("select",)) if tag == "option" else ((), ())
        if tag == "body":
            closes, stop = ("head",), ()
        up, target = here, None
        while up.parent is not None and up.tag not in stop:
            if up.tag in closes:
                target = up.parent
            up = up.parent
        return target or here


def tidy(raw: str) -> str:
    return SPACE.sub(" ", html_lib.unescape(raw) if "&" in raw else raw)


def token_counts(pages: DataFrame) -> DataFrame:
    """host, token, parent, main (text in a main element), support, total, vector: occurrence figures of every token on a host's pages."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parser, held = Parser(), {}

        def out() -> pa.RecordBatch:
            keys, values = list(held), list(held.values())
            held.clear()
            columns = [pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.int64()), *[pa.array([v[i] for v in values], pa.int64()) for i in range(4)], pa.array([v[4] for v in values], pa.bool_())]
            return pa.RecordBatch.from_arrays(columns, names=["host", "token", "parent", "support", "total", "vector", "main"])

        for batch in batches:
            for piece in slices(batch, "html"):
                for page, host, source in zip(*(piece.column(c).to_pylist() for c in ("page", "host", "html"))):
                    seen: dict[int, list] = {}
                    for kind, element, raw in parser.walk(source or ""):
                        if kind == "open":
                            token, parent, main = element.path, element.parent.path, False
                        elif kind == "text" and (text := tidy(raw).strip()):
                            token, parent, main = hash64(element.path, text), element.path, element.main
                        else:
                            continue
                        entry = seen.get(token)
                        if entry is None:
                            seen[token] = [parent, 1, main]
                        else:
                            entry[1] += 1
                    for token, (parent, n, main) in seen.items():
                        v = held.get((host, token))
                        h = hash64(page, n)
                        if v is None:
                            held[host, token] = [parent, 1, n, h, main]
                        else:
                            v[1] += 1
                            v[2] += n
                            v[3] ^= h
                    if len(held) > HELD_TOKENS:
                        yield out()
        if held:
            yield out()

    partial = pages.mapInArrow(run, "host string, token long, parent long, support long, total long, vector long, main boolean")
    return partial.groupBy("host", "token").agg(F.min("parent").alias("parent"), F.max("main").alias("main"), F.sum("support").alias("support"), F.sum("total").alias("total"), F.bit_xor("vector").alias("vector"))


def templates(counts: DataFrame, sizes: DataFrame) -> DataFrame:
    """host and the tokens of its template: valid classes, nested.  Tokens that pass the support bound are few on a host."""
    enough = (F.col("support") >= F.when(F.col("main"), MAIN_PAGES).otherwise(MIN_PAGES)) & (F.col("support") >= F.when(F.col("main"), MAIN_SHARE).otherwise(MIN_SHARE) * F.col("pages"))
    frequent = counts.where(F.col("support") >= MIN_PAGES).join(sizes, "host").where(enough)
    by_host = frequent.groupBy("host").agg(F.collect_list(F.struct("token", "parent", "support", "total", "vector")).alias("tokens"))

    def nest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        root = Parser().root.path
        for batch in batches:
            kept = []
            for tokens in batch.column("tokens").to_pylist():
                support = {t["token"]: t["support"] for t in tokens} | {root: 1 << 62}
                # the class of a token, its parent's class around it: a token is valid with all tokens of its class
                bad = {(t["support"], t["total"], t["vector"]) for t in tokens if support.get(t["parent"], -1) < t["support"]}
                valid = {root}
                grown = True
                rest = [t for t in tokens if (t["support"], t["total"], t["vector"]) not in bad]
                while grown:
                    new = [t for t in rest if t["parent"] in valid]
                    rest = [t for t in rest if t["parent"] not in valid]
                    valid.update(t["token"] for t in new)
                    grown = bool(new)
                kept.append(sorted(valid - {root}))
            yield pa.RecordBatch.from_arrays([batch.column("host"), pa.array(kept, pa.list_(pa.int64()))], names=["host", "template"])

    return by_host.mapInArrow(nest, "host string, template array<long>")


def main_text(parser: Parser, source: str, template: frozenset[int]) -> str:
    """Text of the slots that remain, one line for each block."""
    slots: dict[int, list[int]] = {}
    nodes: list[tuple[str, Element | None, int, bool]] = []
    has_main, in_main, outside = False, 0, {}
    for kind, element, raw in parser.walk(source):
        if kind == "open":
            has_main = has_main or (element.main and not element.chrome)
            continue
        if kind == "break":
            nodes.append(("", None, 0, False))
            continue
        if element.chrome:
            continue
        text = tidy(raw)
        bare = text.strip()
        fixed = bool(template and bare) and hash64(element.path, bare) in template
        if fixed and not element.main:
            continue
        around = element
        while template and around.parent is not None and around.path not in template:
            around = around.parent
        slot = around.path
        if not fixed:
            slots.setdefault(slot, [0, 0])[element.link] += len(bare)
            if element.main:
                in_main += len(bare)
            elif not element.link:
                outside[slot] = outside.get(slot, 0) + len(bare)
        nodes.append((text, element, slot, fixed))
    whole = has_main and not in_main
    if has_main and not whole and max(outside.values(), default=0) >= max(OUTSIDE_CHARS, OUTSIDE * in_main):
        has_main = False
    blocks, line = [], []
    for text, element, slot, fixed in [*nodes, ("", None, 0, False)]:
        if element is None:
            if (joined := SPACE.sub(" ", "".join(line)).strip()):
                blocks.append(joined)
            line = []
        elif fixed and not whole:
            continue
        elif element.main if has_main else slots[slot][1] <= slots[slot][0]:
            line.append(text)
    return "\n".join(blocks)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every row of (page_id, url, html)."""
    host = F.lower(F.coalesce(F.regexp_extract("url", r"^\w+://(?:[^/@?#]*@)?([^/:?#]*)", 1), F.lit("")))
    rows = pages.select("page_id", "url", "html", host.alias("host"))
    counts = token_counts(rows.select(F.xxhash64("page_id", "url").alias("page"), "host", "html"))
    sizes = rows.groupBy("host").agg(F.count("*").alias("pages"))
    found = checkpointed(templates(counts, sizes))
    size = found.agg(F.coalesce(F.sum(100 + 8 * F.size("template")), F.lit(0))).first()[0]
    with_template = rows.join(F.broadcast(found) if size <= BROADCAST_BYTES else found, "host", "left")
    id_type = pages.schema["page_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parser, known = Parser(), {}
        for batch in batches:
            for piece in slices(batch, "html"):
                texts = []
                for name, tokens, source in zip(piece.column("host").to_pylist(), piece.column("template"), piece.column("html").to_pylist()):
                    if name not in known:
                        if len(known) > 1000:
                            known.clear()
                        known[name] = frozenset(tokens.as_py() or ())
                    texts.append(main_text(parser, source or "", known[name]))
                yield pa.RecordBatch.from_arrays([piece.column("page_id"), piece.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return with_template.select("page_id", "url", "host", "template", "html").mapInArrow(run, f"page_id {id_type}, url string, text string, n_chars long")


def op7_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages").select(F.col("page_id").cast("long").alias("page_id"), "url", "html"))

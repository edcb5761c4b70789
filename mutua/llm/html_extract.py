"""Main text of web pages by tree scoring.

A page becomes a tree of elements; scripts, styles, comments and other raw text are
skipped by the tokenizer. Boilerplate is cut first: by element (navigation, forms,
page headers and footers, asides outside the article), by role, and by words of class and
id on containers; headings, code and inline elements are never cut by words. Paragraphs
then pass points for their length and commas to their ancestors, less with each level up;
a container's points are discounted by the share of its text that is inside links. The
best container is kept, widened to the article or main element around it, together with
siblings, its own and its parent's, that hold paragraphs. Its blocks are joined in page order.

Character references are decoded in each piece of text between tags; white space within a
block is one space; blocks are joined by an empty line.

Defined cases: a null or empty page, or one without text, gives an empty text; unclosed
and misnested tags are closed as browsers do for paragraphs and list items; repeated
rows give repeated results; an empty table gives an empty table; other columns are
ignored. Time is linear in the page, but for the depth of nesting, and nothing is cut from long
pages.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mutua.storage import table

QUERY = "op8_html"
ORACLE_SQL = None  # a tree has no SQL form; tests use pages whose articles are known

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title template iframe noembed noframes xmp svg canvas".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
INLINE = frozenset("a abbr b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var".split())
#: What an opening tag closes, up to the nearest element of the second set.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
}
PARAGRAPHS = frozenset("p pre blockquote td dd li".split())
CUT_TAGS = frozenset("nav form footer menu dialog button select label fieldset head".split())
CUT_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
#: Elements that words of class and id may cut.
CUTTABLE = frozenset("div section aside ul ol dl table header footer p center details iframe address".split())
CUT_WORDS = frozenset(
    """ad ads advert adverts advertisement advertising adsense adslot sponsor sponsored promo promotion
    nav navbar navigation submenu breadcrumb breadcrumbs sidebar widget widgets toolbar pagination pager
    topbar bottombar cookie cookies consent gdpr notice popup modal overlay menu footer
    subscribe subscription newsletter signup login share sharing social related recommended recommendations popular trending taglist""".split()
)
#: Words that cut outside of articles only.
OUTSIDE_WORDS = frozenset("banner aside rail header masthead copyright legal colophon alert tags form search skip".split())
COMMENT_WORDS = frozenset("comment comments commentlist commentary disqus replies reply respond responses discussion".split())
KEEP_TAGS = frozenset("article main body html".split())
BODY_WORDS = frozenset("article content entry post story text body main".split())
MIN_PARAGRAPH = 25
#: Points of a sibling that is kept, and a fifth of the best container's.
MIN_SIBLING = 2.0

# A quotation mark opens a value only after an equals sign.
_TOKEN = re.compile(r"<(?:!--.*?(?:-->|$)|[!?][^>]*(?:>|$)|/([A-Za-z][^\s/>]*)[^>]*(?:>|$)|([A-Za-z][^\s/>]*)((?:=\s*+(?:\"[^\"]*\"|'[^']*'|[^\s\"'>][^\s>]*)?|[^>=])*+)(?:>|$))", re.S)
_ATTR = re.compile(r"([^\s=>\"'/]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>][^\s>]*)))?")
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


class Node:
    __slots__ = ("tag", "attrs", "parent", "children", "text", "linked", "commas", "points", "peak", "kinds", "cut")

    def __init__(self, tag: str, attrs: str, parent: Node | None) -> None:
        self.tag, self.attrs, self.parent = tag, attrs, parent
        self.children: list[Node | str] = []
        self.text = self.linked = self.commas = 0
        self.points = self.peak = 0.0
        self.kinds: frozenset[str] = frozenset()
        self.cut = False


def tokens(page: str) -> Iterator[tuple[str, str, str]]:
    """("text", text, ""), ("open", tag, attributes) and ("close", tag, "") in page order; raw text is skipped."""
    at, end = 0, len(page)
    while at < end:
        less = page.find("<", at)
        if less < 0:
            yield "text", page[at:], ""
            return
        if less > at:
            yield "text", page[at:less], ""
        m = _TOKEN.match(page, less)
        if not m:
            yield "text", "<", ""
            at = less + 1
            continue
        at = m.end()
        if m[1]:
            yield "close", m[1].lower(), ""
        elif m[2]:
            tag = m[2].lower()
            if tag in RAW and not m[3].endswith("/"):
                close = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>?", re.I).search(page, at)
                at = close.end() if close else (end if tag in ("script", "style") else at)
            else:
                yield "open", tag, m[3]


def parse(page: str) -> Node:
    root = Node("html", "", None)
    stack, opened = [root], Counter({"html": 1})

    def pop_to(k: int) -> None:
        for n in stack[k:]:
            opened[n.tag] -= 1
        del stack[k:]

    def close_first(tags: set[str], stop: set[str]) -> None:
        for k in range(len(stack) - 1, 0, -1):
            if stack[k].tag in tags:
                pop_to(k)
                return
            if stack[k].tag in stop:
                return

    for kind, tag, attrs in tokens(page):
        if kind == "text":
            stack[-1].children.append(tag)
        elif kind == "open":
            if tag == "html" or tag == "body" and opened["body"]:
                continue
            if tag in BLOCKS and opened["p"]:
                close_first({"p"}, BLOCKS - {"p"})
            if tag in CLOSES and sum(opened[t] for t in CLOSES[tag][0]):
                close_first(*CLOSES[tag])
            if tag in ("a", "button") and opened[tag]:
                close_first({tag}, BLOCKS)
            node = Node(tag, attrs, stack[-1])
            stack[-1].children.append(node)
            if tag not in VOID and not (attrs.endswith("/") and tag not in BLOCKS and tag not in INLINE):
                stack.append(node)
                opened[tag] += 1
        elif opened[tag]:
            fence = BLOCKS if tag in INLINE else frozenset({"td", "th", "table", "body"}) if tag == "p" else frozenset()
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == tag:
                    pop_to(k)
                    break
                if stack[k].tag in fence:
                    break
    return root


def _in_order(root: Node) -> list[Node]:
    """Every element, parents before children."""
    out, todo = [], [root]
    while todo:
        n = todo.pop()
        out.append(n)
        todo += [c for c in reversed(n.children) if not isinstance(c, str)]
    return out


def _measure(nodes: list[Node]) -> None:
    """Length, linked length, commas and the element kinds below, without what is cut."""
    for n in reversed(nodes):
        n.text = n.linked = n.commas = 0
        kinds = set()
        for c in n.children:
            if isinstance(c, str):
                n.text += len(" ".join(c.split()))
                n.commas += c.count(",")
            elif not c.cut:
                n.text += c.text
                n.linked += c.linked
                n.commas += c.commas
                kinds |= c.kinds & _MARKS | ({c.tag} & _MARKS)
        n.kinds = frozenset(kinds)
        if n.tag == "a":
            n.linked = n.text


_MARKS = frozenset({"article", "main", "h1", "p"})


def _attributes(n: Node) -> dict[str, str]:
    return {m[1].lower(): next((x for x in m.groups()[1:] if x is not None), "") for m in _ATTR.finditer(n.attrs)} if n.attrs else {}


def _cut(nodes: list[Node]) -> None:
    """Marks boilerplate."""
    total = max(1, nodes[0].text)
    inside: set[int] = set()  # elements within an article
    for n in nodes:
        p = n.parent
        if p is not None and (id(p) in inside or p.tag in ("article", "main")):
            inside.add(id(n))
        if n.tag in ("html", "body"):
            continue
        if n.tag in ("aside", "noscript") and id(n) not in inside:
            n.cut = not n.kinds & {"article", "main"}
            continue
        if n.tag in CUT_TAGS or n.tag == "header" and id(n) not in inside and not n.kinds & {"article", "main"}:
            n.cut = not (n.tag == "form" and n.text > 0.5 * total and n.kinds & {"p", "article"})
            continue
        if not n.attrs:
            continue
        attrs = _attributes(n)
        if "hidden" in attrs or attrs.get("aria-hidden") == "true" or _HIDDEN.search(attrs.get("style", "")):
            n.cut = True
        elif attrs.get("role", "").lower() in CUT_ROLES:
            n.cut = not n.kinds & {"article", "main"}
        elif n.tag in CUTTABLE:
            words = {w.lower() for w in _WORDS.findall(attrs.get("class", "") + " " + attrs.get("id", ""))}
            if words & COMMENT_WORDS:
                n.cut = "h1" not in n.kinds and not n.kinds & {"main"}
            elif words & CUT_WORDS or words & OUTSIDE_WORDS and id(n) not in inside:
                n.cut = not n.kinds & {"article", "main"} and not (n.text > 0.5 * total and ("p" in n.kinds or words & BODY_WORDS))


def _density(n: Node) -> float:
    return n.linked / n.text if n.text else 0.0


def _score(nodes: list[Node]) -> None:
    for n in nodes:
        own = sum(len(c.split()) and len(" ".join(c.split())) for c in n.children if isinstance(c, str)) if n.tag not in PARAGRAPHS else n.text
        is_paragraph = n.tag in PARAGRAPHS and not n.kinds & {"p"} or n.tag in ("div", "section", "article", "main") and own >= MIN_PARAGRAPH
        if not is_paragraph or own < MIN_PARAGRAPH:
            continue
        points = (1 + n.commas + min(own / 100, 3)) * (1 - _density(n))
        holder, level = (n.parent if n.tag in PARAGRAPHS else n), 0
        while holder is not None and level < 6:
            holder.points += points / (1, 2, 6, 9, 12, 15)[level]
            holder, level = holder.parent, level + 1
    for n in reversed(nodes):
        n.peak = max([n.points * (1 - _density(n)), *(c.peak for c in n.children if not isinstance(c, str) and not c.cut)])


def _visible(root: Node) -> list[Node]:
    out, todo = [], [root]
    while todo:
        n = todo.pop()
        if n.cut:
            continue
        out.append(n)
        todo += [c for c in reversed(n.children) if not isinstance(c, str)]
    return out


def best_parts(root: Node) -> list[Node]:
    """The best container, widened to its article, and the siblings kept with it, in page order."""
    nodes = _in_order(root)
    _measure(nodes)
    _cut(nodes)
    nodes = _visible(root)
    _measure(nodes)
    _score(nodes)
    holders = [n for n in nodes if n.tag not in INLINE and n.tag not in ("p", "tr", "td", "li", "ul", "ol")]
    final = lambda n: n.points * (1 - _density(n))
    best = max(holders, key=final, default=None)
    if best is None or final(best) <= 0:
        named = [n for n in nodes if n.tag in ("article", "main") and n.text]
        return [max(named, key=lambda n: n.text - n.linked)] if named else [n for n in nodes if n.tag == "body" and n.text > n.linked][:1]
    around = best
    while around is not None and around.tag not in ("article", "main"):
        around = around.parent
    if around is not None:
        while around.parent is not None and any(p.tag == "article" for p in _ancestors(around)):
            around = next(p for p in _ancestors(around) if p.tag == "article")
        return [around]
    if best.parent is None or best.tag in ("html", "body"):
        return [best]
    least = max(MIN_SIBLING, 0.2 * final(best))
    kept = _with_siblings(best, [best], least)
    up = best.parent
    return _with_siblings(up, kept, least) if up.parent is not None and up.tag not in ("html", "body") else kept


def _with_siblings(n: Node, kept: list[Node], least: float) -> list[Node]:
    """``kept``, which stands for ``n``, and the siblings of ``n`` that hold text, in page order."""
    out: list[Node] = []
    for c in n.parent.children:
        if c is n:
            out += kept
        elif not isinstance(c, str) and not c.cut:
            paragraph = c.tag in PARAGRAPHS and c.text and _density(c) < (0.25 if c.text > 80 else 0.01)
            heading = c.tag in ("h1", "h2", "h3") and _density(c) < 0.25 and c.text > 0
            if c.peak >= least and _density(c) < 0.5 or paragraph or heading:
                out.append(c)
    return out


def _ancestors(n: Node) -> Iterator[Node]:
    while n.parent is not None:
        n = n.parent
        yield n


def block_texts(parts: list[Node]) -> list[str]:
    out: list[str] = []
    now: list[str] = []

    def flush() -> None:
        text = " ".join("".join(now).split())
        if text:
            out.append(text)
        now.clear()

    todo: list[Node | str | None] = [x for p in reversed(parts) for x in (None, p)]
    while todo:
        x = todo.pop()
        if x is None:
            flush()
        elif isinstance(x, str):
            now.append(html.unescape(x))
        elif not x.cut:
            if x.tag == "br":
                now.append(" ")
            if x.tag in BLOCKS:
                flush()
                todo.append(None)
            todo += reversed(x.children)
    flush()
    return out


def main_text(page: str | None) -> str:
    return "\n\n".join(block_texts(best_parts(parse(page)))) if page else ""


def _extract_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [main_text(p) for p in batch.column(batch.num_columns - 1).to_pylist()]
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(texts, pa.string())], names=[*batch.schema.names[:-1], "text"])


def extract(pages: DataFrame) -> DataFrame:
    """``page_id``, ``url`` and the main ``text`` of every row."""
    kept = pages.select("page_id", F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return kept.mapInArrow(_extract_batches, f"page_id {kept.schema['page_id'].dataType.simpleString()}, url string, text string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))

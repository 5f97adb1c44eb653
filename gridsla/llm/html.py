"""Main text of web pages by minimum-cut labelling of blocks."""

from __future__ import annotations

import re
from collections import Counter, deque
from collections.abc import Iterator
from html.parser import HTMLParser
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridsla.llm.common import table

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SKIP = frozenset("head script style noscript template textarea select option svg math iframe object canvas audio video title".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp "
                   "small span strike strong sub sup time tt u var img wbr nobr center".split()) - {"center"}
CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
SCOPE = frozenset("ul ol dl table article section div main body nav aside footer header form".split())
AWAY_TAGS = frozenset("nav footer aside button dialog menu".split())
DOUBT_TAGS = frozenset("form fieldset header".split())  # like a name word
AWAY_ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog menu menubar toolbar".split())
# fixed words of class and id names
AWAY_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising banner sponsor sponsored promo promotion sidebar side rail menu nav "
    "navbar navigation breadcrumb breadcrumbs pagination pager header masthead topbar footer comment comments reply replies "
    "respond disqus cookie cookies consent gdpr notice notices notification alert popup modal overlay newsletter subscribe "
    "subscription signup login register search share sharing social related recommended widget toolbar copyright legal "
    "disclaimer skip hidden form".split())
MAIN_WORDS = frozenset("article content main post entry story body text".split())
_NAME = re.compile(r"[A-Za-z][a-z]*|[A-Z]+")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_STOPS = re.compile(r"[.!?:;…](?:\s|$)")


# what an element says of the text inside
GONE, MAIN, ARTICLE, NAMED, PLAIN = "gone", "main", "article", "named", "plain"
HEAD_TAGS = frozenset("head title meta link style script base noscript template".split())  # any other tag ends the head
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())


class Mark(NamedTuple):
    """An element that says something of its text, with what the marked elements around it say."""
    kind: str
    words: frozenset[str]
    around: int  # the next marked element outwards; 0 is the page
    gone: bool  # this element or one around it holds no main text
    named: frozenset[str]  # words of this element and those around it, articles left out
    every: frozenset[str]  # and with them
    main: bool  # this element or one around it is said to hold main text


class Block(NamedTuple):
    text: str
    element: int  # the block-level element around
    mark: int
    heading: bool
    link_chars: int


PAGE = Mark(PLAIN, frozenset(), 0, False, frozenset(), frozenset(), False)


def _mark(tag: str, attrs: dict[str, str | None]) -> tuple[str, frozenset[str]]:
    """Whether an element holds no main text at all or is said to hold it; words that speak against it."""
    if tag in ("html", "body"):
        return PLAIN, frozenset()
    if tag in AWAY_TAGS or "hidden" in attrs or attrs.get("aria-hidden") == "true" or _HIDDEN.search(attrs.get("style") or ""):
        return GONE, frozenset()
    role = (attrs.get("role") or "").lower()
    if role in AWAY_ROLES:
        return GONE, frozenset()
    words = {w.lower() for w in _NAME.findall(f"{attrs.get('class') or ''} {attrs.get('id') or ''}")}
    away = frozenset(words & AWAY_WORDS)
    if tag == "main" or role == "main":
        return MAIN, frozenset()
    if tag == "article" or role == "article":
        return ARTICLE, away
    if tag in DOUBT_TAGS:
        away |= {f"<{tag}>"}
    return NAMED if words & MAIN_WORDS and tag in ("div", "section", "td") else PLAIN, away


def natures(blocks: list[Block], marks: list[Mark]) -> list[int]:
    """Of each block: 1 in main text by its elements, 0 unknown, -1 under a doubtful name, -2 in no main text.

    The nearest mark counts. A name word under which half of the page's prose (blocks of ten words or more)
    lies names a wrapper and is ignored, unless elements of main text hold text outside it, a tenth as long or
    more. An article in a doubtful element is believed when a quarter of the prose lies in it.
    """
    prose = [max(0, len(b.text) - b.link_chars) if b.text.count(" ") >= 9 and not marks[b.mark].gone else 0 for b in blocks]
    whole, under, inside = sum(prose), {}, [0] * len(marks)
    for n, b in zip(prose, blocks):
        for w in marks[b.mark].named:
            under[w] = under.get(w, 0) + n
        inside[b.mark] += n
    for k in range(len(marks) - 1, 0, -1):  # marks are numbered from the outside in
        inside[marks[k].around] += inside[k]

    def judged(ignored: frozenset[str]) -> list[int]:
        out = [0] * len(marks)
        for k, m in enumerate(marks[1:], 1):
            now = out[m.around]
            if m.gone:
                now = -2
            elif m.kind == MAIN or m.kind == ARTICLE and (now >= 0 or not m.words - ignored and 0 < whole <= 4 * inside[k]):
                now = 1
            elif m.kind != ARTICLE and m.words - ignored:
                now = -1
            elif m.kind == NAMED and now >= 0:
                now = 1
            out[k] = now
        return out

    first = judged(frozenset())
    sure = [len(b.text) - b.link_chars if first[b.mark] > 0 else 0 for b in blocks]
    ignored = set()
    for w, n in under.items():
        if 0 < whole <= 2 * n:
            outside = sum(s for s, b in zip(sure, blocks) if w not in marks[b.mark].every)
            if 10 * outside <= n:
                ignored.add(w)
    final = judged(frozenset(ignored))
    return [final[b.mark] for b in blocks]


class Blocks(HTMLParser):
    """Blocks of a page, with the elements and marks around them; linear in the page, however deep it is.

    Open elements are kept on a stack with the cases where HTML closes them without an end tag.
    """

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.stack: list[tuple[str, int, int]] = []  # tag, block-level element and mark that hold inside
        self.open: Counter[str] = Counter()
        self.parent, self.depth = [0], [0]  # of block-level elements; 0 is the page
        self.marks = [PAGE]
        self.blocks: list[Block] = []
        self.parts: list[str] = []
        self.skipped = self.links = self.headings = self.link_chars = 0

    def flush(self) -> None:
        text = " ".join("".join(self.parts).split())
        if text:
            _, element, mark = self.stack[-1] if self.stack else ("", 0, 0)
            self.blocks.append(Block(text, element, mark, self.headings > 0, self.link_chars))
        self.parts, self.link_chars = [], 0

    def _pop(self, depth: int) -> None:
        for tag, _, _ in self.stack[depth:]:
            self.open[tag] -= 1
            self.skipped -= tag in SKIP
            self.links -= tag == "a"
            self.headings -= tag in HEADINGS
        del self.stack[depth:]

    def _end_head(self) -> None:
        if self.stack and self.stack[-1][0] == "head":
            self._pop(len(self.stack) - 1)

    def handle_starttag(self, tag, attrs):
        if tag not in HEAD_TAGS:
            self._end_head()
        if tag == "br":
            self.parts.append(" ")
            return
        if tag not in INLINE:
            self.flush()
            closes = CLOSED_BY.get(tag, frozenset({"p"})) | {"p"}
            if any(self.open[t] for t in closes):
                for at in range(len(self.stack) - 1, -1, -1):
                    if self.stack[at][0] in closes:
                        self._pop(at)
                    elif self.stack[at][0] in SCOPE:
                        break
            if tag == "body" and self.open["head"]:
                self._pop(next(i for i, s in enumerate(self.stack) if s[0] == "head"))
        if tag in VOID:
            return
        _, element, mark = self.stack[-1] if self.stack else ("", 0, 0)
        kind, words = _mark(tag, dict(attrs))
        around = self.marks[mark]
        if tag == "header" and around.main:  # the title of an article
            words -= {"<header>", "header"}
        if kind != PLAIN or words:
            named = around.named if kind == ARTICLE else around.named | words
            self.marks.append(Mark(kind, words, mark, around.gone or kind == GONE, named, around.every | words,
                                   around.main or kind in (MAIN, ARTICLE, NAMED)))
            mark = len(self.marks) - 1
        if tag not in INLINE:
            self.parent.append(element)
            self.depth.append(self.depth[element] + 1)
            element = len(self.parent) - 1
        self.stack.append((tag, element, mark))
        self.open[tag] += 1
        self.skipped += tag in SKIP
        self.links += tag == "a"
        self.headings += tag in HEADINGS

    def handle_endtag(self, tag):
        if tag not in INLINE:
            self.flush()
        if self.open[tag]:
            self._pop(next(i for i in range(len(self.stack) - 1, -1, -1) if self.stack[i][0] == tag))

    def handle_data(self, data):
        if self.skipped and not data.isspace():
            self._end_head()
        if not self.skipped:
            self.parts.append(data)
            if self.links:
                self.link_chars += len(data)

    def apart(self, a: int, b: int) -> int:
        """Steps between two block-level elements in the tree."""
        steps = 0
        while a != b:
            if self.depth[a] < self.depth[b]:
                a, b = b, a
            a = self.parent[a]
            steps += 1
        return steps

    def parse_html_declaration(self, i):
        """``<![...`` is a comment up to the next ``>`` as in HTML (in svg and math CDATA ends at ``]]>``).

        The standard library raises an error for it unless a known keyword follows.
        """
        if not self.rawdata.startswith("<![", i):
            return super().parse_html_declaration(i)
        if self.rawdata.startswith("<![CDATA[", i) and any(t in ("svg", "math") for t, _, _ in self.stack):
            end = self.rawdata.find("]]>", i)
            return end + 3 if end >= 0 else -1
        return self.parse_bogus_comment(i)

    def of(self, html: str) -> list[Block]:
        self.feed(html)
        self.close()
        self.flush()
        return self.blocks


def classifier_cost(text: str, nature: int, heading: bool, link_chars: int) -> float:
    """Evidence that a block is main text (positive) or boilerplate (negative)."""
    if nature < -1:
        return -40.0
    words = text.count(" ") + 1
    score = {1: 4.0, 0: -0.5, -1: -5.5}[nature]  # long prose under a doubtful name comes near 0
    score += min(words, 40) / 10 - 0.8
    score += 0.7 * min(3, len(_STOPS.findall(text)))
    score -= 5.0 * min(1.0, link_chars / len(text))
    return score + (1.0 if heading else 0.0)


def max_flow_labels(costs: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Blocks on the source side of a minimum cut (main text).

    A block's positive cost is its capacity from the source, a negative one that to the sink; smoothness
    edges work both ways. Dinic's algorithm with iterative searches.
    """
    n, s, t = len(costs) + 2, len(costs), len(costs) + 1
    to, cap, graph = [], [], [[] for _ in range(n)]

    def edge(u, v, forth, back):
        graph[u].append(len(to))
        to.append(v)
        cap.append(forth)
        graph[v].append(len(to))
        to.append(u)
        cap.append(back)

    for i, c in enumerate(costs):
        edge(s, i, c, 0.0) if c > 0 else edge(i, t, -c, 0.0)
    for u, v, w in edges:
        edge(u, v, w, w)
    while True:
        level = [-1] * n
        level[s], queue = 0, deque([s])
        while queue:
            u = queue.popleft()
            for e in graph[u]:
                if cap[e] > 1e-9 and level[to[e]] < 0:
                    level[to[e]] = level[u] + 1
                    queue.append(to[e])
        if level[t] < 0:
            return [level[i] >= 0 for i in range(n - 2)]
        at, path, u = [0] * n, [], s
        while True:
            if u == t:
                flow = min(cap[e] for e in path)
                cut = 0
                for k, e in enumerate(path):
                    cap[e] -= flow
                    cap[e ^ 1] += flow
                    if cap[e] <= 1e-9 and not cut:
                        cut = k + 1
                del path[cut - 1:]
                u = to[path[-1]] if path else s
                continue
            while at[u] < len(graph[u]):
                e = graph[u][at[u]]
                if cap[e] > 1e-9 and level[to[e]] == level[u] + 1:
                    break
                at[u] += 1
            if at[u] < len(graph[u]):
                path.append(graph[u][at[u]])
                u = to[path[-1]]
            elif path:
                u = to[path.pop() ^ 1]
                at[u] += 1
            else:
                break


def extract(html: str | None) -> str:
    page = Blocks()
    blocks = page.of(html or "")
    if not blocks:
        return ""
    kinds = natures(blocks, page.marks)
    costs = [classifier_cost(b.text, nature, b.heading, b.link_chars) for b, nature in zip(blocks, kinds)]
    edges, last_under = [], {}
    for i, b in enumerate(blocks):
        if i:  # neighbours in page order, more strongly the nearer they are in the tree
            edges.append((i - 1, i, 3.0 / (1 + page.apart(blocks[i - 1].element, b.element))))
        parent = page.parent[b.element]
        if parent in last_under and last_under[parent] != i - 1:  # next block under the same parent
            edges.append((last_under[parent], i, 1.0))
        last_under[parent] = i
    keep = max_flow_labels(costs, edges)
    if not any(keep) and all(k >= 0 and 2 * b.link_chars < len(b.text) for b, k in zip(blocks, kinds)):
        keep = [True] * len(blocks)  # nothing on the page speaks against its text but that it is short
    return "\n".join(b.text for b, k in zip(blocks, keep) if k)


def extract_pages(pages: DataFrame) -> DataFrame:
    """Main text of every page: page_id, url, text, n_chars.

    Blocks are cut at block-level elements, their character references decoded, white space made one
    space. Null or empty html, and pages without main text, give an empty text; a page of nothing but short texts, with no
    sign of boilerplate, keeps them. Repeated rows and null ids are kept; an empty table gives an empty result; other columns
    are ignored. A page of any length or depth is parsed whole, in time and memory in proportion to its length.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [extract(h.as_py()) for h in b.column(2)]
            yield pa.record_batch([*b.columns[:2], pa.array(texts, pa.string())], names=["page_id", "url", "text"])

    out = pages.select("page_id", "url", F.col("html").cast("string")).mapInArrow(run, "page_id long, url string, text string")
    return out.withColumn("n_chars", F.char_length("text").cast("long"))


def op9_html(spark, sf_dir) -> DataFrame:
    return extract_pages(table(spark, sf_dir, "pages"))

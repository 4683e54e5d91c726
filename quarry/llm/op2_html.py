"""Main text of a page by minimum-cut labelling.

The page is read, in one pass, into blocks of text and the tree of elements above them. Blocks and
elements are the vertices. A classifier's fixed costs become terminal capacities: a block's from its
text (words outside links, sentence ends, share of linked text, heading), an element's from its tag
and, as one voice, from its class, id and role, in proportion to the blocks below it. Smoothness
edges join blocks that follow each other and every vertex with the element above. So a short
line of an article is kept by the edges alone, and a layout name that most of the page stands under
says nothing.
Max-flow separates content from boilerplate; before it, vertices of at most two neighbours are
folded into those exactly, which keeps the cost linear on lists, tables and deep nesting.

Null html gives an empty text; a quote or tag that never ends stops at the next `>`, or at the end of
the page; other malformed markup closes implicitly; repeated rows repeat the result; ties go to
boilerplate; ids of any type, nulls included, and other columns are left to Spark; an empty table
gives an empty result.
"""

from __future__ import annotations

import re
from collections import deque
from html import unescape

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read

NAME = re.compile(r"/?([a-zA-Z][a-zA-Z0-9:-]*)")
REST = re.compile(r"(?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')|=)*+>")
NAMES = re.compile(r"(?i)\b(?:class|id|role)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)")
SPACE = re.compile(r"\s+")
PART = re.compile(r"[a-z]+")
CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
RAW = frozenset("script style noscript template textarea title svg math iframe object select xmp".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("td", "th", "tr"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
BAD_TAG = frozenset("nav footer aside header form menu dialog button fieldset".split())
GOOD_TAG = frozenset("article main".split())
# names that say what a block is, by their words; a word of the first list outweighs one of the last
OTHERS = frozenset("ad ads advert advertisement adverts advertising banner sponsor sponsored promo promotion comment comments disqus reply replies respond cookie cookies consent gdpr notice alert popup modal overlay newsletter subscribe subscription share sharing social related recommended breadcrumb breadcrumbs pagination pager login signup copyright legal toolbar skip".split())
LAYOUT = frozenset("nav navbar navigation menu footer foot header masthead sidebar side aside widget widgets form search".split())
GOOD = frozenset("article content main post entry story body text".split())
STATE = frozenset("has with no is not tag tags category cat type status format layout wrap wrapper container page grid".split())

SENTENCE = ('.', '!', '?', '…', '."', '.”', ':', ';', '。')
BAD, LAID_OUT, GOOD_WORDS, GOOD_TAGS = 30, 20, 8, 14
# edges: of neighbours; of a vertex with the element above, if that stands in a boilerplate element or not; of an element with a voice of its own
NEIGHBOUR, HELD, PLAIN, VOICED = 2, 24, 6, 4


class Page:
    """Blocks (text, linked characters, heading, element) and elements (tag, names, parent), parents first."""

    def __init__(self, html: str):
        self.blocks: list[tuple[str, int, bool, int]] = []
        self.elements: list[tuple[str, str, int]] = [("", "", -1)]
        stack, open_tags, buf = [0], {"": 1}, []
        linked, in_link, at, size = 0, 0, 0, len(html)
        unclosed: set[str] = set()

        def flush() -> None:
            nonlocal linked
            text = "".join(buf)
            buf.clear()
            text = SPACE.sub(" ", unescape(text) if "&" in text else text).strip()
            if text:
                self.blocks.append((text, linked, self.elements[stack[-1]][0] in ("h1", "h2"), stack[-1]))
            linked = 0

        def pop() -> None:
            nonlocal in_link
            open_tags[self.elements[stack.pop()][0]] -= 1
            if in_link > len(stack):  # a link ends with the element it stands in
                in_link = 0

        def add(piece: str) -> None:
            nonlocal linked
            if piece:
                buf.append(piece)
                linked += len(piece) if in_link else 0

        while at < size:
            lt = html.find("<", at)
            if lt < 0:
                break
            add(html[at:lt])
            at = lt + 1
            if html.startswith(("!", "?"), at):
                end = html.find("-->", at) + 3 if html.startswith("!--", at) else html.find(">", at) + 1
                at = end if end > 2 else size
                continue
            m = NAME.match(html, at)
            if not m:
                add("<")
                continue
            rest = REST.match(html, m.end())
            if not rest:
                at = size  # no tag ends after this
                break
            at, tag, closing = rest.end(), m[1].lower(), html[lt + 1] == "/"
            if tag == "br":
                buf.append(" ")
                continue
            if tag == "a":
                in_link = 0 if closing else len(stack)
                continue
            if tag in INLINE:
                continue
            if tag in RAW and not closing:
                if not rest[0].endswith("/>") and tag not in unclosed:
                    end = re.compile(rf"</{tag}\s*>", re.I).search(html, at)
                    if end:
                        at = end.end()
                    elif tag in ("script", "style"):
                        at = size
                    else:
                        unclosed.add(tag)  # only its tag is dropped
                buf.append(" ")
                continue
            flush()
            if closing:
                if tag != "" and open_tags.get(tag):
                    while self.elements[stack[-1]][0] != tag:
                        pop()
                    pop()
            elif tag not in VOID and not rest[0].endswith("/>"):
                over = CLOSES.get(tag, ())
                while (top := self.elements[stack[-1]][0]) == "p" or top in over:  # an open paragraph ends at the next block
                    pop()
                names = " ".join(x.strip("\"'") for x in NAMES.findall(rest[0])) if "=" in rest[0] else ""
                self.elements.append((tag, names, stack[-1]))
                open_tags[tag] = open_tags.get(tag, 0) + 1
                stack.append(len(self.elements) - 1)
        add(html[at:])
        flush()


def voice(names: str) -> int:
    """What the words of class, id and role say: 2 other matter, 1 layout, -1 content, 0 nothing."""
    heard = 0
    for name in names.split():
        words = PART.findall(CAMEL.sub("-", name).lower())
        if not words or words[0] in STATE:
            continue
        if not OTHERS.isdisjoint(words):
            return 2
        good = not GOOD.isdisjoint(words)
        if not LAYOUT.isdisjoint(words):
            heard = max(heard, 0 if good else 1)
        elif good and not heard:
            heard = -1
    return heard


def costs(text: str, linked: int, heading: bool) -> tuple[int, int]:
    """What it costs to call a block boilerplate, and to call it content, by its text alone."""
    share, words = min(1.0, linked / max(1, len(text))), text.count(" ") + 1
    plain = int(words * (1 - share))
    content = min(16, plain // 2) + 4 * (plain >= 5 and text.endswith(SENTENCE)) + 6 * heading
    return content, 3 + 8 * (share > 0.5)


def network(page: Page) -> tuple[list[tuple[int, int]], list[tuple[int, int, int]]]:
    """Terminal capacities (content, boilerplate) and edges; the blocks come first, then the elements."""
    n, elements = len(page.blocks), page.elements
    mass, words = [0] * len(elements), [0] * len(elements)
    for text, _, _, e in page.blocks:
        mass[e] += 1
        words[e] += text.count(" ") + 1
    for e in range(len(elements) - 1, 0, -1):
        mass[elements[e][2]] += mass[e]
        words[elements[e][2]] += words[e]
    kind, under = [0] * len(elements), [False] * len(elements)  # -1 content, 1 boilerplate, 2 layout
    weight = [0] * len(elements)
    for e, (tag, names, parent) in enumerate(elements):
        if not mass[e] or parent < 0:
            continue
        under[e], article = under[parent], weight[parent] < 0
        weight[e] = -1 if article else 0
        heard = voice(names) if names and tag not in ("html", "body") else 0
        most = 2 * words[e] > words[0]
        if heard == 2 and (tag not in GOOD_TAG or "comment" in names.lower()):
            kind[e] = 1
        elif tag in BAD_TAG and not (tag == "header" and article) and not (tag in ("form", "fieldset") and most):
            kind[e] = 1
        elif heard == 1 and not most and tag not in GOOD_TAG:
            kind[e] = 2
        elif (tag in GOOD_TAG or heard == -1) and not under[e]:
            kind[e] = -1
        if kind[e] > 0:
            under[e], weight[e] = True, 0
        elif kind[e] < 0 and tag in GOOD_TAG:
            weight[e] = -1
    terminals = [costs(*b[:3]) for b in page.blocks]
    for e, (tag, _, _) in enumerate(elements):
        good = GOOD_TAGS if tag in GOOD_TAG else GOOD_WORDS
        terminals.append((good * mass[e], 0) if kind[e] < 0 else (0, (0, BAD, LAID_OUT)[kind[e]] * mass[e]))
    edges = [(i, i + 1, NEIGHBOUR) for i in range(n - 1)]
    edges += [(i, n + b[3], HELD if under[b[3]] else PLAIN) for i, b in enumerate(page.blocks)]
    edges += [(n + e, n + x[2], (VOICED if kind[e] else HELD if under[e] else PLAIN) * mass[e]) for e, x in enumerate(elements) if e and mass[e]]
    return terminals, edges


def max_flow_side(n: int, terminals: list[tuple[int, int]], edges: list[tuple[int, int, int]]) -> list[bool]:
    """Vertices on the source side of a minimum cut; capacities are whole numbers, one value for both directions of an edge."""
    near: list[dict[int, int]] = [{} for _ in range(n)]  # near[v][w]: cost of v content, w not
    for a, b, c in edges:
        near[a][b] = near[a].get(b, 0) + c
        near[b][a] = near[b].get(a, 0) + c
    cost = [b - a for a, b in terminals]  # of content over boilerplate
    side = [False] * n
    folded: list[tuple[int, int, list[tuple[int, int, int]]]] = []
    todo, gone = [v for v in range(n) if len(near[v]) <= 2], [False] * n
    while todo:
        v = todo.pop()
        if gone[v] or len(near[v]) > 2:
            continue
        gone[v] = True
        ends = [(w, out, near[w].pop(v)) for w, out in near[v].items()]
        folded.append((v, cost[v], ends))
        todo += [w for w, _, _ in ends if len(near[w]) <= 2]
        if len(ends) == 1:
            w, out, back = ends[0]
            cost[w] += min(cost[v], back) - min(cost[v] + out, 0)
        elif ends:
            (u, out, back), (w, out2, back2) = ends
            f = {(x, y): min(cost[v] + out * (1 - x) + out2 * (1 - y), back * x + back2 * y) for x in (0, 1) for y in (0, 1)}
            cost[u] += f[1, 1] - f[0, 1]
            cost[w] += f[0, 1] - f[0, 0]
            if more := f[1, 0] + f[0, 1] - f[0, 0] - f[1, 1]:
                near[u][w] = near[u].get(w, 0) + more
                near[w].setdefault(u, 0)
            todo += [x for x in (u, w) if len(near[x]) <= 2]
    core = [v for v in range(n) if not gone[v]]
    if core:
        for v, on in zip(core, source_side(core, cost, near), strict=True):
            side[v] = on
    for v, own, ends in reversed(folded):
        side[v] = own + sum(out for w, out, _ in ends if not side[w]) < sum(back for w, _, back in ends if side[w])
    return side


def source_side(core: list[int], cost: list[int], near: list[dict[int, int]]) -> list[bool]:
    """Max-flow by levels (shortest paths first, all of a length in one sweep); what the source still reaches is content."""
    s, t, number = len(core), len(core) + 1, {v: i for i, v in enumerate(core)}
    cap: list[dict[int, int]] = [{number[w]: c for w, c in near[v].items()} for v in core] + [{}, {}]
    for i, v in enumerate(core):
        if cost[v] < 0:
            cap[s][i], cap[i][s] = -cost[v], 0
        elif cost[v] > 0:
            cap[i][t], cap[t][i] = cost[v], 0
    while True:
        level, queue = {s: 0}, deque([s])
        while queue:
            v = queue.popleft()
            for w, c in cap[v].items():
                if c > 0 and w not in level:
                    level[w] = level[v] + 1
                    queue.append(w)
        if t not in level:
            return [i in level for i in range(len(core))]
        arcs = [iter([w for w, c in x.items() if c > 0 and level.get(w, -1) == level.get(v, -2) + 1]) for v, x in enumerate(cap)]
        path = [s]
        while path:
            v = path[-1]
            if v == t:
                least = min(cap[a][b] for a, b in zip(path, path[1:], strict=False))
                keep = len(path)
                for k in range(len(path) - 2, -1, -1):
                    a, b = path[k], path[k + 1]
                    cap[a][b] -= least
                    cap[b][a] += least
                    if not cap[a][b]:
                        keep = k + 1
                del path[keep:]
                continue
            w = next((w for w in arcs[v] if cap[v][w] > 0), None)
            if w is None:
                path.pop()
            else:
                path.append(w)


def main_text(html: str | None) -> str:
    page = Page(html or "")
    if not page.blocks:
        return ""
    terminals, edges = network(page)
    side = max_flow_side(len(terminals), terminals, edges)
    return "\n".join(b[0] for b, keep in zip(page.blocks, side, strict=False) if keep)


def extract(pages: DataFrame) -> DataFrame:
    @F.pandas_udf("string")
    def text_of(htmls: pd.Series) -> pd.Series:
        return pd.Series([main_text(h) for h in htmls], dtype=object)

    out = pages.select("page_id", "url", text_of("html").alias("text"))
    return out.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))


def op2_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(read(spark, sf_dir, "pages"))

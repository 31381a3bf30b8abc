"""Main text of web pages by a minimum cut.

A page becomes a line of text blocks with their place in the tree. A linear classifier over the block's own evidence (tags
and names around it, link share, length, sentence marks) gives each block a cost for either label: the terminal
capacities. Neighbouring blocks, and blocks next to each other under one parent, are joined by smoothness edges, stronger the more of their path they share.
The cut of least cost, found by maximum flow, parts content from boilerplate.

A tag or name of boilerplate is a cost for the text below it, relative to the page: a mark that holds most of the page's text is a wrapper and
costs nothing. Marks with one meaning (navigation, footers, asides, comments, adverts) cost the more of themselves until they hold nearly all of the text, and an
article or main inside them does not undo them; words of many uses (header, banner, legal, widget, form) count as whole names only, add up, and an article halves them.
Names of html, body and main are no marks, and of an article only those of comments."""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayframe.llm.common import small_batches

# Elements by their part in a page.
SILENT = frozenset("script style noscript template head title svg math iframe object canvas select textarea button option datalist audio video".split())
RAW = frozenset("script style textarea title".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul br".split())
AWAY = frozenset("nav aside footer menu dialog".split())
WHOLE = frozenset("html body main article".split())  # whose names say nothing against their text
GENERIC = frozenset("header banner banners promo notice notices legal widget widgets toolbar copyright skip form".split())  # as a tag or whole name
AWAY_COST, IN_ARTICLE = 6.0, 0.5
WRAPS = {1: (0.3, 0.6), 2: (0.9, 1.0)}  # share of the page's text from which a mark (1: generic, 2: certain) costs less, and nothing
CLOSES_P = BLOCK - {"br"}
COMMENT = r"comments?|disqus|replies|reply|respond"
NAMES = r"(?:^|[\s_-])(?<!\bhas[_-])(?<!\bno[_-])(?<!\bwith[_-])(?:{})(?=$|[\s_-])"
NAMES_AWAY = re.compile(NAMES.format(COMMENT + r"|ads?|advert\w*|sponsor\w*|nav\w*|menu\w*|breadcrumbs?|side-?bar|footer|site-header|masthead|cookies?|consent|newsletter|subscribe|popup|modal"
                                     r"|share|social|related|recommend\w*|login|signup|pager|pagination"), re.I)
NAMES_COMMENT = re.compile(NAMES.format(COMMENT), re.I)
NAMES_KEEP = re.compile(r"(?:^|[\s_-])(?:article|content|main|post|entry|story|body|text)(?=$|[\s_-])", re.I)
MARK = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^>=]|=\s*+(?:\"[^\"]*\"|'[^']*'|[^\s\"'>][^\s>]*)?+)*+)(?:>|\Z)", re.S)
ATTR = re.compile(r"([^\s=/>\"']+)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
SPACE = re.compile(r"\s+")
ENDS = re.compile(r"[.!?…][\"'”’)\]]?(?:\s|$)")


class Block:
    __slots__ = ("parts", "node", "away", "keep", "linked", "kind", "text")

    def __init__(self, node, kind):
        self.parts, self.node, self.kind, self.linked, self.text, self.away, self.keep = [], node, kind, 0, "", 0.0, False


class Tree:
    """Elements of a page in page order: parent, depth, mark (0: none, 1: generic, 2: certain), whether it is an article or main, and whether its
    tag or name speaks for content."""

    def __init__(self):
        self.parent, self.depth, self.mark, self.tag, self.held = [-1], [0], [0], [""], [False]

    def add(self, parent: int, mark: int, tag: str, held: bool) -> int:
        self.parent.append(parent)
        self.depth.append(self.depth[parent] + 1)
        self.mark.append(mark)
        self.tag.append(tag)
        self.held.append(held)
        return len(self.parent) - 1

    def common(self, a: int, b: int) -> int:
        """Elements that two paths have in common, the root included."""
        while a != b:
            if self.depth[a] >= self.depth[b]:
                a = self.parent[a]
            else:
                b = self.parent[b]
        return self.depth[a] + 1

    def judge(self, found: list[Block]) -> None:
        """Set each block's cost of boilerplate marks, and whether its path speaks for content. Parents come before their children."""
        n = len(self.parent)
        size = [0] * n
        for b in found:
            size[b.node] += max(0, len(b.text) - b.linked)
        for v in range(n - 1, 0, -1):
            size[self.parent[v]] += size[v]
        generic, certain, keep = [0.0] * n, [0.0] * n, [False] * n
        for v in range(1, n):
            up = self.parent[v]
            own = 0.0
            if self.mark[v]:
                low, high = WRAPS[self.mark[v]]
                share = size[v] / size[0] if size[0] else 0.0
                own = AWAY_COST * min(1.0, max(0.0, (high - share) / (high - low)))
            above = 0.0 if self.tag[v] == "main" else generic[up] * (IN_ARTICLE if self.tag[v] == "article" else 1.0)
            generic[v] = above + (own if self.mark[v] == 1 else 0.0)
            certain[v] = max(certain[up], own if self.mark[v] == 2 else 0.0)
            keep[v] = (keep[up] or self.held[v]) and own <= AWAY_COST / 2 and certain[v] <= AWAY_COST / 2
        for b in found:
            b.away, b.keep = generic[b.node] + certain[b.node], keep[b.node]


class Blocks(list):
    """Blocks of a page in their order, with the tree they stand in."""

    def __init__(self, found: list[Block], tree: Tree):
        super().__init__(found)
        self.tree = tree


def blocks(page: str) -> Blocks:
    """Text blocks in page order, and their tree. Open elements are a stack of (tag, node, silent, link, nearest block element)."""
    out: list[Block] = []
    tree = Tree()
    stack = [("", 0, False, False, "")]
    inside = 0  # open article and main elements
    opened: dict[str, int] = {}
    now, at, size = None, 0, len(page)

    def pop() -> None:
        nonlocal inside
        gone = stack.pop()[0]
        opened[gone] -= 1
        inside -= gone in ("article", "main")

    def say(raw: str) -> None:
        nonlocal now
        if not raw:
            return
        _, node, silent, link, kind = stack[-1]
        if silent:
            return
        if now is None:
            if raw.isspace():
                return
            now = Block(node, kind)
            out.append(now)
        now.parts.append(raw)
        if link:
            now.linked += len(raw)

    while at < size:
        m = MARK.search(page, at)
        if m is None:
            say(page[at:])
            break
        say(page[at:m.start()])
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            if tag in BLOCK:
                now = None
            if opened.get(tag):
                while stack[-1][0] != tag:
                    pop()
                pop()
            continue
        if tag in BLOCK:
            now = None
            if tag in CLOSES_P and opened.get("p"):
                depth = len(stack) - 1
                while depth and stack[depth][0] != "p" and stack[depth][0] not in BLOCK:
                    depth -= 1
                if stack[depth][0] == "p":  # an open paragraph ends here
                    while len(stack) > depth:
                        pop()
            if tag == "li" and stack[-1][0] == "li":
                pop()
        if tag in VOID:
            continue
        _, up, silent, link, kind = stack[-1]
        marks = names(m[3]) if m[3] else ""
        hidden = "\0hidden" in marks
        certain = tag in AWAY or bool(marks and (NAMES_COMMENT if tag == "article" else NAMES_AWAY).search(marks)) and (tag == "article" or tag not in WHOLE)
        generic = tag == "form" or (tag == "header" and not inside) or bool(marks and tag not in WHOLE and not GENERIC.isdisjoint(marks.lower().split()))
        mark = 2 if certain else 1 if generic else 0
        held = tag in ("article", "main") or bool(marks and not mark and NAMES_KEEP.search(marks))
        if not m[3].rstrip().endswith("/") or tag in BLOCK or tag in SILENT:
            stack.append((tag, tree.add(up, mark, tag, held), silent or tag in SILENT or hidden, link or tag == "a", tag if tag in BLOCK else kind))
            opened[tag] = opened.get(tag, 0) + 1
            inside += tag in ("article", "main")
        if tag in RAW:
            close = re.compile(rf"</{tag}\s*>", re.I).search(page, at)
            at = close.end() if close else size
            pop()
    for b in out:
        b.text = SPACE.sub(" ", entities.unescape("".join(b.parts))).strip()
    out = [b for b in out if b.text]
    tree.judge(out)
    return Blocks(out, tree)


def names(attributes: str) -> str:
    """Class, id and role of a start tag; a hidden element is marked."""
    found = []
    for k, a, b, c in ATTR.findall(attributes):
        k = k.lower()
        if k in ("class", "id", "role"):
            found.append(a or b or c)
        elif k == "hidden" or (k == "style" and "display:none" in (a or b or c).replace(" ", "").lower()):
            found.append("\0hidden")
    return " ".join(found)


def evidence(b: Block) -> float:
    """Log-odds that a block is content."""
    n = len(b.text)
    links = min(1.0, b.linked / n)
    score = 0.6 + min(1.5, n / 150) + 0.8 * min(2, len(ENDS.findall(b.text))) / 2 - 3.0 * links
    if b.kind in ("p", "h1", "h2", "h3", "h4", "h5", "h6", "blockquote", "pre", "td", "li", "figcaption"):
        score += 0.5
    if b.keep:
        score += 2.5
    score -= b.away
    if b.text.startswith(("©", "(c) ")):
        score -= 3.0
    return score


def edges(found: Blocks) -> list[tuple[int, int, float]]:
    """Smoothness: next blocks, and next blocks under one parent, by the share of their path in common."""
    tree, out, last = found.tree, [], {}
    for i, b in enumerate(found):
        seen = {}
        if i:
            seen[i - 1] = 0.3
        parent = tree.parent[b.node]
        if parent in last:
            seen[last[parent]] = seen.get(last[parent], 0.0) + 0.4
        last[parent] = i
        for j, base in seen.items():
            most = max(tree.depth[b.node], tree.depth[found[j].node]) + 1
            out.append((j, i, base * tree.common(found[j].node, b.node) / most))
    return out


EPSILON = 1e-12


def min_cut(cost: list[float], links: list[tuple[int, int, float]]) -> list[bool]:
    """Labels of least total cost: a block against its evidence costs |evidence|, parted neighbours cost their edge.

    Maximum flow in phases: one breadth-first search gives every block its distance from the blocks that lean to content, and flow
    then fills all shortest ways at once, each block remembering the edge that it tries next."""
    n = len(cost)
    heads: list[list[int]] = [[] for _ in range(n)]
    to, cap = [], []
    for a, b, w in links:
        heads[a].append(len(to))
        heads[b].append(len(to) + 1)
        to += [b, a]
        cap += [w, w]
    source, sink = [max(0.0, c) for c in cost], [max(0.0, -c) for c in cost]
    while True:
        level = [0 if x > EPSILON else -1 for x in source]
        todo = [v for v in range(n) if level[v] == 0]
        end = None
        for v in todo:
            if sink[v] > EPSILON and end is None:
                end = level[v]
            if end is not None and level[v] >= end:
                continue
            for e in heads[v]:
                if cap[e] > EPSILON and level[to[e]] < 0:
                    level[to[e]] = level[v] + 1
                    todo.append(to[e])
        if end is None:
            return [x >= 0 for x in level]
        nxt = [0] * n
        for start in range(n):
            if level[start] != 0:
                continue
            path: list[int] = []
            v = start
            while source[start] > EPSILON:
                if level[v] == end and sink[v] > EPSILON:
                    amount = min([source[start], sink[v], *(cap[e] for e in path)])
                    source[start] -= amount
                    sink[v] -= amount
                    for e in path:
                        cap[e] -= amount
                        cap[e ^ 1] += amount
                    full = next((i for i, e in enumerate(path) if cap[e] <= EPSILON), len(path))
                    path = path[:full]  # go on from where the way is full
                    v = to[path[-1]] if path else start
                    continue
                while nxt[v] < len(heads[v]):
                    e = heads[v][nxt[v]]
                    if level[v] < end and cap[e] > EPSILON and level[to[e]] == level[v] + 1:
                        break
                    nxt[v] += 1
                if nxt[v] < len(heads[v]):
                    path.append(heads[v][nxt[v]])
                    v = to[path[-1]]
                elif path:
                    e = path.pop()
                    v = to[e ^ 1]
                    nxt[v] += 1
                else:
                    break


def main_text(page: str | None) -> str:
    """Main text of one page; null and pages without text give the empty text."""
    found = blocks(page or "")
    if not found:
        return ""
    keep = min_cut([evidence(b) for b in found], edges(found))
    return " ".join(b.text for b, k in zip(found, keep) if k)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars (code points) of every row of `pages(page_id, url, html)`; repeated rows give repeated
    results, further columns are ignored, an empty table gives no rows."""

    @F.pandas_udf("text string, n_chars long")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for rows in parts:
            texts = [main_text(x) for x in rows]
            yield pd.DataFrame({"text": pd.Series(texts, dtype=object), "n_chars": pd.Series(list(map(len, texts)), dtype="int64")})

    return small_batches(pages).select("page_id", "url", run(F.col("html")).alias("x")).select("page_id", "url", "x.*")

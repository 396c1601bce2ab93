"""Main text of web pages by minimum-cut labelling.

A page is cut into blocks of text between block tags. A block's costs of being called content or boilerplate are the
capacities from the source and to the sink: what its elements and their marks say, and the log odds of its own look
(length, share of link text, end of a sentence), within LOOK. Blocks in sequence, siblings, and blocks and elements in the tree are
joined by smoothness edges: calling two near ones differently costs the edge. Maximum flow finds the cheapest labelling.
Clear marks outweigh all edges of a block; short, plain or unmarked blocks go with those around them.

The look's log odds are learned from the pages themselves: in a bounded sample, blocks under elements with a clear meaning are
taken as labelled. Where a sample has too few of either kind, fixed odds hold.

Before the flow, nodes whose own cost outweighs all their edges are settled and hand their edges on; that is exact, and
most pages need no search after it.

Defined results: null and empty pages give an empty text; broken markup (open quotes, tags, comments and references cut off at
the end) is read as browsers do, as far as it goes; pages of any length are taken whole; repeated rows agree; an empty table
gives an empty result; columns beyond the page's id, address and html don't matter.
"""

from __future__ import annotations

import re
from collections import Counter, deque
from collections.abc import Iterator
from html import unescape
from math import log

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, map_rows

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|svg|iframe|object|textarea|select)\b[^>]*>.*?(?:</\1\s*>|\Z)|</?[a-z](?:[^>\"']|\"[^\"]*\"|'[^']*')*>|</?[a-z][^>]*(?:>|\Z)|<[!?][^>]*(?:>|\Z)",
    re.S | re.I,
)
_NAME = re.compile(r"</?([a-z][a-z0-9-]*)", re.I)
_MARKS = re.compile(r"(?:class|id|role|aria-label)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", re.I)

BLOCKS = set("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option optgroup p pre section summary table tbody td tfoot th thead title tr ul".split())
VOID = set("hr br img input meta link wbr source track area base col embed param".split())
#: An open element of the first kind ends where one of the second begins.
IMPLIED = {"p": BLOCKS, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "option": {"option"}, "head": {"body"}}

#: Costs of elements and of words in class, id and role: above zero speaks for content.
ELEMENTS = {"article": 2.0, "main": 2.0, "p": 0.6, "pre": 0.6, "blockquote": 0.6, "h1": 0.8, "h2": 0.4, "h3": 0.4, "nav": -6.0, "footer": -6.0, "aside": -6.0, "form": -6.0, "header": -3.0, "menu": -6.0, "button": -6.0, "dialog": -6.0, "head": -30.0, "title": -30.0, "fieldset": -6.0, "li": -0.4}
_BAD = re.compile(r"\b(?:nav(?:bar|igation)?|menu|foot(?:er)?|site-?header|masthead|side-?bar|aside|cookies?|consent|gdpr|adverts?|advertisement|ads?|advert-\w+|ad-\w+|sponsor(?:ed)?|promo(?:tion)?|comments?|comment-\w+|disqus|repl(?:y|ies)|respond|newsletter|subscribe|signup|login|breadcrumbs?|popup|modal|pagination|pager|toolbar|complementary|contentinfo)\b", re.I)
_GOOD = re.compile(r"\b(?:article|content|main|post|entry|story|article-?body|post-?body|entry-?content|text)\b", re.I)
#: Words that may as well name what an article is about: one alone weighs less than an article's marks, two of them more.
_DOUBTFUL = re.compile(r"\b(?:notice|alert|banner|share|social|related|recommended|widget|skip|copyright|search)\b", re.I)
BAD_MARK, DOUBTFUL_MARK, GOOD_MARK = -6.0, -3.0, 1.5
#: Costs of elements within an article that differ there: its own header holds its title.
IN_ARTICLE = {"header": -0.5}
#: What a block says of rights counts beyond its look, but for less than an article: there it may be part of the text.
_RIGHTS = re.compile(r"(?:^(?:copyright\b|©|\(c\))\s*(?:©|\(c\))?\s*\d{4}|\ball rights reserved\b)", re.I)
RIGHTS, RIGHTS_LENGTH = -2.0, 200
LOOK = 1.5
ADJACENT, SIBLING, PARENT = 0.3, 0.3, 0.3
SCALE = 1 << 10
#: Pages whose blocks a look is learned from, at most; the path cost from which a block counts as labelled; labelled blocks of either kind that it takes.
SAMPLE_PAGES, CLEAR, LEAST_BLOCKS = 4000, 2.0, 50


class Block:
    __slots__ = ("parts", "element", "linked", "text")

    def __init__(self, element: int):
        self.parts: list[str] = []
        self.element, self.linked, self.text = element, 0, ""


def blocks(html: str) -> tuple[list[Block], list[int], list[float]]:
    """The blocks of a page in order; parent and cost of each element."""
    parents, costs, names = [-1], [0.0], [""]
    open_, links, out = [0], 0, []
    standing: Counter[str] = Counter()
    now = Block(0)

    def text(piece: str) -> None:
        if piece:
            now.parts.append(piece)
            if links:
                now.linked += len(piece)

    def ends(element: int) -> None:
        nonlocal now
        if now.parts:
            out.append(now)
        now = Block(element)

    at = 0
    for m in _TOKEN.finditer(html):
        if m.start() > at:
            text(html[at : m.start()])
        at = m.end()
        token = m[0]
        if m[1] or token[1] in "!?":
            continue
        name = _NAME.match(token)[1].lower()
        if name not in BLOCKS and name != "button":
            if name == "br":
                text(" ")
            elif name == "a":
                links = 0 if token[1] == "/" else 1
            continue
        links = 0
        if token[1] == "/":
            if standing[name]:
                while True:
                    ended = names[open_.pop()]
                    standing[ended] -= 1
                    if ended == name:
                        break
            ends(open_[-1])
        elif name == "hr":
            ends(open_[-1])
        else:
            while len(open_) > 1 and name in IMPLIED.get(names[open_[-1]], ()):
                standing[names[open_.pop()]] -= 1
            own = IN_ARTICLE[name] if name in IN_ARTICLE and standing["article"] else ELEMENTS.get(name, 0.0)
            if " " in token and (marks := _MARKS.findall(token)):
                said = " ".join(marks).replace("_", "-")
                doubtful = len({w.lower() for w in _DOUBTFUL.findall(said)})
                own += BAD_MARK * bool(_BAD.search(said)) or DOUBTFUL_MARK * min(doubtful, 2) + GOOD_MARK * bool(_GOOD.search(said))
            parents.append(open_[-1])
            costs.append(own)
            names.append(name)
            open_.append(len(names) - 1)
            standing[name] += 1
            ends(open_[-1])
    if at < len(html):
        text(html[at:])
    ends(0)
    for b in out:
        joined = "".join(b.parts)
        b.text = " ".join((unescape(joined) if "&" in joined else joined).split())
    return [b for b in out if b.text], parents, costs


def _path_costs(parents: list[int], costs: list[float]) -> list[float]:
    """Each element's cost with those above it."""
    out: list[float] = []
    for parent, cost in zip(parents, costs, strict=True):
        out.append(cost + (out[parent] if parent >= 0 else 0.0))
    return out


def look(b: Block) -> tuple[str, str, str]:
    """What a block looks like: bins of its length by powers of two, of its link share, and whether it ends a sentence."""
    n = len(b.text)
    links = min(1.0, b.linked / max(n, 1))
    return f"length{min(n.bit_length(), 11)}", f"links{0 if not links else 1 + (links > 0.3) + (links > 0.7)}", f"sentence{b.text[-1] in '.!?…:»”' + chr(34):d}"


#: Log odds of content by look, where none are learned.
FIXED: dict[str, float] = {f"length{n}": min(0.25 * n - 1.5, 0.5) for n in range(12)} | {"links0": 0.2, "links1": -0.2, "links2": -1.0, "links3": -2.0} | {"sentence0": -0.3, "sentence1": 0.5}


def evidence(b: Block, path: float, odds: dict[str, float]) -> float:
    """Classifier: above zero for content."""
    rights = RIGHTS * (len(b.text) <= RIGHTS_LENGTH and bool(_RIGHTS.search(b.text)))
    return path + rights + max(-LOOK, min(LOOK, sum(odds.get(x, 0.0) for x in look(b))))


def minimum_cut(terminals: list[int], edges: dict[int, dict[int, int]]) -> list[bool]:
    """True for nodes on the source side of a minimum cut. terminals: capacity from the source less that to the sink."""
    excess, side = list(terminals), [None] * len(terminals)
    weight = {v: sum(edges.get(v, {}).values()) for v in range(len(excess))}
    todo = deque(range(len(excess)))
    while todo:
        v = todo.popleft()
        if side[v] is not None or abs(excess[v]) < weight[v]:
            continue
        side[v] = excess[v] > 0
        for u, cap in edges.get(v, {}).items():
            if side[u] is None:
                excess[u] += cap if side[v] else -cap
                weight[u] -= cap
                todo.append(u)
    left = [v for v in range(len(excess)) if side[v] is None]
    if left:
        reached = _flow(left, excess, edges, side)
        for v in left:
            side[v] = v in reached
    return side


def _flow(left: list[int], excess: list[int], edges: dict[int, dict[int, int]], side: list) -> set[int]:
    """Maximum flow by blocking flows over the nodes not settled; the nodes the source still reaches."""
    rest = {v: {u: c for u, c in edges.get(v, {}).items() if side[u] is None} for v in left}
    give, take = {v: max(excess[v], 0) for v in left}, {v: max(-excess[v], 0) for v in left}
    while True:
        level = {v: 0 for v in left if give[v]}
        todo, goals = deque(level), False
        while todo:
            v = todo.popleft()
            goals |= take[v] > 0
            for u, c in rest[v].items():
                if c and u not in level:
                    level[u] = level[v] + 1
                    todo.append(u)
        if not goals:
            return set(level)
        ways = {v: iter(list(rest[v])) for v in level}
        for root in [v for v in left if give[v]]:
            path = [root]
            while path:
                v = path[-1]
                if take[v] and give[root]:
                    flow = min(take[v], give[root], *(rest[a][b] for a, b in zip(path, path[1:], strict=False)))
                    take[v] -= flow
                    give[root] -= flow
                    for a, b in zip(path, path[1:], strict=False):
                        rest[a][b] -= flow
                        rest[b][a] = rest[b].get(a, 0) + flow
                    if not give[root]:
                        break
                    # back to before the first edge that is full now
                    full = next((i for i, (a, b) in enumerate(zip(path, path[1:], strict=False)) if not rest[a][b]), None)
                    del path[full + 1 if full is not None else len(path) :]
                    continue
                step = next((u for u in ways[v] if rest[v].get(u) and level.get(u) == level[v] + 1), None)
                if step is not None:
                    path.append(step)
                else:
                    path.pop()


def network(html: str, odds: dict[str, float] = FIXED) -> tuple[list[Block], list[int], dict[int, dict[int, int]]]:
    """Blocks, terminal capacities of blocks and then elements, and edges."""
    found, parents, costs = blocks(html)
    paths = _path_costs(parents, costs)
    n = len(found)
    terminals = [round(SCALE * evidence(b, paths[b.element], odds)) for b in found] + [0] * len(parents)
    edges: dict[int, dict[int, int]] = {}

    def join(a: int, b: int, cost: float) -> None:
        cap = round(SCALE * cost)
        for x, y in ((a, b), (b, a)):
            edges.setdefault(x, {})[y] = edges.get(x, {}).get(y, 0) + cap

    for i, b in enumerate(found):
        if i:
            same = parents[b.element] == parents[found[i - 1].element]
            join(i - 1, i, ADJACENT + SIBLING * same)
        join(i, n + b.element, PARENT)
    for e, parent in enumerate(parents):
        if parent >= 0:
            join(n + e, n + parent, PARENT)
    return found, terminals, edges


def main_text(html: str, odds: dict[str, float] = FIXED) -> str:
    """The blocks labelled content, in order, two line feeds between."""
    found, terminals, edges = network(html, odds)
    side = minimum_cut(terminals, edges)
    return "\n\n".join(b.text for i, b in enumerate(found) if side[i])


def learn(pages: DataFrame, html: str = "html", sample_pages: int = SAMPLE_PAGES) -> dict[str, float]:
    """Log odds of content by look, from the clearly marked blocks of ``sample_pages`` different pages picked by digest."""
    digest = F.xxhash64(html)
    least = pages.select(digest.alias("d")).distinct().orderBy("d").limit(sample_pages).agg(F.max("d")).first()[0]
    if least is None:
        return FIXED
    sample = pages.where(digest <= F.lit(least)).select(html).groupBy(digest).agg(F.first(html).alias(html)).select(html)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[tuple[str, bool]] = Counter()
        for batch in batches:
            for page in batch.column(0):
                found, parents, costs = blocks(page.as_py() or "")
                paths = _path_costs(parents, costs)
                for b in found:
                    if CLEAR <= abs(path := paths[b.element]) < -ELEMENTS["head"] / 2:
                        seen.update((x, path > 0) for x in (*look(b), "all"))
        keys = sorted(seen)
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.bool_()), pa.array([seen[k] for k in keys], pa.int64())], names=["look", "content", "n"])

    bounded_batches(pages.sparkSession)
    # bounded: 19 looks of two kinds
    counts = sample.mapInArrow(rows, "look string, content boolean, n long").groupBy("look", "content").agg(F.sum("n").alias("n")).collect()
    seen = {(r["look"], r["content"]): r["n"] for r in counts}
    good, bad = seen.get(("all", True), 0), seen.get(("all", False), 0)
    if min(good, bad) < LEAST_BLOCKS:
        return FIXED
    share = lambda x, content, n: (seen.get((x, content), 0) + 1) / (n + 2)
    return {x: log(share(x, True, good)) - log(share(x, False, bad)) for x in FIXED}


def extracted(pages: DataFrame, odds: dict[str, float] = FIXED, html: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """The kept columns, ``text`` and ``n_chars``."""

    def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [main_text(h.as_py() or "", odds) for h in batch.column(len(keep))]
        return pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[*keep, "text", "n_chars"])

    schema = ", ".join(f"`{c}` {pages.schema[c].dataType.simpleString()}" for c in keep)
    return map_rows(pages, [*keep, html], rows, f"{schema}, text string, n_chars long")

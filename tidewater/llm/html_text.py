"""Main text of web pages by a tree-structured graphical model over the DOM.

Every element that starts a block, or whose name or class hints at page furniture, is a node with a hidden label: main
text or not. A label sends what the element looks like (its kind, hints, length of its own text, share of links,
sentence marks) and meets the label of its parent in a potential of the edge. Messages go from the leaves up and from
the root down (sum-product, exact on a tree), and an element's own text is kept if its marginal says main text.

The potentials are smoothed counts over labelled pages: html and the lines of its main text. Where no labels are at
hand, pages that mark exactly one article or main element label themselves.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.llm import words

# Element names of HTML, by what they do here.
RAW = ("script", "style", "noscript", "template", "iframe", "svg", "object", "head", "textarea", "select", "canvas", "audio", "video")
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
HEADINGS = set("h1 h2 h3 h4 h5 h6".split())
TEXTS = set("p blockquote pre figcaption caption summary".split())
ITEMS = set("li dd dt".split())
CELLS = set("td th".split())
MAINS = set("article main".split())
FURNITURE = set("nav header footer aside form menu dialog button fieldset label legend".split())
BLOCKS = HEADINGS | TEXTS | ITEMS | CELLS | MAINS | FURNITURE - {"button", "label"} | set("html body div section ul ol dl table thead tbody tfoot tr figure details address hgroup search center hr".split())
CLOSES = {"li": {"li"}, "dd": {"dd", "dt"}, "dt": {"dd", "dt"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "tbody": {"thead", "tbody", "tr", "td", "th"}, "tfoot": {"tbody", "tr", "td", "th"}}
KEEPS_OPEN = {"li": {"ul", "ol", "menu"}, "dd": {"dl"}, "dt": {"dl"}, "tr": {"table"}, "td": {"table", "tr"}, "th": {"table", "tr"}, "tbody": {"table"}, "tfoot": {"table"}}
# Words in class, id and role that name page furniture.
HINTS = set(
    "ad ads advert adverts advertisement advertising adsense adslot banner billboard breadcrumb breadcrumbs comment comments commentlist consent cookie cookies disqus "
    "disclaimer feedback footer form gdpr header login masthead menu menubar modal nav navbar navigation newsletter notice notices notification outbrain pager pagination paywall "
    "popup promo promoted promotion recommended related replies reply search share sharing sidebar signup skip social sponsor sponsored subscribe subscription taboola teaser toolbar "
    "topbar widget widgets warning alert alerts contentinfo complementary".split()
)
# Those of them that may as well tell what a part of an article is about, or that it warns the reader.
SOFT = set("alert alerts banner billboard disclaimer feedback header notice notices notification promotion search sharing skip social subscription teaser warning widget widgets".split())
# Words in class names that tell of place, size and make only.
NEUTRAL = set("area bar block body bottom box button buttons col column container content desktop form group icons inner item items js large left link links list mobile outer panel reader right row section size slot small top unit user wrap wrapper".split())

# Possessive where a second try could only fail again; cut marks what runs to the end of the page.
TOKEN = re.compile(
    r"""<!--.*?(?:-->|(?P<cut>\Z))|<[!?][^>]*+>|<(?P<raw>"""
    + "|".join(RAW)
    + r""")\b[^>]*+>.*?(?:</(?P=raw)\s*+>|(?P<cut_raw>\Z))|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*+)(?P<attributes>(?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|</?[a-zA-Z][^>]*+>""",
    re.S | re.I,
)
NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
WORDS = re.compile(r"[a-z]+")
OTHER = re.compile(r"(?:.*[-_])?(?:has|with|without|no|non|is)[-_]")
HIDDEN = re.compile(r"""(?:^|\s)hidden(?:\s|=|$)|display\s*:\s*none|aria-hidden\s*=\s*["']?true""", re.I)
SENTENCE = re.compile(r"[.!?…。！？]")


class Page:
    """The nodes of a page in page order, and its pieces of text: block number, node, text as it stands."""

    def __init__(self, text: str):
        self.parent, self.name, self.hint, self.inside, self.unsure = [-1], ["#root"], [0], [0], [False]
        self.pieces: list[tuple[int, int, str]] = []
        self.size, self.linked, self.own, self.marks = [0], [0], [0], [0]
        wraps, mains = [False], [False]
        stack, block, links, at = [("#root", 0)], 0, 0, 0
        # Where elements of each name are open, and where blocks other than p are: no end tag or start tag searches the stack.
        where: dict[str, list[int]] = defaultdict(list)
        blocks: list[int] = []

        def last(names) -> int:
            return max((where[n][-1] for n in names if where.get(n)), default=0)

        def close(k: int) -> bool:
            """Closes the k-th open element and all within it; tells whether one of them is a block."""
            nonlocal links
            found = False
            for n, _ in reversed(stack[k:]):
                where[n].pop()
                links -= n == "a"
                if n in BLOCKS:
                    found = True
                    if n != "p":
                        blocks.pop()
            del stack[k:]
            return found

        # Behind the last > nothing can be a tag.
        for m in TOKEN.finditer(text, 0, text.rfind(">") + 1):
            if m.start() > at:
                self.put(block, stack[-1][1], text[at : m.start()], links)
            at, name = m.end(), (m["name"] or "").lower()
            if m["cut"] is not None or m["cut_raw"] is not None:
                at = len(text)
            if not name:
                continue
            if name in BLOCKS:
                block += 1
            if name == "br":
                self.pieces.append((block, stack[-1][1], " "))
            if m["end"]:
                if where.get(name):
                    block += close(where[name][-1])
                continue
            if name in BLOCKS:
                while (k := last(("p",))) > (blocks[-1] if blocks else 0):
                    close(k)
            if name in CLOSES:
                while (k := last(CLOSES[name])) > last(KEEPS_OPEN.get(name, ("select",))):
                    close(k)
            if name in VOID:
                continue
            attributes = m["attributes"]
            named = self.hinted(attributes) if name not in ("html", "body") else 0
            # An article has a header and a footer of its own, and parts whose names are but looks, with weights from labelled pages.
            told = bool(where.get("article") or where.get("main"))
            own = name in ("header", "footer") and told
            by_name = named and name not in MAINS
            hint = 1 if name in FURNITURE and not own or by_name and (named == 1 or not told) else 2 if by_name else 0
            node = stack[-1][1]
            if name in BLOCKS or hint:
                node = len(self.parent)
                self.parent.append(stack[-1][1])
                self.name.append(name)
                self.hint.append(hint)
                self.unsure.append(told and name not in FURNITURE and hint == 1)
                wraps.append(hint == 1 and (name in ("form", "fieldset") or name not in FURNITURE) and not HIDDEN.search(attributes))
                mains.append(name in MAINS and not named)
                for x in (self.size, self.linked, self.own, self.marks):
                    x.append(0)
            if not attributes.endswith("/"):
                where[name].append(len(stack))
                if name in BLOCKS and name != "p":
                    blocks.append(len(stack))
                stack.append((name, node))
                links += name == "a"
        if at < len(text):
            self.put(block, stack[-1][1], text[at:], links)
        for k in range(len(self.parent) - 1, 0, -1):
            self.size[self.parent[k]] += self.size[k]
            self.linked[self.parent[k]] += self.linked[k]
        self.unwrap(wraps, mains)

    def unwrap(self, wraps: list[bool], mains: list[bool]) -> None:
        """Takes the hint from elements around the whole content, and tells which nodes lie inside a hinted one.

        A class name or a form is around the content if it holds every article and main element that isn't named
        furniture itself (every main element, where there is one); on a page without them, a form that holds most text.
        """
        wanted = [m and n == "main" for m, n in zip(mains, self.name)]
        held = [int(m) for m in (wanted if any(wanted) else mains)]
        for k in range(len(held) - 1, 0, -1):
            held[self.parent[k]] += held[k]
        for k in range(1, len(held)):
            if wraps[k] and (held[k] == held[0] if held[0] else self.name[k] == "form" and 2 * self.size[k] > self.size[0]):
                self.hint[k] = 0
            self.inside.append(int(self.hint[k] == 1 or self.inside[self.parent[k]]))

    @staticmethod
    def hinted(attributes: str) -> int:
        """1: the element is hidden, or one of its names holds nothing but furniture; 2: a name holds such words beside others, or soft ones; 0: none."""
        if not attributes or "=" not in attributes and "hidden" not in attributes:
            return 0
        if HIDDEN.search(attributes):
            return 1
        level = 0
        for x in " ".join(x for m in NAMES.findall(attributes) for x in m).lower().split():
            # A name such as has-sidebar or content-with-sidebar tells of something else than the element itself.
            if not OTHER.match(x) and (found := HINTS.intersection(held := WORDS.findall(x))):
                if found - SOFT and HINTS.union(NEUTRAL).issuperset(held):
                    return 1
                level = 2
        return level

    def put(self, block: int, node: int, text: str, links: int) -> None:
        n = len(text.strip())
        self.pieces.append((block, node, text))
        self.size[node] += n
        self.own[node] += n
        self.linked[node] += n * (links > 0)
        self.marks[node] += bool(n and SENTENCE.search(text))

    def looks(self, k: int) -> tuple[str, ...]:
        """What the model sees of a node."""
        name, own, size = self.name[k], self.own[k], self.size[k]
        kind = "heading" if name in HEADINGS else "text" if name in TEXTS else "item" if name in ITEMS else "main" if name in MAINS else ""
        length = "none" if not own else "short" if own < 25 else "middle" if own < 100 else "long" if own < 400 else "very long"
        share = self.linked[k] / size if size else 0
        links = "none" if share == 0 else "few" if share < 0.3 else "some" if share < 0.7 else "most"
        out = [f"hint {self.hint[k]}", f"length {length}", f"links {links}"]
        return (*out, f"kind {kind}") if kind else tuple(out)  # boxes without a meaning of their own tell nothing

    def edge(self, k: int) -> str:
        return "furniture" if self.inside[k] else "top" if self.name[self.parent[k]] in ("#root", "html", "body") else "inner"

    def lines(self, keep) -> list[tuple[int, str]]:
        """Node and text of each block, of the pieces that are kept; references decoded, white space made one blank."""
        out, block, held, owner = [], None, [], 0
        for b, node, text in [*self.pieces, (None, 0, "")]:
            if b != block:
                if line := " ".join(html.unescape("".join(held)).split()):
                    out.append((owner, line))
                block, held, owner = b, [], node
            if b is not None and keep(node):
                if not held:
                    owner = node
                held.append(text)
        return out


def marked_main(page: Page) -> list[str] | None:
    """The lines inside the one article or main element of a page, but those in furniture (hint 1); None if there isn't exactly one, or if it lies in furniture."""
    tops = [k for k, n in enumerate(page.name) if n in MAINS and page.name[page.parent[k]] not in MAINS]
    if len(tops) != 1 or page.inside[tops[0]]:
        return None
    inside = [False] * len(page.parent)
    for k in range(len(page.parent)):
        inside[k] = (k == tops[0] or k > 0 and inside[page.parent[k]]) and page.hint[k] != 1
    return [line for _, line in page.lines(lambda k: inside[k])]


def count(page: Page, main: list[str], own: bool = False) -> Counter:
    """How often labels send looks and meet along edges on one labelled page; a node with several lines or children follows most of its text.

    Labels that a page gave itself (own) say nothing on what only its name makes furniture within an article.
    """
    unsure = [False] * len(page.parent)
    for k in range(1, len(unsure) if own else 0):
        unsure[k] = page.unsure[k] or unsure[page.parent[k]]
    wanted, yes, total = set(main), [0] * len(page.parent), [0] * len(page.parent)
    for node, line in page.lines(lambda k: not unsure[k]):
        yes[node] += len(line) * (line in wanted)
        total[node] += len(line)
    for k in range(len(page.parent) - 1, 0, -1):
        yes[page.parent[k]] += yes[k]
        total[page.parent[k]] += total[k]
    label, out = [int(2 * y > t) for y, t in zip(yes, total)], Counter()
    for k in range(1, len(page.parent)):
        if total[k]:
            out[f"edge {page.edge(k)} {label[page.parent[k]]}{label[k]}"] += 1
            for look in page.looks(k)[: 1 if page.inside[k] else None]:
                out[f"look {label[k]} {look}"] += 1
    return out


#: What is known without pages, as shares of what a label sends or of what follows a parent's label (0, 1).
KNOWN = {
    "look 0 hint": {"0": 0.5, "1": 0.49, "2": 0.01}, "look 1 hint": {"0": 0.994, "1": 0.001, "2": 0.005},
    "look 0 length": {"none": 0.3, "short": 0.35, "middle": 0.2, "long": 0.1, "very long": 0.05}, "look 1 length": {"none": 0.25, "short": 0.25, "middle": 0.2, "long": 0.2, "very long": 0.1},
    "look 0 links": {"none": 0.4, "few": 0.1, "some": 0.1, "most": 0.4}, "look 1 links": {"none": 0.7, "few": 0.25, "some": 0.04, "most": 0.01},
    "look 0 kind": {"heading": 0.15, "text": 0.43, "item": 0.4, "main": 0.02}, "look 1 kind": {"heading": 0.12, "text": 0.48, "item": 0.3, "main": 0.1},
    "edge top 0": {"0": 0.75, "1": 0.25}, "edge top 1": {"0": 0.5, "1": 0.5}, "edge inner 0": {"0": 0.9, "1": 0.1}, "edge inner 1": {"0": 0.1, "1": 0.9},
    "edge furniture 0": {"0": 1 - 1e-7, "1": 1e-7}, "edge furniture 1": {"0": 1 - 1e-7, "1": 1e-7},
}
#: Weight of what is known beside the pages' own shares; menus, adverts and comments become main text only where labelled pages show it.
WEIGHT = {"look": 0.6, "edge top": 0.1, "edge inner": 0.005, "edge furniture": 0.005}


def model_of(counts: dict[str, float]) -> dict[str, float]:
    """Log potentials: of edges as shares of what follows a parent's label, of looks as shares of what a label sends."""
    out = {}
    for family, known in KNOWN.items():
        edge = family.startswith("edge")
        seen = {x: counts.get(family + ("" if edge else " ") + x, 0) for x in known}
        weight = WEIGHT[family.rsplit(" ", 1)[0] if edge else "look"] if sum(seen.values()) else 1.0
        for x, share in known.items():
            out[family + ("" if edge else " ") + x] = math.log(weight * share + (1 - weight) * seen[x] / max(1, sum(seen.values())))
    return out


def marginals(page: Page, model: dict[str, float]) -> list[float]:
    """Each node's probability of main text: messages from the leaves up, then from the root down."""
    n = len(page.parent)
    own = [[0.0, 0.0] for _ in range(n)]
    for k in range(1, n):
        for look in page.looks(k)[: 1 if page.inside[k] else None]:  # inside furniture only the hint counts
            own[k][0] += model[f"look 0 {look}"]
            own[k][1] += model[f"look 1 {look}"]
    edge = {e: [[model[f"edge {e} {a}{b}"] for b in (0, 1)] for a in (0, 1)] for e in ("top", "inner", "furniture")}
    up = [None] * n

    def passed(e, to_parent, x0, x1):
        out = []
        for y in (0, 1):
            a, b = (e[y][0] + x0, e[y][1] + x1) if to_parent else (e[0][y] + x0, e[1][y] + x1)
            top = max(a, b)
            out.append(top + math.log(math.exp(a - top) + math.exp(b - top)))
        return out

    belief = [list(x) for x in own]
    for k in range(n - 1, 0, -1):
        up[k] = passed(edge[page.edge(k)], True, *belief[k])
        belief[page.parent[k]][0] += up[k][0]
        belief[page.parent[k]][1] += up[k][1]
    for k in range(1, n):
        above = belief[page.parent[k]]
        down = passed(edge[page.edge(k)], False, above[0] - up[k][0], above[1] - up[k][1])
        belief[k][0] += down[0]
        belief[k][1] += down[1]
    return [1 / (1 + math.exp(max(-700.0, min(700.0, b[0] - b[1])))) for b in belief]


def main_text(source: str | None, model: dict[str, float]) -> str:
    page = Page(source or "")
    share = marginals(page, model)
    return "\n".join(line for _, line in page.lines(lambda k: share[k] >= 0.5))


def own_labels(pages: DataFrame) -> DataFrame:
    """html, main: pages that mark their main text themselves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(x, main) for x in batch.column(0).to_pylist() if x and (main := marked_main(Page(x))) is not None]
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.string()), pa.array(["\n".join(m) for _, m in found], pa.string())], ["html", "main"])

    return pages.select("html").mapInArrow(run, "html string, main string")


def self_labelling(pages: DataFrame) -> DataFrame:
    """page_id of the pages that mark their main text themselves; null ids are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array([marked_main(Page(x)) is not None for x in batch.column(1).to_pylist()], pa.bool_()))], ["page_id"])

    # No page without the tag of one is parsed twice.
    tagged = pages.select("page_id", "html").filter(F.col("page_id").isNotNull() & F.col("html").rlike(f"(?i)<({'|'.join(sorted(MAINS))})"))
    return tagged.mapInArrow(run, "page_id long").distinct()


def train(labelled: DataFrame, own: bool = False) -> dict[str, float]:
    """labelled: html, main (the lines of the main text); own: the labels are own_labels()."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = Counter()
        for batch in batches:
            for source, main in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                total += count(Page(source or ""), (main or "").split("\n"), own)
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], ["what", "n"])

    summed = labelled.select("html", "main").mapInArrow(run, "what string, n long").groupBy("what").agg(F.sum("n").alias("n"))
    return model_of({r["what"]: r["n"] for r in summed.collect()})  # about forty sums


def extract(pages: DataFrame, labelled: DataFrame | None = None, max_training_pages: int = 2000) -> DataFrame:
    """One row per row of pages: page_id, url, text, n_chars.

    Null and empty html give an empty text; repeated rows are extracted each; other columns are ignored. The model is
    trained on `labelled` or, without it, on at most max_training_pages of the pages that label themselves (taken by a
    hash of page_id).
    """
    if own := labelled is None:
        ids = self_labelling(pages).orderBy(F.xxhash64("page_id"), "page_id").limit(max_training_pages)
        labelled = own_labels(pages.select("page_id", "html").join(F.broadcast(ids), "page_id"))  # a bounded number of ids
    handle = pages.sparkSession.sparkContext.broadcast(train(labelled, own))  # about forty numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in words.slices(batch, 2, 4 << 20):
                text = [main_text(x, handle.value) for x in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(text, pa.string()), pa.array([len(x) for x in text], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select("page_id", "url", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")

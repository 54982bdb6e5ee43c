"""Main text of web pages by tree scoring.

A page is cut into tags and text by one pattern, and its elements form a tree with the usual implied
ends (a new paragraph ends an open one, a list item the one before).  Elements whose tag, role, class or
id says menu, header, footer, sidebar, notice, advert, form, script, style or reader comments are left
out.  A block that only a form tag or a word of its class or id speaks against stays if it holds half of the
paragraph text, at a lower score; words of names like "has-sidebar" do not count; and where no paragraph is
left, the page is judged again without words.  Every paragraph gives points for its length and commas to its container, half of them to the
container above, a third to the one above that, and so on for 32 containers; a container's points are discounted by the
share of its text that lies in links.  The best container is kept whole, with those of its siblings that
score a fifth of it or are paragraphs of running text; a container inside an article stands for the
whole article.

Text comes out block by block in page order, character references decoded, white space runs (any
Unicode white space) as one space, blocks joined by a newline; a line break ends a block.  A null or
empty page, and a page without text, gives an empty text.  Pages are judged one by one, so null ids,
repeated rows and empty tables need no rule.  A page of any length is held by its task alone and read
forward once, whatever is left unclosed in it.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_right
from collections import defaultdict

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches

TOKEN = re.compile(
    r"""<!--(?:.*?-->|.*)|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*+)(?P<attrs>(?:[^>"']|"[^"]*"|'[^']*')*+)>|</?[a-zA-Z][^>]*>|<[!?][^>]*>""", re.S
)
ATTR = re.compile(r"""([a-zA-Z_:][-\w:.]*)\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")

VOID = set("area base br col embed hr img input link meta param source track wbr".split())
#: Their content is not page text.
RAW = set("script style title textarea noscript iframe template svg math canvas object video audio head".split())
BLOCK = set(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre section select summary table tbody td tfoot th "
    "thead tr ul".split()
)
LEFT_OUT = set("nav footer aside button select dialog menu label input".split())
#: Left out like elements of the words below, unless they hold the page's text.
WEAKLY_OUT = {"form", "fieldset"}
LEFT_OUT_ROLES = set("navigation banner contentinfo complementary search form dialog alert menu menubar".split())
#: Words of a class or an id.
LEFT_OUT_WORDS = set(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice "
    "notices notification alert sidebar sidebars aside widget widgets menu menus nav navbar navigation breadcrumb breadcrumbs "
    "footer foot masthead topbar toolbar comment comments disqus respond reply replies share sharing social related recommended "
    "newsletter subscribe subscription signup login popup popups modal overlay paywall pagination pager skip".split()
)
#: Those of what readers wrote, which may be longer than the article.
READER_WORDS = set("comment comments disqus respond reply replies".split())
#: A class name that begins so tells what is beside or inside an element, not what it is.
BESIDE = re.compile(r"(?:^|\s)(?:has|with|without|no)[-_]\S*", re.I)
HEADER_WORDS = {"header", "head", "top"}
GOOD_WORDS = set("article body content entry main page post story text blog".split())
SCORE = {"article": 25, "main": 15, "div": 5, "section": 3, "td": 3, "pre": 3, "blockquote": 3, "body": 0, "html": -5, "ul": -3, "ol": -3, "li": -3, "dl": -3, "table": -3}
PARAGRAPH = set("p pre td blockquote li dd div section article main body figcaption th dt center".split())
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: An implied end does not pass these.
FENCE = {"li": {"ul", "ol", "menu", "dir"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table", "tr"}, "th": {"table", "tr"}, "option": {"select"}}
COMMA = re.compile("[,;、，؛،]")
KEPT, WEAK, OUT = range(3)
#: Ancestors that a paragraph passes points to.
LEVELS = 32


class Node:
    """An open element.  ``parent`` and ``block`` are blocks: the nearest above, and the nearest or itself."""

    __slots__ = ("tag", "parent", "block", "verdict", "hint", "points", "chars", "linked", "paragraphs", "chosen")

    def __init__(self, tag: str, parent: Node | None, verdict: int, hint: float):
        self.tag, self.parent, self.verdict, self.hint = tag, parent, verdict, hint
        self.block = self if parent is None or tag in BLOCK else parent
        self.points = 0.0
        self.chars = self.linked = self.paragraphs = 0
        self.chosen = False


def judge(tag: str, attrs: str, inside_article: bool, by_words: bool) -> tuple[int, float]:
    """Whether an element is left out, and what its class and id add to its score."""
    if tag in LEFT_OUT or tag == "header" and not inside_article:
        return OUT, 0.0
    verdict, hint = WEAK if tag in WEAKLY_OUT and by_words else KEPT, 0.0
    if not attrs or attrs.isspace():
        return verdict, hint
    whole = tag in ("html", "body", "article", "main")
    for name, a, b, c in ATTR.findall(attrs):
        name, value = name.lower(), a or b or c
        if (
            name == "role" and value.lower() in LEFT_OUT_ROLES or name == "hidden" or name == "aria-hidden" and value == "true"
            or name == "style" and "display:none" in value.replace(" ", "").lower()
        ):
            verdict = verdict if whole else OUT
        elif name in ("class", "id"):
            words = {w.lower() for w in PART.findall(BESIDE.sub(" ", value))}
            good = bool(words & GOOD_WORDS)
            hint += 25 * good
            if by_words and words & READER_WORDS and not whole:
                verdict = OUT
            elif by_words and (words & LEFT_OUT_WORDS or words & HEADER_WORDS and not inside_article):
                verdict = max(verdict, WEAK if tag in BLOCK else OUT) if not whole or tag == "article" and not good else verdict
    return verdict, hint


def blocks_of(page: str, by_words: bool = True) -> tuple[list[tuple[Node, str]], list[Node]]:
    """(container, text) of every block that is not left out, in page order, and all containers.

    The page is read forward once; what is open is found by tag, and sums go up at the end.
    """
    root = Node("html", None, KEPT, 0.0)
    nodes, open_, found = [root], [root], []
    where: dict[str, list[int]] = defaultdict(list)  # places of open elements by tag
    fences = [0]  # places of open blocks other than p
    text: list[str] = []
    size = linked = articles = 0
    at, end, last = 0, len(page), page.rfind(">")
    unclosed = set()

    def close() -> None:
        nonlocal size, linked
        if text and (joined := " ".join("".join(text).split())):
            holder = open_[-1].block
            found.append((holder, joined))
            holder.chars += len(joined)
            holder.linked += round((linked / size if size else 0.0) * len(joined))
            holder.paragraphs += len(joined) * (holder.tag in PARAGRAPH)
        text.clear()
        size = linked = 0

    def say(part: str) -> None:
        nonlocal size, linked
        if part and open_[-1].verdict != OUT:
            part = html.unescape(part)
            text.append(part)
            size += len(part)
            linked += len(part) * bool(where["a"])

    def leave(i: int) -> None:
        nonlocal articles
        for node in open_[i:]:
            where[node.tag].pop()
            articles -= node.tag in ("article", "main")
        del open_[i:]
        while fences[-1] >= len(open_):
            fences.pop()

    def implied_end(tags: set[str], fence: int) -> None:
        """Open elements end from the first of ``tags`` above the fence on."""
        ends = [where[t][k] for t in tags if (k := bisect_right(where[t], fence)) < len(where[t])]
        if ends:
            leave(min(ends))

    while at <= last:  # no tag ends after that
        m = TOKEN.search(page, at)
        if m is None:
            break
        say(page[at : m.start()])
        at = m.end()
        if m["tag"] is None:
            continue
        tag, closing = m["tag"].lower(), bool(m["end"])
        if tag in RAW and not closing:
            if m["attrs"].endswith("/") or tag in unclosed:
                continue
            stop = re.compile(rf"</{re.escape(tag)}\b[^>]*>", re.I).search(page, at)
            if stop is not None:
                at = stop.end()
            elif tag != "head":
                at = end
            else:
                unclosed.add(tag)
            continue
        if tag in BLOCK:
            close()
        if tag in ("br", "hr") or tag in VOID or tag in RAW:
            continue
        if closing:
            if where[tag] and (tag in BLOCK or where[tag][-1] > max(fences[-1], where["p"][-1] if where["p"] else 0)):
                leave(where[tag][-1])
            continue
        if tag in BLOCK:
            implied_end({"p"}, fences[-1])
            if tag in ENDS:
                implied_end(ENDS[tag], max((where[t][-1] for t in FENCE[tag] if where[t]), default=0))
        if tag in ("html", "body"):
            continue
        above = open_[-1]
        verdict, hint = (OUT, 0.0) if above.verdict == OUT else judge(tag, m["attrs"], articles > 0, by_words)
        if verdict == OUT and above.verdict != OUT:
            close()
        if m["attrs"].endswith("/") and tag not in BLOCK and tag != "a":
            continue
        node = Node(tag, above.block, verdict, hint)
        where[tag].append(len(open_))
        if tag in BLOCK:
            nodes.append(node)
            if tag != "p":
                fences.append(len(open_))
        articles += tag in ("article", "main")
        open_.append(node)
    if at < end:
        say(page[at:])
    close()
    return settle(found, nodes)


def settle(found: list[tuple[Node, str]], nodes: list[Node]) -> tuple[list[tuple[Node, str]], list[Node]]:
    """Weakly left out elements stay, at a lower score, if they hold half of the paragraph text; sums of the rest."""
    for node in reversed(nodes[1:]):
        node.parent.paragraphs += node.paragraphs
    whole = nodes[0].paragraphs
    for node in nodes[1:]:
        if node.parent.verdict == OUT or node.verdict == WEAK and node.paragraphs * 2 < max(whole, 1):
            node.verdict = OUT
        elif node.verdict == WEAK:
            node.hint -= 25
    for node in reversed(nodes[1:]):
        if node.verdict != OUT:
            node.parent.chars += node.chars
            node.parent.linked += node.linked
    return [(holder, text) for holder, text in found if holder.verdict != OUT], nodes


def container(node: Node) -> Node:
    """The nearest block that can hold several paragraphs."""
    while node.parent is not None and (node.tag not in SCORE or node.tag in ("pre", "td", "li")):
        node = node.parent
    return node


def main_text(page: str | None) -> str:
    found, nodes = blocks_of(page or "")
    if not any(holder.tag in PARAGRAPH for holder, _ in found):
        found, nodes = blocks_of(page or "", by_words=False)
    if not found:
        return ""
    seen: dict[int, Node] = {}
    for holder, text in found:
        if holder.tag not in PARAGRAPH:
            points = 0.01  # headings and the like decide only where there is nothing else
        else:
            points = (len(text) >= 25) + len(COMMA.findall(text)) + min(len(text) / 100, 3)
        node, share = container(holder if holder.tag not in ("p", "pre", "blockquote") or holder.parent is None else holder.parent), 1
        while node is not None and share <= LEVELS:
            if node.tag in SCORE:
                if id(node) not in seen:
                    seen[id(node)] = node
                    node.points = max(SCORE[node.tag], -5) + node.hint
                node.points += points / share
                share += 1
            node = node.parent
    for node in seen.values():
        node.points *= 1 - node.linked / node.chars if node.chars else 0
    best = max(seen.values(), key=lambda n: n.points)  # ties: the one met first
    top = best
    node = best.parent
    while node is not None:
        if node.tag in ("article", "main") or node.hint > 0 and node.points >= 0.75 * best.points:
            top = node
        node = node.parent
    top.chosen = True
    if top.tag not in ("article", "main") and top.parent is not None:
        for other in nodes:
            if other.parent is top.parent and other is not top and other.verdict != OUT and other.chars:
                density = other.linked / other.chars
                scored = id(other) in seen and other.points >= max(10, best.points * 0.2)
                if scored or other.tag == "p" and density < 0.25 and other.chars > 80 or other.tag in ("h1", "p") and density == 0 and other.chars <= 300:
                    other.chosen = True
    for node in nodes[1:]:  # a block comes after those it stands in
        node.chosen |= node.parent.chosen
    return "\n".join(text for holder, text in found if holder.chosen)


def extract_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars."""

    def batch(rows: dict) -> dict:
        texts = [main_text(page) for page in rows["html"]]
        return {"page_id": rows["page_id"], "url": rows["url"], "text": texts, "n_chars": [len(t) for t in texts]}

    return map_batches(pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html"), "page_id long, url string, text string, n_chars long", batch)

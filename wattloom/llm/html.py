"""Main text of web pages by a tree-structured graphical model.

A page becomes its tree of elements. Each element has a hidden state (content or not); its own features vote
for a state, and a potential connects it with its parent. Sum-product messages, first from the leaves to the
root and then back, give the exact probability of each state. Weights are learned from labelled pages by the
gradient of the log likelihood, which needs the same marginals. The labelled pages are built here from layouts
of many kinds; further ones can be given (``data-content`` of "1" or "0" on the elements).

Text of elements that are content is kept by block: character references decoded, white space of a block one
space, blocks in page order joined by a line break. Titles, scripts, styles, comments and the like are no text. The head is no element of the
tree: what may stand in it has no text, and anything else ends it, with or without its tags.

A null or empty page gives an empty text. Cut pages are read as far as they go; a tag cut off at the end is
left out. Repeated rows give repeated results; other columns are ignored.
"""

from __future__ import annotations

import html
import math
import pickle
import random
import re
from functools import lru_cache

from pyspark.sql import DataFrame

from wattloom.llm.common import columns_of, map_batches

SCHEMA = "page_id bigint, url string, text string, n_chars bigint"

VOID = set("area base br col embed hr img input link meta param source track wbr".split())
DROPPED = set("script style template svg iframe noscript object canvas select textarea annotation annotation-xml".split())
RAW = set("script style textarea title".split())
INLINE = set("a abbr acronym b bdi bdo big br cite code data del dfn em font i img input ins kbd label mark q ruby s samp "
             "small span strike strong sub sup time tt u var wbr math menclose merror mfenced mfrac mi mmultiscripts mn mo mover mpadded "
             "mphantom mroot mrow ms mspace msqrt mstyle msub msubsup msup mtable mtd mtext mtr munder munderover semantics".split())
#: Opening one of the keys ends an open element of the values, unless a stopping element lies between
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
          "option": {"option"}}
CLOSE_P = set("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main "
              "nav ol p pre section table ul".split())
STOPS = set("article aside body div dl footer form header main nav ol section table td th ul".split())
GROUPS = {"article": "article", "main": "article", "section": "box", "div": "box", "p": "p", "h1": "h1", "h2": "h", "h3": "h",
          "h4": "h", "h5": "h", "h6": "h", "nav": "nav", "menu": "nav", "header": "header", "footer": "footer", "aside": "aside",
          "form": "form", "fieldset": "form", "button": "form", "dialog": "aside", "ul": "list", "ol": "list", "dl": "list",
          "li": "item", "dt": "item", "dd": "item", "a": "a", "table": "table", "tbody": "table", "tr": "table", "td": "cell",
          "th": "cell", "blockquote": "p", "pre": "p", "figure": "figure", "figcaption": "figure", "body": "root", "html": "root"}
#: Parts of class, id and role that say what an element is for
HINTS = {"ad": "ad ads advert adverts advertisement banner promo sponsor sponsored", "nav": "nav navbar navigation menu breadcrumb "
         "breadcrumbs toc pagination pager", "side": "sidebar side aside rail widget complementary", "talk": "comment comments reply "
         "replies disqus discussion respond reviews feedback", "foot": "footer foot copyright contentinfo legal", "head": "header "
         "masthead topbar logo branding", "notice": "cookie cookies consent notice gdpr popup modal overlay alert dialog privacy",
         "form": "form login signup subscribe newsletter search register", "share": "share social related recommended tags meta "
         "byline author trending", "main": "article content main post entry story body text prose"}
_HINT = {w: k for k, ws in HINTS.items() for w in ws.split()}
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?][^>]*(?:>|\Z)|<(?=[a-zA-Z/])[^<]*\Z",
                    re.S)
_ATTRIBUTE = re.compile(r"\b(class|id|role|data-content|hidden|style)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
_PARTS = re.compile(r"[a-z]+")
#: Marks the end of a block among the pieces of text; no text equals it
BREAK = None


class Node:
    __slots__ = ("tag", "parent", "children", "hints", "label", "own", "links", "size", "linked", "features")

    def __init__(self, tag: str, parent: Node | None, attributes: str = ""):
        self.tag, self.parent, self.children, self.hints, self.label = tag, parent, [], (), None
        self.own = self.links = self.size = self.linked = 0
        self.features: list[str] = []
        if attributes and not attributes.isspace():
            found = set()
            for name, a, b, c in _ATTRIBUTE.findall(attributes):
                value, name = (a or b or c).lower(), name.lower()
                if name == "data-content":
                    self.label = value == "1"
                elif name == "hidden" or name == "style" and "display:none" in value.replace(" ", ""):
                    found.add("hidden")
                elif name != "style":
                    found.update(_HINT[p] for p in _PARTS.findall(value) if p in _HINT)
            self.hints = tuple(sorted(found))


def parse(page: str) -> tuple[list[Node], list[tuple[Node, str | None]]]:
    """Nodes in document order (parents first) and the pieces of text with their element. ``BREAK`` marks
    the end of a block in the pieces. Of the elements without text, only a script or style that never ends
    takes the rest of the page; of others the tag is left out, and of a title or text area what comes before the next tag."""
    top, unclosed = Node("html", None), set()
    nodes, pieces, at, here, end = [top], [], 0, top, len(page)
    while at < end:
        m = _TOKEN.search(page, at)
        start = m.start() if m else end
        if start > at:
            pieces.append((here, html.unescape(page[at:start])))
        if not m:
            break
        at, tag = m.end(), (m[2] or "").lower()
        if not tag:
            continue
        if m[1]:
            up = here
            while up is not None and up.tag != tag:
                up = None if tag == "p" and up.tag in STOPS else up.parent
            if up is not None and up.parent is not None:
                here = up.parent
            if tag not in INLINE:
                pieces.append((here, BREAK))
            continue
        if tag in DROPPED or tag in RAW:
            if not m[3].endswith("/"):
                close = None if tag in unclosed else re.compile(f"</{re.escape(tag)}\\s*>", re.I).search(page, at)
                if close:
                    at = close.end()
                else:
                    unclosed.add(tag)
                    if tag in ("script", "style"):
                        at = end
                    elif tag in RAW:
                        at = end if (following := page.find("<", at)) < 0 else following
            continue
        if tag in ("html", "head"):
            continue
        if tag in VOID:
            pieces.append((here, " " if tag in INLINE else BREAK))
            continue
        close = CLOSES.get(tag) or ({"p"} if tag in CLOSE_P else None)
        if close:
            up = here
            while up.parent is not None and up.tag not in close and up.tag not in STOPS:
                up = up.parent
            if up.tag in close and up.parent is not None:
                here = up.parent
        node = Node(tag, here, m[3])
        here.children.append(node)
        nodes.append(node)
        if tag not in INLINE:
            pieces.append((here, BREAK))
        if not m[3].endswith("/"):
            here = node
    return nodes, pieces


def describe(nodes: list[Node], pieces: list[tuple[Node, str | None]]) -> None:
    """Features of every node."""
    for node, text in pieces:
        if text is BREAK:
            continue
        n = len(text.strip())
        node.own += n
        if node.tag == "a":
            node.links += n
    for node in reversed(nodes):
        node.size += node.own
        node.linked += node.size if node.tag == "a" else 0
        if node.parent is not None:
            node.parent.size += node.size
            node.parent.linked += node.linked
    for node in nodes:
        group = GROUPS.get(node.tag, "inline" if node.tag in INLINE else "other")
        length = "0" if not node.own else "s" if node.own < 25 else "m" if node.own < 120 else "l"
        links = "no" if not node.size else "few" if node.linked * 10 < node.size * 3 else "many" if node.linked * 10 < node.size * 8 else "all"
        node.features = ["bias", "tag:" + group, "own:" + length, "links:" + links, f"tag:{group}:links:{links}",
                         *("hint:" + h for h in node.hints)]


class TreeModel:
    """Log-linear model over (state of parent, state) and (feature, state content)."""

    def __init__(self):
        self.vote: dict[str, float] = {}
        self.pair = {(s, t): 0.0 for s in (0, 1) for t in (0, 1)}

    def marginals(self, nodes: list[Node]) -> tuple[list[float], list[tuple]]:
        """Probability of content of each node, and of the pairs (parent, node) for training."""
        place = {id(n): i for i, n in enumerate(nodes)}
        vote, e = self.vote, math.exp
        p00, p01, p10, p11 = (e(self.pair[k]) for k in ((0, 0), (0, 1), (1, 0), (1, 1)))
        up = [1.0] * len(nodes)                       # ratio content : other of a node and all below it
        ratio = [e(max(-30.0, min(30.0, sum(vote.get(f, 0.0) for f in n.features)))) for n in nodes]
        message = [1.0] * len(nodes)                  # the same, sent to the parent
        for i in range(len(nodes) - 1, -1, -1):
            r = up[i] = min(1e30, max(1e-30, up[i] * ratio[i]))
            parent = nodes[i].parent
            if parent is not None:
                message[i] = (p10 + p11 * r) / (p00 + p01 * r)
                j = place[id(parent)]
                up[j] = min(1e30, max(1e-30, up[j] * message[i]))
        belief = [0.0] * len(nodes)
        pairs = []
        belief[0] = up[0]
        for i in range(1, len(nodes)):
            j = place[id(nodes[i].parent)]
            rest = belief[j] / message[i]             # what the parent hears from elsewhere
            joint = (p00, p01 * up[i], p10 * rest, p11 * rest * up[i])
            belief[i] = min(1e30, max(1e-30, (joint[1] + joint[3]) / (joint[0] + joint[2])))
            pairs.append(joint)
        return [b / (1 + b) for b in belief], pairs

    def fit(self, pages: list[str], rounds: int = 30, rate: float = 0.4, shrink: float = 1e-4) -> TreeModel:
        trees = []
        for page in pages:
            nodes, pieces = parse(page)
            describe(nodes, pieces)
            for n in nodes:
                n.label = (n.parent.label if n.parent else False) if n.label is None else n.label
            trees.append(nodes)
        size: dict = {}
        for _ in range(rounds):
            for nodes in trees:
                p, pairs = self.marginals(nodes)
                step: dict = {}
                for n, q in zip(nodes, p):
                    for f in n.features:
                        step[f] = step.get(f, 0.0) + n.label - q
                for n, joint in zip(nodes[1:], pairs):
                    total = sum(joint)
                    for k, key in enumerate(((0, 0), (0, 1), (1, 0), (1, 1))):
                        step[key] = step.get(key, 0.0) + ((n.parent.label, n.label) == (bool(key[0]), bool(key[1]))) - joint[k] / total
                for key, g in step.items():
                    size[key] = size.get(key, 1.0) + g * g
                    held = self.vote if isinstance(key, str) else self.pair
                    held[key] = held.get(key, 0.0) * (1 - shrink) + rate * g / math.sqrt(size[key])
        return self

    def text(self, page: str | None) -> str:
        if not page:
            return ""
        nodes, pieces = parse(page)
        describe(nodes, pieces)
        content = {id(n) for n, p in zip(nodes, self.marginals(nodes)[0]) if p >= 0.5}
        blocks, held = [], []
        for node, text in [*pieces, (nodes[0], BREAK)]:
            if text is BREAK:
                if held and (block := " ".join("".join(held).split())):
                    blocks.append(block)
                held = []
            elif id(node) in content or text == " ":
                held.append(text)
        return "\n".join(blocks)


# labelled pages -----------------------------------------------------------------------------------

def labelled_pages(n: int = 240, seed: int = 5) -> list[str]:
    """Pages of many layouts with ``data-content`` on what is or is not content."""
    r = random.Random(seed)

    def words(lo, hi):
        return " ".join("".join(r.choice("bcdfglmnprst") + r.choice("aeiou") for _ in range(r.randint(1, 4)))
                        for _ in range(r.randint(lo, hi)))

    def box(tag, inside, content=None, names=()):
        name = f' {r.choice(("class", "id"))}="{r.choice(names)}"' if names and r.random() < 0.85 else ""
        label = "" if content is None else f' data-content="{int(content)}"'
        return f"<{tag}{name}{label}>{inside}</{tag}>"

    def links(k):
        return "".join(f'<li><a href="/x">{words(1, 3)}</a></li>' for _ in range(k))

    def paragraphs(k):
        out = ""
        for _ in range(k):
            kind = r.random()
            body = words(1, 70)
            out += f"<p>{body}</p>" if kind < 0.6 else f"<p>{body} <a href='/y'>{words(1, 3)}</a> <b>{words(1, 4)}</b> {words(2, 30)}</p>" \
                if kind < 0.75 else f"<h2>{words(1, 6)}</h2>" if kind < 0.82 else f"<ul><li>{words(2, 20)}</li><li>{words(2, 9)}</li></ul>" \
                if kind < 0.89 else f"<blockquote>{body}</blockquote>" if kind < 0.93 else f"<table><tr><td>{words(1, 4)}</td><td>{words(1, 4)}</td></tr></table>" \
                if kind < 0.96 else f"<p><b>{body}<br>"
        return out
    hints = {k: [*v.split(), f"{v.split()[0]}-box", f"site-{v.split()[0]}"] for k, v in HINTS.items()}
    unwanted = [
        lambda: box("nav", f"<ul>{links(r.randint(2, 8))}</ul>", False), lambda: box("div", f"<ul>{links(r.randint(2, 8))}</ul>", False, hints["nav"]),
        lambda: box("header", f"<a href='/'>{words(1, 3)}</a><p>{words(1, 8)}</p>", False), lambda: box("div", f"<p>{words(1, 6)}</p>", False, hints["head"]),
        lambda: box("aside", f"<h3>{words(1, 3)}</h3><p>{words(3, 30)}</p><ul>{links(3)}</ul>", False),
        lambda: box("div", f"<h3>{words(1, 3)}</h3><p>{words(3, 40)}</p>", False, hints["side"]),
        lambda: box("div", words(3, 40), False, hints["ad"]), lambda: box("div", f"<p>{words(3, 40)}</p>", False, hints["ad"]),
        lambda: box("div", f"<p>{words(4, 30)}</p><button>{words(1, 2)}</button>", False, hints["notice"]),
        lambda: box("form", f"<label>{words(1, 4)}</label><input name='q'><button>{words(1, 2)}</button>", False),
        lambda: box("div", f"<p>{words(3, 12)}</p><form><input><button>{words(1, 1)}</button></form>", False, hints["form"]),
        lambda: box("div", words(2, 12) + f"<a href='/s'>{words(1, 2)}</a>", False, hints["share"])]
    after = [
        lambda: box("footer", f"<p>{words(3, 25)}</p>", False), lambda: box("footer", words(3, 25), False),
        lambda: box("div", f"<p>{words(3, 25)}</p>", False, hints["foot"]),
        lambda: box("section", f"<h3>{words(1, 3)}</h3>" + "".join(f"<div class='comment'><p>{words(3, 40)}</p></div>" for _ in range(r.randint(1, 4))), False, hints["talk"]),
        lambda: box("div", f"<ul>{''.join(f'<li><p>{words(3, 40)}</p></li>' for _ in range(r.randint(1, 4)))}</ul>", False, hints["talk"])]
    pages = []
    for _ in range(n):
        body = paragraphs(r.randint(1, 12))
        inner = body
        if r.random() < 0.35:                                # something unwanted among the paragraphs
            inner += r.choice(unwanted + after)() + paragraphs(r.randint(0, 3))
        title = f"<h1>{words(1, 10)}</h1>"
        kind = r.random()
        if kind < 0.55:
            main = box("article", title + inner, True)
        elif kind < 0.7:
            main = box("main", box("article", title + inner, True), r.random() < 0.0)
        elif kind < 0.9:
            main = box("div", title + inner, True, hints["main"])
        else:
            main = box("main", title + inner, True)
        if r.random() < 0.3:
            main = box("div", main, False, ["wrap", "page", "container", "layout"])
        before = "".join(r.choice(unwanted)() for _ in range(r.randint(0, 4)))
        end = "".join(r.choice(unwanted + after * 3)() for _ in range(r.randint(0, 4)))
        pages.append(f"<html><head><title>{words(1, 5)}</title></head><body data-content='0'>{before}{main}{end}</body></html>")
    return pages


@lru_cache(maxsize=1)
def _loaded(raw: bytes) -> TreeModel:
    return pickle.loads(raw)


@lru_cache(maxsize=1)
def trained() -> TreeModel:
    return TreeModel().fit(labelled_pages())


def main_text(pages: DataFrame, model: TreeModel | None = None) -> DataFrame:
    """page_id, url, text, n_chars of each page; needs no shuffle. The model is some hundred weights."""
    raw = pickle.dumps(model or trained())

    def rows(cols):
        m = _loaded(raw)
        texts = [m.text(p) for p in cols["html"]]
        return {"page_id": cols["page_id"], "url": cols["url"], "text": texts, "n_chars": [len(t) for t in texts]}
    return map_batches(columns_of(pages, "page_id", "url", "html"), SCHEMA, rows)

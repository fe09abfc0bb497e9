"""Main text of web pages by a tree-structured graphical model over the DOM.

Every block element and every run of text in one is a node with a hidden label, content or not. A node's own
potential is a weighted sum of features of its tag, its class words and its text; parent-child potentials connect
the labels. Sum-product messages upward and downward give each node's exact marginal, and runs of text that are
more likely content than not are the page's text. Weights and potentials maximise the likelihood of labelled
pages (`labelled_pages`), whose gradient is the marginals' difference to the labels.

Null and empty pages, and pages without content, give an empty text. Repeated rows are read each for itself; an
empty table gives no rows; other columns are kept, but for one named like the result. Very long pages are read whole,
in time in proportion to their length. Broken markup is read as far as Python's parser makes sense of it, never
refused: an element left open ends with what holds it, a paragraph, a button or a head with the next block.
A text equally likely to be content and not is left out.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterable
from dataclasses import dataclass, field
from functools import lru_cache
from html.parser import HTMLParser

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinweave.llm.common import add_columns, table

#: Elements inside a line of text; all others are blocks, but for those within a drawing or a formula.
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark math nobr object q s samp"
    " small span strike strong sub sup svg time tt u var wbr".split()
)
FOREIGN = ("svg", "math")
#: Elements whose text is markup, a script, a form's controls, or shown only where the element itself is not. What
#: stands around one in a line stays one line.
UNSEEN = frozenset(
    "script style template head title desc noscript select option optgroup textarea datalist button canvas audio video"
    " iframe".split()
)
#: Elements of a head; any other ends it.
HEAD = frozenset("head title style script template noscript meta link base".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that end an open element of the first kind when they begin.
_ENDS = {
    "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"),
    "th": ("td", "th"), "tbody": ("tr", "td", "th", "thead", "tbody"), "tfoot": ("tr", "td", "th", "thead", "tbody"),
}
_SCOPE = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("table",), "th": ("table",)}
#: Elements that a form's choices hold; any other element ends them.
_CHOICES = frozenset("option optgroup hr".split())
TEXT = "#text"
#: Kinds of edges, by the child: each has its own potentials.
KINDS = {TEXT: 1} | dict.fromkeys("nav aside footer header form".split(), 2) | dict.fromkeys(
    "ul ol li dl dt dd table tbody tr td th".split(),
    3,
)
KINDS |= dict.fromkeys("article main section".split(), 4)
N_KINDS = 5


class _Reader(HTMLParser):
    """Nodes in page order: parent, tag, class words, text and linked characters.

    Where an element ends an open one is looked up by the places of open elements of each tag, so that reading
    takes time in proportion to the page, however its elements nest and whatever is left open.
    """

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.parent, self.tag, self.words = [-1], ["#root"], [()]
        self.text: dict[int, list[str]] = {}
        self.linked: dict[int, int] = {}
        #: Tag, the block that it is or stands in, and whether it stands in a line.
        self.open: list[tuple[str, int, bool]] = [("#root", 0, False)]
        self.places: dict[str, list[int]] = {}  # where elements of a tag are open
        self.blocks: list[int] = []  # where blocks other than paragraphs are open
        self.unseen = 0
        self.links = 0
        self.run = -1

    def _add(self, tag: str, words: tuple) -> int:
        self.parent.append(self.open[-1][1])
        self.tag.append(tag)
        self.words.append(words)
        return len(self.tag) - 1

    def _last(self, tags: Iterable[str]) -> int:
        """The place of the innermost open element of these tags, 0 for none."""
        return max((self.places[t][-1] for t in tags if self.places.get(t)), default=0)

    def _close(self, at: int) -> None:
        for tag, _, inline in reversed(self.open[at:]):
            self.places[tag].pop()
            self.unseen -= tag in UNSEEN
            self.links -= tag == "a"
            if not inline:
                self.run = -1
                if tag != "p":
                    self.blocks.pop()
        del self.open[at:]

    def _end_by(self, tag: str) -> None:
        """Close what the start of a block ends."""
        if self.places.get("button"):
            self._close(self.places["button"][0])
        scope = self._last(_SCOPE.get(tag, ()))
        ended = [x for t in _ENDS.get(tag, ()) for x in self.places.get(t, ())[-1:] if x > scope]
        # A cell ends the cell beside it; a row or a table's part ends its row and the cells of that.
        if ended:
            self._close(min(ended))
        if self._last("p") > max(scope, self.blocks[-1] if self.blocks else 0):
            self._close(self._last("p"))

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag not in HEAD and self.places.get("head"):
            self._close(self.places["head"][0])
        if tag not in _CHOICES and self._last(("select", "datalist")):
            self._close(self._last(("select", "datalist")))
        inline = tag in INLINE or tag in UNSEEN or bool(self._last(FOREIGN))
        if not inline:
            self.run = -1
            self._end_by(tag)
        elif tag == "br" and self.run >= 0:
            self.text[self.run].append(" ")
        if tag in VOID:
            return
        if inline:
            block = self.open[-1][1]
        else:
            block = self._add(tag, _class_words(" ".join(v for k, v in attrs if k in ("class", "id", "role") and v)))
            if tag != "p":
                self.blocks.append(len(self.open))
        self.places.setdefault(tag, []).append(len(self.open))
        self.open.append((tag, block, inline))
        self.unseen += tag in UNSEEN
        self.links += tag == "a"

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self._close(len(self.open) - 1)

    def handle_endtag(self, tag: str) -> None:
        at = self._last((tag,))
        if at and not (self.open[at][2] and at < max(self._last("p"), self.blocks[-1] if self.blocks else 0)):
            self._close(at)

    def handle_data(self, data: str) -> None:
        if self.unseen:
            if self.open[-1][0] != "head" or not data.strip():
                return
            self._close(len(self.open) - 1)
        if self.run < 0:
            if not data.strip():
                return
            self.run = self._add(TEXT, ())
            self.text[self.run] = []
            self.linked[self.run] = 0
        self.text[self.run].append(data)
        if self.links:
            self.linked[self.run] += len(data)


@lru_cache(4096)
def _class_words(said: str) -> tuple[str, ...]:
    parts = re.sub(r"([a-z])([A-Z])", r"\1 \2", said)
    return tuple(dict.fromkeys(w.lower() for w in re.findall(r"[A-Za-z]+", parts)))


def read(html: str | None) -> tuple[list[int], list[list[str]], dict[int, str]]:
    """(parent of each node, its features, text of the nodes that are runs of text)."""
    reader = _Reader()
    if html:
        reader.feed(html)
        reader.close()
    texts = {i: " ".join("".join(t).split()) for i, t in reader.text.items()}
    below = [[0, 0] for _ in reader.tag]  # characters and linked characters under a node
    for i in range(len(reader.tag) - 1, -1, -1):
        if i in texts:
            below[i] = [len(texts[i]), min(len(texts[i]), reader.linked[i])]
        if i:
            up = below[reader.parent[i]]
            up[0] += below[i][0]
            up[1] += below[i][1]
    features = []
    for i, tag in enumerate(reader.tag):
        chars, linked = below[i]
        link = "none" if not linked else "some" if linked * 2 < chars else "most"
        own = [f"link {link}", f"size {min(chars.bit_length(), 11)}"]
        up = reader.tag[reader.parent[i]] if i else ""
        if tag == TEXT:
            t = texts[i]
            own = [TEXT, *(f"text {x}" for x in own), f"text in {up}", "ends" if t[-1:] in ".!?:;\"'" else "open"]
        else:
            own = [f"tag {tag}", "bias", *own, f"tag {tag} in {up}", *(f"word {w}" for w in reader.words[i])]
            own += [f"begins {w[:n]}" for w in reader.words[i] for n in (4, 7) if len(w) > n]
        features.append(own)
    return reader.parent, features, texts


@dataclass
class Forest:
    """Many trees as one: parents before children; `levels` are the nodes by depth."""

    parent: np.ndarray
    kind: np.ndarray
    levels: list[np.ndarray]
    row: np.ndarray
    place: np.ndarray

    @classmethod
    def of(cls, pages: list[tuple[list[int], list[list[str]]]], names: dict[str, int]) -> Forest:
        parent, kind, row, place, base = [], [], [], [], 0
        depth: list[int] = []
        for up, features in pages:
            for i, f in enumerate(features):
                parent.append(up[i] + base if up[i] >= 0 else -1)
                depth.append(depth[up[i] + base] + 1 if up[i] >= 0 else 0)
                kind.append(KINDS.get(f[0].removeprefix("tag "), 0))
                for x in f:
                    if x in names:
                        row.append(base + i)
                        place.append(names[x])
            base += len(features)
        d = np.array(depth, np.int64)
        order = np.argsort(d, kind="stable")
        levels = np.split(order, np.flatnonzero(np.diff(d[order])) + 1) if len(d) else []
        return cls(
            np.array(parent, np.int64),
            np.array(kind, np.int64),
            levels,
            np.array(row, np.int64),
            np.array(place, np.int64),
        )


@dataclass
class Model:
    """Weights by feature, and log potentials [kind of the child][parent's label][child's label]."""

    names: dict[str, int] = field(default_factory=dict)
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    pairs: np.ndarray = field(default_factory=lambda: np.zeros((N_KINDS, 2, 2)))

    def marginals(self, f: Forest) -> tuple[np.ndarray, np.ndarray]:
        """P(content) of every node, and P(parent's label, own label) of every node but the roots."""
        n = len(f.parent)
        own = np.zeros((n, 2))
        own[:, 1] = np.bincount(f.row, self.weights[f.place], minlength=n) if len(f.row) else 0
        edge = self.pairs[f.kind]
        belief = own.copy()  # with the messages from below
        sent = np.zeros((n, 2))
        for nodes in reversed(f.levels[1:]):
            x = edge[nodes] + belief[nodes][:, None, :]
            sent[nodes] = np.logaddexp(x[:, :, 0], x[:, :, 1])
            np.add.at(belief, f.parent[nodes], sent[nodes])
        full = belief.copy()  # with the messages from above as well
        both = np.zeros((n, 2, 2))
        for nodes in f.levels[1:]:
            above = full[f.parent[nodes]] - sent[nodes]
            x = above[:, :, None] + edge[nodes]
            full[nodes] += np.logaddexp(x[:, 0], x[:, 1])
            joint = x + belief[nodes][:, None, :]
            joint -= joint.max(axis=(1, 2), keepdims=True)
            joint = np.exp(joint)
            both[nodes] = joint / joint.sum(axis=(1, 2), keepdims=True)
        return 1 / (1 + np.exp(np.clip(full[:, 0] - full[:, 1], -60, 60))), both

    def extract(self, pages: list[str | None]) -> list[str]:
        """The text of every page."""
        trees = [read(p) for p in pages]
        content, _ = self.marginals(Forest.of([t[:2] for t in trees], self.names))
        out, base = [], 0
        for up, _, texts in trees:
            out.append("\n".join(t for i, t in texts.items() if t and content[base + i] > 0.5))
            base += len(up)
        return out


def train(pages: list[tuple[str, set[str]]], steps: int = 100, rate: float = 0.1, decay: float = 1e-3) -> Model:
    """Fit to pages with the set of texts of their content blocks; an element is content if some of it is."""
    trees = [read(html) for html, _ in pages]
    label: list[int] = []
    for (up, _, texts), (_, good) in zip(trees, pages, strict=True):
        own = [int(texts.get(i) in good) for i in range(len(up))]
        for i in range(len(up) - 1, 0, -1):
            own[up[i]] |= own[i]
        label += own
    counts: dict[str, int] = {}
    for _, features, _ in trees:
        for f in features:
            for x in f:
                counts[x] = counts.get(x, 0) + 1
    names = {x: i for i, x in enumerate(sorted(x for x, n in counts.items() if n >= 3))}
    forest, y = Forest.of([t[:2] for t in trees], names), np.array(label)
    model = Model(names, np.zeros(len(names)), np.zeros((N_KINDS, 2, 2)))
    child = np.flatnonzero(forest.parent >= 0)
    seen = np.zeros((N_KINDS, 2, 2))
    np.add.at(seen, (forest.kind[child], y[forest.parent[child]], y[child]), 1)
    held = np.bincount(forest.place, y[forest.row], minlength=len(names))
    cells = 4 * N_KINDS
    m, v = np.zeros(len(names) + cells), np.zeros(len(names) + cells)
    for step in range(1, steps + 1):
        p, both = model.marginals(forest)
        expected = np.zeros((N_KINDS, 2, 2))
        for k in range(N_KINDS):
            expected[k] = both[child][forest.kind[child] == k].sum(axis=0)
        gw = np.bincount(forest.place, p[forest.row], minlength=len(names)) - held
        grad = np.append(gw, (expected - seen).ravel()) / len(pages)
        grad += decay * np.append(model.weights, model.pairs.ravel())
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        move = rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        model.weights = model.weights - move[:-cells]
        model.pairs = model.pairs - move[-cells:].reshape(N_KINDS, 2, 2)
    return model


#: Class words of labelled pages, by what their elements hold.
_CONTENT_WORDS = "content main article post entry body text story page container wrapper row column hentry".split()
_OTHER_WORDS = {
    "menu": "nav menu navbar navigation breadcrumb breadcrumbs topbar links tabs pagination pager toc".split(),
    "header": "header masthead banner logo brand site top hero".split(),
    "footer": "footer copyright legal bottom colophon imprint".split(),
    "side": "sidebar aside widget related recommended trending popular more rail secondary".split(),
    "notice": "cookie cookies consent notice alert gdpr privacy popup modal overlay message warning banner".split(),
    "ad": "ad ads advert advertisement sponsored sponsor promo promotion adsense partner".split(),
    "form": "form newsletter subscribe signup search login subscription field".split(),
    "share": "share social sharing tools meta tags byline author toolbar buttons".split(),
    "comments": "comments comment commentlist replies reply discussion respond thread disqus readers responses".split(),
}


def labelled_pages(n: int = 800, seed: int = 5) -> list[tuple[str, set[str]]]:
    """Generated pages of many layouts with the texts of their article's blocks.

    The words mean nothing; only tags, class words, links and lengths can tell content from the rest.
    """
    r = random.Random(seed)
    serial = 0

    def words(lo: int, hi: int, end: str = "") -> str:
        nonlocal serial
        serial += 1
        made = ["".join(r.choice("abdegiklmnoprstu") for _ in range(r.randint(2, 9))) for _ in range(r.randint(lo, hi))]
        made[-1] += f"x{serial}" + end
        return " ".join(made).capitalize()

    def named(kind: list[str]) -> str:
        if r.random() < 0.25:
            return ""
        said = r.choice("- _").join(r.sample(kind, r.choice((1, 1, 2))))
        return f' {r.choice(("class", "class", "id"))}="{said}"'

    def links(k: int) -> str:
        rows = "".join(f'<li><a href="/{i}">{words(1, 4)}</a></li>' for i in range(k))
        return f"<ul>{rows}</ul>" if r.random() < 0.8 else rows.replace("<li>", "<span>").replace("</li>", "</span>")

    def other(kind: str) -> str:
        said = named(_OTHER_WORDS[kind])
        if kind == "menu":
            tag = r.choice(("nav", "nav", "div", "table"))
            if tag == "table":
                cells = "".join(f'<td><a href="/{i}">{words(1, 4)}</a>' for i in range(r.randint(3, 9)))
                return f"<table{said}><tr>{cells}</table>"
            return f"<{tag}{said if tag == 'nav' else said or ' class=menu'}>{links(r.randint(3, 9))}</{tag}>"
        if kind == "header":
            return f"<header{said}><p>{words(1, 6)}</p>{other('menu') if r.random() < 0.6 else links(4)}</header>"
        if kind == "footer":
            inner = f"&copy; {words(2, 20, r.choice(('', '.')))}"
            inner = f"<p>{inner}</p>{links(4)}" if r.random() < 0.5 else inner
            tag = r.choice(("footer", "footer", "div"))
            return f"<{tag}{said or (' class=footer' if tag == 'div' else '')}>{inner}</{tag}>"
        tag = {"side": "aside", "comments": "section"}.get(kind, "div")
        tag = tag if r.random() < 0.6 else "div"
        if tag != "aside" and not said:
            said = f' class="{_OTHER_WORDS[kind][0]}"'
        if kind == "side":
            inner = f"<h3>{words(1, 4)}</h3>" + (links(5) if r.random() < 0.6 else f"<p>{words(5, 40, '.')}</p>")
        elif kind == "form":
            inner = f"<p>{words(2, 12, '.')}</p><label>{words(1, 3)}</label><input name=q><button>{words(1, 2)}</button>"
            inner = f"<form>{inner}</form>"
            if r.random() < 0.4:
                return inner
        elif kind == "share":
            inner = "".join(f"<a href=#>{words(1, 2)}</a> " for _ in range(r.randint(2, 5)))
        elif kind == "comments":
            t = r.choice(("div", "li", "article"))
            own = "".join(
                f"<{t}{named(_OTHER_WORDS[kind])}>"
                + (f"<p>{words(4, 60, '.')}</p>" if r.random() < 0.7 else words(1, 40, "."))
                + (f"<span>{words(1, 3)}</span>" if r.random() < 0.3 else "")
                + f"</{t}>"
                for _ in range(r.randint(1, 6))
            )
            h = r.choice(("h2", "h3", "h4", "p"))
            inner = f"<{h}>{words(1, 3)}</{h}>" if r.random() < 0.8 else ""
            inner += f"<ol{named(_OTHER_WORDS[kind])}>{own}</ol>" if t == "li" else own
        else:
            inner = words(3, 40, ".")
            inner = f"<p>{inner}</p>" if r.random() < 0.5 else inner
            inner += f"<a href=#>{words(1, 3)}</a>" if r.random() < 0.3 else ""
        return f"<{tag}{said}>{inner}</{tag}>"

    pages = []
    for _ in range(n):
        good: set[str] = set()

        def keep(text: str, good: set[str] = good) -> str:
            good.add(text)
            return text

        def block(keep=keep) -> str:
            x = r.random()
            if x < 0.7:
                t = keep(words(1, 90, r.choice((".", ".", ".", "!", ""))))
                if r.random() < 0.25:
                    return f"<p><b>{t}<br>"
                if r.random() < 0.1:
                    return f"<p>{t}<button>{words(1, 2)}</button>"
                if r.random() < 0.25:
                    cut_at = t.rfind(" ")
                    return f'<p>{t[: cut_at + 1]}<a href="/x">{t[cut_at + 1 :]}</a></p>'
                return f"<p>{t}</p>"
            if x < 0.78:
                return f"<h2>{keep(words(1, 8))}</h2>"
            if x < 0.86:
                t = r.choice(("ul", "ol"))
                return f"<{t}>" + "".join(f"<li>{keep(words(1, 15))}" for _ in range(r.randint(2, 5))) + f"</{t}>"
            if x < 0.92:
                return f"<blockquote>{keep(words(5, 30, '.'))}</blockquote>"
            if x < 0.96:
                return f"<table><tr><td>{keep(words(1, 4))}<td>{keep(words(1, 4))}</table>"
            return f"<figure><img src=x><figcaption>{keep(words(3, 12))}</figcaption></figure>"

        inside = [f"<h1>{keep(words(1, 12))}</h1>"] if r.random() < 0.9 else []
        for _ in range(r.choice((0, 1, 2, 4, 8))):
            inside.append(block())
            if r.random() < 0.08:
                inside.append(other(r.choice(("ad", "share", "side", "form", "notice"))))
        if r.random() < 0.15:
            inside.append(other("comments"))
        tag = r.choice(("article", "article", "article", "main", "div", "div", ""))
        said = named(_CONTENT_WORDS) or (' class="content"' if tag == "div" and r.random() < 0.5 else "")
        body = f"<{tag}{said}>{''.join(inside)}</{tag}>" if tag else "".join(inside)
        if r.random() < 0.3:
            body = f"<div{named(_CONTENT_WORDS)}>{body}</div>"
        before = [other(k) for k in ("header", "menu", "notice", "ad", "form") if r.random() < 0.45]
        after = [other(k) for k in ("share", "comments", "side", "ad", "notice", "form") if r.random() < 0.3]
        after += [other("footer")] * (r.random() < 0.9)
        head = f"<head><title>{words(1, 8)}</title><style>p{{margin:0}}</style></head>"
        body = f"{''.join(before)}{body}{''.join(after)}"
        pages.append((f"<html>{head}<body>{body}</body></html>" if r.random() < 0.85 else body, good))
    return pages


def extract_text(df: DataFrame, html: str = "html", model: Model | None = None) -> DataFrame:
    """df with text string: the main text of the whole html, blocks joined by line ends; other columns are kept.

    Without a model, one is trained on `labelled_pages()` on the driver; its size doesn't depend on df.
    """
    held = df.sparkSession.sparkContext.broadcast(model or train(labelled_pages()))
    return add_columns(df, [html], "text string", lambda pages: (held.value.extract(pages),))


def op10_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    out = extract_text(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return out.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))

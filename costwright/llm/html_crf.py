"""Main text of web pages by a linear-chain conditional random field over DOM leaf blocks.

A page is cut into blocks: runs of text between block-level tags, with the tags, classes
and ids of their ancestors. Each block has binary features of its ancestors and its text; a two-label
chain (main text or not) is learned on labelled pages by stochastic gradient ascent
on the conditional likelihood (forward-backward) and decoded by Viterbi.

The labelled pages are made here from a fixed seed: layouts with the usual containers, menus,
notices, adverts, sidebars, forms, comments and footers around an article of invented words, so
that tags, names and text shapes are learned and no vocabulary is.
"""

from __future__ import annotations

import html
import math
import random
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

# Elements of the HTML standard.
_INLINE = set(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp "
    "small span strike strong sub sup time tt u var wbr".split()
)
_VOID = set("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is never text of the page.
_SILENT = set("script style template noscript head title textarea select svg math iframe object".split())
_RAW = set("script style textarea title iframe noscript".split())
#: Elements of SVG and MathML whose children are elements of HTML again.
_HTML_IN_FOREIGN = set("foreignobject desc title mi mo mn ms mtext annotation-xml".split())
#: An opening tag closes open ones of these names, up to the nearest of the second set.
_CLOSES = {
    "p": ({"p"}, {"div", "td", "li", "article", "section", "body", "blockquote"}),
    "li": ({"li"}, {"ul", "ol"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"optgroup", "select", "datalist"}),
    "optgroup": ({"option", "optgroup"}, {"select"}),
}

# Attributes as the HTML standard scans them: a quote opens a value only after an equals sign and is a
# plain character elsewhere; what is not closed ends with the page. Every quantifier that could be
# tried in several ways is possessive, so time is linear and nothing has a bound.
_VALUE = r"""(?:"[^"]*+"|'[^']*+'|(?!["'])[^\s>]*+)"""
_ATTRIBUTES = rf"""(?:[\s/]++|(?:=[^\s/>=]*+|[^\s/>=]++)(?:\s*+=\s*+{_VALUE})?+)*+"""
_TAG = re.compile(
    rf"""<!--(?:-?>|.*?(?:--!?>|\Z))|<(/?)([a-zA-Z][^\s/>]*+)({_ATTRIBUTES})(?:>|\Z)|</?(?:[!?]|(?<=/)[^a-zA-Z>])[^>]*+(?:>|\Z)|</>""",
    re.S,
)
_NAMES = re.compile(r"""(?:class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
_PIECES = re.compile(r"[a-z]+")


@dataclass
class Block:
    text: str
    near: str
    above: frozenset[str]
    link_share: float


def _names(attributes: str) -> list[str]:
    found = _NAMES.findall(attributes) if attributes else []
    return [f"n:{w}" for value in found for w in _PIECES.findall(value.lower())]


def blocks(page: str | None) -> list[Block]:
    """The text blocks of a page's body in page order; white space is one space, references are decoded."""
    out: list[Block] = []
    # of each open element: its name, what is above, the nearest block, whether it is of SVG or MathML
    stack: list[tuple[str, frozenset[str], str, bool]] = [("", frozenset(), "", False)]
    opened: dict[str, list[int]] = {}  # places of the open elements of a name
    parts: list[str] = []
    linked = 0
    links = silent = 0
    at = 0
    page = page or ""

    def flush() -> None:
        nonlocal parts, linked
        text = " ".join(html.unescape("".join(parts)).split())
        if text:
            out.append(Block(text, stack[-1][2], stack[-1][1], min(1.0, linked / len(text))))
        parts, linked = [], 0

    def pop(to: int) -> None:
        nonlocal links, silent
        for tag, *_ in stack[to:]:
            opened[tag].pop()
            links -= tag == "a"
            silent -= tag in _SILENT
        del stack[to:]

    def last(names: Iterable[str]) -> int:
        return max((places[-1] for name in names if (places := opened.get(name))), default=0)

    def add(text: str) -> None:
        nonlocal linked
        if text and not silent:
            parts.append(text)
            if links:
                linked += len(text.strip())

    while True:
        m = _TAG.search(page, at)
        if m is None:
            add(page[at:])
            break
        add(page[at : m.start()])
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            place = last((tag,))
            if tag not in _INLINE:
                flush()
            if place:
                pop(place)
            continue
        if tag == "br":
            add(" ")
            continue
        if tag not in _INLINE:
            flush()
        if tag in _VOID:
            continue
        if tag in _CLOSES:
            names, until = _CLOSES[tag]
            while (place := last(names)) > last(until):
                pop(place)
        parent, above, near, foreign = stack[-1]
        foreign = tag in ("svg", "math") or foreign and parent not in _HTML_IN_FOREIGN
        if m[3].endswith("/") and (foreign or tag in ("iframe", "object")):
            continue
        own = {f"t:{tag}", *_names(m[3])}
        opened.setdefault(tag, []).append(len(stack))
        stack.append((tag, above if own <= above else above | own, near if tag in _INLINE else tag, foreign))
        links += tag == "a"
        silent += tag in _SILENT
        if tag in _RAW:
            end = re.compile(rf"</{tag}(?=[\s/>])", re.I).search(page, at)
            at = end.start() if end else len(page)
    flush()
    return out


def _bin(n: float) -> int:
    return min(7, int(math.log2(n + 1)))


def features(page: list[Block]) -> list[list[str]]:
    """Binary features of each block: ancestors, own shape, neighbours' shapes, place."""
    sizes = [_bin(b.text.count(" ") + 1) for b in page]
    # a page that marks its main part says what is outside it, whatever the names of the rest
    marks = [m for m in ("t:article", "t:main") if any(m in b.above for b in page)]
    out = []
    for i, b in enumerate(page):
        density, size = int(b.link_share * 3), sizes[i]
        own = ["1", f"near:{b.near}", f"size:{size}", f"link:{density}", f"{b.near}:{size}", f"{density}:{size}"]
        own.append(f"prev:{sizes[i - 1] if i else -1}")
        own.append(f"next:{sizes[i + 1] if i + 1 < len(page) else -1}")
        own.append(f"stop:{b.text[-1] in '.!?:;…»”' + chr(34)}")
        if "©" in b.text or "copyright" in b.text.lower():
            own.append("copyright")
        if i == 0 or i == len(page) - 1:
            own.append("first" if i == 0 else "last")
        own += [f"outside {m}" for m in marks if m not in b.above]
        out.append([*own, *b.above])
    return out


@dataclass
class Chain:
    """Weights of label 1 against 0 for features, and of a label after a label."""

    weights: dict[str, float] = field(default_factory=dict)
    moves: np.ndarray = field(default_factory=lambda: np.zeros((2, 2)))

    def emissions(self, page: list[list[str]]) -> list[float]:
        get = self.weights.get
        return [sum([get(f, 0.0) for f in block]) for block in page]

    def expected(self, scores: list[float]) -> tuple[np.ndarray, np.ndarray]:
        """Probabilities of label 1 for each block and of each pair of neighbours (forward-backward)."""
        n = len(scores)
        emit = np.zeros((n, 2))
        emit[:, 1] = scores
        forward, backward = np.zeros((n, 2)), np.zeros((n, 2))
        forward[0] = emit[0]
        for t in range(1, n):
            forward[t] = np.logaddexp(forward[t - 1, 0] + self.moves[0], forward[t - 1, 1] + self.moves[1]) + emit[t]
        for t in range(n - 2, -1, -1):
            after = emit[t + 1] + backward[t + 1]
            backward[t] = np.logaddexp(self.moves[:, 0] + after[0], self.moves[:, 1] + after[1])
        total = np.logaddexp(*forward[-1])
        ones = np.exp(forward[:, 1] + backward[:, 1] - total)
        pairs = np.exp(
            forward[:-1, :, None] + self.moves + (emit[1:] + backward[1:])[:, None, :] - total
        ).sum(axis=0)
        return ones, pairs

    def viterbi(self, scores: list[float]) -> list[int]:
        """The likeliest labels; of equal ones 0."""
        (m00, m01), (m10, m11) = self.moves.tolist()
        zero, one, back = 0.0, 0.0, []
        for t, score in enumerate(scores):
            if t == 0:
                zero, one = 0.0, score
                continue
            back.append((int(one + m10 > zero + m00), int(one + m11 > zero + m01)))
            zero, one = max(zero + m00, one + m10), max(zero + m01, one + m11) + score
        labels = [int(one > zero)] if scores else []
        for step in reversed(back):
            labels.append(step[labels[-1]])
        return labels[::-1]


def train(pages: list[tuple[list[list[str]], list[int]]], epochs: int = 12, rate: float = 0.3, decay: float = 1e-4) -> Chain:
    """Stochastic gradient ascent with a step per page, scaled by past gradients."""
    chain, rng = Chain(), random.Random(5)
    seen: dict[str, float] = {}
    seen_moves = np.full((2, 2), 1e-6)
    for _ in range(epochs):
        for i in rng.sample(range(len(pages)), len(pages)):
            page, labels = pages[i]
            if not page:
                continue
            ones, pairs = chain.expected(chain.emissions(page))
            steps: dict[str, float] = {}
            for block, label, p in zip(page, labels, ones.tolist()):
                for f in block:
                    steps[f] = steps.get(f, 0.0) + label - p
            for f, g in steps.items():
                g -= decay * chain.weights.get(f, 0.0)
                seen[f] = seen.get(f, 1e-6) + g * g
                chain.weights[f] = chain.weights.get(f, 0.0) + rate * g / math.sqrt(seen[f])
            for a, b in zip(labels, labels[1:]):
                pairs[a, b] -= 1
            seen_moves += pairs * pairs
            chain.moves -= rate * pairs / np.sqrt(seen_moves)
    return chain


# Names that pages commonly give their parts.
_ARTICLE = ("article", "post", "entry content", "post body", "story", "content", "main content", "article body", "text", "page content")
_BEFORE = {
    "header": ("header", "masthead", "top bar", "site header", "branding"),
    "nav": ("nav", "navbar", "menu", "main menu", "breadcrumb", "breadcrumbs", "navigation", "toc"),
    "div": ("cookie notice", "cookie banner", "consent", "alert", "notice", "notification", "popup", "modal", "gdpr", "message"),
}
_ADS = ("ad", "ads", "advert", "advertisement", "banner", "sponsored", "sponsor", "promo", "promotion", "ad slot")
_AFTER = {
    "aside": ("sidebar", "side bar", "widget", "related", "recommended", "more stories", "trending", "links"),
    "form": ("search", "login", "newsletter", "subscribe", "signup", "contact", "register"),
    "section": ("comments", "comment list", "reader comments", "responses", "discussion", "replies", "feedback", "reviews"),
    "footer": ("footer", "site footer", "copyright", "legal", "colophon", "bottom"),
    "div": ("share", "social", "pagination", "pager", "tags", "author bio", "recommendations"),
}


#: Share of the containers of made pages that have a name of no list, so that shape and place are learned too.
FOREIGN_NAMES = 0.12


def labelled_page(rng: random.Random) -> tuple[str, list[str]]:
    """A page and the texts of its article's blocks."""
    syllables = ["".join(rng.choices("abcdefghilmnoprstuvz", k=rng.randint(1, 4))) for _ in range(30)]
    word = lambda: "".join(rng.choices(syllables, k=rng.randint(1, 4)))
    words = lambda a, b: " ".join(word() for _ in range(rng.randint(a, b)))
    sentence = lambda: words(1, 18).capitalize() + rng.choice("....!?")
    prose = lambda a, b: " ".join(sentence() for _ in range(rng.randint(a, b)))

    def open_(tag: str, names: tuple[str, ...] | None, share: float = 0.8) -> str:
        if names is None or rng.random() > share:
            return f"<{tag}>"
        name = word() if rng.random() < FOREIGN_NAMES else rng.choice(names).replace(" ", rng.choice("-_ "))
        return f'<{tag} {rng.choice(["class", "class", "id"])}="{name}">'

    def links(a: int, b: int) -> str:
        items = [f'<a href="/{word()}">{words(1, 3)}</a>' for _ in range(rng.randint(a, b))]
        if rng.random() < 0.6:
            return "<ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul>"
        return rng.choice([" | ", " ", " &middot; "]).join(items)

    def junk(tag: str, names: tuple[str, ...]) -> str:
        real = tag if rng.random() < 0.6 else "div"
        start = open_(real, names, 1.0 if real == "div" else 0.7)
        if tag in ("header", "nav"):
            body = rng.choice([links(2, 8), f"<p>{words(1, 5)}</p>" + links(1, 5), f"<h2>{words(1, 4)}</h2>"])
        elif tag == "form":
            body = f"<label>{words(1, 3)}</label><input name=q><button>{words(1, 2)}</button>" + rng.choice(["", f"<p>{prose(1, 2)}</p>"])
        elif tag == "section":
            name = word() if rng.random() < FOREIGN_NAMES else rng.choice(["comment", "reply", "comment-body"])
            comment = lambda: f'<div class="{name}"><b>{word()}</b><p>{prose(1, 4)}</p></div>'
            body = f"<h3>{words(1, 3)}</h3>" + "".join(comment() for _ in range(rng.randint(1, 5)))
            if rng.random() < 0.3:
                body = "<ol>" + "".join(f"<li>{word()}: {prose(1, 3)}</li>" for _ in range(rng.randint(1, 4))) + "</ol>"
        elif tag == "footer":
            body = rng.choice([f"&copy; {rng.randint(1999, 2025)} {words(1, 8)}.", f"<p>&copy; {word()} &middot; {sentence()}</p>", links(2, 6) + f"<p>{words(3, 12)}</p>"])
        elif tag == "aside":
            body = f"<h3>{words(1, 3)}</h3>" + rng.choice([links(2, 6), f"<p>{prose(1, 3)}</p>", links(1, 3) + f"<p>{sentence()}</p>"])
        else:
            body = rng.choice([prose(1, 3), f"<p>{prose(1, 2)}</p>", f"<p>{sentence()}</p><button>{words(1, 2)}</button>", links(1, 4)])
        return f"{start}{body}</{real}>"

    main: list[str] = []
    parts: list[str] = []

    def keep(text: str) -> str:
        main.append(text)
        return text

    if rng.random() < 0.85:
        parts.append(f"<h1>{keep(words(1, 10).capitalize() + rng.choice(['', '', '.']))}</h1>")
    for _ in range(rng.choice([0, 1, 1, 2, 3, 4, 6, 9, 14])):
        kind = rng.random()
        if kind < 0.62:
            parts.append(f"<p>{keep(prose(1, 7))}</p>")
        elif kind < 0.7:
            parts.append(f"<p><b>{keep(prose(1, 4))}<br>")
        elif kind < 0.77:
            parts.append(f"<h2>{keep(words(1, 6).capitalize())}</h2>")
        elif kind < 0.84:
            items = "".join(f"<li>{keep(words(2, 12).capitalize())}</li>" for _ in range(rng.randint(2, 5)))
            parts.append(rng.choice(["<ul>{}</ul>", "<ol>{}</ol>"]).format(items))
        elif kind < 0.88:
            parts.append(f"<blockquote>{keep(prose(1, 3))}</blockquote>")
        elif kind < 0.895:
            link = f'<a href="/{word()}">{keep(words(2, 9).capitalize())}</a>'
            parts.append(rng.choice(["<p>{}</p>", "<p>{}</p>", "<ul><li>{}</li></ul>"]).format(link))
        elif kind < 0.92:
            parts.append("<table>" + "".join(f"<tr><td>{keep(words(1, 3))}</td><td>{keep(words(1, 4))}</td></tr>" for _ in range(2)) + "</table>")
        elif kind < 0.94:
            parts.append(f"<div>{keep(prose(1, 5))}</div>")
        else:
            parts.append(junk("div", _ADS) if rng.random() < 0.6 else junk("aside", _AFTER["aside"]))
    if rng.random() < 0.1:
        parts.insert(0, junk("header", _BEFORE["header"]))
    if rng.random() < 0.25:
        tag = rng.choice(["section", "footer", "div"])
        parts.append(junk(tag, _AFTER[tag]))
    body = "".join(parts)
    shape = rng.random()
    if shape < 0.45:
        body = f"{open_('article', _ARTICLE, 0.3)}{body}</article>"
    elif shape < 0.55:
        body = f"{open_('main', _ARTICLE, 0.3)}{body}</main>"
    elif shape < 0.9:
        tag = rng.choice(["div", "div", "section", "td"])
        body = f"{open_(tag, _ARTICLE)}{body}</{tag}>"
    before = [junk(tag, names) for tag, names in _BEFORE.items() if rng.random() < 0.6]
    before += [junk("div", _ADS)] * (rng.random() < 0.5)
    after = [junk(tag, names) for tag, names in _AFTER.items() if rng.random() < 0.45]
    after += [junk("div", _ADS)] * (rng.random() < 0.3)
    rng.shuffle(before)
    rng.shuffle(after)
    if rng.random() < 0.25:
        before.append(junk("aside", _AFTER["aside"]))
    page = "".join(before) + body + "".join(after)
    for _ in range(rng.randint(0, 2)):
        name = rng.choice(["wrapper", "container", "page", "site", "layout", "row"])
        page = f'<div class="{name}">{page}</div>'
    head = f"<head><title>{words(1, 8)}</title><style>p{{margin:0}}</style></head>"
    return f"<!DOCTYPE html><html>{head}<body>{page}</body></html>", main


def labelled(count: int, seed: int) -> list[tuple[list[list[str]], list[int]]]:
    """Features and labels of made pages: a block is main text if the article has its text."""
    rng, out = random.Random(seed), []
    for _ in range(count):
        page, main = labelled_page(rng)
        found, texts = blocks(page), set(main)
        out.append((features(found), [int(b.text in texts) for b in found]))
    return out


#: Labelled pages that the registered model learns from.
TRAINING_PAGES = 900


@lru_cache(maxsize=2)
def trained(pages: int = TRAINING_PAGES, seed: int = 11) -> Chain:
    return train(labelled(pages, seed))


def main_text(page: str | None, chain: Chain) -> str:
    """The blocks labelled as main text, joined by two line ends; empty if there are none."""
    found = blocks(page)
    labels = chain.viterbi(chain.emissions(features(found)))
    return "\n\n".join(b.text for b, label in zip(found, labels) if label)


def extract(
    pages: DataFrame, chain: Chain | None = None, keep: tuple[str, ...] = ("page_id", "url"), page: str = "html"
) -> DataFrame:
    """The kept columns of every row with `text`, the main text of its page.

    Whole pages; a null or empty page has an empty text. Rows stay one to one, repeated
    rows included; other columns are not read. One pass, no shuffle.
    """
    chosen = pages.select(*keep, pages[page].alias("__page"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in chosen.schema.fields[:-1])
    model = chain or trained()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(p, model) for p in batch.column(len(keep)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(texts, pa.string())], names=[*keep, "text"])

    return chosen.mapInArrow(run, f"{schema}, text string")

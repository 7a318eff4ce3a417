"""Main text of web pages by a linear-chain conditional random field over DOM leaf blocks.

A page is parsed with HTML's forgiving rules (implied ends, unclosed tags, raw script and style text)
into leaf blocks: runs of text between block-level tags. Each block has features of its ancestors
(tags, and the words of their class, id and role) and of its text; the field scores a label, article
or other, for each block and for each pair of neighbours, and Viterbi decoding picks the labels.
It is trained by conditional likelihood on labelled pages that `training_pages` writes: many layouts,
with menus, headers, footers, sidebars, notices, adverts, forms and reader comments around and
inside the article. Training is bounded (PAGES pages) and happens on the driver; weights are broadcast.

Defined results: null and empty pages, and pages without article blocks, give the empty text; repeated
rows give repeated results; a null page_id or url stays null; ties cannot arise, as each page stands
alone (labels of equal score: other); an empty table gives an empty table; columns besides page_id, url
and html are not read. Whole pages are parsed in time in proportion to their length; as in browsers, an
element deeper than DEPTH is the sibling of the one above it, and a tag that the page's end cuts off is none.
"""

from __future__ import annotations

import html
import math
import random
import re
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import held, tidy

PAGES = 400
DEPTH = 512
EPOCHS = 12
SEED = 11

#: Tags that begin and end blocks; fixed values of HTML.
BLOCK_TAGS = frozenset(
    "address article aside blockquote body br button caption center dd details dialog dir div dl dt fieldset "
    "figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav "
    "ol optgroup option p pre section select summary table tbody td textarea tfoot th thead title tr ul".split()
)
#: Tags without content; fixed values of HTML.
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is never text of the page.
SILENT_TAGS = frozenset("script style template noscript svg math iframe object head title canvas audio video".split())
#: Start tags that leave an open head open; fixed values of HTML. Any other, and any text, ends it.
HEAD_TAGS = frozenset("html head base basefont bgsound link meta title noscript noframes style script template".split())
#: A start tag on the left ends an open element on the right, up to the nearest of SCOPES; fixed values of HTML.
IMPLIED_ENDS = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
    "th": {"td", "th"}, "option": {"option"}, "optgroup": {"option", "optgroup"},
    "thead": {"tr", "td", "th", "tbody"}, "tbody": {"tr", "td", "th", "thead", "tbody"},
}
SCOPES = frozenset("ul ol menu dl table select body html article section nav aside div main form footer header".split())

#: Tags that end an open svg or math element; fixed values of HTML.
BREAKOUT_TAGS = frozenset(
    "b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li listing menu meta "
    "nobr ol p pre ruby s small span strong strike sub sup table tt u ul var article section main header footer nav aside".split()
)

_TAG_NAME = re.compile(r"</?+([a-zA-Z][^\s/>]*+)")
_GAP = re.compile(r"[\s/]*+")
_ATTRIBUTE_NAME = re.compile(r"=?+[^\s/>=]*+")
_EQUALS = re.compile(r"\s*+=\s*+")
_UNQUOTED = re.compile(r"[^\s>]*+")
_NAME_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_RAW_END = {t: re.compile(rf"</{t}\s*>", re.IGNORECASE) for t in ("script", "style", "title", "textarea", "noscript", "iframe")}


class Block:
    """A leaf block: its text and what stood open around it."""

    __slots__ = ("link_chars", "path", "text")

    def __init__(self, text: str, path: tuple[tuple[str, frozenset[str]], ...], link_chars: int) -> None:
        self.text, self.path, self.link_chars = text, path, link_chars


def _tag(page: str, at: int) -> tuple[int, frozenset[str], bool] | None:
    """(end, words of class, id and role, whether it closes itself) of a tag whose name ends at `at`; None if the page ends in it."""
    words: set[str] = set()
    while True:
        at = _GAP.match(page, at).end()
        if at >= len(page):
            return None
        if page[at] == ">":
            return at + 1, frozenset(words), page[at - 1] == "/"
        name = _ATTRIBUTE_NAME.match(page, at)
        at, value = name.end(), ""
        if equals := _EQUALS.match(page, at):
            at = equals.end()
            if at < len(page) and page[at] in "\"'":  # a quote counts only where a value begins
                end = page.find(page[at], at + 1)
                if end < 0:
                    return None
                value, at = page[at + 1 : end], end + 1
            else:
                found = _UNQUOTED.match(page, at)
                value, at = found[0], found.end()
        if value and name[0].lower() in ("class", "id", "role"):
            words.update(w.lower() for w in _NAME_WORD.findall(value))


def tokens(page: str) -> Iterator[tuple[str, str, frozenset[str], bool, int]]:
    """(kind, text or tag, words of its names, whether it closes itself, end): kinds are text, open and close.

    A caller may send the place from which to go on, as after raw text.
    """
    at = begin = 0  # text since begin is not yet told
    while (at := page.find("<", at)) >= 0:
        name = _TAG_NAME.match(page, at)
        if name is None and page[at + 1 : at + 2] not in ("!", "?", "/"):
            at += 1
            continue
        if at > begin:
            yield "text", page[begin:at], frozenset(), False, at
        if name is None:
            if page.startswith("<!--", at):
                short = next((e for e in ("<!-->", "<!--->") if page.startswith(e, at)), None)
                end = at + len(short) - 3 if short else page.find("-->", at + 4)
                end = end + 3 if end >= 0 else len(page)
            else:
                end = page.find(">", at) + 1 or len(page)
            at = begin = end
            continue
        tag = _tag(page, name.end())
        if tag is None:
            return
        at = begin = tag[0]
        to = yield "close" if page[name.start() + 1] == "/" else "open", name[1].lower(), tag[1], tag[2], at
        if to is not None:
            at = begin = to
            yield "text", "", frozenset(), False, at
    if begin < len(page):
        yield "text", page[begin:], frozenset(), False, len(page)


def leaf_blocks(page: str) -> list[Block]:
    """The page's leaf blocks in page order, character references decoded and white space single."""
    blocks: list[Block] = []
    stack: list[tuple[str, frozenset[str]]] = []
    silent = links = 0  # how many such elements are open
    parts: list[str] = []
    link_chars = 0

    def flush() -> None:
        nonlocal link_chars
        text = " ".join(html.unescape("".join(parts)).split())
        if text:
            blocks.append(Block(text, tuple(stack), link_chars))
        parts.clear()
        link_chars = 0

    def cut(size: int) -> None:
        nonlocal silent, links
        for tag, _ in stack[size:]:
            silent -= tag in SILENT_TAGS
            links -= tag == "a"
        del stack[size:]

    def close(tags: set[str] | frozenset[str], within: frozenset[str]) -> None:
        for i in range(len(stack) - 1, -1, -1):
            if stack[i][0] in tags:
                cut(i)
                return
            if stack[i][0] in within:
                return

    reader = tokens(page)
    token = next(reader, None)
    while token is not None:
        kind, tag, names, closed, at = token
        token = None
        if kind == "text":
            if stack and stack[-1][0] == "head" and tag.strip():
                cut(len(stack) - 1)
            if tag and not silent:
                parts.append(tag)
                if links:
                    link_chars += len(tag)
        else:
            if tag in BLOCK_TAGS:
                flush()
            if kind == "close":
                if tag not in VOID_TAGS:
                    close({tag}, frozenset())
            else:
                if stack and stack[-1][0] == "head" and tag not in HEAD_TAGS:
                    cut(len(stack) - 1)
                if silent and tag in BREAKOUT_TAGS:
                    foreign = next((i for i, (t, _) in enumerate(stack) if t in SILENT_TAGS), 0)
                    if stack[foreign][0] in ("svg", "math"):
                        cut(foreign)
                if tag in BLOCK_TAGS and tag != "br":
                    close({"p"}, SCOPES - {"p"} | {"li", "td", "th", "blockquote"})
                if tag in IMPLIED_ENDS:
                    close(IMPLIED_ENDS[tag], SCOPES)
                # A closing slash counts in svg and math alone.
                if tag in _RAW_END and not (closed and silent and any(t in ("svg", "math") for t, _ in stack)):
                    end = _RAW_END[tag].search(page, at)
                    token = reader.send(end.end() if end else len(page))
                elif tag not in VOID_TAGS and not (closed and tag in SILENT_TAGS):
                    if len(stack) >= DEPTH:
                        cut(DEPTH - 1)
                    stack.append((tag, names))
                    silent += tag in SILENT_TAGS
                    links += tag == "a"
        if token is None:
            token = next(reader, None)
    flush()
    return blocks


_NUMBER = re.compile(r"\d")


def block_features(block: Block) -> list[str]:
    made = {"bias"}
    for depth, (tag, names) in enumerate(reversed(block.path)):
        if tag in ("html", "body"):
            continue
        if tag in BLOCK_TAGS:
            made.add(f"in:{tag}")
            if depth == 0:
                made.add(f"tag:{tag}")
        made.update(f"name:{n}" for n in names)
    inside = [t for t, _ in block.path if t in ("article", "main", "nav", "aside", "footer", "header", "form", "section")]
    made.add("landmark:" + (inside[-1] if inside else "none"))
    words = block.text.count(" ") + 1
    made.add(f"words:{min(6, int(math.log2(words + 1)))}")
    share = block.link_chars / max(1, len(block.text))
    made.add(f"links:{0 if share == 0 else 1 if share < 0.5 else 2}")
    made.add(f"stop:{block.text[-1] in '.!?…\"»”'}")
    if "©" in block.text:
        made.add("copyright")
    if len(_NUMBER.findall(block.text)) * 4 > len(block.text):
        made.add("numbers")
    return sorted(made)


class Field:
    """The field's weights: emission by feature and label (0 other, 1 article), and transition."""

    def __init__(self, emission: dict[str, tuple[float, float]] | None = None, transition: np.ndarray | None = None) -> None:
        self.emission = emission or {}
        self.transition = np.zeros((3, 2)) if transition is None else transition  # row 2: the page's start

    def scores(self, features: list[list[str]]) -> list[tuple[float, float]]:
        get, zero = self.emission.get, (0.0, 0.0)
        out = []
        for block in features:
            a = b = 0.0
            for f in block:
                w = get(f, zero)
                a += w[0]
                b += w[1]
            out.append((a, b))
        return out

    def decode(self, features: list[list[str]]) -> list[int]:
        """Viterbi: the labels of highest joint score."""
        if not features:
            return []
        (t00, t01), (t10, t11), (s0, s1) = self.transition.tolist()
        back = []
        best0 = best1 = 0.0
        for i, (a, b) in enumerate(self.scores(features)):
            if i == 0:
                best0, best1 = s0 + a, s1 + b
                continue
            from0 = 0 if best0 + t00 >= best1 + t10 else 1
            from1 = 0 if best0 + t01 >= best1 + t11 else 1
            back.append((from0, from1))
            best0, best1 = max(best0 + t00, best1 + t10) + a, max(best0 + t01, best1 + t11) + b
        labels = [0 if best0 >= best1 else 1]
        for pair in reversed(back):
            labels.append(pair[labels[-1]])
        return labels[::-1]


def _log_add(a: float, b: float) -> float:
    return max(a, b) + math.log1p(math.exp(-abs(a - b)))


def log_likelihood(field: Field, features: list[list[str]], gold: list[int]) -> float:
    """Log of the conditional probability of a page's labels."""
    scores, t = field.scores(features), field.transition.tolist()
    forward, path, before = None, 0.0, 2
    for (a, b), y in zip(scores, gold):
        if forward is None:
            forward = (t[2][0] + a, t[2][1] + b)
        else:
            forward = tuple(_log_add(forward[0] + t[0][z], forward[1] + t[1][z]) + (a, b)[z] for z in (0, 1))
        path += t[before][y] + (a, b)[y]
        before = y
    return path - _log_add(*forward) if forward else 0.0


def train(pages: list[tuple[list[list[str]], list[int]]], epochs: int = EPOCHS, rate: float = 0.3) -> Field:
    """Conditional likelihood by adaptive gradient steps, a page at a time; gradients from forward-backward."""
    weights: dict[str, list[float]] = {}
    squares: dict[str, list[float]] = {}
    transition, t_squares = np.zeros((3, 2)), np.full((3, 2), 1e-6)
    order = list(range(len(pages)))
    rng = random.Random(SEED)
    for _ in range(epochs):
        rng.shuffle(order)
        for k in order:
            features, gold = pages[k]
            n = len(features)
            if not n:
                continue
            scores = Field({f: (w[0], w[1]) for b in features for f in b if (w := weights.get(f))}).scores(features)
            t = transition.tolist()
            forward = [(t[2][0] + scores[0][0], t[2][1] + scores[0][1])]
            for i in range(1, n):
                f = forward[-1]
                forward.append(tuple(_log_add(f[0] + t[0][y], f[1] + t[1][y]) + scores[i][y] for y in (0, 1)))
            backward = [(0.0, 0.0)]
            for i in range(n - 1, 0, -1):
                b = backward[-1]
                backward.append(tuple(_log_add(t[y][0] + scores[i][0] + b[0], t[y][1] + scores[i][1] + b[1]) for y in (0, 1)))
            backward.reverse()
            total = _log_add(*forward[-1])
            t_gradient = np.zeros((3, 2))
            for i in range(n):
                p1 = math.exp(min(0.0, forward[i][1] + backward[i][1] - total))
                gradient = gold[i] - p1
                for f in features[i]:
                    w, s = weights.setdefault(f, [0.0, 0.0]), squares.setdefault(f, [1e-6, 1e-6])
                    for y, g in ((1, gradient - 1e-4 * w[1]), (0, -gradient - 1e-4 * w[0])):
                        s[y] += g * g
                        w[y] += rate * g / math.sqrt(s[y])
                if i == 0:
                    t_gradient[2, gold[0]] += 1
                    t_gradient[2] -= [1 - p1, p1]
                else:
                    t_gradient[gold[i - 1], gold[i]] += 1
                    for x in (0, 1):
                        for y in (0, 1):
                            t_gradient[x, y] -= math.exp(min(0.0, forward[i - 1][x] + t[x][y] + scores[i][y] + backward[i][y] - total))
            t_squares += t_gradient**2
            transition += rate * t_gradient / np.sqrt(t_squares)
    return Field({f: (w[0], w[1]) for f, w in weights.items()}, transition)


# ------------------------------------------------------------------ labelled pages

#: Class and id names for each kind of part.
PART_NAMES = {
    "nav": "nav menu navbar navigation breadcrumb breadcrumbs topnav mainmenu links pagination pager toc tabs".split(),
    "header": "header masthead banner topbar site-header logo branding page-header tagline".split(),
    "footer": "footer site-footer bottom colophon copyright legal page-footer credits".split(),
    "aside": "sidebar aside widget related recommended trending popular side rail teaser more-stories".split(),
    "notice": "notice cookie cookies consent alert gdpr warning message cookie-notice paywall popup modal".split(),
    "ad": "ad ads advert advertisement sponsored promo sponsor ad-slot banner-ad adbox commercial promoted".split(),
    "form": "form search login subscribe newsletter signup contact-form searchbox".split(),
    "comments": "comments comment commentlist comment-list responses discussion replies disqus reader-comments reply".split(),
    "share": "share social sharing follow share-buttons".split(),
    "article": "content article post entry story main body text article-body post-content entry-content page-content".split(),
}


def _prose(rng: random.Random, least: int, most: int) -> str:
    """Invented words, with the punctuation and references of prose."""
    made = []
    for _ in range(rng.randint(least, most)):
        word = "".join(rng.choice("bcdfghklmnprstvwz") + rng.choice("aeiouäéo") for _ in range(rng.randint(1, 4)))
        made.append(rng.choice(["", "", "", "", "&amp;", "&quot;", "42"]) + word + rng.choice(["", "", "", "", ",", ".", "***"]))
    text = " ".join(made).capitalize()
    return text + rng.choice([".", ".", ".", "", "!", "?", " ..."])


def training_pages(n: int = PAGES, seed: int = SEED) -> list[tuple[str, list[str]]]:
    """(html, texts of the article's blocks): pages of many layouts, labelled as they are written."""
    rng = random.Random(seed)
    pages = []
    for _ in range(n):
        kept: list[str] = []

        def named(tag: str, kind: str, inner: str, chance: float = 0.75) -> str:
            attribute = rng.choice(["class", "class", "id"])
            name = f' {attribute}="{rng.choice(PART_NAMES[kind])}"' if rng.random() < chance else ""
            return f"<{tag}{name}>{inner}</{tag}>"

        def links(many: int) -> str:
            items = "".join(f'<li><a href="/{i}">{_prose(rng, 1, 3)}</a></li>' for i in range(rng.randint(2, many)))
            return f"<ul>{items}</ul>"

        def paragraphs(least: int, most: int) -> str:
            return "".join(f"<p>{_prose(rng, 1, 40)}</p>" for _ in range(rng.randint(least, most)))

        def other(kind: str) -> str:
            sure = 1.0
            if kind == "nav":
                return rng.choice([f"<nav>{links(8)}</nav>", named("div", "nav", links(8), sure), named("ul", "nav", links(6), sure)])
            if kind == "header":
                return named("header", "header", _prose(rng, 1, 6) + rng.choice(["", links(5)])) if rng.random() < 0.6 else named("div", "header", _prose(rng, 1, 8), sure)
            if kind == "footer":
                inner = rng.choice(["&copy; 2020 ", "&copy; example.net &middot; ", ""]) + _prose(rng, 3, 25) + rng.choice(["", links(5)])
                return f"<footer>{inner}</footer>" if rng.random() < 0.6 else named("div", "footer", inner, sure)
            if kind == "aside":
                inner = rng.choice([links(6), paragraphs(1, 3), f"<h3>{_prose(rng, 1, 4)}</h3>{links(5)}"])
                return named("aside", "aside", inner) if rng.random() < 0.5 else named("div", "aside", inner, sure)
            if kind == "notice":
                inner = _prose(rng, 5, 30) + "<button>" + _prose(rng, 1, 2) + "</button>"
                return named("div", "notice", inner, sure) if rng.random() < 0.8 else f'<div role="{rng.choice(["alert", "dialog"])}">{inner}</div>'
            if kind == "ad":
                return named(rng.choice(["div", "div", "aside", "section"]), "ad", rng.choice([_prose(rng, 3, 20), paragraphs(1, 2)]), sure)
            if kind == "form":
                inner = f"<label>{_prose(rng, 1, 3)}</label><input name=q><select><option>{_prose(rng, 1, 2)}<option>{_prose(rng, 1, 2)}</select><button>{_prose(rng, 1, 2)}</button>"
                return named("form", "form", inner, 0.4)
            if kind == "share":
                return named("div", "share", links(4), sure)
            title = f"<h{rng.choice('23')}>{_prose(rng, 1, 4)}</h{2}>"
            each = "".join(rng.choice([f"<li>{paragraphs(1, 2)}</li>", named("div", "comments", paragraphs(1, 2), 0.5)]) for _ in range(rng.randint(1, 4)))
            return named(rng.choice(["section", "div", "ol"]), "comments", title + each, sure)

        def article() -> str:
            made = []
            for i in range(rng.randint(1, 12)):
                kind = rng.random()
                if i and kind < 0.1:
                    made.append(other(rng.choice(["ad", "aside", "form", "share", "notice"])))
                    continue
                text = _prose(rng, 1, 60)
                kept.append(" ".join(html.unescape(text).split()))
                wrap = rng.choice(["p", "p", "p", "p", "p", "div", "blockquote", "li", "h2", "pre", "td"])
                inner = rng.choice([text, text, f"<b>{text}", f"<em>{text}</em>", f'<a href="#x">{text}</a>' if kind > 0.9 else text])
                whole = {"li": f"<ul><li>{inner}</ul>", "td": f"<table><tr><td>{inner}</table>"}.get(wrap, f"<{wrap}>{inner}</{wrap}>")
                made.append(inner + "<br>" if kind > 0.93 else whole)
            return "".join(made)

        before = [other(k) for k in ("header", "nav", "notice", "ad", "form", "aside") if rng.random() < 0.55]
        after = [other(k) for k in ("share", "comments", "aside", "ad", "nav", "form", "notice") if rng.random() < 0.4]
        rng.shuffle(before)
        rng.shuffle(after)
        title = ""
        if rng.random() < 0.8:
            text = _prose(rng, 2, 9)
            kept.append(" ".join(html.unescape(text).split()))
            title = f"<h1>{text}</h1>"
        inner = title + article()
        inside = other("comments") if rng.random() < 0.15 else ""
        shell = rng.choice(
            [f"<article>{inner}{inside}</article>", f"<main>{inner}{inside}</main>", f"<main><article>{inner}</article>{inside}</main>", named("div", "article", inner + inside, 1.0), named("section", "article", inner, 1.0) + inside, named("article", "article", inner + inside), f"<div>{inner}</div>{inside}"]
        )
        end = other("footer") if rng.random() < 0.85 else ""
        head = '<!DOCTYPE html><html><head><title>x</title><style>p{}</style><script>var a="</p>";</script></head>'
        body = "".join(before) + shell + "".join(after) + end
        if rng.random() < 0.3:
            body = f'<div class="{rng.choice(["wrapper", "container", "page", "layout"])}">{body}</div>'
        pages.append((f"{head}<body>{body}</body></html>", kept))
    return pages


def labelled(page: str, kept: list[str]) -> tuple[list[list[str]], list[int]]:
    """Features and labels: the article's texts are met in page order."""
    blocks = leaf_blocks(page)
    labels, k = [], 0
    for b in blocks:
        match = k < len(kept) and b.text == kept[k]
        labels.append(int(match))
        k += match
    return [block_features(b) for b in blocks], labels


_field: list[Field] = []


def trained_field() -> Field:
    """Trained once in a process: the pages and the order of steps are fixed, so are the weights."""
    if not _field:
        _field.append(train([labelled(*p) for p in training_pages()]))
    return _field[0]


def main_text(page: str, field: Field) -> str:
    blocks = leaf_blocks(page)
    labels = field.decode([block_features(b) for b in blocks])
    return " ".join(b.text for b, y in zip(blocks, labels) if y)


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of each page; no shuffle."""
    field = trained_field()
    key = ("html", uuid.uuid4().hex)
    table = pages.sparkSession.sparkContext.broadcast((field.emission, field.transition))

    @F.pandas_udf("string")
    def read(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            mine = held(key, lambda: Field(*table.value))
            for whole in batches:
                yield pd.Series([main_text(p, mine) if p else "" for p in whole], dtype=object)

        yield from tidy(run, key)(batches)

    return (
        pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
        .select("page_id", "url", read("html").alias("text"))
        .withColumn("n_chars", F.length("text").cast("long"))
    )

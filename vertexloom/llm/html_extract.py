"""Main text of web pages by the maximum-scoring subsequence.

A page becomes a row of tokens: words and tags. Words score by where they stand, which is positive inside an article and negative
inside menus and other furniture, and tags score negative; the weights are fitted on labelled pages. One linear scan finds the
contiguous row of tokens with the greatest sum, the content region. Inside it, words that score negative themselves, which stand
in furniture within the article, are left out; a row of them costs the scan nothing within an article or main element and no more
than ``GAP`` elsewhere, so that it passes over furniture of any size to the paragraphs beyond. Hidden elements are no text.

The labelled pages are drawn by ``labelled_page`` from a seed: layouts in which it is known which words are content.
"""

from __future__ import annotations

import dataclasses
import functools
import html
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vertexloom.llm.common import map_texts

# Fixed values of HTML: elements whose content isn't text, that have no content, and that stand inside a line.
RAW = ("script", "style", "title", "textarea", "noscript", "template", "iframe", "svg", "math", "object", "select", "option", "button", "video", "audio", "canvas")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr img".split())
#: Words in class, id and role that may tell furniture or content, by kind; each is a cue to be weighted, in the singular and the plural.
NAMES = {
    "menu": "menu nav navbar navigation breadcrumb toolbar pager pagination".split(),
    "advert": "ad advert advertisement advertising sponsor sponsored promo banner".split(),
    "notice": "cookie consent notice alert popup modal overlay disclaimer copyright".split(),
    "side": "sidebar widget related share social".split(),
    "form": "newsletter subscribe signup login search feedback".split(),
    "comments": "comment reply respond response discussion disqus thread".split(),
    "edge": "header footer masthead".split(),
    "content": "content article post story entry main body text".split(),
}
CUES = tuple(name for names in NAMES.values() for name in names)
_CUES = {form: c for c in CUES for form in (c, f"{c}s", f"{c[:-1]}ies" if c.endswith("y") else c)}
#: Elements that are cues by their name.
PLACES = frozenset("nav header footer aside form article main p li a table figure dialog menu".split())
#: A heading that opens readers' comments.
COMMENTS = re.compile(r"\W*(?:\d+\s+)?(?:(?:reader|user|leave|post|add|write|join|all|the|your|a)\W+){0,3}(?:comments?|responses?|repl(?:y|ies)|discussion)\W*(?:\d+\W*)?", re.I)
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)|[^<]+|<", re.S)
ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?")
UNSEEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
ENDS = {tag: re.compile(rf"</{tag}\b[^>]*(?:>|\Z)", re.I) for tag in RAW}
HEADING = re.compile("h[1-6]")
CLOSES = {"p": {"p"}, "li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "tr": {"tr", "td", "th", "p"}, "td": {"td", "th", "p"}, "th": {"td", "th", "p"}}
#: Block elements that end an open paragraph, as the HTML parser does.
ENDS_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol pre section table ul".split())
#: What a row of furniture costs the scan at most where no element says that it is the article; words of a block that is long, and of one that is short.
GAP = 20.0
LONG, SHORT = 15, 4


@dataclasses.dataclass
class Weights:
    """word: a word's score without cues. cue: what each cue around it adds. tag: a tag's score."""

    word: float
    cue: dict[str, float]
    tag: float

    def of(self, cues: frozenset[str]) -> float:
        return self.word + sum(self.cue.get(c, 0.0) for c in cues)


def cues_of(tag: str, attributes: str, around: frozenset[str]) -> frozenset[str] | None:
    """The cues within an element, given those of the elements around it; None if it is hidden. A header within an article is the article's own."""
    new = set()
    if tag in PLACES and not (tag == "header" and ("article" in around or "main" in around)):
        new.add(tag)
    elif HEADING.fullmatch(tag):
        new.add("heading")
    for name, value in ATTRIBUTE.findall(attributes) if attributes.strip() else ():
        name = name.lower()
        if name == "hidden" or name == "style" and UNSEEN.search(value):
            return None
        if name in ("class", "id", "role"):
            parts = re.findall(r"[a-z]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", value).lower())
            new |= {f".{_CUES[p]}" for p in parts if p in _CUES}
    return around | new if new else around


class _Open:
    """An open element: its name, the cues within, or None if hidden, and the tokens before it."""

    __slots__ = ("cues", "since", "tag")

    def __init__(self, tag: str, cues: frozenset[str] | None, since: int) -> None:
        self.tag, self.cues, self.since = tag, cues, since


def tokens(page: str) -> list[tuple[str, str, frozenset[str]]]:
    """The page's tokens in order: ("text", string, cues around it), ("block", "", cues) or ("inline", "", cues)."""
    out: list[tuple[str, str, frozenset[str]]] = []
    stack = [_Open("", frozenset(), 0)]
    opened: Counter = Counter()
    at, n = 0, len(page)

    def shut_last() -> None:
        last = stack.pop()
        opened[last.tag] -= 1
        if HEADING.fullmatch(last.tag) and stack[-1].cues is not None and ".comment" not in stack[-1].cues:
            said = "".join(piece for kind, piece, _ in out[last.since :] if kind == "text")
            if len(said) < 80 and COMMENTS.fullmatch(said):
                stack[-1].cues = stack[-1].cues | {".comment"}
                out[last.since :] = [(kind, piece, cues | {".comment"}) for kind, piece, cues in out[last.since :]]

    while at < n:
        found = TOKEN.match(page, at)
        at = found.end()
        around = stack[-1].cues
        name = found[2] or found[5]
        if name is None:
            piece = found[0]
            if around is not None and (piece[0] != "<" or piece == "<"):
                out.append(("text", piece, around))
            continue
        closing, tag, attributes = bool(found[1] or found[4]), name.lower(), found[3] or found[6] or ""
        if not closing and tag in ENDS:
            end = ENDS[tag].search(page, at)
            at = end.end() if end else n
            if around is not None:
                out.append(("inline", "", around))
            continue
        if closing:
            if opened[tag] > 0:
                while stack[-1].tag != tag:
                    shut_last()
                shut_last()
        else:
            shut = CLOSES.get(tag) or ({"p"} if tag in ENDS_P else ())
            while shut and stack[-1].tag in shut:
                shut_last()
            around = stack[-1].cues
            if tag not in VOID and (tag not in INLINE or tag == "a" or "hidden" in attributes or "style" in attributes):
                stack.append(_Open(tag, None if around is None else cues_of(tag, attributes, around), len(out)))
                opened[tag] += 1
        if around is not None:
            out.append(("inline" if tag in INLINE else "block", "", around))
    return with_shapes(out)


def with_shapes(parts: list[tuple[str, str, frozenset[str]]]) -> list[tuple[str, str, frozenset[str]]]:
    """Adds cues of a block's shape to its text: ``long``, and outside an article ``short``, and ``linked`` if most of its words are links."""
    known: dict[tuple, frozenset[str]] = {}
    begin = 0
    for i in range(len(parts) + 1):
        if i < len(parts) and parts[i][0] != "block":
            continue
        words = linked = 0
        for kind, piece, cues in parts[begin:i]:
            if kind == "text":
                many = len(piece.split())
                words += many
                linked += many * ("a" in cues)
        shape = ("long",) * (words >= LONG)
        bare = shape + ("short",) * (words < SHORT) + ("linked",) * (2 * linked > words)
        for j in range(begin, i):
            kind, piece, cues = parts[j]
            if kind == "text":
                own = shape if "article" in cues or "main" in cues else bare
                key = (cues, own)
                if key not in known:
                    known[key] = cues.union(own)
                parts[j] = (kind, piece, known[key])
        begin = i + 1
    return parts


def best_region(scores: np.ndarray) -> tuple[int, int]:
    """Start and end of the contiguous part with the greatest positive sum, the first and shortest such; (0, 0) if none is positive."""
    best, best_at, total, begin = 0.0, (0, 0), 0.0, 0
    for i, s in enumerate(scores):
        if total <= 0:
            total, begin = 0.0, i
        total += s
        if total > best:
            best, best_at = total, (begin, i + 1)
    return best_at


def extract(page: str | None, weights: Weights) -> str:
    """The main text: character references decoded, white space inside a block made one space, blocks joined by one space."""
    parts = tokens(page or "")
    known: dict[frozenset[str], float] = {}
    scores, words, debt = np.zeros(len(parts)), [], 0.0
    for i, (kind, piece, cues) in enumerate(parts):
        if cues not in known:
            known[cues] = weights.of(cues)
        if kind == "text":
            decoded = html.unescape(piece)
            words.append(decoded)
            score = known[cues] * len(decoded.split())
        else:
            words.append("")
            score = weights.tag
        if known[cues] <= 0 and ("article" in cues or "main" in cues):
            score = 0.0
        elif score > 0:
            debt = 0.0
        else:
            score = max(score, -GAP - debt)
            debt += score
        scores[i] = score
    begin, end = best_region(scores)
    blocks, line = [], []
    for i in range(begin, end):
        kind, _, cues = parts[i]
        if kind == "block":
            blocks.append("".join(line))
            line = []
        elif kind == "text" and known[cues] > 0:
            line.append(words[i])
    blocks.append("".join(line))
    return " ".join(" ".join(b.split()) for b in blocks if b.strip())


def labelled_page(seed: int) -> tuple[str, set[str]]:
    """A page drawn from the layouts of the web, and the words that are its content."""
    r = random.Random(seed)
    count, content = [0], set()

    def words(n: int, good: bool) -> str:
        made = []
        for _ in range(n):
            count[0] += 1
            made.append(f"w{count[0]}")
        if good:
            content.update(made)
        return " ".join(made)

    few, some, many = (lambda: r.randint(1, 4)), (lambda: r.randint(4, 14)), (lambda: r.randint(20, 90))
    no, yes = (lambda n: words(n, False)), (lambda n: words(n, True))
    links = lambda n, good=False: "".join(f'<li><a href="#">{words(few(), good)}</a></li>' for _ in range(n))
    named = lambda kind: r.choice(["class", "id"]) + f'="{r.choice(NAMES[kind])}{r.choice(["", "s", "-box", " wide", "_1"])}"'
    remarks = lambda: "".join(r.choice(["<p>{}</p>", "<li><p>{}</p></li>", "<article><p>{}</p></article>", "<div>{}</div>", "<blockquote>{}</blockquote>"]).format(no(r.randint(5, 60))) for _ in range(few()))
    furniture = [
        lambda: f"<nav><ul>{links(some())}</ul></nav>",
        lambda: f"<div {named('menu')}>{no(r.randint(0, 6))}<ul>{links(r.randint(1, 8))}</ul><p>{no(r.randint(0, 8))}</p></div>",
        lambda: f"<menu>{links(few())}</menu>",
        lambda: f"<div {named('advert')}>{r.choice(['{}', '<p>{}</p>']).format(no(r.randint(4, 60)))}</div>",
        lambda: f"<div {named('notice')}><p>{no(some() * 3)}</p></div>",
        lambda: f"<aside><h3>{no(few())}</h3><p>{no(some() * 2)}</p></aside>",
        lambda: f"<div {named('side')}><h4>{no(few())}</h4><ul>{links(few())}</ul><p>{no(some() * 2)}</p></div>",
        lambda: f"<form><label>{no(few())}</label><p>{no(some())}</p>{no(few())}</form>",
        lambda: f"<div {named('form')}><p>{no(some())}</p></div>",
        lambda: f"<dialog><p>{no(some())}</p></dialog>",
    ]
    unnamed = [  # which are furniture for sure only outside an article
        lambda: f"<div><ul>{links(some())}</ul></div>",
        lambda: "<table><tr>" + "".join(f"<td><a href='#'>{no(few())}</a></td>" for _ in range(some())) + "</tr></table>",
    ]
    comments = [
        lambda: f"<section {named('comments')}><h3>{no(few())}</h3>{remarks()}</section>",
        lambda: f"<section><h3>{r.choice(['Comments', '7 comments', 'Reader comments', 'Leave a reply', 'Responses (3)'])}</h3>{remarks()}</section>",
    ]
    any_furniture = lambda more=(): r.choice([*furniture, *more] if r.random() < 0.75 else comments)()
    before = f"<header><h1>{no(few())}</h1><p>{no(some())}</p></header>" if r.random() < 0.5 else f"<div {named('edge')}>{no(some())}</div>"
    after = f"<footer><p>{no(some())}</p>{no(few())}</footer>" if r.random() < 0.6 else f"<div {named('edge')}>{no(some())}</div>"
    paragraph = lambda: f"<p>{yes(many())} <a href='#'>{yes(few())}</a> {yes(few())}" + "</p>" * (r.random() < 0.8)
    blocks = [
        lambda: f"{r.choice(['', '<div>'])}{yes(many())}<br>{yes(some())}<br>",
        lambda: f"<h{r.choice('234')}>{yes(few())}</h2>",
        lambda: r.choice(["<ul>{}</ul>", "<ol>{}</ol>"]).format("".join(f"<li>{yes(some())}</li>" for _ in range(few()))),
        lambda: f"<figure>{yes(few())}<figcaption>{yes(some())}</figcaption></figure>",
        lambda: "<table>" + "".join(f"<tr><td>{yes(few())}</td><td>{yes(some())}</td></tr>" for _ in range(few())) + "</table>",
        lambda: r.choice(["<blockquote>{}</blockquote>", "<pre>{}</pre>", "<blockquote><p>{}</p></blockquote>", "<section>{}</section>", "<div>{}</div>", "<address>{}</address>"]).format(yes(r.randint(3, 60))),
        lambda: f"<dl><dt>{yes(few())}</dt><dd>{yes(some())}</dd></dl>",
        lambda: f"<p>{yes(few())}</p><p><a href='#'>{yes(few())}</a></p>",
        lambda: f"<ul>{links(few(), True)}</ul>",
    ]
    holder = r.choice([("<article>", "</article>"), ("<article>", "</article>"), ("<main>", "</main>"), ("<main><article>", "</article></main>"), *((f'<div class="{c}">', "</div>") for c in NAMES["content"]), ("<div>", "</div>")])
    marked = "article" in holder[0] and "class" not in holder[0] or "<main>" in holder[0]
    body = [f"<h1>{yes(r.randint(3, 12))}</h1>", paragraph()]
    for _ in range(r.randint(0, 9)):
        kind = r.random()
        # An all-linked block is content for sure only in an element that says so.
        body.append(paragraph() if kind < 0.55 else r.choice(blocks if marked else blocks[:-2])() if kind < 0.9 else any_furniture())
    body.append(paragraph() if not marked or r.random() < 0.7 else r.choice(blocks)())
    parts = [before, *(any_furniture(unnamed) for _ in range(r.randint(0, 3))), holder[0], *body, holder[1], *(any_furniture(unnamed) for _ in range(r.randint(0, 3))), after]
    return "<html><body>" + "".join(parts) + "</body></html>", content


@functools.cache
def fitted(pages: int = 1000, steps: int = 1000, ridge: float = 2e-4) -> Weights:
    """Weights from labelled pages: a logistic model of whether a word is content gives words' scores; the tag's score is minus the mean log odds lost where content borders on furniture."""
    columns: dict[str, int] = {}
    rows: list[tuple[frozenset[str], int, int]] = []
    tags, inside = 0, 0
    for seed in range(pages):
        page, content = labelled_page(seed)
        for kind, piece, cues in tokens(page):
            if kind == "text":
                found = piece.split()
                good = sum(w in content for w in found)
                rows.append((cues, good, len(found) - good))
                inside += good
            else:
                tags += 1
    for cues, *_ in rows:
        for c in sorted(cues):
            columns.setdefault(c, len(columns))
    cell_r = np.repeat(np.arange(len(rows)), [len(c) for c, *_ in rows])
    cell_c = np.array([columns[c] for cues, *_ in rows for c in sorted(cues)])
    good, bad = (np.array([r[k] / max(1, r[1] + r[2]) ** 0.5 for r in rows], float) for k in (1, 2))
    theta, first, second = (np.zeros(len(columns) + 1) for _ in range(3))
    for step in range(1, steps + 1):
        p = 1 / (1 + np.exp(-(np.bincount(cell_r, theta[cell_c], minlength=len(rows)) + theta[-1])))
        pull = (p * (good + bad) - good) / (good + bad).sum()
        slope = np.append(np.bincount(cell_c, pull[cell_r], minlength=len(columns)), pull.sum()) + ridge * np.append(theta[:-1], 0) / 10
        first, second = 0.9 * first + 0.1 * slope, 0.99 * second + 0.01 * slope**2
        theta -= 0.1 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-9)
    word = float(theta[-1])
    return Weights(word, {c: float(theta[i]) for c, i in columns.items()}, -tags / max(1, tags + inside))


def extract_pages(df: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", weights: Weights | None = None) -> DataFrame:
    """``page_id, url, text, n_chars`` of every row. A null page counts as empty; an empty one, or one without a region, gives an empty text.

    Repeated rows stay repeated; an empty table gives no rows; other columns of ``df`` are left out.
    """
    weights = weights or fitted()

    def made(rows: pa.RecordBatch) -> dict:
        texts = [extract(p, weights) for p in rows.column("html").to_pylist()]
        return {"page_id": rows.column("page_id"), "url": rows.column("url"), "text": texts, "n_chars": [len(t) for t in texts]}

    kinds = dict(df.dtypes)
    return map_texts(df.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html")), made, f"page_id {kinds[id_col]}, url {kinds[url_col]}, text string, n_chars bigint", "html")

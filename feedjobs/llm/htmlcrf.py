"""Main text of web pages: a linear-chain conditional random field over the leaf blocks of the DOM.

A leaf block is a run of text between block-level tags; inline tags do not cut it. Each block has the tags and
the class and id words of its ancestors, the nearest of them separately, and features of its text (length,
share of link text, final punctuation, marks of menus and legal lines, place on the page). The field gives
each block the label main or other; the best sequence of labels is found by Viterbi.

The weights are trained by gradient ascent on the conditional likelihood, on pages with known labels: the
text blocks of at most SAMPLE stored pages, drawn by a hash of the id, are laid out anew in many page
structures (containers, class names, notices, forms, adverts, comments inside and outside the article), so that
the label of each block is known by construction.

Defined results: a null or empty page has no text; a page of text without any tags is one block; unclosed and
stray tags are repaired as browsers do for paragraphs and list items; an unclosed comment, script or style runs to the
end of the page. Pages are handled one by one, so repeated rows get equal texts.
"""

from __future__ import annotations

import html as entities
import random
import re
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import bounded_sample, sliced

SAMPLE, TRAIN_PAGES, EPOCHS = 120, 400, 25

# Tags by their role.
BLOCK_TAGS = frozenset(
    "address article aside blockquote body br button caption center dd details dialog div dl dt fieldset figcaption figure footer "
    "form h1 h2 h3 h4 h5 h6 head header hgroup hr html iframe legend li main menu nav noscript ol optgroup option p pre section "
    "select summary table tbody td template textarea tfoot th thead title tr ul video audio canvas object".split()
)
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW_TAGS = frozenset("script style textarea template iframe noscript".split())
CLOSES = {"p": frozenset(("p",)), "li": frozenset(("li", "p")), "dt": frozenset(("dt", "dd", "p")), "dd": frozenset(("dt", "dd", "p")), "tr": frozenset(("tr", "td", "th", "p")), "td": frozenset(("td", "th", "p")), "th": frozenset(("td", "th", "p")), "option": frozenset(("option",))}
SCOPES = frozenset("ul ol dl table div section article aside nav footer header main form body blockquote td th".split())
ENDS_P = BLOCK_TAGS - frozenset("br body html head title option optgroup td th tr tbody thead tfoot caption button".split())

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>?"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>?|[^<]+|<",
    re.S,
)
_NAMES = re.compile(r"(?:^|\s)(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


class LeafBlock:
    __slots__ = ("path", "names", "text", "linked", "start")

    def __init__(self, path, names, text, linked, start):
        self.path, self.names, self.text, self.linked, self.start = path, names, text, linked, start


def leaf_blocks(page: str | None) -> list[LeafBlock]:
    """Blocks in page order: tags of the ancestors, their name words, text with single blanks, linked characters,
    and where in the page the text begins."""
    out: list[LeafBlock] = []
    stack: list[tuple[str, tuple[str, ...]]] = []
    run: list[str] = []
    linked, start = 0, -1
    page = page or ""

    def flush() -> None:
        nonlocal linked, start
        text = " ".join("".join(run).split())
        if text:
            out.append(LeafBlock([t for t, _ in stack if t in BLOCK_TAGS], [n for _, n in stack], text, linked, start))
        run.clear()
        linked, start = 0, -1

    def pop_to(i: int) -> None:
        flush()
        del stack[i:]

    at, lower = 0, None
    while m := _TOKEN.match(page, at):
        at = m.end()
        name = m[2] or m[5]
        if name is None:
            piece = m[0]
            if piece[0] != "<" or len(piece) == 1:
                text = entities.unescape(piece)
                run.append(text)
                if start < 0 and text.strip():
                    start = m.start()
                if any(t == "a" for t, _ in stack):
                    linked += len(text.strip())
            elif piece.startswith("<![CDATA["):
                run.append(piece[9:-3] if piece.endswith("]]>") else piece[9:])
            continue
        tag, closing, attrs = name.lower(), bool(m[1] or m[4]), m[3] or m[6] or ""
        block = tag in BLOCK_TAGS
        if closing:
            i = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == tag), None)
            if i is None:
                if tag == "p" or tag == "br":
                    flush()
            elif block:
                pop_to(i)
            elif not any(t in BLOCK_TAGS for t, _ in stack[i + 1 :]):
                del stack[i:]
            continue
        if tag in RAW_TAGS and not attrs.rstrip().endswith("/"):
            lower = page.lower() if lower is None or len(lower) != len(page) else lower
            end = lower.find(f"</{tag}", at)
            flush() if block else None
            if end < 0:
                break
            at = page.find(">", end) + 1 or len(page)
            continue
        if tag in VOID_TAGS:
            flush() if block else None
            continue
        if block:
            flush()
            close = CLOSES.get(tag, frozenset())
            if tag in ENDS_P:
                close = close | CLOSES["p"]
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] in close:
                    del stack[i:]
                elif stack[i][0] in SCOPES and not (stack[i][0] in ("td", "th") and tag in ("td", "th", "tr")):
                    break
        names = tuple(w.lower() for a in _NAMES.finditer(attrs) for w in _PARTS.findall(a[1] or a[2] or a[3] or "")) if "=" in attrs else ()
        if not attrs.rstrip().endswith("/") or block:
            stack.append((tag, names))
    flush()
    return out


_BUCKETS = (2, 4, 8, 15, 30, 60, 120)
_LEGAL = re.compile(r"©|\(c\)|copyright|all rights|privacy|cookie|subscribe|newsletter|log ?in|sign (?:in|up)|advert|sponsored|comment|repl(?:y|ies)", re.I)


def features(blocks: list[LeafBlock]) -> list[list[str]]:
    out = []
    for i, b in enumerate(blocks):
        n = b.text.count(" ") + 1
        f = ["1", f"own={b.path[-1] if b.path else ''}", f"n{sum(n > x for x in _BUCKETS)}", f"link{min(4, 4 * b.linked // max(1, len(b.text)))}"]
        f += [f"in={t}" for t in set(b.path)]
        words = [w for names in b.names for w in names]
        f += [f"has={w}" for w in set(words)]
        near = next((names for names in reversed(b.names) if names), ())
        f += [f"near={w}" for w in near]
        container = next((t for t in reversed(b.path) if t in ("article", "main", "aside", "nav", "footer", "header", "form", "section", "head")), "")
        f += [f"container={container}", f"end={'p' if b.text[-1] in '.!?…:;' else 'w'}", f"place={min(3, 4 * i // len(blocks))}", "first" if i == 0 else "later"]
        if _LEGAL.search(b.text):
            f.append("legal")
        if i + 1 == len(blocks):
            f.append("last")
        out.append(f)
    return out


class Field:
    """Weights of label features [feature, label] and of transitions [label, next label]; labels other = 0, main = 1."""

    def __init__(self):
        self.index: dict[str, int] = {}
        self.w = np.zeros((0, 2))
        self.t, self.start, self.end = np.zeros((2, 2)), np.zeros(2), np.zeros(2)
        self.table: dict[str, float] = {}

    def train(self, pages: list[tuple[list[list[str]], list[int]]], epochs: int = EPOCHS, rate: float = 0.3, l2: float = 1e-3) -> None:
        """Adagrad on the negative conditional log-likelihood; expectations by forward and backward sums."""
        for feats, _ in pages:
            for f in feats:
                for x in f:
                    self.index.setdefault(x, len(self.index))
        self.w = np.zeros((len(self.index), 2))
        coded = [([np.array([self.index[x] for x in f]) for f in feats], np.array(y)) for feats, y in pages if feats]
        state = [np.full(a.shape, 1e-2) for a in (self.w, self.t, self.start, self.end)]
        rng = np.random.default_rng(3)
        for _ in range(epochs):
            for part in np.array_split(rng.permutation(len(coded)), max(1, len(coded) // 20)):
                g = [l2 * self.w, l2 * self.t, np.zeros(2), np.zeros(2)]
                for i in part:
                    feats, y = coded[i]
                    u = np.array([self.w[f].sum(axis=0) for f in feats])
                    node, edge = self._marginals(u)
                    want = np.eye(2)[y]
                    for f, d in zip(feats, (node - want) / len(part), strict=True):
                        g[0][f] += d
                    g[1] += (edge - want[:-1].T @ want[1:]) / len(part)
                    g[2] += (node[0] - want[0]) / len(part)
                    g[3] += (node[-1] - want[-1]) / len(part)
                for value, grad, s in zip((self.w, self.t, self.start, self.end), g, state, strict=True):
                    s += grad * grad
                    value -= rate * grad / np.sqrt(s)
        self.table = {x: float(self.w[i, 1] - self.w[i, 0]) for x, i in self.index.items()}

    def _marginals(self, u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = len(u)
        a, b, t = np.empty((n, 2)), np.empty((n, 2)), np.exp(self.t)
        e = np.exp(u - u.max(axis=1, keepdims=True))
        a[0] = e[0] * np.exp(self.start)
        a[0] /= a[0].sum()
        for i in range(1, n):
            a[i] = (a[i - 1] @ t) * e[i]
            a[i] /= a[i].sum()
        b[-1] = np.exp(self.end)
        for i in range(n - 2, -1, -1):
            b[i] = t @ (e[i + 1] * b[i + 1])
            b[i] /= b[i].sum()
        node = a * b
        node /= node.sum(axis=1, keepdims=True)
        pair = a[:-1, :, None] * t[None] * (e[1:] * b[1:])[:, None, :]
        return node, (pair / pair.sum(axis=(1, 2), keepdims=True)).sum(axis=0) if n > 1 else np.zeros((2, 2))

    def decode(self, feats: list[list[str]]) -> list[int]:
        """The most likely labels (Viterbi). Unseen features have no weight."""
        if not feats:
            return []
        (t00, t01), (t10, t11) = self.t.tolist()
        get, back = self.table.get, []
        v0, v1 = float(self.start[0]), float(self.start[1]) + sum(get(x, 0.0) for x in feats[0])
        for f in feats[1:]:
            u = sum(get(x, 0.0) for x in f)
            from0, from1 = v0 + t00 < v1 + t10, v0 + t01 < v1 + t11
            back.append((int(from0), int(from1)))
            v0, v1 = max(v0 + t00, v1 + t10), max(v0 + t01, v1 + t11) + u
        label = int(v1 + self.end[1] > v0 + self.end[0])
        out = [label]
        for step in reversed(back):
            label = step[label]
            out.append(label)
        return out[::-1]


def main_text(page: str | None, field: Field) -> str:
    blocks = leaf_blocks(page)
    return "\n".join(b.text for b, y in zip(blocks, field.decode(features(blocks)), strict=True) if y)


# ------------------------------------------------------------------ training pages


def _menu(r: random.Random, words) -> str:
    items = "".join(f'<li><a href="/{w}">{w}</a></li>' for w in words(r.randint(3, 9)))
    return r.choice((f"<nav><ul>{items}</ul></nav>", f'<ul class="{r.choice(("menu", "nav", "navbar links", "breadcrumb"))}">{items}</ul>', f'<div id="{r.choice(("nav", "menu", "top-menu"))}"><ul>{items}</ul></div>', f'<nav class="main-nav">{items}</nav>', f'<div role="navigation">{items}</div>'))


def training_page(r: random.Random, texts: list[str]) -> tuple[str, list[int]]:
    """A page in a random structure, and the label of each of its leaf blocks in page order. texts: short texts."""
    parts: list[tuple[str, int]] = []  # html, label of its blocks

    def word() -> str:
        """The word at a random place of a random text."""
        text = r.choice(texts)
        start = text.rfind(" ", 0, r.randrange(len(text))) + 1
        end = text.find(" ", start)
        return text[start:] if end < 0 else text[start:end]

    def words(n: int) -> list[str]:
        return [word().strip("<>&\"'") or "x" for _ in range(n)]

    def sentence() -> str:
        return entities.escape(" ".join(words(r.randint(4, 14))).capitalize() + r.choice((".", ".", "", "!")))

    def para() -> str:
        return entities.escape(r.choice(texts))

    def other(place: str) -> str:
        kind = r.choice(place.split())
        if kind == "menu":
            return _menu(r, words)
        if kind == "header":
            return r.choice((f"<header><p>{sentence()}</p></header>", f"<header><a href='/'>{sentence()}</a>{_menu(r, words)}</header>", f'<div class="{r.choice(("header", "site-header", "masthead", "topbar"))}"><h2>{sentence()}</h2></div>', f'<div id="header">{sentence()}</div>'))
        if kind == "ad":
            return r.choice((f'<div class="{r.choice(("ad", "ads", "advert", "advertisement", "ad banner", "sponsor", "promo"))}">{r.choice((sentence, para))()}</div>', f'<aside class="ad"><p>{sentence()}</p></aside>', f'<div id="ad-{r.randint(1, 9)}"><p>{para()}</p></div>'))
        if kind == "notice":
            return r.choice((f'<div class="{r.choice(("cookie", "cookie-notice", "notice", "cookie-banner", "consent", "alert", "banner", "popup", "modal"))}">{r.choice((sentence, para))()} <button>{sentence()}</button></div>', f'<div id="cookies"><p>{para()}</p></div>', f'<section class="notice"><p>{para()}</p></section>'))
        if kind == "side":
            return r.choice((f"<aside><h3>{sentence()}</h3><p>{para()}</p></aside>", f'<div class="{r.choice(("sidebar", "side", "related", "widget", "recommended", "share", "social", "trending"))}"><h3>{sentence()}</h3><ul><li><a href="#">{sentence()}</a></li><li>{sentence()}</li></ul></div>', f'<div id="sidebar"><p>{para()}</p><p>{para()}</p></div>'))
        if kind == "form":
            return r.choice((f"<form><label>{sentence()}</label><input><button>{sentence()}</button></form>", f'<form class="{r.choice(("search", "newsletter", "subscribe", "login"))}"><p>{r.choice((sentence, para))()}</p><select><option>{sentence()}<option>{sentence()}</select></form>', f'<div class="newsletter"><form><p>{sentence()}</p></form></div>'))
        if kind == "comments":
            each = lambda: r.choice((f'<div class="comment"><b>{sentence()}</b><p>{para()}</p></div>', f'<li class="comment"><p>{para()}</p></li>', f'<article class="comment"><p>{para()}</p></article>', f'<div class="reply"><p>{para()}</p></div>'))
            body = "".join(each() for _ in range(r.randint(1, 4)))
            return r.choice((f'<div id="comments"><h3>{sentence()}</h3>{body}</div>', f'<section class="{r.choice(("comments", "discussion", "responses", "user-comments"))}">{body}</section>', f'<ol class="comment-list commentlist">{body}</ol>'))
        return r.choice((f"<footer>&copy; {sentence()}</footer>", f"<footer><p>{para()}</p></footer>", f'<div class="{r.choice(("footer", "site-footer", "copyright", "legal"))}">&copy; {sentence()}</div>', f'<div id="footer"><p>{sentence()}</p>{_menu(r, words)}</div>'))

    def block() -> str:
        p = para()
        words_ = p.split(" ")
        if len(words_) > 6 and r.random() < 0.3:
            i = r.randrange(len(words_) - 2)
            tag = r.choice(("a href='/x'", "b", "em", "span", "strong"))
            p = " ".join([*words_[:i], f"<{tag}>{words_[i]} {words_[i + 1]}</{tag.split()[0]}>", *words_[i + 2 :]])
        return r.choice((f"<p>{p}</p>",) * 8 + (f"<p><b>{p}<br>", f"<h2>{sentence()}</h2><p>{p}</p>", f"<blockquote><p>{p}</p></blockquote>", f"<ul><li>{sentence()}</li><li>{p}</li></ul>", f"<div>{p}</div>", f"<p>{sentence()}</p>", f"<table><tr><td>{sentence()}<td>{sentence()}</table>", f"<figure><img src=x><figcaption>{sentence()}</figcaption></figure>", f"<pre>{p}</pre>"))

    for _ in range(r.randint(1, 4)):
        parts.append((other("menu header ad notice side form"), 0))
    open_, close = r.choice(
        (("<article>", "</article>"),) * 5
        + (("<main>", "</main>"), ("<main><article>", "</article></main>"), ("<section>", "</section>"))
        + tuple((f'<div class="{c}">', "</div>") for c in ("content", "article", "article-body", "post", "entry-content", "story", "main-content", "post-body", "text", "page-content"))
        + (('<div id="content">', "</div>"), ('<div id="main"><div class="article">', "</div></div>"), ('<article class="post">', "</article>"))
    )
    parts.append((open_, 0))
    if r.random() < 0.8:
        title = f"<h1>{sentence()}</h1>"
        parts.append((title, 1))
    for _ in range(r.randint(1, 12)):
        parts.append((block(), 1))
        if r.random() < 0.06:
            parts.append((other("ad side form notice"), 0))
    if r.random() < 0.2:
        parts.append((other("comments side form"), 0))
    parts.append((close, 0))
    for _ in range(r.randint(0, 3)):
        parts.append((other("ad side form comments menu notice"), 0))
    if r.random() < 0.9:
        parts.append((other("footer"), 0))
    page = f"<!DOCTYPE html><html><head><title>{sentence()}</title><style>p{{margin:0}}</style><script>x('</p>')</script></head><body>"
    ends, said = [len(page)], [0]
    for piece, label in parts:
        page += piece
        ends.append(len(page))
        said.append(label)
    page += r.choice(("</body></html>", ""))
    return page, [said[bisect_right(ends, b.start)] for b in leaf_blocks(page)]


def fit(texts: list[str], pages: int = TRAIN_PAGES, seed: int = 11) -> Field:
    r, field, made = random.Random(seed), Field(), []
    texts = [t for t in texts if t.strip()] or ["A line of text.", "Another line of text, which is longer than the first one."]
    for _ in range(pages):
        page, labels = training_page(r, texts)
        made.append((features(leaf_blocks(page)), labels))
    field.train(made)
    return field


def sample_texts(pages: DataFrame, page_id: str, html: str, sample: int = SAMPLE) -> list[str]:
    """Block texts of a bounded sample of pages, as material for training pages."""
    rows = bounded_sample(pages.where(F.col(html).isNotNull()).select(page_id, html), sample, page_id).collect()
    return [b.text for r in rows for b in leaf_blocks(r[html])]


def extract(pages: DataFrame, page_id: str = "page_id", html: str = "html", sample: int = SAMPLE) -> DataFrame:
    """pages with text and n_chars in place of html."""
    spark = pages.sparkSession
    shared = spark.sparkContext.broadcast(fit(sample_texts(pages, page_id, html, sample)))
    keep = [c for c in pages.columns if c not in (html, "text", "n_chars")]
    df = pages.select(*[F.col(f"`{c}`") for c in keep], F.col(html).alias("_html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches, "_html"):
            texts = [main_text(h, shared.value) for h in b["_html"].to_pylist()]
            yield pa.RecordBatch.from_arrays([*[b[c] for c in keep], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], [*keep, "text", "n_chars"])

    return df.mapInArrow(run, "".join(f"`{c}` {t}, " for c, t in df.dtypes if c != "_html") + "text string, n_chars long")


def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"))

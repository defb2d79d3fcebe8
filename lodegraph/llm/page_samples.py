"""Labelled pages for training the extractor: seeded layouts with a known main text."""

from __future__ import annotations

import html as html_lib
import random

from pyspark.sql import DataFrame, SparkSession

ONSETS, VOWELS = "b c d f g h j k l m n p r s t v w z br dr fl gr kl pr sk tr".split(), "a e i o u ai eo ü é ó".split()
HEADS = (
    "<meta charset=utf-8><link rel=stylesheet href=/site.css>",
    "<style>body > .wrap { color: #333 } h1 { font-size: 2em }</style>",
    "<script>if (a < b) { load('x'); }</script>",
    '<script type="application/ld+json">{"@type": "WebPage"}</script><base href="/">',
    "<meta name=viewport content='width=device-width'><!-- build 71 -->",
)
DRAWINGS = (
    '<svg width="8" height="8"/>',
    '<svg viewBox="0 0 4 4"><path d="M0 0h4"/><text>icon</text></svg>',
    "<noscript><img src=/pixel.gif></noscript>",
    "<canvas></canvas>",
    "<iframe src=/frame title=frame></iframe>",
)
MAIN_NAMES = "content post entry-content entry article-body story main text body-copy post-content story-text".split()


def _words(rng: random.Random, n: int) -> list[str]:
    return ["".join(rng.choice(ONSETS) + rng.choice(VOWELS) for _ in range(rng.randint(1, 4))) for _ in range(n)]


def _sentences(rng: random.Random, n: int) -> str:
    out = []
    while n > 0:
        words = _words(rng, min(n, rng.randint(1, 18)))
        n -= len(words)
        out.append(" ".join(words).capitalize() + rng.choice([".", ".", ".", "!", "?", "", " &", " #!", " % $"]))
    return " ".join(out)


class _Page:
    """Collects html; main text blocks are noted as they are written."""

    def __init__(self, rng: random.Random):
        self.rng, self.html, self.main = rng, [], []

    def put(self, text: str) -> None:
        self.html.append(text)

    def block(self, tag: str, text: str, main: bool, attributes: str = "") -> None:
        if main:
            self.main.append(" ".join(text.split()))
        shown = html_lib.escape(text, quote=False)
        if self.rng.random() < 0.15:
            shown = f"<{'b' if self.rng.random() < 0.5 else 'em'}>{shown}</b>"
        closing = "" if tag in ("p", "li") and self.rng.random() < 0.2 else f"</{tag}>"
        self.put(f"<{tag}{attributes}>{shown}{closing}")

    def links(self, tag: str, attributes: str = "", words: int = 2) -> None:
        self.put(f"<{tag}{attributes}><ul>")
        for _ in range(self.rng.randint(2, 9)):
            self.put(f'<li><a href="/{self.rng.randint(1, 99)}">{" ".join(_words(self.rng, self.rng.randint(1, words)))}</a></li>')
        self.put(f"</ul></{tag}>")


def _attribute(rng: random.Random, *names: str) -> str:
    return f' {rng.choice(["class", "class", "id"])}="{rng.choice(names)}"'


def _menu(p: _Page) -> None:
    r = p.rng
    p.links(*r.choice([("nav", ""), ("div", _attribute(r, "menu", "navbar", "nav", "topnav", "breadcrumbs")), ("nav", ' class="menu"')]))


def _header(p: _Page) -> None:
    r = p.rng
    tag, attributes = r.choice([("header", ""), ("div", _attribute(r, "header", "masthead", "banner", "site-header"))])
    p.put(f"<{tag}{attributes}>")
    p.block(r.choice(["div", "h1", "p", "h2"]), _sentences(r, r.randint(1, 5)), False)
    if r.random() < 0.5:
        _menu(p)
    p.put(f"</{tag}>")


def _advert(p: _Page) -> None:
    r = p.rng
    p.put(r.choice(["", "", "<!-- begin promotion -->", "<!-- slot:7 -->"]))
    tag = r.choice(["div", "div", "aside", "section"])
    p.put(f"<{tag}{_attribute(r, 'ad', 'ads', 'advert', 'sponsored', 'promo', 'advertisement', 'ad-slot')}>")
    for _ in range(r.randint(1, 2)):
        if r.random() < 0.5:
            p.put(html_lib.escape(_sentences(r, r.randint(2, 25)), quote=False))
        else:
            p.block("p", _sentences(r, r.randint(2, 25)), False)
    p.put(f"</{tag}>")


def _notice(p: _Page) -> None:
    r = p.rng
    p.put(f"<div{_attribute(r, 'cookie', 'cookie-banner', 'notice', 'consent', 'alert', 'gdpr', 'popup', 'newsletter', 'subscribe', 'paywall')}>")
    p.block(r.choice(["p", "div", "span"]), _sentences(r, r.randint(3, 30)), False)
    if r.random() < 0.5:
        p.put("<button>Accept</button>")
    p.put("</div>")


def _sidebar(p: _Page) -> None:
    r = p.rng
    tag, attributes = r.choice([("aside", ""), ("div", _attribute(r, "sidebar", "side", "widget", "related", "rail", "sidebar-right"))])
    p.put(f"<{tag}{attributes}>")
    for _ in range(r.randint(1, 3)):
        p.block(r.choice(["h2", "h3", "h4"]), _sentences(r, r.randint(1, 3)), False)
        if r.random() < 0.5:
            p.links("div", "", 6)
        else:
            p.block("p", _sentences(r, r.randint(4, 60)), False)
    p.put(f"</{tag}>")


def _form(p: _Page) -> None:
    r = p.rng
    p.put("<form action='/go'>")
    if r.random() < 0.6:
        p.block("p", _sentences(r, r.randint(2, 20)), False)
    p.put(f"<label>{_words(r, 1)[0]}</label><input name='q'><select><option>{_words(r, 1)[0]}</option></select>")
    p.put(f"<button>{_words(r, 1)[0]}</button></form>")


def _comments(p: _Page) -> None:
    r = p.rng
    tag = r.choice(["section", "div", "aside"])
    p.put(f"<{tag}{_attribute(r, 'comments', 'comment-list', 'responses', 'discussion', 'disqus', 'reader-comments', 'comments-area')}>")
    if r.random() < 0.6:
        p.block("h3", _sentences(r, r.randint(1, 3)), False)
    inner = r.choice(["div class='comment'", "article class='comment'", "li", "article", "div class='reply'"])
    for _ in range(r.randint(1, 6)):
        p.put(f"<{inner}>")
        if r.random() < 0.6:
            p.block("span", _sentences(r, 2), False)
        p.block("p", _sentences(r, r.randint(3, 80)), False)
        p.put(f"</{inner.split()[0]}>")
    p.put(f"</{tag}>")


def _footer(p: _Page) -> None:
    r = p.rng
    tag, attributes = r.choice([("footer", ""), ("footer", ""), ("div", _attribute(r, "footer", "bottom", "site-footer", "copyright"))])
    p.put(f"<{tag}{attributes}>")
    if r.random() < 0.4:
        p.links("div")
    text = html_lib.escape(_sentences(r, r.randint(2, 25)), quote=False)
    p.put(f"&copy; example.com &middot; {text}" if r.random() < 0.7 else f"<p>{text}</p>")
    p.put(f"</{tag}>")


def _article(p: _Page) -> None:
    r = p.rng
    outer, attributes = r.choice(
        [("article", ""), ("article", ""), ("article", ' class="post"'), ("main", ""), ("main", ""), ("main", " id=main")]
        + [(r.choice(["div", "div", "section"]), _attribute(r, *MAIN_NAMES)) for _ in range(4)]
    )
    p.put("<main>" if outer == "article" and r.random() < 0.3 else "")
    p.put(f"<{outer}{attributes}>")
    if r.random() < 0.8:
        p.block("h1", _sentences(r, r.randint(1, 12)), True)
    for i in range(r.choice([0, 1, 1, 2, 3, 5, 8, 14])):
        kind = r.random()
        if kind < 0.72:
            p.block("p", _sentences(r, r.choice([1, 2, 5, 12, 30, 60, 150, 300])), True)
        elif kind < 0.8:
            p.block(r.choice(["h2", "h3"]), _sentences(r, r.randint(1, 6)), True)
        elif kind < 0.86:
            p.put("<ul>")
            for _ in range(r.randint(2, 5)):
                p.block("li", _sentences(r, r.randint(1, 15)), True)
            p.put("</ul>")
        elif kind < 0.9:
            p.block("blockquote", _sentences(r, r.randint(4, 40)), True)
        elif kind < 0.91:
            p.put("<table><tr>")
            for _ in range(r.randint(2, 4)):
                p.block("td", _sentences(r, r.randint(1, 5)), True)
            p.put("</tr></table>")
        elif kind < 0.92:
            p.block("pre", _sentences(r, r.randint(3, 30)), True)
        elif kind < 0.96:
            _advert(p)
        elif kind < 0.98:
            p.links("div", _attribute(r, "share", "social", "related"))
        else:
            _notice(p)
        if r.random() < 0.05:
            p.put(r.choice(DRAWINGS))
    if r.random() < 0.08:
        _comments(p)
    p.put(f"</{outer}>")


def labelled_page(seed: int) -> tuple[str, str]:
    """html and main text of one page."""
    r = random.Random(seed)
    p = _Page(r)
    p.put(r.choice(["<!DOCTYPE html><html><head>", "<html lang=xx><head>", "<!doctype html>\n<head>"]))
    p.put(f"<title>{html_lib.escape(_sentences(r, 4))}</title>")
    p.put("".join(r.sample(HEADS, r.randint(0, 3))) + r.choice(["</head><body>", "</head>\n<body class=page>"]))
    wrapper = r.choice(["", "", "<div id=page>", "<div class='wrap'><div class=inner>"])
    p.put(wrapper)
    for part in (_header, _menu, _notice, _advert, _form):
        if r.random() < 0.5:
            part(p)
    if r.random() < 0.3:
        _sidebar(p)
    _article(p)
    for part in (_sidebar, _advert, _comments, _form, _notice, _menu):
        if r.random() < 0.35:
            part(p)
    if r.random() < 0.85:
        _footer(p)
    p.put("</div>" * wrapper.count("<div"))
    p.put("</body></html>" if r.random() < 0.8 else "")
    return "".join(p.html), "\n\n".join(p.main)


def labelled_pages(spark: SparkSession, count: int = 600, parts: int = 4) -> DataFrame:
    """html, text: the first count pages, spread over a fixed number of partitions."""
    rows = [labelled_page(seed) for seed in range(count)]
    return spark.createDataFrame(rows, "html string, text string").repartition(parts)

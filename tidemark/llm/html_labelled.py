"""Labelled pages to train on: layouts of many kinds with invented words.

An element with ``data-tidemark-label`` gives its label (1: main text) to all in it, up to the next
such element. The pages are made by rule and the same in every run.
"""

from __future__ import annotations

import random

_SYLLABLES = "ba co de fi gu lo mi na per qua ri sol ta un ver wex yol zen mar tin é ü ción heit".split()
_CONTENT = ["content", "post", "entry-content", "article-body", "story", "mainContent", "text", "post-body", "page-content", "articleText", "body-copy", "main"]
_MENU = ["menu", "nav", "navbar", "main-nav", "navigation", "breadcrumb", "topnav", "toolbar", "pagination", "tabs", "skip-links", "languages"]
_SIDE = ["sidebar", "widget", "side", "rail", "right-col", "secondary", "related", "more-stories", "popular", "tag-cloud", "author-box", "recommended"]
_ADS = ["ad", "ads", "advert", "advertisement", "sponsored", "promo", "banner", "adsense", "ad-slot", "sponsor"]
_NOTICE = ["notice", "cookie-banner", "cookies", "consent", "alert", "gdpr", "disclaimer", "popup", "modal", "subscribe", "newsletter", "paywall", "warning-bar"]
_TALK = ["comments", "comment-list", "commentlist", "discussion", "responses", "comment", "replies", "disqus", "reader-comments", "reviews"]
_SHARE = ["share", "social", "sharing", "share-buttons", "follow-us", "print-links", "byline", "meta", "post-meta"]
_FOOT = ["footer", "site-footer", "bottom", "copyright", "legal", "colophon", "foot"]
_HEAD = ["header", "masthead", "site-header", "top", "topbar", "logo", "branding", "hero-nav"]


def _word(r: random.Random) -> str:
    return "".join(r.choice(_SYLLABLES) for _ in range(r.choice((1, 1, 2, 2, 3))))


def _words(r: random.Random, low: int, high: int) -> str:
    style = r.random()
    w = [_word(r) for _ in range(r.randint(low, high))]
    if style < 0.06:
        w = [x + r.choice(("***", "$$$", "&amp;&amp;", "%%%")) for x in w]
    elif style < 0.12:
        w = [x.upper() + "!!" for x in w]
    elif style < 0.18:
        w = " | ".join(w).split(" ")
    elif style < 0.8:
        for i in range(0, len(w), 9):
            w[i] = w[i].capitalize()
            w[max(0, i - 1)] += "." if i else ""
        w[-1] += "."
    return " ".join(w)


def _named(r: random.Random, names: list[str]) -> str:
    kind = r.random()
    name = r.choice(names)
    return f' class="{name}"' if kind < 0.6 else f' id="{name}"' if kind < 0.85 else f' class="box {name}"'


def _links(r: random.Random, n: int) -> str:
    items = [f'<a href="/{_word(r)}">{_words(r, 1, 3)}</a>' for _ in range(n)]
    if r.random() < 0.7:
        return "<ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul>"
    return r.choice((" | ", " ", "&middot;")).join(items)


def _block(r: random.Random) -> str:
    """Some paragraphs, as boilerplate has them too."""
    return "".join(f"<p>{_words(r, 3, 45)}</p>" for _ in range(r.randint(1, 3)))


def _boilerplate(r: random.Random, kind: str) -> str:
    if kind == "menu":
        tag = r.choice(("nav", "nav", "div"))
        return f"<{tag}{_named(r, _MENU) if tag == 'div' or r.random() < 0.4 else ''}>{_links(r, r.randint(3, 9))}</{tag}>"
    if kind == "head":
        tag = r.choice(("header", "div"))
        inner = f"<h2>{_words(r, 1, 4)}</h2>" + r.choice((f"<p>{_words(r, 2, 8)}</p>", _links(r, 4), "", _words(r, 2, 12)))
        return f"<{tag}{_named(r, _HEAD) if tag == 'div' or r.random() < 0.4 else ''}>{inner}</{tag}>"
    if kind == "side":
        tag = r.choice(("aside", "div", "section"))
        inner = f"<h3>{_words(r, 1, 3)}</h3>" + r.choice((_links(r, 5), _block(r), _words(r, 8, 40)))
        return f"<{tag}{_named(r, _SIDE) if tag != 'aside' or r.random() < 0.5 else ''}>{inner}</{tag}>"
    if kind == "ad":
        tag = r.choice(("div", "div", "aside", "section"))
        return f"<{tag}{_named(r, _ADS)}>{r.choice((_words(r, 3, 40), _block(r), _links(r, 2)))}</{tag}>"
    if kind == "notice":
        tag = r.choice(("div", "section", "p"))
        inner = _words(r, 5, 40) if tag == "p" or r.random() < 0.5 else _block(r) + "<button>OK</button>"
        return f"<{tag}{_named(r, _NOTICE)}>{inner}</{tag}>"
    if kind == "form":
        return f'<form action="/{_word(r)}"><label>{_words(r, 1, 3)}</label><input name="q"><p>{_words(r, 2, 14)}</p><button>{_words(r, 1, 2)}</button></form>'
    if kind == "talk":
        tag = r.choice(("section", "div"))
        one = r.choice(("div", "li", "article"))
        mark = r.choice(("comment", "reply", "comment-body", "response"))
        items = "".join(f'<{one} class="{mark}"><p>{_words(r, 4, 60)}</p></{one}>' for _ in range(r.randint(1, 5)))
        return f"<{tag}{_named(r, _TALK)}><h3>{_words(r, 1, 3)}</h3>{items}</{tag}>"
    if kind == "share":
        return f"<div{_named(r, _SHARE)}>{r.choice((_links(r, 3), _words(r, 2, 6)))}</div>"
    tag = r.choice(("footer", "footer", "div"))
    inner = r.choice((f"&copy; {_words(r, 3, 30)}", f"<p>&copy; {_words(r, 2, 12)}</p>{_links(r, 4)}", _links(r, 6), _block(r)))
    return f"<{tag}{_named(r, _FOOT) if tag == 'div' or r.random() < 0.3 else ''}>{inner}</{tag}>"


def _main(r: random.Random) -> str:
    parts = []
    if r.random() < 0.9:
        h = f"<h1>{_words(r, 2, 12)}</h1>"
        parts.append(f"<header>{h}</header>" if r.random() < 0.1 else h)
    for _ in range(r.choice((1, 1, 2, 4, 7, 12))):
        kind = r.random()
        text = _words(r, *r.choice(((1, 4), (3, 12), (10, 60), (40, 150))))
        if kind < 0.7:
            parts.append(f"<p>{text}</p>" if r.random() < 0.7 else f"<p><b>{text}<br>")
        elif kind < 0.78:
            parts.append(f"<h2>{_words(r, 1, 6)}</h2>")
        elif kind < 0.85:
            parts.append("<ul>" + "".join(f"<li>{_words(r, 2, 20)}</li>" for _ in range(r.randint(2, 5))) + "</ul>")
        elif kind < 0.9:
            parts.append(f"<blockquote><p>{text}</p></blockquote>")
        elif kind < 0.93:
            parts.append(f"<pre>{text}</pre>")
        elif kind < 0.96:
            parts.append("<table>" + "".join(f"<tr><td>{_words(r, 1, 5)}</td><td>{_words(r, 1, 5)}</td></tr>" for _ in range(3)) + "</table>")
        else:
            parts.append(f"<p>{text} <a href='/x'>{_words(r, 1, 3)}</a> {_words(r, 2, 9)}</p>")
        if r.random() < 0.08:
            parts.append(_off(r, r.choice(("ad", "share", "side", "notice", "form"))))
    if r.random() < 0.15:
        parts.append(_off(r, "talk"))
    return "".join(parts)


def _off(r: random.Random, kind: str) -> str:
    """Boilerplate as an element labelled 0."""
    out = _boilerplate(r, kind)
    cut = next(i for i, c in enumerate(out) if c in " >")
    return f'{out[:cut]} data-tidemark-label="0"{out[cut:]}'


def _paragraphs(r: random.Random, n: int) -> str:
    """Main text and nothing else, as plain pages have it."""
    parts = [f"<h1>{_words(r, 1, 9)}</h1>"] if r.random() < 0.4 else []
    for _ in range(n):
        text = _words(r, *r.choice(((1, 6), (5, 15), (12, 40), (30, 90))))
        parts.append(r.choices((f"<p>{text}</p>", text + "<br><br>", f"<div>{text}</div>", f"<h2>{_words(r, 1, 5)}</h2><p>{text}</p>", f"<pre>{text}</pre>", f"<ul><li>{text}</li><li>{_words(r, 2, 9)}</li></ul>"), (10, 1, 2, 2, 1, 1))[0])
    return "".join(parts)


def plain_pages(n: int = 450, seed: int = 17) -> list[str]:
    """Pages whose text stands in the body itself, in boxes without a name or with one that says nothing, alone or beside little else."""
    r = random.Random(seed)
    pages = []
    for _ in range(n):
        inner, kind = _paragraphs(r, r.choice((1, 1, 1, 2, 3, 5, 9))), r.random()
        label = ' data-tidemark-label="1"'
        one = lambda k: f'<div data-tidemark-label="0"{_named(r, _TALK)}>{_block(r)}</div>' if k == "talk" and r.random() < 0.7 else _off(r, k)
        few = lambda ks: "".join(one(k) for k in ks if r.random() < 0.4)  # noqa: B023, E731
        around = r.random() < 0.6
        before, after = (few(("head", "menu", "notice", "ad")), few(("side", "talk", "foot", "share"))) if around else ("", "")
        if kind < 0.35:
            body = f"<body{label}>{before}{inner}{after}</body>"
        elif kind < 0.4:  # no body either
            pages.append(inner.replace("<p>", f"<p{label}>").replace("<div>", f"<div{label}>").replace("<h1>", f"<h1{label}>").replace("<h2>", f"<h2{label}>").replace("<pre>", f"<pre{label}>").replace("<ul>", f"<ul{label}>"))
            continue
        elif kind < 0.47:
            body = f"<body{label}>{_words(r, 1, 60)}{inner if r.random() < 0.3 else ''}</body>"
        else:
            deep = r.choice((1, 1, 2, 3))
            names = [r.choice(("", "", f' class="{_word(r)}"', f' id="{_word(r)}"', f' class="{_word(r)}-{_word(r)}"')) for _ in range(deep)]
            tags = [r.choice(("div", "div", "section", "center")) for _ in names]
            opened = "".join(f"<{t}{m}{label if i == 0 else ''}>" for i, (t, m) in enumerate(zip(tags, names)))
            body = f"<body>{before}{opened}{inner}{''.join(f'</{t}>' for t in reversed(tags))}{after}</body>"
        pages.append(body if r.random() < 0.3 else f"<html><head><title>{_words(r, 1, 6)}</title></head>{body}</html>")
    return pages


def labelled_pages(n: int = 600, seed: int = 5) -> list[str]:
    r = random.Random(seed)
    pages = []
    for _ in range(n):
        kind = r.random()
        inner = _main(r)
        if kind < 0.45:
            body = f'<article data-tidemark-label="1"{_named(r, _CONTENT) if r.random() < 0.3 else ""}>{inner}</article>'
        elif kind < 0.8:
            body = f'<{(t := r.choice(("div", "section", "main")))} data-tidemark-label="1"{_named(r, _CONTENT)}>{inner}</{t}>'
        elif kind < 0.9:
            body = f'<table><tr><td>{_off(r, "menu")}</td><td data-tidemark-label="1">{inner}</td></tr></table>'
        else:
            body = f'<div data-tidemark-label="1">{inner}</div>'
        if r.random() < 0.4:
            body = r.choice(("<main>{}</main>", '<div class="container">{}</div>', '<div id="wrapper"><div class="row">{}</div></div>')).format(
                body + (_off(r, "side") if r.random() < 0.5 else "")
            )
        before = "".join(_off(r, k) for k in ("head", "menu", "notice", "ad", "form") if r.random() < 0.5)
        after = "".join(_off(r, k) for k in ("share", "side", "talk", "ad", "form", "notice", "foot") if r.random() < 0.45)
        pages.append(f"<!DOCTYPE html><html><head><title>{_words(r, 2, 8)}</title></head><body>{before}{body}{after}</body></html>")
    return pages

"""Labelled pages for training: common layouts with content and everything around it marked.

``pages`` draws them from lists of the tags and class names that sites use. A mark
``data-l="1"`` or ``"0"`` says whether an element holds article text; it goes for all below it
until another mark. The words are arbitrary, only their number and punctuation matter.
"""

from __future__ import annotations

import random

CONTENT = [
    ("article", ""), ("article", "post"), ("article", "story entry"), ("main", ""), ("main", "content"), ("div", "content"),
    ("div", "article-body"), ("div", "post-content"), ("div", "entry-content"), ("div", "main-content"), ("div", "story text"),
    ("section", "article"), ("section", "body"), ("div", "page-content"), ("div", "blog-post"), ("td", "main"),
]
AROUND = {
    "menu": [("nav", ""), ("nav", "main-nav"), ("div", "nav"), ("div", "menu"), ("ul", "menu"), ("div", "navbar"), ("ul", "navigation"), ("div", "breadcrumb"), ("nav", "breadcrumbs"), ("div", "toc"), ("div", "pagination"), ("div", "tags")],
    "head": [("header", ""), ("header", "site-header"), ("div", "header"), ("div", "masthead"), ("div", "topbar"), ("div", "top-header")],
    "foot": [("footer", ""), ("footer", "site-footer"), ("div", "footer"), ("div", "copyright"), ("div", "bottom"), ("div", "legal")],
    "side": [("aside", ""), ("aside", "sidebar"), ("div", "sidebar"), ("div", "widget"), ("div", "side"), ("div", "related"), ("section", "related-posts"), ("div", "recommended"), ("div", "popular")],
    "advert": [("div", "ad"), ("div", "ads"), ("div", "advert"), ("div", "advertisement"), ("div", "banner"), ("div", "promo"), ("section", "sponsored"), ("div", "ad-slot"), ("aside", "ad"), ("p", "ad"), ("div", "adsense")],
    "notice": [("div", "cookie"), ("div", "cookie-notice"), ("div", "notice"), ("div", "consent"), ("div", "gdpr"), ("div", "alert"), ("div", "popup"), ("div", "modal"), ("p", "notice"), ("dialog", ""), ("section", "cookie-banner"), ("div", "disclaimer")],
    "form": [("form", ""), ("form", "search"), ("form", "newsletter"), ("div", "subscribe"), ("div", "login"), ("div", "signup"), ("form", "contact-form"), ("fieldset", "")],
    "reply": [("div", "comments"), ("section", "comments"), ("div", "comment-list"), ("ul", "comments"), ("ol", "commentlist"), ("div", "comment"), ("div", "replies"), ("div", "discussion"), ("div", "disqus"), ("section", "comment-section"), ("div", "responses")],
    "share": [("div", "share"), ("div", "social"), ("ul", "social-links"), ("div", "sharing")],
}


def _words(rng: random.Random, n: int) -> str:
    return " ".join("".join(rng.choice("aeiou") + rng.choice("bdklmnrst") for _ in range(rng.randint(1, 4))) for _ in range(n))


def _sentences(rng: random.Random) -> str:
    return " ".join(_words(rng, rng.choice((1, 3, 8, 15, 20))).capitalize() + "." for _ in range(rng.choice((1, 1, 1, 2, 3, 6))))


def _untold(kind: tuple[str, str], rng: random.Random) -> tuple[str, str]:
    """The element as one whose tag and class name tell nothing."""
    tag = kind[0] if kind[0] in ("ul", "ol", "td", "form", "fieldset", "p", "section") else "div"
    return tag, "".join(rng.choice("abcdefghij") for _ in range(5))


def _open(kind: tuple[str, str], label: int | None, rng: random.Random) -> str:
    tag, name = kind
    mark = f' data-l="{label}"' if label is not None else ""
    return f"<{tag}" + (f' {rng.choice(("class", "class", "id"))}="{name}"' if name else "") + mark + ">"


def _block(rng: random.Random) -> str:
    kind = rng.random()
    if kind < 0.62:
        text = _sentences(rng)
        if rng.random() < 0.2:
            text = f"{text} <a href='x'>{_words(rng, rng.randint(1, 6))}</a> {_words(rng, 4)}."
        return f"<p>{text}</p>"
    if kind < 0.74:
        return f"<h{rng.randint(1, 4)}>{_words(rng, rng.randint(1, 9))}</h2>"
    if kind < 0.82:
        return "<ul>" + "".join(f"<li>{_words(rng, rng.randint(1, 14))}" for _ in range(rng.randint(1, 5))) + "</ul>"
    if kind < 0.87:
        return f"<blockquote>{_sentences(rng)}</blockquote>"
    if kind < 0.91:
        return f"<pre>{_words(rng, rng.randint(1, 20))}</pre>"
    if kind < 0.95:
        return "<table>" + "".join(f"<tr><td>{_words(rng, 1)}</td><td>{_words(rng, 3)}</td></tr>" for _ in range(rng.randint(1, 4))) + "</table>"
    if kind < 0.97:
        return f"<figure><img src='x'><figcaption>{_words(rng, 6)}</figcaption></figure>"
    return f"<div>{_sentences(rng)}</div>"


def _around(rng: random.Random, kind: str, untold: bool = False) -> str:
    shell = rng.choice(AROUND[kind])
    if untold:
        shell = _untold(shell, rng)
    links = lambda n: "".join(f"<li><a href='/x'>{_words(rng, rng.randint(1, 3))}</a></li>" for _ in range(n))
    text = _sentences(rng)
    inner = {
        "menu": lambda: rng.choice(("<ul>" + links(rng.randint(2, 8)) + "</ul>", links(5), " ".join(f"<a href='/y'>{_words(rng, 1)}</a>" for _ in range(5)))),
        "head": lambda: rng.choice((f"<h1>{_words(rng, 2)}</h1><p>{_words(rng, 5)}</p>", f"<a href='/'>{_words(rng, 2)}</a>", f"<div>{_words(rng, 3)}</div>")),
        "foot": lambda: rng.choice((f"&copy; {_words(rng, 2)} &middot; {text}", f"<p>{text}</p>", "<ul>" + links(4) + "</ul>")),
        "side": lambda: rng.choice((f"<h3>{_words(rng, 2)}</h3><ul>{links(5)}</ul>", f"<p>{text}</p>", f"<h2>{_words(rng, 2)}</h2><p>{text}</p>", text)),
        "advert": lambda: rng.choice((text, f"<p>{text}</p>", f"<a href='/z'>{_words(rng, 4)}</a>")),
        "notice": lambda: rng.choice((text, f"<p>{text}</p><button>{_words(rng, 1)}</button>")),
        "form": lambda: f"<label>{_words(rng, 2)}</label><input name='q'><button>{_words(rng, 1)}</button>" + rng.choice(("", f"<p>{text}</p>")),
        "reply": lambda: "".join(rng.choice((f"<p>{_sentences(rng)}</p>", f"<div{'' if untold else " class='comment'"}><b>{_words(rng, 1)}</b><p>{_sentences(rng)}</p></div>", f"<li>{_sentences(rng)}</li>")) for _ in range(rng.randint(1, 4))),
        "share": lambda: "<ul>" + links(4) + "</ul>",
    }[kind]()
    return _open(shell, 0, rng) + inner + f"</{shell[0]}>"


def pages(n: int, seed: int = 1, untold: bool = False) -> list[str]:
    """``n`` labelled pages; ``untold`` ones have no tag or name that says what an element holds."""
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        shell = rng.choice(CONTENT)
        if untold:
            shell = _untold(shell, rng)
        body = [_block(rng) for _ in range(rng.randint(1, 9))]
        for kind in rng.sample(("advert", "share", "reply", "side", "form", "notice"), rng.choice((0, 0, 1, 2))):
            body.insert(len(body) if kind == "reply" else rng.randint(0, len(body)), _around(rng, kind, untold))
        content = _open(shell, 1, rng) + "".join(body) + f"</{shell[0]}>"
        if rng.random() < 0.4:
            content = "<div>" + content + "</div>" if untold else rng.choice(("<div>", "<div class='container'>", "<div id='wrapper'>", "<main>", "<div class='row'>")) + content + "</div>"
        before = [_around(rng, k, untold) for k in rng.sample(("head", "menu", "advert", "notice", "form"), rng.randint(0, 4))]
        after = [_around(rng, k, untold) for k in rng.sample(("side", "reply", "foot", "share", "advert", "notice", "menu"), rng.randint(0, 4))]
        out.append("<html><body>" + "".join(before) + content + "".join(after) + "</body></html>")
    return out

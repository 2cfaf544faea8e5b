"""Made-up pages whose main text is known, to learn extraction from."""

from __future__ import annotations

import random
import re

#: Class names that sites give to the parts of a page (fixed lists); "" stands for no attribute.
NAMES = {
    "body": ["article", "post", "content", "entry-content", "post-body", "story", "main-content", "article-body", "text", "", "", "c12", "wrap"],
    "menu": ["nav", "menu", "navbar", "main-menu", "breadcrumbs", "site-nav", "pagination", "", "toc"],
    "edge": ["header", "masthead", "site-header", "footer", "site-footer", "copyright", "top", "", "banner"],
    "side": ["sidebar", "widget", "related", "aside", "most-read", "recommended", "", "col-right", "trending"],
    "advert": ["ad", "ads", "advert", "sponsored", "promo", "advertisement", "banner-ad", "ad-slot"],
    "notice": ["cookie-notice", "consent", "newsletter", "popup", "modal", "gdpr", "alert", "subscribe", "notice"],
    "reader": ["comments", "comment-list", "discussion", "replies", "respond", "disqus_thread", "comment"],
    "share": ["share", "social", "tags", "post-meta", "byline", "share-buttons"],
    "form": ["search", "login", "contact-form", "search-form", ""],
}

#: Elements that say what a part of the page is; many pages have none of them, and many no names either.
SEMANTIC = re.compile(r"<(/?)(?:nav|header|footer|aside|article|main|section)\b")
NAMED = re.compile(r' (?:class|id)="[^"]*"')

MARKS = "\ue000\ue001"


def told(text: str) -> int | None:
    """Whether a block of text is marked as main text (1) or not (0)."""
    return next((MARKS.index(c) for c in text if c in MARKS), None)


class Writer:
    """Marks each block of text as main text (1) or not (0) with a private character before it."""

    def __init__(self, seed: int):
        self.r = random.Random(seed)
        self.words = ["".join(self.r.choice("aeiounrstlmdhg") for _ in range(self.r.randint(2, 9))) for _ in range(400)]

    def sentence(self, least: int, most: int) -> str:
        """A title, label or link: often without a stop."""
        words = [self.r.choice(self.words) + ("," if self.r.random() < 0.04 else "") for _ in range(self.r.randint(least, most))]
        return " ".join(words).capitalize() + self.r.choice(["", "", "", ".", ".", "!", "?"])

    def prose(self, most: int = 6) -> str:
        """Sentences of any length, with commas as dense as this text has them."""
        commas, longest, out = self.r.choice([0.0, 0.05, 0.1, 0.2]), self.r.choice([6, 12, 18, 30]), []
        for _ in range(self.r.randint(1, most)):
            words = [self.r.choice(self.words) + ("," if self.r.random() < commas else "") for _ in range(self.r.randint(1, longest))]
            out.append(" ".join(words).capitalize() + self.r.choice(["."] * 9 + ["!", "?"]))
        return " ".join(out)

    def said(self, main: int, text: str) -> str:
        return f"{MARKS[main]}{text}"

    def named(self, kind: str) -> str:
        name = self.r.choice(NAMES[kind])
        return f' {self.r.choice(["class", "class", "id"])}="{name}"' if name and self.r.random() < 0.85 else ""

    def links(self, most: int) -> str:
        items = "".join(f'<li>{self.said(0, "")}<a href="/x">{self.sentence(1, 4)}</a></li>' for _ in range(self.r.randint(2, most)))
        return f"<ul>{items}</ul>"

    def block(self, main: int) -> str:
        kind = self.r.random()
        close = "</p>" if self.r.random() < 0.8 else ""
        if kind < 0.66:
            lead = self.r.choice(["", "", "", "<b>", "<em>", '<a href="/y">'])
            return f"<p>{self.said(main, lead + self.prose())}{close}"
        if kind < 0.74:
            return f"<h2>{self.said(main, self.sentence(2, 6))}</h2>"
        if kind < 0.82:
            return "<ul>" + "".join(f"<li>{self.said(main, self.sentence(2, 14))}</li>" for _ in range(self.r.randint(2, 6))) + "</ul>"
        if kind < 0.88:
            return f"<blockquote>{self.said(main, self.prose(3))}</blockquote>"
        if kind < 0.9:
            return f'<figure><img src="/z"><figcaption>{self.said(main, self.prose(2))}</figcaption></figure>'
        if kind < 0.94:
            rows = "".join(f"<tr><td>{self.said(main, self.sentence(1, 4))}</td><td>{self.said(main, self.sentence(1, 4))}</td></tr>" for _ in range(self.r.randint(1, 4)))
            return f"<table>{rows}</table>"
        return f"<div>{self.said(main, self.prose(3))}</div>"

    def aside(self, kind: str) -> str:
        tag = {"menu": ["nav", "div", "ul"], "edge": ["header", "footer", "div"], "side": ["aside", "div", "section"], "form": ["form"]}.get(kind, ["div", "section", "div", "aside"])
        tag = self.r.choice(tag)
        if kind == "menu":
            return f"<{tag}{self.named(kind)}>{self.links(9)}</{tag}>"
        if kind == "form":
            return f'<form{self.named(kind)}><label>{self.said(0, self.sentence(1, 3))}</label><input><p>{self.said(0, self.sentence(2, 9))}</p><button>{self.sentence(1, 2)}</button></form>'
        if kind == "reader":  # each comment in an element of its own, never bare paragraphs
            who = f'<span>{self.said(0, self.sentence(1, 2))}</span>' if self.r.random() < 0.6 else ""
            each = self.r.choice(['<div class="comment">%s<p>{}</p></div>', "<li>%s<p>{}</p></li>", '<div class="reply">%s{}</div>', '<article class="comment">%s<p>{}</p></article>']) % who.replace("{", "").replace("}", "")
            return f"<{tag}{self.named(kind)}><h3>{self.said(0, self.sentence(1, 3))}</h3>" + "".join(each.format(self.said(0, self.prose(4))) for _ in range(self.r.randint(1, 8))) + f"</{tag}>"
        if kind == "side":
            inner = self.links(6) if self.r.random() < 0.6 else f"<h3>{self.said(0, self.sentence(1, 3))}</h3><p>{self.said(0, self.prose(2))}</p>"
            return f"<{tag}{self.named(kind)}>{inner}</{tag}>"
        text = self.said(0, self.r.choice(["", "&copy; "]) + self.prose(3))
        return f"<{tag}{self.named(kind)}>{self.r.choice([text, f'<p>{text}</p>'])}</{tag}>"

    def page(self) -> str:
        r = self.r
        body = self.r.choice(["<article{}>", "<article{}>", "<main{}>", "<div{}>", "<div{}>", "<section{}>"])
        tag = body[1:].split("{")[0]
        blocks = [self.block(1) for _ in range(r.choice([1, 1, 2, r.randint(1, 14), r.randint(3, 14), r.randint(3, 60)]))]
        if r.random() < 0.3:  # nothing but paragraphs, of any number and alike in length
            least = r.choice([1, 2, 3])
            blocks = [f"<p>{self.said(1, ' '.join(self.prose(3) for _ in range(least)))}</p>" for _ in range(r.choice([1, 2, 3, 5, 8, 12, r.randint(1, 60)]))]
        if r.random() < 0.25:
            blocks = [f"<p>{self.said(1, self.sentence(1, 8))}</p>" for _ in range(r.choice([1, 1, 1, 2]))]
        if r.random() < 0.06:
            plain = self.said(1, self.prose(8))
            return r.choice([plain, f"<p>{plain}", f"<html><body>{plain}</body></html>", f"<body><div>{plain}</div></body>"])
        for kind in ("advert", "share", "side", "form", "notice"):
            if r.random() < 0.2:
                blocks.insert(r.randint(0, len(blocks)), self.aside(kind))
        title = f"<h1>{self.said(1, self.sentence(2, 9))}</h1>" if r.random() < 0.8 else ""
        main = body.format(self.named("body")) + title + "".join(blocks)
        comments = r.random() < 0.3
        inside = comments and r.random() < 0.3
        if inside:
            main += self.aside("reader")
        main += f"</{tag}>"
        for _ in range(r.randint(0, 2)):
            main = f"<div{self.named('body') if r.random() < 0.4 else ''}>{main}</div>"
        before = [self.aside(k) for k in ("edge", "menu", "advert", "notice", "form") if r.random() < 0.5]
        after = [self.aside(k) for k in ("side", "advert", "menu", "edge", "notice") if r.random() < 0.5]
        if comments and not inside:
            after.append(self.aside("reader"))
        if r.random() < 0.1:
            before, after = [], []
        if r.random() < 0.15:  # the article's blocks lie in the body itself
            main = title + "".join(blocks)
        r.shuffle(before)
        r.shuffle(after)
        shown = "".join(before) + main + "".join(after)
        if r.random() < 0.35:
            shown = SEMANTIC.sub(r"<\1div", shown)
        if r.random() < 0.35:
            shown = NAMED.sub("", shown)
        return f"<html><head><title>{self.sentence(2, 6)}</title><style>p{{}}</style></head><body>{shown}</body></html>"


def pages(count: int, seed: int) -> list[str]:
    return [Writer(seed * 100_003 + k).page() for k in range(count)]

"""Pages with known main text, in many layouts and made-up words: what the block labeller is fitted and tested on."""

from __future__ import annotations

import html
import random

_SYLLABLES = "ta re in on ly the er an ou pa mento vi qua schi ung keit los ado cion pre st ko na mi su ra el ti mo du za be gri fel ha wo".split()
#: Words that stand in what is no article (plain text, a sample of common ones).
_MENU = "Home News Sports About Contact Login Register Search Shop Cart Help Blog Archive Politics World Culture Video Weather Jobs".split()
_NOTICES = ["We use cookies to improve this site. Accept all Reject", "This site uses cookies. By using it you accept our privacy policy.", "Please enable JavaScript to view this page.", "Subscribe to our newsletter", "You have read all free articles this month."]
_ADS = ["Advertisement", "Sponsored", "Buy now", "Special offer today only", "Ad"]


#: Stands at the start of each block of main text while a page is made.
MARK = "\ue000"


class _Page:
    """HTML that is written together with the text that an extractor should return."""

    def __init__(self, rng: random.Random):
        self.rng, self.html, self.main = rng, [], []

    def word(self) -> str:
        return "".join(self.rng.choice(_SYLLABLES) for _ in range(self.rng.choice((1, 1, 2, 2, 3, 4))))

    def sentence(self, low: int = 1, high: int = 18) -> str:
        words = [self.word() for _ in range(self.rng.randint(low, high))]
        odd = self.rng.random()
        if odd < 0.04:  # what stands in an article is not always prose
            return self.rng.choice((" | ", " | ", " · ", " > ")).join(words) + self.rng.choice(("", ".", " |"))
        if odd < 0.06:
            return " ".join(w + self.rng.choice(("###", "$$$", "&&&", "%%%")) for w in words)
        if odd < 0.08:
            return " ".join(w.upper() for w in words) + self.rng.choice(("", "!!", "."))
        return " ".join([words[0].capitalize(), *words[1:]]) + self.rng.choice((".", ".", ".", "!", "?", ""))

    def text(self, sentences: int) -> str:
        return " ".join(self.sentence() for _ in range(max(1, sentences)))

    def put(self, *parts: str) -> None:
        self.html += parts

    def keep(self, text: str, before: str, after: str) -> None:
        """A block of the main text, sometimes with markup inside."""
        self.main.append(text)
        words = text.split(" ")
        if len(words) > 3 and self.rng.random() < 0.3:
            k = self.rng.randrange(len(words) - 1)
            tag = self.rng.choice(("b", "em", "i", "strong", "a href='/x'", "span class='hl'"))
            words = [html.escape(w) for w in words]
            words[k] = f"<{tag}>{words[k]}</{tag.split()[0]}>"
            self.put(before, MARK, " ".join(words), after)
        else:
            self.put(before, MARK, html.escape(text), after)

    def links(self, n: int, wrap: str = "li") -> str:
        pick = lambda: self.rng.choice(_MENU) if self.rng.random() < 0.4 else self.word().capitalize()
        items = [f'<a href="/{k}">{pick()}{" " + self.word() if self.rng.random() < 0.3 else ""}</a>' for k in range(n)]
        if wrap == "li":
            return "<ul>" + "".join(f"<li>{a}</li>" for a in items) + "</ul>"
        return self.rng.choice((" | ", " ", " &middot; ")).join(items)

    def box(self, names: tuple[str, ...], inner: str, tags: tuple[str, ...] = ("div", "section")) -> None:
        tag, name = self.rng.choice(tags), self.rng.choice(names)
        kind = self.rng.choice((f' class="{name}"', f' id="{name}"', f' class="{name} {self.word()}"'))
        if tag not in ("div", "section") and self.rng.random() < 0.6:
            kind = ""
        self.put(f"<{tag}{kind}>{inner}</{tag}>")


def make_page(seed: int) -> tuple[str, str]:
    """(html, main text) of one made-up page; the same for the same seed."""
    page, main = marked_page(seed)
    return page.replace(MARK, ""), main


def marked_page(seed: int) -> tuple[str, str]:
    """The same with MARK before each block of main text."""
    rng = random.Random(seed)
    p = _Page(rng)
    chance = lambda x: rng.random() < x
    title = p.sentence(2, 12)
    p.put(f'<!DOCTYPE html><html lang="en"><head><meta charset="utf-8"><title>{html.escape(title)}</title>')
    p.put("<style>p{margin:0}</style>" if chance(0.7) else "", '<script>var t="</p>";track(1);</script>' if chance(0.7) else "", "</head><body>")

    def advert() -> None:
        inner = p.text(rng.randint(1, 3)) if chance(0.7) else rng.choice(_ADS)
        p.put("<!-- ad -->" if chance(0.5) else "")
        p.box(("ad", "ads", "advert", "banner", "sponsor", "promo"), inner if chance(0.6) else f"<p>{inner}</p>", ("div", "div", "aside"))

    def notice() -> None:
        inner = rng.choice(_NOTICES) if chance(0.6) else p.text(rng.randint(1, 2))
        p.box(("cookie", "cookie-notice", "notice", "consent", "alert", "gdpr"), f"<p>{inner}</p>" if chance(0.5) else inner)

    def menu() -> None:
        inner = p.links(rng.randint(1, 9), rng.choice(("li", "li", "flat")))
        p.box(("menu", "nav", "navbar", "topnav", "breadcrumb"), inner, ("nav", "nav", "div"))

    def heading() -> None:
        inner = f"<a href='/'>{p.word().capitalize()}</a>" + (f"<p>{p.sentence(2, 8)}</p>" if chance(0.6) else "") + (f"<nav>{p.links(rng.randint(2, 6))}</nav>" if chance(0.5) else "")
        p.box(("header", "masthead", "top", "site-header"), inner, ("header", "header", "div"))

    def sidebar() -> None:
        tag = rng.choice(("h2", "h3", "h3", "h4", "b"))
        inner = f"<{tag}>{p.sentence(1, 3)}</{tag}>" + (p.links(rng.randint(3, 8)) if chance(0.6) else f"<p>{p.text(rng.randint(1, 4))}</p>")
        if chance(0.15):
            inner += f"<table><tr><td>{p.word()}</td><td>{rng.randint(0, 999)}</td></tr></table>"
        p.box(("sidebar", "related", "widget", "trending", "recommended"), inner, ("aside", "aside", "div"))

    def form() -> None:
        inner = f"<label>{p.word()}</label><input name='q'>" + (f"<p>{p.sentence(2, 10)}</p>" if chance(0.5) else "") + f"<button>{p.word()}</button>"
        p.put(f"<form>{inner}</form>")

    def comments() -> None:
        items = "".join(f"<div class='comment'><b>{p.word()}</b><p>{p.text(rng.randint(1, 4))}</p><a href='#r'>Reply</a></div>" for _ in range(rng.randint(1, 5)))
        p.box(("comments", "comment-list", "discussion", "responses"), f"<{(tag := rng.choice(('h2', 'h3', 'h3', 'h4')))}>{rng.choice(('Comments', 'Responses', p.word()))}</{tag}>{items}", ("section", "div"))

    def footer() -> None:
        inner = f"&copy; {p.word()}.example.com &middot; {p.text(rng.randint(1, 2))}" if chance(0.6) else f"<p>{p.text(rng.randint(1, 2))}</p>" + p.links(rng.randint(1, 6), rng.choice(("li", "flat")))
        p.box(("footer", "bottom", "site-footer", "copyright"), inner, ("footer", "footer", "div"))

    def listing(tag: str) -> None:
        p.put(f"<{tag}>")
        for _ in range(rng.randint(2, 5)):
            p.keep(p.sentence(1, 9), "<li>", "</li>")
        p.put(f"</{tag}>")

    def subhead() -> None:
        tag = rng.choice(("h3", "h3", "h3", "h4", "h5", "h6"))
        p.keep(p.sentence(1, 7), f"<{tag}>", f"</{tag}>")
        if chance(0.7):
            p.keep(p.text(rng.randint(1, 4)), "<p>", "</p>")

    def table() -> None:
        width = rng.randint(2, 4)
        before, after = rng.choice((("<table>", "</table>"), ("<table class='data'>", "</table>"), ("<div class='table'><table>", "</table></div>")))
        p.put(before)
        if chance(0.3):
            p.keep(p.sentence(1, 8), "<caption>", "</caption>")
        for row in range(rng.randint(2, 5)):
            tag = "th" if row == 0 and chance(0.6) else "td"
            p.put("<tr>")
            for _ in range(width):
                p.keep(str(rng.randint(0, 9999)) if chance(0.4) else p.sentence(1, 3).rstrip(".!?"), f"<{tag}>", f"</{tag}>" if chance(0.9) else "")
            p.put("</tr>")
        p.put(after)

    def code() -> None:
        lines = [f"{p.word()} = {p.word()}({rng.randint(0, 99)})" for _ in range(rng.randint(1, 6))]
        p.main.append(" ".join(lines))
        inner = rng.choice(("{}", "<code>{}</code>")).format(MARK + "\n".join(lines))
        p.put(rng.choice(("<pre>{}</pre>", "<pre class='code'>{}</pre>", "<div class='highlight'><pre>{}</pre></div>")).format(inner))

    def terms() -> None:
        p.put("<dl>")
        for _ in range(rng.randint(1, 4)):
            p.keep(p.word(), "<dt>", "</dt>")
            p.keep(p.sentence(1, 14), "<dd>", "</dd>")
        p.put("</dl>")

    def figure() -> None:
        p.put("<figure>", rng.choice(("<img src='a.png'>", "<svg><path d='M0 0'/><text>x</text></svg>", "")))
        p.keep(p.sentence(2, 14), "<figcaption>", "</figcaption>")
        p.put("</figure>")

    def section() -> None:
        tag, names = rng.choice((("section", ""), ("section", ""), ("section", ""), ("section", " id='s2'"), ("div", " class='section'"), ("div", " class='paragraph'"), ("div", ""), ("div", ""), ("div", "")))
        p.put(f"<{tag}{names}>")
        if chance(0.6):
            subhead()
        p.keep(p.text(rng.randint(1, 4)), "<p>", "</p>")
        p.put(f"</{tag}>")

    def loose_text() -> None:
        p.keep(p.text(rng.randint(1, 4)), "<div>", "</div>")

    def formula() -> None:
        p.main.append(line := f"{p.sentence(2, 8)} x=2 {p.sentence(2, 8)}")
        a, b = line.split(" x=2 ")
        p.put(f"<p>{MARK}{a} <math><mi>x</mi><mo>=</mo><mn>2</mn></math> {b}</p>")

    def article() -> None:
        opening = rng.choice(("<article>", "<article>", "<article>", '<article class="post">', '<main><article>', "<main>", '<div class="content">', '<div class="post entry-content">', '<div id="article-body">', "<main><div class='story'>", "<div role='main'>"))
        p.put(opening)
        if chance(0.85):
            tag = rng.choice(("h1", "h1", "h2"))
            wrap = chance(0.2)
            p.keep(title if chance(0.8) else p.sentence(2, 10), f"<header><{tag}>" if wrap else f"<{tag}>", f"</{tag}></header>" if wrap else f"</{tag}>")
        loose = chance(0.4)
        rich = chance(0.6)  # others hold paragraphs only, with a list or a quotation
        for _ in range(rng.randint(60, 160) if chance(0.02) else rng.randint(1, 22)):
            kind = rng.random()
            if kind < 0.06:
                p.main.append(line := p.sentence(2, 30))
                p.put(f"<p><b>{MARK}{line}<br>")
            elif kind < 0.10:
                p.keep(p.sentence(1, 6), "<h2>", "</h2>")
            elif kind < 0.14:
                listing("ul")
            elif kind < 0.17:
                p.keep(p.text(2), "<blockquote><p>", "</p></blockquote>")
            elif kind < 0.19:
                advert()
            elif kind < 0.21:
                sidebar()
            elif rich and kind < 0.55:
                rng.choice((subhead, subhead, lambda: listing("ol"), table, code, terms, figure, section, section, loose_text, formula))()
            else:
                p.keep(p.text(rng.choice((1, 1, 1, 2, 3, 5, 8))), "<p>", "</p>" if not loose or chance(0.8) else "")
        if chance(0.15):
            p.box(("share", "social", "tags"), p.links(3, "flat"))
        if chance(0.12):
            comments()
        for tag in reversed([t[1:].split()[0].rstrip(">") for t in opening.replace("><", ">|<").split("|")]):
            p.put(f"</{tag}>")

    for part, odds in ((notice, 0.2), (heading, 0.35), (menu, 0.75), (form, 0.1), (advert, 0.5), (sidebar, 0.1)):
        if chance(odds):
            part()
    article()
    for part, odds in ((form, 0.15), (comments, 0.3), (sidebar, 0.3), (advert, 0.2), (menu, 0.15), (footer, 0.85), (notice, 0.1)):
        if chance(odds):
            part()
    p.put("</body></html>")
    page = "".join(p.html)
    return page, " ".join(p.main)

"""Labelled pages, built by rule, on which HTML extraction is fitted and held out.

A page is put together from parts in many forms: wrappers, menus, notices,
adverts, containers of the main text, asides, comments, footers.  The forms of
each kind are split in two: pages of one half fit the weights, pages of the
other, with class names and layouts that the fit never saw, test them.  In a
labelled page, comments mark where the main text begins and ends, and elements
to be left out bear the attribute data-part; `bare` takes both away.
"""

from __future__ import annotations

import random
import re
from typing import NamedTuple

MAIN, END = "<!--main-->", "<!--/main-->"
_SOUNDS = ["ka lo mi ren ta vi so ar el dun pe shi or an be", "er st and ion the ing ly re con ver un mal dor fe", "що на ре до ка ли мо ва ти пі", "un lé té oui reau ça mer dans por ciel"]
_PHRASES = ["Read more", "Sign in", "Home", "About us", "Contact", "Terms of use", "Most read", "Next page", "Share this", "Subscribe", "Archive"]

_LINKS = "{links}"
NAVS = [
    "<nav data-part><ul>{items}</ul></nav>", '<div data-part class="menu">{links}</div>', '<ul data-part id="navbar">{items}</ul>', '<div data-part role="navigation"><p>{links}</p></div>',
    '<table data-part class="nav"><tr><td>{links}</td></tr></table>', '<header data-part><h1>{phrase}</h1><p>{short}</p>{links}</header>', '<div data-part class="breadcrumbs">{links}</div>', "<p>{links}</p>",
    '<div data-part class="site-navigation"><ul>{items}</ul></div>', '<div data-part id="main-menu">{links}</div>', '<header data-part class="masthead"><p>{phrase}</p><nav data-part><ul>{items}</ul></nav></header>', '<div data-part class="toolbar search">{links} <span>{phrase}</span></div>',
]
NOTICES = [
    "", "", '<div data-part class="cookie-notice">{short} <button data-part>{phrase}</button></div>', '<div data-part id="consent"><p>{short}</p></div>', '<div data-part role="alert">{short}</div>', "<noscript>{short}</noscript>", '<div data-part class="popup"><p>{short}</p><p>{phrase}</p></div>', "",
    "", '<div data-part class="gdpr banner"><p>{short}</p></div>', '<section data-part class="notification">{short} {links}</section>', '<div data-part class="overlay"><p>{short}</p><button data-part>{phrase}</button></div>',
]
ADVERTS = [
    "", '<div data-part class="ad">{short}</div>', '<aside data-part class="promo"><p>{short}</p></aside>', '<div data-part id="banner">{short}</div>', '<div data-part class="sponsored-box"><h3>{phrase}</h3><p>{short}</p></div>', '<div data-part class="share">{links}</div>', '<div data-part class="widget related"><a href="/r">{short}</a></div>', "",
    "", '<div data-part class="advertisement"><p>{short}</p></div>', '<section data-part class="promotion"><a href="/b">{short}</a></section>', '<form data-part action="/s"><label data-part>{phrase}</label><input name="n"><p>{short}</p></form>',
]
WRAPPERS = [
    ("", ""), ("", ""), ('<form id="pageForm" action="/p">', "</form>"), ('<div class="page-header-wrapper">', "</div>"), ('<div id="page" class="site has-sidebar comments-open">', "</div>"), ("<div><div>", "</div></div>"), ('<div class="modal-ready nav-left">', "</div>"), ('<table class="layout menu-top"><tr><td>', "</td></tr></table>"),
    ("", ""), ('<form method="post"><div>', "</div></form>"), ('<div id="header-and-content" class="legal">', "</div>"), ('<section class="no-sidebar header-fixed">', "</section>"),
]
CONTAINERS = [
    ("<article>", "</article>"), ("<main><article>", "</article></main>"), ("<main>", "</main>"), ('<div class="content">', "</div>"), ("<section>", "</section>"), ("<div>", "</div>"), ('<div id="post" class="entry tag-news">', "</div>"), ("", ""),
    ('<article class="story">', "</article>"), ("<main><div>", "</div></main>"), ('<div class="body-text with-sidebar">', "</div>"), ('<div itemprop="articleBody">', "</div>"),
]
ASIDES = [
    "", "", '<aside data-part><h3>{phrase}</h3><ul>{items}</ul></aside>', '<div data-part class="sidebar"><h3>{phrase}</h3><p>{short}</p>{links}</div>', '<div data-part class="related"><h3>{phrase}</h3>{links}</div>', '<div data-part class="newsletter"><p>{short}</p><form data-part><label data-part>{phrase}</label><input></form></div>', "<ul>{items}</ul>", "<h3>{phrase}</h3><p>{links}</p>",
    "", '<div data-part id="sidebar-right" class="widget"><p>{short}</p><ul>{items}</ul></div>', '<section data-part class="recommended"><h4>{phrase}</h4>{links}</section>', '<div data-part role="complementary"><p>{short}</p><p>{links}</p></div>',
]
COMMENTS = [
    "", "", '<div data-part class="comments"><h3>{phrase}</h3><p>{short}</p><p>{long}</p></div>', '<section data-part id="comments"><ul><li>{short}</li><li>{long}</li></ul></section>', '<div data-part class="disqus"><p>{long}</p></div>', '<div data-part class="replies"><p>{short}</p><p>{short}</p></div>', '<ol data-part class="comment-list"><li>{long}</li><li>{short}</li></ol>', "",
    "", '<section data-part class="comments-area"><h2>{phrase}</h2><p>{long}</p><p>{short}</p></section>', '<div data-part id="respond"><p>{short}</p></div>', '<div data-part class="reader comments"><p>{short}</p><p>{long}</p></div>',
]
FOOTERS = [
    "<footer data-part>&copy; {short} {links}</footer>", '<div data-part class="footer"><p>{short}</p></div>', '<div data-part id="footer">{links}</div>', '<div data-part class="copyright">&copy; {short}</div>', "<p>{links}</p>", '<div data-part role="contentinfo">{short}</div>', "", "<footer data-part><p>{short}</p><p>{long}</p></footer>",
    '<div data-part class="site-footer"><p>{short}</p>{links}</div>', '<footer data-part class="legal"><p>{long}</p></footer>', '<div data-part class="social"><p>{links}</p></div>', "",
]
#: Sections of an article whose names only sound like parts of a page.
SECTIONS = ["related-work", "legal-background", "alert-history", "search-results-discussed", "header-section", "banner-years", "tags-and-labels", "notice-of-motion", "related-studies", "advert-law", "menu-of-the-day", "login-methods"]
_HALF = 8  # forms before this place are for the fit, the others are held out


class Page(NamedTuple):
    html: str  # with its labels
    text: str  # what is to be extracted


class _Writer:
    def __init__(self, seed: int, held_out: bool):
        self.r, self.held_out = random.Random(seed), held_out
        sounds = self.r.choice(_SOUNDS).split()
        self.words = ["".join(self.r.choice(sounds) for _ in range(self.r.randint(1, 3))) for _ in range(150)]

    def form(self, forms: list):
        return self.r.choice(forms[_HALF:] if self.held_out else forms[:_HALF])

    def prose(self, low: int, high: int) -> str:
        out = " ".join(self.r.choice(self.words) for _ in range(self.r.randint(low, high)))
        return out[0].upper() + out[1:] + self.r.choice([".", ".", "!", "?", ""])

    def part(self, forms: list[str]) -> str:
        form = self.form(forms)
        while "{" in form:
            form = re.sub(r"\{(\w+)\}", lambda m: self.fill(m[1]), form, count=1)
        return form

    def fill(self, name: str) -> str:
        link = lambda: f'<a href="/{self.r.randint(1, 99)}">{self.r.choice([self.r.choice(_PHRASES), self.prose(1, 6)])}</a>'
        many = range(self.r.randint(2, 8))
        return {
            "links": lambda: " | ".join(link() for _ in many), "items": lambda: "".join(f"<li>{link()}</li>" for _ in many),
            "phrase": lambda: self.r.choice(_PHRASES), "short": lambda: self.prose(4, 16), "long": lambda: self.prose(20, 60),
        }[name]()

    def rich(self, text: str) -> tuple[str, str]:
        """Inline markup and character references, and what they read as."""
        words, shown = text.split(" "), text.split(" ")
        for k in range(len(words)):
            x = self.r.random()
            if x < 0.02:
                words[k] = f"<b>{words[k]}</b>"
            elif x < 0.04:
                words[k] = f'<a href="/x">{words[k]}</a>'
            elif x < 0.05:
                words[k], shown[k] = words[k] + "&nbsp;&amp;&#8212;", shown[k] + " &—"
            elif x < 0.06:
                words[k] += "\n \t"
        return " ".join(words), " ".join(shown)

    def article(self) -> tuple[str, list[str]]:
        html, blocks = [], []

        def block(tag: str, low: int, high: int) -> str:
            marked, shown = self.rich(self.prose(low, high))
            blocks.append(shown)
            return f"<{tag}>{marked}</{tag}>" if tag != "p" or self.r.random() < 0.9 else f"<p>{marked}"

        if self.r.random() < 0.9:
            html.append(block("h1", 2, 14))
        for _ in range(self.r.randint(3, 12)):
            kind = self.r.random()
            if kind < 0.66:
                html.append(block("p", 12, 70))
            elif kind < 0.72:
                html.append(block("p", 1, 8))
            elif kind < 0.78:
                html.append(block("h2", 1, 11))
            elif kind < 0.84:
                html.append("<ul>" + "".join(block("li", 3, 20) for _ in range(self.r.randint(2, 5))) + "</ul>")
            elif kind < 0.88:
                html.append(f"<blockquote>{block('p', 8, 30)}</blockquote>")
            elif kind < 0.92:
                html.append("<table><tr>" + "".join(block("td", 1, 5) for _ in range(3)) + "</tr></table>")
            elif kind < 0.96:
                html.append(f'<section class="{self.form(SECTIONS)}">{block("h2", 1, 5)}{block("p", 30, 70)}{block("p", 15, 60)}</section>')
            else:
                html.append(self.part(ADVERTS))
        html.append(block("p", 15, 60))
        return "\n".join(html), blocks


def labelled_page(seed: int, held_out: bool = False) -> Page:
    w = _Writer(seed, held_out)
    (open_, close), (begin, end) = w.form(WRAPPERS), w.form(CONTAINERS)
    main, blocks = w.article()
    before = w.part(NOTICES) + w.part(NAVS) + w.part(ADVERTS)
    after = w.part(ASIDES) + w.part(COMMENTS)
    if w.r.random() < 0.3:
        before, after = w.part(ASIDES) + before, after + w.part(NAVS)
    head = f"<head><title>{w.prose(2, 5)}</title><style>p{{margin:0}}</style><script>var a = '<p>no</p>';</script></head>"
    html = f"<!DOCTYPE html><html>{head}<body>{open_}{before}{begin}{MAIN}{main}{END}{end}{after}{w.part(FOOTERS)}{close}</body></html>"
    return Page(html, "\n\n".join(blocks))


def bare(html: str) -> str:
    return html.replace(" data-part", "").replace(MAIN, "").replace(END, "")

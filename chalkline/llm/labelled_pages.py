"""Labelled training pages, generated: random layouts of invented text in which every block is known to be article or not."""

from __future__ import annotations

import random

_SYLLABLES = "an er on th st re en ti la mo ra de ka lo mi su ve po ni ta".split()


class PageMaker:
    """Makes one page; `labels` maps the text of each block to 1 (article) or 0."""

    def __init__(self, seed: int):
        self.r = random.Random(seed)
        self.labels: dict[str, int] = {}
        self.serial = 0

    def words(self, low: int, high: int) -> str:
        return " ".join("".join(self.r.choices(_SYLLABLES, k=self.r.randint(1, 4))) for _ in range(self.r.randint(low, high)))

    def sentences(self, low: int, high: int) -> str:
        return " ".join(self.words(3, 16).capitalize() + self.r.choice([".", ".", ".", "?", "!"]) for _ in range(self.r.randint(low, high)))

    def text(self, label: int, body: str) -> str:
        """Remember the block; a number makes its text unique."""
        self.serial += 1
        body = f"{body} {self.serial}" if self.r.random() < 0.5 or body in self.labels else body
        self.labels[" ".join(body.split())] = label
        return body

    def wrap(self, body: str, *choices: tuple[str, str]) -> str:
        tag, attributes = self.r.choice(choices)
        return f"<{tag}{' ' + attributes if attributes else ''}>{body}</{tag}>"

    def link(self, body: str) -> str:
        return f'<a href="/{self.r.randint(1, 99)}">{body}</a>'

    def links(self, low: int, high: int) -> str:
        plain = self.r.random() < 0.2
        return "<ul>" + "".join(f"<li>{t if plain else self.link(t)}</li>" for t in (self.text(0, self.words(1, 3)) for _ in range(self.r.randint(low, high)))) + "</ul>"

    def paragraph(self, label: int, low: int = 1, high: int = 5) -> str:
        body = self.sentences(low, high) if self.r.random() < 0.9 else self.words(1, 6)
        t = self.text(label, body)
        if self.r.random() < 0.2:
            head, _, tail = t.partition(" ")
            t = f"<b>{head}</b> {tail}" if tail else t
        if self.r.random() < 0.1:
            return f"<p><b>{t}<br>"
        return f"<p>{t}</p>" if self.r.random() < 0.9 else f"<p>{t}"

    def menu(self) -> str:
        return self.wrap(self.links(3, 8), ("nav", ""), ("nav", 'class="main"'), ("div", 'class="menu"'), ("div", 'id="nav-bar"'), ("div", 'role="navigation"'),
                         ("div", 'class="breadcrumbs"'), ("div", 'class="pagination"'))

    def header(self) -> str:
        name = self.wrap(self.text(0, self.words(1, 4).title()), ("h1", ""), ("p", ""), ("div", 'class="logo"'), ("h2", ""), ("p", 'class="tagline"'))
        return self.wrap(name + (self.menu() if self.r.random() < 0.5 else ""), ("header", ""), ("div", 'id="header"'), ("div", 'class="masthead"'), ("header", 'class="site-header"'),
                         ("div", 'role="banner"'))

    def advert(self) -> str:
        return self.wrap(self.text(0, self.sentences(1, 3)), ("div", 'class="ad"'), ("div", 'class="ads top"'), ("aside", 'class="advert"'), ("div", 'id="ad-slot"'),
                         ("section", 'class="sponsored"'), ("div", 'class="promo-box"'), ("p", 'class="advertisement"'), ("div", 'class="ad-banner"'))

    def notice(self) -> str:
        body = f"<p>{self.text(0, self.sentences(1, 3))}</p>" + (f"<button>{self.text(0, self.words(1, 2))}</button>" if self.r.random() < 0.5 else "")
        return self.wrap(body, ("div", 'class="cookie-banner"'), ("div", 'id="consent"'), ("div", 'role="dialog"'), ("section", 'class="notice"'), ("div", 'class="alert alert-info"'),
                         ("dialog", ""), ("div", 'class="gdpr-notice"'), ("div", 'class="popup" style="display:none"'))

    def side(self) -> str:
        body = f"<h3>{self.text(0, self.words(1, 4))}</h3>" + "".join(self.paragraph(0, 1, 3) if self.r.random() < 0.4 else self.links(2, 5) for _ in range(self.r.randint(1, 3)))
        return self.wrap(body, ("aside", ""), ("div", 'class="sidebar"'), ("div", 'id="side-content"'), ("div", 'class="related"'), ("aside", 'class="widget"'),
                         ("div", 'role="complementary"'), ("section", 'class="related-posts"'), ("div", 'class="trending"'))

    def comments(self) -> str:
        body = f"<h{self.r.choice('234')}>{self.text(0, self.words(1, 3))}</h3>"
        for _ in range(self.r.randint(1, 5)):
            who = f"<span>{self.words(1, 2)}</span>: " if self.r.random() < 0.3 else ""
            t = self.text(0, (who and who.replace("<span>", "").replace("</span>", "")) + self.sentences(1, 5))
            body += self.wrap(f"<p>{t}</p>" if self.r.random() < 0.6 else t, ("div", 'class="comment"'), ("li", ""), ("article", 'class="comment-body"'), ("div", ""))
        return self.wrap(body, ("section", 'class="comments"'), ("div", 'id="comments"'), ("div", 'class="comment-list"'), ("section", 'id="disqus_thread"'), ("div", 'class="reader-comments"'))

    def form(self) -> str:
        body = f"<label>{self.text(0, self.words(1, 3))}</label><input name='q'>" + (f"<p>{self.text(0, self.sentences(1, 2))}</p>" if self.r.random() < 0.5 else "")
        body += f"<button>{self.text(0, self.words(1, 2))}</button>"
        return self.wrap(body, ("form", ""), ("form", 'class="newsletter"'), ("form", 'id="search"'), ("form", 'action="/subscribe"'))

    def footer(self) -> str:
        body = self.text(0, f"© {self.words(1, 3)} · {self.sentences(1, 2)}") if self.r.random() < 0.6 else f"<p>{self.text(0, self.sentences(1, 2))}</p>" + self.links(2, 5)
        return self.wrap(body, ("footer", ""), ("div", 'id="footer"'), ("div", 'class="site-footer"'), ("footer", 'role="contentinfo"'), ("div", 'class="copyright"'))

    def share(self) -> str:
        return self.wrap(self.links(2, 4), ("div", 'class="share"'), ("div", 'class="social-links"'), ("div", 'class="tags"'))

    def article(self) -> str:
        r = self.r
        title = f"<h1>{self.text(1, self.words(2, 14).capitalize())}</h1>"
        parts = [f"<header>{title}</header>" if r.random() < 0.1 else title]
        for _ in range(r.randint(1, 10)):
            x = r.random()
            if x < 0.72:
                parts.append(self.paragraph(1))
            elif x < 0.79:
                parts.append(f"<h{r.choice('23')}>{self.text(1, self.words(1, 7))}</h2>")
            elif x < 0.85:
                parts.append("<ul>" + "".join(f"<li>{self.text(1, self.sentences(1, 1))}</li>" for _ in range(r.randint(2, 4))) + "</ul>")
            elif x < 0.89:
                parts.append(f"<blockquote>{self.paragraph(1, 1, 2)}</blockquote>")
            elif x < 0.92:
                parts.append("<table><tr>" + "".join(f"<td>{self.text(1, self.words(1, 3))}</td>" for _ in range(4)) + "</tr></table>")
            elif x < 0.95:
                parts.append(f"<figure><img src='x.png'><figcaption>{self.text(1, self.sentences(1, 1))}</figcaption></figure>")
            elif x < 0.97:
                parts.append(f"<div>{self.text(1, self.sentences(1, 4))}</div>")
            else:
                parts.append(f"<pre>{self.text(1, self.words(3, 12))}</pre>")
            if r.random() < 0.06:
                parts.append(r.choice([self.advert, self.share, self.side, self.form, self.notice])())
        if r.random() < 0.1:
            parts.append(self.comments())
        return self.wrap("".join(parts), ("article", ""), ("article", ""), ("article", 'class="post"'), ("main", ""), ("div", 'id="content"'), ("div", 'class="post-content"'), ("div", 'class="entry"'),
                         ("section", 'class="story-body"'), ("div", 'itemprop="articleBody"'), ("div", ""))

    def page(self) -> str:
        r = self.r
        if r.random() < 0.03:  # no markup around the article
            return self.text(1, self.sentences(1, 6)) if r.random() < 0.5 else self.paragraph(1) + self.paragraph(1)
        some = lambda part, p: part() if r.random() < p else ""
        body = some(self.notice, 0.25) + some(self.header, 0.5) + some(self.menu, 0.6) + some(self.advert, 0.4)
        middle = some(self.side, 0.15) + self.article() + some(self.share, 0.15) + some(self.advert, 0.2) + some(self.comments, 0.3) + some(self.form, 0.2) + some(self.side, 0.3)
        body += self.wrap(middle, ("div", ""), ("main", ""), ("div", 'class="container"'), ("div", 'id="main"'), ("div", 'class="wrapper"')) if r.random() < 0.4 else middle
        body += some(self.form, 0.15) + some(self.footer, 0.8) + some(self.notice, 0.1)
        return f"<!DOCTYPE html><html><head><title>{self.text(0, self.words(2, 9))}</title><style>p{{}}</style><script>var a='</p>';</script></head><body>{body}</body></html>"


def labelled_pages(n: int, seed: int = 0) -> list[tuple[str, dict[str, int]]]:
    """n pages with the labels of their blocks by text."""
    out = []
    for k in range(n):
        maker = PageMaker(seed * 1_000_003 + k)
        out.append((maker.page(), maker.labels))
    return out

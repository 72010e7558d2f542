"""Labelled pages to train on: pages set from seeded parts, each part known to be main text or not.

Layouts vary in the elements and names that hold the parts, in which parts there are and where, in
how well the tags are closed, and in the words, which are made of random syllables so that nothing is
learned from one language.
"""

from __future__ import annotations

import random
from html import escape

# fixed values: names that pages commonly give to their parts, and stock phrases of some parts
NAMES = {
    "main": "content main-content post post-content entry entry-content article article-body story story-body blog-post text page-content body-text single".split(),
    "nav": "nav navbar menu main-menu navigation breadcrumb breadcrumbs topnav site-nav links tabs pagination toc skip-links".split(),
    "header": "header masthead site-header page-header banner logo branding top topbar".split(),
    "footer": "footer site-footer page-footer copyright legal bottom colophon site-info credits".split(),
    "sidebar": "sidebar side aside widget widget-area related related-posts popular trending recommended more-stories recent tags archive".split(),
    "notice": "cookie cookie-notice cookie-banner consent gdpr notice alert popup modal overlay paywall newsletter-signup toast message-bar disclaimer".split(),
    "ad": "ad ads advert advertisement ad-slot sponsor sponsored promo promotion banner-ad adsbox dfp outbrain taboola partner".split(),
    "form": "search search-form login signup subscribe newsletter contact-form register form poll".split(),
    "comments": "comments comment-list comment comment-body responses discussion replies disqus thread reply user-comments".split(),
    "share": "share sharing social social-links share-buttons toolbar meta byline-links print actions".split(),
}
PHRASES = {
    "nav": "Home|About|Contact|News|Menu|Blog|Sign in|Log in|Start|Archive|Next|Previous|Skip to content|Sport|Help|FAQ|Products".split("|"),
    "header": "Welcome|The daily news|Your site for everything|Menu|Log in|Register|My account".split("|"),
    "footer": "© 2024 All rights reserved.|Privacy policy|Terms of use|Imprint|Impressum|Copyright 2023|Powered by|Contact us|Sitemap|Mentions légales".split("|"),
    "sidebar": "Related articles|Popular posts|Recent comments|Tags|Categories|Most read|You may also like|Archives|Follow us".split("|"),
    "notice": "We use cookies to improve this site.|Accept all|This site uses cookies.|By continuing you agree to our terms.|Sign up for our newsletter!|Please enable JavaScript.|You have two free articles left.".split("|"),
    "ad": "Advertisement|Sponsored|Buy now|Shop the sale|Anzeige|Publicité|Ad|Learn more|Limited offer".split("|"),
    "form": "Search|Email address|Subscribe|Send|Password|Your name|Submit|Log in|Remember me|Enter your e-mail".split("|"),
    "comments": "Comments|Leave a reply|Reply|3 comments|Log in to comment|Report|says:|Anonymous|1 day ago".split("|"),
    "share": "Share|Tweet|Print|E-mail|Share on Facebook|Copy link|Save|Like".split("|"),
}
#: Elements that hold a part, the plain ones more often.
HOLDERS = {
    # the empty one stands for text that lies in the body itself
    "main": ["article", "article", "article", "main", "div", "div", "div", "section", "main>article", "div>article", "td", "main>div", "", ""],
    "nav": ["nav", "nav", "div", "ul", "menu", "header>nav", "div>nav"], "header": ["header", "header", "div", "header>div"],
    "footer": ["footer", "footer", "div", "footer>div"], "sidebar": ["aside", "aside", "div", "section", "aside>section"],
    "notice": ["div", "div", "section", "dialog", "aside", "p"], "ad": ["div", "div", "aside", "section", "p"], "form": ["form", "form", "div>form", "section>form"],
    "comments": ["section", "div", "ol", "aside", "section>ol"], "share": ["div", "ul", "p", "section"],
}
SYLLABLES = "la re ti on an de er en st un ch ou ie au ng sch th ar os al ur em it ka mo vi sa né ü ñe ся ко 的 か".split()

#: Words that stand in texts of any kind, so that nothing is learned from them.
COMMON = """the of and to in is that it was for you we this with be are as at by my me from have not all your our will can one now
    use new more free time best get up on or if der die das und ist zu le la les et de un une que el los y en es""".split()


class Page:
    """One page: ``html`` and the lines of its main text."""

    def __init__(self, seed: int):
        self.rng = random.Random(seed)
        self.lines: list[str] = []
        self.marks = self.rng.choice(["", "", "", "", "!!", "###"])
        self.upper = self.rng.random() < 0.1
        self.named = self.rng.random() < 0.8  # whether parts carry telling names
        self.sloppy = self.rng.random() < 0.4
        self.html = self._page()

    def words(self, least: int, most: int) -> str:
        rng = self.rng
        out = []
        for _ in range(rng.randint(least, most)):
            word = rng.choice(COMMON) if rng.random() < 0.35 else "".join(rng.choices(SYLLABLES, k=rng.randint(1, 4)))
            out.append(word + (rng.choice([",", self.marks]) if rng.random() < (0.7 if self.marks else 0.08) else ""))
        text = " ".join(out)
        return text.upper() if self.upper else text[:1].upper() + text[1:]

    def prose(self) -> str:
        return " ".join(self.words(3, 16) + self.rng.choice([".", ".", ".", "?", "!", " &", ""]) for _ in range(self.rng.choice([1, 1, 2, 3, 5, 8])))

    def phrase(self, part: str) -> str:
        rng = self.rng
        return rng.choice(PHRASES[part]) if rng.random() < 0.5 else self.words(1, 4) if rng.random() < 0.6 else self.words(3, 9) + "."

    def opened(self, part: str, holder: str | None = None) -> tuple[str, str]:
        """Start and end tags of a part."""
        rng, start, end = self.rng, "", ""
        for tag in (rng.choice(HOLDERS[part]) if holder is None else holder).split(">"):
            if not tag:
                return "", ""
            own = " "
            telling = tag in ("nav", "header", "footer", "aside", "form", "article", "main", "dialog")
            if rng.random() < (0.35 if telling else 0.95 if part not in ("main", "ad") or self.named else 0.4):
                names = rng.sample(NAMES[part], rng.choice([1, 1, 2]))
                own += f'{rng.choice(["class", "class", "id"])}="{" ".join(names)}" '
            start, end = f"{start}<{tag}{own.rstrip()}>", f"</{tag}>{end}"
        return start, end

    def inline(self, text: str, links: float = 0.15) -> str:
        """``text`` with some inline elements around its words."""
        words = escape(text, quote=False).split(" ")
        for k in range(len(words)):
            if self.rng.random() < 0.03:
                tag = self.rng.choice(["b", "em", "i", "strong", "span", "code"])
                words[k] = f"<{tag}>{words[k]}</{tag}>"
            elif self.rng.random() < links / 8:
                words[k] = f'<a href="/x">{words[k]}</a>'
        return self.rng.choice([" ", " ", "\n  "]).join(words)

    def main(self, tag: str, text: str, attributes: str = "") -> str:
        self.lines.append(" ".join(text.split()))
        close = "" if tag in ("p", "li") and self.sloppy and self.rng.random() < 0.5 else f"</{tag}>"
        first = "<b>" if tag == "p" and self.sloppy and self.rng.random() < 0.3 else ""
        return f"<{tag}{attributes}>{first}{self.inline(text)}{self.rng.choice(['', '', '<br>'])}{close}"

    def article(self) -> str:
        rng = self.rng
        title = self.words(2, 12)
        out = []
        if rng.random() < 0.8:
            heading = self.main(rng.choice(["h1", "h1", "h2"]), title)
            out.append(f"<header>{heading}</header>" if rng.random() < 0.2 else heading)
        for _ in range(rng.choice([1, 1, 2, 3, 4, 6, 9, 14])):
            kind = rng.random()
            if kind < 0.72:
                out.append(self.main("p", self.prose()))
            elif kind < 0.78:
                out.append(self.main(rng.choice(["h2", "h3"]), self.words(1, 7)))
            elif kind < 0.84:
                tag = rng.choice(["ul", "ol"])
                out.append(f"<{tag}>" + "".join(self.main("li", self.words(1, 14)) for _ in range(rng.randint(1, 5))) + f"</{tag}>")
            elif kind < 0.87:
                out.append("<blockquote>" + self.main("p", self.prose()) + "</blockquote>")
            elif kind < 0.89:
                out.append(self.main("pre", self.words(2, 12)))
            elif kind < 0.91:
                out.append("<figure><img src=x>" + self.main("figcaption", self.words(2, 10)) + "</figure>")
            elif kind < 0.93:
                out.append("<table>" + "".join("<tr>" + "".join(self.main("td", self.words(1, 3)) for _ in range(2)) + "</tr>" for _ in range(2)) + "</table>")
            elif kind < 0.96:
                out.append(self.main("div", self.prose()))
            else:
                out.append(self.part(rng.choice(["ad", "ad", "share", "sidebar", "form", "notice"])))
        return "".join(out)

    def part(self, part: str) -> str:
        rng = self.rng
        start, end = self.opened(part)
        inner = []
        if part in ("nav", "share", "sidebar") or part == "footer" and rng.random() < 0.4:
            if part == "sidebar" and rng.random() < 0.7:
                inner.append(f"<{(h := rng.choice(['h2', 'h3', 'h4', 'p']))}>{escape(self.phrase(part))}</{h}>")
            items = [f'<a href="/{k}">{escape(self.phrase(part))}</a>' for k in range(rng.randint(2, 8))]
            style = rng.random()
            if start.startswith(("<ul", "<menu")) or style < 0.6:
                body = "".join(f"<li>{i}</li>" for i in items)
                inner.append(body if start.startswith(("<ul", "<menu")) else f"<ul>{body}</ul>")
            else:
                inner.append((" | " if style < 0.8 else "<br>" if style < 0.9 else " ").join(items))
            if part == "sidebar" and rng.random() < 0.4:
                inner.append(f"<p>{escape(self.prose())}</p>")
        elif part == "form":
            inner.append(f"<label>{escape(self.phrase(part))}</label><input><button>{escape(self.phrase(part))}</button>")
            inner.append(f"<p>{escape(self.phrase(part))}</p>" if rng.random() < 0.5 else "")
        elif part == "comments":
            item = "li" if start.endswith("<ol>") or start.startswith("<ol") else rng.choice(["div", "article", "p"])
            inner.append(f"<h3>{escape(self.phrase(part))}</h3>" if item != "li" else "")
            for _ in range(rng.randint(1, 5)):
                text = escape(self.prose())
                who = f"<span>{escape(self.words(1, 2))}</span> "
                inner.append(f"<{item} class=\"comment\">{who}{text if item == 'p' else f'<p>{text}</p>'}</{item}>" if rng.random() < 0.6 else f"<{item}>{text}</{item}>")
            if rng.random() < 0.4:
                inner.append(f"<form><textarea></textarea><p>{escape(self.phrase('comments'))}</p></form>")
        else:
            for _ in range(rng.choice([1, 1, 1, 2, 3])):
                text = self.phrase(part) if rng.random() < 0.6 else self.prose() if part in ("ad", "notice") else self.words(2, 12)
                host = f"© {self.words(1, 2)} · {self.words(2, 8)}." if part == "footer" and rng.random() < 0.5 else text
                inner.append(escape(host) if start.startswith("<p") or rng.random() < 0.4 else f"<p>{escape(host)}</p>")
            if part == "header" and rng.random() < 0.5:
                inner.append(f"<h1>{escape(self.words(1, 3))}</h1>" if rng.random() < 0.6 else f'<a href="/">{escape(self.words(1, 3))}</a>')
        return start + "".join(inner) + end

    def _page(self) -> str:
        rng = self.rng
        some = lambda part, p: self.part(part) if rng.random() < p else ""
        title = f"<title>{escape(self.words(2, 8))}</title>"
        out = ["<!DOCTYPE html><html><head><meta charset=utf-8>", title, "<style>p{margin:0}</style><script>var t='</p>';</script></head><body>"]
        out += [some("notice", 0.25), some("header", 0.45), some("nav", 0.7), some("form", 0.2), "<!-- top -->", some("ad", 0.4), some("sidebar", 0.2)]
        start, end = self.opened("main")
        if start.startswith("<td"):
            start, end = f"<table><tr>{start}", f"{end}</tr></table>"
        out += [start, self.article(), some("share", 0.2), end if not (self.sloppy and rng.random() < 0.1) else ""]
        out += [some("ad", 0.2), some("share", 0.15), some("comments", 0.35), some("sidebar", 0.35), some("form", 0.2), some("nav", 0.15), some("notice", 0.15)]
        out += [some("footer", 0.8), "" if self.sloppy else "</body></html>"]
        return rng.choice(["", "", "\n"]).join(out)


def pages(n: int, seed: int = 0) -> list[tuple[str, str]]:
    """``n`` pages with their main text, one line for a block."""
    made = [Page(seed * 1_000_003 + k) for k in range(n)]
    return [(p.html, "\n".join(p.lines)) for p in made]

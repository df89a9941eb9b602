"""Random page layouts with known labels, from which the block labeller learns.

A layout sets given sentences into an article and into the parts around and inside it that are no
article: menus, headers, footers, sidebars, notices, adverts, forms, share bars and reader
comments. Parts are marked by elements, by class words, or not at all. Labels are carried by a mark before
each article text, which is taken off again after the page was cut into blocks.
"""

from __future__ import annotations

import html
import re

import numpy as np

from .html_text import Block, blocks

_MARK = "\x02"

# Class words and elements by which pages name their parts, and what such parts usually say.
CLASSES = {
    "menu": "nav navbar navigation menu mainmenu topnav breadcrumb breadcrumbs pagination pager toc submenu tabs links sitemap",
    "header": "header masthead topbar top banner site brand logo branding hero tagline",
    "footer": "footer foot bottom colophon copyright legal imprint impressum credits",
    "side": "sidebar aside side rail widget widgets secondary complementary related recommended teaser teasers promo popular trending more also latest",
    "notice": "notice cookie cookies consent gdpr alert banner popup modal overlay newsletter subscribe signup warning message toast disclaimer announcement info paywall",
    "ad": "ad ads advert adverts advertisement advertising adsense adslot adbox banner sponsor sponsored promo promotion anzeige werbung publicite publicidad commercial",
    "form": "form search searchbox login newsletter contact subscribe signup register poll survey",
    "comments": "comments comment discussion disqus replies reply respond thread responses commentlist reader feedback kommentare commentaires comentarios",
    "share": "share social sharing follow buttons tools actions print",
    "main": "article content main post entry story body text page prose copy news blog maincontent articlebody",
}
ELEMENTS = {
    "menu": "nav menu ul",
    "header": "header",
    "footer": "footer",
    "side": "aside section",
    "notice": "div aside section dialog",
    "ad": "div aside section ins",
    "form": "form",
    "comments": "section aside div ol",
    "share": "div ul p",
    "main": "article main section",
}
NEUTRAL = "wrap wrapper container row col inner outer box section block group left right center clearfix layout grid item c1 c2 x1 module"
PHRASES = {
    "menu": "Home|About us|Contact|News|Sports|Politics|Products|Login|Start|Über uns|Kontakt|Nachrichten|Anmelden|Accueil|À propos|Actualités|Connexion|Inicio|Noticias|Acerca de|Next|Previous|Skip to content|Menu",
    "header": "The daily page|Your news every day|Welcome to our site|Willkommen|Bienvenue|Bienvenido|Log in|Search",
    "footer": "© 2024 All rights reserved|Copyright 2023 Example Inc.|Privacy policy|Terms of use|Impressum|Datenschutz|Mentions légales|Aviso legal|Alle Rechte vorbehalten|Tous droits réservés|Todos los derechos reservados|Powered by example|© example.com · Contact",
    "side": "Related articles|Most read|You may also like|Recommended for you|Popular posts|Mehr zum Thema|Meistgelesen|À lire aussi|Les plus lus|Te puede interesar|Lo más leído|Tags|Archive|Latest posts",
    "notice": "We use cookies to improve your experience.|This site uses cookies. By continuing you accept our policy.|Accept all|Wir verwenden Cookies.|Diese Seite nutzt Cookies, um Ihnen das beste Erlebnis zu bieten.|Nous utilisons des cookies.|Utilizamos cookies para mejorar su experiencia.|Subscribe to continue reading.|Please enable JavaScript to view this page.|Your browser is out of date.|You have 3 free articles left.",
    "ad": "Advertisement|Sponsored|Buy now and save 50%|Anzeige|Jetzt kaufen|Publicité|Publicidad|Limited offer: order today|Promoted content|Click here for the best deals",
    "form": "Search|Your email address|Sign up for our newsletter|Send|Name|Email|Subscribe|Suchen|Absenden|Ihre E-Mail-Adresse|Rechercher|Envoyer|Buscar|Enviar|I agree to the terms|Password|Forgot your password?",
    "comments": "Comments|3 comments|Leave a reply|Reply|Kommentare|Antworten|Commentaires|Répondre|Comentarios|Responder|Anonymous says:|Posted by user42 on 3 May 2021|Great article, thanks!|I disagree with this.|Log in to comment|Like|Report",
    "share": "Share|Tweet|Share on Facebook|Teilen|Partager|Compartir|Print|Email this|Follow us|Copy link",
}
_FALLBACK = "The town opened a new bridge over the river. Many people came to see it. Der Rat hat den Plan gestern beraten. La ville a rénové le marché. El museo abre sus puertas de nuevo."


def sentences(texts: list[str]) -> list[str]:
    """The sentences of texts, in order; a few of our own where there are none."""
    return [s for t in texts for s in re.findall(r"[^.!?]+[.!?]*", t) if s.strip()] or re.findall(r"[^.]+\.", _FALLBACK)


class _Page:
    def __init__(self, g: np.random.Generator, pool: list[str]):
        self.g, self.pool = g, pool
        self.marked = g.random() < 0.93  # whether class words tell the parts
        self.semantic = g.random() if self.marked else 0.5 + g.random() / 2  # how often elements do

    def odds(self, p: float) -> bool:
        return self.g.random() < p

    def one(self, words: str, by: str | None = None) -> str:
        every = words.split(by)
        return every[self.g.integers(len(every))]

    def some(self, low: int, high: int) -> range:
        return range(int(self.g.integers(low, high + 1)))

    def text(self, low: int = 1, high: int = 6) -> str:
        n = int(self.g.integers(low, high + 1))
        at = int(self.g.integers(len(self.pool)))
        said = " ".join(self.pool[(at + i) % len(self.pool)].strip() for i in range(n))
        if self.odds(0.08):
            said = self.one(said)
        if self.odds(0.08):
            said += "".join(f" {self.g.integers(10 ** self.g.integers(1, 17))}" for _ in self.some(1, 4))
        return self.inline(said)

    def inline(self, said: str) -> str:
        said = html.escape(said)
        if self.odds(0.15) and " " in said:
            a, b = said.split(" ", 1)
            tag = self.one('b i em strong span code a_href="/x"').replace("_", " ")
            return f"<{tag}>{a}</{tag.split()[0]}> {b}"
        return said

    def phrase(self, kind: str, own: float = 0.5) -> str:
        """Something such a part says: a usual phrase, a word or a sentence of the corpus."""
        if self.odds(own):
            return html.escape(self.one(PHRASES[kind], "|"))
        return self.text(1, 3) if self.odds(0.6) and kind not in ("menu", "share") else html.escape(self.one(self.pool[self.g.integers(len(self.pool))] or "x") if self.pool[0].split() else "x")

    def box(self, kind: str, inner: str) -> str:
        """A part in an element of its kind, or a plain one with class words, within plain ones now and then."""
        semantic = self.odds(self.semantic)
        tag = self.one(ELEMENTS[kind]) if semantic else self.one("div div div section")
        names = []
        if self.marked and (not semantic or self.odds(0.5)):
            names.append(self.one(CLASSES[kind]))
            if self.odds(0.4):
                names.insert(int(self.g.integers(2)), self.one(f"{NEUTRAL} {CLASSES[kind]}"))
        elif self.odds(0.3):
            names.append(self.one(NEUTRAL))
        name = self.one("- _ @").replace("@", " ").join(names)
        attr = f' {self.one("class class class id")}="{name}"' if names else ""
        if self.odds(0.1) and kind != "main":
            attr += ' data-x="1"'
        out = f"<{tag}{attr}>{inner}</{tag}>"
        for _ in self.some(0, 1):
            out = f'<div class="{self.one(NEUTRAL)}">{out}</div>' if self.odds(0.7) else f"<div>{out}</div>"
        return out

    def links(self, kind: str, low: int = 2, high: int = 8) -> str:
        item = lambda: f'<a href="/x">{self.phrase(kind)}</a>'
        rows = [item() for _ in range(int(self.g.integers(low, high + 1)))]
        if self.odds(0.75):
            return "<ul>" + "".join(f"<li>{r}</li>" for r in rows) + "</ul>"
        return self.one(" | @·@").replace("@", " ").join(rows) if self.odds(0.5) else "".join(f"<div>{r}</div>" for r in rows)

    def menu(self) -> str:
        return self.box("menu", self.links("menu"))

    def header(self) -> str:
        inner = self.one("div p h1 h2 span")
        return self.box("header", f"<{inner}>{self.phrase('header')}</{inner}>" + (self.links("menu") if self.odds(0.4) else ""))

    def footer(self) -> str:
        inner = self.phrase("footer", 0.7) + " &middot; " * self.odds(0.5) + self.phrase("footer")
        return self.box("footer", (self.links("footer") if self.odds(0.4) else "") + (f"<p>{inner}</p>" if self.odds(0.5) else inner))

    def plain(self, kind: str, low: int = 1, high: int = 3) -> str:
        """Sentences or phrases in paragraphs or bare."""
        rows = [self.phrase(kind) for _ in range(int(self.g.integers(low, high + 1)))]
        tag = self.one("p p div span")
        return rows[0] if len(rows) == 1 and self.odds(0.6) else "".join(f"<{tag}>{r}</{tag}>" for r in rows)

    def side(self) -> str:
        parts = [f"<h3>{self.phrase('side', 0.8)}</h3>" + (self.links("side") if self.odds(0.6) else self.plain("side")) for _ in self.some(1, 2)]
        return self.box("side", "".join(parts)) if parts else ""

    def form(self) -> str:
        inner = f'<label>{self.phrase("form", 0.8)}</label><input name="q">' + f"<p>{self.phrase('form')}</p>" * self.odds(0.4) + "<button>Go</button>"
        return self.box("form", inner if self.odds(0.4) else f'<form action="/s">{inner}</form>')

    def comments(self) -> str:
        tag, name = self.one("div li article div"), self.one("comment comment comment-body reply c post")
        rows = []
        for _ in range(int(self.g.integers(1, 7))):
            who = f"<{(t := self.one('span div cite h4 b'))}>{self.one(self.pool[self.g.integers(len(self.pool))] or 'x')}</{t}>" if self.odds(0.5) and self.pool[0].split() else ""
            rows.append(f'<{tag} class="{name}">{who}<p>{self.text(1, 4) if self.odds(0.8) else self.phrase("comments")}</p>' + '<a href="#">Reply</a>' * self.odds(0.3) + f"</{tag}>")
        title = f"<h3>{self.phrase('comments', 0.9)}</h3>" * self.odds(0.7)
        return self.box("comments", title + "".join(rows) + (self.form() if self.odds(0.3) else ""))

    def extra(self) -> str:
        """A part that may stand anywhere, inside the article too."""
        kind = self.one("ad ad notice share side form")
        if kind == "form":
            return self.form()
        if kind == "side":
            return self.side()
        return self.box(kind, self.links(kind) if kind == "share" else self.plain(kind))

    def article(self) -> str:
        say = lambda low=1, high=6: _MARK + self.text(low, high)
        parts = []
        if self.odds(0.85):
            title = f"<h1>{say(1, 1)}</h1>"
            parts.append(f"<header>{title}</header>" if self.odds(0.1) else title)
        same = self.text(1, 2) if self.odds(0.05) else None  # a page that says one thing again and again
        for _ in range(int(self.g.choice([1, 3, 6, 12, 20, 90], p=[0.2, 0.22, 0.22, 0.18, 0.15, 0.03]))):
            kind = self.g.random()
            if kind < 0.72:
                bold = "<b>" * self.odds(0.1)
                parts.append(f"<p>{_MARK}{bold}{same or self.text()}" + "<br>" * self.odds(0.1) + "</p>" * self.odds(0.9))
            elif kind < 0.80:
                t = self.one("h2 h3 h4")
                parts.append(f"<{t}>{say(1, 1)}</{t}>")
            elif kind < 0.86:
                t = self.one("ul ol")
                parts.append(f"<{t}>" + "".join(f"<li>{say(1, 2)}" + "</li>" * self.odds(0.8) for _ in range(int(self.g.integers(1, 6)))) + f"</{t}>")
            elif kind < 0.90:
                parts.append(f"<blockquote>{say()}</blockquote>" if self.odds(0.5) else f"<blockquote><p>{say()}</p></blockquote>")
            elif kind < 0.93:
                parts.append("<table>" + "".join(f"<tr><td>{say(1, 1)}</td><td>{say(1, 1)}</td></tr>" for _ in self.some(1, 3)) + "</table>")
            elif kind < 0.95:
                parts.append(f'<figure><img src="x.png"><figcaption>{say(1, 1)}</figcaption></figure>')
            elif kind < 0.97:
                parts.append(f"<div>{say()}</div>" if self.odds(0.7) else f"<pre>{say()}</pre>")
            elif self.odds(0.6):
                parts.append(self.extra())
        if self.odds(0.2):
            parts.insert(int(self.g.integers(len(parts) + 1)), self.extra())
        if self.odds(0.12):
            parts.append(self.comments())
        body = "".join(parts)
        for _ in self.some(0, 1):
            body = f'<div class="{self.one(CLASSES["main"])}-{self.one("body content text inner")}">{body}</div>' if self.marked else f"<div>{body}</div>"
        return self.box("main", body) if self.odds(0.9) else body

    def whole(self) -> str:
        before = [part() for part, p in ((self.header, 0.6), (self.menu, 0.75), (self.extra, 0.5), (self.extra, 0.2), (self.side, 0.2), (self.form, 0.15)) if self.odds(p)]
        after = [part() for part, p in ((self.extra, 0.25), (self.comments, 0.35), (self.side, 0.4), (self.extra, 0.15), (self.menu, 0.15)) if self.odds(p)]
        if self.odds(0.4):
            self.g.shuffle(before)
        middle = self.article()
        if self.odds(0.25):
            middle = self.box("main", "".join(before[1:]) + middle + "".join(after[:1])) if self.odds(0.3) else f'<div class="{self.one(NEUTRAL)}">{middle}{"".join(after[:1])}</div>'
            before, after = before[:1], after[1:]
        return "<html><body>" + "".join(before) + middle + "".join(after) + (self.footer() if self.odds(0.85) else "")


def page(g: np.random.Generator, pool: list[str]) -> tuple[list[Block], np.ndarray]:
    """A random page's blocks and which of them are the article's."""
    found = blocks(_Page(g, pool).whole())
    label = np.array([_MARK in b.text for b in found], np.int64)
    for b in found:
        b.text = b.text.replace(_MARK, "")
    kept = [i for i, b in enumerate(found) if b.text]
    return [found[i] for i in kept], label[kept]

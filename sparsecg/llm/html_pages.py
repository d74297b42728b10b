"""Labelled pages of many layouts, written by rule: each with the texts of its main blocks in order.

A layout is one way of building a site (LAYOUTS): an article element, named containers in several languages, plain
pages, tables, nested containers without telling names, manuals, discussions, markup without end tags. Words are
made up, so that nothing is learned about what pages say. Parts with telling containers get texts of any shape; parts
without them get the texts that such parts have.
"""

from __future__ import annotations

import html
import random
import re

_SYLLABLES = {
    "latin": "ba ke lo mi nu ra se ti vo wa el in or an de chi pra ste gu fo".split(),
    "accents": "bä ké lo mi nü ra ße ti vø wå él in ör an de çi prã ště gu fó".split(),
    "cyrillic": "ба ке ло ми ну ра се ти во ва ель ин ор ан де".split(),
    "han": list("山水人大小中天日月木火土金田文字学生年国"),
}
#: Names that sites give to the parts of a page, in several languages.
MAIN = """article content post entry main story text inhalt beitrag artikel
hauptinhalt textkörper contenu corps texte contenido articulo cuerpo noticia articolo contenuto testo conteudo artigo materia innehall tresc tekst""".split()
PARTS = {
    "menu": "nav menu navbar navigation topnav breadcrumb breadcrumbs tabs toc pagination pager menü hauptmenü navigationsleiste brotkrumen menú migas navegacion naviguer fil-ariane menu-principal navegação menyu".split(),
    "head": "header masthead site-header top-bar banner logo branding kopf kopfzeile kopfbereich entete bandeau cabecera encabezado intestazione testata cabeçalho".split(),
    "foot": "footer site-footer foot colophon copyright legal bottom fuss fusszeile fußzeile impressum pied pied-de-page pie piedipagina rodape rodapé".split(),
    "side": "sidebar side aside widget related recommended popular trending rail tags seitenleiste randspalte verwandt mehr-zum-thema barre-laterale annexe lateral barra-lateral relacionados colonna correlati".split(),
    "note": "notice cookie cookies consent gdpr alert popup modal overlay newsletter subscribe paywall promo share social hinweis meldung einwilligung teilen avis bandeau-cookies partager aviso alerta compartir avviso condividi".split(),
    "ad": "ad ads advert advertisement sponsored sponsor ad-slot adbox werbung anzeige reklame publicite pub annonce publicidad anuncio pubblicita patrocinado".split(),
    "talk": "comments comment comment-list discussion replies responses disqus kommentare kommentar leserkommentare commentaires commentaire reactions comentarios comentario commenti risposte".split(),
    "form": "search login signup contact-form form subscribe-form suche anmeldung formular recherche connexion formulaire buscar formulario ricerca accesso".split(),
}
_TAGS = {"menu": "nav div ul nav", "head": "header div", "foot": "footer div", "side": "aside div section", "note": "div section", "ad": "div aside ins div", "talk": "section div ol", "form": "form div form"}


class Maker:
    def __init__(self, seed: int):
        self.r = random.Random(seed)
        self.syllables = _SYLLABLES[self.r.choice(("latin", "latin", "latin", "accents", "accents", "cyrillic", "han"))]
        self.parts: list[str] = []
        self.says: list[str] = []
        self.open = self.r.random() < 0.25  # end tags that may be left out are

    # --- texts

    def word(self) -> str:
        return "".join(self.r.choice(self.syllables) for _ in range(self.r.randint(1, 4)))

    def words(self, lo: int, hi: int) -> str:
        return " ".join(self.word() for _ in range(self.r.randint(lo, hi)))

    def sentence(self) -> str:
        text = self.words(4, 20)
        if self.r.random() < 0.4:
            text = text.replace(" ", ", ", 1)
        return text.capitalize() + self.r.choice("....!?")

    def prose(self) -> str:
        return " ".join(self.sentence() for _ in range(self.r.randint(2, 7)))

    def any_text(self) -> str:
        """Text of any shape, for parts that are known by where they stand."""
        r, k = self.r, self.r.random()
        if k < 0.6:
            return " ".join(self.sentence() for _ in range(r.randint(1, 6)))
        if k < 0.72:
            return self.word().capitalize() + r.choice(("", "", ".", ",", "!"))
        if k < 0.84:
            return self.words(2, 50)
        if k < 0.92:
            return " ".join(self.sentence() for _ in range(r.randint(8, 25)))
        return " ".join(self.word() + r.choice(("", "+++", "~~", ";;", " | ", "@@", "!!!")) for _ in range(r.randint(2, 80)))

    def title(self) -> str:
        return self.words(2, 9).capitalize()

    # --- markup

    def put(self, markup: str) -> None:
        self.parts.append(markup)

    def say(self, form: str, text: str) -> None:
        """A block of the main text; form holds {} for it."""
        shown = html.escape(text, quote=self.r.random() < 0.5)
        if self.r.random() < 0.12 and " " in shown and "&" not in shown:
            a, b = shown.split(" ", 1)
            tag = self.r.choice(("b", "em", "i", "strong", "span", "code"))
            shown = self.r.choice((f"<{tag}>{a}</{tag}> {b}", f"<{tag}>{a} {b}", f'{a} <a href="/{self.word()}">{b}</a>' if len(b) < len(a) else f'<a href="#">{a}</a> {b}'))
        self.put(form.replace("{}", shown))
        self.says.append(" ".join(text.split()))

    def end(self, tag: str) -> str:
        return "" if self.open and tag in ("p", "li", "dt", "dd", "td", "tr") else f"</{tag}>"

    def links(self, n: int, tag: str = "li") -> str:
        return "".join(f'<{tag}><a href="/{self.word()}">{self.words(1, 4)}</a>{self.end(tag)}' for _ in range(n))

    def named(self, part: str) -> tuple[str, str]:
        r = self.r
        tag = r.choice(_TAGS[part].split())
        name = r.choice(PARTS[part]) + r.choice(("", "", "-1", "-wrap", " box", " clearfix", "_inner"))
        plain = tag in ("nav", "header", "footer", "aside", "form")
        attr = "" if plain and r.random() < 0.6 else f' {r.choice(("class", "class", "id"))}="{name}"'
        return f"<{tag}{attr}>", f"</{tag}>"

    def other(self, part: str | None = None) -> None:
        """A part that isn't main text, in a telling container."""
        r = self.r
        part = part or r.choice([*PARTS])
        a, z = self.named(part)
        block = lambda: r.choice((f"<p>{html.escape(self.any_text())}</p>", html.escape(self.any_text()), f"<div>{html.escape(self.any_text())}</div>", f"<h3>{self.title()}</h3>", f"<span>{self.sentence()}</span>"))
        blocks = lambda: "".join(block() for _ in range(r.randint(1, 3)))
        if part == "menu":
            n = r.randint(2, 9)
            inner = self.links(n) if a.startswith("<ul") else r.choice((f"<ul>{self.links(n)}</ul>", self.links(n, "span"), " | ".join(self.links(1, "b") for _ in range(n)), f"<ol>{self.links(n)}</ol>"))
        elif part == "foot":
            inner = r.choice((f"© {self.words(1, 3)} {self.any_text()}", f"<p>&copy; {self.title()}</p><ul>{self.links(3)}</ul>", blocks(), f"<small>{self.sentence()}</small>"))
        elif part == "talk":
            item = "li" if a.startswith("<ol") else r.choice(("div", "article", "p"))
            inner = "" if item == "li" else r.choice(("", f"<h3>{self.title()}</h3>"))
            inner += "".join(f'<{item}{r.choice((" class=comment", "", ""))}>' + r.choice(("", f"<b>{self.word()}</b> ", f"<cite>{self.words(1, 2)}</cite>")) + (html.escape(self.any_text()) if item == "p" else f"<p>{html.escape(self.any_text())}</p>") + f"</{item}>" for _ in range(r.randint(1, 4)))
        elif part == "form":
            inner = f"<label>{self.title()}</label><input name=x>" + r.choice(("", f"<p>{self.any_text()}</p>", f"<button>{self.word()}</button>", f"<select><option>{self.word()}<option>{self.word()}</select>"))
        elif part == "side":
            inner = r.choice((blocks(), f"<h3>{self.title()}</h3><ul>{self.links(4)}</ul>", f"<ul>{self.links(5)}</ul>"))
        elif part == "head":
            inner = r.choice((f'<a href="/">{self.title()}</a>', f"<h2>{self.title()}</h2><p>{self.sentence()}</p>", blocks(), f"<h1>{self.title()}</h1>"))
        else:
            inner = blocks() + r.choice(("", "", f"<button>{self.word()}</button>"))
        self.put(a + inner + z)

    def others(self, lo: int, hi: int) -> None:
        for _ in range(self.r.randint(lo, hi)):
            self.other()

    def body(self, text, inserts: float = 0.0) -> None:
        """Main blocks of many forms."""
        r = self.r
        for _ in range(r.randint(1, 8)):
            k = r.random()
            if k < 0.68:
                self.say(r.choice(("<p>{}" + self.end("p"), "<p>{}</p>", "<p>{}</p>", "<div>{}</div>")), text())
            elif k < 0.76:
                self.say(r.choice(("<h2>{}</h2>", "<h3>{}</h3>")), self.title())
            elif k < 0.84:
                kind = r.choice(("ul", "ol"))
                self.put(f"<{kind}>")
                for _ in range(r.randint(2, 5)):
                    self.say("<li>{}" + self.end("li"), self.sentence())
                self.put(f"</{kind}>")
            elif k < 0.9:
                self.say("<blockquote>{}</blockquote>", text())
            elif k < 0.94:
                self.say("<pre>{}</pre>", self.sentence())
            elif k < 0.97:
                self.put("<table>")
                for _ in range(r.randint(1, 4)):
                    self.put("<tr>")
                    for _ in range(2):
                        self.say("<td>{}" + self.end("td"), self.words(1, 6))
                    self.put(self.end("tr"))
                self.put("</table>")
            else:
                self.put("<figure><img src=x alt=y>")
                self.say("<figcaption>{}</figcaption>", self.sentence())
                self.put("</figure>")
            if r.random() < inserts:
                self.other(r.choice(("ad", "note", "side", "form")))

    # --- layouts

    def semantic(self) -> None:
        """An article or main element among other parts."""
        r = self.r
        self.others(0, 4)
        tag = r.choice(("article", "article", "main"))
        wrap = tag == "article" and r.random() < 0.3
        self.put("<main>" * wrap + f"<{tag}" + (f' class="{r.choice(MAIN)}"' if r.random() < 0.3 else "") + ">")
        k = r.random()
        if k < 0.55:
            self.say("<h1>{}</h1>", self.title())
        elif k < 0.85:
            self.put("<header>")
            self.say("<h1>{}</h1>", self.title())
            if r.random() < 0.4:
                self.say("<p>{}</p>", self.sentence())
            self.put("</header>")
        self.body(self.any_text, 0.08)
        if r.random() < 0.25:
            self.other(r.choice(("talk", "note", "side", "foot")))
        self.put(f"</{tag}>" + "</main>" * wrap)
        self.others(0, 4)

    def named_container(self) -> None:
        """A container with a telling name, in one of several languages."""
        r = self.r
        self.put('<div class="page wrapper">')
        self.others(0, 4)
        name = r.choice(MAIN)
        self.put(f'<{r.choice(("div", "div", "section"))} {r.choice(("class", "id"))}="{name}{r.choice(("", "", "-1", " col", "-area"))}">')
        tag = "div" if "<div" in self.parts[-1] else "section"
        if r.random() < 0.8:
            self.say(r.choice(("<h1>{}</h1>", "<h2>{}</h2>", "<div class=title>{}</div>")), self.title())
        self.body(self.any_text, 0.08)
        self.put(f"</{tag}>")
        self.others(0, 4)
        self.put("</div>")

    def plain(self) -> None:
        """No containers at all: headings and paragraphs, perhaps a line of links before and a short line after."""
        r = self.r
        if r.random() < 0.5:
            self.put(r.choice((f"<ul>{self.links(r.randint(2, 6))}</ul>", "<p>" + " | ".join(f'<a href="/{self.word()}">{self.word()}</a>' for _ in range(r.randint(2, 6))) + "</p>", " ".join(f'<a href="/{self.word()}">{self.word()}</a>' for _ in range(r.randint(2, 5))) + "<hr>")))
        if r.random() < 0.6:
            self.say("<h1>{}</h1>", self.title())
        for _ in range(r.randint(1, 6)):
            if r.random() < 0.15:
                self.say("<h2>{}</h2>", self.title())
            self.say("<p>{}" + self.end("p"), self.prose() if r.random() < 0.7 else self.sentence())
        if r.random() < 0.4:
            self.put(r.choice((f"<hr><p>&copy; {self.words(1, 3)}</p>", f"<address>{self.words(1, 4)}</address>", f'<p><a href="/">{self.words(1, 3)}</a></p>')))

    def table(self) -> None:
        """A table that lays out the page: cells of links beside or above a cell of text."""
        r = self.r
        loud = r.random() < 0.4
        put = lambda m: self.put(re.sub(r"</?[a-z]+", lambda t: t[0].upper(), m) if loud else m)
        put("<table width=100%>")
        if r.random() < 0.6:
            put(f"<tr><td colspan=2><b><a href=/>{self.title()}</a></b>" + self.end("td") + self.end("tr"))
        put("<tr>")
        side = r.choice(("left", "right", "above", "above"))
        links = lambda: r.choice(("<br>".join(f'<a href="/{self.word()}">{self.words(1, 3)}</a>' for _ in range(r.randint(2, 8))), f"<ul>{self.links(r.randint(2, 7))}</ul>", " ".join(f'<a href="/{self.word()}">{self.words(1, 2)}</a>' for _ in range(r.randint(2, 6)))))
        cell = lambda: put(r.choice(("<td width=150>", "<td>")) + links() + self.end("td"))
        if side == "above":
            cell()
            put(self.end("tr") + "<tr>")
        elif side == "left":
            cell()
        if r.random() < 0.4:
            self.say("<td>{}" + self.end("td"), self.prose())
        else:
            put("<td>")
            if r.random() < 0.7:
                self.say(r.choice(("<h1>{}</h1>", "<h2>{}</h2>")), self.title())
            for _ in range(r.randint(1, 5)):
                self.say("<p>{}" + self.end("p"), self.prose())
            put(self.end("td"))
        if side == "right":
            cell()
        put(self.end("tr"))
        if r.random() < 0.5:
            put(f"<tr><td colspan=2>&copy; {self.words(1, 4)}" + self.end("td") + self.end("tr"))
        put("</table>")

    def soup(self) -> None:
        """Containers whose names say nothing."""
        r = self.r
        name = lambda: r.choice((f' class="{self.code()}"', f' id="{self.code()}"', ""))
        deep = r.randint(1, 4)
        self.put(f"<div{name()}>" * deep)
        if r.random() < 0.7:
            self.put(f"<div{name()}>" + self.links(r.randint(2, 7), r.choice(("div", "span"))) + "</div>")
        self.put(f"<div{name()}>")
        if r.random() < 0.7:
            self.say(r.choice((f"<h1{name()}>{{}}</h1>", f"<div{name()}>{{}}</div>")), self.title())
        for _ in range(r.randint(1, 6)):
            self.say(r.choice((f"<div{name()}>{{}}</div>", "<p>{}</p>")), self.prose())
        self.put("</div>")
        if r.random() < 0.5:
            self.put(f"<div{name()}>" + r.choice((self.links(r.randint(2, 6), "div"), f"&copy; {self.words(1, 4)}")) + "</div>")
        self.put("</div>" * deep)

    def manual(self) -> None:
        """A main element with a table of contents, sections, definitions and code."""
        r = self.r
        self.other("head")
        self.other("menu")
        self.put('<main id="main">' if r.random() < 0.5 else '<div role="main">')
        tag = "main" if "<main" in self.parts[-1] else "div"
        if r.random() < 0.5:
            self.put(f"<nav>{self.links(r.randint(2, 6))}</nav>")
        self.say("<h1>{}</h1>", self.title())
        for _ in range(r.randint(1, 4)):
            self.put("<section>")
            self.say("<h2>{}</h2>", self.title())
            self.say("<p>{}" + self.end("p"), self.prose())
            if r.random() < 0.4:
                self.put("<dl>")
                for _ in range(r.randint(1, 4)):
                    self.say("<dt>{}" + self.end("dt"), self.words(1, 3))
                    self.say("<dd>{}" + self.end("dd"), self.sentence())
                self.put("</dl>")
            if r.random() < 0.3:
                self.say("<pre><code>{}</code></pre>", self.words(2, 12))
            self.put("</section>")
        self.put(f"</{tag}>")
        self.other("foot")

    def discussion(self) -> None:
        """A text with what readers said about it."""
        r = self.r
        self.others(0, 2)
        self.put(r.choice(("<article>", '<div class="post">', '<div class="entry-content">', '<section class="beitrag">')))
        tag = self.parts[-1][1:].split()[0].rstrip(">")
        self.say(r.choice(("<h1>{}</h1>", "<h2>{}</h2>")), self.title())
        self.body(self.any_text)
        if r.random() < 0.4:
            self.other("talk")
            self.put(f"</{tag}>")
        else:
            self.put(f"</{tag}>")
            self.other("talk")
        if r.random() < 0.5:
            self.other("form")
        self.others(0, 2)

    def code(self) -> str:
        return "".join(self.r.choice("abcdefghkmnpqrstuvwxyz0123456789") for _ in range(self.r.randint(4, 9)))

    def page(self, layout: str) -> tuple[str, list[str]]:
        r = self.r
        getattr(self, layout)()
        lang = r.choice(("", ' lang="en"', ' lang="de"', " lang=fr"))
        head = f"<html{lang}><head><meta charset=utf-8><title>{self.title()}</title>" + r.choice(("", f"<style>.{self.code()} {{ color: red }}</style>", f"<script>let {self.code()} = 1 < 2;</script>", "<link rel=stylesheet href=/x.css>")) + "</head><body>"
        page = r.choice(("<!doctype html>", "", "<!DOCTYPE html>\n")) + (head if r.random() < 0.9 else "") + r.choice(("", "\n")).join(self.parts) + r.choice(("</body></html>", "", "<!-- end -->"))
        return page, self.says


LAYOUTS = {"semantic": 4, "named_container": 4, "plain": 2, "table": 2, "soup": 2, "manual": 1, "discussion": 2}


def pages(n: int, seed: int = 7, layouts: tuple[str, ...] = tuple(LAYOUTS)) -> list[tuple[str, list[str]]]:
    """n pages of these layouts by their shares, each with the texts of its main blocks in order."""
    r = random.Random(seed)
    kinds = r.choices(layouts, [LAYOUTS[x] for x in layouts], k=n)
    return [Maker(seed * 100_003 + i).page(k) for i, k in enumerate(kinds)]

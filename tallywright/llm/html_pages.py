"""Labelled training pages for HTML extraction, made by a rule: random layouts whose main blocks carry a mark.

Every main block starts with MARK, a private-use character that features never see. Layouts vary the containers, names,
nesting, order and lengths that pages on the web use for articles, menus, headers, footers, sidebars, notices, adverts, forms
and reader comments.
"""

from __future__ import annotations

import random

MARK = ""
PAGES = 900

_MAIN = ["article", "main", "div.content", "div#content", "div.post", "div.entry-content", "section.article", "div.article-body", "div#main", "div.story", "div.post-content", "div.text", "td.content", "div.page-content", "div.markdown-body", "div.blog-post", "section", "div"]
_BOILER = {
    "menu": ["nav", "div.nav", "div#nav", "ul.menu", "div.navbar", "div.menu", "div#navigation", "div.breadcrumb", "nav.breadcrumbs", "ul#topnav", "div.toc", "div.pagination", "div.tabs", "header", "div.links"],
    "header": ["header", "div.header", "div#header", "div.masthead", "div.top-bar", "div.site-header", "div.branding", "header.site"],
    "footer": ["footer", "div.footer", "div#footer", "div.site-footer", "div.copyright", "div.bottom", "footer.page-footer", "div.legal"],
    "sidebar": ["aside", "div.sidebar", "div#sidebar", "aside.side", "div.widget", "div.related", "div.right-column", "section.related", "div.popular", "div.recommended", "aside.sidebar", "div.secondary", "div.author-box", "div.tags"],
    "notice": ["div.notice", "div.cookie", "div#cookie-banner", "div.alert", "div.gdpr", "div.consent", "div.banner", "p.notice", "div.warning", "div.cookie-notice", "div.popup", "div.modal", "div.newsletter", "section.notice", "div.announcement", "aside.notice", "div.disclaimer"],
    "advert": ["div.ad", "div.ads", "div.advert", "div.advertisement", "div.sponsored", "div.promo", "aside.ad", "div#ad-top", "div.banner-ad", "div.sponsor", "ins.adsbygoogle", "section.promo", "p.ad", "div.ad-slot"],
    "form": ["form", "form.search", "div.search", "form#login", "div.subscribe", "form.newsletter", "div.login", "div.signup", "form.contact"],
    "comment": ["div.comments", "section.comments", "div#comments", "ol.commentlist", "div.comment", "section#discussion", "ul.comment-list", "div.disqus", "div.replies", "section.reader-comments", "div.responses", "article.comment", "div.feedback", "div.user-comments"],
}
_NEUTRAL = ["div", "div.wrapper", "div.container", "div.row", "div.inner", "section", "div.col", "div.clearfix", "div.block", "div#page", "div.layout"]
_VOWELS, _CONSONANTS = "aeiouäéíóüèáöñ", "bcdfghlmnprstvwz"


def _word(r: random.Random) -> str:
    return "".join(r.choice(_CONSONANTS) * (r.random() < 0.8) + r.choice(_VOWELS) + r.choice(_CONSONANTS) * (r.random() < 0.4) for _ in range(r.randint(1, 4)))


def _words(r: random.Random, low: int, high: int) -> str:
    n = r.randint(low, high)
    out = []
    for i in range(n):
        w = _word(r)
        out.append((w.capitalize() if i == 0 or out[-1].endswith(".") else w) + r.choice(["", "", "", "", "", ",", ".", " &amp;", "&nbsp;"] if i < n - 1 else ["."]))
    if r.random() < 0.08:
        out = [w + r.choice(["!!", "***", "%%%", "###", "$$$", "&amp;&amp;"]) for w in out]
    if r.random() < 0.05:
        out = [w.upper() for w in out]
    text = " ".join(out)
    return text.replace(" ", "\n", 3) if r.random() < 0.1 else text


def _wrap(name: str, inner: str, r: random.Random) -> str:
    tag, kind = name, ""
    for mark, attribute in ((".", "class"), ("#", "id")):
        if mark in name:
            tag, value = name.split(mark)
            if attribute == "class" and r.random() < 0.3:
                value += " " + r.choice(["wide", "box", "clear", "js-x", "col-4", "m-2"])
            if r.random() < 0.2:
                value = value.capitalize() if r.random() < 0.3 else value.replace("-", "_")
            quote = r.choice(['"', '"', "'"])
            kind = f" {attribute}={quote}{value}{quote}"
    end = "" if tag in ("p", "li") and r.random() < 0.5 else f"</{tag}>"
    if tag in ("ul", "ol") and "<li" not in inner:
        inner = "".join(f"<li>{x}</li>" for x in inner.split("<hr>"))
    return f"<{tag}{kind}>{inner}{end}" + r.choice(["", "", "\n", "\n  "])


def _inline(text: str, r: random.Random) -> str:
    words = text.split(" ")
    for _ in range(r.choice([0, 0, 1, 2])):
        at = r.randrange(len(words))
        tag = r.choice(["a href='/x'", "b", "em", "strong", "span", "code", "i"])
        words[at] = f"<{tag}>{words[at]}</{tag.split(' ')[0]}>"
    if r.random() < 0.1:
        words[0] = "<b>" + words[0]  # never closed
    return " ".join(words)


def _main(r: random.Random) -> str:
    parts = []
    if r.random() < 0.8:
        title = MARK + _words(r, 2, 12).rstrip(".")
        parts.append(r.choice([f"<h1>{title}</h1>", f"<h2>{title}</h2>", f"<header><h1>{title}</h1></header>", f'<h1 class="title">{title}</h1>']))
    for _ in range(r.choice([1, 2, 3, 5, 8, 12])):
        kind = r.random()
        long = MARK + _inline(_words(r, *r.choice([(1, 4), (5, 15), (20, 60), (40, 120)])), r)
        if kind < 0.72:
            parts.append(f"<p>{long}" + r.choice(["</p>", "</p>", "", "<br>"]))
        elif kind < 0.8:
            parts.append(r.choice(["<h2>{}</h2>", "<h3>{}</h3>", "<h4>{}</h4>"]).format(MARK + _words(r, 1, 7).rstrip(".")))
        elif kind < 0.86:
            parts.append("<ul>" + "".join(f"<li>{MARK}{_words(r, 2, 20)}</li>" for _ in range(r.randint(2, 5))) + "</ul>")
        elif kind < 0.9:
            parts.append(f"<blockquote>{r.choice(['', '<p>'])}{long}</blockquote>")
        elif kind < 0.93:
            parts.append("<table>" + "".join(f"<tr><td>{MARK}{_words(r, 1, 4)}</td><td>{MARK}{_words(r, 1, 6)}</td></tr>" for _ in range(r.randint(1, 4))) + "</table>")
        elif kind < 0.95:
            parts.append(f"<pre>{long}</pre>")
        elif kind < 0.97:
            parts.append(f"<figure><img src=x><figcaption>{MARK}{_words(r, 3, 12)}</figcaption></figure>")
        else:
            parts.append(f"<div>{long}</div>")
    for _ in range(r.choice([0, 0, 0, 1, 1, 2])):  # what isn't of the article may stand inside it
        parts.insert(r.randint(1, len(parts)), _boiler(r.choice(["advert", "notice", "form", "sidebar", "advert"]), r))
    return "".join(parts)


def _boiler(kind: str, r: random.Random) -> str:
    name = r.choice(_BOILER[kind])
    links = lambda a, b: "".join(r.choice(["<li><a href='/{0}'>{0}</a></li>", "<a href='#'>{0}</a> | ", "<li><a href=/x>{0}</a>"]).format(_words(r, 1, 3).rstrip(".")) for _ in range(r.randint(a, b)))
    if kind == "menu":
        inner = r.choice(["<ul>{}</ul>", "{}", "<ol>{}</ol>", "<div>{}</div>"]).format(links(2, 9))
    elif kind == "header":
        inner = r.choice(["<h1>{}</h1>", "<div>{}</div>", "<a href=/><img src=l>{}</a>", "<p>{}</p>"]).format(_words(r, 1, 6)) + (links(2, 6) if r.random() < 0.5 else "")
    elif kind == "footer":
        inner = r.choice(["&copy; {}", "<p>&copy; 2024 {}</p>", "<p>{}</p>", "<small>{}</small>", "<div>{} &middot; {}</div>"]).format(_words(r, 2, 25), _words(r, 2, 20)) + (links(1, 6) if r.random() < 0.4 else "")
    elif kind == "sidebar":
        inner = r.choice(["", "<h3>{}</h3>", "<h4>{}</h4>"]).format(_words(r, 1, 3)) + r.choice([links(2, 8), f"<p>{_words(r, 5, 50)}</p>", f"<ul>{links(2, 6)}</ul>", _words(r, 5, 30)])
    elif kind in ("notice", "advert"):
        inner = r.choice(["{}", "<p>{}</p>", "<span>{}</span>", "<h3>Ad</h3><p>{}</p>", "<p>{}</p><button>OK</button>", "<a href=/>{}</a>"]).format(_words(r, 2, 45))
    elif kind == "form":
        inner = r.choice(["<label>{}</label><input name=q>", "<p>{}</p><input type=text><button>{}</button>", "<select><option>{}</option><option>{}</option></select>", "<fieldset><legend>{}</legend><textarea>{}</textarea></fieldset>"]).format(_words(r, 1, 14), _words(r, 1, 3))
    else:
        inner = r.choice(["", "<h3>{}</h3>", "<h2>{}</h2>"]).format(_words(r, 1, 3)) + "".join(
            r.choice(["<div class='comment'><b>{0}</b><p>{1}</p></div>", "<li>{1}</li>", "<p>{1}</p>", "<article><header>{0}</header><p>{1}</p></article>", "<div class=reply>{1}</div>"]).format(_words(r, 1, 2), _words(r, 3, 70)) for _ in range(r.randint(1, 4))
        )
    if tag_of(name) == "p":
        inner = _words(r, 3, 40)
    return _wrap(name, inner, r)


def tag_of(name: str) -> str:
    return name.replace("#", ".").split(".")[0]


def page(r: random.Random) -> str:
    if r.random() < 0.03:
        return MARK + _words(r, 5, 80)  # no markup at all
    main = _wrap(r.choice(_MAIN), _main(r), r)
    for _ in range(r.choice([0, 0, 1, 2])):
        main = _wrap(r.choice(_NEUTRAL), main, r)
    before = [_boiler(k, r) for k in r.sample(["menu", "header", "notice", "advert", "form", "sidebar"], r.randint(0, 5))]
    after = [_boiler(k, r) for k in r.sample(["footer", "comment", "sidebar", "advert", "notice", "form", "menu", "comment"], r.randint(0, 6))]
    if r.random() < 0.5:
        after = sorted(after, key=lambda x: "footer" in x[:30])
    body = r.choice(["", "\n"]).join([*before, main, *after])
    if r.random() < 0.3:
        body = _wrap(r.choice(_NEUTRAL), body, r)
    comment = r.choice(["", "<!-- ad 3 -->", "<!-- <p>no</p> -->"])
    head = f"<head><title>{_words(r, 1, 9)}</title><style>p{{margin:0}}</style><script>var t=\"</p>\";f(0)</script></head>" if r.random() < 0.8 else ""
    return f"<!DOCTYPE html><html>{head}<body>{comment}{body}</body></html>" if r.random() < 0.9 else comment + body


def labelled_pages(n: int = PAGES, seed: int = 11) -> list[str]:
    r = random.Random(seed)
    return [page(r) for _ in range(n)]

"""DOM leaf blocks of a page, and labelled pages to learn from (operator 6)."""

from __future__ import annotations

import random
import re
from collections import Counter
from html.parser import HTMLParser

#: Tags that end a block where they start or end.
BLOCK_TAGS = frozenset(
    "address article aside blockquote body br button caption center dd details dialog div dl dt fieldset figcaption figure footer form"
    " h1 h2 h3 h4 h5 h6 head header hr html iframe label legend li main menu nav noscript ol optgroup option p pre section select"
    " summary table tbody td textarea tfoot th thead title tr ul".split())
#: Tags without content, and tags whose text is no text of the page.
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN_TAGS = frozenset("script style template".split())
#: An opening tag ends these, as pages often leave them open.
IMPLIED_END = {
    "p": {"p"}, "li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "tr": {"tr", "td", "th", "p"}, "td": {"td", "th", "p"},
    "th": {"td", "th", "p"}, "option": {"option"},
}
_P_ENDERS = frozenset(
    "address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol pre section table ul".split())
_NAME = re.compile(r"[a-z]+")


class Block:
    """A run of text between block tags: its text, its innermost tag, all ancestors' tags and names, its linked share."""

    __slots__ = ("text", "leaf", "tags", "names", "linked")

    def __init__(self, text: str, leaf: str, tags: frozenset[str], names: frozenset[str], linked: float):
        self.text, self.leaf, self.tags, self.names, self.linked = text, leaf, tags, names, linked


class _Reader(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.blocks: list[Block] = []
        # Per open tag its name, and the tags and names of it and all around it.
        self.stack: list[tuple[str, frozenset[str], frozenset[str]]] = []
        self.open: Counter[str] = Counter()
        self.parts: list[str] = []
        self.linked = self.hidden = self.links = 0

    def flush(self) -> None:
        if self.parts:
            raw = "".join(self.parts)
            text = " ".join(raw.split())
            if text:
                leaf, tags, names = self.stack[-1] if self.stack else ("", frozenset(), frozenset())
                self.blocks.append(Block(text, leaf, tags, names, self.linked / max(1, len(raw))))
            self.parts, self.linked = [], 0

    def handle_starttag(self, tag, attrs):
        if tag in BLOCK_TAGS:
            self.flush()
        if tag in VOID_TAGS:
            return
        ends = IMPLIED_END.get(tag, {"p"} if tag in _P_ENDERS else None)
        if ends:
            # Look no further than the nearest enclosing container.
            for i in range(len(self.stack) - 1, -1, -1):
                open_tag = self.stack[i][0]
                if open_tag in ends:
                    self._close(i)
                elif open_tag in BLOCK_TAGS:
                    break
        found = set()
        for key, value in attrs:
            if value and key in ("class", "id", "role"):
                found.update(_NAME.findall(value.lower()))
        _, tags, names = self.stack[-1] if self.stack else ("", frozenset(), frozenset())
        self.stack.append((tag, tags if tag in tags else tags | {tag}, names if found <= names else names | found))
        self.open[tag] += 1
        self.hidden += tag in HIDDEN_TAGS
        self.links += tag == "a"

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID_TAGS:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        if tag in BLOCK_TAGS:
            self.flush()
        if not self.open[tag]:
            return
        for i in range(len(self.stack) - 1, -1, -1):
            if self.stack[i][0] == tag:
                self._close(i)
                return

    def _close(self, i: int) -> None:
        for tag, _, _ in self.stack[i:]:
            self.open[tag] -= 1
            self.hidden -= tag in HIDDEN_TAGS
            self.links -= tag == "a"
        del self.stack[i:]

    def handle_data(self, data):
        if not self.hidden:
            self.parts.append(data)
            if self.links:
                self.linked += len(data)


def blocks(html: str | None) -> list[Block]:
    """The page's leaf blocks in order; none for a page without text."""
    if not html:
        return []
    reader = _Reader()
    reader.feed(html)
    reader.close()
    reader.flush()
    return reader.blocks


# ---- labelled pages -------------------------------------------------------

_SYLLABLES = "ba de fi go lu ma ne po ri su ta ve wo xi yu zen tor lin par ment".split()
#: Names under which sites put parts that are not the article, and those of articles.
CLUTTER = {
    "menu": "menu nav navbar navigation topnav breadcrumb breadcrumbs tabs toolbar".split(),
    "header": "header masthead topbar banner logo branding sitehead".split(),
    "footer": "footer bottom copyright legal colophon siteinfo".split(),
    "sidebar": "sidebar side rail widget widgets related recommended trending popular archive tags".split(),
    "notice": "notice cookie cookies consent gdpr alert popup modal overlay paywall".split(),
    "advert": "ad ads advert advertisement sponsored sponsor promo promotion banner".split(),
    "form": "search subscribe newsletter signup login form contact".split(),
    "comments": "comment comments discussion replies respond reviews disqus".split(),
    "share": "share sharing social follow".split(),
}
ARTICLE = "article content post entry story main text body page articlebody postbody".split()


def _words(rng: random.Random, n: int) -> str:
    out = ["".join(rng.choice(_SYLLABLES) for _ in range(rng.randint(1, 4))) for _ in range(n)]
    out = [w + rng.choice(["", "", "", "", "", ",", "."]) for w in out]
    return (" ".join(out)).capitalize() + rng.choice([".", ".", ".", "", "!", "?"])


def _name(rng: random.Random, names: list[str]) -> str:
    key = rng.choice(["class", "class", "id"])
    name = rng.choice(names)
    if rng.random() < 0.4:
        name += rng.choice(["-", "_", " "]) + rng.choice(["box", "wrap", "list", "top", "inner", "area", "container", "one"])
    return f' {key}="{name}"'


def _links(rng: random.Random, n: int) -> str:
    items = [f'<a href="/{i}">{_words(rng, rng.randint(1, 3))}</a>' for i in range(n)]
    return "<ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul>" if rng.random() < 0.7 else " | ".join(items)


def _clutter(rng: random.Random, kind: str) -> str:
    semantic = {"menu": "nav", "header": "header", "footer": "footer", "sidebar": "aside", "form": "form"}.get(kind)
    named = rng.random() < 0.75 or semantic is None
    tag = semantic if semantic and rng.random() < 0.6 else rng.choice(["div", "section"])
    if tag in ("div", "section"):
        named = True
    if kind in ("menu", "share"):
        body = _links(rng, rng.randint(2, 8))
    elif kind == "footer":
        body = f"&copy; {_words(rng, 3)} &middot; " + rng.choice([_words(rng, rng.randint(3, 20)), _links(rng, 3)])
    elif kind == "form":
        body = f"<label>{_words(rng, 2)}</label><input name=q><button>{_words(rng, 1)}</button>"
        body = body if tag == "form" else f"<form>{body}</form>"
    elif kind == "comments":
        body = f"<h3>{_words(rng, 2)}</h3>" + "".join(f"<p>{_words(rng, rng.randint(3, 60))}</p>" for _ in range(rng.randint(1, 5)))
    elif kind == "sidebar":
        body = f"<h3>{_words(rng, 2)}</h3>" + rng.choice([_links(rng, 5), f"<p>{_words(rng, rng.randint(4, 30))}</p>"])
    else:
        body = rng.choice([_words(rng, rng.randint(2, 40)), f"<p>{_words(rng, rng.randint(2, 40))}</p>"])
    return f"<{tag}{_name(rng, CLUTTER[kind]) if named else ''}>{body}</{tag}>"


def _article(rng: random.Random) -> tuple[str, list[str]]:
    out, texts = [], []
    if rng.random() < 0.85:
        texts.append(_words(rng, rng.randint(2, 10)))
        out.append(f"<h1>{texts[-1]}</h1>")
    for _ in range(rng.randint(1, 14)):
        kind = rng.choice(["p"] * 8 + ["open", "h2", "li", "quote", "link", "td", "plain"])
        t = _words(rng, rng.choice([1, 2, 4, 9, 20, 50, 120]) + rng.randint(0, 4))
        if kind in ("li", "td"):
            u = _words(rng, rng.randint(2, 25))
            texts += [t, u]
            out.append(f"<ul><li>{t}</li><li>{u}</li></ul>" if kind == "li" else f"<table><tr><td>{t}</td><td>{u}</td></tr></table>")
            continue
        if kind == "link":
            u = _words(rng, 3)
            texts.append(f"{t} {u} {t}")
            out.append(f'<p>{t} <a href="#">{u}</a> {t}</p>')
            continue
        texts.append(t)
        out.append({"p": f"<p>{t}</p>", "open": f"<p><b>{t}<br>", "h2": f"<h2>{t}</h2>", "plain": f"<div>{t}</div>",
                    "quote": f"<blockquote>{t}</blockquote>"}[kind])
    return "".join(out), texts


def labelled_page(rng: random.Random) -> tuple[str, list[str]]:
    """A page and the texts of its article, block by block."""
    body, texts = _article(rng)
    kind = rng.choice(["article", "main", "div", "div", "both"])
    name = _name(rng, ARTICLE)
    body = {"article": f"<article>{body}</article>", "main": f"<main>{body}</main>", "div": f"<div{name}>{body}</div>",
            "both": f"<main><article{name}>{body}</article></main>"}[kind]
    before = [_clutter(rng, k) for k in ("header", "menu", "notice", "advert", "share", "form") if rng.random() < 0.45]
    after = [_clutter(rng, k) for k in ("sidebar", "advert", "share", "comments", "form", "notice", "footer") if rng.random() < 0.5]
    rng.shuffle(before)
    head = f"<head><title>{_words(rng, 4)}</title><style>p{{margin:0}}</style><script>var a = '</p>';</script></head>"
    wrap = rng.choice(["{}", "{}", "<div id=wrapper>{}</div>", "<div class=\"container page\">{}</div>"])
    return f"<!DOCTYPE html><html>{head}<body>" + wrap.format("".join([*before, body, *after])) + "</body></html>", texts

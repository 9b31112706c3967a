"""HTML without third-party parsers: text, images and links, row by row.

One event parser with a depth counter for hidden elements serves every flavour; a flavour
is which tags are hidden, which break a line, and what stands for a break.
"""

from __future__ import annotations

import html as entities
import re
from dataclasses import dataclass
from html.parser import HTMLParser
from urllib.parse import unquote, urljoin, urlsplit

from pyspark.sql import Column
from pyspark.sql import types as T

from quillspark.functions import lexicon as lx
from quillspark.session import by_rows

VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())


@dataclass(frozen=True)
class Flavour:
    hidden: frozenset[str]
    opening: dict
    closing: dict


SIMPLE = Flavour(frozenset({"script", "style"}), dict.fromkeys(("br", "p", "div", "tr", "li", "h1", "h2", "h3", "h4"), " "), {})
ZONES = Flavour(frozenset({"style", "script", "head"}), dict.fromkeys(("p", "div", "br", "li", "tr", "h1", "h2", "h3"), "\n"), dict.fromkeys(("p", "div", "li", "tr"), "\n"))
CORPUS = Flavour(frozenset({"script", "style"}), dict.fromkeys(("p", "div", "li", "br"), "\n"), dict.fromkeys(("p", "div", "li"), "\n"))
RICH = Flavour(frozenset({"script", "style", "noscript", "template", "head", "title"}), {"br": "\n"}, {})

_CID = re.compile(r"^cid:\s*(.+?)\s*$", re.IGNORECASE)
_CSS_URL = re.compile(r"""url\(\s*['"]?([^'")]+)['"]?\s*\)""", re.IGNORECASE)
_HREF = re.compile(r"""href=["']?(https?://[^"'\s>]+)""", re.IGNORECASE)
_BARE = re.compile(r"""https?://[^\s<>"')\]]+""", re.IGNORECASE)


class _Events(HTMLParser):
    """Collects text pieces by flavour, and anchors, images, styles and backgrounds in document order."""

    def __init__(self, flavour: Flavour) -> None:
        super().__init__(convert_charrefs=True)
        self.flavour = flavour
        self.pieces: list[str] = []
        self.depth = 0
        self.base: str | None = None
        self.anchors: list[list] = []
        self.open_anchors: list[list] = []
        self.images: list[tuple[str, str | None]] = []
        self.styles: list[str] = []
        self.in_style = 0
        self.backgrounds: list[str] = []

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        f, a = self.flavour, {k: v or "" for k, v in reversed(attrs)}
        if tag in f.hidden:
            self.depth += tag not in VOID
        if tag in f.opening:
            self.pieces.append(f.opening[tag])
        if tag == "base" and "href" in a and self.base is None:
            self.base = a["href"].strip()
        elif tag == "a" and "href" in a:
            self.anchors.append([a["href"].strip(), []])
            self.open_anchors.append(self.anchors[-1])
        elif tag == "img" and a.get("src", "").strip():
            self.images.append((a["src"].strip(), a.get("alt") or None))
        elif tag == "style":
            self.in_style += 1
        if "background" in a and a["background"].strip():
            self.backgrounds.append(a["background"].strip())

    def handle_endtag(self, tag: str) -> None:
        f = self.flavour
        if tag in f.hidden:
            self.depth = max(0, self.depth - 1)
        if tag in f.closing:
            self.pieces.append(f.closing[tag])
        if tag == "a" and self.open_anchors:
            self.open_anchors.pop()
        if tag == "style":
            self.in_style = max(0, self.in_style - 1)

    def handle_data(self, data: str) -> None:
        if self.in_style:
            self.styles.append(data)
        if not self.depth:
            self.pieces.append(data)
            for a in self.open_anchors:
                if data.strip():
                    a[1].append(data.strip())


def events(source: str, flavour: Flavour) -> _Events:
    p = _Events(flavour)
    p.feed(source or "")
    p.close()
    return p


def simple(source: str) -> dict:
    """text with single spaces, distinct images and distinct http links (anchors, href attributes, bare addresses)."""
    p = events(source, SIMPLE)
    text = re.sub(r"\s+", " ", "".join(p.pieces)).strip()
    anchors = [a[0] for a in p.anchors if a[0].startswith(("http://", "https://"))]
    return {"text": text, "images": list(dict.fromkeys(i for i, _ in p.images)), "links": list(dict.fromkeys(anchors + _HREF.findall(source or "") + _BARE.findall(text)))}


def zone_text(source: str) -> str:
    return "".join(events(source, ZONES).pieces)


def corpus_text(source: str) -> str:
    return entities.unescape("".join(events(source, CORPUS).pieces))


def rich_text(source: str) -> str:
    """Text nodes one a line, blanks and blank lines collapsed."""
    p = events(source, RICH)
    text = "\n".join(p.pieces)
    text = re.sub(r"[ \t\xa0]+", " ", text)
    return re.sub(r"\n[ \t]*\n[ \t\n]*", "\n\n", text).strip()


def artifacts(source: str) -> dict:
    """links (url, context, position, scheme, is_cid) and images (url, cid, context) of a mail's HTML."""
    p = events(source, Flavour(frozenset({"script"}), {}, {}))

    def full(url: str) -> str:
        try:
            return urljoin(p.base, url.strip()) if p.base else url.strip()
        except ValueError:
            return url.strip()

    def scheme(url: str) -> str:
        try:
            return urlsplit(url).scheme.lower()
        except ValueError:
            return ""

    links, images = [], []

    def link(url: str, context: str | None, kind: str | None, cid: bool = False) -> None:
        links.append({"url": url, "context": context, "position": len(links), "scheme": kind, "is_cid": cid})

    for href, words in p.anchors:
        if href:
            context = " ".join(words)[:200] or None
            if _CID.match(href):
                link(href, context, "cid", True)
            else:
                link(full(href), context, scheme(full(href)) or None)
    for src, alt in p.images:
        if m := _CID.match(src):
            images.append({"url": None, "cid": unquote(m[1]), "context": alt})
        elif scheme(full(src)) not in lx.DANGEROUS_SCHEMES:
            images.append({"url": full(src), "cid": None, "context": alt})
    for target in (m.strip() for css in p.styles for m in _CSS_URL.findall(css)):
        if _CID.match(target):
            images.append({"url": None, "cid": unquote(target[4:].strip()), "context": None})
        elif scheme(full(target)) not in lx.DANGEROUS_SCHEMES:
            link(full(target), "css_background", scheme(full(target)))
    for target in p.backgrounds:
        if not _CID.match(target):
            link(full(target), "bg_attr", scheme(full(target)))
    return {"links": links, "images": images}


LINK = T.StructType([T.StructField("url", T.StringType()), T.StructField("context", T.StringType()), T.StructField("position", T.IntegerType()), T.StructField("scheme", T.StringType()), T.StructField("is_cid", T.BooleanType())])
HTML_IMAGE = T.StructType([T.StructField("url", T.StringType()), T.StructField("cid", T.StringType()), T.StructField("context", T.StringType())])
ARTIFACTS = T.StructType([T.StructField("links", T.ArrayType(LINK)), T.StructField("images", T.ArrayType(HTML_IMAGE))])
SIMPLE_TYPE = T.StructType([T.StructField("text", T.StringType()), T.StructField("images", T.ArrayType(T.StringType())), T.StructField("links", T.ArrayType(T.StringType()))])


def parsed(c: Column) -> Column:
    """struct<text, images, links> of simple(); null HTML counts as empty."""

    return by_rows(simple, SIMPLE_TYPE)(c)


def artifacts_of(c: Column) -> Column:
    return by_rows(lambda x: artifacts(x or ""), ARTIFACTS)(c)


def text_of(c: Column, flavour: str = "rich") -> Column:
    """Text by flavour: rich, zones or corpus."""
    return by_rows({"rich": rich_text, "zones": zone_text, "corpus": corpus_text}[flavour], T.StringType())(c)


def canonical(c: Column) -> Column:
    """The whole clean-up of a text for models: entities, tags, NFKC, masks, control characters, white space, case.

    Entities and NFKC have no built-in, so those two run in one Python function and the rest is native.
    """
    import unicodedata

    from quillspark.functions import text as tx

    def fold(x: str | None) -> str:
        return unicodedata.normalize("NFKC", re.sub(r"<[^>]+>", " ", entities.unescape(x or "")))

    return tx.mask(by_rows(fold, T.StringType())(c))

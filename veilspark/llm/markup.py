"""Pages to blocks of text: what each is inside of, and its words."""

from __future__ import annotations

import re
from dataclasses import dataclass
from html import unescape
from urllib.parse import urlsplit

TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(?P<close>/?)(?P<tag>[a-zA-Z][a-zA-Z0-9:-]*)"
    r"(?P<rest>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+|[^>]*+)(?:>|\Z)",
    re.S,
)
ATTRIBUTE = re.compile(r"([^\s=\"'/>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")

# Elements by their kind.
RAW = frozenset("script style noscript template textarea title iframe svg select object".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark nobr q s "
    "samp small span strike strong sub sup time tt u var wbr".split()
)
CHROME = frozenset("nav aside footer form dialog menu button head".split())
CHROME_ROLES = frozenset(
    "navigation banner contentinfo complementary search dialog alert alertdialog menu menubar".split()
)
#: Words of class and id that name what surrounds an article.
CHROME_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion nav navbar "
    "navigation menu breadcrumb breadcrumbs sidebar aside footer cookie cookies consent gdpr notice "
    "notification alert popup modal overlay newsletter subscribe subscription signup login share sharing "
    "social comment comments disqus respond related recommended teaser widget toolbar pagination "
    "pager skip masthead topbar".split()
)
PAGE_HEAD = frozenset(["header", "head"])


@dataclass
class Block:
    words: list[str]
    article: bool
    main: bool
    chrome: bool


def _labels(rest: str) -> tuple[set[str], str, bool]:
    """Words of class and id, the role, and whether the element is hidden."""
    names, role, hidden = set(), "", False
    for m in ATTRIBUTE.finditer(rest):
        attribute, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if attribute in ("class", "id"):
            names.update(re.split(r"[\s_:-]+", value))
        elif attribute == "role":
            role = value.strip()
        elif attribute == "hidden" or (attribute == "aria-hidden" and value == "true"):
            hidden = True
        elif attribute == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            hidden = True
    return names, role, hidden


class _Reader:
    def __init__(self):
        self.blocks: list[Block] = []
        self.text: list[str] = []
        # Per open element: tag, in article, in main, chrome by element, chrome by name.
        self.open: list[tuple[str, bool, bool, bool, bool]] = []

    def state(self) -> tuple[bool, bool, bool, bool]:
        return self.open[-1][1:] if self.open else (False, False, False, False)

    def end_block(self) -> None:
        words = unescape("".join(self.text)).split()
        self.text.clear()
        if words:
            article, main, element, named = self.state()
            self.blocks.append(Block(words, article, main, element or named))

    def start(self, tag: str, rest: str) -> None:
        if tag in VOID:
            if tag in ("br", "hr"):
                self.text.append(" ")
            return
        names, role, hidden = _labels(rest) if rest.strip() else (set(), "", False)
        article, main, element, named = self.state()
        opens = tag in ("article", "main") or role in ("main", "article")
        chrome = tag in CHROME or role in CHROME_ROLES or hidden or (tag == "header" and not article)
        called = tag not in ("html", "body", "main") and bool(names & CHROME_WORDS)
        called = called or (tag not in ("html", "body") and not article and "header" in names)
        if tag not in INLINE or chrome or called:
            self.end_block()
        if tag not in INLINE:
            self._imply(tag)
            article, main, element, named = self.state()
        if opens:
            named = named and article
        self.open.append(
            (
                tag,
                article or tag == "article" or role == "article",
                main or opens,
                element or chrome,
                named or called,
            )
        )

    def _imply(self, tag: str) -> None:
        """An open paragraph or item ends where the next begins."""
        ends = {"p"} | ({tag} if tag in ("li", "dt", "dd", "tr", "td", "th", "option") else set())
        for at in range(len(self.open) - 1, -1, -1):
            own = self.open[at][0]
            if own in ends:
                del self.open[at:]
                return
            if own not in INLINE:
                return

    def stop(self, tag: str) -> None:
        if tag == "br":
            self.text.append(" ")
            return
        at = next((i for i in range(len(self.open) - 1, -1, -1) if self.open[i][0] == tag), None)
        inline = tag in INLINE
        if inline and at is not None and any(x[0] not in INLINE for x in self.open[at:]):
            at = None
        if not inline or (at is not None and self.open[at][1:] != (self.open[at - 1][1:] if at else (False,) * 4)):
            self.end_block()
        if at is not None:
            del self.open[at:]


def read(html: str) -> list[Block]:
    """Blocks in page order, without comments, scripts, styles and what else is never shown."""
    reader, at = _Reader(), 0
    while True:
        m = TAG.search(html, at)
        if not m:
            reader.text.append(html[at:])
            break
        reader.text.append(html[at : m.start()])
        at = m.end()
        tag = (m["tag"] or "").lower()
        if not tag:
            continue
        if m["close"]:
            reader.stop(tag)
        elif tag in RAW:
            if not m["rest"].endswith("/"):
                end = re.compile(rf"</{tag}[^>]*(?:>|\Z)", re.I).search(html, at)
                at = end.end() if end else len(html)
        else:
            reader.start(tag, m["rest"])
    reader.end_block()
    return reader.blocks


def host_of(url: str | None) -> str:
    try:
        return urlsplit(url or "").hostname or ""
    except ValueError:
        return ""


def parts(html: str) -> tuple[list[str] | None, list[str], list[bool]]:
    """The blocks of the article, if the markup tells one; else None. Then the blocks around it,
    and whether the markup says that a block is not content."""
    blocks = read(html)
    chosen = [b for b in blocks if b.article and not b.chrome] or [b for b in blocks if b.main and not b.chrome]
    inside = {id(b) for b in chosen}
    rest = [b for b in blocks if id(b) not in inside]
    own = [" ".join(b.words) for b in chosen] if chosen else None
    return own, [" ".join(b.words) for b in rest], [b.chrome for b in rest]


def split(html: str) -> tuple[str | None, list[str], list[bool]]:
    """As ``parts``, with the article as one text."""
    inside, outer, chrome = parts(html)
    return None if inside is None else " ".join(inside), outer, chrome

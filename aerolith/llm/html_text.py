"""Main text of a page by composite text density.

The page is read into flat arrays of DOM nodes, in one pass and in time proportional to its length. Each
node's composite density is its characters per tag, lowered by the share of link text in it, and by a class,
id or role that names what is not an article. A node's score is the sum of its children's densities; the
subtree of the container with the highest score is chosen. The least density on the path from the body down
to it is the threshold that other subtrees along the path must reach to be part of the article (sections of
it do, comments of readers and link lists do not). Nothing inside the choice is left out but what such a
name marks. Elements that are never article text (scripts, menus, forms) and hidden ones are not read.
"""

from __future__ import annotations

import html as entities
import math
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aerolith.llm.common import map_texts

# Element names of HTML.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
RAW = {"script", "style", "textarea", "title", "noscript", "template", "iframe", "noembed", "noframes", "xmp"}
BLOCK = {
    "address", "article", "aside", "blockquote", "body", "br", "caption", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt",
    "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "head", "header", "hr", "html", "legend",
    "li", "main", "menu", "nav", "ol", "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul",
}
CLOSES_P = BLOCK - {"br", "html", "head", "body", "caption", "dd", "dt", "legend", "li", "summary", "tbody", "td", "tfoot", "th", "thead", "tr"}
# Elements without article text.
NO_TEXT = {
    "script", "style", "noscript", "template", "iframe", "head", "title", "nav", "header", "footer", "aside", "form", "button", "select",
    "textarea", "input", "option", "svg", "canvas", "object", "menu", "dialog", "label", "fieldset",
}
_WORD = r"(?:^|[\s_-])(?<!no-)(?<!has-)(?<!with-)(?:{})(?:$|[\s_-])"
#: Words in a class, an id or a role of what is hardly ever an article.
_NEVER = re.compile(
    _WORD.format(
        r"ads?|ad(?:vert\w*|sense|box|slot|unit)|banner|sponsor\w*|nav\w*|menu|breadcrumbs?|footer|header|masthead|comment\w*|replies|disqus|cookies?|consent|popup|modal|overlay|toast|newsletter|subscribe|signup|login|toolbar|pagination|pager|contentinfo|gdpr"
    ),
    re.I,
)
#: Words of what is often beside an article, but also names articles and frames around them.
_ASIDE = re.compile(_WORD.format(r"promo\w*|sidebar|side|reviews?|notices?|announcement|share|sharing|social|related|recommend\w*|widget|search|form|complementary|alert"), re.I)
#: What the density of a subtree without, with a milder and with another such name is multiplied by.
NAMED = (1.0, 0.5, 0.1)
#: Text that is all so named is the article if the page has an element for one, or, with the milder words, this many characters.
LEAST_NAMED = 120
#: Share of a path node's density that another subtree beside it must have, besides the threshold.
BESIDE = 0.6
_ARTICLE = re.compile(r"<(?:article|main|h1)\b", re.I)
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_TAG = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*(?:>|$)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|$)|</?[a-zA-Z][^>]*(?:>|$)", re.S)
_MARKS = re.compile(r"(?<![\w-])(class|id|role|style|hidden)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
_GAP = re.compile(r"\s+")
#: Names that a tag inside closes: a list item ends the one before, and so on.
_ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: Elements that can be the choice (and custom ones, whose names have a hyphen).
_CONTAINERS = {"div", "section", "td", "center", "body", "#page", "article", "main", "details"}
_HEADINGS = {"h1", "h2"}
_HOLDS = {"ul", "ol", "dl", "table", "select", "body", "article", "div", "section", "main"}


class Page:
    """DOM nodes in flat lists, in page order. Text pieces belong to a node; None marks the end of a block.

    ``named`` is 0 for a node with no name against it, 1 inside one of the milder words, 2 inside one of the others.
    """

    def __init__(self, source: str):
        self.name, self.parent, self.skip, self.named = ["#page"], [-1], [False], [0]
        self.pieces: list[tuple[int, str | None]] = []
        self._read(source)

    def _open(self, name: str, attributes: str, top: int) -> int:
        skipped, named = name in NO_TEXT, 0
        if not skipped and attributes:
            for m in _MARKS.finditer(attributes):
                kind, value = m[1].lower(), m[2] or m[3] or m[4] or ""
                if kind == "hidden" or kind == "style" and _HIDDEN.search(value):
                    skipped = True
                elif kind != "style" and name not in ("html", "body", "main"):
                    named = max(named, 2 if _NEVER.search(value) else 1 if _ASIDE.search(value) else 0)
        self.name.append(name)
        self.parent.append(top)
        self.skip.append(self.skip[top] or skipped)
        self.named.append(max(self.named[top], named))
        return len(self.name) - 1

    def _read(self, source: str) -> None:
        stack, at = [0], 0
        places: dict[str, list[int]] = {}  # of open elements in the stack, by name: no search ever walks the stack
        pieces, skip, name_of = self.pieces, self.skip, self.name

        def text(raw: str) -> None:
            if raw and not skip[stack[-1]]:
                pieces.append((stack[-1], entities.unescape(raw) if "&" in raw else raw))

        def cut() -> None:
            if pieces and pieces[-1][1] is not None:
                pieces.append((stack[-1], None))

        def last(names: set[str]) -> int:
            return max((places[n][-1] for n in names if places.get(n)), default=-1)

        def close(names: set[str], until: set[str]) -> None:
            """End the innermost open element of ``names`` and all inside it, unless one of ``until`` is inside."""
            k = last(names)
            if k < 0 or last(until) > k:
                return
            ended = [name_of[i] for i in stack[k:]]
            if any(n in BLOCK for n in ended):
                cut()
            for n in reversed(ended):
                places[n].pop()
            del stack[k:]

        while match := _TAG.search(source, at):
            text(source[at : match.start()])
            at = match.end()
            if match[2] is None:
                if match[0].startswith("<![CDATA["):
                    text(match[0][9:].removesuffix("]]>"))
                continue
            name = match[2].lower()
            if match[1]:
                if name == "br" or name == "p" and not places.get("p"):
                    cut()
                elif name not in VOID:
                    close({name}, {"body"} if name not in ("body", "html") else set())
                continue
            if name in CLOSES_P:
                close({"p"}, _HOLDS | {"td", "th", "li"})
            if name in _ENDS:
                close(_ENDS[name], _HOLDS - _ENDS[name])
            if name in BLOCK:
                cut()
            node = self._open(name, match[3], stack[-1])
            if name in VOID or match[3].endswith("/") and name not in BLOCK and name not in RAW:
                continue
            if name in RAW:
                shut = re.compile(rf"</{re.escape(name)}\b[^>]*(?:>|$)", re.I).search(source, at)
                if not skip[node]:
                    pieces.append((node, source[at : shut.start() if shut else len(source)]))
                at = shut.end() if shut else len(source)
                continue
            places.setdefault(name, []).append(len(stack))
            stack.append(node)
        text(source[at:])

    def _totals(self) -> tuple[list[int], list[int], list[int], list[int]]:
        """Of each subtree: characters without white space, tags, characters in links, link tags."""
        n = len(self.name)
        chars, tags, links, link_tags = [0] * n, [0] * n, [0] * n, [0] * n
        for node, piece in self.pieces:
            if piece is not None:
                chars[node] += len(piece) - sum(map(len, _GAP.findall(piece)))
        linked = [False] * n
        for i in range(1, n):
            linked[i] = linked[self.parent[i]] or self.name[i] == "a"
            if linked[i]:
                links[i] = chars[i]
        for i in range(n - 1, 0, -1):  # children stand behind their parents
            p = self.parent[i]
            if not self.skip[i]:
                chars[p] += chars[i]
                links[p] += links[i]
                tags[p] += tags[i] + 1
                link_tags[p] += link_tags[i] + (self.name[i] == "a")
        return chars, tags, links, link_tags

    def measure(self) -> None:
        """``chars``, ``density`` and ``score`` of every node."""
        n = len(self.name)
        self.chars, tags, links, link_tags = chars, *_ = self._totals()
        self.body = next((i for i, name in enumerate(self.name) if name == "body"), 0)
        share = links[self.body] / chars[self.body] if chars[self.body] else 0.0
        self.density, self.score = [0.0] * n, [0.0] * n
        for i in range(1, n):
            if chars[i] and not self.skip[i]:
                per_tag, plain = chars[i] / max(tags[i], 1), max(chars[i] - links[i], 1)
                base = math.log(chars[i] / plain * links[i] + share * chars[i] + math.e)
                lean = chars[i] / max(links[i], 1) * max(tags[i], 1) / max(link_tags[i], 1)
                self.density[i] = per_tag * math.log(lean) / base * NAMED[self.named[i]] if lean > 1 else 0.0
            self.score[self.parent[i]] += self.density[i]

    def choose(self) -> int:
        """The container with the highest score; of equals the outer or earlier one. An article element around it goes first."""
        inside = [False] * len(self.name)
        inside[self.body] = True
        best = self.body
        for i in range(self.body + 1, len(self.name)):
            inside[i] = inside[self.parent[i]] and not self.skip[i]
            holds = self.name[i] in _CONTAINERS or "-" in self.name[i]
            if inside[i] and holds and self.score[i] > self.score[best]:
                best = i
        return next((i for i in self.path(best) if self.name[i] == "article"), best)

    def path(self, node: int) -> list[int]:
        """A node and what it is in, up to the body."""
        out = [node]
        while out[-1] not in (self.body, 0):
            out.append(self.parent[out[-1]])
        return out

    def main_text(self, has_article: bool) -> str:
        """Text of the chosen subtree, its headings and the subtrees beside its path that are as dense."""
        self.measure()
        n, density, named = len(self.name), self.density, self.named
        chosen = self.choose()
        path = self.path(chosen)
        threshold = min(density[i] for i in path)
        beside = {self.parent[i]: i for i in path[:-1]}  # path node by its parent
        on_path = set(path)
        kept = [False] * n
        kept[chosen] = True
        for i in range(self.body + 1, n):
            if self.skip[i] or kept[i]:
                continue
            p = self.parent[i]
            aside = named[i] > named[p]  # the node itself has a name against it
            if kept[p]:
                kept[i] = not (aside and 2 * self.chars[i] < self.chars[chosen])
            elif p in beside and i not in on_path and self.name[chosen] != "article" and not aside:
                on = beside[p]
                dense = self.name[i] in _CONTAINERS and density[i] >= max(threshold, BESIDE * density[on]) and density[i] > 0
                kept[i] = dense or self.name[i] in _HEADINGS and i < on
        text = self._joined(kept)
        level = min((named[i] for i, piece in self.pieces if piece and kept[i] and not piece.isspace()), default=0)
        return "" if level and not has_article and (level > 1 or len(text) < LEAST_NAMED) else text

    def _joined(self, kept: list[bool]) -> str:
        """Blocks of the kept nodes in page order, white space inside one collapsed, joined by a space."""
        blocks, current = [], []
        for owner, piece in self.pieces:
            if piece is None:
                blocks.append("".join(current))
                current = []
            elif kept[owner]:
                current.append(piece)
        blocks.append("".join(current))
        return " ".join(b for b in (_GAP.sub(" ", x).strip() for x in blocks) if b)


def main_text(source: str) -> str:
    """The article of a page; empty where there is none."""
    return Page(source).main_text(bool(_ARTICLE.search(source))) if source else ""


def extract(pages: DataFrame, html: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """``keep``, text and n_chars (code points) of each page.

    A null or empty page has an empty text; so has one without any text outside menus and the like.
    Broken markup is read as far as it goes. Whole pages are read, in time proportional to their length; a page
    takes some 300 bytes of memory a tag. Rows are kept one for one, repeated ones too; a null id or url
    stays null. Columns besides ``keep`` and ``html`` are not read, whatever their names.
    """

    def work():
        def run(sources: list[bytes]) -> dict[str, list]:
            texts = [main_text(s.decode("utf-8")) for s in sources]
            return {"main_text": texts, "n_chars": [len(t) for t in texts]}

        return run

    named = map_texts(pages.select(*keep, F.col(html).alias("_html")), "main_text string, n_chars long", work, keep=keep, text="_html")
    return named.withColumnRenamed("main_text", "text")

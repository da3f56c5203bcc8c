"""The one piece of per-page Python: walk a page's tags once.

`text_nodes` yields every text node with a bit set of the elements around it; which nodes are
kept, in which order regions are preferred and how they are joined is decided in Spark columns.
`to_markdown` renders a page, because nested lists, tables and quotes need a stack.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from html.entities import html5

# One alternative per kind of markup: comment, declaration, end tag, beginning of a start tag, text.
_TOKEN = re.compile(
    r"<!--(?:>|->|.*?(?:--!?>|\Z))|<[!?][^>]*(?:>|\Z)"
    r"|</([a-zA-Z])|<([a-zA-Z])"
    r"|([^<]+|<)",
    re.S,
)
_NAME_END = re.compile(r"[\s/>]")
_ENTITY = re.compile(r"&(?:#([0-9]+)|#[xX]([0-9a-fA-F]+)|([a-zA-Z][a-zA-Z0-9.-]*));?")
# A name is only looked for where one begins, so a long run without `=` is read once.
_ATTRIBUTE = re.compile(r"""(?<![^\s=/>"'])([^\s=/>"']++)\s*+=\s*+(?:"([^"]*)"|'([^']*)'|([^\s>]+))""")
# Elements without content, and elements whose strings are not page text.
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr",
         "basefont", "bgsound", "command", "frame", "image", "isindex", "nextid", "spacer"}
_RAW = {"script", "style"}

# Bits of `inside`. The first three mark the preferred content regions, `noise` a selector match.
TAG_BITS = {name: 1 << i for i, name in enumerate([
    "article", "main", "body", "noise",
    "script", "style", "nav", "header", "footer", "aside", "form", "svg", "noscript", "meta", "head",
    "template", "rt", "rp",
])}
_REGIONS = ("article", "main", "body")
_NEVER_TEXT = TAG_BITS["template"] | TAG_BITS["rt"] | TAG_BITS["rp"] | TAG_BITS["script"] | TAG_BITS["style"]


def mask(tags: list[str]) -> int:
    return sum(TAG_BITS[t] for t in tags)


def _character(m: re.Match) -> str:
    decimal, hexadecimal, name = m.groups()
    if name:
        return html5.get(name + ";", "&" + name)
    code = int(decimal) if decimal else int(hexadecimal, 16)
    if 128 <= code < 160:
        return bytes([code]).decode("windows-1252", "replace")
    return chr(code) if 0 < code < 0x110000 else "�"


class _Tags:
    """Where the tags of a page end, worked out once: every quote and `>` is looked at a fixed number of times,
    however many tags lie before it."""

    def __init__(self, html: str):
        self.html = html
        self.marks = [m.start() for m in re.finditer("[\"'>]", html)]
        n = len(self.marks)
        # ends[i]: the first `>` outside quotes for a tag that is outside quotes at mark i, else -1
        self.ends = [-1] * (n + 1)
        following = {'"': -1, "'": -1}
        for i in range(n - 1, -1, -1):
            c = html[self.marks[i]]
            if c == ">":
                self.ends[i] = self.marks[i]
            else:
                if following[c] >= 0:
                    self.ends[i] = self.ends[following[c] + 1]
                following[c] = i
        # ending[i]: the last mark up to i from which a tag ends
        self.ending, last = [-1] * n, -1
        for i in range(n):
            last = i if self.ends[i] >= 0 else last
            self.ending[i] = last
        self.name_end = -1

    def end_of_name(self, at: int) -> int:
        if self.name_end < at:
            m = _NAME_END.search(self.html, at)
            self.name_end = m.start() if m else len(self.html)
        return self.name_end

    def start_tag(self, at: int) -> tuple[str, str, int] | None:
        """Name, attributes and end of the start tag whose name begins at `at`. A quoted `>` does
        not end it, unless the quotes do not work out; then the next `>` does. Quotes within the name count as its
        letters if they can."""
        stop = self.end_of_name(at + 1)
        mark = bisect_left(self.marks, stop)
        if self.ends[mark] < 0:
            inner = self.ending[mark - 1] if mark else -1
            if inner < 0 or self.marks[inner] <= at:
                end = self.html.find(">", stop)
                return (self.html[at:stop], self.html[stop:end], end + 1) if end >= 0 else None
            mark, stop = inner, self.marks[inner]
        end = self.ends[mark]
        return self.html[at:stop], self.html[stop:end], end + 1

    def end_tag(self, at: int) -> tuple[str, int] | None:
        stop = self.end_of_name(at + 1)
        end = self.html.find(">", stop)
        return (self.html[at:stop], end + 1) if end >= 0 else None


def tokens(html: str) -> Iterator[tuple[str, str, str]]:
    """(kind, name or text, attributes); kind is open, close, empty or text. Neighbouring text
    pieces come as one, comments and declarations split them. Time is linear in the page."""
    pending: list[str] = []
    at, size, last = 0, len(html), html.rfind(">")
    tags = _Tags(html)
    while at <= size:
        m = _TOKEN.match(html, at) if at < size else None
        if at > last and m and not html.startswith("<!--", at):
            pending.append(html[at:])  # no tag can end here any more
            at = size
            continue
        close = tags.end_tag(m.start(1)) if m and m[1] else None
        start = tags.start_tag(m.start(2)) if m and m[2] else None
        if m and (m[3] is not None or (m[1] and not close) or (m[2] and not start)):
            piece = m[3] if m[3] is not None else "<"
            pending.append(piece)
            at += len(piece)
            continue
        if pending:
            text = "".join(pending)
            yield "text", _ENTITY.sub(_character, text) if "&" in text else text, ""
            pending.clear()
        if m is None:
            return
        at = m.end()
        if close:
            name, at = close
            yield "close", name.lower(), ""
        elif start:
            name, attributes, at = start
            name = name.lower()
            if name in _VOID or attributes.endswith("/"):
                yield "empty", name, attributes
            else:
                yield "open", name, attributes
                if name in _RAW:
                    end = re.compile(rf"</{name}(?=[\s/>])", re.I).search(html, at)
                    at = end.start() if end else size


def _matches(attributes: str, classes: frozenset[str], ids: frozenset[str]) -> bool:
    for name, *values in _ATTRIBUTE.findall(attributes):
        value = "".join(values)
        if name.lower() == "class" and not classes.isdisjoint(value.split()):
            return True
        if name.lower() == "id" and value.strip() in ids:
            return True
    return False


def text_nodes(
    html: str, region_drop: int = 0, classes: frozenset[str] = frozenset(), ids: frozenset[str] = frozenset()
) -> tuple[list[str], list[int], int]:
    """(texts, inside bits, regions found). A region bit is set within the first such element of
    the page that is not inside a `region_drop` element. An end tag closes everything opened
    since its start tag; one without a start tag is ignored."""
    texts: list[str] = []
    bits: list[int] = []
    stack: list[tuple[str, int]] = []
    open_count: dict[str, int] = {}
    found = inside = 0
    for kind, name, attributes in tokens(html):
        if kind == "text":
            if not inside & _NEVER_TEXT:
                if not name.strip(" \n\t\f\r") and not (open_count.get("pre") or open_count.get("textarea")):
                    name = "\n" if "\n" in name else " "
                texts.append(name)
                bits.append(inside)
        elif kind == "close":
            if open_count.get(name):
                while stack:
                    top, inside = stack.pop()
                    open_count[top] -= 1
                    if top == name:
                        break
        else:
            bit = TAG_BITS.get(name, 0)
            if name in _REGIONS:
                if found & bit or inside & region_drop:
                    bit = 0
                found |= bit
            if attributes and (classes or ids) and _matches(attributes, classes, ids):
                bit |= TAG_BITS["noise"]
            if kind == "open":
                stack.append((name, inside))
                open_count[name] = open_count.get(name, 0) + 1
                inside |= bit
    return texts, bits, found


# How inline elements are wrapped, and which elements stand as blocks.
_INLINE_WRAP = {"b": "**", "strong": "**", "i": "*", "em": "*", "del": "~~", "s": "~~", "code": "`", "kbd": "`", "samp": "`"}
_BLOCK = {"p", "div", "article", "section", "main", "nav", "header", "footer", "aside", "form", "figure", "blockquote",
          "ul", "ol", "table", "pre", "hr", "body", "html", "dl", "dt", "dd", "address", "details", "summary"}
_HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")
# Enclosing elements that change how their content is rendered, by effect.
_EFFECTS = {
    **dict.fromkeys((*_HEADINGS, "td", "th"), ("one line",)), **dict.fromkeys(("code", "kbd", "samp"), ("literal",)),
    "pre": ("literal", "pre"), "li": ("item",), **dict.fromkeys(("template", "rt", "rp"), ("hidden",)),
}
# Quotes and items deeper than this print the marks of this many around them; their text and all else stays as it is.
MAX_MARKS = 100
_ROWS = ("ul", "ol", "table", "tr", "thead", "tbody", "tfoot")
_BREAKS = re.compile(r"[\t ]*[\r\n][\t \r\n]*")
_BLANKS = re.compile(r"\t[\t ]*| [\t ]+")
_EMPHASIS = re.compile(r"([*_])")
_GAPS = re.compile(r"\n{3,}")
_END = ("end", "")


class _Element:
    __slots__ = ("name", "attributes", "start", "body", "count")

    def __init__(self, name: str, attributes: str = "", start: int = 0, body: int = 0):
        self.name, self.attributes, self.start, self.body, self.count = name, attributes, start, body, 0

    def attribute(self, wanted: str) -> str:
        for name, *values in _ATTRIBUTE.findall(self.attributes):
            if name.lower() == wanted:
                return _ENTITY.sub(_character, "".join(values))
        return ""


class _Markdown:
    """A page's output as one list of pieces, in which an open element is a position: closing it trims the ends of
    what came since, and puts a mark at its front, but copies nothing.

    A piece is a string, a pair that begins or ends a quote or an item, or a number: the position up to which
    nothing follows. What quotes and items put before their lines is added when the whole is printed."""

    def __init__(self) -> None:
        self.out: list = []
        self.stack = [_Element("")]
        self.open: dict[str, int] = {}
        self.lists: list[_Element] = []
        self.tables: list[_Element] = []
        self.effects = {"one line": 0, "literal": 0, "pre": 0, "item": 0, "hidden": 0}

    def push(self, name: str, attributes: str) -> None:
        start = len(self.out)
        if name in _INLINE_WRAP or name in _BLOCK or name in _HEADINGS or name in ("li", "td", "th", "tr"):
            self.out += ("", "") if name == "blockquote" else ("",)
        element = _Element(name, attributes, start, len(self.out))
        self.stack.append(element)
        self.open[name] = self.open.get(name, 0) + 1
        for effect in _EFFECTS.get(name, ()):
            self.effects[effect] += 1
        if name in ("ul", "ol"):
            self.lists.append(element)
        elif name == "table":
            self.tables.append(element)

    def pop(self) -> str:
        element = self.stack.pop()
        self.open[element.name] -= 1
        for effect in _EFFECTS.get(element.name, ()):
            self.effects[effect] -= 1
        if element.name in ("ul", "ol"):
            self.lists.pop()
        elif element.name == "table":
            self.tables.pop()
        self.render(element)
        return element.name

    def close(self, name: str) -> None:
        while self.pop() != name:
            pass

    # -------------------------------------------------------------- the ends of what an element holds
    def trim_end(self, floor: int, chars: str | None = None) -> None:
        """Drop blanks (or chars) at the end, down to position floor."""
        out = self.out
        while len(out) > floor:
            last = out[-1]
            if type(last) is str and (last := last.rstrip(chars)):
                out[-1] = last
                return
            if type(last) is tuple:
                return
            out.pop()

    def trim_front(self, at: int, chars: str | None = None) -> None:
        """Drop blanks from position `at` on; the emptied pieces are jumped over from then on."""
        out, first = self.out, at
        while at < len(out):
            piece = out[at]
            if type(piece) is int:
                at = piece
            elif type(piece) is tuple:
                break
            elif piece := piece.lstrip(chars):
                out[at] = piece
                break
            else:
                out[at] = ""
                at += 1
        if at > first + 1:
            out[first] = at

    def trim_before(self, at: int) -> None:
        """Drop spaces in front of a block that begins at `at`, within the element around it."""
        out, floor = self.out, self.stack[-1].body
        while at > floor:
            at -= 1
            if type(out[at]) is str:
                out[at] = out[at].rstrip(" ")
                if out[at]:
                    return
            elif type(out[at]) is tuple:
                return

    def blank(self, floor: int) -> bool:
        return all(type(p) is int or type(p) is str and (not p or p.isspace()) for p in reversed_from(self.out, floor))

    # -------------------------------------------------------------- pieces
    def text(self, text: str) -> None:
        if self.effects["hidden"]:
            return
        top = self.stack[-1]
        if not self.effects["pre"]:
            if "\n" in text or "\r" in text:
                text = _BREAKS.sub("\n", text)
            text = _BLANKS.sub(" ", text)
            if ("*" in text or "_" in text) and not self.effects["literal"]:
                text = _EMPHASIS.sub(r"\\\1", text)
            if len(self.out) > top.body and type(self.out[-1]) is str and self.out[-1].endswith("\n\n"):
                text = text.lstrip()
        if text and not (text.isspace() and top.name in _ROWS):
            self.out.append(text)

    def void(self, name: str, attributes: str) -> None:
        one_line = self.effects["one line"]
        if name == "br":
            self.out.append(" " if one_line else "  \n")
        elif name == "hr":
            self.trim_before(len(self.out))
            self.out.append("\n\n---\n\n")
        elif name == "img":
            image = _Element(name, attributes)
            alt, title = image.attribute("alt"), image.attribute("title")
            title = f' "{title}"' if title else ""
            self.out.append(alt if one_line else f"![{alt}]({image.attribute('src')}{title})")

    def one_line(self, element: _Element) -> str:
        """What an outermost heading or cell holds, as one line."""
        line = " ".join("".join(p for p in self.out[element.body:] if type(p) is str).split())
        del self.out[element.body:]
        return line

    def render(self, element: _Element) -> None:
        out, name, start, body, one_line = self.out, element.name, element.start, element.body, self.effects["one line"]
        heading = name in _HEADINGS
        if name in ("td", "th"):
            self.stack[-1].count += 1
            if one_line:
                self.trim_end(body)
                self.trim_front(body)
                out[start] = " "
                out.append(" |")
            else:
                out[start] = f" {self.one_line(element)} |"
        elif name == "tr":
            self.row(element)
        elif name == "li":
            self.item(element)
        elif body == start:
            pass
        elif self.blank(body):
            del out[start:]
        elif name in _INLINE_WRAP:
            if not self.effects["pre"]:
                self.wrap(element, _INLINE_WRAP[name])
        elif one_line:
            self.trim_end(body)
            self.trim_front(body)
            out[start] = " "
            out.append(" ")
        elif heading:
            line = self.one_line(element)
            self.trim_before(start)
            out[start] = f"\n\n{'#' * int(name[1])} {line}\n\n"
        elif name in ("ul", "ol") and self.effects["item"]:
            self.trim_end(body, "\n ")
            self.trim_front(body, "\n ")
            self.trim_before(start)
            out[start] = "\n"
            out.append("\n")
        elif name == "pre":
            self.trim_before(start)
            out[start] = "\n\n```\n"
            out.append("\n```\n\n")
        else:
            self.trim_end(body)
            self.trim_front(body)
            self.trim_before(start)
            out[start] = "\n\n"
            if name == "blockquote":
                out[start + 1] = ("quote", "")
                out.append(_END)
            out.append("\n\n")

    def wrap(self, element: _Element, mark: str) -> None:
        out, last = self.out, next(p for p in reversed_from(self.out, element.body) if type(p) is not int and p)
        trail = " " * (type(last) is str and last[-1].isspace())
        at = element.body
        while type(out[at]) is int or not out[at]:
            at = out[at] if type(out[at]) is int else at + 1
        lead = " " * (type(out[at]) is str and out[at][0].isspace())
        self.trim_end(element.body)
        self.trim_front(element.body)
        out[element.start] = lead + mark
        out.append(mark + trail)

    def item(self, element: _Element) -> None:
        owner, bullet = self.lists[-1] if self.lists else None, "-"
        if owner is not None:
            if owner.name == "ol":
                start = owner.attribute("start")
                bullet = f"{(int(start) if start.isdigit() else 1) + owner.count}."
            owner.count += 1
        self.trim_end(element.body)
        self.trim_front(element.body)
        if self.effects["one line"] or len(self.out) == element.body:
            self.out[element.start] = f"{bullet} "
        else:
            self.out[element.start] = ("item", bullet)
            self.out.append(_END)
        self.out.append("\n")

    def row(self, element: _Element) -> None:
        table = self.tables[-1] if self.tables else self.stack[-1]
        table.count += 1
        if not element.count:
            del self.out[element.start:]
            return
        self.trim_end(element.body, "\n")
        self.trim_front(element.body, "\n")
        self.out[element.start] = "|"
        self.out.append("\n" + ("|" + " --- |" * element.count + "\n" if table.count == 1 else ""))

    # -------------------------------------------------------------- printing
    def printed(self) -> str:
        """The pieces in order, each line behind the marks of the quotes and items around it. A quote marks empty lines
        too and cuts blanks at a line's end; an item puts its bullet before its first line."""
        done: list[str] = []
        marks = [("", "", False)]  # before a line, before an empty one, within a quote
        fresh, run = True, []

        def flush() -> None:
            nonlocal fresh
            text = "".join(run)
            run.clear()
            before, empty, quoted = marks[-1]
            if len(marks) > 1:
                text = _GAPS.sub("\n\n", text)
            lines = text.split("\n") if before or empty else [text]
            for n, line in enumerate(lines):
                ends = n + 1 < len(lines)
                if quoted and ends:
                    line = line.rstrip()
                if line:
                    done.append(before + line if fresh else line)
                    fresh = False
                elif ends and fresh:
                    done.append(empty)
                if ends:
                    if quoted and not line and done:
                        done[-1] = done[-1].rstrip(" ")
                    done.append("\n")
                    fresh = True
            if len(lines) == 1 and text:
                fresh = text.endswith("\n")

        for piece in self.out:
            if type(piece) is str:
                run.append(piece)
            elif type(piece) is tuple:
                flush()
                kind, bullet = piece
                before, empty, quoted = marks[-1]
                if kind == "end":
                    marks.pop()
                    continue
                if kind == "item":
                    done.append((before if fresh else "") + bullet + " ")
                    fresh = False
                elif not fresh:
                    done.append("> ")
                if len(marks) > MAX_MARKS:
                    marks.append(marks[-1])
                elif kind == "item":
                    marks.append((before + " " * (len(bullet) + 1), empty, quoted))
                else:
                    marks.append((before + "> ", before + ">", True))
        flush()
        return "".join(done)


def reversed_from(pieces: list, floor: int) -> Iterator:
    """The pieces from the last one down to position floor."""
    return (pieces[i] for i in range(len(pieces) - 1, floor - 1, -1))


def to_markdown(
    html: str, drop: frozenset[str], classes: frozenset[str] = frozenset(), ids: frozenset[str] = frozenset()
) -> str:
    """Markdown with # headings and - bullets; link targets are dropped, their text is kept. Left out are
    elements named in `drop` and those with one of the classes or ids.

    Pages may be nested to any depth; time is linear in the page."""
    page = _Markdown()
    dropped: list[str] = []  # open elements from the outermost dropped one inwards
    within: dict[str, int] = {}
    for kind, name, attributes in tokens(html):
        if dropped:
            if kind == "open":
                dropped.append(name)
                within[name] = within.get(name, 0) + 1
            elif kind == "close" and within.get(name):
                top = ""
                while top != name:
                    top = dropped.pop()
                    within[top] -= 1
            elif kind == "close" and page.open.get(name):
                dropped.clear()  # an ancestor ends, and the dropped element with it
                within.clear()
            if dropped or kind != "close" or not page.open.get(name):
                continue
        if kind == "text":
            page.text(name)
        elif kind == "open":
            if name in drop or (attributes and (classes or ids) and _matches(attributes, classes, ids)):
                dropped.append(name)
                within[name] = within.get(name, 0) + 1
            else:
                page.push(name, attributes)
        elif kind == "empty":
            page.void(name, attributes)
        elif page.open.get(name):
            page.close(name)
    while len(page.stack) > 1:
        page.pop()
    return page.printed()

"""Trees of markup: a strict parser with a tolerant one behind it, edits, serialization, and flat node rows.

Well-formed input goes through expat.  Anything else is read by tolerant rules of our own: void elements
close at once, a new block closes an open paragraph, an end tag without a start is dropped, and what is
open at the end is closed.  Entity references other than the five of XML stay as they are.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from html import unescape
from html.parser import HTMLParser
from xml.parsers import expat

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset("address article aside blockquote div dl figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
PLAIN = frozenset(["amp", "lt", "gt", "quot", "apos"])
SPACE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_SPACES = re.compile(f"[{SPACE}]+")
_SEPARATORS = re.compile("[\x1c-\x1f]")  # str.split takes these for blanks, SPACE doesn't hold them
_REFERENCE = re.compile(r"&([A-Za-z][A-Za-z0-9._-]*);")
_CODED = re.compile('["\r\n\t]')
_HELD = re.compile("\ue000([^\ue001]*)\ue001")  # an entity's name on its way through the strict parser


def squeeze(text: str) -> str:
    if _SEPARATORS.search(text):
        return _SPACES.sub(" ", text).strip(" ")
    return " ".join(text.split())


class Node:
    """kind: element, text, raw (comments and instructions, as written) or entity (its name as text)."""

    __slots__ = ("kind", "name", "local", "attrs", "text", "nodes", "parent")

    def __init__(self, kind: str, name: str = "", attrs: dict[str, str] | None = None, text: str = "", nodes: list[Node] | None = None, parent: Node | None = None) -> None:
        self.kind, self.name, self.text, self.parent = kind, name, text, parent
        self.local = name.rpartition(":")[2].lower()
        self.attrs = {} if attrs is None else attrs
        self.nodes = [] if nodes is None else nodes

    # -- reading ------------------------------------------------------------------------------
    @property
    def children(self) -> list[Node]:
        return [n for n in self.nodes if n.kind == "element"]

    def elements(self) -> list[Node]:
        """This element and all below it, in document order."""
        out: list[Node] = []
        stack = [self] if self.kind == "element" else []
        while stack:
            n = stack.pop()
            out.append(n)
            if n.nodes:
                stack += [c for c in reversed(n.nodes) if c.kind == "element"]
        return out

    def below(self) -> list[Node]:
        return self.elements()[1:]

    def named(self, *locals_: str) -> list[Node]:
        return [n for n in self.elements() if n.local in locals_]

    def holds(self, *locals_: str) -> bool:
        """Is one of these below."""
        stack = [self]
        while stack:
            for c in stack.pop().nodes:
                if c.local in locals_:
                    return True
                if c.nodes:
                    stack.append(c)
        return False

    def child(self, local: str) -> Node | None:
        return next((n for n in self.children if n.local == local), None)

    def content(self, without: str = "") -> str:
        """The text below; without elements of that name and the runs of text that follow them, if one is given."""
        out: list[str] = []
        stack = [self]
        while stack:
            n = stack.pop()
            if n.kind == "text":
                out.append(n.text)
            elif n.kind == "entity":
                out.append(f"&{n.text};")
            elif n.nodes:
                stack += reversed(_spared(n.nodes, without) if without else n.nodes)
        return "".join(out)

    def flat(self) -> str:
        return squeeze(self.content())

    def get(self, name: str) -> str:
        return self.attrs.get(name, "")

    def classes(self) -> list[str]:
        return self.attrs["class"].lower().split() if "class" in self.attrs else []

    # -- editing ------------------------------------------------------------------------------
    def append(self, node: Node) -> Node:
        node.parent = self
        self.nodes.append(node)
        return node

    def place(self, node: Node, before: Node) -> None:
        node.parent = self
        self.nodes.insert(self.index(before), node)

    def index(self, node: Node) -> int:
        return self.nodes.index(node)

    def detach(self) -> None:
        """Leaves the tree; the text after it stays."""
        if self.parent:
            del self.parent.nodes[self.parent.index(self)]
            self.parent = None

    def remove_with_tail(self) -> None:
        """Leaves the tree with the run of text that follows."""
        if p := self.parent:
            i = p.index(self)
            j = i + 1
            while j < len(p.nodes) and p.nodes[j].kind == "text":
                j += 1
            del p.nodes[i:j]
            self.parent = None

    def unwrap(self) -> None:
        if p := self.parent:
            i = p.index(self)
            for n in self.nodes:
                n.parent = p
            p.nodes[i : i + 1] = self.nodes
            self.nodes, self.parent = [], None

    def rename(self, local: str) -> None:
        prefix, sep, _ = self.name.rpartition(":")
        self.name, self.local = prefix + sep + local, local.rpartition(":")[2].lower()

    def like(self, local: str, **attrs: str) -> Node:
        prefix, sep, _ = self.name.rpartition(":")
        return Node("element", prefix + sep + local, attrs)

    def set_text(self, text: str) -> None:
        self.nodes = []
        if text:
            self.append(Node("text", text=text))

    def add_class(self, name: str) -> None:
        have = squeeze(self.get("class")).split()
        if name not in have:
            self.attrs["class"] = " ".join([*have, name])


def _spared(nodes: list[Node], name: str) -> list[Node]:
    """What remove_with_tail would leave of a list if it took all elements of a name."""
    out: list[Node] = []
    tail = False
    for n in nodes:
        if n.local == name:
            tail = True
        elif not (tail and n.kind == "text"):
            tail = False
            out.append(n)
    return out


def detach_all(nodes: list[Node]) -> None:
    """Each leaves its tree, as with detach; one pass over each parent's nodes."""
    gone = {id(n) for n in nodes}
    for up in {id(n.parent): n.parent for n in nodes if n.parent is not None}.values():
        up.nodes = [n for n in up.nodes if id(n) not in gone]
    for n in nodes:
        n.parent = None


@dataclass
class Document:
    """A root, and what stood before and after it, as written."""

    root: Node
    before: str = ""
    after: str = ""
    strict: bool = True

    def serialize(self) -> str:
        return f'<?xml version="1.0" encoding="utf-8"?>\n{self.before}{serialize(self.root)}{self.after}\n'


def escape(text: str, attribute: bool = False) -> str:
    text = text.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")
    if attribute and _CODED.search(text):
        for char, code in (('"', "&quot;"), ("\r", "&#13;"), ("\n", "&#10;"), ("\t", "&#9;")):
            text = text.replace(char, code)
    return _HELD.sub(r"&\1;", text) if "\ue000" in text else text


def serialize(node: Node) -> str:
    out: list[str] = []
    stack: list[Node | str] = [node]
    while stack:
        n = stack.pop()
        if isinstance(n, str):
            out.append(n)
        elif n.kind == "text":
            out.append(escape(n.text))
        elif n.kind == "raw":
            out.append(n.text)
        elif n.kind == "entity":
            out.append(f"&{n.text};")
        else:
            attrs = "".join([f' {k}="{escape(v, True)}"' for k, v in sorted(n.attrs.items())]) if n.attrs else ""
            if len(n.nodes) == 1 and n.nodes[0].kind == "text":
                out.append(f"<{n.name}{attrs}>{escape(n.nodes[0].text)}</{n.name}>")
            elif n.nodes:
                out.append(f"<{n.name}{attrs}>")
                stack.append(f"</{n.name}>")
                stack += reversed(n.nodes)
            else:
                out.append(f"<{n.name}{attrs}/>")
    return "".join(out)


class _Builder:
    def __init__(self) -> None:
        self.root: Node | None = None
        self.open: list[Node] = []

    def start(self, name: str, attrs: dict[str, str]) -> Node:
        node = Node("element", name, attrs)
        if self.open:
            node.parent = self.open[-1]
            node.parent.nodes.append(node)
        elif self.root is None:
            self.root = node
        self.open.append(node)
        return node

    def end(self) -> None:
        self.open.pop()

    def add(self, kind: str, text: str) -> None:
        if not self.open or not text:
            return
        into = self.open[-1]
        if kind == "text" and into.nodes and into.nodes[-1].kind == "text":
            into.nodes[-1].text += text
        else:
            into.append(Node(kind, text=text))

    def data(self, text: str) -> None:
        if "\ue000" not in text:
            return self.add("text", text)
        at = 0
        for m in _HELD.finditer(text):
            self.add("text", text[at : m.start()])
            self.add("entity", m.group(1))
            at = m.end()
        self.add("text", text[at:])


#: Markup that every version of HTMLParser reads alike: text, references, plain tags, scripts and styles without comments.
_PLAIN = re.compile(
    r"""(?P<text>[^<&]+|&(?=[^a-zA-Z\#])|<(?=[^a-zA-Z/!?]))
    |&(?P<entity>[a-zA-Z][-.a-zA-Z0-9]*)(?:;|(?=[^a-zA-Z0-9]))|&\#(?P<char>[0-9]+|[xX][0-9a-fA-F]+)(?:;|(?=[^0-9a-fA-F]))|</(?P<end>[a-zA-Z][-.a-zA-Z0-9:_]*)>
    |<(?P<raw>script|style)(?P<raw_attrs>(?:[ \t\n]+[a-zA-Z][-a-zA-Z0-9:_]*="[^"&]*")*)>(?P<inside>[^<]*(?:<(?!/\s*(?i:script|style)|!--)[^<]*)*)</(?P=raw)>
    |<(?P<start>[a-zA-Z][-a-zA-Z0-9:_]*)(?P<attrs>(?:[ \t\n]+[a-zA-Z][-a-zA-Z0-9:_]*="[^"&]*")*)[ ]?(?P<empty>/)?>""",
    re.X,
)
_ATTRS = re.compile(r'([a-zA-Z][-a-zA-Z0-9:_]*)="([^"]*)"')


class _Tolerant(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=False)
        self.made = _Builder()
        self.special = {"script", "style", "plaintext", *self.CDATA_CONTENT_ELEMENTS, *getattr(self, "RCDATA_CONTENT_ELEMENTS", ())}

    def updatepos(self, i: int, j: int) -> int:
        return j  # lines are never asked for

    def read(self, text: str) -> None:
        """The whole text: plain markup by pattern, one odd tag or comment by the parser's own methods, what they leave by the parser."""
        at, n = 0, len(text)
        while at < n:
            m = _PLAIN.match(text, at)
            kind = m.lastgroup if m else None
            if kind == "text":
                self.handle_data(m["text"])
            elif kind == "end":
                self.handle_endtag(m["end"].lower())
            elif kind == "entity":
                self.handle_entityref(m["entity"])
            elif kind == "char":
                self.handle_charref(m["char"])
            elif kind == "inside":
                self.handle_starttag(m["raw"], self._attributes(m["raw_attrs"]))
                self.handle_data(m["inside"])
                self.handle_endtag(m["raw"])
            elif kind in ("attrs", "empty") and (tag := m["start"].lower()) not in self.special:
                (self.handle_startendtag if kind == "empty" else self.handle_starttag)(tag, self._attributes(m["attrs"]))
            else:
                k = self._odd(text, at)
                if k < 0 or self.cdata_elem:
                    rest = max(k, at)
                    self.rawdata = ""
                    self.feed(text[rest:])
                    return self.close()
                at = k
                continue
            at = m.end()

    def _attributes(self, text: str) -> list[tuple[str, str | None]]:
        return [(k.lower(), v) for k, v in _ATTRS.findall(text)] if text else []

    def _odd(self, text: str, at: int) -> int:
        """Where a start tag or comment ends that the parser has read, or -1."""
        self.rawdata = text
        if text.startswith("<!--", at):
            return self.parse_comment(at)
        return self.parse_starttag(at) if text[at] == "<" and text[at + 1 : at + 2].isalpha() and text[at + 1].isascii() else -1

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        made = self.made
        if made.root is not None and not made.open:
            made.open = [made.root]  # what follows a closed root still belongs to it
        if tag == made.root.name if made.root and made.open else False:
            return
        if tag in BLOCKS:
            at = next((i for i in range(len(made.open) - 1, -1, -1) if made.open[i].local in ("p", "div", "section", "td", "li", "body")), None)
            if at is not None and made.open[at].local == "p":
                del made.open[at:]
        for same in ("li", "td", "tr", "option"):
            if tag == same and made.open and made.open[-1].local == same:
                made.end()
        if not made.open and made.root is not None:
            made.open = [made.root]
        seen: dict[str, str] = {}
        for k, v in attrs:
            seen.setdefault(k, v or "")
        made.start(tag, seen)
        if tag in VOID:
            made.end()

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        n = len(self.made.open)
        self.handle_starttag(tag, attrs)
        if tag not in VOID and len(self.made.open) > max(n, 1) - 1 and self.made.open and self.made.open[-1].name == tag:
            self.made.end()

    def handle_endtag(self, tag: str) -> None:
        open_ = self.made.open
        for k in range(len(open_) - 1, -1, -1):
            if open_[k].name == tag:
                del open_[k:]
                return

    def handle_data(self, data: str) -> None:
        self.made.add("text", data)

    def handle_entityref(self, name: str) -> None:
        if name in PLAIN:
            self.made.add("text", unescape(f"&{name};"))
        else:
            self.made.add("entity", name)

    def handle_charref(self, name: str) -> None:
        self.made.add("text", unescape(f"&#{name};"))

    def handle_comment(self, data: str) -> None:
        self.made.add("raw", f"<!--{data}-->")

    def handle_pi(self, data: str) -> None:
        self.made.add("raw", f"<?{data}>")

    def unknown_decl(self, data: str) -> None:
        if data.startswith("CDATA["):
            self.made.add("text", data[6:])


def _strict(text: str) -> Node | None:
    held = _REFERENCE.sub(lambda m: m.group() if m.group(1) in PLAIN else f"\ue000{m.group(1)}\ue001", text)
    made, parser = _Builder(), expat.ParserCreate()
    parser.buffer_text = True
    parser.StartElementHandler = made.start
    parser.EndElementHandler = lambda name: made.end()
    parser.CharacterDataHandler = made.data
    parser.CommentHandler = lambda data: made.add("raw", f"<!--{data}-->")
    parser.ProcessingInstructionHandler = lambda target, data: made.add("raw", f"<?{target} {data}?>")
    try:
        parser.Parse(held.encode("utf-8", "replace"), True)
    except expat.ExpatError:
        return None
    return made.root


def parse(data: bytes | str, recover: bool = True) -> Document | None:
    """The document, or None where there is no root (or, without recover, where it isn't well-formed)."""
    text = data.decode("utf-8", "replace") if isinstance(data, bytes) else data
    text = text.removeprefix("\ufeff")
    body = re.sub(r"^\s*<\?xml[^>]*\?>\s*", "", text)
    begin = re.search(r"<[A-Za-z_]", body)
    if not begin:
        return None
    before, rest = body[: begin.start()], body[begin.start() :]
    if root := _strict(body if "<!ENTITY" not in before else rest):
        close = re.search(r"</[A-Za-z_][^<>]*>((?:\s|<!--(?:(?!-->).)*-->|<\?[^>]*>)*)$", rest, re.S)
        return Document(root, before, close.group(1).strip() if close else "", True)
    if not recover:
        return None
    parser = _Tolerant()
    parser.read(rest)
    return Document(parser.made.root, before, "", False) if parser.made.root else None


NODE_FIELDS = "node_ix int, end_ix int, parent_ix int, sibling_ix int, depth int, kind string, qname string, local string, attrs map<string,string>, text string"


def rows(root: Node) -> list[tuple]:
    """The tree in preorder: what is below node a are the rows with a.node_ix < node_ix <= a.end_ix."""
    out: list[list] = []

    def visit(top: Node) -> None:
        stack = [(top, None, 0, 0, False)]
        at: dict[int, int] = {}
        while stack:
            n, up, sibling, depth, done = stack.pop()
            if done:
                out[at[id(n)]][1] = len(out) - 1
                continue
            ix = at[id(n)] = len(out)
            is_element = n.kind == "element"
            out.append([ix, ix, up, sibling, depth, n.kind, n.name or None, n.local if is_element else None, dict(n.attrs) if is_element else None, n.text if not is_element else None])
            stack.append((n, up, sibling, depth, True))
            stack.extend((c, ix, k, depth + 1, False) for k, c in reversed(list(enumerate(n.nodes))))

    visit(root)
    return [tuple(r) for r in out]

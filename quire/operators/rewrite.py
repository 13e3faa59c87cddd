"""Content normalization: one document rewritten by an ordered list of steps.

Each step is a function of (Page); the order matters, since later steps read what earlier ones wrote.
Where the usual behaviour loses information this one differs on purpose: links to a repeated id keep to its
first holder, and sectioning elements are never wrapped in a paragraph.
"""

from __future__ import annotations

import posixpath
import re
from collections.abc import Callable
from dataclasses import dataclass, field

from quire.functions.uris import DANGEROUS
from quire.markup import Document, Node, detach_all, parse
from quire.operators import classify

# Fixed values. --------------------------------------------------------------------------------------
PRESENTATION = frozenset("align alink background bgcolor border cellpadding cellspacing clear color face height hspace link marginheight marginwidth size style text valign vlink vspace width".split())
PICTURES = "eo-image image img dis_img cover"
BREAKS = "scene-break scenebreak separator ornament space-break"
FLOW = frozenset("address aside article blockquote del div dl figure footer h1 h2 h3 h4 h5 h6 header hr ins main nav noscript ol p pre script section svg table ul".split())
EMPHASIS = [(lambda c: "bold" in c, "strong"), (lambda c: "italic" in c or "ital" in c, "em")]
DECORATION = [("eo-underline", "underline"), ("eo-strike", "strike"), ("eo-overline", "overline")]
SMALLCAPS = "smallcaps small-cap small-caps"
SHEET = "Styles/quire.css"


@dataclass
class Uri:
    path: str
    query: str
    fragment: str
    scheme: str

    @property
    def external(self) -> bool:
        return bool(self.scheme) or self.path.startswith("//")

    @property
    def dangerous(self) -> bool:
        return self.scheme in DANGEROUS


def uri(href: str) -> Uri:
    text = re.sub("[\r\n\t]", "", re.sub(r"^[\x00-\x20]+", "", href))
    body, _, fragment = text.partition("#")
    path, _, query = body.partition("?")
    scheme = re.match(r"([A-Za-z][A-Za-z0-9+.-]*):", path)
    return Uri(path, query, fragment, scheme.group(1).lower() if scheme else "")


def join(directory: str, href: str) -> str | None:
    """The path in the archive, or None if it leaves it."""
    if href.startswith("/"):
        return None
    out: list[str] = []
    for part in f"{directory}/{href}".split("/"):
        if part == "..":
            if not out:
                return None
            out.pop()
        elif part not in ("", "."):
            out.append(part)
    return "/".join(out)


def relative(source: str, target: str) -> str:
    return posixpath.relpath("/" + target, "/" + posixpath.dirname(source))


@dataclass
class Page:
    root: Node
    path: str
    sheet: str
    role: str
    class_roles: dict[str, str]
    files: frozenset[str]
    preserve: bool = False
    listed: list[Node] | None = field(default=None, repr=False)

    def elements(self) -> list[Node]:
        """The elements in document order; listed anew after a step that moves some."""
        if self.listed is None:
            self.listed = self.root.elements()
        return self.listed

    def named(self, *locals_: str) -> list[Node]:
        return [n for n in self.elements() if n.local in locals_]

    def moved(self) -> None:
        self.listed = None

    def detach(self, nodes: list[Node]) -> None:
        if nodes:
            detach_all(nodes)
            self.moved()


def link_sheet(page: Page) -> None:
    head = next(iter(page.named("head")), None)
    if head is None:
        return
    for n in head.children:
        if n.local != "link":
            continue
        rel, kind = n.get("rel").lower(), n.get("type").lower()
        ours = n.get("href").endswith(posixpath.basename(page.sheet))
        if ours or rel == "xpgt" or "page-template" in kind or (not page.preserve and "stylesheet" in rel):
            n.detach()
    head.append(head.like("link", rel="stylesheet", type="text/css", href=relative(page.path, page.sheet)))
    page.moved()


def drop_styles(page: Page) -> None:
    if not page.preserve:
        for n in page.named("style"):
            n.remove_with_tail()
            page.moved()


def drop_dangerous(page: Page) -> None:
    for n in page.elements():
        for a in ("href", "src") if n.attrs else ():
            if a in n.attrs and uri(n.attrs[a]).dangerous:
                del n.attrs[a]


def align(page: Page) -> None:
    for n in page.elements():
        if "style" not in n.attrs and "align" not in n.attrs and "class" not in n.attrs:
            continue
        style = n.get("style").lower().replace(" ", "")
        told = {n.get("align").lower(), *re.findall(r"text-align:(right|center)", style)}
        told |= {page.class_roles.get(c) for c in n.classes()}
        if not told.isdisjoint(("right", "eo-right")):
            n.add_class("eo-right")
        elif not told.isdisjoint(("center", "eo-centered")):
            n.add_class("eo-centered")


def drop_presentation(page: Page) -> None:
    for n in page.elements():
        if not n.attrs:
            continue
        keep = ("width", "height") if n.local in ("svg", "image") else ()
        for a in [a for a in n.attrs if a.rpartition(":")[2].lower() in PRESENTATION and a not in keep]:
            del n.attrs[a]


def drop_missing_images(page: Page) -> None:
    from urllib.parse import unquote

    gone = []
    for n in page.named("img"):
        link = uri(n.get("src"))
        target = None if link.external or not link.path else join(posixpath.dirname(page.path), unquote(link.path))
        if not n.get("src") or (target is not None and target not in page.files):
            gone.append(n)
    page.detach(gone)
    page.detach([n for n in page.named("p", "div", "figure") if n.parent is not None and classify.any_word(n.classes(), PICTURES) and classify.is_empty(n)])


def unwrap_fonts(page: Page) -> None:
    for n in page.named("font"):
        n.unwrap()
        page.moved()


def spans(page: Page) -> None:
    for n in page.named("span"):
        have, text = n.classes(), n.flat()
        inline = min((c for c in have if c in classify.INLINE_ROLES), default=None)
        tag = next((tag for test, tag in EMPHASIS if test(have)), None)
        role = inline or (None if tag else next((r for r, c in DECORATION if c in have), None))
        if not role and not tag and (classify.any_word(have, SMALLCAPS) or (len(text) >= 2 and classify.upper(text))):
            role = "eo-smallcaps"
        if tag and not inline:
            n.rename(tag)
        n.attrs.pop("class", None)
        if role:
            n.attrs["class"] = role


def wrap_phrases(page: Page) -> None:
    """Runs of text and inline elements between blocks become paragraphs."""
    made = False
    for parent in page.named("body", "blockquote"):
        out: list[Node] = []
        run: list[Node] = []

        def close(run=run, out=out, parent=parent) -> None:
            if any(n.kind in ("element", "entity") or (n.kind == "text" and n.text.strip()) for n in run):
                p = parent.like("p")
                for n in run:
                    p.append(n)
                p.parent = parent
                out.append(p)
            else:
                out.extend(run)
            run.clear()

        for n in parent.nodes:
            if n.kind == "element" and n.local in FLOW:
                close()
                out.append(n)
            else:
                run.append(n)
        close()
        made |= len(out) != len(parent.nodes) or any(a is not b for a, b in zip(out, parent.nodes))
        parent.nodes = out
    if made:
        page.moved()


def unique_ids(page: Page) -> None:
    elements = page.elements()
    taken = {n.get("id") for n in elements}
    seen: set[str] = set()
    following: dict[str, int] = {}
    for n in elements:
        name = n.get("id")
        if not name:
            continue
        if name in seen:
            k = following.get(name, 2)
            while f"{name}-{k}" in taken:
                k += 1
            following[name] = k + 1
            n.attrs["id"] = f"{name}-{k}"
            taken.add(n.attrs["id"])
        seen.add(n.attrs["id"])


def nested_quotes(page: Page) -> None:
    for outer in page.named("blockquote"):
        while len(kids := outer.children) == 1 and kids[0].local == "blockquote" and not any(n.kind in ("text", "entity") and n.text.strip() for n in outer.nodes):
            kids[0].unwrap()
            page.moved()


def drop_empty(page: Page) -> None:
    gone: list[Node] = []
    left: dict[Node, int] = {}  # how many elements a body still has; its last one stays
    for n in page.named("div", "p", "section"):
        if n.parent is None or not classify.is_empty(n) or classify.any_word(n.classes(), BREAKS):
            continue
        if n.parent.local == "body":
            if n.parent not in left:
                left[n.parent] = len(n.parent.children)
            if left[n.parent] == 1:
                continue
            left[n.parent] -= 1
        gone.append(n)
    page.detach(gone)


def roles(page: Page) -> None:
    body = [n for b in page.named("body") for n in b.below()]  # classify.below_bodies from the list at hand
    classify.classify(page.root, classify.refine(page.root, page.role, body), body)


def keep_roles(page: Page) -> None:
    for n in page.elements():
        if "class" in n.attrs:
            kept = [c for c in n.get("class").split() if c.startswith("eo-")]
            n.attrs.pop("class")
            if kept:
                n.attrs["class"] = " ".join(kept)


STEPS: list[Callable[[Page], None]] = [
    link_sheet, drop_styles, drop_dangerous, align, drop_presentation, drop_missing_images, unwrap_fonts, spans,
    wrap_phrases, unique_ids, nested_quotes, drop_empty, roles, keep_roles,
]


def normalize(data: bytes | str, path: str = "page.xhtml", role: str = "body", class_roles: dict[str, str] | None = None, files: frozenset[str] = frozenset(), preserve: bool = False, sheet: str = SHEET) -> str | None:
    """The rewritten document, or None if it has no root."""
    doc = parse(data)
    return None if doc is None else rewritten(doc, path, role, class_roles, files, preserve, sheet)


def rewritten(doc: Document, path: str = "page.xhtml", role: str = "body", class_roles: dict[str, str] | None = None, files: frozenset[str] = frozenset(), preserve: bool = False, sheet: str = SHEET) -> str:
    """The same of a document that is parsed; its tree is rewritten in place."""
    page = Page(doc.root, path, sheet, role, class_roles or {}, files, preserve)
    for step in STEPS:
        step(page)
    return doc.serialize()

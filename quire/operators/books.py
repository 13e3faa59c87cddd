"""Operators on one book in memory: package, manifest, navigation, links, validation, repair, preview.

Workers call these for each archive; quire.operators.tables has the relational forms over a corpus.
Manifest references are percent-decoded everywhere, also where the usual behaviour compares them raw.
"""

from __future__ import annotations

import mimetypes
import posixpath
import re
from collections import defaultdict
from dataclasses import dataclass, field
from urllib.parse import quote, unquote

from quire.markup import Document, Node, escape, parse
from quire.operators import rewrite
from quire.operators.findings import Finding
from quire.operators.rewrite import Uri, join, relative, uri
from quire.sources.archives import dimensions, safe_name

# Media types and names. ---------------------------------------------------------------
CONTAINER = "META-INF/container.xml"
ENCRYPTION = "META-INF/encryption.xml"
REPORT = "META-INF/quire-report.json"
OCF = "urn:oasis:names:tc:opendocument:xmlns:container"
CONTENT_TYPES = ("application/xhtml+xml", "text/html", "application/x-dtbook+xml")
NCX_TYPE = "application/x-dtbncx+xml"
FONT_TYPES = ("application/vnd.ms-opentype", "application/font-sfnt", "application/font-woff", "application/font-woff2", "application/x-font-opentype", "application/x-font-otf", "application/x-font-truetype", "application/x-font-ttf", "application/x-font-woff", "font/otf", "font/sfnt", "font/ttf", "font/woff", "font/woff2", "application/vnd.adobe-page-template+xml")
STYLE_EXTENSIONS = ("css", "xpgt", "otf", "ttf", "woff", "woff2")
HTML_EXTENSIONS = ("html", "htm", "xhtml")
SHEET_ID, SHEET = "quire-css", rewrite.SHEET
MARKER = "quire:version"
CSS_URL = re.compile(r"""url\(\s*(?:'([^']*)'|"([^"]*)"|([^'")][^)]*))\s*\)""", re.I | re.S)
CSS_RULE = re.compile(r"\.([A-Za-z_][\w-]*)[^{}]*\{([^}]*)\}", re.S)
REFINED = {"role": "creator contributor publisher", "file-as": "creator contributor", "title-type": "title"}


class BookError(ValueError):
    pass


def extension(path: str) -> str:
    return posixpath.splitext(posixpath.basename(path))[1][1:].lower()


def is_html(path: str) -> bool:
    return extension(path) in HTML_EXTENSIONS


def is_content(item: Node) -> bool:
    return item.get("media-type").lower() in CONTENT_TYPES and bool(item.get("href"))


def is_sheet(item: Node) -> bool:
    return item.get("media-type").lower() == "text/css" or extension(item.get("href")) == "css"


def is_removable(item: Node) -> bool:
    return is_sheet(item) or item.get("media-type").lower() in FONT_TYPES or extension(item.get("href")) in STYLE_EXTENSIONS


def resource_urls(text: str) -> list[str]:
    found = (next(g for g in m.groups() if g is not None).strip() for m in CSS_URL.finditer(text))
    local = (u for u in found if u and not u.startswith("/") and ":" not in u.split("/")[0])
    return [v for u in local if (v := re.split("[?#]", u)[0].strip())]


@dataclass
class Book:
    files: dict[str, bytes]
    package_path: str = ""
    package: Document | None = None
    pages: dict[str, Document | None] = field(default_factory=dict)

    @classmethod
    def open(cls, files: dict[str, bytes]) -> Book:
        book = cls(files)
        book.package_path = book.locate()
        book.package = parse(files[book.package_path], recover=False)
        if book.package is None:
            raise BookError("Could not parse the OPF package document.")
        return book

    def locate(self) -> str:
        data = self.files.get(CONTAINER, b"")
        if b"<!ENTITY" in data:
            raise BookError("EntitiesForbidden in META-INF/container.xml.")
        doc = parse(data, recover=False)
        if doc is None:
            raise BookError("Could not parse META-INF/container.xml.")
        listed = doc.root.named("rootfile")
        space = lambda n: _namespace(n)
        chosen = next((n for n in listed if space(n) == OCF), None) or next((n for n in listed if not space(n)), None)
        if chosen is None:
            raise BookError("container.xml does not declare an OPF rootfile.")
        path = chosen.get("full-path")
        if not path:
            raise BookError("OPF rootfile path is empty.")
        safe_name(path)
        if path not in self.files:
            raise BookError("Declared OPF package document does not exist.")
        return path

    # -- parts ---------------------------------------------------------------------------------
    @property
    def root(self) -> Node:
        return self.package.root

    @property
    def folder(self) -> str:
        return posixpath.dirname(self.package_path)

    @property
    def manifest(self) -> Node:
        found = self.root.child("manifest")
        if found is None:
            raise BookError("OPF package document is missing a manifest.")
        return found

    @property
    def items(self) -> list[Node]:
        return [n for n in self.manifest.children if n.local == "item"]

    def path_of(self, item: Node) -> str | None:
        return join(self.folder, unquote(item.get("href")))

    def page(self, path: str) -> Document | None:
        if path not in self.pages:
            self.pages[path] = parse(self.files[path]) if path in self.files else None
        return self.pages[path]

    def save(self, path: str) -> None:
        self.files[path] = self.pages[path].serialize().encode()

    def anchors(self, path: str) -> set[str]:
        doc = self.page(path)
        return {v for n in doc.root.elements() if n.attrs for a in ("id", "name") if (v := n.get(a))} if doc else set()

    # -- style sheets, fonts, pictures ---------------------------------------------------------
    def class_roles(self) -> dict[str, str]:
        out: dict[str, str] = {}
        for item in self.items:
            href = item.get("href").partition("#")[0]
            if not is_sheet(item) or not href.lower().endswith(".css"):
                continue
            path = join(self.folder, unquote(href))
            if path is None:
                raise BookError(f"Stylesheet leaves the book: {href}")
            for name, body in CSS_RULE.findall(self.files.get(path, b"").decode("utf-8", "replace")):
                if side := re.search(r"text-align\s*:\s*(right|center)", body.lower()):
                    out[name.lower()] = "eo-right" if side.group(1) == "right" else "eo-centered"
        return out

    def used_fonts(self) -> set[str]:
        """Paths that sheets and pages name in url()."""
        sheets = [p for i in self.items if is_sheet(i) and (p := self.path_of(i)) in self.files]
        pages = [p for p in self.files if is_html(p)]
        return {t for p in [*sheets, *pages] for u in resource_urls(self.files[p].decode("utf-8", "replace")) if (t := join(posixpath.dirname(p), unquote(u)))}

    def removable(self, preserve: bool = False) -> list[Node]:
        used = self.used_fonts() if preserve else set()
        ours = lambda i: i.get("id") == SHEET_ID or i.get("href") == SHEET
        keep = lambda i: preserve and (is_sheet(i) or self.path_of(i) in used)
        return [i for i in self.items if i.get("href") and not ours(i) and is_removable(i) and not keep(i)]

    def image_diagnostics(self) -> list[str]:
        out = []
        for item in self.items:
            media, href = item.get("media-type").lower(), item.get("href")
            if not media.startswith("image/") or not href:
                continue
            data = self.files.get(self.path_of(item) or "")
            if data is None:
                out.append(f"Image missing from manifest: {href}.")
                continue
            n, box = len(data), dimensions(data)
            size = f"{n} B" if n < 1024 else f"{n / 1024:.1f} KB" if n < 1 << 20 else f"{n / (1 << 20):.1f} MB"
            out.append(f"{href} ({media}, {size}{f', {box[0]}x{box[1]}' if box else ''}).")
        return out

    def clean_encryption(self, removed: set[str]) -> None:
        doc = parse(self.files.get(ENCRYPTION, b""), recover=False)
        if doc is None:
            return
        changed = False
        for data in doc.root.named("encrypteddata"):
            links = [uri(n.get("URI")) for n in data.named("cipherreference")]
            if any(not u.external and join("", unquote(u.path)) in removed for u in links):
                data.remove_with_tail()
                changed = True
        if changed and doc.root.children:
            self.files[ENCRYPTION] = doc.serialize().encode()
        elif changed:
            del self.files[ENCRYPTION]

    def preview(self, name: str, preserve: bool = False) -> dict:
        items, removable = self.items, self.removable(preserve)
        content = [i for i in items if is_content(i)]
        images = sum(i.get("media-type").lower().startswith("image/") for i in items)
        old = sum(self.path_of(i) in self.files for i in removable)
        return {
            "input_filename": name, "epub_version": self.root.attrs.get("version"), "package_path": self.package_path,
            "content_documents": len(content), "stylesheets_and_fonts": len(removable), "removable_files": old, "images_preserved": images,
            "would_write_canonical_css": True, "image_diagnostics": self.image_diagnostics(),
            "change_summary": [
                f"Would normalize {len(content)} content document(s).", f"Would replace {len(removable)} stylesheet/font manifest item(s).", f"Would delete {old} old style/font file(s).",
                f"Would preserve {images} image resource(s) without recompression.", "Would write the canonical stylesheet.",
            ],
            "warnings": [f"Manifest content document is missing: {i.get('href')}" for i in content if self.path_of(i) not in self.files],
        }


def _namespace(n: Node | None) -> str:
    prefix = n.name.rpartition(":")[0]
    key = f"xmlns:{prefix}" if prefix else "xmlns"
    while n is not None:
        if key in n.attrs:
            return n.attrs[key]
        n = n.parent
    return ""


# Validation. ----------------------------------------------------------------------------------------
def issues(book: Book) -> list[tuple[str, str, str]]:
    """(severity, code, message), repeated ids last."""
    if book.root.child("manifest") is None:
        return [("error", "missing-manifest", "OPF package document is missing a manifest.")]
    out, repeated = [], []
    anchors: dict[str, set[str]] = {}
    items, spine = book.items, book.root.child("spine")
    ids = {i.get("id") for i in items}
    out += [("error", "missing-manifest-file", f"Manifest file is missing: {i.get('href')}") for i in items if i.get("href") and book.path_of(i) not in book.files]
    if spine is None:
        out.append(("error", "missing-spine", "OPF package document is missing a spine."))
    else:
        out += [("error", "missing-spine-target", f"Spine references missing manifest item: {n.get('idref')}") for n in spine.children if n.local == "itemref" and n.get("idref") not in ids]
    for item in filter(is_content, items):
        path = book.path_of(item)
        doc = book.page(path) if path else None
        if doc is None:
            continue
        seen: set[str] = set()
        twice: set[str] = set()
        for n in doc.root.elements():
            if not n.attrs:
                continue
            name = n.get("id")
            (twice if name in seen else seen).add(name)
            out += [found for a in ("href", "src") if n.get(a) and (found := _link_issue(book, anchors, path, n.get(a)))]
        repeated += [("warning", "duplicate-id", f"Duplicate id '{i}' found in {item.get('href')}.") for i in sorted(twice - {""})]
    return out + repeated


def _link_issue(book: Book, anchors: dict[str, set[str]], source: str, href: str) -> tuple[str, str, str] | None:
    link = uri(href)
    if link.dangerous:
        return "error", "unsafe-link-scheme", f"Unsafe link scheme found: {href}"
    if link.external or not link.path:
        return None
    target = join(posixpath.dirname(source), unquote(link.path))
    if target is None:
        return "error", "unsafe-link-target", f"Link target escapes the EPUB root: {href}"
    if target not in book.files:
        return "warning", "missing-link-target", f"Link target is missing: {href}"
    if link.fragment and is_html(target) and unquote(link.fragment) not in _anchors(book, anchors, target):
        return "warning", "missing-link-anchor", f"Link anchor is missing: {href}"
    return None


def _anchors(book: Book, known: dict[str, set[str]], path: str) -> set[str]:
    """The anchors of a page, read once for all links to it."""
    if path not in known:
        known[path] = book.anchors(path)
    return known[path]


# Links. ---------------------------------------------------------------------------------------------
def with_path(link: Uri, path: str) -> str:
    return quote(path, safe="/-_.~") + (f"?{link.query}" if link.query else "") + (f"#{link.fragment}" if link.fragment else "")


def repair_links(book: Book) -> list[str]:
    """Broken links go to the one page that fits their file name and anchor, or lose their target; the text stays."""
    paths = list(dict.fromkeys(p for i in book.items if is_content(i) and (p := book.path_of(i)) and book.page(p)))
    anchors = {p: book.anchors(p) for p in paths}
    by_name: dict[str, set[str]] = defaultdict(set)
    by_anchor: dict[str, set[str]] = defaultdict(set)
    for p in paths:
        by_name[posixpath.basename(p)].add(p)
        for a in anchors[p]:
            by_anchor[a].add(p)
    actions = []
    for source in paths:
        before = len(actions)
        for n in book.page(source).root.named("a"):
            if "href" not in n.attrs:
                continue
            href = n.attrs["href"]
            link = uri(href)
            path, fragment = unquote(link.path), unquote(link.fragment)
            if link.external or _holds(book, anchors, source, path, fragment):
                continue
            fit = by_name.get(posixpath.basename(path), set()) if path else set()
            if fragment:
                owners = by_anchor.get(fragment, set())
                fit = fit & owners or owners
            if len(fit) == 1:
                n.attrs["href"] = with_path(link, relative(source, next(iter(fit))))
                actions.append(f"Repaired hyperlink in {source}: {href} -> {n.attrs['href']}")
            else:
                del n.attrs["href"]
                actions.append(f"Removed broken hyperlink in {source} (text preserved): {href}")
        if len(actions) > before:
            book.save(source)
    return actions


def _holds(book: Book, anchors: dict[str, set[str]], source: str, path: str, fragment: str) -> bool:
    target = join(posixpath.dirname(source), path) if path else source
    if target not in book.files:
        return False
    if not fragment or (target not in anchors and not is_html(target)):
        return True
    return fragment in _anchors(book, anchors, target)


# Navigation. ----------------------------------------------------------------------------------------
def normalize_ncx(book: Book) -> int:
    """Drops points that lead nowhere, tidies labels, numbers the rest by first appearance of their target."""
    changed = 0
    for item in book.items:
        path = book.path_of(item)
        if item.get("media-type").lower() != NCX_TYPE or path not in book.files or not item.get("href"):
            continue
        doc = book.page(path)
        if doc is None:
            continue
        was = doc.serialize()
        source = lambda n: (c.get("src") if (c := n.child("content")) else "")
        for n in doc.root.named("navpoint"):
            link = uri(source(n))
            there = link.external or (bool(link.path) and join(posixpath.dirname(path), unquote(link.path)) in book.files)
            if link.dangerous or not source(n) or not there:
                n.remove_with_tail()
            elif (label := n.child("navlabel")) and (text := label.child("text")) and text.content() != text.flat():
                text.set_text(text.flat())
        order: dict[str | int, int] = {}
        for k, n in enumerate(doc.root.named("navpoint", "navtarget", "pagetarget")):
            n.attrs["playOrder"] = str(order.setdefault(source(n) or k, len(order) + 1))
        if doc.serialize() != was:
            book.save(path)
            changed += 1
    return changed


def ensure_nav(book: Book) -> bool:
    """A version 3 book without a navigation document gets one over its spine."""
    content, spine = [i for i in book.items if is_content(i)], book.root.child("spine")
    if not book.root.get("version").startswith("3") or spine is None or any("nav" in i.get("properties").lower().split() for i in content):
        return False
    by_id: dict[str, Node] = {}
    for i in content:
        by_id.setdefault(i.get("id"), i)
    listed = [by_id[r.get("idref")] for r in spine.children if r.local == "itemref" and r.get("idref") in by_id]
    if not listed:
        return False
    href = "nav.xhtml" if join(book.folder, "nav.xhtml") not in book.files else "quire-nav.xhtml"
    nav = join(book.folder, href)
    rows = []
    for k, item in enumerate(listed, 1):
        path = book.path_of(item)
        rows.append(f'      <li><a href="{escape(relative(nav, path), True)}">{escape(_label(book, path) or f"Section {k}")}</a></li>')
    book.files[nav] = "\n".join([
        '<?xml version="1.0" encoding="utf-8"?>', '<html xmlns="http://www.w3.org/1999/xhtml" xmlns:epub="http://www.idpf.org/2007/ops">', "  <head><title>Contents</title></head>", "  <body>",
        '    <nav epub:type="toc" role="doc-toc">', "      <h1>Contents</h1>", "      <ol>", *rows, "      </ol>", "    </nav>", "  </body>", "</html>", "",
    ]).encode()
    book.manifest.append(book.manifest.like("item", id="quire-nav", href=href, properties="nav", **{"media-type": CONTENT_TYPES[0]}))
    return True


def _label(book: Book, path: str) -> str:
    doc = book.page(path)
    if doc is None:
        return ""
    found = doc.root.named("h1", "h2", "title")
    heading = next((n for n in found if n.local != "title"), None)
    title = next((n for n in found if n.local == "title"), None)
    return next((t for n in (heading, title) if n is not None and (t := n.flat())), "")


# Repair by findings. --------------------------------------------------------------------------------
def flat_path(path: str) -> str:
    text = path.replace("\\", "/").lstrip("/")
    return join("", text) or path


def free_id(base: str, taken: set[str]) -> str:
    return base if base not in taken else next(c for k in range(2, 1 << 30) if (c := f"{base}-{k}") not in taken)


def repair_metadata(root: Node, findings: list[Finding]) -> list[str]:
    meta, actions = root.child("metadata"), []
    codes = {f.code.upper() for f in findings}
    if meta is None:
        return actions
    if "OPF-030" in codes:
        named = [n for n in meta.children if n.local == "identifier" and n.content().strip()]
        chosen = next((n for n in named if n.get("id")), named[0] if named else None)
        if chosen is not None:
            if not chosen.get("id"):
                chosen.attrs["id"] = free_id("bookid", {n.get("id") for n in meta.children})
                actions.append(f"Assigned stable id to dc:identifier: {chosen.get('id')}")
            root.attrs["unique-identifier"] = chosen.get("id")
            actions.append(f"Pointed package unique-identifier to dc:identifier: {chosen.get('id')}")
    for f in findings:
        told = re.search(r'prefix:\s*"([A-Za-z][\w-]*)"', f.message, re.I) if f.code.upper() == "OPF-028" else None
        if told and told.group(1).lower() == "calibre" and f"{told.group(1)}:" not in root.get("prefix").split()[::2]:
            root.attrs["prefix"] = f"{root.get('prefix')} calibre: https://calibre-ebook.com".strip()
            actions.append("Declared known calibre metadata vocabulary")
    if "RSC-005" in codes:
        bad = {m.group(1) for f in findings if (m := re.search(r'Property "([^"]+)" must refine', f.message))}
        by_id = {n.get("id"): n for n in reversed(meta.children)}
        for n in [n for n in meta.children if n.local == "meta" and "refines" in n.attrs]:
            name, what = n.get("refines"), n.get("property")
            target = by_id.get(name[1:]) if name.startswith("#") else None
            wrong = what in bad and what in REFINED and target is not None and target.local not in REFINED[what].split()
            if not what or target is None or wrong:
                n.remove_with_tail()
                actions.append("Removed invalid metadata refinement")
    return actions


def remove_reference(n: Node, attr: str) -> str:
    """Takes a broken reference out of an element; what was done, in words."""
    if n.local in ("a", "area") and attr == "href":
        del n.attrs[attr]
        return "Removed broken link target (text preserved)"
    if n.local == "img":
        if alt := n.get("alt").strip():
            span = n.like("span")
            span.set_text(alt)
            n.parent.place(span, n)
            n.detach()
            return "Replaced broken image with alt text"
        n.remove_with_tail()
        return "Removed broken image without alt text"
    if n.local in ("link", "script", "image", "source"):
        n.remove_with_tail()
        return "Removed broken resource element"
    del n.attrs[attr]
    return "Removed broken resource attribute; fallback preserved" if n.local in ("object", "audio", "video") else "Removed broken reference"


def repair(book: Book, findings: list[Finding]) -> list[str]:
    """What findings allow: each repair needs its code, and those in a document also its path."""
    of = lambda *codes: [f for f in findings if f.code.upper() in codes]
    paths = lambda fs: {flat_path(unquote(f.path)) for f in fs if f.path}
    actions = repair_metadata(book.root, [f for f in findings if f.path and flat_path(unquote(f.path)) == flat_path(book.package_path)])
    if book.root.child("manifest") is None:
        return actions
    ncx = paths(of("NCX-001"))
    if ncx or (of("OPF-030") and actions):
        actions += _sync_ncx(book, ncx)
    if of("OPF-003"):
        spine = book.root.child("spine")
        used = {n.get("idref") for n in spine.children} if spine else set()
        for item in book.items:
            if item.get("href") and item.get("id") not in used and (p := book.path_of(item)) is not None and p not in book.files:
                item.remove_with_tail()
                actions.append(f"Removed missing manifest item: {item.get('href')}")
    broken, unlisted = paths(of("RSC-007", "RSC-012")), bool(of("OPF-012"))
    for item in [i for i in book.items if is_content(i)]:
        path = book.path_of(item)
        fix = path is not None and flat_path(path) in broken
        if (fix or unlisted) and path and book.page(path) and (done := _repair_page(book, path, fix, unlisted)):
            actions += done
            book.save(path)
    return actions


def _sync_ncx(book: Book, only: set[str]) -> list[str]:
    meta = book.root.child("metadata")
    chosen = next((n for n in (meta.children if meta else []) if n.local == "identifier" and n.get("id") == book.root.get("unique-identifier")), None)
    name, actions = chosen.content().strip() if chosen else "", []
    for item in book.items:
        path = book.path_of(item)
        if not name or item.get("media-type").lower() != NCX_TYPE or path not in book.files or (only and flat_path(path) not in only):
            continue
        doc = book.page(path)
        uid = next((n for n in doc.root.named("meta") if n.get("name").lower() == "dtb:uid"), None) if doc else None
        if uid is not None and uid.get("content") != name:
            uid.attrs["content"] = name
            book.save(path)
            actions.append(f"Synchronized NCX identifier with OPF identifier: {item.get('href')}")
    return actions


def _repair_page(book: Book, path: str, fix: bool, unlisted: bool) -> list[str]:
    actions: list[str] = []
    listed, ids = {book.path_of(i) for i in book.items}, {i.get("id") for i in book.items}
    for n in list(book.page(path).root.elements()):
        for attr in [a for a in n.attrs if a in ("href", "src", "data") or (":" in a and a.endswith(":href"))]:
            value = n.get(attr)
            link = uri(value)
            if not value or link.external:
                continue
            target = join(posixpath.dirname(path), unquote(link.path)) if link.path else path
            if target is None:
                continue
            there = target in book.files
            lost = bool(link.fragment) and there and (not link.path or is_html(target)) and unquote(link.fragment) not in book.anchors(target)
            if not there or (lost and not link.path):
                if fix:
                    actions.append(f"{remove_reference(n, attr)}: {value}")
            elif lost:
                n.attrs[attr] = link.path
                actions.append(f"Removed broken fragment: {value}")
            elif unlisted and link.path and not (link.fragment and is_html(target)) and target not in listed:
                if media := mimetypes.guess_type(target)[0]:
                    stem = re.sub(r"[\W_]", "-", posixpath.splitext(posixpath.basename(target))[0]).strip("-")
                    name = free_id(f"added-{stem}", ids)
                    ids.add(name)
                    listed.add(target)
                    href = relative(book.package_path, target)
                    book.manifest.append(book.manifest.like("item", id=name, href=href, **{"media-type": media}))
                    actions.append(f"Added manifest item for referenced resource: {href}")
    return actions

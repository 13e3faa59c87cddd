import io
import zipfile

import pytest

from quire import markup
from quire.operators import books as ops
from quire.operators import classify, findings, rewrite
from quire.operators.books import Book
from quire.operators.findings import CheckResult, Finding
from quire.plans import batch
from quire.plans import normalize as plan
from quire.sources import archives

OPF = '<package xmlns="http://www.idpf.org/2007/opf" version="{version}" unique-identifier="id"><metadata xmlns:dc="http://purl.org/dc/elements/1.1/">{meta}</metadata><manifest>{items}</manifest><spine>{spine}</spine></package>'


def book(pages, version="2.0", meta='<dc:identifier id="id">x</dc:identifier>', extra="", files=()):
    items = "".join(f'<item id="i{k}" href="{p}" media-type="application/xhtml+xml"/>' for k, p in enumerate(pages)) + extra
    spine = "".join(f'<itemref idref="i{k}"/>' for k in range(len(pages)))
    out = {"mimetype": b"application/epub+zip", ops.CONTAINER: b'<container xmlns="urn:oasis:names:tc:opendocument:xmlns:container"><rootfiles><rootfile full-path="O/b.opf"/></rootfiles></container>'}
    out |= {f"O/{p}": f"<html><head><title>{p}</title></head><body>{body}</body></html>".encode() for p, body in pages.items()}
    out |= {"O/b.opf": OPF.format(version=version, meta=meta, items=items, spine=spine).encode()} | dict(files)
    return out


LINKS = [
    ("T/a.x", "old/b.x", {"T/b.x": ""}, "b.x"),
    ("T/a.x", "b.x#n", {"T/b.x": "", "U/c.x": '<p id="n"/>'}, "../U/c.x#n"),
    ("T/a.x", "old%20x/b%20c.x?q#n", {"T/b c.x": '<a name="n"/>'}, "b%20c.x?q#n"),
    ("T/a.x", "b.x", {"U/b.x": "", "V/b.x": ""}, None),
    ("T/a.x", "gone.x", {"U/b.x": ""}, None),
    ("T/a.x", "/b.x", {"U/b.x": ""}, "../U/b.x"),
]


@pytest.mark.parametrize("source, href, others, want", LINKS)
def test_link_repair(source, href, others, want):
    b = Book.open(book({source: f'<p>see <a id="k" href="{href}">x <i>y</i></a></p>', **others}))
    assert len(ops.repair_links(b)) == 1
    a = b.page(f"O/{source}").root.named("a")[0]
    assert a.attrs.get("href") == want and a.get("id") == "k" and a.flat() == "x y"
    assert ops.repair_links(b) == []


def test_valid_links_leave_the_page_alone():
    pages = {"T/a.x": '<p id="s"><a href="#s">1</a><a href="b.x#t">2</a><a href="http://x/">3</a><a href="//h">4</a><a href="mailto:x">5</a><a>6</a></p>', "T/b.x": '<p id="t"/>'}
    files = book(pages)
    b = Book.open(dict(files))
    assert ops.repair_links(b) == [] and b.files["O/T/a.x"] == files["O/T/a.x"]


def test_colliding_entries_keep_the_first_name_and_the_last_content():
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        z.writestr("Café.txt", "one")
        z.writestr("cafe\u0301.TXT", "two")
    assert archives.unpack(buffer.getvalue()) == {"Café.txt": b"two"}


def test_archive_failures_come_in_order():
    good = archives.pack(book({"a.x": ""}))
    assert archives.error_of("x.epub", good) is None
    assert archives.error_of("x.zip", good).startswith("Input file must use")
    assert archives.error_of("x.epub", b"no").startswith("Input file is not a valid ZIP")
    assert archives.error_of("x.epub", archives.pack({"mimetype": b"x"})) == "EPUB mimetype is invalid."
    assert archives.error_of("x.epub", archives.pack({"mimetype": b"application/epub+zip"})).endswith("container.xml.")
    assert archives.pack(book({"a.x": ""})) == good and archives.unpack(good)["mimetype"] == b"application/epub+zip"


@pytest.mark.parametrize("name", ["../x", "/x", "c:\\x", "a/../b"])
def test_unsafe_names(name):
    with pytest.raises(ValueError):
        archives.safe_name(name)


def test_entities_and_edits_keep_text():
    doc = markup.parse("<!DOCTYPE a><a xmlns='u'>x&nbsp;<b>y</b>tail<c/></a><!--end-->")
    assert doc.root.content() == "x&nbsp;ytail" and doc.before == "<!DOCTYPE a>"
    doc.root.child("b").unwrap()
    doc.root.child("c").detach()
    assert markup.serialize(doc.root) == '<a xmlns="u">x&nbsp;ytail</a>'
    doc = markup.parse("<a>1<b/>2<c/>3</a>")
    doc.root.child("b").remove_with_tail()
    assert markup.serialize(doc.root) == "<a>1<c/>3</a>"


@pytest.mark.parametrize("bad", ["<p>a<p>b", "<div><b>x</div>y", "<ul><li>1<li>2</ul>", "text", "", "<", "<p a=1 a=2>x&bogus;</p></q>"])
def test_tolerant_parsing_gives_well_formed_markup(bad):
    doc = markup.parse(bad)
    assert doc is None or markup.parse(doc.serialize(), recover=False) is not None


def test_rows_are_intervals():
    rows = markup.rows(markup.parse("<a><b>t<c/></b><d/></a>").root)
    assert [(r[0], r[1], r[2], r[7]) for r in rows] == [(0, 4, None, "a"), (1, 3, 0, "b"), (2, 2, 1, None), (3, 3, 1, "c"), (4, 4, 0, "d")]


def test_phrases_and_spans():
    out = rewrite.normalize('<html><body>one <em>two</em><blockquote><blockquote>three</blockquote></blockquote><span class="bold">four</span> FIVE<span>SIX</span><font>!</font></body></html>')
    root = markup.parse(out).root
    assert len(root.named("blockquote")) == 1 and [n.flat() for n in root.named("strong")] == ["four"]
    assert [n.get("class") for n in root.named("span")] == ["eo-smallcaps"] and root.flat() == "one twothreefour FIVESIX!"
    assert rewrite.normalize(out) == out


def test_dangerous_and_missing_go():
    out = rewrite.normalize('<html><body><p><a href=" JavaScript:x">a</a><img src="no.png"/>kept</p><p class="image"></p></body></html>', files=frozenset(["a.png"]))
    root = markup.parse(out).root
    assert "href" not in root.named("a")[0].attrs and not root.named("img") and root.flat() == "akept"


@pytest.mark.parametrize("href, properties, role", [("x/cover.x", "", "title"), ("x.x", "nav", "toc"), ("subtitle-title.x", "", "front"), ("part2.x", "", "part"), ("chap_1.x", "", "chapter"), ("ch/ch01.x", "", "chapter"), ("discover.x", "", "body"), ("acknowledgements.x", "", "front"), ("toc.x", "", "toc")])
def test_document_roles(href, properties, role):
    assert classify.document_role("", href, properties) == role


def test_block_roles_follow_the_state():
    out = markup.parse("<html><body><h1>One</h1><p><em>An epigraph that is long enough to count</em></p><p>- Someone</p><p>Text.</p><p>More.</p><p>***</p><p>Next.</p></body></html>").root
    classify.classify(out, "chapter")
    assert [n.get("class") for n in out.named("h1", "p")] == ["eo-chapter", "eo-extract", "eo-extract", "eo-first", "eo-body", "eo-scene-break", "eo-first"]


def test_refined_roles():
    page = lambda lines: markup.parse(f"<html><body>{''.join(f'<p>{x}</p>' for x in lines)}</body></html>").root
    assert classify.refine(page(["Contents", *[f"Chapter {k}" for k in range(5)]]), "body") == "toc"
    assert classify.refine(page(["Dedication", "For them"]), "body") == "dedication"
    assert classify.refine(page(["ISBN 1", "Copyright 2000", "x"]), "body") == "metadata"
    assert classify.refine(page(["Also by A", "ONE", "Two", "Three"]), "body") == "works"
    assert classify.refine(page(["Just", "some text that tells nothing"]), "body") == "body"


def test_issues():
    pages = {"a.x": '<p id="d"><a href="no.x">1</a><a href="b.xhtml#no">2</a><a href="data:x">3</a><a href="../../x">4</a></p><p id="d"/>', "b.xhtml": ""}
    files = book(pages, extra='<item id="z" href="lost.png" media-type="image/png"/>')
    files["O/b.opf"] = files["O/b.opf"].replace(b"<spine>", b'<spine><itemref idref="none"/>')
    assert [c for _, c, _ in ops.issues(Book.open(files))] == ["missing-manifest-file", "missing-spine-target", "missing-link-target", "missing-link-anchor", "unsafe-link-scheme", "unsafe-link-target", "duplicate-id"]


def error(code="E", message="m", path=None, severity="error"):
    return Finding(severity, code, message, path)


def test_compare_pairs_findings():
    run = lambda *f: CheckResult(True, findings=list(f))
    c = findings.compare(run(error(path="a"), error(path="a"), error("F")), run(error(path="a"), error("G")))
    assert (len(c.persisting), len(c.resolved), len(c.introduced)) == (1, 2, 1)
    c = findings.compare(run(error(path="a")), run(error()))
    assert (len(c.persisting), len(c.resolved), len(c.introduced)) == (1, 0, 0)
    c = findings.compare(run(error(path="a")), run(error(path="a"), error(path="a")))
    assert (len(c.persisting), len(c.introduced)) == (2, 0)
    c = findings.compare(run(error(path="a")), run(error(path="b")))
    assert (len(c.resolved), len(c.introduced)) == (1, 1)
    assert findings.rejection(c) == "optimized EPUB introduced EPUBCheck errors: E: m (x1; resources: b)"


@pytest.mark.parametrize("text, status", [("{", 0), ("{}", 0), ("[]", 0), ('{"messages": 1}', 0), ('{"messages": []}', 2)])
def test_bad_reports_are_unavailable(text, status):
    assert not findings.parse_report(text, status).available


def test_repair_is_gated_by_code_and_path():
    pages = {"a.x": '<p><a href="no.x">t</a><img src="no.png" alt="alt"/><object data="no.bin">f</object></p>'}
    for code, path in (("X", "O/a.x"), ("RSC-007", "O/b.x"), ("RSC-007", None)):
        assert ops.repair(Book.open(book(pages)), [error(code, path=path)]) == []
    b = Book.open(book(pages))
    assert len(ops.repair(b, [error("RSC-007", path="O/a.x")])) == 3
    assert b.page("O/a.x").root.flat() == "a.xtaltf"


def test_metadata_repairs():
    meta = '<dc:identifier>u1</dc:identifier><meta refines="#no" property="role">x</meta><meta refines="#t" property="role">y</meta><dc:title id="t">T</dc:title>'
    b = Book.open(book({"a.x": ""}, meta=meta))
    told = [error("OPF-030", path="O/b.opf"), error("OPF-028", 'Undeclared prefix: "calibre"', "O/b.opf"), error("RSC-005", 'Property "role" must refine a creator', "O/b.opf")]
    assert len(ops.repair(b, told)) == 5
    assert b.root.get("unique-identifier") == "bookid" and "calibre:" in b.root.get("prefix") and not [n for n in b.root.child("metadata").children if n.local == "meta"]


def test_navigation():
    b = Book.open(book({"a.x": "<h1>One</h1>", "b.x": ""}, version="3.0"))
    assert ops.ensure_nav(b) and not ops.ensure_nav(b)
    assert [a.flat() for a in markup.parse(b.files["O/nav.xhtml"]).root.named("a")] == ["One", "b.x"]
    ncx = '<ncx><navMap><navPoint playOrder="9"><navLabel><text> a  b </text></navLabel><content src="a.x"/></navPoint><navPoint><content src="no.x"/></navPoint><navPoint><content src="a.x"/></navPoint></navMap></ncx>'
    b = Book.open(book({"a.x": ""}, extra='<item id="n" href="t.ncx" media-type="application/x-dtbncx+xml"/>', files={"O/t.ncx": ncx.encode()}))
    assert ops.normalize_ncx(b) == 1 and ops.normalize_ncx(b) == 0
    assert [n.get("playOrder") for n in b.page("O/t.ncx").root.named("navpoint")] == ["1", "1"]


def scripted(*results):
    left = list(results)
    return lambda _: left.pop(0) if len(left) > 1 else left[0]


def test_normalized_book():
    extra = '<item id="c" href="s.css" media-type="text/css"/><item id="f" href="f.otf" media-type="font/otf"/>'
    content = archives.pack(book({"a.x": '<p class="r">x</p>'}, extra=extra, files={"O/s.css": b".r{text-align:right}", "O/f.otf": b"x"}))
    out = plan.normalize_book("b.epub", content)
    files = archives.unpack(out["output"])
    assert out["outcome"] == "unavailable" and out["removed_files"] == 2 and "O/s.css" not in files and ops.REPORT in files
    assert b"eo-right" in files["O/a.x"] and out["output"] == plan.normalize_book("b.epub", content)["output"]
    assert plan.normalize_book("b.epub", content, plan.Options(preserve_publisher_css=True))["removed_files"] == 1
    ok, bad = CheckResult(True), CheckResult(True, findings=[error(path="O/a.x")])
    assert plan.normalize_book("b.epub", content, plan.Options(checker=scripted(ok)))["outcome"] == "clean"
    same = plan.normalize_book("b.epub", content, plan.Options(checker=scripted(bad)))
    assert (same["outcome"], same["remaining"], same["persisting"]) == ("legacy_issues", 1, 1)


@pytest.mark.parametrize("results, why", [((CheckResult(True), CheckResult(False)), "not for the output"), ((CheckResult(False), CheckResult(True, findings=[error()])), "couldn't be checked"), ((CheckResult(True), CheckResult(True, findings=[error()])), "introduced"), ((CheckResult(True), CheckResult(True), CheckResult(True, findings=[error()])), "changed")])
def test_rejected_books(results, why):
    with pytest.raises(plan.Rejected, match=why):
        plan.normalize_book("b.epub", archives.pack(book({"a.x": ""})), plan.Options(checker=scripted(*results)))


def test_image_headers():
    png = b"\x89PNG\r\n\x1a\n" + b"\0\0\0\rIHDR" + (640).to_bytes(4) + (480).to_bytes(4)
    jpeg = b"\xff\xd8\xff\xe0\x00\x04ab\xff\xc2\x00\x11\x08" + (48).to_bytes(2) + (64).to_bytes(2) + b"\x03"
    assert archives.dimensions(png) == (640, 480) and archives.dimensions(jpeg) == (64, 48) and archives.dimensions(b"GIF89a") is None


def test_job_plans(tmp_path):
    a = tmp_path / "a.epub"
    a.write_bytes(b"x")
    assert batch.plan([str(a)])[0].destination.endswith("a-normalized.epub")
    with pytest.raises(batch.UsageError):
        batch.plan([str(a)], output=str(a))
    with pytest.raises(batch.UsageError):
        batch.plan([str(a), str(tmp_path / "d" / "a.epub")], output_dir=str(tmp_path))
    for argv in (["x"], ["x", "--dry-run", "--force"], ["x", "--output-dir", "y", "--max-bytes", "0"]):
        with pytest.raises(SystemExit) as e:
            batch.arguments(argv)
        assert e.value.code == 2


def test_only_blank_text_is_empty():
    from quire.markup import parse
    from quire.operators import classify

    root = parse('<html><body><p/><p> </p><p><a id="x"/></p><p><br/></p><p><!-- note --></p><p>t</p><div><hr/></div></body></html>').root
    assert [classify.is_empty(n) for n in root.named("p", "div")] == [True, True, False, False, False, False, False]

"""What the work costs: calls counted, not seconds, so that it is the same on every machine."""

import sys

import pytest

from quire import corpus, markup
from quire.operators import books as ops
from quire.operators import rewrite
from quire.operators.findings import CheckResult
from quire.plans import normalize as plan
from quire.sources import archives
from tests.test_books import book


def calls(work):
    n = 0

    def see(frame, event, arg):
        nonlocal n
        n += event in ("call", "c_call")

    sys.setprofile(see)
    try:
        work()
    finally:
        sys.setprofile(None)
    return n


def page(line, k):
    return f"<!DOCTYPE html><html><head><meta charset=u><title>t</title></head><body>{''.join(line.format(j) for j in range(k))}</body></html>"


LINES = ["<div>line {}</div>", '<p>Line {} of <b>this</b> page.</p><p class="x"></p><img src="no.png">', '<p id="a">x<br>{}']


@pytest.mark.parametrize("line", LINES)
@pytest.mark.parametrize("role", ["front", "body"])
def test_a_line_costs_the_same_on_a_long_page(line, role):
    rewrite.normalize(page(line, 5), role=role)  # caches of words are filled
    short, long = (calls(lambda k=k: rewrite.normalize(page(line, k), role=role)) / k for k in (50, 200))
    assert long < 1.1 * short and short < 800


ODD = [
    "<p>a<p>b&nbsp;&copy c&#65;&#x41 &bogus", "a & b < c &", "<div a=1 b='x' c>t</div>", '<br/><hr /><p a="x" b="y"/>', "<script>var t='</p>';</script>x", "<script>if (a<b) c</script ><p>", "<style><!-- a --></style><p>x", "<title>a &amp; <b>b</title>",
    "<!-- c --><p><!-- d -- e --><![CDATA[x<y]]><?pi?>", '<p a="x&amp;y" A="1">', "<P CLASS='q'>x</P>", "</ p></p a='1'></>", "<p", "<p a='x", "<script>never closed <p>", '<p\na="x"\tb="y">', "<a-;&a-;&a-b", "<textarea><p></textarea>", "<plaintext><p>x",
]


@pytest.mark.parametrize("text", [*ODD, "<html>" + "".join(ODD), *("<x>" + a + b for a, b in zip(ODD, ODD[1:]))])
def test_plain_markup_is_read_as_the_parser_reads_it(text):
    one, other = markup._Tolerant(), markup._Tolerant()
    one.read(text)
    other.feed(text)
    other.close()
    tree = lambda p: markup.rows(p.made.root) if p.made.root else None
    assert tree(one) == tree(other)


@pytest.mark.parametrize("text", ["<a>1<style>2</style>3<b/>4<style/><style/>5<!--c-->6<i>7<style>8</style>9&nbsp;0</i></a>", "<style>1<style>2</style>3</style>", "<a/>"])
def test_text_without_styles_is_what_is_left_when_they_go(text):
    root, other = markup.parse(text).root, markup.parse(text).root
    for n in other.named("style"):
        n.remove_with_tail()
    assert root.content(without="style") == other.content()


def test_lists_of_elements_follow_the_steps():
    text = '<html><head><style>x</style>tail</head><body>one<font><b>two</b></font><blockquote><blockquote>q</blockquote></blockquote><p></p><p class="image"><img src="no.png"/></p><span class="bold">s</span></body></html>'
    at = rewrite.Page(markup.parse(text).root, "p.xhtml", rewrite.SHEET, "body", {}, frozenset())
    for step in rewrite.STEPS:
        step(at)
        assert at.elements() == at.root.elements(), step.__name__


def test_pages_are_dealt_to_several_tasks_a_core(spark):
    pages = spark.createDataFrame([(k, "<p>x</p>") for k in range(500)], "page_id long, html string")
    dealt = corpus.spread(pages, "page_id")
    assert dealt.rdd.getNumPartitions() >= 4 * spark.sparkContext.defaultParallelism and dealt.count() == 500


def test_a_book_without_a_checker_is_packed_and_looked_over_once(monkeypatch):
    content, done = archives.pack(book({"a.x": "<p>x</p>"})), []
    pack, issues = archives.pack, ops.issues
    monkeypatch.setattr(archives, "pack", lambda files: done.append("pack") or pack(files))
    monkeypatch.setattr(ops, "issues", lambda b: done.append("issues") or issues(b))
    out = plan.normalize_book("b.epub", content)["output"]
    assert sorted(done) == ["issues", "pack"]
    seen = []
    checked = plan.normalize_book("b.epub", content, plan.Options(checker=lambda data: seen.append(data) or CheckResult(False, "unavailable")))["output"]
    assert len(seen) == 3 and seen[2] == checked == out != seen[1]


def test_anchors_of_a_page_are_read_once_for_all_links_to_it():
    def work(k):
        pages = {"a.x": "".join(f'<p><a href="b.xhtml#n{j}">x</a></p>' for j in range(k)), "b.xhtml": "".join(f'<p id="n{j}">x</p>' for j in range(k))}
        b = ops.Book.open(book(pages))
        return calls(lambda: (ops.issues(b), ops.repair_links(b))) / k

    work(5)
    assert work(200) < 1.2 * work(50)


def test_books_are_dealt_to_several_tasks_a_core(spark):
    from quire import queries

    made = queries.books(spark, "/root/testdata/sf0.001")
    assert made.rdd.getNumPartitions() >= 4 * spark.sparkContext.defaultParallelism

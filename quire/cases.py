"""Registered queries over documents written out case by case: what each step, rule and tree operator makes of them.

Every page takes the case of its number, with the page's id worked into the markup, so that the expected rows
follow from page_id alone and SQL can say them.
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.corpus import table
from quire.operators import classify, rewrite, tables
from quire.ship import ship
from quire.sources import archives

LONG = "Words that go on and on until the line is long enough to be told from a heading by its length alone, which takes more than a hundred and forty characters."

# (step, markup, what the step makes of it); {i} is the page's id. -------------------------------------
STEPS = [
    ("link_sheet", '<html><head><link rel="stylesheet" href="o{i}.css"/><link rel="icon" href="i.png"/></head><body/></html>',
     '<html><head><link href="i.png" rel="icon"/><link href="Styles/quire.css" rel="stylesheet" type="text/css"/></head><body/></html>'),
    ("drop_styles", "<html><head><style>p{i}</style></head><body>x<style>y</style> tail<p>z</p></body></html>", "<html><head/><body>x<p>z</p></body></html>"),
    ("drop_dangerous", '<html><body><a href=" javascript:f({i})">a</a><a href="t{i}.xhtml">b</a><img src="data:x"/></body></html>', '<html><body><a>a</a><a href="t{i}.xhtml">b</a><img/></body></html>'),
    ("align", '<html><body><p align="right">a</p><p style="text-align: center">b</p><p class="told">{i}</p><p>d</p></body></html>',
     '<html><body><p align="right" class="eo-right">a</p><p class="eo-centered" style="text-align: center">b</p><p class="told eo-right">{i}</p><p>d</p></body></html>'),
    ("drop_presentation", '<html><body><p align="x" style="y" id="k{i}">a</p><svg width="9" color="z"/><td width="5">c</td></body></html>', '<html><body><p id="k{i}">a</p><svg width="9"/><td>c</td></body></html>'),
    ("drop_missing_images", '<html><body><p><img src="here.png"/></p><p>x<img src="gone{i}.png"/></p><div class="cover"><img src="gone.png"/></div><p class="image"><a id="k{i}"/></p><p><img/></p></body></html>',
     '<html><body><p><img src="here.png"/></p><p>x</p><p class="image"><a id="k{i}"/></p><p/></body></html>'),
    ("unwrap_fonts", '<html><body><p>a<font color="red">b<b>{i}</b></font>c</p></body></html>', "<html><body><p>ab<b>{i}</b>c</p></body></html>"),
    ("spans", '<html><body><p><span class="bold">a{i}</span><span class="ital">b</span><span class="underline">c</span><span class="eo-strike x">d</span><span>AB</span><span class="x">cd</span></p></body></html>',
     '<html><body><p><strong>a{i}</strong><em>b</em><span class="eo-underline">c</span><span class="eo-strike">d</span><span class="eo-smallcaps">AB</span><span>cd</span></p></body></html>'),
    ("wrap_phrases", "<html><body>one <em>two{i}</em><p>x</p> <div>y</div>tail</body></html>", "<html><body><p>one <em>two{i}</em></p><p>x</p> <div>y</div><p>tail</p></body></html>"),
    ("unique_ids", '<html><body><p id="a{i}"/><p id="a{i}"/><p id="a{i}-2"/><p id="a{i}"/></body></html>', '<html><body><p id="a{i}"/><p id="a{i}-3"/><p id="a{i}-2"/><p id="a{i}-4"/></body></html>'),
    ("nested_quotes", "<html><body><blockquote><blockquote><p>{i}</p></blockquote></blockquote><blockquote>t<blockquote>u</blockquote></blockquote></body></html>",
     "<html><body><blockquote><p>{i}</p></blockquote><blockquote>t<blockquote>u</blockquote></blockquote></body></html>"),
    ("drop_empty", '<html><body><div><p> </p><p><br/></p><p><a id="n{i}"/></p><div><hr/></div><p><video src="v"/></p><section class="ornament"/><p>x</p></div><div/></body></html>',
     '<html><body><div><p><br/></p><p><a id="n{i}"/></p><div><hr/></div><p><video src="v"/></p><section class="ornament"/><p>x</p></div></body></html>'),
    ("keep_roles", '<html><body><p class="x eo-first y">a</p><p class="z{i}">b</p></body></html>', '<html><body><p class="eo-first">a</p><p>b</p></body></html>'),
]

# (document role, body, the body with the roles of its blocks). ----------------------------------------
BLOCKS = [
    ("chapter", "<h1>Chapter {i}</h1><p>One.</p><p>Two.</p><p>***</p><p>Three.</p>", '<h1 class="eo-chapter">Chapter {i}</h1><p class="eo-first">One.</p><p class="eo-body">Two.</p><p class="eo-scene-break">***</p><p class="eo-first">Three.</p>'),
    ("toc", '<h1>Contents</h1><p><a href="c{i}.xhtml">The one</a></p><p><a href="x.xhtml">PART ONE</a></p><p><a href="x.xhtml">An entry of several words</a></p>',
     '<h1 class="eo-toc-heading">Contents</h1><p class="eo-toc-chapter"><a href="c{i}.xhtml">The one</a></p><p class="eo-toc-part"><a href="x.xhtml">PART ONE</a></p><p class="eo-toc-entry"><a href="x.xhtml">An entry of several words</a></p>'),
    ("title", "<p>The Book {i}</p><p>written by</p><p>John Smith</p><p>Some Press</p>", '<h1 class="eo-title-main">The Book {i}</h1><p class="eo-title-credit-label">written by</p><p class="eo-title-credit">John Smith</p><p class="eo-title-publisher">Some Press</p>'),
    ("metadata", "<h2>Colophon</h2><p>ISBN: {i}</p>", '<h2 class="eo-metadata-title">Colophon</h2><p class="eo-metadata-line">ISBN: {i}</p>'),
    ("works", "<p>Also by the author</p><p>NOVELS</p><p>Title {i}</p>", '<h1 class="eo-front">Also by the author</h1><p class="eo-front-section">NOVELS</p><p class="eo-front-list-item">Title {i}</p>'),
    ("dedication", "<p>Dedication</p><p>To {i}</p>", '<h1 class="eo-front">Dedication</h1><p class="eo-dedication">To {i}</p>'),
    ("part", f"<p>Part {{i}}</p><p>{LONG}</p><p>Text.</p>", f'<h1 class="eo-part">Part {{i}}</h1><p class="eo-first">{LONG}</p><p class="eo-body">Text.</p>'),
    ("body", '<p class="ltg">Dear {i},</p><p class="lt">Text.</p><p class="ept">Signed</p>', '<p class="eo-letter-opener">Dear {i},</p><p class="eo-letter-body">Text.</p><p class="eo-letter-attribution">Signed</p>'),
    ("body", "<p><em>some words that are long enough {i}</em></p><p>— Author</p><p>Then.</p>", '<p class="eo-extract"><em>some words that are long enough {i}</em></p><p class="eo-extract">— Author</p><p class="eo-first">Then.</p>'),
    ("front", "<div>Thanks</div><div>Anna {i}</div><div>Bertil</div>", '<h1 class="eo-front">Thanks</h1><p class="eo-front-list-item">Anna {i}</p><p class="eo-front-list-item">Bertil</p>'),
    ("body", '<p class="caption">{i}</p><p class="verse">a</p><p class="note">b</p><ul><li>c</li></ul><blockquote>d</blockquote>',
     '<p class="eo-caption">{i}</p><p class="eo-poetry">a</p><p class="eo-footnote">b</p><ul class="eo-list"><li>c</li></ul><blockquote class="eo-blockquote">d</blockquote>'),
]

# (document role, body, the role that its content gives). ----------------------------------------------
REFINED = [
    ("body", '<div><img src="c{i}.png"/></div>', "title"),
    ("body", "<p>Dedicated to</p><p>Anna {i}</p>", "dedication"),
    ("body", "<p>Copyright {i}</p><p>ISBN: 1-2-3</p>", "metadata"),
    ("body", "<p>Contents</p><p>Chapter {i}</p><p>Chapter 2</p><p>Chapter 3</p><p>Epilogue</p>", "toc"),
    ("front", "<p>Also by the author</p><p>NOVELS</p><p>Title {i}</p><p>Another title</p>", "works"),
    ("prologue", f"<h1>Prologue</h1><p>{LONG} {{i}}</p><p>{LONG}</p>", "body"),
    ("prologue", "<h1>Prologue</h1><p>{i} is short.</p>", "front"),
    ("part", "<p>Contents {i}</p>", "part"),
    ("chapter", f"<p>{{i}}</p><p>{LONG}</p>", "chapter"),
]


def _sql(text: str) -> str:
    return "'" + text.replace("'", "''").replace("{i}", "' || page_id || '") + "'"


def _expected(cases: list[tuple[str, str, str]], column: str, name: str) -> str:
    pick = lambda k: " ".join(f"WHEN {n} THEN {_sql(c[k])}" for n, c in enumerate(cases))
    return f"SELECT page_id, CASE page_id % {len(cases)} {pick(0)} END AS {name}, CASE page_id % {len(cases)} {pick(2)} END AS {column} FROM pages"


def _worked(spark: SparkSession, sf: str, cases: list[tuple[str, str, str]], work: Callable[[str, str], str], column: str, name: str) -> DataFrame:
    def run(batches):
        for batch in batches:
            ids = batch.column("page_id").to_pylist()
            rows = [(cases[i % len(cases)][0], work(cases[i % len(cases)][0], cases[i % len(cases)][1].replace("{i}", str(i)))) for i in ids]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.string())], names=["page_id", name, column])

    return table(ship(spark), sf, "pages").select("page_id").mapInArrow(run, f"page_id bigint, {name} string, {column} string")


def _step(step: str, text: str) -> str:
    from quire.markup import parse, serialize

    root = parse(text).root
    getattr(rewrite, step)(rewrite.Page(root, "p.xhtml", rewrite.SHEET, "body", {"told": "eo-right"}, frozenset(["here.png"])))
    return serialize(root)


def _blocks(role: str, body: str) -> str:
    from quire.markup import parse, serialize

    root = parse(f"<html><body>{body}</body></html>").root
    classify.classify(root, role)
    return serialize(root).removeprefix("<html><body>").removesuffix("</body></html>")


def _refined(role: str, body: str) -> str:
    from quire.markup import parse

    return classify.refine(parse(f"<html><body>{body}</body></html>").root, role)


def rewrite_steps(spark: SparkSession, sf: str) -> DataFrame:
    return _worked(spark, sf, STEPS, _step, "made", "step")


def block_roles(spark: SparkSession, sf: str) -> DataFrame:
    return _worked(spark, sf, BLOCKS, _blocks, "made", "document_role")


def refined_roles(spark: SparkSession, sf: str) -> DataFrame:
    return _worked(spark, sf, REFINED, _refined, "role", "given")


# Trees. In preorder: html 0, body 1, div 2, p 3, x 4, b 5, its text 6, y 7, p 8, its text 9, ul 10, its items. ---
def _trees(spark: SparkSession, sf: str) -> DataFrame:
    i = F.col("page_id").cast("string")
    html = F.concat(F.lit('<html><body><div id="a'), i, F.lit('"><p>x<b>b'), i, F.lit('</b>y</p><p name="n">z</p></div><ul>'), F.repeat(F.lit("<li>l</li>"), (F.col("page_id") % 5).cast("int")), F.lit("</ul></body></html>"))
    return tables.nodes(table(spark, sf, "pages").select("page_id", html.alias("html"))).withColumnRenamed("doc_id", "page_id")


def _of_doc(f: Callable[[DataFrame], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf: f(_trees(spark, sf).withColumnRenamed("page_id", "doc_id")).withColumnRenamed("doc_id", "page_id")


tree_children = _of_doc(lambda n: tables.children(n).groupBy("doc_id", "parent_ix").agg(F.count("*").alias("n")))
tree_first_child = _of_doc(lambda n: tables.first_child(n, "p"))
tree_descendants = _of_doc(lambda n: tables.descendants(n, "div"))
tree_anchors = _of_doc(tables.anchors)
tree_contents = _of_doc(lambda n: tables.contents(n, "p"))
tree_runs = _of_doc(lambda n: n.where("kind = 'element'").groupBy("doc_id", "local").agg(F.count("*").alias("n"), F.max("depth").cast("bigint").alias("depth")))


def jpeg_headers(spark: SparkSession, sf: str) -> DataFrame:
    two = lambda c: F.lpad(F.hex(c), 4, "0")
    head = F.unhex(F.concat(F.lit("FFD8FFE000040000FFC4000600000000FFC0001108"), two(F.col("page_id") % 77 + 5), two(F.col("page_id") % 1000 + 1), F.lit("03012200")))
    return table(ship(spark), sf, "pages").select("page_id", archives.image_size(head).alias("s")).select("page_id", "s.width", "s.height")


QUERIES: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str]] = {
    "rewrite_steps": (rewrite_steps, _expected(STEPS, "made", "step")),
    "block_roles": (block_roles, _expected(BLOCKS, "made", "document_role")),
    "refined_roles": (refined_roles, _expected(REFINED, "role", "given")),
    "tree_children": (tree_children, "SELECT page_id, ix AS parent_ix, n FROM pages, (VALUES (0, 1), (1, 2), (2, 2), (3, 1)) AS t(ix, n) UNION ALL SELECT page_id, 10, page_id % 5 FROM pages WHERE page_id % 5 > 0"),
    "tree_first_child": (tree_first_child, "SELECT page_id, 2 AS parent_ix, 3 AS node_ix FROM pages"),
    "tree_descendants": (tree_descendants, "SELECT page_id, 2 AS ancestor_ix, CAST(ix AS INT) AS node_ix FROM pages, (SELECT unnest(range(3, 10)) AS ix)"),
    "tree_anchors": (tree_anchors, "SELECT page_id, 'a' || page_id AS anchor FROM pages UNION ALL SELECT page_id, 'n' FROM pages"),
    "tree_contents": (tree_contents, "SELECT page_id, 3 AS node_ix, 'xb' || page_id || 'y' AS content FROM pages UNION ALL SELECT page_id, 8, 'z' FROM pages"),
    "tree_depths": (tree_runs, "SELECT page_id, local, n, depth FROM pages, (VALUES ('html', 1, 0), ('body', 1, 1), ('div', 1, 2), ('ul', 1, 2), ('p', 2, 3), ('b', 1, 4)) AS t(local, n, depth) UNION ALL SELECT page_id, 'li', page_id % 5, 3 FROM pages WHERE page_id % 5 > 0"),
    "jpeg_headers": (jpeg_headers, "SELECT page_id, page_id % 1000 + 1 AS width, page_id % 77 + 5 AS height FROM pages"),
}

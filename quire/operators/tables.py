"""Relational operators over a corpus: nodes, links, anchors, validation and repair decisions as joins.

Tables: files(book_id, path), anchors(book_id, path, anchor), links(book_id, source, href).  All joins are
equi-joins on the book and a path, name or anchor; no side is broadcast by hand, so adaptive execution
picks the strategy by measured size.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire import markup
from quire.functions import paths, uris
from quire.operators import rewrite
from quire.ship import ship

NODES = f"doc_id bigint, {markup.NODE_FIELDS}"


def nodes(pages: DataFrame, id_column: str = "page_id", text_column: str = "html") -> DataFrame:
    """The trees of documents as rows in preorder."""

    def run(batches):
        for batch in batches:
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                doc = markup.parse(text or "")
                if doc is None:
                    continue
                cols = list(zip(*markup.rows(doc.root)))
                attrs = pa.array([None if a is None else list(a.items()) for a in cols[8]], pa.map_(pa.string(), pa.string()))
                made = [pa.array([i] * len(cols[0]), pa.int64()), *[pa.array(c, t) for c, t in zip(cols[:8], [pa.int32()] * 5 + [pa.string()] * 3)], attrs, pa.array(cols[9], pa.string())]
                yield pa.RecordBatch.from_arrays(made, names=[x.split()[0] for x in NODES.replace("map<string,string>", "map").split(", ")])

    ship(pages.sparkSession)
    return pages.select(F.col(id_column).cast("bigint"), text_column).mapInArrow(run, NODES)


def children(nodes_: DataFrame) -> DataFrame:
    """(doc_id, parent_ix, node_ix, local): elements below each element."""
    return nodes_.where("kind = 'element' and parent_ix is not null").select("doc_id", "parent_ix", "node_ix", "local")


def first_child(nodes_: DataFrame, local: str) -> DataFrame:
    return children(nodes_).where(F.col("local") == local).groupBy("doc_id", "parent_ix").agg(F.min("node_ix").alias("node_ix"))


def descendants(nodes_: DataFrame, local: str) -> DataFrame:
    """(doc_id, ancestor_ix, node_ix) for ancestors of one name: an interval join within a document."""
    up = nodes_.where(F.col("local") == local).select("doc_id", F.col("node_ix").alias("ancestor_ix"), F.col("end_ix").alias("last"))
    return up.join(nodes_.select("doc_id", "node_ix"), "doc_id").where("node_ix > ancestor_ix and node_ix <= last").select("doc_id", "ancestor_ix", "node_ix")


def contents(nodes_: DataFrame, local: str) -> DataFrame:
    """(doc_id, node_ix, content) of elements of one name: their text in document order.

    An element's text is a stretch of its document's: from the characters before the element to those up to its last
    descendant.  So there is one running sum over each document, and equi-joins.
    """
    text = F.when(F.col("kind") == "text", F.col("text")).when(F.col("kind") == "entity", F.concat(F.lit("&"), "text", F.lit(";")))
    run = Window.partitionBy("doc_id").orderBy("node_ix").rowsBetween(Window.unboundedPreceding, 0)
    n = nodes_.select("doc_id", "node_ix", "end_ix", "local", F.coalesce(text, F.lit("")).alias("part")).withColumn("upto", F.sum(F.char_length("part")).over(run))
    listed = F.array_sort(F.collect_list(F.when(F.col("part") != "", F.struct("node_ix", "part"))))
    whole = n.groupBy("doc_id").agg(F.array_join(F.transform(listed, lambda x: x["part"]), "").alias("whole"))
    tops = n.where(F.col("local") == local).select("doc_id", "node_ix", "end_ix", F.col("upto").alias("start"))
    found = tops.join(n.select("doc_id", F.col("node_ix").alias("end_ix"), "upto"), ["doc_id", "end_ix"]).join(whole, "doc_id")
    return found.select("doc_id", "node_ix", F.substring("whole", (F.col("start") + 1).cast("int"), (F.col("upto") - F.col("start")).cast("int")).alias("content"))


def anchors(nodes_: DataFrame) -> DataFrame:
    """(doc_id, anchor): every id and name."""
    both = nodes_.where("kind = 'element'").select("doc_id", F.explode(F.array(F.col("attrs")["id"], F.col("attrs")["name"])).alias("anchor"))
    return both.where("anchor is not null and anchor <> ''").distinct()


def links(nodes_: DataFrame) -> DataFrame:
    """(doc_id, node_ix, local, attr, href)."""
    pair = F.explode(F.array(*[F.struct(F.lit(a).alias("attr"), F.col("attrs")[a].alias("href")) for a in ("href", "src")])).alias("x")
    return nodes_.where("kind = 'element'").select("doc_id", "node_ix", "local", pair).select("doc_id", "node_ix", "local", "x.*").where("href is not null")


def repeated_ids(ids: DataFrame, by: list[str], order: str) -> DataFrame:
    """Each holder of a name with its number: the first keeps it, the others get name-2, name-3 ..."""
    k = F.row_number().over(Window.partitionBy(*by).orderBy(order))
    return ids.withColumn("k", k).withColumn("new_id", F.when(F.col("k") == 1, F.col(by[-1])).otherwise(F.concat(F.col(by[-1]), F.lit("-"), F.col("k"))))


def phrase_runs(nodes_: DataFrame) -> DataFrame:
    """Runs of phrasing content between blocks: gaps and islands over the children of body and blockquote."""
    tops = nodes_.where(F.col("local").isin("body", "blockquote")).select("doc_id", F.col("node_ix").alias("parent_ix"))
    kids = nodes_.join(tops, ["doc_id", "parent_ix"])
    is_block = (F.col("kind") == "element") & F.col("local").isin(*sorted(rewrite.FLOW))
    run = F.sum(F.when(is_block, 1).otherwise(0)).over(Window.partitionBy("doc_id", "parent_ix").orderBy("sibling_ix"))
    rows = kids.withColumn("run", run).where(~is_block)
    return rows.groupBy("doc_id", "parent_ix", "run").agg(F.min("node_ix").alias("first_ix"), F.count("*").alias("n"))


def resolve(links_: DataFrame, files: DataFrame, anchors_: DataFrame) -> DataFrame:
    """links(book_id, link_id, source, href) with uri, target, exists, anchored: does the file exist, and the anchor in it."""
    u = links_.withColumn("uri", uris.parse(F.col("href"))).withColumn("path", uris.decode(F.col("uri.path"))).withColumn("fragment", uris.decode(F.col("uri.fragment")))
    target = F.when(F.col("path") == "", F.col("source")).otherwise(paths.join(paths.dirname(F.col("source")), F.col("path")))
    t = u.withColumn("target", target)
    there = files.select("book_id", F.col("path").alias("target"), F.lit(True).alias("_there")).distinct()
    held = anchors_.select("book_id", F.col("path").alias("target"), F.col("anchor").alias("fragment"), F.lit(True).alias("_held")).distinct()
    both = t.join(there, ["book_id", "target"], "left").join(held, ["book_id", "target", "fragment"], "left")
    return both.withColumn("exists", F.col("_there").isNotNull()).withColumn("anchored", (F.col("fragment") == "") | F.col("_held").isNotNull()).drop("_there", "_held")


def link_decisions(links_: DataFrame, files: DataFrame, anchors_: DataFrame) -> DataFrame:
    """(book_id, link_id, source, href, decision, candidates, new_href): valid, external, repaired or removed.

    A broken link goes to the one file that has its name and, with a fragment, the anchor; where no file has
    both, to the one file that owns the anchor.
    """
    r = resolve(links_, files, anchors_)
    broken = ~F.col("uri.external") & ~(F.col("exists") & F.col("anchored"))
    state = F.when(F.col("uri.external"), "external").when(F.col("exists") & F.col("anchored"), "valid")
    r = r.withColumn("name", F.when(F.col("path") != "", paths.basename(F.col("path")))).withColumn("broken", broken).withColumn("state", state)
    keys = ["book_id", "name", "fragment"]
    asked = r.where("broken").select(keys).distinct()
    owners = files.select("book_id", "path", paths.basename(F.col("path")).alias("name")).distinct()
    named = asked.join(owners, ["book_id", "name"]).select(*keys, "path", F.lit(1).alias("by_name"), F.lit(0).alias("by_anchor"))
    owning = asked.where("fragment <> ''").join(anchors_.select("book_id", "path", F.col("anchor").alias("fragment")).distinct(), ["book_id", "fragment"]).select(*keys, "path", F.lit(0).alias("by_name"), F.lit(1).alias("by_anchor"))
    each = named.unionByName(owning).groupBy(*keys, "path").agg(F.max("by_name").alias("by_name"), F.max("by_anchor").alias("by_anchor"))
    # counts and one path are enough to tell "exactly one": no list of candidates is gathered
    both = (F.col("by_name") == 1) & ((F.col("fragment") == "") | (F.col("by_anchor") == 1))
    fit = each.groupBy(keys).agg(
        F.sum(both.cast("bigint")).alias("n_both"), F.min(F.when(both, F.col("path"))).alias("one_both"),
        F.sum("by_anchor").alias("n_anchor"), F.min(F.when(F.col("by_anchor") == 1, F.col("path"))).alias("one_anchor"),
    )
    on = (r.book_id == fit.book_id) & r.name.eqNullSafe(fit.name) & (r.fragment == fit.fragment) & r.broken
    d = r.join(fit, on, "left").select(r["*"], "n_both", "one_both", "n_anchor", "one_anchor")
    wide = (F.col("fragment") != "") & (F.coalesce("n_both", F.lit(0)) == 0)
    n = F.when(F.col("broken"), F.coalesce(F.when(wide, F.col("n_anchor")).otherwise(F.col("n_both")), F.lit(0)))
    one = F.when(wide, F.col("one_anchor")).otherwise(F.col("one_both"))
    decision = F.coalesce("state", F.when(n == 1, "repaired").when(n == 0, "removed: no candidate").otherwise("removed: ambiguous"))
    new = F.when(F.col("broken") & (n == 1), uris.with_path(F.col("uri"), paths.relative(F.col("source"), one))).when(~F.col("broken"), F.col("href"))
    return d.select("book_id", "link_id", "source", "href", decision.alias("decision"), n.alias("candidates"), new.alias("new_href"))


def link_issues(links_: DataFrame, files: DataFrame, anchors_: DataFrame) -> DataFrame:
    """(book_id, link_id, severity, code, message) of links that validation complains of."""
    r = resolve(links_, files, anchors_).where(F.col("href") != "")
    html = paths.extension(F.col("target")).isin("html", "htm", "xhtml")
    skip = F.col("uri.external") | (F.col("uri.path") == "")
    code = (
        F.when(uris.dangerous(F.col("uri")), "unsafe-link-scheme").when(skip, None).when(F.col("target").isNull(), "unsafe-link-target")
        .when(~F.col("exists"), "missing-link-target").when((F.col("uri.fragment") != "") & html & ~F.col("anchored"), "missing-link-anchor")
    )
    told = F.create_map(*[F.lit(x) for x in ("unsafe-link-scheme", "Unsafe link scheme found: ", "unsafe-link-target", "Link target escapes the EPUB root: ", "missing-link-target", "Link target is missing: ", "missing-link-anchor", "Link anchor is missing: ")])
    return r.withColumn("code", code).where("code is not null").select("book_id", "link_id", F.when(F.col("code").startswith("unsafe"), "error").otherwise("warning").alias("severity"), "code", F.concat(told[F.col("code")], "href").alias("message"))


def play_order(points: DataFrame, by: list[str], target: str, order: str) -> DataFrame:
    """Numbers by first appearance: equal targets share one, an empty target always has its own."""
    key = F.when(F.col(target) == "", F.concat(F.lit("missing:"), F.col(order))).otherwise(F.concat(F.lit("src:"), F.col(target)))
    first = F.min(order).over(Window.partitionBy(*by, "_key"))
    return points.withColumn("_key", key).withColumn("_first", first).withColumn("play_order", F.dense_rank().over(Window.partitionBy(*by).orderBy("_first"))).drop("_key", "_first")

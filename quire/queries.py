"""Registered queries over the driver's tables, each with the SQL that says the same where SQL can."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire import cases, corpus
from quire.corpus import spread, table
from quire.functions import paths, shapes, uris
from quire.operators import classify, findings, rewrite, tables
from quire.plans import normalize as plan
from quire.ship import ship
from quire.sources import archives

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

# Pieces of SQL that several oracles share. ----------------------------------------------------------
HREFS = """hrefs AS (SELECT page_id, i - 1 AS pos, hs[i] AS href FROM (SELECT page_id, regexp_extract_all(html, '<a [^>]*href="([^"]*)"', 1) AS hs FROM pages), LATERAL (SELECT unnest(range(1, len(hs) + 1)) AS i))"""
URLS = r"""urls AS (SELECT page_id, regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS site, trim(regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1), '/') AS path,
  regexp_extract(url, '\?([^#]*)', 1) AS query, regexp_extract(url, '#(.*)$', 1) AS fragment FROM pages)"""
LINES = r"""lines AS (SELECT doc_id, i - 1 AS line_ix, ls[i] AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents), LATERAL (SELECT unnest(range(1, len(ls) + 1)) AS i) WHERE trim(ls[i]) <> '')"""
JOIN_SQL = """CASE WHEN {href} LIKE '/%' THEN NULL ELSE list_reduce(list_prepend(CAST('' AS VARCHAR), string_split({dir} || '/' || {href}, '/')), lambda a, x:
  CASE WHEN a IS NULL OR a = '!' THEN '!' WHEN x IN ('', '.') THEN a WHEN x = '..' THEN CASE WHEN a = '' THEN '!' ELSE regexp_replace(a, '/?[^/]*$', '') END WHEN a = '' THEN x ELSE a || '/' || x END) END"""


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


# Links and paths. -----------------------------------------------------------------------------------
@query(f"WITH {HREFS} SELECT page_id, pos, href FROM hrefs")
def page_links(spark, sf):
    return corpus.hrefs(table(spark, sf, "pages"))


VARIED = "CASE pos % 6 WHEN 0 THEN ' javascript:x(' || href || ')' WHEN 1 THEN 'mailto:a@b' || href WHEN 2 THEN '//cdn' || href WHEN 3 THEN '#' || href WHEN 4 THEN substr(href, 2) || '?q=1#t' ELSE href END"


@query(rf"""WITH {HREFS}, v AS (SELECT page_id, pos, {VARIED} AS raw FROM hrefs),
p AS (SELECT *, regexp_replace(raw, '^[\x00-\x20]+', '') AS flat FROM v),
q AS (SELECT *, regexp_extract(flat, '^([^#?]*)', 1) AS path, regexp_extract(flat, '^[^#?]*\?([^#]*)', 1) AS query, regexp_extract(flat, '^[^#]*#(.*)$', 1) AS fragment FROM p),
s AS (SELECT *, lower(regexp_extract(path, '^([A-Za-z][A-Za-z0-9+.-]*):', 1)) AS scheme FROM q)
SELECT page_id, pos, path, query, fragment, scheme, (scheme <> '' OR path LIKE '//%') AS external,
 CASE WHEN scheme IN ('javascript', 'data', 'vbscript', 'file') THEN 'dangerous' WHEN scheme <> '' OR path LIKE '//%' THEN 'external'
      WHEN path = '' THEN CASE WHEN fragment = '' THEN 'empty' ELSE 'same-document' END WHEN path LIKE '/%' THEN 'absolute' ELSE 'local' END AS kind FROM s""")
def link_kinds(spark, sf):
    v = corpus.hrefs(table(spark, sf, "pages")).withColumn("u", uris.parse(F.expr(VARIED)))
    return v.select("page_id", "pos", "u.path", "u.query", "u.fragment", "u.scheme", "u.external", uris.kind(F.col("u")).alias("kind"))


@query(f"WITH {HREFS} SELECT page_id, count(*) AS n_links, count(*) FILTER (pos % 6 = 0) AS n_unsafe FROM hrefs GROUP BY page_id")
def unsafe_links(spark, sf):
    v = corpus.hrefs(table(spark, sf, "pages")).withColumn("u", uris.parse(F.expr(VARIED)))
    return v.groupBy("page_id").agg(F.count("*").alias("n_links"), F.count_if(uris.dangerous(F.col("u"))).alias("n_unsafe"))


@query(f"WITH {URLS} SELECT * FROM urls")
def url_parts(spark, sf):
    return corpus.url_parts(table(spark, sf, "pages"))


@query(rf"""WITH {URLS} SELECT page_id, CASE WHEN path LIKE '%/%' THEN regexp_replace(path, '/[^/]*$', '') ELSE '' END AS dir, regexp_extract(path, '([^/]*)$', 1) AS base,
  lower(regexp_extract(path, '[^/]\.([^./]*)$', 1)) AS ext FROM urls""")
def url_dir_base_ext(spark, sf):
    p = F.col("path")
    return corpus.url_parts(table(spark, sf, "pages")).select("page_id", paths.dirname(p).alias("dir"), paths.basename(p).alias("base"), paths.extension(p).alias("ext"))


STEPS = "repeat('../', CAST(pos % 4 AS INT)) || substr(href, 2) || '/./x'"


@query(f"WITH {HREFS}, {URLS}, j AS (SELECT page_id, pos, path AS dir, {STEPS} AS href FROM hrefs JOIN urls USING (page_id)), r AS (SELECT page_id, pos, {JOIN_SQL.format(dir='dir', href='href')} AS t FROM j) SELECT page_id, pos, CASE WHEN t LIKE '!%' THEN NULL ELSE t END AS target FROM r")
def path_join_resolve(spark, sf):
    pages = table(spark, sf, "pages")
    j = corpus.hrefs(pages).join(corpus.url_parts(pages).select("page_id", "path"), "page_id")
    return j.select("page_id", "pos", paths.join(F.col("path"), F.expr(STEPS)).alias("target"))


@query(rf"""WITH {URLS}, n AS (SELECT a.page_id, a.path AS a, b.path AS b FROM urls a JOIN urls b ON b.page_id = a.page_id + 1),
k AS (SELECT *, list_filter(string_split(CASE WHEN a LIKE '%/%' THEN regexp_replace(a, '/[^/]*$', '') ELSE '' END, '/'), lambda x: x <> '') AS h, list_filter(string_split(b, '/'), lambda x: x <> '') AS t FROM n),
c AS (SELECT *, len(list_filter(range(1, least(len(h), len(t)) + 1), lambda i: h[:i] = t[:i])) AS c FROM k)
SELECT page_id, CASE WHEN len(h) = c AND len(t) = c THEN '.' ELSE array_to_string(list_concat(list_transform(range(len(h) - c), lambda i: '..'), t[c + 1:]), '/') END AS way FROM c""")
def path_relative(spark, sf):
    u = corpus.url_parts(table(spark, sf, "pages")).select("page_id", "path")
    n = u.join(u.select((F.col("page_id") - 1).alias("page_id"), F.col("path").alias("next")), "page_id")
    return n.select("page_id", paths.relative(F.col("path"), F.col("next")).alias("way"))


NAMES = "CASE page_id % 5 WHEN 0 THEN '/' || path WHEN 1 THEN 'c:' || path WHEN 2 THEN path || '/../x' WHEN 3 THEN replace(path, '/', chr(92)) ELSE './' || path || '//y' END"


@query(rf"""WITH {URLS}, n AS (SELECT page_id, {NAMES} AS name FROM urls), s AS (SELECT *, replace(name, chr(92), '/') AS f FROM n),
e AS (SELECT *, CASE WHEN f LIKE '/%' THEN 'absolute path' WHEN string_split(f, '/')[1] LIKE '%:%' THEN 'drive prefix' WHEN list_contains(string_split(f, '/'), '..') THEN 'parent segment' END AS error FROM s)
SELECT page_id, error, CASE WHEN error IS NULL THEN array_to_string(list_filter(string_split(f, '/'), lambda x: x NOT IN ('', '.')), '/') END AS entry FROM e""")
def entry_name_check(spark, sf):
    n = corpus.url_parts(table(spark, sf, "pages")).withColumn("name", F.expr(NAMES))
    return n.select("page_id", paths.entry_error(F.col("name")).alias("error"), paths.entry_name(F.col("name")).alias("entry"))


@query(r"""SELECT page_id, CASE WHEN stem = '' THEN 'optimized' ELSE stem || '-optimized' END || '.' || ext AS output FROM (
  SELECT page_id, regexp_replace(regexp_replace(n, '\.(?i:epub)$', ''), '(?i:-optimized)$', '') AS stem, CASE WHEN lower(n) LIKE '%.epub' THEN right(n, 4) ELSE 'epub' END AS ext
  FROM (SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'b' || page_id || '-Optimized.EPUB' WHEN 1 THEN 'b' || page_id || '.epub' ELSE '.epub' END AS n FROM pages))""")
def output_names(spark, sf):
    n = F.expr("CASE page_id % 3 WHEN 0 THEN 'b' || page_id || '-Optimized.EPUB' WHEN 1 THEN 'b' || page_id || '.epub' ELSE '.epub' END")
    return table(spark, sf, "pages").select("page_id", paths.optimized_filename(n).alias("output"))


@query(f"WITH {HREFS} SELECT page_id, pos, replace(replace(url_encode(href || ' +~'), '%2F', '/'), '%7E', '~') AS encoded, href || ' +~' AS back FROM hrefs")
def percent_round_trip(spark, sf):
    h = corpus.hrefs(table(spark, sf, "pages")).withColumn("encoded", uris.encode(F.concat("href", F.lit(" +~"))))
    return h.select("page_id", "pos", "encoded", uris.decode(F.col("encoded")).alias("back"))


# The flagship: link resolution over books made of pages. --------------------------------------------
LINKED = rf"""{URLS}, u AS (SELECT page_id // 64 AS book_id, * FROM urls WHERE path <> ''), files AS (SELECT DISTINCT book_id, path FROM u), anchors AS (SELECT DISTINCT book_id, path, fragment AS anchor FROM u WHERE fragment <> ''),
n AS (SELECT a.book_id, a.page_id AS link_id, a.path AS source, b.path AS nxt, b.fragment AS f FROM u a JOIN u b ON b.book_id = a.book_id AND b.page_id = a.page_id + 1),
l AS (SELECT book_id, link_id, source, string_split(source, '/')[:-2] AS dirs, CASE link_id % 3 WHEN 0 THEN nxt WHEN 1 THEN 'old/' || regexp_extract(nxt, '([^/]*)$', 1) ELSE 'old/x' || regexp_extract(nxt, '([^/]*)$', 1) END AS target, f AS fragment FROM n),
k AS (SELECT *, repeat('../', len(dirs)) || target || CASE WHEN fragment <> '' THEN '#' || fragment ELSE '' END AS href, regexp_extract(target, '([^/]*)$', 1) AS name,
  (book_id, target) IN (SELECT (book_id, path) FROM files) AS there, fragment = '' OR (book_id, target, fragment) IN (SELECT (book_id, path, anchor) FROM anchors) AS held FROM l),
c AS (SELECT k.*, list_sort(list(DISTINCT files.path) FILTER (files.path IS NOT NULL)) AS named FROM k LEFT JOIN files ON files.book_id = k.book_id AND regexp_extract(files.path, '([^/]*)$', 1) = k.name GROUP BY ALL),
o AS (SELECT c.*, list_sort(list(DISTINCT anchors.path) FILTER (anchors.path IS NOT NULL)) AS owners FROM c LEFT JOIN anchors ON c.fragment <> '' AND anchors.book_id = c.book_id AND anchors.anchor = c.fragment GROUP BY ALL),
d AS (SELECT *, there AND held AS ok, CASE WHEN fragment = '' THEN coalesce(named, []) WHEN len(list_intersect(coalesce(named, []), coalesce(owners, []))) > 0 THEN list_intersect(named, owners) ELSE coalesce(owners, []) END AS fit FROM o)"""
DECIDED = rf"""WITH {LINKED}, w AS (SELECT *, string_split(fit[1], '/') AS t, len(fit) AS n FROM d),
v AS (SELECT *, len(list_filter(range(1, least(len(dirs), len(t)) + 1), lambda i: dirs[:i] = t[:i])) AS common FROM w)
SELECT book_id, link_id, source, href, CASE WHEN ok THEN 'valid' WHEN n = 1 THEN 'repaired' WHEN n = 0 THEN 'removed: no candidate' ELSE 'removed: ambiguous' END AS decision, CASE WHEN ok THEN NULL ELSE n END AS candidates,
 CASE WHEN ok THEN href WHEN n = 1 THEN array_to_string(list_concat(list_transform(range(len(dirs) - common), lambda i: '..'), t[common + 1:]), '/') || CASE WHEN fragment <> '' THEN '#' || fragment ELSE '' END END AS new_href FROM v"""


@query(DECIDED)
def link_repair_decision(spark, sf):
    files, anchors, links = corpus.linked(table(spark, sf, "pages"))
    return tables.link_decisions(links, files, anchors)


@query(f"SELECT decision, count(*) AS n FROM ({DECIDED}) GROUP BY decision")
def link_repair_summary(spark, sf):
    return link_repair_decision(spark, sf).groupBy("decision").agg(F.count("*").alias("n"))


@query(rf"""WITH {LINKED} SELECT book_id, link_id, 'warning' AS severity, 'missing-link-target' AS code, 'Link target is missing: ' || href AS message FROM k WHERE NOT there
UNION ALL SELECT book_id, link_id, 'warning', 'missing-link-anchor', 'Link anchor is missing: ' || href FROM k WHERE there AND NOT held AND lower(regexp_extract(target, '[^/]\.([^./]*)$', 1)) IN ('html', 'htm', 'xhtml')""")
def link_issues(spark, sf):
    files, anchors, links = corpus.linked(table(spark, sf, "pages"))
    return tables.link_issues(links, files, anchors)


# Manifest, spine, navigation. -----------------------------------------------------------------------
@query(rf"""WITH {URLS}, m AS (SELECT page_id AS id, path AS href FROM urls WHERE page_id % 4 <> 3), f AS (SELECT DISTINCT path FROM urls WHERE page_id % 5 <> 4)
SELECT 'missing-manifest-file' AS code, 'Manifest file is missing: ' || href AS message FROM m WHERE href <> '' AND href NOT IN (SELECT path FROM f)
UNION ALL SELECT 'missing-spine-target', 'Spine references missing manifest item: ' || page_id FROM urls WHERE page_id NOT IN (SELECT id FROM m)""")
def package_issues(spark, sf):
    u = corpus.url_parts(table(spark, sf, "pages"))
    manifest, held = u.where("page_id % 4 <> 3").select(F.col("page_id").alias("id"), F.col("path").alias("href")), u.where("page_id % 5 <> 4").select(F.col("path").alias("href")).distinct()
    lost = manifest.where("href <> ''").join(held, "href", "left_anti").select(F.lit("missing-manifest-file").alias("code"), F.concat(F.lit("Manifest file is missing: "), "href").alias("message"))
    spine = u.select(F.col("page_id").alias("id")).join(manifest, "id", "left_anti")
    return lost.unionByName(spine.select(F.lit("missing-spine-target").alias("code"), F.concat(F.lit("Spine references missing manifest item: "), F.col("id").cast("string")).alias("message")))


@query(f"WITH {HREFS}, f AS (SELECT *, min(pos) OVER (PARTITION BY page_id, href) AS first FROM hrefs) SELECT page_id, pos, href, dense_rank() OVER (PARTITION BY page_id ORDER BY first) AS play_order FROM f")
def label_by_first_appearance(spark, sf):
    return tables.play_order(corpus.hrefs(table(spark, sf, "pages")), ["page_id"], "href", "pos").select("page_id", "pos", "href", F.col("play_order").cast("bigint").alias("play_order"))


@query(f"WITH {HREFS}, r AS (SELECT *, row_number() OVER (PARTITION BY page_id, href ORDER BY pos) AS k FROM hrefs) SELECT page_id, pos, CASE WHEN k = 1 THEN href ELSE href || '-' || k END AS new_id FROM r")
def duplicate_id_numbering(spark, sf):
    """Links of a page stand for its ids: they repeat within pages."""
    return tables.repeated_ids(corpus.hrefs(table(spark, sf, "pages")), ["page_id", "href"], "pos").select("page_id", "pos", "new_id")


TOKENS = r"list_filter(regexp_split_to_array(lower(path), '[^\p{L}\p{N}]+'), lambda x: x <> '')"


def _role_sql() -> str:
    out = []
    for role, names in classify.DOCUMENT_WORDS:
        listed = "[" + ", ".join(f"'{n}'" for n in names.split()) + "]"
        test = f"len(list_intersect(tok, {listed})) > 0"
        if names.startswith("cover"):
            test += " OR (list_contains(tok, 'title') AND NOT list_contains(tok, 'subtitle') AND NOT list_contains(tok, 'entitle'))"
        if role == "front":
            test += " OR len(list_filter(tok, lambda x: starts_with(x, 'acknowledg'))) > 0"
        if names in ("part del", "chapter chap kapitel"):
            test += f" OR len(list_filter(tok, lambda x: regexp_matches(x, '^({names.replace(' ', '|')})[0-9]'))) > 0"
        out.append(f"WHEN {test} THEN '{role}'")
    return f"CASE {' '.join(out)} WHEN lower(path) LIKE '%/ch%' THEN 'chapter' ELSE 'body' END"


PIECES = "CASE page_id % 9 WHEN 0 THEN path || '/cover' WHEN 1 THEN 'Text/chap' || page_id || '.xhtml' WHEN 2 THEN 'toc/' || path WHEN 3 THEN 'part2/' || path WHEN 4 THEN 'intro-' || path WHEN 5 THEN 'subtitle title ' || path WHEN 6 THEN 'x/ch' || path ELSE path END"


@query(rf"WITH {URLS}, p AS (SELECT page_id, {PIECES} AS path FROM urls), t AS (SELECT *, {TOKENS} AS tok FROM p) SELECT page_id, {_role_sql()} AS role FROM t")
def doc_role_from_url(spark, sf):
    p = corpus.url_parts(table(spark, sf, "pages")).select("page_id", F.expr(PIECES).alias("path"))
    tok = F.filter(F.split(F.lower("path"), r"[^\p{L}\p{N}]+"), lambda x: x != "")
    role = None
    for name, words in classify.DOCUMENT_WORDS:
        test = shapes.any_of(F.col("tok"), words.split())
        if words.startswith("cover"):
            test = test | (F.array_contains("tok", "title") & ~shapes.any_of(F.col("tok"), ["subtitle", "entitle"]))
        if name == "front":
            test = test | F.exists("tok", lambda x: F.startswith(x, F.lit("acknowledg")))
        if words in ("part del", "chapter chap kapitel"):
            pattern = rf"^(?:{words.replace(' ', '|')})\p{{N}}"
            test = test | F.exists("tok", lambda x: F.regexp_like(x, F.lit(pattern)))
        role = F.when(test, name) if role is None else role.when(test, name)
    return p.withColumn("tok", tok).select("page_id", role.when(F.contains(F.lower("path"), F.lit("/ch")), "chapter").otherwise("body").alias("role"))


# Markup and style. ----------------------------------------------------------------------------------
@query(r"""SELECT page_id, trim(regexp_replace(regexp_extract(html, '<title>([^<]*)</title>', 1), '\s+', ' ', 'g')) AS title FROM pages""")
def page_titles(spark, sf):
    return table(spark, sf, "pages").select("page_id", shapes.normalized(F.regexp_extract("html", "<title>([^<]*)</title>", 1)).alias("title"))


@query(r"""SELECT tag, count(*) AS n FROM (SELECT unnest(regexp_extract_all(html, '<([a-z][a-z0-9]*)[ >/]', 1)) AS tag FROM pages) GROUP BY tag""")
def tag_counts(spark, sf):
    return table(spark, sf, "pages").select(F.explode(F.regexp_extract_all("html", F.lit("<([a-z][a-z0-9]*)[ >/]"), F.lit(1))).alias("tag")).groupBy("tag").agg(F.count("*").alias("n"))


@query(r"""SELECT class, count(*) AS n, count(DISTINCT page_id) AS n_pages FROM (SELECT page_id, unnest(list_filter(string_split(lower(v), ' '), lambda x: x <> '')) AS class FROM (SELECT page_id, unnest(regexp_extract_all(html, ' class="([^"]*)"', 1)) AS v FROM pages)) GROUP BY class""")
def class_inventory(spark, sf):
    v = table(spark, sf, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit(' class="([^"]*)"'), F.lit(1))).alias("v"))
    return v.select("page_id", F.explode(shapes.classes(F.col("v"))).alias("class")).groupBy("class").agg(F.count("*").alias("n"), F.countDistinct("page_id").alias("n_pages"))


@query(r"""SELECT page_id, len(regexp_extract_all(html, '<style[^>]*>([^<]*)</style>', 1)) AS n, coalesce(array_to_string(regexp_extract_all(html, '<style[^>]*>([^<]*)</style>', 1), '|'), '') AS css FROM pages""")
def inline_style_blocks(spark, sf):
    css = F.regexp_extract_all("html", F.lit("<style[^>]*>([^<]*)</style>"), F.lit(1))
    return table(spark, sf, "pages").select("page_id", F.size(css).cast("bigint").alias("n"), F.array_join(css, "|").alias("css"))


CSS = "'.a' || (page_id % 7) || ' { text-align: ' || CASE page_id % 3 WHEN 0 THEN 'right' WHEN 1 THEN 'CENTER' ELSE 'left' END || '; } .b { color: red } .A' || (page_id % 5) || ' { Text-Align:center }'"


@query(rf"""WITH s AS (SELECT page_id % 10 AS book, page_id, {CSS} AS css FROM pages), r AS (SELECT book, page_id, i, lower(regexp_extract_all(css, '\.([A-Za-z_][A-Za-z0-9_-]*)[^{{}}]*\{{([^}}]*)\}}', 1)[i]) AS class, lower(regexp_extract_all(css, '\.([A-Za-z_][A-Za-z0-9_-]*)[^{{}}]*\{{([^}}]*)\}}', 2)[i]) AS body FROM s, (SELECT unnest(range(1, 4)) AS i)),
x AS (SELECT *, CASE WHEN regexp_matches(body, 'text-align\s*:\s*right') THEN 'eo-right' WHEN regexp_matches(body, 'text-align\s*:\s*center') THEN 'eo-centered' END AS role FROM r)
SELECT 'b' || book AS book_id, class, arg_max(role, page_id * 10 + i) AS role FROM x WHERE role IS NOT NULL GROUP BY ALL""")
def css_class_roles(spark, sf):
    s = table(spark, sf, "pages").select(F.concat(F.lit("b"), F.col("page_id") % 10).alias("book_id"), F.col("page_id").alias("sheet_ix"), F.expr(CSS).alias("css"))
    return archives.class_roles(s)


@query(f"SELECT page_id, unnest(['f/' || page_id || '.otf', 'img' || page_id || '.png']) AS target FROM pages")
def css_resource_urls(spark, sf):
    css = F.concat(F.lit('@font-face { src: url("f/'), "page_id", F.lit(".otf?x\") } a { background: URL( img"), "page_id", F.lit(".png ) } b { c: url(data:x) url('http://h/x') url(/root) url('') }"))
    return table(spark, sf, "pages").select("page_id", F.explode(archives.resource_urls(css)).alias("target"))


@query("SELECT page_id, page_id % 1000 + 1 AS width, page_id % 77 + 5 AS height FROM pages")
def image_headers(spark, sf):
    number = lambda c: F.lpad(F.hex(c), 8, "0")
    head = F.unhex(F.concat(F.lit("89504E470D0A1A0A0000000D49484452"), number(F.col("page_id") % 1000 + 1), number(F.col("page_id") % 77 + 5), F.lit("0806000000")))
    return table(spark, sf, "pages").select("page_id", archives.png_size(head).alias("s")).select("page_id", "s.width", "s.height")


# Text heuristics. -----------------------------------------------------------------------------------
N_WORDS = r"len(list_filter(regexp_split_to_array(line, '\s+'), lambda x: x <> ''))"
UPPER = r"(regexp_replace(line, '[^\p{L}]', '', 'g') <> '' AND regexp_replace(line, '[^\p{L}]', '', 'g') = upper(regexp_replace(line, '[^\p{L}]', '', 'g')))"


@query(rf"""WITH {LINES} SELECT doc_id, line_ix, length(line) AS n_chars, {N_WORDS} AS n_words, length(line) <= 120 AND {N_WORDS} <= 14 AS short_heading, length(line) <= 90 AND {N_WORDS} <= 12 AS short_list,
 {UPPER} AS all_upper, {N_WORDS} BETWEEN 1 AND 4 AND length(line) <= 60 AND {UPPER} AS category FROM lines""")
def text_shape(spark, sf):
    c = F.col("line")
    return corpus.lines(table(spark, sf, "documents")).select("doc_id", "line_ix", F.char_length(c).cast("bigint").alias("n_chars"), F.size(shapes.words(c)).cast("bigint").alias("n_words"), shapes.short_heading(c).alias("short_heading"), shapes.short_list(c).alias("short_list"), shapes.all_upper(c).alias("all_upper"), shapes.category(c).alias("category"))


def _any(words: list[str]) -> str:
    return "(" + " OR ".join(f"contains(lower(line), '{w}')" for w in words) + ")"


META_SQL = rf"({_any(shapes.METADATA)} OR (contains(line, ':') AND length(line) <= 100) OR (length(line) <= 40 AND regexp_matches(line, '\p{{N}}') AND regexp_matches(line, '[-/.:]')))"
CHAPTER_SQL = f"(regexp_matches(lower(line), '^({'|'.join(shapes.CHAPTER_STARTS)})') OR lower(line) IN ({', '.join(repr(w) for w in shapes.CHAPTER_WORDS)}))"
CREDIT_SQL = f"(length(line) <= 80 AND (contains(lower(line), ' by') OR contains(lower(line), 'by ') OR contains(lower(line), ' from ') OR regexp_matches(lower(line), '^({'|'.join(shapes.CREDIT_STARTS)})')))"


@query(f"WITH {LINES} SELECT doc_id, line_ix, {META_SQL} AS metadata, {CHAPTER_SQL} AS chapterish, {_any(shapes.WORKS)} AS works, {CREDIT_SQL} AS credit FROM lines")
def line_predicates(spark, sf):
    c = F.col("line")
    return corpus.lines(table(spark, sf, "documents")).select("doc_id", "line_ix", shapes.metadata_line(c).alias("metadata"), shapes.chapterish(c).alias("chapterish"), shapes.works_heading(c).alias("works"), shapes.credit_label(F.lower(c)).alias("credit"))


@query(f"""WITH {LINES}, a AS (SELECT doc_id, count(*) AS n_lines, count(*) FILTER ({META_SQL}) AS hits, count(*) FILTER (length(line) <= 90) AS short, max(CASE WHEN regexp_matches(lower(line), 'epub|isbn|copyright|editor') THEN 1 ELSE 0 END) AS named FROM lines GROUP BY doc_id)
SELECT doc_id, n_lines, hits, n_lines BETWEEN 2 AND 14 AND ((hits >= 2 AND 2 * short >= n_lines) OR (hits >= 1 AND 4 * short >= 3 * n_lines AND named = 1)) AS is_metadata FROM a""")
def doc_refine_metadata(spark, sf):
    c = F.col("line")
    a = corpus.lines(table(spark, sf, "documents")).groupBy("doc_id").agg(F.count("*").alias("n_lines"), F.count_if(shapes.metadata_line(c)).alias("hits"), F.count_if(F.char_length(c) <= 90).alias("short"), F.max(F.lower(c).rlike("epub|isbn|copyright|editor")).alias("named"))
    n, hits, short = F.col("n_lines"), F.col("hits"), F.col("short")
    return a.select("doc_id", "n_lines", "hits", (n.between(2, 14) & (((hits >= 2) & (2 * short >= n)) | ((hits >= 1) & (4 * short >= 3 * n) & F.col("named")))).alias("is_metadata"))


@query(f"""WITH {LINES}, r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY line_ix) AS k FROM lines),
a AS (SELECT doc_id, count(*) AS n_lines, count(*) FILTER (k <= 80 AND length(line) <= 90 AND {N_WORDS} <= 12) AS short, count(*) FILTER (k <= 80 AND {CHAPTER_SQL}) AS chapters, arg_min(line, k) AS first_line FROM r GROUP BY doc_id)
SELECT doc_id, short, chapters, n_lines >= 5 AND lower(trim(first_line)) IN ('contents', 'innehall', 'innehåll', 'table of contents') AND 10 * short >= 8 * least(n_lines, 80) AND chapters >= 3 AS is_contents FROM a""")
def doc_refine_contents(spark, sf):
    w, c, k = Window.partitionBy("doc_id").orderBy("line_ix"), F.col("line"), F.col("k")
    a = corpus.lines(table(spark, sf, "documents")).withColumn("k", F.row_number().over(w)).groupBy("doc_id").agg(F.count("*").alias("n_lines"), F.count_if((k <= 80) & shapes.short_list(c)).alias("short"), F.count_if((k <= 80) & shapes.chapterish(c)).alias("chapters"), F.min_by("line", "k").alias("first_line"))
    return a.select("doc_id", "short", "chapters", ((F.col("n_lines") >= 5) & F.lower(F.trim("first_line")).isin(*classify.CONTENTS_HEADINGS) & (10 * F.col("short") >= 8 * F.least("n_lines", F.lit(80))) & (F.col("chapters") >= 3)).alias("is_contents"))


def _tenths(unit: int) -> str:
    """Of n units with one decimal, ties to even, in integers."""
    t = f"(n * 10 // {unit} + CASE WHEN n * 10 % {unit} * 2 > {unit} OR (n * 10 % {unit} * 2 = {unit} AND n * 10 // {unit} % 2 = 1) THEN 1 ELSE 0 END)"
    return f"({t} // 10) || '.' || ({t} % 10)"


@query(f"SELECT doc_id, CASE WHEN n < 1024 THEN n || ' B' WHEN n < 1048576 THEN {_tenths(1024)} || ' KB' ELSE {_tenths(1048576)} || ' MB' END AS size FROM (SELECT doc_id, n_chars * (1 + doc_id % 3 * 500) + 1 AS n FROM documents)")
def human_size(spark, sf):
    return table(spark, sf, "documents").select("doc_id", shapes.human_size(F.col("n_chars") * (1 + F.col("doc_id") % 3 * 500) + 1).alias("size"))


# Findings. ------------------------------------------------------------------------------------------
@query("""WITH a AS (SELECT lang AS code, source AS path, count(*) AS a FROM documents WHERE doc_id % 2 = 0 GROUP BY ALL), b AS (SELECT lang AS code, source AS path, count(*) AS b FROM documents WHERE doc_id % 2 = 1 GROUP BY ALL)
SELECT coalesce(a.code, b.code) AS code, coalesce(a.path, b.path) AS path, least(coalesce(a, 0), coalesce(b, 0)) AS persisting, greatest(coalesce(a, 0) - coalesce(b, 0), 0) AS resolved, greatest(coalesce(b, 0) - coalesce(a, 0), 0) AS introduced FROM a FULL JOIN b ON a.code IS NOT DISTINCT FROM b.code AND a.path IS NOT DISTINCT FROM b.path""")
def finding_multiset_diff(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.col("lang").alias("code"), F.col("source").alias("path"))
    return findings.multiset_diff(d.where("doc_id % 2 = 0"), d.where("doc_id % 2 = 1"), ["code", "path"])


@query("SELECT lang AS code, text AS message, count(*) AS n, array_to_string(list_sort(list(DISTINCT source)), ', ') AS paths FROM documents GROUP BY ALL")
def findings_grouped(spark, sf):
    d = table(spark, sf, "documents").select(F.col("lang").alias("code"), F.col("text").alias("message"), F.col("source").alias("path"))
    return findings.grouped(d)


@query("""WITH d AS (SELECT doc_id, lang, source, n_chars, CAST(doc_id % 3 AS INT) AS more FROM documents)
SELECT 'd' || doc_id AS book_id, 'input' AS phase, CASE WHEN doc_id % 2 = 0 THEN 'error' ELSE 'warning' END AS severity, lang AS code, 'n ' || n_chars AS message, CASE WHEN k = 0 THEN source END AS path, CASE WHEN k = 0 THEN doc_id END AS line, NULL::BIGINT AS "column" FROM d, LATERAL (SELECT unnest(range(0, more + 1)) AS k)""")
def checker_json_explode(spark, sf):
    message = F.struct(
        F.col("lang").alias("ID"), F.when(F.col("doc_id") % 2 == 0, "ERROR").otherwise("Warning").alias("severity"), F.concat(F.lit("n "), "n_chars").alias("message"), (F.col("doc_id") % 3).alias("additionalLocations"),
        F.array(F.struct(F.col("source").alias("path"), F.col("doc_id").alias("line"))).alias("locations"),
    )
    reports = table(spark, sf, "documents").select(F.concat(F.lit("d"), "doc_id").alias("book_id"), F.lit("input").alias("phase"), F.to_json(F.struct(F.array(message).alias("messages"))).alias("report"))
    return findings.report_rows(reports)


# Whole-document and whole-book workers. -------------------------------------------------------------
@query()
def node_table(spark, sf):
    n = tables.nodes(table(spark, sf, "pages").repartition("page_id"))
    return n.groupBy(F.col("doc_id").alias("page_id"), "kind").agg(F.count("*").alias("n"), F.max("depth").alias("depth"))


@query()
def paragraph_texts(spark, sf):
    return tables.contents(tables.nodes(table(spark, sf, "pages").repartition("page_id")), "p").select(F.col("doc_id").alias("page_id"), "node_ix", F.char_length("content").alias("n_chars"))


@query()
def phrase_runs(spark, sf):
    return tables.phrase_runs(tables.nodes(table(spark, sf, "pages").repartition("page_id"))).withColumnRenamed("doc_id", "page_id")


def _pages_done(spark: SparkSession, sf: str, one, schema: str, types: list[pa.DataType]) -> DataFrame:
    def run(batches):
        for batch in batches:
            rows = [one(i, html or "") for i, html in zip(batch.column("page_id").to_pylist(), batch.column("html").to_pylist())]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names=[x.split()[0] for x in schema.split(", ")])

    # parsing is heavy in CPU and the table may be one row group
    return spread(table(ship(spark), sf, "pages").select("page_id", "html"), "page_id").mapInArrow(run, schema)


@query("SELECT page_id, true AS text_kept, true AS settled FROM pages")
def normalize_pages(spark, sf):
    """Each page rewritten: its text is kept and a second pass changes nothing."""
    from quire.markup import parse

    def one(i, html):
        # what is parsed is read before the steps work on it, so each text is parsed once
        doc = parse(html)
        if doc is None:
            return i, None, None
        before = doc.root.content(without="style")
        out = rewrite.rewritten(doc)
        again = parse(out)
        if again is None:
            return i, None, None
        after = again.root.content()
        return i, "".join(before.split()) == "".join(after.split()), rewrite.rewritten(again) == out

    return _pages_done(spark, sf, one, "page_id bigint, text_kept boolean, settled boolean", [pa.int64(), pa.bool_(), pa.bool_()])


@query()
def classify_blocks(spark, sf):
    from quire.markup import parse

    def one(i, html):
        doc = parse(html)
        if doc is None:
            return i, None, []
        role = classify.refine(doc.root, "body")
        classify.classify(doc.root, role)
        return i, role, [n.get("class") for n in doc.root.elements() if n.get("class").startswith("eo-")]

    d = _pages_done(spark, sf, one, "page_id bigint, document_role string, roles array<string>", [pa.int64(), pa.string(), pa.list_(pa.string())])
    return d.select("document_role", F.explode("roles").alias("role")).groupBy("document_role", "role").agg(F.count("*").alias("n"))


def books(spark: SparkSession, sf: str, per_book: int = 16) -> DataFrame:
    """Archives made of pages: per_book pages each, with a sheet, a font, a spine and links between them."""
    pages = table(ship(spark), sf, "pages").select((F.col("page_id") / per_book).cast("bigint").alias("b"), "page_id", "html")

    def build(t: pa.Table) -> pa.Table:
        b = t.column("b")[0].as_py()
        rows = sorted(zip(t.column("page_id").to_pylist(), t.column("html").to_pylist()))
        item = '<item id="p{0}" href="Text/p{0}.xhtml" media-type="application/xhtml+xml"/>'
        files = {"mimetype": b"application/epub+zip", "META-INF/container.xml": f'<container xmlns="urn:oasis:names:tc:opendocument:xmlns:container"><rootfiles><rootfile full-path="OEBPS/book.opf"/></rootfiles></container>'.encode()}
        for k, (i, html) in enumerate(rows):
            nxt = rows[(k + 1) % len(rows)][0]
            link = f'<p><a href="{["p", "../p", "lost/q"][i % 3]}{nxt}.xhtml">next</a></p>'
            files[f"OEBPS/Text/p{i}.xhtml"] = (html or "").replace("<body>", f"<body>{link}", 1).encode()
        extra = '<item id="css" href="Styles/a.css" media-type="text/css"/><item id="font" href="Fonts/f.otf" media-type="font/otf"/>'
        files |= {"OEBPS/Styles/a.css": b".r { text-align: right }", "OEBPS/Fonts/f.otf": b"OTTO"}
        opf = f'<package xmlns="http://www.idpf.org/2007/opf" version="3.0" unique-identifier="id"><metadata xmlns:dc="http://purl.org/dc/elements/1.1/"><dc:identifier id="id">b{b}</dc:identifier></metadata><manifest>{"".join(item.format(i) for i, _ in rows)}{extra}</manifest><spine>{"".join(f"<itemref idref=\"p{i}\"/>" for i, _ in rows)}</spine></package>'
        files["OEBPS/book.opf"] = opf.encode()
        return pa.table({"book_id": [f"b{b}.epub"], "content": pa.array([archives.pack(files)], pa.binary())})

    return spread(pages, "b").groupBy("b").applyInArrow(build, "book_id string, content binary")


#: The pages of the books below, with the links that lead out of the book's root and those whose target is not there.
IN_BOOKS = "b AS (SELECT 'b' || page_id // 16 || '.epub' AS book_id, count(*) AS n, sum(len(regexp_extract_all(html, '(?:href|src)=\"/[^\"]*\"')))::BIGINT AS out, count(*) FILTER (page_id % 3 <> 0) AS lost FROM pages GROUP BY 1)"


# five files besides the pages
@query(f"WITH {IN_BOOKS} SELECT book_id, n + 5 AS n_files, true AS same FROM b")
def archive_round_trip(spark, sf):
    """Books exploded, packed again and exploded: the same files."""
    made = books(spark, sf)
    first = archives.files(archives.entries(made))
    again = archives.files(archives.entries(archives.packed(first)))
    digest = lambda d, name: d.groupBy("book_id").agg(F.count("*").alias(f"n_{name}"), F.sum(F.pmod(F.xxhash64("path", "bytes"), F.lit(1 << 40))).alias(f"h_{name}"))
    return digest(first, "a").join(digest(again, "b"), "book_id").select("book_id", F.col("n_a").alias("n_files"), ((F.col("n_a") == F.col("n_b")) & (F.col("h_a") == F.col("h_b"))).alias("same"))


@query(f"WITH {IN_BOOKS} SELECT book_id, 'unavailable' AS outcome, n AS content_documents, 2 AS removed_items, true AS nav_added, out + lost AS n_actions, 0 AS n_warnings, CAST(NULL AS VARCHAR) AS error FROM b")
def normalize_books(spark, sf):
    return plan.normalize(books(spark, sf)).select("book_id", "outcome", "content_documents", "removed_items", "nav_added", F.size("actions").alias("n_actions"), F.size("warnings").alias("n_warnings"), "error")


@query(f"""WITH {IN_BOOKS} SELECT book_id, book_id AS input_filename, '3.0' AS epub_version, 'OEBPS/book.opf' AS package_path, n AS content_documents, 2 AS stylesheets_and_fonts, 2 AS removable_files, 0 AS images_preserved, true AS would_write_canonical_css, 0 AS n_diagnostics,
 'Would normalize ' || n || ' content document(s). Would replace 2 stylesheet/font manifest item(s). Would delete 2 old style/font file(s). Would preserve 0 image resource(s) without recompression. Would write the canonical stylesheet.' AS summary, 0 AS n_warnings, CAST(NULL AS VARCHAR) AS error FROM b""")
def preview_books(spark, sf):
    p = plan.preview(books(spark, sf))
    more = {"n_diagnostics": F.size("image_diagnostics"), "summary": F.array_join("change_summary", " "), "n_warnings": F.size("warnings")}
    return p.withColumns(more).drop("image_diagnostics", "change_summary", "warnings")


@query(f"WITH {IN_BOOKS} SELECT book_id, 'warning' AS severity, 'missing-link-target' AS code, lost AS n FROM b WHERE lost > 0 UNION ALL SELECT book_id, 'error', 'unsafe-link-target', out FROM b WHERE out > 0")
def validate_books(spark, sf):
    return plan.validate(books(spark, sf)).groupBy("book_id", "severity", "code").agg(F.count("*").alias("n"))


@query(f"WITH {URLS} SELECT site, count(*) AS n_pages, count(DISTINCT path) AS n_paths, sum(CASE WHEN fragment <> '' THEN 1 ELSE 0 END)::BIGINT AS n_anchored, sum(len(regexp_extract_all(html, '<a [^>]*href=')))::BIGINT AS n_links FROM urls JOIN pages USING (page_id) GROUP BY site")
def corpus_preview(spark, sf):
    pages = table(spark, sf, "pages")
    n = pages.select("page_id", F.regexp_count("html", F.lit("<a [^>]*href=")).alias("n"))
    return corpus.url_parts(pages).join(n, "page_id").groupBy("site").agg(F.count("*").alias("n_pages"), F.countDistinct("path").alias("n_paths"), F.count_if(F.col("fragment") != "").alias("n_anchored"), F.sum("n").alias("n_links"))


for _name, (_query, _oracle) in cases.QUERIES.items():
    QUERIES[_name], ORACLES[_name] = _query, _oracle


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)

import pytest
from pyspark.sql import functions as F

from quire.functions import paths, shapes, uris


def values(spark, rows, column):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"i int, {', '.join(f'c{k} string' for k in range(len(rows[0])))}")
    return [r[0] for r in df.select(column.alias("v"), "i").orderBy("i").select("v").collect()]


def test_entry_names(spark):
    names = ["a/b.txt", "a\\b.txt", "./a//b", "../x", "/abs", "c:/x", "a/../b", ""]
    assert values(spark, [(n,) for n in names], paths.entry_name(F.col("c0"))) == ["a/b.txt", "a/b.txt", "a/b", None, None, None, None, ""]


def test_join_and_relative(spark):
    cases = [("Text", "../Img/a.png", "Img/a.png"), ("", "../x", None), ("a/b", "./c", "a/b/c"), ("a", "/x", None), ("a", "../../x", None)]
    assert values(spark, [c[:2] for c in cases], paths.join(F.col("c0"), F.col("c1"))) == [c[2] for c in cases]
    cases = [("Text/a.x", "Text/b.x", "b.x"), ("Text/a.x", "Img/c", "../Img/c"), ("a.x", "b/c", "b/c"), ("d/e/a.x", "d/e", "."), ("x/y/z", "q", "../../q")]
    assert values(spark, [c[:2] for c in cases], paths.relative(F.col("c0"), F.col("c1"))) == [c[2] for c in cases]


def test_extension_of_dotted_names(spark):
    assert values(spark, [("a/.hidden",), ("a.b/c",), ("x.TXT",), ("x.",), (".a.b",)], paths.extension(F.col("c0"))) == ["", "", "txt", "", "b"]


@pytest.mark.parametrize("href, kind", [(" javascript:x", "dangerous"), ("mailto:a", "external"), ("//h/x", "external"), ("#a", "same-document"), ("", "empty"), ("/x", "absolute"), ("a?b#c", "local"), (":x", "local"), ("java\nscript:x", "dangerous")])
def test_link_kinds(spark, href, kind):
    assert values(spark, [(href,)], uris.kind(uris.parse(F.col("c0")))) == [kind]


def test_percent_coding(spark):
    assert values(spark, [("a%20b+c",), ("%zz",), ("x%C4%87",), ("plain",), (None,)], uris.decode(F.col("c0"))) == ["a b+c", "%zz", "xć", "plain", None]
    assert values(spark, [("a b/ć~*+",)], uris.encode(F.col("c0"))) == ["a%20b/%C4%87~%2A%2B"]


def test_shapes(spark):
    assert values(spark, [("ABC",), ("Abc",), ("12",), ("中文",), ("ß",)], shapes.all_upper(F.col("c0"))) == [True, False, False, True, False]
    assert values(spark, [("a\u00a0 b\n",), ("a\x1cb",)], shapes.normalized(F.col("c0"))) == ["a b", "a\x1cb"]
    assert values(spark, [("Part 1",), ("partial",), ("Epilogue",)], shapes.chapterish(F.col("c0"))) == [True, False, True]
    assert values(spark, [("1023",), ("1024",), ("256",), ("1049088",)], shapes.human_size(F.col("c0").cast("bigint"))) == ["1023 B", "1.0 KB", "256 B", "1.0 MB"]
    assert values(spark, [("b A",), ("x",)], shapes.add_class(F.col("c0"), F.lit("x"))) == ["b A x", "x"]


def test_output_names(spark):
    assert values(spark, [("a-OPTIMIZED.EPUB",), ("x.txt",), (".epub",)], paths.optimized_filename(F.col("c0"))) == ["a-optimized.EPUB", "x.txt-optimized.epub", "optimized.epub"]

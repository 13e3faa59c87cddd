"""The pipeline against a plain version of its stages on the smallest tables."""

import hashlib

import corpus_pipeline
from quire.llm import decontaminate, langid
from quire.llm.queries import vocabulary
from tests.llm.test_dedup import plain_components

SF = "/root/testdata/sf0.001"


def test_run_equals_plain_stages(spark):
    from tokenizers import Tokenizer

    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    rows = [(i, t) for i, t in docs if any(c.isalpha() for c in t or "")]
    last = {}
    for i, t in rows:
        key = hashlib.sha256("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t).encode()).digest()
        last[key] = max(last.get(key, i), i)
    rows = [(i, t) for i, t in rows if i in set(last.values())]
    top = plain_components(rows, 5, 80)
    rows = [(i, t) for i, t in rows if top[i][2]]
    plain = lambda s: " ".join(s.lower().split())
    items = [plain(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    rows = [(i, t) for i, t in rows if not any(x in plain(t) for x in items)]
    tokenizer = Tokenizer.from_file(vocabulary())
    want = {i: tokenizer.encode(t, add_special_tokens=False).ids for i, t in rows}
    got = corpus_pipeline.run(spark, SF).collect()
    assert {r.doc_id: r.ids for r in got} == want and all(r.round_trip for r in got)


def test_stages_keep_the_columns_and_take_odd_rows(spark, odd, monkeypatch):
    docs = odd.select(corpus_pipeline.COLUMNS)
    monkeypatch.setattr(langid, "fit", lambda *a: langid.Model(["en"], langid.np.ones(langid.SIZE), langid.np.zeros((langid.SIZE, 1)), 1.0))
    for name, stage in corpus_pipeline.STAGES:
        for table in (docs, docs.limit(0)):
            out = stage(spark, table, SF)
            assert name == "bpe_tokens" or out.columns == corpus_pipeline.COLUMNS
            assert (out.count() > 0) == (table is docs)
    assert decontaminate.PERCENT == 6


def test_stages_keep_texts_with_letters_when_no_language_could_be_learned(spark, odd):
    docs = odd.select(corpus_pipeline.COLUMNS)
    kept = corpus_pipeline.known_language(spark, docs, SF)
    assert kept.columns == corpus_pipeline.COLUMNS
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["4", "5", "5", "6", "7", "None"]
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
        assert docs.count() > 0, name


def test_documents_of_no_known_language_are_labelled(docs, spark):
    rows = docs([(1, "some words"), (2, "123")]).withColumn("lang", langid_lit("sv", "doc_id = 1"))
    rows = rows.unionByName(docs([(3, "other words"), (4, None)]))
    model = langid.Model(["en"], langid.np.ones(langid.SIZE), langid.np.zeros((langid.SIZE, 1)), 1.0)
    kept = langid.keep_known(rows, model)
    assert kept.columns == rows.columns and {(r.doc_id, r.lang) for r in kept.collect()} == {(1, "sv"), (3, "en")}


def langid_lit(value, test):
    from pyspark.sql import functions as F

    return F.when(F.expr(test), F.lit(value))


def test_a_language_named_und_is_a_language(spark, docs):
    rows = docs([(1, "some words"), (2, "123"), (3, None)])
    model = langid.Model(["und"], langid.np.ones(langid.SIZE), langid.np.zeros((langid.SIZE, 1)), 1.0)
    assert [r.doc_id for r in langid.keep_known(rows, model).collect()] == [1]
    assert langid.keep_known(rows, model, ["en"]).count() == 0
    assert langid.keep_known(rows, langid.Model([], langid.np.ones(langid.SIZE), langid.np.zeros((langid.SIZE, 0)), 1.0), ["en"]).count() == 0

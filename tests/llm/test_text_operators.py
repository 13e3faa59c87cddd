"""PII, toxicity, secrets, BPE, language, URLs: each against a plain version, and the odd cases."""

import hashlib
import random
import re
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quire.llm import bpe, langid, pii, secrets, toxicity, urlfilter
from quire.llm.queries import vocabulary

SF = "/root/testdata/sf0.001"
BASE = {k: re.compile(v) for k, v in {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}.items()}
CUES = pii.automaton()


def plain_spans(text):
    def good(kind, s):
        digits = re.sub("[^0-9]", "", s)
        if kind == "ip":
            return all(int(p) <= 255 for p in s.split("."))
        if kind == "card":
            return 13 <= len(digits) <= 19 and sum(sum(divmod(int(c) * (1 + k % 2), 10)) for k, c in enumerate(digits[::-1])) % 10 == 0
        return kind == "email" or 9 <= len(digits) <= 15

    return {k: [m.span() for m in r.finditer(text) if good(k, m.group())] for k, r in BASE.items()}


@settings(max_examples=1500, deadline=None)
@given(st.text("0123456789..+@@-ab  ()é%_", max_size=60))
def test_base_spans_equal_the_patterns(text):
    found = pii.find(text, CUES)
    assert {k: found[k] for k in pii.BASE} == plain_spans(text)


def test_added_kinds_and_redaction(spark, docs):
    text = "IBAN DE89 3704 0044 0532 0130 00, call +1 (523) 555-1055, see https://me:pw@h.example/x, 12 Long Street now, card 4111 1111 1111 1111"
    found = pii.find(text, CUES)
    assert {k for k, v in found.items() if v} == {"account", "phone", "login", "card", "address", "email"}
    clean = pii.redact(docs([(1, text), (2, None)])).orderBy("doc_id").collect()
    assert "0532" not in clean[0].text and "[phone]" in clean[0].text and clean[1].text is None


@pytest.mark.parametrize("text", ["1" * 100_000, "1." * 50_000, "@" * 10_000, "a@" * 30_000, "+1 " * 30_000, " street" * 10_000])
def test_pii_is_linear(text):
    pii.find(text, CUES)


def test_pii_odd(odd, none):
    rows = {r.doc_id: r for r in pii.spans(odd).collect()}
    assert rows[1].spans == "" and rows[1].base_sha256 == hashlib.sha256(b"").hexdigest() and pii.spans(odd).count() == 10 and pii.spans(none).count() == 0


# BPE. -----------------------------------------------------------------------------------------------
def test_bpe_equals_the_library(spark):
    from tokenizers import Tokenizer

    t, c = Tokenizer.from_file(vocabulary()), bpe.Codec(vocabulary(), keep=500)
    rnd = random.Random(1)
    letters = "ab 's't\n\t\r\x1c\x85  　é1²Ⅳ½中١​_\x00\x0b'llreDON"
    texts = [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    texts += ["".join(rnd.choice(letters) for _ in range(rnd.randrange(30))) for _ in range(5000)]
    texts += ["a" * 20_000, " " * 999 + "x", "<|endoftext|>a<|endoftext|>", "ab" * 3000, "\U0001f600" * 50]
    for text in texts:
        want = t.encode(text, add_special_tokens=False).ids
        assert c.encode(text) == want and c.decode(want) == t.decode(want, skip_special_tokens=False)


def plain_merge(ranks, sym):
    while len(sym) > 1:
        low, i = min((ranks.get(p, (1 << 60, 0))[0], i) for i, p in enumerate(zip(sym, sym[1:])))
        if low == 1 << 60:
            break
        sym[i : i + 2] = [ranks[sym[i], sym[i + 1]][1]]
    return sym


def test_one_tree_serves_pieces_of_all_lengths(monkeypatch):
    c, rnd = bpe.Codec(vocabulary()), random.Random(2)
    ranks = {(int(k) >> 20, int(k) & (1 << 20) - 1): (int(r), int(c.merged[r])) for k, r in zip(c.keys, c.rank)}
    pieces = [bytes(rnd.choice(b"the and ion.\xc3") for _ in range(n)) for n in [*range(70), 200, 300] for _ in range(4)]
    met, trees = [], c.merge_trees
    monkeypatch.setattr(c, "merge_trees", lambda these, bits: met.extend(these) or trees(these, bits))
    assert c.merge(pieces) == [plain_merge(ranks, [int(c.first[x]) for x in p]) for p in pieces]
    assert sorted(met) == sorted(p for p in pieces if len(p) > 1)


def test_bpe_odd(odd, none):
    rows = {r.doc_id: r for r in bpe.token_digests(odd, vocabulary()).collect()}
    assert rows[1].n_tokens == 0 == rows[2].n_tokens and rows[1].ids_sha256 == hashlib.sha256(b"").hexdigest()
    got = {r.doc_id: r for r in bpe.encode_documents(odd, vocabulary()).collect()}
    assert len(got[6].ids) == rows[6].n_tokens and got[7].decoded == "\u0001\x00 é 中文 \U0001f600"
    assert bpe.token_digests(none, vocabulary()).count() == 0
    assert all(r.round_trip and r.n_tokens == len(r.ids) for r in bpe.token_rows(odd, vocabulary()).collect() if r.doc_id != 1)


# Language. ------------------------------------------------------------------------------------------
def test_language_accuracy_on_held_out_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = langid.predictions(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out and lang is not null").collect()
    assert len(rows) > 150 and sum(r.lang_pred == r.lang for r in rows) / len(rows) > 0.97
    assert all(0 <= r.score <= 1 for r in rows) and all(zlib.crc32(str(r.doc_id).encode()) % 5 == 0 for r in rows)


def test_every_language_is_learned_and_repeated_rows_stay_bounded(docs, spark, monkeypatch):
    rows = [(i * 1000 + k, f"{chr(0x4E00 + 40 * i)}{chr(0x4E01 + 40 * i)} " * 4, f"l{i}") for i in range(300) for k in range(2)] + [(7, "one text of a third of the rows", "l0")] * 300
    model = langid.fit(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"), per_language=5)
    assert len(model.langs) == 300


def test_language_odd(odd, none, docs, spark):
    assert {r.lang_pred for r in langid.predictions(odd).collect()} == {"und"} and langid.predictions(none).count() == 0
    rows = [(i, f"{a} {i}", lang) for i, (a, lang) in enumerate([("the cat and dog", "en"), ("der hund und katze", "de")] * 20)]
    model = langid.fit(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"))
    assert model.predict("the dog and the cat")[0] == "en" and model.predict("der und hund")[0] == "de" and model.predict("123 .")[0] == "und"
    kept = langid.keep_known(odd, model)
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["4", "5", "5", "6", "7", "None"] and kept.columns == odd.columns


# Toxicity. ------------------------------------------------------------------------------------------
def test_toxicity_on_held_out_rows(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    rows = toxicity.scores(docs, labels).join(labels, "doc_id").where("held_out").collect()
    hit = sum(r.predicted == r.toxic == 1 for r in rows)
    assert hit >= 0.6 * sum(r.toxic for r in rows) and hit >= 0.8 * sum(r.predicted for r in rows)


def test_toxicity_on_held_out_rows_of_the_larger_tables(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    rows = toxicity.scores(docs, labels).join(labels, "doc_id").where("held_out and toxic is not null").collect()
    hit = sum(r.predicted == r.toxic == 1 for r in rows)
    assert hit >= 0.9 * sum(r.toxic for r in rows) and hit >= 0.95 * sum(r.predicted for r in rows)


def test_label_model_finds_the_better_voter():
    import numpy as np

    rnd = np.random.default_rng(3)
    y = rnd.random(4000) < 0.3
    good, copy, poor = (np.where(y, rnd.random(4000) < a, rnd.random(4000) < b) for a, b in ((0.9, 0.02), (0.9, 0.02), (0.4, 0.3)))
    votes = np.stack([good, good & (rnd.random(4000) < 0.98), copy, poor], 1).astype(float)
    patterns, inverse, counts = np.unique(votes, axis=0, return_inverse=True, return_counts=True)
    labelled = np.stack([np.bincount(inverse.ravel()[:400], ~y[:400], len(patterns)), np.bincount(inverse.ravel()[:400], y[:400], len(patterns))], 1)
    m = toxicity.fit_label_model(patterns, counts.astype(float), labelled, 0.3)
    assert m.rates[1][0] > 0.8 > 0.6 > m.rates[1][3]
    assert m.parent[1] == 0 or m.parent[0] == 1
    lone = toxicity.fit_label_model(patterns[:, [0, 3]], counts.astype(float), labelled, 0.3)
    gain = lambda m, v: float(np.diff(m.log_odds(np.array([[0.0] * len(v), v])))[0] / m.scale)
    # what two correlated voters say together counts hardly more than what one says
    assert gain(m, [1, 1, 0, 0]) < 1.3 * gain(lone, [1, 0]) < 0.8 * (2 * gain(lone, [1, 0]))


def test_tree_of_voters_equals_enumeration():
    import itertools

    import numpy as np

    rnd = np.random.default_rng(4)
    m = toxicity.LabelModel(0.3, rnd.uniform(0.1, 0.9, (2, 4)), np.array([-1, 0, 1, 0]), rnd.uniform(0.1, 0.9, (2, 2, 4)))
    for v in itertools.product([0.0, 1.0], repeat=4):
        chance = []
        for c in (0, 1):
            p = m.prior if c else 1 - m.prior
            for j, up in enumerate(m.parent):
                q = m.rates[c, j] if up < 0 else m.given[c, int(v[up]), j]
                p *= q if v[j] else 1 - q
            chance.append(p)
        assert abs(m.with_silence(np.array([v]))[0] - np.log(chance[1] / chance[0])) < 1e-9
    near = toxicity.dependence(np.array([[0, 0, 0], [0, 0, 1], [1, 1, 0], [1, 1, 1]], float), np.ones((2, 4)))
    assert abs(near[0, 1] - np.log(2)) < 1e-9 and abs(near[0, 2]) < 1e-9
    assert sorted(toxicity.spanning(near).tolist()) == [-1, -1, 0]


def test_toxicity_odd(odd, none, spark):
    labels = spark.createDataFrame([(4, 1), (4, None), (6, 0), (None, 1)], "doc_id bigint, toxic int")
    for docs, known in ((odd, labels), (odd, labels.limit(0)), (none, labels)):
        rows = toxicity.scores(docs, known).collect()
        assert len(rows) == docs.count() and all(0 <= r.score <= 1 for r in rows)
    assert toxicity.fit(odd, labels.limit(0)).score("you idiot, you worthless scum") > 0.5


# Secrets. -------------------------------------------------------------------------------------------
def test_forest_on_findings_it_has_not_seen(spark):
    import json

    from pyspark.sql import functions as F

    forest = secrets.train(spark, secrets.labelled_findings())
    fresh = [dict(zip("clry", f)) for f in secrets.labelled_findings(600, seed=99)]
    df = spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(fresh)), "array<struct<c string, l string, r string, y int>>")))
    cols = secrets.features(F.col("c"), F.col("l"), F.col("r"))
    p = sum((t.expression(cols) for t in forest[1:]), forest[0].expression(cols)) / len(forest)
    rows = df.select("y", (p >= 0.5).cast("int").alias("p")).collect()
    assert sum(r.y == r.p for r in rows) / len(rows) > 0.93


def test_secrets_are_found_where_they_are(spark, docs):
    text = "é see token = \"24be64439e3e49cf46b2d7c90f3602a3d0b9aa11\" and commit 24be64439e3e49cf46b2d7c90f3602a3d0b9aa12 now"
    found = secrets.candidates(docs([(1, text), (2, text + text)])).collect()
    assert all((text + text)[r.start_char : r.end_char] == r.candidate for r in found) and len(found) == 6
    rows = {(r.doc_id, r.ordinal): r.is_secret for r in secrets.scan(docs([(1, text)])).collect()}
    assert rows == {(1, 1): True, (1, 2): False}


def test_candidates_of_any_length_case_and_cue_come_whole(docs):
    rnd = random.Random(16)
    pick = lambda chars, n: "".join(rnd.choice(chars) for _ in range(n))
    letters, symbols = "abcdefghijklmnopqrstuvwxyz", "!$%&*.;?"
    values = [(f"see {v} here", v) for v in (pick(letters, n) + "7" + pick(letters, 9) for n in (150, 201, 300, 5000))]
    for n in (20, 201, 5000):
        for left in ('password = "', "PASSWORD='", "Secret: ", 'bearer: "', "CREDENTIAL=", "auth='", "passwd=", 'private_key: "', 'API-KEY="', "SECRET_KEY='"):
            v = pick(letters, n) if n == 20 else "!" + pick(letters + symbols, n - 1)
            values.append((f"see {left}{v}\" or ' end", v))
    values.append(('PASSWORD="p@ss!word9"', "p@ss!word9"))
    found = {}
    for r in secrets.candidates(docs([(i, t) for i, (t, _) in enumerate(values)])).collect():
        found.setdefault(r.doc_id, []).append((r.start_char, r.end_char, r.candidate))
    for i, (t, v) in enumerate(values):
        assert found.get(i) == [(t.index(v), t.index(v) + len(v), v)], (t[:40], len(v))
    plain = [(1, "the secret of a token, " + pick(letters, 5000) + " and internationalization"), (2, "=" * 40_000 + " a: b"), (3, "a" * 200_000)]
    assert secrets.candidates(docs(plain)).count() == 0


def test_candidates_of_any_length_with_a_known_beginning_or_behind_a_cue(docs):
    long, late, bare = "Ab3" * 1700, "q" * 300 + "7" + "w" * 20, "AKIA" + "BCDEFGHIJKLMNOPQ"
    rows = [(1, f"x {long} y"), (2, f"x {late} y"), (3, f"x {bare} y"), (4, 'PASSWORD = "abcdefghijk"'), (5, "Token: " + "v" * 260), (6, "no candidate in here"), (7, long), (7, long)]
    found = {}
    for r in secrets.candidates(docs(rows)).collect():
        found.setdefault(r.doc_id, []).append(r.candidate)
    assert found == {1: [long], 2: [late], 3: [bare], 4: ["abcdefghijk"], 5: ["v" * 260], 7: [long, long]}


def test_secret_plan_is_native(spark, odd):
    plan = secrets.scan(odd)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


def test_secrets_odd(odd, none):
    assert secrets.scan(odd).count() == 0 and secrets.scan(none).count() == 0


# URLs. ----------------------------------------------------------------------------------------------
def test_url_rules(spark):
    urls = ["http://A.example.NET/en/1", "http://net", "http://net/", "http://example.com/de", "http://x.example.com/de/?q", "https://a.b.org/fr/x#y", "http://notnet.com/x", "nothing", None, "", "://h?x", "http://example.net/EN/", "http:///en/"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id bigint, url string").withColumn("rule", __import__("pyspark").sql.functions.lit(1))
    rows = {r.page_id: (r.rule, r.verdict) for r in urlfilter.judge(pages).collect()}
    assert [rows[i] for i in range(len(urls))] == [("example.net/en/", "allow"), (None, "allow"), ("net/", "block"), (None, "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"), *[(None, "allow")] * 5, ("net/", "block"), (None, "allow")]
    assert urlfilter.judge(pages.limit(0)).count() == 0 and urlfilter.judge(pages, []).where("rule is not null").count() == 0


def test_trie_equals_the_join_and_a_scan(spark):
    rnd = random.Random(4)
    rules = [urlfilter.Rule(".".join(rnd.choice("abc") for _ in range(rnd.randint(1, 3))), rnd.choice(["/", "/x", "/x/", "/x/y", "", "/y"]), rnd.choice(["allow", "block"])) for _ in range(25)]
    trie = urlfilter.Trie(rules)
    pages = [(i, "http://" + ".".join(rnd.choice("abc") for _ in range(rnd.randint(1, 4))) + rnd.choice(["", "/", "/x", "/x/", "/x/yz", "/xy", "/y/x"])) for i in range(400)]
    table = spark.createDataFrame([(r.host, r.path, r.verdict) for r in rules], "host string, path string, verdict string")
    joined = {r.page_id: (r.rule, r.verdict) for r in urlfilter.judge_by_join(spark.createDataFrame(pages, "page_id bigint, url string"), table).collect()}
    for i, url in pages:
        host, _, rest = url[7:].partition("/")
        path = "/" + rest if "/" in url[7:] else ""
        fit = [r for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
        best = max(fit, key=lambda r: (len(r.host), len(r.path), r.verdict == "block"), default=None)
        got = trie.find(host, path)
        assert (got and (got.text, got.verdict)) == (best and (best.text, best.verdict))
        assert joined[i] == ((best.text, best.verdict) if best else (None, "allow"))

"""Exact, suffix and near dedup, decontamination, the pipeline: against brute force, and the odd cases."""

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest

from quire.llm import decontaminate, exact_dedup, near_dedup, suffix_dedup
from quire.llm.common import Workspace
from quire.llm.components import components

WORDS = "the of and to in is was for that on with as by at from".split()


# Exact. ---------------------------------------------------------------------------------------------
def plain_groups(rows):
    folded = [(i, hashlib.sha256("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "").encode()).hexdigest()) for i, t in rows]
    out = []
    for i, h in folded:
        ids = [j for j, g in folded if g == h]
        keep = max((j for j in ids if j is not None), default=None)
        out.append((i, keep, len(ids), i == keep, h))
    return sorted(map(str, out))


@pytest.mark.parametrize("bits", [63, 3, 0])
def test_exact_groups_chain_collisions(docs, bits):
    rnd = random.Random(5)
    rows = [(i, rnd.choice(["a", "A", "b", "É", "é", "", None, "c" * 50, "C" * 50, f"x{i % 40}"])) for i in range(300)] + [(7, "dup"), (7, "dup")]
    got = exact_dedup.groups(docs(rows), hash_bits=bits, capacity=8)
    assert sorted(str(tuple(r)) for r in got.select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()) == plain_groups(rows)


def test_directory_doubles_until_buckets_fit():
    rnd = random.Random(3)
    keys = [rnd.getrandbits(63) for _ in range(400)] + [(5 << 55) + (k << 49) for k in range(60)] + [7 << 45] * 30
    calls = []

    def count(prefixes, local, known):
        calls.append(known)
        out = {}
        for k in keys:
            if k >> 63 - local in prefixes:
                out[k >> 63 - known] = out.get(k >> 63 - known, 0) + 1
        return out

    d = exact_dedup.Directory(count, 14, 16, 4, 3)
    firsts = d.firsts()
    assert len(d.slots) == 1 << d.depth == len(firsts) and len(calls) > 3
    held = {}
    for k in keys:
        held.setdefault(int(firsts[k >> 63 - d.depth]), []).append(k)
    for prefix, local in set(d.slots):
        rows = held.pop(prefix << 63 - local, [])
        assert all(k >> 63 - local == prefix for k in rows) and (len(rows) <= 16 or local == 14)
    assert not held


def test_index_alone_answers_and_buckets_are_files(docs, spark):
    rows = [(i, f"text {i % 70}") for i in range(300)]
    ws = Workspace(spark)
    prints, index, directory = exact_dedup.build_index(docs(rows).select("doc_id", "text"), ws, 8)
    assert directory.depth >= 3
    found = index.collect()
    assert len(found) == 70 and sum(r.group_size for r in found) == 300
    assert {r.bucket for r in found} <= set(directory.firsts().tolist())
    assert all(directory.firsts()[r.key >> 63 - directory.depth] == r.bucket for r in found)
    import os

    folders = [f for f in os.listdir(f"{ws.root}/index".removeprefix("file:")) if f.startswith("bucket=")]
    assert {int(f.split("=")[1]) for f in folders} == {r.bucket for r in found}
    assert prints.count() == 300


def test_exact_odd(odd, none):
    rows = {(r.doc_id, r.kept) for r in exact_dedup.groups(odd).collect()}
    assert (1, False) in rows and (2, True) in rows and (4, False) in rows and (5, True) in rows and (None, True) in rows
    assert exact_dedup.groups(none).count() == 0
    kept = exact_dedup.keep_one(odd)
    assert kept.columns == odd.columns and kept.count() == 8


# Components. ----------------------------------------------------------------------------------------
def test_components_of_chains_stars_and_pairs(spark):
    rnd = random.Random(6)
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, i) for i in range(101, 160)] + [(rnd.randrange(200, 300), rnd.randrange(200, 300)) for _ in range(60)]
    rnd.shuffle(edges)
    top = {}

    def root(x):
        while top.get(x, x) != x:
            x = top[x]
        return x

    for a, b in edges:
        a, b = sorted((root(a), root(b)))
        top[b] = a
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "u bigint, v bigint"), Workspace(spark)).collect()}
    assert got == {n: root(n) for a, b in edges if a != b for n in (a, b)}


# Near. ----------------------------------------------------------------------------------------------
def plain_components(rows, words, percent):
    sets = {}
    for i, t in rows:
        w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "").encode().split()
        sets[i] = {tuple(w[k : k + words]) for k in range(len(w) - words + 1)} if len(w) >= words else {tuple(w)} if w else set()
    ids, top = sorted(sets), {i: i for i in sets}

    def root(x):
        while top[x] != x:
            x = top[x]
        return x

    for a in ids:
        for b in ids:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                top[y] = x
    return {i: (len(sets[i]), root(i), root(i) == i) for i in ids}


def near_rows(rnd, n=400):
    base = [[rnd.choice(WORDS) + str(rnd.randrange(60)) for _ in range(rnd.choice([3, 10, 60, 120]))] for _ in range(25)]
    rows = []
    for i in range(n):
        w = list(rnd.choice(base[:4] if i % 2 else base))
        for _ in range(rnd.choice([0, 0, 1, 1, 2, 3, 6])):
            w[rnd.randrange(len(w))] = rnd.choice(WORDS) + "x"
        rows.append((i * 3, rnd.choice([" ", "\n", "  "]).join(w).upper() if i % 5 == 0 else " ".join(w)))
    return rows + [(5000, ""), (5001, None), (5002, " \t"), (5003, "one two"), (5004, "ONE two")]


@pytest.mark.parametrize("words, block", [(4, 256), (5, 7)])
def test_near_groups_equal_brute_force(docs, words, block):
    rows = near_rows(random.Random(words))
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_dedup.near_groups(docs(rows), words, 80, block).collect()}
    assert got == plain_components(rows, words, 80)


def test_shingles_across_batches_of_bytes(monkeypatch):
    texts = [r[1] for r in near_rows(random.Random(9), 60)]
    whole = list(near_dedup.sets_of(pa.array(texts), 4))
    monkeypatch.setattr(near_dedup, "PIECE", 100)
    assert all(np.array_equal(a, b) for a, b in zip(whole, near_dedup.sets_of(pa.array(texts), 4)))
    assert [len(s) for s in near_dedup.sets_of(pa.array(["a b c d", "a\x0bb\x1cc d e", None]), 4)] == [1, 1, 0]


def test_texts_of_one_template_do_not_meet_by_the_square(docs, spark, monkeypatch):
    rnd = random.Random(23)
    base = [rnd.choice(WORDS) + str(rnd.randrange(500)) for _ in range(120)]
    made = []
    for _ in range(600):
        w = list(base)
        for p in rnd.sample(range(len(w)), 7):  # some 0.6 of the shingles are common
            w[p] = "x" + str(rnd.randrange(10**6))
        made.append(" ".join(w))
    made += [made[5] + " end", made[6] + " end of it"]
    rows = list(enumerate(made))
    seen, block = [], near_dedup.cross_block

    def counted(members, percent):
        seen.append(near_dedup.cells_of(members).count())
        return block(members, percent)

    monkeypatch.setattr(near_dedup, "cross_block", counted)
    for n in (300, 602):
        part = rows[:n]
        got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_dedup.near_groups(docs(part), 4, 80, 32).collect()}
        assert got == plain_components(part, 4, 80)
    assert seen[1] <= 3 * seen[0] + 100, seen


def test_keys_that_hold_the_same_texts_are_looked_at_once(spark):
    rows = [(key, band, rep, rep, None) for key, band in ((70, 5), (80, 2), (90, 9)) for rep in (1, 2, 3)] + [(60, 1, 1, 1, None), (60, 1, 2, 2, None), (50, 0, 4, 4, None), (50, 0, 5, 4, None)]
    members = near_dedup.sized(spark.createDataFrame(rows, "key bigint, band int, rep bigint, comp bigint, prefix binary"), 256)
    assert sorted((r.key, r.rep) for r in members.collect()) == [(60, 1), (60, 2), (80, 1), (80, 2), (80, 3)]


def test_only_texts_alike_by_signature_move_with_their_sets(docs, monkeypatch):
    rnd = random.Random(31)
    rows = []
    for k in range(60):  # pairs that share half of their shingles meet in buckets, but are not alike
        head, a, b = ([rnd.choice(WORDS) + str(rnd.randrange(10**6)) for _ in range(n)] for n in (60, 30, 30))
        rows += [(2 * k, " ".join(head + a)), (2 * k + 1, " ".join(head + b))]
    seen, block = [], near_dedup.cross_block

    def counted(members, percent):
        seen.append(members.count())
        return block(members, percent)

    monkeypatch.setattr(near_dedup, "cross_block", counted)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_dedup.near_groups(docs(rows), 4, 80).collect()}
    assert got == plain_components(rows, 4, 80) and seen == [0]


def test_a_row_without_words_does_not_speak_for_its_id(docs):
    rnd = random.Random(37)
    pairs = []
    for k in range(30):  # the digest of no set is less than that of every fifth set
        w = [rnd.choice(WORDS) + str(rnd.randrange(10**6)) for _ in range(60)]
        pairs += [(2 * k, " ".join(w)), (2 * k + 1, " ".join(w[:-1]))]
    got = near_dedup.near_groups(docs(pairs + [(i, None) for i, _ in pairs] + pairs[:6]), 4, 80).where("n_shingles > 0").collect()
    assert len(got) == 66 and {(r.doc_id, r.component_id) for r in got} == {(i, i // 2 * 2) for i, _ in pairs}


def test_near_odd(odd, none):
    rows = {(r.doc_id, r.component_id, r.kept) for r in near_dedup.near_groups(odd, 4).collect()}
    assert {(1, 1, True), (2, 2, True), (4, 4, True), (5, 4, False), (None, None, True), (6, 6, True)} <= rows
    assert near_dedup.near_groups(none, 4).count() == 0
    kept = near_dedup.keep_one(odd)
    assert kept.columns == odd.columns and kept.count() == 8


# Suffix. --------------------------------------------------------------------------------------------
def plain_removals(rows):
    seen, out = {}, []
    for i, t in sorted(((-(1 << 63) if i is None else i, t) for i, t in rows), key=lambda r: r[0]):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - 99):
            if seen.setdefault(b[p : p + 100], (i, p)) != (i, p):
                gone[p : p + 100] = b"\1" * 100
        runs = sum(gone[p] and not (p and gone[p - 1]) for p in range(len(b)))
        out.append((None if i == -(1 << 63) else i, len(b), sum(gone), runs, hashlib.sha256(bytes(x for x, y in zip(b, gone) if not y)).hexdigest()))
    return sorted(map(str, out))


def removed(got):
    return sorted(str(tuple(r)) for r in got.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect())


@pytest.mark.parametrize("hot", [dict(), dict(hot_least=3, sample=1, part_bytes=4000), dict(hot_least=1, sample=1, part_bytes=1500)])
def test_removals_equal_brute_force(docs, hot):
    rnd = random.Random(11)
    prose = lambda n: " ".join(rnd.choice(WORDS) + rnd.choice(["", "s", "é"]) for _ in range(n))
    passages = [prose(60) for _ in range(6)]
    rows = [(i * 7 % 401, prose(rnd.randrange(40)) + rnd.choice(passages)[rnd.randrange(30) :] + prose(rnd.randrange(40)) * rnd.choice([1, 1, 3])) for i in range(150)]
    rows += [(500, "ab" * 400), (501, "ab" * 400), (502, "a" * 99), (503, "a" * 100), (504, "a" * 101), (505, None), (506, ""), (None, passages[0])]
    assert removed(suffix_dedup.removals(docs(rows), **hot)) == plain_removals(rows)


@pytest.mark.parametrize("partitions", [4, 64])
def test_rows_on_the_way_grow_with_the_copies_and_not_with_the_partitions(docs, spark, partitions):
    rnd = random.Random(19)
    base = [rnd.choice(WORDS) + str(rnd.randrange(90)) for _ in range(80)]
    made = []
    for _ in range(800):
        w = list(base)
        for _ in range(3):
            w[rnd.randrange(len(w))] = rnd.choice(WORDS) + str(rnd.randrange(10_000))
        made.append(" ".join(w))

    def rows(n):
        t = suffix_dedup.find(docs(list(enumerate(made[:n]))).select("doc_id", "text"), Workspace(spark), 7, 1 << 16, 64)
        return {k: t[k].count() for k in ("parsed", "owned", "reached", "windows")}

    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    half, whole = rows(400), rows(800)
    spark.conf.set("spark.sql.shuffle.partitions", before)
    assert all(whole[k] <= 2.3 * half[k] for k in whole), (half, whole)


def test_suffix_odd(odd, none, docs):
    assert removed(suffix_dedup.removals(odd)) == plain_removals([(r.doc_id, r.text) for r in odd.collect()])
    assert suffix_dedup.removals(none).count() == 0
    twice = [(1, "x y " * 60), (1, "x y " * 60)]
    assert len(set(removed(suffix_dedup.removals(docs(twice))))) == 1


# Decontamination. -----------------------------------------------------------------------------------
def edits(rnd, text, k):
    out = list(text)
    for _ in range(k):
        p = rnd.randrange(len(out))
        out[p : p + 1] = rnd.choice([[], [rnd.choice("xyz")], [out[p], rnd.choice("xyz")]])
    return "".join(out)


def test_blocks_pass_on_very_long_pairs_at_the_threshold(spark):
    rnd, n = np.random.default_rng(17), 450_000
    sig = bytes(4 * near_dedup.HASHES)

    def pairs(share):
        both = rnd.integers(0, 2**64, share, np.uint64)
        rows = []
        for rep in (1, 2):
            full = np.concatenate([both, rnd.integers(0, 2**64, n - share, np.uint64)])
            rows.append((9, 0, rep, rep, n, sig, np.unique((full >> np.uint64(32)).astype(np.uint32)).tobytes(), None))
        members = near_dedup.sized(spark.createDataFrame(rows, "key bigint, band int, rep bigint, comp bigint, n bigint, signature binary, short binary, prefix binary"), 256)
        return [tuple(r) for r in near_dedup.cross_block(members, 80).collect()]

    assert pairs(n * 8 // 9) == [(1, 2)] and pairs(n * 17 // 20) == []
    assert near_dedup.doubt(60, 60) == 0 and near_dedup.doubt(1_000_000, 1_000_000) > 300


def test_leaks_with_edits_are_found_and_others_left(docs, spark):
    rnd = random.Random(12)
    prose = lambda n: " ".join(rnd.choice(WORDS) + rnd.choice("abcdefgh") + rnd.choice("klmnop") for _ in range(n))
    items = [(k, prose(rnd.choice([8, 20, 45]))) for k in range(30)] + [(90, "too short"), (91, None), (92, "")]
    rows, want = [], {}
    for i in range(120):
        k, text = items[rnd.randrange(30)]
        if i % 3 == 0:
            part = edits(rnd, text, len(text) * 3 // 100)
            rows.append((i, prose(30) + "\n " + part.upper().replace(" ", rnd.choice([" ", "\n\n"])) + " " + prose(20)))
            want[i] = k
        else:
            rows.append((i, prose(80)))
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    for block in (2_000_000, 3000):
        got = {(r.doc_id, r.item_id) for r in decontaminate.leaks(docs(rows), bench, block_chars=block).collect()}
        assert got == set(want.items())
    kept = decontaminate.keep_clean(docs(rows), bench)
    assert {r.doc_id for r in kept.collect()} == {i for i, _ in rows} - set(want)


def plain_edits(pattern, text):
    row = [0] * (len(text) + 1)
    for i, a in enumerate(pattern, 1):
        above, row = row, [i]
        for j, b in enumerate(text, 1):
            row.append(min(above[j] + 1, row[j - 1] + 1, above[j - 1] + (a != b)))
    return min(row)


def test_banded_alignment_equals_the_full_table():
    rnd = random.Random(13)
    code = lambda s: np.array([ord(c) for c in s], np.uint32)
    for _ in range(150):
        pattern = "".join(rnd.choice("abcd") for _ in range(40))
        before = "".join(rnd.choice("abcd") for _ in range(rnd.randrange(20)))
        text = before + edits(rnd, pattern, rnd.randrange(6)) + "".join(rnd.choice("abcd") for _ in range(10))
        full = plain_edits(pattern, text)
        got = decontaminate.align(code(pattern), code(text), 6, 0, 30)
        assert (got is None) == (full > 6) and (got is None or got[2] == full)
        if got:
            assert plain_edits(pattern, text[got[0] : got[1]]) == full


def test_spans_point_into_the_text(docs, spark):
    item = "A passage that is long enough to be told from others, by far and wide."
    text = "é\n\n intro  " + item.replace(" ", "  ") + "  end"
    r = decontaminate.leaks(docs([(1, text)]), spark.createDataFrame([(3, item)], "item_id bigint, text string")).collect()
    assert [(x.doc_id, x.item_id, x.edits) for x in r] == [(1, 3, 0)] and text[r[0].start_char : r[0].end_char] == item.replace(" ", "  ")


def test_unaligned_excerpts_of_an_item_are_found():
    rnd = random.Random(14)
    item = " ".join(rnd.choice(WORDS) + rnd.choice("abcdefgh") + rnd.choice("klmnop") for _ in range(90))[:394].strip()
    index = decontaminate.Index([(7, item)], 24)
    fence = "0123456789" * 20
    for n in (100, 101, 110, 123, 140):
        for start in range(1, len(item) - n, 13):
            part = item[start : start + n].strip()
            if len(part) < 100:
                continue
            for k in (0, 3, 6):
                text = fence + edits(rnd, part, k) + fence
                found = index.search(text)
                assert found and {f[0] for f in found} == {7}, (n, start, k)
                assert k or found[0][1:] == (len(fence), len(fence) + len(part), 0)
    assert not any(index.search(fence + item[s : s + 90].strip() + fence) for s in range(1, 300, 17))


def test_aligned_together_equals_the_full_table():
    rnd = random.Random(15)
    code = lambda s: np.array([ord(c) for c in s], np.uint32)
    for _ in range(30):
        text = "".join(rnd.choice("abcd") for _ in range(60))
        firsts = [rnd.randrange(-5, 30) for _ in range(8)]
        patterns = ["".join(edits(rnd, text[max(f, 0) :] + "abcd" * 20, rnd.randrange(9))[:40]) for f in firsts]
        got = decontaminate.align_all(np.stack([code(p) for p in patterns]), code(text), 6, np.array(firsts), 30)
        for p, r in zip(patterns, got):
            full = plain_edits(p, text)
            assert r is None or (full <= r[2] == plain_edits(p, text[r[0] : r[1]]))
            assert r is not None or full > 6


def test_short_items_match_whole_documents_only(docs, spark):
    bench = spark.createDataFrame([(1, "Short item"), (2, "short  ITEM "), (3, "another passage that is long enough to be found within a text")], "item_id bigint, text string")
    rows = [(1, "\n short item"), (2, "a short item within a text"), (3, "so " + "another passage that is long enough to be found within a text" + " it is"), (3, "SHORT ITEM")]
    for block in (2_000_000, 60):
        found = sorted(tuple(r) for r in decontaminate.leaks(docs(rows), bench, block_chars=block).select("doc_id", "item_id", "start_char", "end_char").collect())
        assert found == [(1, 1, 2, 12), (1, 2, 2, 12), (3, 1, 0, 10), (3, 2, 0, 10), (3, 3, 3, 3 + len(bench.where('item_id = 3').first().text))]


def test_decontamination_odd(odd, none, spark):
    bench = spark.createDataFrame([(1, "something that is in no text at all, whatever one reads")], "item_id bigint, text string")
    assert decontaminate.leaks(odd, bench).count() == 0 and decontaminate.leaks(none, bench).count() == 0 and decontaminate.leaks(odd, bench.limit(0)).count() == 0
    assert decontaminate.keep_clean(odd, bench).count() == odd.count()

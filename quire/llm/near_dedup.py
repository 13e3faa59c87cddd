"""MinHash near-dedup: universal hash minima, banding, verification on full sets, connected components.

Texts with equal shingle sets form a class, of which one row goes on.  HASHES minima in BANDS bands of
ROWS miss a pair at the threshold of 0.8 with probability (1 - 0.8^ROWS)^BANDS < 1e-7.  Each text is first
compared with one hub of its buckets; components of what is confirmed come from large-star and small-star.
Only buckets that then still hold several components are compared further, and one of those that hold the same
texts.  Those of more than ``block`` texts are dealt anew by the rarest shingles of each text (a prefix filter,
which loses no link), so that texts of one template, alike but below the threshold, don't meet by the square of
their number.  A large group of copies costs one comparison a text.  Signatures move first; shingle sets move only
of texts that a signature finds alike to another.  A link counts only if the full sets confirm it.

Defined results: null, empty and blank texts have no shingles, link with nothing and are their own
component; texts of fewer words than a shingle are one shingle; rows that repeat a doc_id are one node,
of the text whose set has the smallest digest; rows of a null doc_id are returned with a null component
and kept = true.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import Workspace, bitmap, in_bitmap, map_batches, small_batches, without
from quire.llm.components import components

BANDS, ROWS = 32, 4
HASHES = BANDS * ROWS
#: Bytes of text that are hashed at a time.
PIECE = 1 << 18
#: Counters by which shingles are put in order, the rarest first.
SLOTS = 1 << 16
_M1, _M2, _BASE = (np.uint64(x) for x in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0x5851F42D4C957F2D))


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(30)) * _M1
    x = (x ^ x >> np.uint64(27)) * _M2
    return x ^ x >> np.uint64(31)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


_tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64."""
    size = 1 << max(PIECE.bit_length(), n.bit_length())
    if size not in _tables:
        _tables.clear()
        base = int(_BASE)
        _tables[size] = _powers(base, size), _powers(pow(base, -1, 1 << 64), size)
    return _tables[size]


def shingles(data: np.ndarray, starts: np.ndarray, words: int) -> list[np.ndarray]:
    """Distinct shingle hashes, sorted, of each text; starts has the offsets of the texts in data, and its length."""
    lower = data + ((data >= 65) & (data <= 90)).astype(np.uint8) * np.uint8(32)
    word = (lower != 32) & ((lower < 9) | (lower > 13))
    first, last = word.copy(), word.copy()
    first[1:] &= ~word[:-1]
    last[:-1] &= ~word[1:]
    edges = starts[(starts > 0) & (starts < len(data))]
    first[edges] = word[edges]
    last[edges - 1] = word[edges - 1]
    a, b = np.flatnonzero(first), np.flatnonzero(last) + 1
    up, down = powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((lower.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=sums[1:])
    h = mix((sums[b] - sums[a]) * down[a] + (b - a).astype(np.uint64))
    at = np.searchsorted(a, starts)
    run = np.zeros(max(len(h) - words + 1, 0), np.uint64)
    for k in range(words):
        run = mix(run * _M1 + h[k : k + len(run)]) if len(run) else run
    out = []
    for i, j in zip(at, at[1:]):
        if j - i >= words:
            out.append(np.unique(run[i : j - words + 1]))
        elif j > i:
            whole = np.uint64(j - i)
            for x in h[i:j]:
                whole = mix(np.array([whole * _M2 + x], np.uint64))[0]
            out.append(np.array([whole], np.uint64))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def sets_of(column: pa.Array, words: int):
    """The shingle sets of a column of texts, one after another, with bounded memory beyond the longest text."""
    column = column.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    i = 0
    with np.errstate(over="ignore"):
        while i < len(column):
            j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + PIECE, "right")) - 1)
            yield from shingles(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], words)
            i = j


def coefficients() -> tuple[np.ndarray, np.ndarray]:
    draw = np.random.default_rng(20240229)
    return draw.integers(0, 1 << 63, HASHES, np.uint64) * np.uint64(2) + np.uint64(1), draw.integers(0, 1 << 63, HASHES, np.uint64)


def minima(s: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least of (a x + b) mod 2^64 over the set for each hash, in its upper 32 bits."""
    low = np.full(HASHES, np.iinfo(np.uint64).max, np.uint64)
    for k in range(0, len(s), 512):
        h = s[k : k + 512, None] * a
        h += b
        np.minimum(low, h.min(0), out=low)
    return (low >> np.uint64(32)).astype(np.uint32)


def signatures(docs: DataFrame, words: int) -> DataFrame:
    """doc_id, n_shingles, digest (of the set), signature (null without shingles)."""

    def start():
        a, b = coefficients()

        def one(batch: pa.RecordBatch) -> dict:
            n, digest, sig = [], [], []
            for s in sets_of(batch.column("text"), words):
                n.append(len(s))
                digest.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                sig.append(minima(s, a, b).tobytes() if len(s) else None)
            return {"doc_id": batch.column("doc_id"), "n_shingles": pa.array(n, pa.int64()), "digest": pa.array(digest, pa.binary()), "signature": pa.array(sig, pa.binary())}

        return one

    return map_batches(docs.select("doc_id", "text"), start, "doc_id bigint, n_shingles bigint, digest binary, signature binary")


def among(df: DataFrame, column: str, ids: DataFrame) -> DataFrame:
    """Rows of df whose id may be one of ids (doc_id): all that are, and few others."""
    words = bitmap(ids.select(F.xxhash64("doc_id").alias("_key")), "_key", ids.count())
    return in_bitmap(df.withColumn("_key", F.xxhash64(column)), "_key", words).drop("_key")


def full_sets(docs: DataFrame, ids: DataFrame, again: DataFrame, words: int, ws: Workspace) -> DataFrame:
    """doc_id, grams (the full set) of the documents named in ids and of few others; again: those of ids that have several rows."""
    some = among(docs.select("doc_id", "text"), "doc_id", ids)

    def start():
        def one(batch: pa.RecordBatch) -> dict:
            made = list(sets_of(batch.column("text"), words))
            return {
                "doc_id": batch.column("doc_id"),
                "grams": pa.array([s.view(np.int64) for s in made], pa.list_(pa.int64())),
                "digest": pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in made], pa.binary()),
            }

        return one

    def made(texts: DataFrame) -> DataFrame:
        return map_batches(texts, start, "doc_id bigint, grams array<bigint>, digest binary").where(F.size("grams") > 0)

    # sets move only where a row must be chosen among several of an id
    count = again.count()
    sets = made(without(some, again, count)).select("doc_id", "grams")
    if count:
        sets = sets.unionByName(made(among(some, "doc_id", again).join(again, "doc_id", "left_semi")).groupBy("doc_id").agg(F.min_by("grams", "digest").alias("grams")))
    return ws.stage(sets, "sets")


def cut_sets(sets: DataFrame, ids: DataFrame) -> DataFrame:
    """rep, short (hashes of the set cut to 32 bits, as bytes) of the documents named in ids and of few others."""

    def start():
        def one(batch: pa.RecordBatch) -> dict:
            cut = [np.unique((g.values.to_numpy().view(np.uint64) >> np.uint64(32)).astype(np.uint32)).tobytes() for g in batch.column("grams")]
            return {"rep": batch.column("doc_id"), "short": pa.array(cut, pa.binary())}

        return one

    return map_batches(among(sets, "doc_id", ids), start, "rep bigint, short binary")


def floor_of(percent: int, deviations: float) -> int:
    """The least number of equal minima by which a pair is taken as one that may reach the threshold."""
    p = percent / 100
    return int(HASHES * (p - deviations * (p * (1 - p) / HASHES) ** 0.5))


def alike(pairs: DataFrame, reps: DataFrame, percent: int) -> DataFrame:
    """Those of the pairs (u, v) that sizes and signatures don't rule out, eight deviations below the threshold."""
    floor = floor_of(percent, 8)
    side = lambda c: reps.select(F.col("rep").alias(c), F.col("n").alias(f"n{c}"), F.col("signature").alias(f"s{c}"))
    both = pairs.distinct().join(side("v"), "v").join(side("u"), "u").where(100 * F.least("nu", "nv") >= percent * F.greatest("nu", "nv"))

    def start():
        def one(batch: pa.RecordBatch) -> dict:
            su, sv = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint32).reshape(-1, HASHES) for c in ("su", "sv"))
            ok = pa.array((su == sv).sum(1) >= floor)
            return {c: batch.column(c).filter(ok) for c in ("u", "v")}

        return one

    return map_batches(both.select("u", "v", "su", "sv"), start, "u bigint, v bigint")


def confirm(sets: DataFrame, pairs: DataFrame, percent: int, ws: Workspace, name: str) -> DataFrame:
    """Those of the pairs (u, v) whose full sets reach the threshold."""
    pairs = ws.stage(pairs.select("u", "v").distinct(), f"{name}-pairs")
    side = lambda c: among(sets, "doc_id", pairs.select(F.col(c).alias("doc_id"))).select(F.col("doc_id").alias(c), F.col("grams").alias(f"g{c}"))
    both = pairs.join(side("v"), "v").join(side("u"), "u")
    shared = F.size(F.array_intersect("gu", "gv"))
    return ws.stage(both.where(100 * shared >= percent * (F.size("gu") + F.size("gv") - shared)).select("u", "v"), name)


def doubt(n: int, m: int) -> float:
    """By how many shingles the cut sets of two texts may be wrong: n m / 2^32 at most are expected, with eight deviations and two more."""
    expected = n * m / 2**32
    return 2 + expected + 8 * expected**0.5 if n * m > 4096 else 0


def sized(members: DataFrame, block: int) -> DataFrame:
    """members (key, band, rep, comp, ...) of keys with several components, with top (the largest component of the key), of it and of others the blocks.

    Of keys that hold the same texts (by their number and 128 bits of hashes) only the first stays: the one in which
    ``cross_block`` looks at their pairs.
    """
    each = members.groupBy("key", "comp").agg(F.count("*").alias("c"), F.min("band").alias("band"), F.bit_xor(F.xxhash64("rep")).alias("x"), F.bit_xor(F.xxhash64("rep", F.lit(1))).alias("y"))
    keys = each.groupBy("key").agg(F.sum("c").alias("held"), F.max(F.struct("c", "comp")).alias("m"), F.count("*").alias("comps"), F.min("band").alias("band"), F.bit_xor("x").alias("x"), F.bit_xor("y").alias("y")).where("comps > 1")
    keys = keys.groupBy("held", "x", "y").agg(F.min(F.struct("band", "key", "m")).alias("first")).select("held", "first.key", "first.m")
    blocks = lambda n: F.ceil(n / block)
    keys = keys.select("key", "held", F.col("m.comp").alias("top"), (F.col("held") - F.col("m.c")).alias("others"), blocks(F.col("m.c")).alias("top_blocks"), blocks(F.col("held") - F.col("m.c")).alias("blocks"))
    return members.join(keys, "key")


def cells_of(members: DataFrame) -> DataFrame:
    """The cells (key, low, high) in which members meet: those in the block ``low`` meet those in ``high``.

    Members of the largest component never meet each other, so those beside few others are in a cell each, and a large
    component costs rows in proportion.  Others meet block by block, and with each block of the largest component.
    """
    top = F.col("comp") == F.col("top")
    mine = F.pmod(F.xxhash64("rep"), F.when(top, F.col("top_blocks")).otherwise(F.col("blocks")))
    count = lambda n: F.sequence(F.lit(0).cast("bigint"), n - 1)
    # blocks of the largest component are numbered from -1 downwards
    cell = lambda low, high: F.struct(low.alias("low"), high.alias("high"))
    held = F.transform(count(F.col("blocks")), lambda k: cell(-1 - F.col("mine"), k))
    passing = F.transform(count(F.col("top_blocks")), lambda k: cell(-1 - k, F.col("mine")))
    among = F.transform(count(F.col("blocks")), lambda k: cell(F.least("mine", k), F.greatest("mine", k)))
    cells = members.withColumn("mine", mine).withColumn("cell", F.explode(F.when(top, held).otherwise(F.concat(passing, among))))
    return cells.withColumn("low", F.col("cell.low")).withColumn("high", F.col("cell.high")).withColumn("mine", F.when(top, F.col("low")).otherwise(F.col("mine"))).drop("cell")


def lookalikes(t: pa.Table, percent: int):
    """(i, j, score) for members i of a cell: those members j of other components that size and signature don't rule out.

    A pair is looked at in the first band that it shares; pairs met with a band of -1 are all given.
    """
    floor = floor_of(percent, 5.5)
    rep, comp, n, mine = (t.column(c).to_numpy() for c in ("rep", "comp", "n", "mine"))
    low, high, band = (t.column(c)[0].as_py() for c in ("low", "high", "band"))
    sig = np.frombuffer(b"".join(t.column("signature").to_pylist()), np.uint32).reshape(-1, HASHES)
    left, right = np.flatnonzero(mine == low), np.flatnonzero(mine == high)
    for i in left:
        j = right[(comp[right] != comp[i]) & (100 * np.minimum(n[right], n[i]) >= percent * np.maximum(n[right], n[i]))]
        if low == high:
            j = j[rep[j] > rep[i]]
        same = sig[j] == sig[i]
        score = same.sum(1)
        first = same.reshape(-1, BANDS, ROWS).all(2).argmax(1)
        ok = (score >= floor) & ((first == band) | (band < 0))
        if ok.any():
            yield i, j[ok], score[ok]


def least_shared(a: np.ndarray, b: np.ndarray) -> int:
    return np.intersect1d(a, b, True)[0]


def marked(members: DataFrame, percent: int) -> DataFrame:
    """The members that are alike to one of another component in a cell of their key, without the signatures that tell it."""
    kept = ["key", "band", "rep", "comp", "n", "top", "top_blocks", "blocks"]
    rows = cells_of(members).select(*kept, "low", "high", "mine", "signature", "prefix")

    def mark(t: pa.Table) -> pa.Table:
        band, key = (t.column(c)[0].as_py() for c in ("band", "key"))
        prefix = [np.frombuffer(x, np.int64) for x in t.column("prefix").to_pylist()] if band < 0 else []
        found = np.zeros(len(t), bool)
        for i, j, _ in lookalikes(t, percent):
            if prefix:
                j = [k for k in j if not (found[i] and found[k]) and least_shared(prefix[i], prefix[k]) == key]
            if len(j):
                found[i] = True
                found[j] = True
        return t.select(kept).filter(pa.array(found))

    return rows.groupBy("key", "low", "high").applyInArrow(mark, rows.select(kept).schema).distinct()


def cross_block(members: DataFrame, percent: int) -> DataFrame:
    """Pairs (u, v) that join different components of one bucket, block by block.

    members: key, band, rep, comp, n, signature, short, and what ``sized`` adds.  Signatures say which pairs may
    reach the threshold, the cut sets decide; a pair is looked at in the first band that it shares, or with a band
    of -1 under the least key that both prefixes hold, and not at all once its components are joined.
    """
    cells = cells_of(members)
    rows = cells.select("key", "low", "high", "mine", "band", "rep", "comp", "n", "signature", "short", "prefix")

    def near(t: pa.Table) -> pa.Table:
        rep, comp, n = (t.column(c).to_numpy() for c in ("rep", "comp", "n"))
        band, key = (t.column(c)[0].as_py() for c in ("band", "key"))
        prefix = [np.frombuffer(x, np.int64) for x in t.column("prefix").to_pylist()] if band < 0 else []
        short = [np.frombuffer(x, np.uint32) for x in t.column("short").to_pylist()]
        top: dict[int, int] = {}

        def root(c: int) -> int:
            while (up := top.get(c, c)) != c:
                top[c] = top.get(up, up)
                c = up
            return c

        u, v = [], []
        for i, j, score in lookalikes(t, percent):
            for k in j[np.argsort(-score, kind="stable")]:
                a, b = root(int(comp[i])), root(int(comp[k]))
                if a == b or prefix and least_shared(prefix[i], prefix[k]) != key:
                    continue
                shared = len(np.intersect1d(short[i], short[k], True))
                # cut hashes may be wrong by some shingles in large sets: what is near the bound goes on to the full sets
                slack = doubt(int(n[i]), int(n[k]))
                bound = percent * (int(n[i]) + int(n[k])) / (100 + percent)
                if shared >= bound - slack:
                    u.append(int(rep[i]))
                    v.append(int(rep[k]))
                if shared >= bound + slack:
                    top[a] = b
        return pa.table({"u": pa.array(np.minimum(u, v) if u else [], pa.int64()), "v": pa.array(np.maximum(u, v) if u else [], pa.int64())})

    return rows.groupBy("key", "low", "high").applyInArrow(near, "u bigint, v bigint").distinct()


def rare_keys(crowd: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(rep, comp, keys, prefix) of each text of the crowd (rep, comp): its rarest shingles, by which crowded buckets are dealt anew, and the same in order as bytes.

    With all shingles of the crowd in one order, two sets that reach the threshold share one of the first
    n - ceil(n percent / 100) + 1 of each: that holds for any order, so no link is lost.  Here shingles come by how often
    their SLOTS-valued hash is met in the crowd, so that texts which share only what is common to it don't meet.
    """
    grams = among(sets, "doc_id", crowd.select(F.col("rep").alias("doc_id"))).select(F.col("doc_id").alias("rep"), "grams")
    slot = lambda g: (g.view(np.uint64) >> np.uint64(17)).astype(np.int64) % SLOTS

    def count(batches):
        met = np.zeros(SLOTS, np.int64)
        for batch in batches:
            met += np.bincount(slot(batch.column("grams").flatten().to_numpy()), minlength=SLOTS)
        at = np.flatnonzero(met)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(met[at])], names=["slot", "n"])

    often = np.zeros(SLOTS, np.int64)
    for r in grams.select("grams").mapInArrow(count, "slot bigint, n bigint").groupBy("slot").agg(F.sum("n").alias("n")).collect():  # at most SLOTS rows
        often[r["slot"]] = r["n"]

    def first():
        def one(batch: pa.RecordBatch) -> dict:
            keys = []
            for g in batch.column("grams"):
                g = np.asarray(g.values.to_numpy())
                keys.append(g[np.lexsort((g, often[slot(g)]))][: len(g) + percent * len(g) // -100 + 1])
            return {"rep": batch.column("rep"), "keys": pa.array(keys, pa.list_(pa.int64())), "prefix": pa.array([np.sort(k).tobytes() for k in keys], pa.binary())}

        return one

    return map_batches(grams, first, "rep bigint, keys array<bigint>, prefix binary").join(crowd, "rep")


def near_groups(docs: DataFrame, words: int = 5, percent: int = 80, block: int = 256) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable), kept. doc_id is a bigint."""
    small_batches(docs.sparkSession)
    ws = Workspace(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    prints = ws.stage(signatures(docs, words), "prints")
    filled = prints.where("n_shingles > 0 and doc_id is not null")
    nodes = filled.groupBy("doc_id").agg(F.min("digest").alias("digest"), F.count("*").alias("rows"))
    classes = ws.stage(nodes.groupBy("digest").agg(F.min(F.struct("doc_id", "rows")).alias("m")).select("digest", F.col("m.doc_id").alias("rep"), F.col("m.rows").alias("rows")), "classes")
    # a row that is the only one of its id and speaks for its class stays where it is
    others = ws.stage(nodes.join(classes.select("digest", "rep"), "digest").where("doc_id <> rep or rows > 1").select("doc_id"), "others")
    again = classes.where("rows > 1").select("digest", F.col("rep").alias("doc_id"))
    alone = without(filled.select("doc_id", "n_shingles", "signature"), others, others.count())
    chosen = among(filled, "doc_id", again).join(again, ["doc_id", "digest"]).groupBy("doc_id").agg(F.min("n_shingles").alias("n_shingles"), F.min("signature").alias("signature"))
    all_reps = alone.unionByName(chosen).select(F.col("doc_id").alias("rep"), F.col("n_shingles").alias("n"), "signature")

    one_band = lambda b: F.struct(F.xxhash64(F.substring(F.col("signature"), 1 + b * 4 * ROWS, F.lit(4 * ROWS)), b).alias("key"), b.alias("band"))
    banded = all_reps.select("rep", F.explode(F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), one_band)).alias("x")).select("rep", "x.*")
    # most keys are met once: only rows of the others move
    keys = ws.stage(banded.groupBy("key").agg(F.count("*").alias("size")).where("size > 1").select("key"), "keys")
    banded = ws.stage(in_bitmap(banded, "key", bitmap(keys, "key", keys.count())), "banded")
    # hubs: the least of the ids under one of four bijections, so that a group has several
    turned = F.element_at(F.array(*[F.lit(m) for m in (0, 0x2AAAAAAAAAAAAAAA, 0x5555555555555555, 0x3333333333333333)]), (F.col("band") % 4 + 1).cast("int"))
    buckets = banded.groupBy("key").agg(F.count("*").alias("size"), F.min(F.col("rep").bitwiseXOR(turned)).alias("hub"), F.min("band").alias("band")).where("size > 1")
    members = ws.stage(banded.select("key", "rep").join(buckets.select("key", "band", F.col("hub").bitwiseXOR(turned).alias("hub")), "key"), "members")
    ids = ws.stage(members.select(F.col("rep").alias("doc_id")).distinct(), "ids")
    reps = ws.stage(among(all_reps, "rep", ids), "reps")
    sets = full_sets(docs, ids, again.select("doc_id"), words, ws)
    shared = members.where("rep <> hub").groupBy("rep", "hub").agg(F.count("*").alias("bands"))
    best = shared.groupBy("rep").agg(F.max_by("hub", F.struct("bands", "hub")).alias("hub"))
    edges = confirm(sets, alike(best.select(F.least("rep", "hub").alias("u"), F.greatest("rep", "hub").alias("v")), reps, percent), percent, ws, "hubs")
    joined = components(edges, ws, "cc-hubs")

    placed = ws.stage(members.join(joined.withColumnRenamed("node", "rep"), "rep", "left").select("key", "band", "rep", F.coalesce("component", "rep").alias("comp")), "placed")
    left = ws.stage(sized(placed, block), "mixed")
    # few beside one large component meet as they are; many are dealt anew
    few = F.col("others") <= block
    crowd = ws.stage(left.where(~few).groupBy("rep").agg(F.min("comp").alias("comp")), "crowd")
    rare = ws.stage(rare_keys(crowd, sets, percent), "rare")
    dealt = ws.stage(sized(rare.select(F.explode("keys").alias("key"), F.lit(-1).alias("band"), "rep", "comp"), block), "dealt")
    prefixes = rare.select("rep", F.lit(-1).alias("band"), "prefix")
    rest = left.where(few).unionByName(dealt).join(prefixes, ["rep", "band"], "left").join(reps, "rep")
    rest = ws.stage(marked(rest, percent), "marked")
    named = ws.stage(rest.select(F.col("rep").alias("doc_id")).distinct(), "named")
    payload = among(reps.select("rep", "signature"), "rep", named).join(cut_sets(sets, named), "rep")
    rest = rest.join(prefixes, ["rep", "band"], "left").join(payload, "rep")
    more = confirm(sets, cross_block(rest, percent), percent, ws, "rest")
    for name in ("others", "keys", "banded", "members", "ids", "reps", "sets", "hubs-pairs", "placed", "mixed", "crowd", "rare", "dealt", "marked", "named", "rest-pairs"):
        ws.drop(name)
    final = components(edges.unionByName(more), ws, "cc-all")

    whole = prints.join(classes.select("digest", "rep"), "digest", "left").join(final.withColumnRenamed("node", "rep"), "rep", "left")
    found = whole.select("doc_id", "n_shingles", F.coalesce("component", "rep", "doc_id").alias("component_id"))
    return found.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"), F.when(F.col("doc_id").isNull(), True).otherwise(F.col("doc_id") == F.col("component_id")).alias("kept"))


def keep_one(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """One document of each group, in the columns they came with."""
    gone = Workspace(docs.sparkSession).stage(near_groups(docs, words, percent).where("not kept").select("doc_id").distinct(), "gone")
    return without(docs, gone, gone.count())


ORACLE = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS (SELECT doc_id, unnest(list_distinct(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')]
      ELSE list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i + 3], ' ')) END)) AS g FROM w),
h AS (SELECT doc_id, hash(g) AS g FROM s),
n AS (SELECT doc_id, count(*) AS n FROM h GROUP BY doc_id),
i AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS c FROM h a JOIN h b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
e AS (SELECT u, v FROM i JOIN n x ON x.doc_id = u JOIN n y ON y.doc_id = v WHERE 100 * c >= 80 * (x.n + y.n - c)),
r AS (SELECT doc_id, doc_id AS top FROM documents UNION SELECT e.v, r.top FROM r JOIN e ON e.u = r.doc_id WHERE r.top < e.v),
m AS (SELECT doc_id, min(top) AS component_id FROM r GROUP BY doc_id)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, m.component_id, d.doc_id = m.component_id AS kept
FROM documents d JOIN m USING (doc_id) LEFT JOIN n USING (doc_id)
"""

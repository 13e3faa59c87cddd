"""Suffix-array dedup by prefix-free parsing.

A byte goes if it lies in a WINDOW-byte string that also starts earlier in the corpus (smaller doc_id, or
earlier in the same document).  Texts are parsed into phrases at rolling-hash triggers: the trigger of a
window is the leftmost minimum of its GRAM-byte hashes, and a phrase is a run of window starts with one
trigger.  Equal windows have the same trigger at the same offset, so:

* the dictionary holds each distinct phrase (with the bytes its windows reach) once: all its windows repeat
  in every occurrence but the first, which settles most of a repetitive corpus phrase by phrase.  Phrases are
  equal when their 64-bit trigger hash, offset, length and 64-bit content hash are; as contents are compared
  under one trigger only, a chance match among a million phrases of a trigger has a probability below 1e-7;
* distinct phrases that share a trigger may still share windows.  What is right of the trigger is a suffix of
  the parse, what is left of it, read backwards, belongs to the dictionary: both are put in order by their
  bytes, with longest common prefixes.  The two orders combine into classes of equal windows for each offset,
  whose first in corpus order stays.  Windows are WINDOW bytes, so suffixes are ordered that deep and no deeper.

All tables are flat: a row a phrase, or a run of windows that go, so what moves is in proportion to the
phrases whatever the number of partitions.  Copies are combined before the first shuffle.  A trigger of very
many distinct phrases is not gathered in one task: its windows are dealt by their own hashes instead, at most
WIDE rows a phrase.  Such triggers are estimated from every SAMPLE-th distinct phrase; a wrong estimate
changes where windows are compared and nothing in the result.

Defined results: null counts as empty; texts under WINDOW bytes lose nothing; rows that repeat a doc_id are
the same place in the corpus and don't remove each other; a null doc_id comes before all others.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import Workspace, small_batches
from quire.llm.near_dedup import mix, powers

WINDOW, GRAM = 100, 40
WIDE = WINDOW - GRAM + 1
#: Bytes of text that are parsed at a time, and phrases that are combined at a time.
PIECE, COMBINED = 1 << 21, 1 << 20
#: One in SAMPLE distinct phrases is counted to find the triggers of very many.
SAMPLE = 64
NO_ID = -(1 << 63)

#: place is at * 2^16 + len * 2^8 + off. A row without a key is a run of windows that go: place is at * 2^32 + len.
PHRASES = "doc bigint, place bigint, key bigint, content bigint"
OWNED = "doc bigint, place bigint, key bigint, hot boolean"
REACHED = "part bigint, doc bigint, place bigint, key bigint, text binary"
MARKS = "doc bigint, at bigint, len bigint"
RESULT = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string"


def place_of(at: np.ndarray, length: np.ndarray, off: np.ndarray | int = 0) -> np.ndarray:
    return at.astype(np.int64) << 16 | length.astype(np.int64) << 8 | off


def unplace(place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return place >> 16, place >> 8 & 255, place & 255


def numbers(t: pa.Table, *names: str) -> list[np.ndarray]:
    return [np.asarray(t.column(n).to_numpy()) for n in names]


def table_of(**columns) -> pa.Table:
    return pa.table({n: c if isinstance(c, pa.Array) else pa.array(np.asarray(c, np.int64)) for n, c in columns.items()})


def phrases(data: np.ndarray, starts: np.ndarray):
    """(trigger key, content hash, document, start, length, trigger offset) of the phrases; starts: offsets of the texts and the end."""
    n = len(data)
    if n < WINDOW:
        return tuple(np.zeros(0, t) for t in (np.uint64, np.uint64, np.int64, np.int64, np.int64, np.int64))
    up, down = powers(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:n], out=sums[1:])
    m = n - GRAM + 1
    h = mix((sums[GRAM:] - sums[:m]) * down[:m])
    bits = np.uint64(n.bit_length())
    low = h >> bits << bits | np.arange(m, dtype=np.uint64)
    span = 1
    while 2 * span <= WIDE:
        low = np.minimum(low[:-span], low[span:])
        span *= 2
    if span < WIDE:
        low = np.minimum(low[: span - WIDE], low[WIDE - span :])
    trigger = (low & (np.uint64(1) << bits) - np.uint64(1)).astype(np.int64)
    doc = np.repeat(np.arange(len(starts) - 1), np.diff(starts))[: len(trigger)]
    inside = np.arange(len(trigger)) + WINDOW <= starts[doc + 1]
    new = np.ones(len(trigger), bool)
    new[1:] = (trigger[1:] != trigger[:-1]) | (doc[1:] != doc[:-1])
    first = np.flatnonzero(new & inside)
    stops = np.append(np.flatnonzero(new | ~inside), len(trigger))
    end = stops[np.searchsorted(stops, first, "right")]
    off = trigger[first] - first
    content = mix((sums[end + WINDOW - 1] - sums[first]) * down[first] + (off.astype(np.uint64) << np.uint64(40)) + (end - first).astype(np.uint64))
    return h[trigger[first]], content, doc[first], first - starts[doc[first]], end - first, off


def later(same: np.ndarray, doc: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Of rows in corpus order within runs of equals (same: equal to the row before): those after the first place of their run."""
    lead = np.maximum.accumulate(np.where(same, 0, np.arange(len(same))))
    return (doc != doc[lead]) | (at != at[lead])


def equals(*keys: np.ndarray) -> np.ndarray:
    same = np.zeros(len(keys[0]), bool)
    if len(same):
        same[1:] = np.logical_and.reduce([k[1:] == k[:-1] for k in keys])
    return same


def runs(doc: np.ndarray, at: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows that follow one another, merged."""
    if not len(doc):
        return doc, at, length
    order = np.lexsort((at, doc))
    doc, at, length = doc[order], at[order], length[order]
    head = np.ones(len(doc), bool)
    head[1:] = (doc[1:] != doc[:-1]) | (at[1:] > at[:-1] + length[:-1])
    begin = np.flatnonzero(head)
    return doc[begin], at[begin], np.maximum.reduceat(at + length, begin) - at[begin]


def texts_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    column = column.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    return np.frombuffer(column.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def ids_of(column) -> np.ndarray:
    return np.asarray(column.fill_null(NO_ID).to_numpy(zero_copy_only=False) if isinstance(column, pa.Array) else column.fill_null(NO_ID).to_numpy()).astype(np.int64)


def first_places(key: np.ndarray, content: np.ndarray, doc: np.ndarray, place: np.ndarray):
    """The phrases in order of key, content and corpus; which begin a run of equals; which come after its first place."""
    at, length, off = unplace(place)
    order = np.lexsort((at, doc, content, key))
    key, content, doc, place, at, length, off = (x[order] for x in (key, content, doc, place, at, length, off))
    same = equals(key, content, length, off)
    return key, content, doc, place, ~same, later(same, doc, at)


def combined(found: list[tuple]) -> pa.RecordBatch:
    """First phrases, and runs of windows of the others, as rows of PHRASES."""
    key, content, doc, place, lead, late = first_places(*(np.concatenate(x) for x in zip(*found)))
    d, a, n = runs(doc[late], *unplace(place[late])[:2])
    back = np.lexsort((place[lead], doc[lead]))  # in corpus order doc and place compress well
    none = np.ones(len(d), bool)
    no = np.concatenate([np.zeros(len(back), bool), none])
    both = lambda x: pa.array(np.concatenate([x[lead][back].view(np.int64), np.zeros(len(d), np.int64)]), mask=no)
    return pa.RecordBatch.from_arrays(
        [pa.array(np.concatenate([doc[lead][back], d])), pa.array(np.concatenate([place[lead][back], a << 32 | n])), both(key), both(content)], names=["doc", "place", "key", "content"]
    )


def parse(docs: DataFrame) -> DataFrame:
    """Phrases of the documents, combined over COMBINED of them. Rows without a key are runs: place is at * 2^32 + windows."""

    def run(batches):
        found, held = [], 0
        for batch in batches:
            ids = ids_of(batch.column("doc_id"))
            data, offsets = texts_of(batch.column("text"))
            i = 0
            while i < len(ids):
                j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + PIECE, "right")) - 1)
                with np.errstate(over="ignore"):
                    key, content, doc, at, length, off = phrases(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                found.append((key, content, ids[i:j][doc], place_of(at, length, off)))
                held += len(key)
                if held >= COMBINED:
                    yield combined(found)
                    found, held = [], 0
                i = j
        if held:
            yield combined(found)

    return docs.mapInArrow(run, PHRASES)


def own_phrases(t: pa.Table) -> pa.Table:
    """Runs of repeated phrases, and edges: first occurrences whose trigger has other phrases too."""
    doc, place, key, content = numbers(t, "doc", "place", "key", "content")
    spread = np.unique(key[np.asarray(t.column("hot").to_numpy())])
    key, content, doc, place, lead, late = first_places(key, content, doc, place)
    hot = np.isin(key, spread)
    d, a, n = runs(doc[late], *unplace(place[late])[:2])
    first = np.flatnonzero(lead)
    counts = np.diff(np.append(np.flatnonzero(~equals(key[first])), len(first))) if len(first) else first
    edge = first[(np.repeat(counts, counts) > 1) | hot[first]]
    no = np.repeat([False, True], [len(edge), len(d)])
    return pa.table({
        "doc": np.concatenate([doc[edge], d]), "place": np.concatenate([place[edge], a << 32 | n]),
        "key": pa.array(np.concatenate([key[edge], np.zeros(len(d), np.int64)]), mask=no), "hot": np.concatenate([hot[edge], np.zeros(len(d), bool)]),
    })


def reached_rows(part: np.ndarray, doc: np.ndarray, place: np.ndarray, key: np.ndarray | None, text: pa.Array | None) -> pa.Table:
    n = len(doc)
    return pa.table({
        "part": part, "doc": doc, "place": place,
        "key": pa.array(key) if key is not None else pa.nulls(n, pa.int64()), "text": text if text is not None else pa.nulls(n, pa.binary()),
    })


def gather(parts: int):
    """For the owners of the triggers the bytes that the edges' windows reach; hashed windows of hot triggers; runs of those that repeat here."""

    def run(docs: pa.Table, edges: pa.Table) -> pa.Table:
        none = np.zeros(0, np.int64)
        if not edges.num_rows or not docs.num_rows:
            return reached_rows(none, none, none, none, None)
        doc, place, key = numbers(edges, "doc", "place", "key")
        is_hot = np.asarray(edges.column("hot").to_numpy())
        ids = ids_of(docs.column("doc_id"))
        data, offsets = texts_of(docs.column("text").combine_chunks())
        order = np.argsort(ids, kind="stable")
        where = order[np.searchsorted(ids[order], doc)]
        at, length, off = unplace(place)
        begin = offsets[where] + at
        fits = begin + length + WINDOW - 1 <= offsets[where + 1]  # another text under a repeated doc_id may be shorter
        doc, place, key, at, length, off, begin, is_hot = (x[fits] for x in (doc, place, key, at, length, off, begin, is_hot))
        cold = ~is_hot
        span = length[cold] + WINDOW - 1
        base = np.concatenate([[0], np.cumsum(span)])
        take = np.repeat(begin[cold] - base[:-1], span) + np.arange(base[-1])
        text = pa.Array.from_buffers(pa.binary(), len(span), [None, pa.py_buffer(base.astype(np.int32)), pa.py_buffer(data[take])])
        tables = [reached_rows(key[cold] % parts, doc[cold], place[cold], key[cold], text)]
        if is_hot.any():
            n = length[is_hot]
            base = np.concatenate([[0], np.cumsum(n)])
            step = np.arange(base[-1]) - np.repeat(base[:-1], n)
            p = np.repeat(begin[is_hot], n) + step
            with np.errstate(over="ignore"):
                hashes = np.zeros(len(p), np.uint64)
                for k in range(WINDOW):
                    hashes = hashes * np.uint64(0x5851F42D4C957F2D) + data[p + k] + np.uint64(1)
                hashes = mix(hashes)
            d, a = np.repeat(doc[is_hot], n), np.repeat(at[is_hot], n) + step
            order = np.lexsort((a, d, hashes))
            d, a, hashes = d[order], a[order], hashes[order].view(np.int64)
            same = equals(hashes)
            late = later(same, d, a)
            run_doc, run_at, run_n = runs(d[late], a[late], np.ones(late.sum(), np.int64))
            tables.append(reached_rows(hashes[~same] % parts, d[~same], a[~same], hashes[~same], None))
            tables.append(reached_rows(run_doc % parts, run_doc, run_at << 32 | run_n, None, None))
        return pa.concat_tables(tables)

    return lambda docs, edges: run(docs, edges)


def suffix_order(matrix: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted order of the suffixes (rows) within their groups, and each one's common prefix with the one before (-1: a new group)."""
    words = matrix.view(">u8").astype(np.uint64)
    order = np.lexsort((*words.T[::-1], group))
    common = np.full(len(order), -1, np.int64)
    for i in range(1, len(order), 1 << 16):
        a, b = order[i : i + (1 << 16)], order[i - 1 : i - 1 + len(order[i : i + (1 << 16)])]
        differ = matrix[a] != matrix[b]
        common[i : i + len(a)] = np.where(group[a] != group[b], -1, np.where(differ.any(1), differ.argmax(1), matrix.shape[1]))
    return order, common


def repeats(doc: np.ndarray, place: np.ndarray, key: np.ndarray, text: np.ndarray, base: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Windows of distinct phrases that another one of their trigger has before them; text[base] on holds the bytes they reach.

    For a window whose trigger is at offset o, its first o bytes are the end of a dictionary phrase and its last
    WINDOW - o the beginning of a suffix of the parse.  Both orders are made once; at each offset a class is a run
    of equal prefixes in the one crossed with a run in the other.
    """
    order = np.lexsort((place, doc))
    doc, place, key, base = (x[order] for x in (doc, place, key, base))
    at, length, off = unplace(place)
    reach = length + WINDOW - 1
    right, left = np.zeros((len(doc), 104), np.uint8), np.zeros((len(doc), 64), np.uint8)
    for k in range(WINDOW):
        ok = off + k < reach
        right[ok, k] = text[(base + off + k)[ok]]
    for k in range(WIDE):
        ok = k < off
        left[ok, k] = text[(base + off - 1 - k)[ok]]
    orders = [suffix_order(right, key), suffix_order(left, key)]
    found_doc, found_at = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for o in range(WIDE):
        here = np.flatnonzero((o <= off) & (off - o < length))
        if len(here) < 2:
            continue
        classes = []
        for (order, common), depth in zip(orders, (WINDOW - o, o)):
            c = np.empty(len(doc), np.int64)
            c[order] = np.cumsum(common < depth)
            classes.append(c[here])
        both = classes[0] * (len(doc) + 1) + classes[1]
        order = np.argsort(both, kind="stable")
        h = here[order]
        d, p = doc[h], at[h] + off[h] - o
        late = later(equals(both[order]), d, p)
        found_doc.append(d[late])
        found_at.append(p[late])
    return np.concatenate(found_doc), np.concatenate(found_at)


def own_windows(t: pa.Table) -> pa.Table:
    """All runs of windows that go, of the reached rows of one part."""
    t = t.combine_chunks()
    doc, place = numbers(t, "doc", "place")
    is_run, has_text = t.column("key").is_null().to_numpy(), t.column("text").is_valid().to_numpy()
    key = t.column("key").fill_null(0).to_numpy()
    out = [(doc[is_run], place[is_run] >> 32, place[is_run] & 0xFFFFFFFF)]
    hashed = np.flatnonzero(~is_run & ~has_text)
    if len(hashed):
        order = hashed[np.lexsort((place[hashed], doc[hashed], key[hashed]))]
        late = order[later(equals(key[order]), doc[order], place[order])]
        out.append((doc[late], place[late], np.ones(len(late), np.int64)))
    if has_text.any():
        column = t.column("text").combine_chunks() if isinstance(t.column("text"), pa.ChunkedArray) else t.column("text")
        column = column.chunk(0) if isinstance(column, pa.ChunkedArray) else column
        base = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column)].astype(np.int64)
        d, p = repeats(doc[has_text], place[has_text], key[has_text], np.frombuffer(column.buffers()[2], np.uint8), base[has_text])
        out.append((d, p, np.ones(len(d), np.int64)))
    d, a, n = runs(*(np.concatenate(x) for x in zip(*out)))
    return table_of(doc=d, at=a, len=n)


def finish(docs: pa.Table, marks: pa.Table) -> pa.Table:
    """What is left of each document."""
    ids = ids_of(docs.column("doc_id"))
    data, offsets = texts_of(docs.column("text").combine_chunks() if docs.num_rows else pa.array([], pa.string()))
    gone = np.zeros(len(data) + 1, np.int32)
    doc, at, length = numbers(marks, "doc", "at", "len") if marks.num_rows else (np.zeros(0, np.int64),) * 3
    if len(doc) and len(ids):
        order = np.argsort(ids, kind="stable")
        lo, hi = np.searchsorted(ids[order], doc, "left"), np.searchsorted(ids[order], doc, "right")
        n = hi - lo
        pick = order[np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(n.sum())]
        begin = np.minimum(offsets[pick] + np.repeat(at, n), offsets[pick + 1])
        end = np.minimum(begin + np.repeat(length, n) + WINDOW - 1, offsets[pick + 1])
        np.add.at(gone, begin, 1)
        np.add.at(gone, end, -1)
    out = np.cumsum(gone[:-1]) > 0
    rise = out.copy()
    rise[1:] &= ~out[:-1]
    edges = offsets[:-1][offsets[:-1] < len(out)]
    rise[edges] = out[edges]
    total, spans = (np.concatenate([[0], np.cumsum(x)]) for x in (out, rise))
    digest = [hashlib.sha256(data[a:b][~out[a:b]].tobytes()).hexdigest() for a, b in zip(offsets, offsets[1:])]
    return pa.table({
        "doc_id": docs.column("doc_id").cast(pa.int64()), "n_bytes": pa.array(np.diff(offsets), pa.int64()), "n_removed": pa.array(np.diff(total[offsets]), pa.int64()),
        "n_spans": pa.array(np.diff(spans[offsets]), pa.int64()), "kept_sha256": pa.array(digest, pa.string()),
    })


def find(docs: DataFrame, ws: Workspace, parts: int, hot_least: int, sample: int) -> dict[str, DataFrame]:
    """The tables on the way: parsed, owned, placed (documents with their part), reached and windows."""
    part = lambda c: F.pmod(c, F.lit(parts))
    home = lambda c: part(F.xxhash64(c))
    parsed = ws.stage(parse(docs), "parsed")
    leads = parsed.where("key is not null")
    often = leads.where(F.pmod("content", F.lit(sample)) == 0).select("key", "content").distinct().groupBy("key").agg(F.count("*").alias("n"))
    hot = ws.stage(often.where(F.col("n") >= max(hot_least // sample, 1)).select("key", F.lit(True).alias("hot")), "hot")
    leads = leads.join(hot, "key", "left").withColumn("hot", F.coalesce("hot", F.lit(False)))
    dealt = leads.select(part(F.when(F.col("hot"), F.col("content")).otherwise(F.col("key"))).alias("part"), "doc", "place", "key", "content", "hot")
    owned = ws.stage(dealt.groupBy("part").applyInArrow(own_phrases, OWNED), "owned")

    placed = docs.select("doc_id", "text", home(F.coalesce("doc_id", F.lit(NO_ID))).alias("part"))
    edges = owned.where("key is not null").withColumn("part", home(F.col("doc")))
    reached = placed.groupBy("part").cogroup(edges.groupBy("part")).applyInArrow(gather(parts), REACHED)
    windows = reached.groupBy("part").applyInArrow(own_windows, MARKS)
    return {"parsed": parsed, "owned": owned, "placed": placed, "reached": reached, "windows": windows}


def removals(docs: DataFrame, part_bytes: int = 2 << 20, hot_least: int = 1 << 16, sample: int = SAMPLE) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every document.

    A part, the unit of an owner's work, holds about part_bytes of text or its phrases; a trigger of more than about
    hot_least distinct phrases is dealt to all parts.
    """
    small_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    parts = (docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // part_bytes + 1
    t = find(docs, Workspace(docs.sparkSession), parts, hot_least, sample)
    run = lambda d: d.where("key is null").select("doc", F.shiftright("place", 32).alias("at"), F.col("place").bitwiseAND(F.lit(0xFFFFFFFF)).alias("len"))
    marks = run(t["parsed"]).unionByName(run(t["owned"])).unionByName(t["windows"])
    marks = marks.withColumn("part", F.pmod(F.xxhash64("doc"), F.lit(parts)))
    return t["placed"].groupBy("part").cogroup(marks.groupBy("part")).applyInArrow(finish, RESULT)

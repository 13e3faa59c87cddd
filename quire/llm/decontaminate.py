"""Benchmark decontamination by q-gram lemma filtering and banded alignment.

Searched for is each stretch of SEGMENT characters of a benchmark text, from every position, and the whole of
a shorter one.  If a document holds a stretch of m characters with at most k edits, the two share at least
m - q + 1 - k q of the stretch's q-grams within k + 1 neighbouring diagonals.  The q-grams of whole items are
indexed; those shared are placed in overlapping diagonal bands of every whole text, and each stretch that
reaches the bound within a band is verified by banded alignment.  Letters are compared in lower case and each
run of white space as one blank.

The benchmark is indexed in blocks of at most ``block_chars`` characters. Documents are read once: a task holds
HELD characters of them and searches those for one block after another.

Defined results: null and empty texts hold nothing; benchmark texts under ``least`` characters are too
short to tell within a text and match only a document whose whole text they are; equal benchmark texts each give their own rows; repeated documents give
repeated rows; an empty benchmark gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import Workspace, give_back, small_batches, texts, without
from quire.llm.near_dedup import mix, powers

Q = 12
SEGMENT = 100
#: Edits allowed for each hundred characters of a segment.
PERCENT = 6
BAND = 16
SLOTS = 20
#: Stretches aligned at once; characters of text held while the blocks of a large benchmark go by.
ALIGNED, HELD = 2048, 1 << 25
_tables: list[tuple[np.ndarray, np.ndarray]] = []


def tables() -> tuple[np.ndarray, np.ndarray]:
    """For each code point: its lower-case form where that is one character, and whether it is white space."""
    if not _tables:
        lower = np.arange(0x110000, dtype=np.uint32)
        for c in range(0x1E944):
            if not 0xD800 <= c < 0xE000 and len(x := chr(c).lower()) == 1:
                lower[c] = ord(x)
        _tables.append((lower, np.fromiter((chr(c).isspace() for c in range(0x3001)), bool, 0x3001)))
    return _tables[0]


def plain(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Folded code points, and where each came from in the text."""
    lower, blank = tables()
    c = lower[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]
    space = (c < len(blank)) & blank[np.minimum(c, len(blank) - 1)]
    keep = ~space
    keep[1:] |= ~space[:-1]
    at = np.flatnonzero(keep)
    return np.where(space, np.uint32(32), c)[at], at


def gram_hashes(c: np.ndarray) -> np.ndarray:
    n = len(c) - Q + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    up, down = powers(len(c) + 1)
    sums = np.zeros(len(c) + 1, np.uint64)
    np.cumsum((c.astype(np.uint64) + np.uint64(1)) * up[: len(c)], out=sums[1:])
    return mix((sums[Q:] - sums[:n]) * down[:n])


@dataclass
class Item:
    """A benchmark text: each stretch of ``size`` characters (SEGMENT, or all of a shorter text) is searched for."""

    item: int | None
    code: np.ndarray
    size: int
    budget: int
    bound: int


class Index:
    """q-grams of one block of benchmark texts."""

    def __init__(self, items: list[tuple[int | None, str | None]], least: int):
        self.items: list[Item] = []
        self.short: dict[bytes, list[int | None]] = {}
        hashes, owners, offsets = [], [], []
        for item, text in items:
            code = plain((text or "").strip())[0]
            if len(code) < max(least, Q):
                if len(code):
                    self.short.setdefault(code.tobytes(), []).append(item)
                continue
            size = min(len(code), SEGMENT)
            budget = size * PERCENT // 100
            while budget and size - Q + 1 - budget * Q < 1:
                budget -= 1
            h = gram_hashes(code)
            hashes.append(h)
            owners.append(np.full(len(h), len(self.items)))
            offsets.append(np.arange(len(h)))
            self.items.append(Item(item, code, size, budget, size - Q + 1 - budget * Q))
        self.hashes = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
        order = np.argsort(self.hashes, kind="stable")
        self.hashes = self.hashes[order]
        self.owners = np.concatenate(owners)[order] if owners else np.zeros(0, np.int64)
        self.offsets = np.concatenate(offsets)[order] if offsets else np.zeros(0, np.int64)
        self.slots = np.zeros(1 << SLOTS, bool)
        self.slots[self.hashes >> np.uint64(64 - SLOTS)] = True
        self.bounds = np.array([x.bound for x in self.items], np.int64)
        self.sizes = np.array([x.size for x in self.items], np.int64)
        self.lengths = np.array([len(x.code) for x in self.items], np.int64)
        self.most = max([x.budget for x in self.items], default=0)
        self.longest = -(-max([len(x.code) for x in self.items], default=0) // BAND) * BAND

    def bands(self, c: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(item, first diagonal, start in the item) of the stretches that reach their bound in a band."""
        none = np.zeros(0, np.int64)
        h = gram_hashes(c)
        at = np.flatnonzero(self.slots[h >> np.uint64(64 - SLOTS)])
        if not len(at):
            return none, none, none
        lo, hi = np.searchsorted(self.hashes, h[at], "left"), np.searchsorted(self.hashes, h[at], "right")
        n = hi - lo
        if not n.any():
            return none, none, none
        first = np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        offset = self.offsets[first]
        diagonal = np.repeat(at, n) - offset + self.longest
        width = len(c) // BAND + self.longest // BAND + 3
        key = self.owners[first] * width + diagonal // BAND + 1
        again = diagonal % BAND < self.most
        key, offset = np.concatenate([key, key[again] - 1]), np.concatenate([offset, offset[again]])
        order = np.lexsort((offset, key))
        key, offset = key[order], offset[order]
        fresh = np.ones(len(key), bool)
        fresh[1:] = (key[1:] != key[:-1]) | (offset[1:] != offset[:-1])
        key, offset = key[fresh], offset[fresh]
        # a stretch from s has its bound if that many offsets of its band lie in s .. s + size - Q
        owner = key // width
        last = np.arange(len(key)) + self.bounds[owner] - 1
        end = np.minimum(last, len(key) - 1)
        good = np.flatnonzero((last < len(key)) & (key[end] == key) & (offset[end] - offset <= self.sizes[owner] - Q))
        if not len(good):
            return none, none, none
        key, owner = key[good], owner[good]
        low = np.maximum(offset[end[good]] - self.sizes[owner] + Q, 0)
        high = np.minimum(offset[good], self.lengths[owner] - self.sizes[owner])
        low[1:] = np.where(key[1:] == key[:-1], np.maximum(low[1:], high[:-1] + 1), low[1:])
        n = np.maximum(high - low + 1, 0)
        start = np.repeat(low - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        return np.repeat(owner, n), np.repeat((key % width - 1) * BAND - self.longest, n), start

    def search(self, text: str) -> list[tuple[int | None, int, int, int]]:
        """(item, start, end, edits) of each region of the text: code points, regions of one item merged."""
        if self.short:
            bare = text.strip()
            begin = text.find(bare)
            if bare and (items := self.short.get(plain(bare)[0].tobytes())):
                return [(item, begin, begin + len(bare), 0) for item in items]
        if len(text) < Q or not self.items:
            return []
        with np.errstate(over="ignore"):
            c, at = plain(text)
            owners, diagonals, starts = self.bands(c)
        regions: dict[int | None, list[tuple[int, int, int]]] = {}
        left: dict[tuple[int, int], list[tuple[int, int, int]]] = {}
        whole, codes = c.tobytes(), {int(k): self.items[k].code.tobytes() for k in np.unique(owners)}
        for k, diagonal, s in zip(owners.tolist(), diagonals.tolist(), starts.tolist()):
            x = self.items[k]
            first = s + diagonal - x.budget
            exact = whole.find(codes[k][4 * s : 4 * (s + x.size)], 4 * max(first, 0), 4 * max(first + BAND + self.most + 2 * x.budget + x.size, 0))
            if exact >= 0 and exact % 4 == 0:
                regions.setdefault(x.item, []).append((int(at[exact // 4]), int(at[exact // 4 + x.size - 1]) + 1, 0))
            else:
                left.setdefault((x.size, x.budget), []).append((k, s, s + diagonal))
        for (size, budget), places in left.items():
            for b in range(0, len(places), ALIGNED):
                part = places[b : b + ALIGNED]
                patterns = np.stack([self.items[k].code[s : s + size] for k, s, _ in part])
                for (k, _, _), found in zip(part, align_all(patterns, c, budget, np.array([d for *_, d in part]), BAND + self.most)):
                    if found:
                        start, end, edits = found
                        regions.setdefault(self.items[k].item, []).append((int(at[start]), int(at[end - 1]) + 1, edits))
        out = []
        for item, parts in regions.items():
            parts.sort()
            start, end, edits = parts[0]
            for a, b, e in parts[1:]:
                if a > end:
                    out.append((item, start, end, edits))
                    start, end, edits = a, b, e
                end, edits = max(end, b), min(edits, e)
            out.append((item, start, end, edits))
        return out


def align(pattern: np.ndarray, region: np.ndarray, budget: int, first: int, wide: int) -> tuple[int, int, int] | None:
    """(start, end, edits) of the best place of the pattern in the region within the band, if its edits are within the budget."""
    exact = region.tobytes().find(pattern.tobytes())
    if exact >= 0 and exact % 4 == 0:
        return exact // 4, exact // 4 + len(pattern), 0
    return align_all(pattern[None], region, budget, np.array([first]), wide)[0]


def align_all(patterns: np.ndarray, text: np.ndarray, budget: int, first: np.ndarray, wide: int) -> list[tuple[int, int, int] | None]:
    """What ``align`` finds of each row of the patterns, in the band of its own first diagonal of the text."""
    out: list[tuple[int, int, int] | None] = [None] * len(patterns)
    end, edits = _ends(patterns, text, budget, first, wide)
    good = np.flatnonzero(edits <= budget)
    if len(good):
        back, _ = _ends(patterns[good, ::-1], text, budget, np.zeros(len(good), np.int64), 1, end[good])
        for i, n in zip(good, back):
            out[i] = (int(end[i] - n), int(end[i]), int(edits[i]))
    return out


def _ends(patterns: np.ndarray, text: np.ndarray, budget: int, first: np.ndarray, wide: int, before: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(end, edits) of each row: least edits over diagonals first - budget to first + wide + budget; with ``before``, anchored there and read backwards."""
    m, patterns = patterns.shape[1], patterns.astype(np.int32)
    width = wide + 2 * budget + 1
    step = np.arange(width, dtype=np.int32)
    lo = first - budget
    limit = np.full(len(patterns), len(text)) if before is None else before
    big = np.int32(m + width)
    # characters of the band: row i of the alignment compares column j with at[:, i - 1 + step]
    j = lo[:, None] + np.arange(m + width)
    inside = (j >= 0) & (j < limit[:, None])
    at = j if before is None else limit[:, None] - 1 - j
    chars = np.where(inside, text[np.where(inside, at, 0)].astype(np.int32), np.int32(-1))
    j = lo[:, None] + step
    row = np.where((j >= 0) & (j <= limit[:, None]), 0 if before is None else np.abs(j), big).astype(np.int32)
    for i in range(1, m + 1):
        c = chars[:, i - 1 : i - 1 + width]
        new = np.where(c < 0, big, row + (c != patterns[:, i - 1 : i]))
        np.minimum(new[:, :-1], row[:, 1:] + 1, out=new[:, :-1])
        edge = -lo - i
        at_edge = np.flatnonzero((edge >= 0) & (edge < width))
        new[at_edge, edge[at_edge]] = i
        row = np.minimum.accumulate(new - step, axis=1) + step
        over = limit - lo - i + 1  # the first column beyond the text
        if over.min() < width:
            row[step >= over[:, None]] = big
    k = row.argmin(1)
    return lo + m + k, row[np.arange(len(row)), k]


def leaks(docs: DataFrame, benchmark: DataFrame, least: int = 24, block_chars: int = 2_000_000) -> DataFrame:
    """doc_id, item_id, start_char, end_char, edits: one row for each region of a document that holds a benchmark text."""
    small_batches(docs.sparkSession)
    spark = docs.sparkSession
    items = benchmark.select("item_id", "text").where("text is not null").distinct()
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, -(-2 * total // block_chars))
    schema = f"doc_id {dict(docs.dtypes)['doc_id']}, item_id {dict(benchmark.dtypes)['item_id']}, start_char bigint, end_char bigint, edits bigint"
    packed = [spark.sparkContext.broadcast([tuple(r) for r in items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).sort("item_id", "text").collect()]) for b in range(blocks)]

    def run(batches):
        index = Index(packed[0].value, least) if blocks == 1 else None

        def search(held):
            for block in packed:
                look = index or Index(block.value, least)
                for batch in held:
                    found = [(i, *x) for i, t in enumerate(texts(batch)) for x in look.search(t)]
                    if found:
                        at, item, start, end, edits = zip(*found)
                        yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(at)), pa.array(item, pa.int64()), pa.array(start, pa.int64()), pa.array(end, pa.int64()), pa.array(edits, pa.int64())], names=["doc_id", "item_id", "start_char", "end_char", "edits"])

        held, chars = [], 0
        for batch in batches:
            held.append(batch)
            chars += batch.nbytes
            if index or chars >= HELD:
                yield from search(held)
                held, chars = [], 0
        yield from search(held)
        held = index = None
        give_back()

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def keep_clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that hold no benchmark text, in the columns they came with."""
    gone = Workspace(docs.sparkSession).stage(leaks(docs, benchmark).select("doc_id").where("doc_id is not null").distinct(), "gone")
    return without(docs, gone, gone.count())

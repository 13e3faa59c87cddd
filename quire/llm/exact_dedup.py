"""Exact dedup by an extendible-hash index on shared files.

A directory of 2^depth slots points from the first bits of a key to buckets; a bucket with more than
``capacity`` keys splits on its next bit, and the directory doubles when that bit is beyond its depth.  The
directory is made from counts of keys by prefix, refined only where a bucket is still too full, so it goes as
deep as it must, up to DEEPEST bits; keys that agree in all bits stay together as a chain.

Each index entry is a text on its way: (bucket, key, text, largest doc_id, number).  Copies are combined a batch
before anything moves, and the bytes of a text move only if its key is met twice.  Owner tasks take whole buckets,
sorted by key, and walk them as a stream: the chain of the key at hand holds its distinct texts, each compared
byte by byte, so an owner's memory is one chain, however many copies pass.  They write the index, one file set a
bucket, in the shared folder.  Documents look their text up by (bucket, key, digest).  Groups with so large a
share of the rows that there can't be many of them - at most HOT - are looked up without a shuffle.

Defined results: a null text counts as empty, and all empty texts are equal; of equal texts the largest
doc_id stays; rows that share that doc_id are all kept; a null doc_id stays only in a group without any
other id; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from quire.llm.common import Workspace, bitmap, fold, in_bitmap, small_batches, without

HASH_BITS = 63
#: A group is hot if it has more than one in HOT of all rows; so there are fewer than HOT of them.
HOT = 10_000
#: Bytes of distinct repeated texts that a task holds to combine their copies.
HELD = 16 << 20
#: Slots of the directory grow with the keys; beyond so many the capacity of a bucket does instead.
SLOTS = 1 << 18
#: Bits that a directory looks at, at most. Keys that agree in all of them share a bucket over its capacity: owners read it as a stream like any other.
DEEPEST = 22
ENTRY = "bucket bigint, key bigint, sha string, folded string, keep_id {id}, n bigint"
INDEX = "bucket bigint, key bigint, sha string, keep_id {id}, group_size bigint"


class Directory:
    """Slots of (prefix, local depth), 2^depth of them, made by doubling."""

    def __init__(self, count: Callable[[list[int], int, int], dict[int, int]], bits: int, capacity: int, start: int = 8, step: int = 8):
        """``count(prefixes, local, known)``: keys by their first ``known`` bits, of those below the prefixes of ``local`` bits."""
        self.depth, self.slots = 0, [(0, 0)]
        known, full = 0, [(0, 0)]
        while full and known < bits:
            deeper = min(known + (step if known else start), bits)
            counts = sorted(count([p for p, _ in full], known, deeper).items())
            known = deeper
            below = np.concatenate([[0], np.cumsum([n for _, n in counts])])
            firsts = np.array([p for p, _ in counts], np.int64)
            rank = lambda prefix, local: below[np.searchsorted(firsts, prefix << known - local)]  # noqa: B023, E731
            over = lambda prefix, local: rank(prefix + 1, local) - rank(prefix, local) > capacity  # noqa: B023, E731
            todo, full = [x for x in full if over(*x)], []
            while todo:
                prefix, local = todo.pop()
                if local == known:
                    full.append((prefix, local))
                    continue
                self._split(prefix, local)
                todo += [(p, local + 1) for p in (2 * prefix, 2 * prefix + 1) if over(p, local + 1)]

    def _split(self, prefix: int, local: int) -> None:
        if local == self.depth:
            self.slots = [s for s in self.slots for _ in range(2)]
            self.depth += 1
        for i in range(prefix << self.depth - local, prefix + 1 << self.depth - local):
            self.slots[i] = (i >> self.depth - local - 1, local + 1)

    def firsts(self) -> np.ndarray:
        """The first key of the bucket of each slot, which names the bucket."""
        return np.array([p << HASH_BITS - local for p, local in self.slots], np.int64)


def _entries(firsts: np.ndarray, depth: int, id_type: pa.DataType):
    """Rows (key, sha, folded, doc_id, n) as index entries, each with its bucket: equal texts are combined while HELD bytes hold them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple[int, str], list] = {}
        held = 0

        def flush() -> pa.RecordBatch:
            rows = list(found.values())
            key = np.array([r[0] for r in rows], np.int64)
            bucket = firsts[key >> HASH_BITS - depth] if depth else np.zeros(len(key), np.int64)
            return pa.RecordBatch.from_arrays(
                [pa.array(bucket), pa.array(key), *(pa.array([r[c] for r in rows], t) for c, t in ((1, pa.string()), (2, pa.string()), (3, id_type), (4, pa.int64())))],
                names=["bucket", "key", "sha", "folded", "keep_id", "n"],
            )

        for batch in batches:
            for key, sha, text, i, n in zip(*(batch.column(c).to_pylist() for c in ("key", "sha", "folded", "doc_id", "n"))):
                name = (key, sha if text is None else text)
                if name not in found:
                    found[name] = [key, sha, text, i, 0]
                    held += 200 + len(name[1])
                entry = found[name]
                entry[3] = _later(entry[3], i)
                entry[4] += n
            if held >= HELD:
                yield flush()
                found, held = {}, 0
        if found:
            yield flush()

    return run


def _later(a, b):
    return b if a is None else a if b is None else max(a, b)


def _own(id_type: pa.DataType):
    """Walks entries sorted by bucket and key; the chain of one key is held at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["bucket", "key", "sha", "keep_id", "group_size"]
        types = [pa.int64(), pa.int64(), pa.string(), id_type, pa.int64()]
        place, chain, done = None, [], []
        flush = lambda: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done), types)], names=names)

        def close():
            # a key that is met once has an entry without bytes; the bitmap may have sent the same text with its bytes
            links = [x for x in chain if x[0] is not None] or chain
            for text, sha, keep, n in links:
                done.append((*place, hashlib.sha256(text.encode()).hexdigest() if sha is None else sha, keep, n))

        for batch in batches:
            for bucket, key, sha, text, keep, n in zip(*(c.to_pylist() for c in batch.columns)):
                if (bucket, key) != place:
                    if place is not None:
                        close()
                    place, chain = (bucket, key), []
                for link in chain:
                    if link[0] == text and (text is not None or link[1] == sha):
                        link[2] = _later(link[2], keep)
                        link[3] += n
                        break
                else:
                    chain.append([text, sha, keep, n])
            if len(done) >= 10_000:
                yield flush()
                done = []
        if place is not None:
            close()
        if done:
            yield flush()

    return run


def build_index(docs: DataFrame, ws: Workspace, capacity: int = 16_384, hash_bits: int = HASH_BITS) -> tuple[DataFrame, DataFrame, Directory]:
    """(prints, index, directory) of doc_id and text. The index has a row for each distinct text: bucket, key, sha, keep_id, group_size."""
    small_batches(docs.sparkSession)
    id_field = docs.select("doc_id").schema.fields[0]
    id_type, id_name = to_arrow_type(id_field.dataType), id_field.dataType.simpleString()
    text = fold(F.col("text"))
    mask = F.lit((1 << hash_bits) - 1 << HASH_BITS - hash_bits)
    prints = ws.stage(docs.select("doc_id", F.xxhash64(text).bitwiseAND(mask).alias("key"), F.sha2(text, 256).alias("sha")), "prints")
    keys = ws.stage(prints.groupBy("key").agg(F.max("doc_id").alias("doc_id"), F.count("*").alias("n"), F.max("sha").alias("sha")), "keys")
    totals = keys.agg(F.count("*").alias("n"), F.sum(F.when(F.col("n") > 1, 1).otherwise(0)).alias("again")).first()

    def count(prefixes: list[int], local: int, bits: int) -> dict[int, int]:
        some = keys if not local else keys.where(F.shiftright("key", HASH_BITS - local).isin(prefixes))
        return {r["p"]: r["n"] for r in some.groupBy(F.shiftright("key", HASH_BITS - bits).alias("p")).agg(F.count("*").alias("n")).collect()}

    capacity = max(capacity, totals["n"] // SLOTS)
    directory = Directory(count, min(hash_bits, DEEPEST), capacity, max(8, (totals["n"] // capacity).bit_length() + 2))
    entries = _entries(directory.firsts(), directory.depth, id_type)

    once = keys.where("n = 1").select("key", "sha", F.lit(None).cast("string").alias("folded"), "doc_id", "n")
    whole = docs.select("doc_id", text.alias("folded")).withColumn("key", F.xxhash64("folded").bitwiseAND(mask))
    met = in_bitmap(whole, "key", bitmap(keys.where("n > 1").select("key"), "key", totals["again"] or 0))
    met = met.select("key", F.lit(None).cast("string").alias("sha"), "folded", "doc_id", F.lit(1).cast("bigint").alias("n"))
    found = once.mapInArrow(entries, ENTRY.format(id=id_name)).unionByName(met.mapInArrow(entries, ENTRY.format(id=id_name)))
    index = found.repartition("bucket").sortWithinPartitions("bucket", "key").mapInArrow(_own(id_type), INDEX.format(id=id_name))
    return prints, ws.stage(index, "index", by="bucket"), directory


def groups(docs: DataFrame, hash_bits: int = HASH_BITS, capacity: int = 16_384) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 of every document."""
    ws = Workspace(docs.sparkSession)
    prints, index, _ = build_index(docs.select("doc_id", "text"), ws, capacity, hash_bits)
    ws.drop("keys")
    index = index.select("key", "sha", "keep_id", "group_size")
    least = (prints.count() // HOT) + 1
    hot = F.broadcast(index.where(F.col("group_size") >= least).withColumnsRenamed({"keep_id": "hot_id", "group_size": "hot_size"}))
    told = prints.join(hot, ["key", "sha"], "left")
    found = told.where("hot_size is null").select("doc_id", "key", "sha").join(index.where(F.col("group_size") < least), ["key", "sha"]).select("doc_id", "keep_id", "group_size", "sha")
    found = found.unionByName(told.where("hot_size is not null").select("doc_id", F.col("hot_id").alias("keep_id"), F.col("hot_size").alias("group_size"), "sha"))
    return found.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.col("sha").alias("text_sha256"))


def keep_one(docs: DataFrame) -> DataFrame:
    """The documents that stay, in the columns they came with."""
    ws = Workspace(docs.sparkSession)
    found = ws.stage(groups(docs).where("doc_id is not null").groupBy("doc_id").agg(F.max("kept").alias("kept")), "kept")
    gone = found.where("not kept").select("doc_id")
    return without(docs, gone, gone.count())


ORACLE = """
WITH t AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS folded FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id IS NOT DISTINCT FROM max(doc_id) OVER w AS kept, sha256(folded) AS text_sha256
FROM t WINDOW w AS (PARTITION BY folded)
"""

"""Byte-level BPE encoding and decoding with a segment tree over adjacent pair ranks.

The leaves of the tree hold ``rank * size + position`` of each adjacent pair, so its root is the leftmost
pair of lowest rank.  A merge updates at most three leaves, each in logarithmic time, until the root says that
no pair can merge.  Pieces of all lengths go through the same tree.  Words between blanks repeat, so their ids
are kept in a bounded table.

Nulls and empty texts give no ids (n_tokens 0 and the hashes of the empty string); repeated rows give
equal rows; special tokens written in a text become their ids, as the public library does it.
"""

from __future__ import annotations

import hashlib
import json
import re

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from quire.llm.common import map_batches, small_batches, texts

#: Unicode White_Space, and the pre-tokenizer's pattern of the vocabulary file.
BLANK = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
PIECES = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{BLANK}\p{{L}}\p{{N}}]+|[{BLANK}]+(?![^{BLANK}])|[{BLANK}]+"
CHUNKS = rf" ?[^{BLANK}]+|[{BLANK}]+(?![^{BLANK}])|[{BLANK}]+"

NONE = 1 << 62
#: Leaves of the trees that are worked on together; characters of text whose new words are; length from which a word isn't kept.
TREES, TOGETHER, LONG = 1 << 16, 1 << 20, 64


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte: itself if visible in Latin-1, else the next free one from 256."""
    seen = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in seen else chr(next(spare)) for b in range(256)]


class Codec:
    def __init__(self, path: str, keep: int = 200_000):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_letters()
        back = {c: b for b, c in enumerate(letters)}
        vocab = spec["model"]["vocab"]
        self.bytes_of = {i: bytes(back[c] for c in t) for t, i in vocab.items()}
        self.added = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.bytes_of |= {i: t.encode() for t, i in self.added.items()}
        self.of_text = {str(i): b for i, b in self.bytes_of.items()}
        self.first = np.array([vocab[c] for c in letters], np.int64)
        merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        keys = np.array([vocab[a] << 20 | vocab[b] for a, b in merges], np.int64)
        self.rank = np.argsort(keys, kind="stable")
        self.keys = keys[self.rank]
        self.merged = np.array([vocab[a + b] for a, b in merges], np.int64)
        self.split_added = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        self.pieces, self.chunks = regex.compile(PIECES), re.compile(CHUNKS)
        self.keep, self.of_piece, self.of_chunk = keep, {}, {}

    def leaves(self, left: np.ndarray, right: np.ndarray, at: np.ndarray, bits: int) -> np.ndarray:
        """Rank and below it the position of each pair, NONE if it can't merge (a symbol of -1 is none)."""
        key = left << 20 | right
        k = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((self.keys[k] == key) & (left >= 0) & (right >= 0), self.rank[k] << bits | at, NONE)

    def merge(self, pieces: list[bytes]) -> list[list[int]]:
        """Ids of each piece. Pieces whose trees have one size are worked on together, a row of the arrays each."""
        out: list[list[int]] = [[]] * len(pieces)
        sized: dict[int, list[int]] = {}
        for p, data in enumerate(pieces):
            if len(data) < 2:
                out[p] = [int(self.first[x]) for x in data]
            else:
                sized.setdefault((len(data) - 2).bit_length(), []).append(p)
        for bits, these in sized.items():
            together = max(1, TREES >> bits)
            for i in range(0, len(these), together):
                rows = these[i : i + together]
                for p, ids in zip(rows, self.merge_trees([pieces[p] for p in rows], bits)):
                    out[p] = ids
        return out

    def merge_trees(self, pieces: list[bytes], bits: int) -> list[list[int]]:
        """A segment tree for each piece, of 2^bits leaves: node k is the least of the nodes 2 k and 2 k + 1, and the leaf of the
        pair at position i is node 2^bits + i. So the root, node 1, names the leftmost pair of lowest rank."""
        size, many = 1 << bits, len(pieces)
        n = np.array([len(p) for p in pieces])
        sym = np.full((many, size + 2), -1, np.int64)
        sym[np.arange(size + 2) < n[:, None]] = self.first[np.frombuffer(b"".join(pieces), np.uint8)]
        tree = np.full((many, 2 * size), NONE, np.int64)
        tree[:, size:] = self.leaves(sym[:, :size], sym[:, 1 : size + 1], np.arange(size), bits)
        low = size
        while low > 1:
            low >>= 1
            tree[:, low : 2 * low] = np.minimum(tree[:, 2 * low : 4 * low : 2], tree[:, 2 * low + 1 : 4 * low : 2])
        # symbols are linked to their neighbours; positions 0 and size + 1 of the links and symbols beyond a piece are never symbols
        after = np.minimum(np.arange(1, size + 3), size + 1)[None].repeat(many, 0)
        before = np.arange(-1, size + 1)[None].repeat(many, 0)
        row = np.arange(many)
        while True:
            root = tree[row, 1]
            if (done := root == NONE).any():
                row, root = row[~done], root[~done]
            if not len(row):
                break
            i = root & size - 1
            j = after[row, i]
            k = after[row, j]
            h = before[row, i]
            new = self.merged[root >> bits]
            sym[row, i], sym[row, j] = new, -1
            after[row, i], before[row, k] = k, i
            first = np.flatnonzero(h >= 0)
            last = np.flatnonzero(j < size)
            paths = [(row[last], j[last] + size), (row, i + size), (row[first], h[first] + size)]
            tree[paths[0]] = NONE
            tree[paths[1]] = self.leaves(new, sym[row, k], i, bits)
            tree[paths[2]] = self.leaves(sym[row[first], h[first]], new[first], h[first], bits)
            for _ in range(bits):
                paths = [(r, node >> 1) for r, node in paths]
                for r, node in paths:
                    tree[r, node] = np.minimum(tree[r, 2 * node], tree[r, 2 * node + 1])
        left = sym >= 0
        ends = np.cumsum(left.sum(1))
        flat = sym[left].tolist()
        return [flat[e - c : e] for e, c in zip(ends.tolist(), left.sum(1).tolist())]

    def learn(self, chunks: set[str]) -> None:
        """Puts the ids of these chunks, as text, into the table of chunks."""
        words = [c for c in chunks if c.isascii() and (c.isalpha() or c[0] == " " and c[1:].isalpha())]  # a piece each
        pieces = {c: self.pieces.findall(c) for c in chunks.difference(words)}
        of_piece, of_chunk = self.of_piece, self.of_chunk
        new = sorted({p for found in pieces.values() for p in found}.difference(of_piece))
        made = [",".join(map(str, ids)) for ids in self.merge([p.encode() for p in [*words, *new]])]
        of_chunk.update(zip(words, made))
        of_piece.update(zip(new, made[len(words) :]))
        for c, found in pieces.items():
            of_chunk[c] = of_piece[found[0]] if len(found) == 1 else ",".join(map(of_piece.__getitem__, found))
        for p in new:
            if len(p) >= LONG:
                del of_piece[p]

    def ids_texts(self, texts: list[str]) -> list[str]:
        """Decimal ids joined by commas, of each text. The tables are bounded: full, they start anew, and long entries aren't kept."""
        out: list[str] = []
        at = 0
        while at < len(texts):
            end, chars = at, 0
            while end < len(texts) and (end == at or chars + len(texts[end]) <= TOGETHER):
                chars += len(texts[end])
                end += 1
            parts = [[x if x in self.added else self.chunks.findall(x) for x in (self.split_added.split(t) if self.split_added else [t])] for t in texts[at:end]]
            known = self.of_chunk
            for table in (self.of_chunk, self.of_piece):
                if len(table) > self.keep:
                    table.clear()
            new = set().union(*(x for t in parts for x in t if not isinstance(x, str))).difference(known)
            self.learn(new)
            for t in parts:
                out.append(",".join(str(self.added[x]) if isinstance(x, str) else ",".join(map(known.__getitem__, x)) for x in t if x))
            for x in new:
                if len(x) >= LONG:
                    del known[x]
            at = end
        return out

    def encode(self, text: str) -> list[int]:
        joined = self.ids_texts([text])[0]
        return [int(x) for x in joined.split(",")] if joined else []

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")

    def decode_text(self, joined: str) -> str:
        return b"".join(map(self.of_text.__getitem__, joined.split(","))).decode("utf-8", "replace") if joined else ""


_codecs: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    if path not in _codecs:
        _codecs[path] = Codec(path)
    return _codecs[path]


def encode_documents(docs: DataFrame, path: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row a document: its id, ``ids`` (array of int) and ``decoded`` (the text that the ids give back)."""
    small_batches(docs.sparkSession)

    def start():
        c = codec(path)

        def one(batch: pa.RecordBatch) -> dict:
            ids = [[int(x) for x in joined.split(",")] if joined else [] for joined in c.ids_texts(texts(batch))]
            return {"doc_id": batch.column("doc_id"), "ids": pa.array(ids, pa.list_(pa.int32())), "decoded": pa.array([c.decode(x) for x in ids], pa.string())}

        return one

    return map_batches(docs.selectExpr(f"{id_column} as doc_id", f"{text_column} as text"), start, f"doc_id {dict(docs.dtypes)[id_column]}, ids array<int>, decoded string")


def token_digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every whole text."""
    small_batches(docs.sparkSession)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()

    def start():
        c = codec(path)

        def one(batch: pa.RecordBatch) -> dict:
            n, ids, back = [], [], []
            for joined in c.ids_texts(texts(batch)):
                n.append(joined.count(",") + 1 if joined else 0)
                ids.append(sha(joined))
                back.append(sha(c.decode_text(joined)))
            return {"doc_id": batch.column("doc_id"), "n_tokens": pa.array(n, pa.int64()), "ids_sha256": pa.array(ids, pa.string()), "decoded_sha256": pa.array(back, pa.string())}

        return one

    return map_batches(docs.select("doc_id", "text"), start, f"doc_id {dict(docs.dtypes)['doc_id']}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")


def token_rows(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, lang, source, n_tokens, ids, round_trip (the ids decode to the text) of every whole text."""
    small_batches(docs.sparkSession)

    def start():
        c = codec(path)

        def one(batch: pa.RecordBatch) -> dict:
            ids, same = [], []
            whole = texts(batch)
            for t, joined in zip(whole, c.ids_texts(whole)):
                ids.append(np.array(joined.split(",") if joined else [], np.int32))
                same.append(c.decode_text(joined) == t)
            n = np.array([len(x) for x in ids], np.int64)
            packed = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32)), pa.array(np.concatenate([np.zeros(0, np.int32), *ids])))
            return {"doc_id": batch.column("doc_id"), "lang": batch.column("lang"), "source": batch.column("source"), "n_tokens": pa.array(n), "ids": packed, "round_trip": pa.array(same, pa.bool_())}

        return one

    return map_batches(docs.select("doc_id", "lang", "source", "text"), start, f"doc_id {dict(docs.dtypes)['doc_id']}, lang string, source string, n_tokens bigint, ids array<int>, round_trip boolean")

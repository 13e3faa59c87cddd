"""Language ID: sparse multinomial logistic regression on TF-IDF character n-grams.

Document frequencies are counted over every learnable row.  The weights are fitted with
follow-the-regularised-leader (per-coordinate rates, elastic-net penalty) on a sample of at most 2 ``per_language``
rows of each language and ``sample`` rows in all, chosen by a hash of the row: two thirds fit the weights, a third
sets the temperature that calibrates the scores.  Every language that is met is learned; the weights are as large
as the languages are many.  Prediction reads whole texts.

Defined results: a null text, or one without a letter, gives ``und`` with score 0; so does every text
where nothing could be learned (empty tables, no language known).  Rows with a null doc_id are predicted
but never learned from.  Repeated rows give equal rows; a tie goes to the language first in order.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.common import fold_of, give_back, map_batches, small_batches, texts

BITS = 14
SIZE = 1 << BITS
UNKNOWN = "und"
_K = [np.uint32(k) for k in (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D)]
_letters: list[np.ndarray] = []


def letters() -> np.ndarray:
    if not _letters:
        _letters.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))
    return _letters[0]


def grams(text: str) -> tuple[np.ndarray, np.ndarray] | None:
    """Hashed 1- to 3-grams of the letters, each run of others as one blank: slots and counts. None without a letter."""
    at = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    is_letter = letters()[at]
    if not is_letter.any():
        return None
    keep = is_letter.copy()
    keep[1:] |= is_letter[:-1]
    c = np.where(is_letter, at, 32)[keep].astype(np.uint32)
    c = np.concatenate([np.array([32], np.uint32), c])
    one = c * _K[0]
    two = one[:-1] + c[1:] * _K[1]
    three = two[:-1] + c[2:] * _K[2]
    slots = np.concatenate([(g ^ g >> np.uint32(15)) * np.uint32(0x2C1B3C6D) + np.uint32(n) >> np.uint32(32 - BITS) for n, g in enumerate((one, two, three))])
    counts = np.bincount(slots, minlength=SIZE)
    found = np.flatnonzero(counts)
    return found, counts[found]


@dataclass
class Model:
    langs: list[str]
    idf: np.ndarray
    weights: np.ndarray
    temperature: float

    def vector(self, found: np.ndarray, counts: np.ndarray) -> np.ndarray:
        x = np.log1p(counts) * self.idf[found]
        return x / max(np.sqrt(x @ x), 1e-12)

    def logits(self, found: np.ndarray, counts: np.ndarray) -> np.ndarray:
        return self.vector(found, counts) @ self.weights[found]

    def predict(self, text: str) -> tuple[str, float]:
        g = grams(text) if self.langs else None
        if g is None:
            return UNKNOWN, 0.0
        p = softmax(self.logits(*g) / self.temperature)
        k = int(p.argmax())
        return self.langs[k], float(p[k])


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max())
    return e / e.sum()


def ftrl(model: Model, rows: list[tuple[np.ndarray, np.ndarray, int]], epochs: int = 3, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.02, l2: float = 0.02) -> None:
    """Follow-the-regularised-leader with elastic net, one row at a time in the order given."""
    z, n = np.zeros_like(model.weights), np.zeros_like(model.weights)
    for _ in range(epochs):
        for found, counts, k in rows:
            x = model.vector(found, counts)
            zi, ni = z[found], n[found]
            w = np.where(np.abs(zi) > l1, -(zi - np.sign(zi) * l1) / ((beta + np.sqrt(ni)) / alpha + l2), 0.0)
            g = softmax(x @ w)
            g[k] -= 1
            g = x[:, None] * g
            grown = ni + g * g
            z[found] = zi + g - (np.sqrt(grown) - np.sqrt(ni)) / alpha * w
            n[found] = grown
    model.weights = np.where(np.abs(z) > l1, -(z - np.sign(z) * l1) / ((beta + np.sqrt(n)) / alpha + l2), 0.0)


def calibrate(model: Model, rows: list[tuple[np.ndarray, np.ndarray, int]]) -> None:
    """The temperature of least log loss on rows that the weights weren't fitted on."""
    if not rows:
        return
    z = np.array([model.logits(f, c) for f, c, _ in rows])
    y = np.array([k for *_, k in rows])

    def loss(t: float) -> float:
        s = z / t
        s = s - s.max(1, keepdims=True)
        return float((np.log(np.exp(s).sum(1)) - s[np.arange(len(y)), y]).mean())

    model.temperature = min(np.geomspace(0.02, 5, 60), key=loss)


def fit(docs: DataFrame, per_language: int = 300, sample: int = 200_000) -> Model:
    """docs: doc_id, text, lang of the rows to learn from. At most 2 per_language rows of a language reach the driver, and ``sample`` in all or a row of each."""
    small_batches(docs.sparkSession)
    docs = docs.where("lang is not null and doc_id is not null and text is not null").select("doc_id", "text", "lang")
    sizes = {r["lang"]: r["n"] for r in docs.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    langs = sorted(sizes)
    model = Model(langs, np.ones(SIZE), np.zeros((SIZE, len(langs))), 1.0)
    if not langs:
        return model

    def count():
        def one(batch: pa.RecordBatch) -> dict:
            df, n = np.zeros(SIZE, np.int64), 0
            for t in texts(batch):
                if g := grams(t):
                    df[g[0]] += 1
                    n += 1
            return {"slot": pa.array([*range(SIZE), -1], pa.int32()), "df": pa.array([*df.tolist(), n], pa.int64())}

        return one

    counted = dict(map_batches(docs.select("text"), count, "slot int, df bigint").groupBy("slot").agg(F.sum("df").alias("df")).collect())
    total = counted.pop(-1, 0) or 0
    df = np.zeros(SIZE)
    df[list(counted)] = list(counted.values())
    model.idf = np.log((1 + total) / (1 + df)) + 1

    spread, most = 1 << 40, max(1, min(2 * per_language, sample // len(langs)))
    share = docs.sparkSession.createDataFrame([(lang, min(spread, 2 * most * spread // n)) for lang, n in sizes.items()], "lang string, share bigint")
    draw = F.pmod(F.xxhash64("doc_id", "text", F.lit("sample")), F.lit(spread))
    # twice the rows that are wanted are drawn, as repeated rows count once
    drawn = docs.withColumn("draw", draw).join(F.broadcast(share), "lang").where(F.col("draw") < F.col("share")).drop("share").distinct()
    first = Window.partitionBy("lang").orderBy("draw", "doc_id")
    chosen = drawn.withColumn("at", F.row_number().over(first)).where(F.col("at") <= most).drop("at")

    def describe():
        def one(batch: pa.RecordBatch) -> dict:
            out = [grams(t) for t in texts(batch)]
            keep = [i for i, g in enumerate(out) if g]
            col = lambda n: batch.column(n).take(pa.array(keep, pa.int64()))
            return {"doc_id": col("doc_id"), "lang": col("lang"), "draw": col("draw"), "found": pa.array([out[i][0].tolist() for i in keep], pa.list_(pa.int32())), "counts": pa.array([out[i][1].tolist() for i in keep], pa.list_(pa.int32()))}

        return one

    rows = map_batches(chosen.select("doc_id", "lang", "draw", "text"), describe, f"doc_id {dict(docs.dtypes)['doc_id']}, lang string, draw bigint, found array<int>, counts array<int>").toPandas()
    rows = rows.sort_values(["draw", "doc_id"])
    rows["at"] = rows.groupby("lang").cumcount()
    made = [(np.asarray(f), np.asarray(c), langs.index(lang), at) for f, c, lang, at in zip(rows.found, rows.counts, rows.lang, rows["at"])]
    half = [m[:3] for m in made if m[3] % 3] or [m[:3] for m in made]
    ftrl(model, half)
    calibrate(model, [m[:3] for m in made if m[3] % 3 == 0])
    return model


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score of every document."""
    small_batches(docs.sparkSession)
    packed = docs.sparkSession.sparkContext.broadcast(model)  # SIZE x languages

    def start():
        m = packed.value

        def one(batch: pa.RecordBatch) -> dict:
            out = [m.predict(t) for t in texts(batch)]
            return {"doc_id": batch.column("doc_id"), "lang_pred": pa.array([x[0] for x in out], pa.string()), "score": pa.array([x[1] for x in out], pa.float64())}

        return one

    return map_batches(docs.select("doc_id", "text"), start, f"doc_id {dict(docs.dtypes)['doc_id']}, lang_pred string, score double")


def keep_known(docs: DataFrame, model: Model, accepted: list[str] | None = None, label: str = "lang") -> DataFrame:
    """The documents with a letter, in the columns they came with; with a list of accepted languages, those predicted to be in one of them.

    Documents whose ``label`` is null get the predicted language there; a label that is given stays.  Where nothing could
    be learned, no language is told of any text: all with a letter stay as they are, unless languages are asked for.
    """
    small_batches(docs.sparkSession)
    packed = docs.sparkSession.sparkContext.broadcast((model, accepted))

    def run(batches):
        m, only = packed.value
        for batch in batches:
            whole = texts(batch)
            told = [m.predict(t) for t in whole]
            at = []
            for i, (t, (lang, score)) in enumerate(zip(whole, told)):
                # only a text without a letter has score 0, but where nothing was learned all have
                known = score > 0 or not m.langs and grams(t) is not None
                if known and (only is None or score > 0 and lang in only):
                    at.append(i)
            if label in batch.schema.names and m.langs:
                k = batch.schema.get_field_index(label)
                given = batch.column(k).to_pylist()
                batch = batch.set_column(k, batch.schema.field(k), pa.array([lang if x is None and score > 0 else x for x, (lang, score) in zip(given, told)], batch.column(k).type))
            yield batch.take(pa.array(at, pa.int64()))
            batch = whole = told = None
        give_back()

    return docs.mapInArrow(run, docs.schema)


def predictions(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score; learned only where crc32(doc_id as text) mod 5 isn't 0."""
    model = fit(docs.where(fold_of(F.col("doc_id")) != 0))
    return identify(docs, model).select("doc_id", (fold_of(F.col("doc_id")) == 0).alias("held_out"), "lang_pred", "score")

"""Toxicity by weak supervision.

Many voters look at a text: lexicons (given ones, and ones mined from labelled rows) and patterns.  Their
vote patterns are counted over all documents.  A generative label model, fitted by expectation
maximisation on those counts and on the labelled rows, estimates each voter's rates per class and the
correlations of voters within a class: voters form a tree, and the chance of a vote depends on the class and on
the vote of the voter above it, so what correlated voters say together counts once.  A sparse linear classifier
over words and voters is then trained on the posterior labels of at most ``sample`` documents.

Only labels of rows whose crc32(doc_id) mod 5 isn't 0 are used; label tables with several rows of a
document count as toxic if one is.  Labels, lang, source and doc_id are no inputs of a score.

Defined results: null and empty texts are scored like a text without words; repeated rows give equal
rows; without any usable label the given lexicons alone vote and the prior is ``prior``.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import fold_of, map_batches, small_batches, texts

#: Given lexicons, one voter each.
LEXICONS = {
    "stupidity": "idiot idiots moron morons stupid dumb imbecile dumbass dimwit halfwit fool brainless clown clowns",
    "contempt": "pathetic worthless loser losers useless failure disgrace despicable contemptible",
    "filth": "trash garbage scum filth filthy vermin disgusting vile rotten sewage",
    "abuse": "bitch bastard asshole shit bullshit fuck fucking crap cunt slut whore dickhead",
    "threat": "murder exterminate strangle lynch behead",
    "hate": "subhuman savages parasites inferior",
    "abroad": "dummkopf arschloch abschaum widerlich connard salaud ordure imbécile estúpido idiota basura imbécil asqueroso",
}
MINED = 6
#: Bytes of a mined stem.
SHORTEST, LONGEST = 4, 9
_LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
PATTERNS = {
    "censored": re.compile(rb"\b[a-z]{1,3}[*#@$]{2,4}[a-z]{1,3}\b", re.I),
    "told": re.compile(rb"\b(?:shut up|get lost|go to hell|drop dead)\b", re.I),
    "called": re.compile(rb"\byou(?: are|'re)? (?:an? )?(?:idiot|moron|loser|clown|scum|trash)\b", re.I),
}


def words_of(raw: bytes) -> set[bytes]:
    return set(raw.translate(_LETTERS).split())


@dataclass
class Voters:
    lexicons: list[frozenset[bytes]]
    stems: list[list[tuple[bytes, int]]] = field(default_factory=list)  # a voter each: (stem, least number of its words)

    def __post_init__(self):
        self.heads = frozenset(stem[:SHORTEST] for voter in self.stems for stem, _ in voter)

    @property
    def names(self) -> list[str]:
        return [*[f"lexicon{i}" for i in range(len(self.lexicons))], *PATTERNS, "shouting", *[f"stems{i}" for i in range(len(self.stems))]]

    def votes(self, raw: bytes, words: set[bytes]) -> int:
        """A bit for each voter that says toxic."""
        out, bit = 0, 1
        for lexicon in self.lexicons:
            if not words.isdisjoint(lexicon):
                out |= bit
            bit <<= 1
        for pattern in PATTERNS.values():
            if pattern.search(raw):
                out |= bit
            bit <<= 1
        if b"!!!" in raw:
            out |= bit
        bit <<= 1
        near = [w for w in words if w[:SHORTEST] in self.heads]
        for voter in self.stems:
            if near and any(sum(w.startswith(stem) for w in near) >= least for stem, least in voter):
                out |= bit
            bit <<= 1
        return out


@dataclass
class LabelModel:
    """The chance of each vote given the class and the vote of the voter it depends on: a tree of correlated voters."""

    prior: float
    rates: np.ndarray  # class x voter
    parent: np.ndarray  # the voter that each depends on; -1: none
    given: np.ndarray  # class x vote of the parent x voter
    scale: float = 1.0
    shift: float = 0.0

    def chances(self, v: np.ndarray) -> np.ndarray:
        """class x row x voter: how likely it is that each voter says toxic."""
        said = (v[:, self.parent] > 0) & (self.parent >= 0)
        return np.where(said, self.given[:, 1, None], np.where(self.parent >= 0, self.given[:, 0, None], self.rates[:, None]))

    def log_odds(self, v: np.ndarray) -> np.ndarray:
        """A voter that says nothing abstains: only votes count."""
        r = np.log(self.chances(v))
        return self.shift + self.scale * (np.log(self.prior / (1 - self.prior)) + (v * (r[1] - r[0])).sum(1))

    def with_silence(self, v: np.ndarray) -> np.ndarray:
        """The log odds if silence counts too; rates are estimated with these."""
        r = self.chances(v)
        said, silent = np.log(r), np.log1p(-r)
        return np.log(self.prior / (1 - self.prior)) + (v * (said[1] - said[0]) + (1 - v) * (silent[1] - silent[0])).sum(1)

    def calibrate(self, patterns: np.ndarray, labelled: np.ndarray) -> None:
        """Scale and shift of least log loss on the labelled rows, by Newton's method with a light ridge; a step that doesn't lower the loss is halved."""
        z = self.log_odds(patterns)
        x = np.stack([z, np.ones(len(z))], 1)
        total, start = labelled.sum(1), np.array([1.0, 0.0])

        def loss(theta: np.ndarray) -> float:
            return float((total * np.logaddexp(0, x @ theta) - labelled[:, 1] * (x @ theta)).sum() + ((theta - start) ** 2).sum() / 2)

        theta = start
        for _ in range(40):
            p = 1 / (1 + np.exp(-np.clip(x @ theta, -30, 30)))
            slope = x.T @ (total * p - labelled[:, 1]) + theta - start
            curve = (x * (total * p * (1 - p))[:, None]).T @ x + np.eye(2)
            step = np.linalg.solve(curve, slope)
            while np.abs(step).max() > 1e-6 and not loss(theta - step) < loss(theta):
                step = step / 2
            if np.abs(step).max() <= 1e-6:
                break
            theta = theta - step
        if theta[0] > 0:
            self.scale, self.shift = map(float, theta)


def dependence(patterns: np.ndarray, mass: np.ndarray) -> np.ndarray:
    """voter x voter: the mutual information of two votes given the class, in nats. mass: class x row."""
    out = np.zeros((patterns.shape[1],) * 2)
    for m in mass:
        total = max(m.sum(), 1e-9)
        both = (patterns * m[:, None]).T @ patterns / total
        one = np.diag(both)
        for a in (0, 1):
            for b in (0, 1):
                joint = both if a and b else one[:, None] - both if a else one - both if b else 1 - one[:, None] - one + both
                apart = np.outer(one if a else 1 - one, one if b else 1 - one)
                out += total / mass.sum() * np.where(joint > 1e-12, joint * np.log(np.maximum(joint, 1e-12) / np.maximum(apart, 1e-12)), 0)
    return out


def spanning(weight: np.ndarray, least: float = 1e-5) -> np.ndarray:
    """The parent of each voter in the forest of largest weight; pairs of less than ``least`` aren't joined."""
    k = len(weight)
    parent, best, link, left = np.full(k, -1), np.full(k, -np.inf), np.full(k, -1), set(range(k))
    while left:
        j = max(left, key=lambda x: (best[x], -x))
        left.remove(j)
        if best[j] > least:
            parent[j] = link[j]
        for x in left:
            if weight[j, x] > best[x]:
                best[x], link[x] = weight[j, x], j
    return parent


def fit_label_model(patterns: np.ndarray, counts: np.ndarray, labelled: np.ndarray, prior: float, rounds: int = 3, steps: int = 30, firm: float = 4.0) -> LabelModel:
    """patterns: distinct vote vectors; counts: of all rows; labelled: of labelled rows, a column a class.

    Expectation maximisation; the first round takes voters for independent, the others join them in the tree that the
    posteriors of the round before give.  A chance given the parent's vote leans on the voter's rate like ``firm`` rows.
    """
    k = patterns.shape[1]
    model = LabelModel(prior, np.vstack([np.full(k, 0.01), np.full(k, 0.4)]), np.full(k, -1), np.full((2, 2, k), 0.5))
    # labels count so much that the unlabelled rows don't outweigh them
    gain = max(1.0, 0.5 * counts.sum() / max(labelled.sum(), 1))
    for turn in range(rounds):
        for _ in range(steps):
            p = 1 / (1 + np.exp(-np.clip(model.with_silence(patterns), -30, 30)))
            mass = np.stack([counts * (1 - p), counts * p]) + gain * labelled.T
            for c, start in ((0, 0.01), (1, 0.3)):
                both = (patterns * mass[c][:, None]).T @ patterns
                one, total = np.diag(both), mass[c].sum()
                model.rates[c] = np.clip((one + 2 * start) / (total + 2), 1e-4, 0.98)
                up = np.maximum(model.parent, 0)
                yes = both[up, np.arange(k)]
                for vote, n, said in ((1, one[up], yes), (0, total - one[up], one - yes)):
                    model.given[c, vote] = np.clip((said + firm * model.rates[c]) / (n + firm), 1e-4, 0.98)
            # a voter says toxic at least as often in toxic texts
            model.rates[1] = np.maximum(model.rates[1], model.rates[0])
            model.given[1] = np.maximum(model.given[1], model.given[0])
        if turn < rounds - 1 and k:
            model.parent = spanning(dependence(patterns, mass))
    if labelled.sum():
        model.calibrate(patterns, labelled)
    return model


@dataclass
class Scorer:
    voters: Voters
    label_model: LabelModel | None = None
    words: dict[bytes, float] = field(default_factory=dict)
    vote_weights: np.ndarray | None = None
    bias: float = 0.0

    def vector(self, bits: int) -> np.ndarray:
        return (bits >> np.arange(len(self.voters.names)) & 1).astype(float)

    def score(self, text: str) -> float:
        raw = text.encode("utf-8", "replace")
        words = words_of(raw)
        z = self.bias + float(self.vector(self.voters.votes(raw, words)) @ self.vote_weights) + sum(self.words[w] for w in self.words.keys() & words)
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def train_linear(scorer: Scorer, rows: list[tuple[set[bytes], int, float]], steps: int = 300, rate: float = 0.3, l1: float = 0.02, l2: float = 0.01) -> None:
    """Sparse logistic regression on posterior labels, by full gradients with soft thresholds."""
    seen: dict[bytes, int] = {}
    for words, _, _ in rows:
        for w in words:
            seen[w] = seen.get(w, 0) + 1
    vocabulary = {w: i for i, w in enumerate(sorted(w for w, n in seen.items() if n >= 3))}
    k = len(scorer.voters.names)
    at = [np.array(sorted(vocabulary[w] for w in words if w in vocabulary) or [], np.int64) for words, _, _ in rows]
    votes = np.array([scorer.vector(b) for _, b, _ in rows]).reshape(len(rows), k)
    y = np.array([p for *_, p in rows])
    lengths = np.array([len(a) for a in at])
    row_of, flat = np.repeat(np.arange(len(rows)), lengths), np.concatenate([np.zeros(0, np.int64), *at])
    w, v, b = np.zeros(len(vocabulary)), np.full(k, 0.5), -1.0
    gw, gv, gb = np.full(len(w), 1e-6), np.full(k, 1e-6), 1e-6
    balance = np.where(y > 0.5, 0.5 / max((y > 0.5).mean(), 1e-6), 0.5 / max((y <= 0.5).mean(), 1e-6)) if 0 < (y > 0.5).sum() < len(y) else np.ones(len(y))
    for turn in range(steps):
        z = b + votes @ v + np.bincount(row_of, w[flat], len(rows))
        e = balance * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y)
        dw = np.bincount(flat, e[row_of], len(w)) + l2 * w
        dv, db = votes.T @ e + l2 * v, e.sum()
        gw += dw * dw
        gv += dv * dv
        gb += db * db
        step = rate / np.sqrt(gw)
        if turn > steps // 3:  # words explain what the voters leave
            w = w - step * dw
            w = np.sign(w) * np.maximum(np.abs(w) - step * l1 * len(rows), 0)
        v = v - rate / np.sqrt(gv) * dv
        b = b - rate / np.sqrt(gb) * db
    scorer.words = {word: float(w[i]) for word, i in vocabulary.items() if w[i]}
    scorer.vote_weights, scorer.bias = v, float(b)


def distinct_texts(rows: list[tuple[set[bytes], int]]) -> list[tuple[set[bytes], int]]:
    """One of each group of near copies: those whose 32 least word hashes agree by half."""
    kept, leaders = [], ([], [])
    for words, toxic in rows:
        sketch = frozenset(sorted(hashlib.blake2b(w, digest_size=8).digest() for w in words)[:32])
        if toxic and any(2 * len(sketch & x) >= max(len(sketch), len(x)) for x in leaders[toxic]):
            continue
        leaders[toxic].append(sketch)
        kept.append((words, toxic))
    return kept


def stem_counts(words: set[bytes]) -> dict[bytes, int]:
    out: dict[bytes, int] = {}
    for w in words:
        for k in range(SHORTEST, min(len(w), LONGEST) + 1):
            out[w[:k]] = out.get(w[:k], 0) + 1
    return out


def mine(rows: list[tuple[set[bytes], int]], covers: int = 4, odds: float = 2.5) -> list[list[tuple[bytes, int]]]:
    """Stems from labelled texts, in MINED voters: "so many words that begin so" is far likelier in toxic texts.

    Chosen one after another by how many toxic texts they add that fewer than ``covers`` of those before cover.
    """
    rows = distinct_texts(rows)
    toxic = [stem_counts(words) for words, y in rows if y]
    clean = [words for words, y in rows if not y]
    least = max(4, len(toxic) // 60)
    holds: dict[tuple[bytes, int], list[int]] = {}
    for i, counts in enumerate(toxic):
        for stem, n in counts.items():
            for t in range(1, min(n, 3) + 1):
                holds.setdefault((stem, t), []).append(i)
    holds = {k: v for k, v in holds.items() if len(v) >= least}
    stems = {stem for stem, _ in holds}
    against = dict.fromkeys(holds, 0)
    for words in clean:
        counts: dict[bytes, int] = {}
        for w in words:
            for k in range(SHORTEST, min(len(w), LONGEST) + 1):
                if w[:k] in stems:
                    counts[w[:k]] = counts.get(w[:k], 0) + 1
        for stem, n in counts.items():
            for t in range(1, min(n, 3) + 1):
                if (stem, t) in against:
                    against[stem, t] += 1
    score = lambda k: np.log((len(holds[k]) + 0.5) / (len(toxic) + 1)) - np.log((against[k] + 0.5) / (len(clean) + 1))
    good = [k for k in holds if score(k) >= odds]
    covered, chosen = np.zeros(len(toxic), int), []
    while good:
        gains = {k: sum(covered[i] < covers for i in holds[k]) for k in good}
        best = max(good, key=lambda k: (gains[k] * min(score(k), 5), len(k[0]), k))
        if gains[best] < least:
            break
        chosen.append(best)
        covered[holds[best]] += 1
        good = [k for k in good if k != best and gains[k] >= least and not (k[1] == best[1] and holds[k] == holds[best])]
    chosen.sort(key=lambda k: (against[k] / max(len(holds[k]), 1), k))  # a voter holds stems that are as sure as each other
    cuts = [len(chosen) * i // MINED for i in range(MINED + 1)]
    return [chosen[i:j] for i, j in zip(cuts, cuts[1:])]


def fit(docs: DataFrame, labels: DataFrame, sample: int = 4000, prior: float = 0.05) -> Scorer:
    """docs: doc_id, text; labels: doc_id, toxic. At most ``sample`` labelled texts and as many others reach the driver."""
    small_batches(docs.sparkSession)
    docs = docs.select("doc_id", "text")
    usable = labels.where((fold_of(F.col("doc_id")) != 0) & F.col("toxic").isin(0, 1)).groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    draw = F.xxhash64("doc_id", F.lit("toxicity"))
    chosen = usable.where("toxic = 1").orderBy(draw).limit(sample // 4).unionByName(usable.where("toxic = 0").orderBy(draw).limit(sample - sample // 4))

    def words_rows():
        def one(batch: pa.RecordBatch) -> dict:
            raw = [t.encode("utf-8", "replace") for t in texts(batch)]
            return {"doc_id": batch.column("doc_id"), "toxic": batch.column("toxic"), "words": pa.array([b" ".join(sorted(words_of(r))) for r in raw], pa.binary()), "marks": pa.array([Voters([]).votes(r, set()) for r in raw], pa.int64())}

        return one

    id_type = dict(docs.dtypes)["doc_id"]
    known = map_batches(docs.join(F.broadcast(chosen), "doc_id").select("doc_id", "toxic", "text"), words_rows, f"doc_id {id_type}, toxic int, words binary, marks bigint")
    known = known.orderBy("doc_id", "words", "marks").limit(2 * sample).toPandas()  # ids may repeat
    labelled_rows = [(set(bytes(w).split()), int(t), int(m)) for w, t, m in zip(known.words, known.toxic, known.marks)]
    given = [frozenset(w.encode() for w in text.split()) for text in LEXICONS.values()]
    scorer = Scorer(Voters(given, mine([r[:2] for r in labelled_rows])))
    packed = docs.sparkSession.sparkContext.broadcast(scorer.voters)

    def vote():
        voters = packed.value

        def one(batch: pa.RecordBatch) -> dict:
            counts: dict[int, int] = {}
            for t in texts(batch):
                raw = t.encode("utf-8", "replace")
                bits = voters.votes(raw, words_of(raw))
                counts[bits] = counts.get(bits, 0) + 1
            return {"bits": pa.array(counts, pa.int64()) if not counts else pa.array(list(counts), pa.int64()), "n": pa.array(list(counts.values()), pa.int64())}

        return one

    # at most 2 ^ voters rows, in practice some hundreds
    patterns = {r["bits"]: r["n"] for r in map_batches(docs.select("text"), vote, "bits bigint, n bigint").groupBy("bits").agg(F.sum("n").alias("n")).collect()}
    # the marks are the votes of the patterns, which need the raw text
    rows = [(words, scorer.voters.votes(b"", words) | marks << len(given), toxic) for words, toxic, marks in labelled_rows]
    for _, bits, _ in rows:
        patterns.setdefault(bits, 0)
    order = sorted(patterns)
    vectors = np.array([scorer.vector(b) for b in order]).reshape(len(order), len(scorer.voters.names))
    labelled = np.zeros((len(order), 2))
    where = {b: i for i, b in enumerate(order)}
    for _, bits, toxic in rows:
        labelled[where[bits], toxic] += 1
    # rows of the sample are drawn by class, so each class is weighted back to its share of the labels
    shares = {r["toxic"]: r["n"] for r in usable.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    for c in (0, 1):
        labelled[:, c] *= shares.get(c, 0) / max(labelled[:, c].sum(), 1)
    if sum(shares.values()):
        prior = float(np.clip(shares.get(1, 0) / sum(shares.values()), 0.005, 0.5))
    scorer.label_model = fit_label_model(vectors, np.array([patterns[b] for b in order], float), labelled, prior)
    posterior = 1 / (1 + np.exp(-np.clip(scorer.label_model.log_odds(vectors), -30, 30))) if order else np.zeros(0)
    train_linear(scorer, [(w, b, float(posterior[where[b]])) for w, b, _ in rows] or [(set(), 1 << i, 0.9) for i in range(len(given))] + [(set(), 0, 0.0)])
    return scorer


def scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every whole text."""
    packed = docs.sparkSession.sparkContext.broadcast(fit(docs, labels))

    def start():
        scorer = packed.value

        def one(batch: pa.RecordBatch) -> dict:
            return {"doc_id": batch.column("doc_id"), "score": pa.array([scorer.score(t) for t in texts(batch)], pa.float64())}

        return one

    out = map_batches(docs.select("doc_id", "text"), start, f"doc_id {dict(docs.dtypes)['doc_id']}, score double")
    return out.select("doc_id", (fold_of(F.col("doc_id")) == 0).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))

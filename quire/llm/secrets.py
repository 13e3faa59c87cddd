"""Secret scans: candidates by pattern, false positives removed by a random forest; DataFrame functions only.

One pattern marks candidates in the whole text, which is then split at the marks, so that neighbouring
words come with each candidate.  Features: length, classes of characters and transitions between them,
dictionary coverage, path and neighbouring words.  The forest is trained on labelled findings - given
ones, or the bounded synthetic set of ``labelled_findings`` - and becomes one SQL expression.

Defined results: null and empty texts have no candidates; the mark character U+0001 in a text is read as a
blank; repeated rows give repeated findings; an empty table gives none.  Secrets are returned as digests.
"""

from __future__ import annotations

import json
import random
import string
import uuid
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MARK = "\u0001"
CUES = "token|secret|passw(?:or)?d|api[_-]?key|access[_-]?key|credential|auth|bearer|private"
PREFIXES = "AKIA|ASIA|gh[pousr]_|sk_live_|sk-|xox[abp]-|AIza|eyJ|glpat-|npm_"
#: What a candidate looks like, at any length - a long run with a digit, one with a known beginning, a value behind a cue, a key block's head.
CANDIDATE = (
    r"(?<![A-Za-z0-9_+/=-])(?=[A-Za-z_+/=-]*+[0-9])[A-Za-z0-9_+/=-]{16,}+"
    rf"|(?<![A-Za-z0-9_+/=-])(?:{PREFIXES})[A-Za-z0-9_+/=-]{{12,}}+"
    rf"|(?<=[=:][\"' ]{{0,2}})(?<=(?i:{CUES})(?:[_-](?i:key))?[\"' ]{{0,2}}[=:][\"' ]{{0,2}})[^\s\"'{MARK}]{{6,}}+"
    r"|-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----"
)
CALM = "sha1|sha256|md5|commit|checksum|digest|uuid|guid|etag|revision|build|version|id|order|card|phone|tel|isbn"
FAKE = "example|sample|dummy|changeme|placeholder|your|test|xxxx|0000000|1234567|abcdef"
WORDS = "the|and|tion|ing|ent|with|that|this|from|for|file|path|user|name|data|page|image|index|main|config|value|error|line|test|home|src|lib|public|static"

FEATURES = ["length", "digits", "uppers", "symbols", "transitions", "distinct", "hex_only", "digits_only", "dictionary", "letters_run", "slashes", "in_path", "assigned", "quoted", "cue", "calm", "fake", "prefix", "uuid_like", "key_block"]


def features(c: Column, left: Column, right: Column) -> list[Column]:
    """The features of a candidate and of the words before and after it, in the order of FEATURES."""
    n = F.length(c)
    count = lambda pattern: F.regexp_count(c, F.lit(pattern)).cast("double")
    yes = lambda cond: F.when(cond, 1.0).otherwise(0.0)
    switch = r"(?<=[a-z])(?![a-z]).|(?<=[A-Z])(?![A-Z]).|(?<=[0-9])(?![0-9])."
    return [
        n.cast("double"),
        count("[0-9]") / n,
        count("[A-Z]") / n,
        count("[^A-Za-z0-9]") / n,
        count(switch) / n,
        F.size(F.array_distinct(F.split(c, ""))) / n,
        yes(c.rlike("^(?:[0-9a-f]+|[0-9A-F]+)$")),
        yes(c.rlike("^[0-9 -]+$")),
        1 - F.length(F.regexp_replace(F.lower(c), WORDS, "")) / n,
        count("[a-z]{5,}") / n * 5,
        count("[/]") / n,
        yes(right.rlike(r"^\.[a-z]{2,4}\b") | left.rlike(r"[/\\.]$")),
        yes(left.rlike(r"[=:]\s?[\"']?$")),
        yes(left.rlike(r"[\"']$") & right.rlike(r"^[\"']")),
        yes(F.lower(left).rlike(f"(?:{CUES})[^a-z]{{0,6}}$")),
        yes(F.lower(left).rlike(rf"\b(?:{CALM})[^a-z]{{0,6}}$")),
        yes(F.lower(c).rlike(FAKE)),
        yes(c.rlike(f"^(?:{PREFIXES})")),
        yes(c.rlike("^[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$")),
        yes(c.startswith("-----BEGIN")),
    ]


def labelled_findings(n: int = 1600, seed: int = 11) -> list[tuple[str, str, str, int]]:
    """(candidate, words before, words after, label) in the shapes that scanners report, half of them real ones."""
    rnd = random.Random(seed)
    pick = lambda chars, k: "".join(rnd.choice(chars) for _ in range(k))
    hexes, alnum = "0123456789abcdef", string.ascii_letters + string.digits
    words = ["the", "of", "value", "run", "Les", "der", "en", "see", "with", "host", "line", "then", "esta", "und"]
    prose = lambda: " ".join(rnd.choice(words) for _ in range(4))
    cues = ["token", "secret", "password", "api_key", "apikey", "access_key", "auth_token", "SECRET_KEY", "client_secret", "bearer", "private_key"]
    out = []
    for k in range(n):
        if k % 2:
            value = rnd.choice([
                lambda: pick(hexes, rnd.choice([32, 40, 48, 64])), lambda: pick(hexes, rnd.choice([32, 40, 40, 64])), lambda: pick(alnum, rnd.randint(20, 64)), lambda: pick(alnum + "+/", rnd.choice([40, 44, 88])),
                lambda: "AKIA" + pick(string.ascii_uppercase + string.digits, 16), lambda: "ghp_" + pick(alnum, 36), lambda: "sk_live_" + pick(alnum, 24), lambda: pick(alnum + "!$%_-", rnd.randint(8, 15)),
            ])()
            bare = value.startswith(("AKIA", "ghp_", "sk_live_")) and rnd.random() < 0.4
            cue = rnd.choice(cues)
            left, right = ("", rnd.choice(["", " "])) if bare else rnd.choice([(f'{cue} = "', '"'), (f"{cue}: ", " "), (f"{cue}='", "'"), (f'"{cue}": "', '",'), (f"{cue.upper()}=", " ")])
            out.append((value, f"{prose()} {left}"[-48:], f"{right} {prose()}"[:24], 1))
            continue
        shape = rnd.randrange(8)
        left, right = prose() + " ", " " + prose()
        if shape == 0:
            value, left = pick(hexes, rnd.choice([32, 40, 64])), f"{prose()} {rnd.choice(['commit', 'sha256:', 'md5', 'checksum', 'etag:', 'digest', 'revision'])} "
        elif shape == 1:
            value = str(uuid.UUID(int=rnd.getrandbits(128)))
            left = rnd.choice([left, f"{prose()} uuid ", f"{prose()} id: "])
        elif shape == 2:
            value, left = "/".join(rnd.choice(["src", "lib", "page", "image", "static", "data"]) + pick(string.digits, rnd.randint(0, 3)) for _ in range(5)), f"{prose()} /"
        elif shape == 3:
            value = pick(string.digits, rnd.randint(16, 19))
            left = rnd.choice([left, f"{prose()} card ", f"{prose()} order: "])
        elif shape == 4:
            value, left, right = rnd.choice(["your_api_key_1234", "example-token-0000000", "changeme12345678", "xxxxxxxxxxxxxxxx1", "TEST_TOKEN_PLACEHOLDER_1"]), f'{prose()} {rnd.choice(cues)} = "', '" '
        elif shape == 5:
            value = "-".join(rnd.choice(["the", "index", "user", "main", "error", "with", "config"]) for _ in range(4)) + pick(string.digits, 2)
        elif shape == 6:
            value = rnd.choice("=-_") * rnd.randint(16, 60) + pick(string.digits, 1)
        else:
            value, left, right = rnd.choice(["getToken(request)", "os.environ[KEY]", "${SECRET}", "<password>", "process.env.TOKEN", "undefined", "required"]), f"{prose()} {rnd.choice(cues)} = ", " "
        out.append((value, left[-48:], right[:24], 0))
    return out


@dataclass
class Node:
    """Below or at the threshold the left one; a leaf has a share of real findings only."""

    share: float
    feature: int = -1
    threshold: float = 0.0
    left: Node | None = None
    right: Node | None = None

    def expression(self, columns: list[Column]) -> Column:
        if self.left is None:
            return F.lit(self.share)
        return F.when(columns[self.feature] <= F.lit(self.threshold), self.left.expression(columns)).otherwise(self.right.expression(columns))


def grow(x: np.ndarray, y: np.ndarray, rnd: np.random.Generator, depth: int, tries: int) -> Node:
    share = float((y.sum() + 0.5) / (len(y) + 1))
    if not depth or len(y) < 8 or y.min() == y.max():
        return Node(share)
    best = (y.var() * len(y) - 1e-9, -1, 0.0)
    for f in rnd.choice(x.shape[1], tries, False):
        cuts = np.unique(x[:, f])
        if len(cuts) < 2:
            continue
        for cut in rnd.choice((cuts[1:] + cuts[:-1]) / 2, min(16, len(cuts) - 1), False):
            low = x[:, f] <= cut
            cost = y[low].var() * low.sum() + y[~low].var() * (~low).sum()
            if cost < best[0]:
                best = (cost, int(f), float(cut))
    _, f, cut = best
    if f < 0:
        return Node(share)
    low = x[:, f] <= cut
    return Node(share, f, cut, grow(x[low], y[low], rnd, depth - 1, tries), grow(x[~low], y[~low], rnd, depth - 1, tries))


def train(spark: SparkSession, findings: list[tuple[str, str, str, int]], trees: int = 15, depth: int = 6, seed: int = 5) -> list[Node]:
    """A forest of bootstrap trees; the findings (a bounded list) get their features from the same expressions as the scan."""
    rows = json.dumps([dict(zip(("c", "l", "r", "y"), f)) for f in findings])
    table = spark.range(1).select(F.inline(F.from_json(F.lit(rows), "array<struct<c string, l string, r string, y int>>")))
    got = table.select(*[f.alias(n) for n, f in zip(FEATURES, features(F.col("c"), F.col("l"), F.col("r")))], "y").collect()
    data = np.array([tuple(r) for r in got], float).reshape(-1, len(FEATURES) + 1)
    x, y, rnd = data[:, :-1], data[:, -1], np.random.default_rng(seed)
    forest = []
    for _ in range(trees):
        at = rnd.integers(0, len(x), len(x))
        forest.append(grow(x[at], y[at], rnd, depth, 6))
    return forest


def candidates(docs: DataFrame) -> DataFrame:
    """doc_id, ordinal, start_char, end_char, candidate, before, after: one row for each candidate of a whole text."""
    text = F.translate(F.coalesce("text", F.lit("")), MARK, " ")
    marked = docs.select("doc_id", text.alias("t")).where(F.col("t").rlike(CANDIDATE))
    pieces = marked.select("doc_id", F.monotonically_increasing_id().alias("row"), F.split(F.regexp_replace("t", f"({CANDIDATE})", f"{MARK}$1{MARK}"), MARK, -1).alias("p"))
    # odd places hold the candidates; before and after hold the words next to them, so the array is left behind here
    place = F.sequence(F.lit(2), F.size("p") - 1, F.lit(2))
    found = pieces.select("doc_id", "row", F.inline(F.transform(place, lambda i: F.struct(
        i.alias("i"), F.length(F.element_at("p", i - 1)).alias("gap"), F.element_at("p", i).alias("candidate"),
        F.right(F.element_at("p", i - 1), F.lit(48)).alias("before"), F.left(F.element_at("p", i + 1), F.lit(24)).alias("after")))))
    from pyspark.sql import Window

    w = Window.partitionBy("row").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.col("gap") + F.length("candidate")).over(w)
    return found.select("doc_id", (F.col("i") / 2).cast("bigint").alias("ordinal"), (end - F.length("candidate")).alias("start_char"), end.alias("end_char"), "candidate", "before", "after")


def scan(docs: DataFrame, findings: list[tuple[str, str, str, int]] | None = None, least: float = 0.5) -> DataFrame:
    """doc_id, ordinal, start_char, end_char, secret_sha256, probability, is_secret of every candidate."""
    forest = train(docs.sparkSession, findings if findings is not None else labelled_findings())
    found = candidates(docs).withColumn("f", F.array(*features(F.col("candidate"), F.col("before"), F.col("after"))))
    columns = [F.element_at("f", k + 1) for k in range(len(FEATURES))]
    p = sum((t.expression(columns) for t in forest[1:]), forest[0].expression(columns)) / len(forest)
    scored = found.select("doc_id", "ordinal", "start_char", "end_char", F.sha2("candidate", 256).alias("secret_sha256"), F.round(p, 6).alias("probability"))
    return scored.withColumn("is_secret", F.col("probability") >= least)

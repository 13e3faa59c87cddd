"""PII by anchor expansion.

An Aho-Corasick automaton finds anchors in the whole text: at-signs, plus signs, schemes and identifier
cues.  From each anchor a deterministic parser expands to both sides and validates the boundary.  Digit
runs are anchors of their own for addresses of the network and for card numbers.

Kinds: email, ip, card and phone as the base; the method adds ``address`` (street cue with a number),
``account`` (letters and digits of an IBAN that passes its check, or the number behind an account cue) and
``login`` (user part of a scheme's authority).  Offsets are code points, end exclusive.

Defined results: a null text counts as empty and has no spans; spans of a kind never overlap; a match
that fails its check is dropped without a second try; repeated rows give equal rows.
"""

from __future__ import annotations

import hashlib
import re

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from quire.llm.common import map_batches, small_batches, texts

BASE = ["email", "ip", "card", "phone"]
ADDED = ["address", "account", "login"]
#: Cues of identifiers and of streets, in lower case.
ACCOUNT_CUES = ["iban", "account no", "account number", "acct", "konto", "kontonummer", "compte", "cuenta"]
STREET_CUES = [" street", " avenue", " road", " lane", " boulevard", "strasse ", "straße ", "rue ", "calle "]

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
DOTTED = re.compile(r"[0-9][0-9.]*")
DIGITS = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+")
NUMBER = re.compile(r"[ :#.=]{0,4}([0-9](?:[ -]?[0-9]){5,19})(?![0-9])")
IBAN = re.compile(r"(?<![A-Za-z0-9])([A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?)(?![A-Za-z0-9])")
AFTER = re.compile(r" ?\w[\w .'-]{0,40}? ([0-9]{1,5}[a-z]?)\b")
BEFORE = re.compile(r"\b[0-9]{1,5}[a-z]? (?:[A-Z][\w'-]* ?){1,4}$")
USER = re.compile(r"[^\s/@?#:]+:[^\s/@?#]+(?=@)")


def automaton() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for cue, kind in [("@", "at"), ("+", "plus"), ("://", "scheme"), *[(c, "account") for c in ACCOUNT_CUES], *[(c, "street") for c in STREET_CUES]]:
        a.add_word(cue, (kind, len(cue)))
    a.make_automaton()
    return a


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) << (k & 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def iban_ok(code: str) -> bool:
    code = code.replace(" ", "")
    return 15 <= len(code) <= 34 and int("".join(str(int(c, 36)) for c in code[4:] + code[:4])) % 97 == 1


def emails(text: str, ats: list[int]):
    """Leftmost matches: the local part runs back from the sign as far as the last match, the domain runs on."""
    done = 0
    for at in ats:
        if at < done:
            continue
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            done = m.end()


def addresses(text: str):
    """Chains of numbers joined by single dots hold a match for each four of them."""
    for m in DOTTED.finditer(text):
        run = m.group()
        if run.count(".") < 3:
            continue
        at, four = m.start(), []
        for part in run.split("."):
            four = [*four, part] if part else []
            at += len(part) + 1
            if len(four) == 4:
                end = at - 1
                if all(len(p.lstrip("0")) <= 3 and int(p[-3:]) <= 255 for p in four):
                    yield end - sum(map(len, four)) - 3, end
                four = []


def cards(text: str):
    for m in DIGITS.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19 and luhn(digits):
            yield m.span()


def phones(text: str, pluses: list[int]):
    for at in pluses:
        m = PHONE.match(text, at)
        if not m:
            continue
        end = m.end()
        while end > at + 3 and not "0" <= text[end - 1] <= "9":
            end -= 1
        if end - at < 4 or not "0" <= text[end - 1] <= "9":
            continue
        if 9 <= sum("0" <= c <= "9" for c in text[at:end]) <= 15:
            yield at, end


def disjoint(spans):
    out, done = [], 0
    for a, b in sorted(set(spans)):
        if a >= done:
            out.append((a, b))
            done = b
    return out


def find(text: str, cues: ahocorasick.Automaton) -> dict[str, list[tuple[int, int]]]:
    """The spans of each kind, in order."""
    anchors: dict[str, list[int]] = {"at": [], "plus": [], "scheme": [], "account": [], "street": []}
    lower = "".join(c.lower() if len(c.lower()) == 1 else c for c in text) if not text.isascii() and len(text.lower()) != len(text) else text.lower()
    for end, (kind, n) in cues.iter(lower):
        anchors[kind].append(end if kind in ("at", "plus") else end + 1)
    found = {"email": list(emails(text, anchors["at"])), "ip": list(addresses(text)), "card": list(cards(text)), "phone": list(phones(text, anchors["plus"]))}
    account = [m.span(1) for at in anchors["account"] if (m := NUMBER.match(text, at))]
    if anchors["account"]:
        account += [m.span(1) for m in IBAN.finditer(text) if iban_ok(m.group(1))]
    street = []
    for at in anchors["street"]:
        left = max(at - 60, 0)
        if m := AFTER.match(text, at):
            street.append((text.rfind(" ", 0, at - 1) + 1, m.end()))
        elif m := BEFORE.search(text[left : at]):
            street.append((left + m.start(), at))
    found["address"], found["account"] = disjoint(street), disjoint(account)
    found["login"] = disjoint(m.span() for at in anchors["scheme"] if (m := USER.match(text, at)))
    return found


def joined(found: dict[str, list[tuple[int, int]]], kinds: list[str]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k in kinds for a, b in found[k])


def spans(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans of every whole text."""
    small_batches(docs.sparkSession)

    def start():
        cues = automaton()

        def one(batch: pa.RecordBatch) -> dict:
            found = [find(t, cues) for t in texts(batch)]
            out = {f"n_{k}": pa.array([len(f[k]) for f in found], pa.int64()) for k in BASE}
            out["base_sha256"] = pa.array([hashlib.sha256(joined(f, BASE).encode()).hexdigest() for f in found], pa.string())
            return out | {"doc_id": batch.column("doc_id"), "spans": pa.array([joined(f, BASE + ADDED) for f in found], pa.string())}

        return one

    return map_batches(docs.select("doc_id", "text"), start, f"doc_id {dict(docs.dtypes)['doc_id']}, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string")


def redact(docs: DataFrame) -> DataFrame:
    """The documents in the columns they came with, each span replaced by its kind in brackets."""
    small_batches(docs.sparkSession)
    schema = docs.schema

    def clean(text: str | None, cues) -> str | None:
        if text is None:
            return None
        out, done = [], 0
        for a, b, k in sorted((a, b, k) for k, s in find(text, cues).items() for a, b in s):
            if a >= done:
                out += [text[done:a], f"[{k}]"]
            done = max(done, b)
        return "".join([*out, text[done:]])

    def run(batches):
        cues = automaton()
        for batch in batches:
            at = batch.schema.get_field_index("text")
            yield batch.set_column(at, batch.schema.field(at), pa.array([clean(t, cues) for t in batch.column(at).to_pylist()], batch.schema.field(at).type))

    return docs.mapInArrow(run, schema)

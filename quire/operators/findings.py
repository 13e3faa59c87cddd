"""Checker findings: reading reports, comparing two runs as multisets, and the gates that follow.

``compare`` works book by book in Python; ``report_rows``, ``multiset_diff`` and ``grouped`` are their
relational forms for a corpus.
"""

from __future__ import annotations

import json
from collections import Counter, defaultdict
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions import shapes
from quire.markup import squeeze

ERRORS = ("error", "fatal")


@dataclass(frozen=True)
class Finding:
    severity: str
    code: str
    message: str
    path: str | None = None
    line: int | None = None
    column: int | None = None

    @property
    def is_error(self) -> bool:
        return self.severity.lower() in ERRORS

    @property
    def diagnostic(self) -> tuple[str, str]:
        return self.code, squeeze(self.message)

    @property
    def fingerprint(self) -> tuple:
        return (*self.diagnostic, self.path)


@dataclass
class CheckResult:
    available: bool
    status: str = "ok"
    findings: list[Finding] = field(default_factory=list)
    returncode: int | None = None
    message: str | None = None

    @property
    def errors(self) -> list[Finding]:
        return [f for f in self.findings if f.is_error]


@dataclass
class Comparison:
    available: bool
    persisting: list[Finding] = field(default_factory=list)
    resolved: list[Finding] = field(default_factory=list)
    introduced: list[Finding] = field(default_factory=list)


def _text(item: dict, *keys: str, default: str | None = None) -> str | None:
    value = next((item[k] for k in keys if k in item), None)
    return value if isinstance(value, str) else default


def _number(item: dict, key: str) -> int | None:
    value = item.get(key)
    return value if isinstance(value, int) and not isinstance(value, bool) else None


def parse_report(text: str, status: int) -> CheckResult:
    """One finding for each place of a message, and one without a place for each further one it counts."""

    def failed(message: str) -> CheckResult:
        return CheckResult(False, "error", [], status, message)

    try:
        payload = json.loads(text)
    except ValueError:
        return failed("EPUBCheck returned invalid JSON.")
    if status not in (0, 1):
        return failed("EPUBCheck failed to complete validation.")
    if not isinstance(payload, dict) or not isinstance(payload.get("messages"), list):
        return failed("EPUBCheck returned an unexpected JSON report.")
    out: list[Finding] = []
    for item in filter(lambda m: isinstance(m, dict), payload["messages"]):
        places = item["locations"] if isinstance(item.get("locations"), list) else [item]
        more = max(_number(item, "additionalLocations") or 0, 0)
        what = ((_text(item, "severity", "type", default="error") or "").lower(), _text(item, "ID", "code", "id", default="unknown"), _text(item, "message", default=""))
        for place in [*filter(lambda p: isinstance(p, dict), places), *[{}] * more]:
            path = place.get("path")
            path = path if isinstance(path, str) and path else _text(place, "file")
            out.append(Finding(*what, path, _number(place, "line"), _number(place, "column")))
    return CheckResult(True, "ok", out, status)


def compare(before: CheckResult, after: CheckResult) -> Comparison:
    """Errors of two runs, paired: first by fingerprint, then one to one by diagnostic where a path is missing, then against all of before."""
    out = Comparison(before.available and after.available)
    left: dict[tuple, list[Finding]] = defaultdict(list)
    right: dict[tuple, list[Finding]] = defaultdict(list)
    for f in before.errors:
        left[f.fingerprint].append(f)
    for f in after.errors:
        right[f.fingerprint].append(f)
    order = lambda k: tuple((x is not None, x or "") for x in k)
    gone: list[Finding] = []
    for key in sorted(left.keys() | right.keys(), key=order):
        both = min(len(left[key]), len(right[key]))
        out.persisting += right[key][:both]
        gone += left[key][both:]
        out.introduced += right[key][both:]
    for f in gone:
        twin = next((c for c in out.introduced if c.diagnostic == f.diagnostic and None in (f.path, c.path)), None)
        if twin is None:
            out.resolved.append(f)
        else:
            out.introduced.remove(twin)
            out.persisting.append(twin)
    known = {(f.diagnostic, f.path) for f in before.errors}
    for f in list(out.introduced):
        if (f.diagnostic, None) in known or (f.path is not None and (f.diagnostic, f.path) in known):
            out.introduced.remove(f)
            out.persisting.append(f)
    return out


def outcome(c: Comparison, after: CheckResult) -> str:
    return "unavailable" if not c.available else "legacy_issues" if after.errors else "clean"


def rejection(c: Comparison) -> str | None:
    """Why a result is rejected: the errors it introduced, by code and message."""
    if not c.available or not c.introduced:
        return None
    counts = Counter((f.code, f.message) for f in c.introduced)
    paths = {k: sorted({f.path for f in c.introduced if (f.code, f.message) == k and f.path}) for k in counts}
    parts = [f"{code}: {message} (x{n}; resources: {', '.join(paths[code, message])})" for (code, message), n in sorted(counts.items())]
    return f"optimized EPUB introduced EPUBCheck errors: {'; '.join(parts)}"


# Relational forms. ----------------------------------------------------------------------------------
def report_rows(reports: DataFrame) -> DataFrame:
    """Findings of reports (book_id, phase, report): a row a place. Keys differ in case only, so they are read one by one."""
    messages = F.from_json("report", "struct<messages: array<string>>")["messages"]
    parsed = reports.select("book_id", "phase", F.explode(messages).alias("m"))
    get = lambda at, *keys: F.coalesce(*[F.get_json_object(at, f"$.{k}") for k in keys])
    more = F.greatest(F.coalesce(get("m", "additionalLocations").cast("int"), F.lit(0)), F.lit(0))
    places = F.coalesce(F.from_json(get("m", "locations"), "array<string>"), F.array("m"))
    found = parsed.select("book_id", "phase", "m", F.explode(F.concat(places, F.array_repeat(F.lit("{}"), more))).alias("p"))
    return found.select(
        "book_id", "phase", F.lower(F.coalesce(get("m", "severity", "type"), F.lit("error"))).alias("severity"), F.coalesce(get("m", "ID", "code", "id"), F.lit("unknown")).alias("code"),
        F.coalesce(get("m", "message"), F.lit("")).alias("message"), F.coalesce(F.nullif(get("p", "path"), F.lit("")), get("p", "file")).alias("path"),
        get("p", "line").cast("bigint").alias("line"), get("p", "column").cast("bigint").alias("column"),
    )


def is_error(severity: Column) -> Column:
    return F.lower(severity).isin(*ERRORS)


def multiset_diff(before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    """keys, persisting, resolved, introduced: how often each key stays, goes and comes. Combined before the shuffle."""
    a = before.groupBy(keys).agg(F.count("*").alias("_a")).withColumn("_b", F.lit(0).cast("bigint"))
    b = after.groupBy(keys).agg(F.count("*").alias("_b")).withColumn("_a", F.lit(0).cast("bigint"))
    both = a.unionByName(b).groupBy(keys).agg(F.sum("_a").alias("_a"), F.sum("_b").alias("_b"))
    return both.select(*keys, F.least("_a", "_b").alias("persisting"), F.greatest(F.col("_a") - F.col("_b"), F.lit(0)).alias("resolved"), F.greatest(F.col("_b") - F.col("_a"), F.lit(0)).alias("introduced"))


def fingerprints(findings: DataFrame) -> DataFrame:
    return findings.where(is_error(F.col("severity"))).select("book_id", "code", shapes.normalized(F.col("message")).alias("message"), "path")


def grouped(findings: DataFrame) -> DataFrame:
    """code, message, n, paths (distinct, sorted, joined)."""
    paths = F.array_join(F.array_sort(F.collect_set(F.nullif("path", F.lit("")))), ", ")
    return findings.groupBy("code", "message").agg(F.count("*").alias("n"), paths.alias("paths"))

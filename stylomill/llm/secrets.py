"""Secret scans: known patterns, and strings of high entropy.

Three kinds of known patterns are found first (assign, access, hex; see BASE). The method adds spans of kind entropy: in
each candidate string, a maximal run of a character class, a window of fixed width slides on by one character at a time;
the counts of the window's characters change by one in and one out, and with them the sum that Shannon's entropy is made
of, and how often lower-case letters, capitals, digits and signs give way to each other. Windows that reach the class's
thresholds in both merge into spans. A span is dropped if its candidate is on the allow-list, if it lacks the kinds of
characters that the class asks for, or if a span of a known pattern or of another class already covers it.

Thresholds are about what one random window in a hundred falls short of; README has recall and false alarms.

Offsets are code points, end exclusive. Defined cases. A null or empty text has no spans (an empty list). Texts of any
length are searched whole. An empty table gives an empty result; an input column named spans is replaced.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stylomill.llm.common import table
from stylomill.session import ship_package

KINDS = ("assign", "access", "hex", "entropy")
#: Letters of the names in either case, ASCII only.
ASSIGN = re.compile(r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS, HEX = re.compile(r"AKIA[A-Z0-9]+"), re.compile(r"[0-9a-f]+")
LEAST = {"assign": 6, "access": 20, "hex": 24}
#: A text without one of these, lower-cased, has no assign.
NAMES = ("password", "passwd", "secret", "token", "apikey", "api_key")


@dataclass(frozen=True)
class CharClass:
    """A class of characters, the window's width, the least entropy in bits a character and the fewest changes of kind in it, and what a span must contain."""

    name: str
    chars: str
    width: int
    bits: float
    changes: int
    needs: tuple[str, ...]


CLASSES = (
    CharClass("hex", "[0-9a-f]", 20, 2.85, 4, ("[0-9]", "[a-f]")),
    CharClass("HEX", "[0-9A-F]", 20, 2.85, 4, ("[0-9]", "[A-F]")),
    CharClass("lower", "[0-9a-z]", 20, 3.4, 3, ("[0-9]", "[a-z]")),
    CharClass("upper", "[0-9A-Z]", 20, 3.3, 2, ("[0-9]", "[A-Z]")),
    CharClass("mixed", "[A-Za-z0-9+/_=-]", 20, 3.6, 6, ("[0-9]", "[a-z]", "[A-Z]")),
)
#: Candidates that are no secrets: UUIDs, dates with times, digests named as such, keys of documentation, words put together (with case or signs) and numbered.
ALLOW = (
    r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}",
    r"[0-9]{4}-?[0-9]{2}-?[0-9]{2}[T_-]?[0-9]*",
    r"sha(1|256|384|512)[-_=].*",
    r".*EXAMPLE(KEY)?",
    r"(?:[A-Z]?[a-z]{2,}+|[A-Z]{2,}+)++[0-9]{0,4}",  # possessive, so that long runs cost no more than their length
    r"/?(?:(?:[A-Z]?[a-z]++|[A-Z]++|[0-9]{1,4}+)[/_=-]++)++(?:[A-Z]?[a-z]++|[A-Z]++)?[0-9]{0,4}/?",
)
KIND = [0] * 128
for _kind, _chars in enumerate(("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789")):
    for _c in _chars:
        KIND[ord(_c)] = _kind + 1


def window_spans(s: str, width: int, bits: float, changes: int = 0) -> Iterator[tuple[int, int]]:
    """Merged spans of the windows of s whose entropy is at least bits and whose kinds of characters change at least so often. s is ASCII."""
    if len(s) < width:
        return
    clog = [0.0] + [c * math.log2(c) for c in range(1, width + 1)]
    counts: dict[str, int] = {}
    total, most = 0.0, width * (math.log2(width) - bits) + 1e-9  # entropy = log2(width) - total / width
    kinds = [KIND[ord(c)] for c in s]
    changed = 0
    start = end = -1
    for i, c in enumerate(s):
        if i >= width:
            old = s[i - width]
            k = counts[old]
            total += clog[k - 1] - clog[k]
            counts[old] = k - 1
            changed -= kinds[i - width] != kinds[i - width + 1]
        k = counts.get(c, 0)
        total += clog[k + 1] - clog[k]
        counts[c] = k + 1
        changed += i > 0 and kinds[i - 1] != kinds[i]
        if i >= width - 1 and total <= most and changed >= changes:
            if start < 0:
                start = i - width + 1
            elif i - width + 1 > end:
                yield start, end
                start = i - width + 1
            end = i + 1
    if start >= 0:
        yield start, end


class Scanner:
    """Finds all spans of a text."""

    def __init__(self, classes: tuple[CharClass, ...] = CLASSES, allow: tuple[str, ...] = ALLOW):
        self.classes = [(c, re.compile(f"{c.chars}{{{c.width},}}"), [re.compile(x) for x in c.needs]) for c in classes]
        self.allow = re.compile("|".join(f"(?:{x})" for x in allow)) if allow else None
        # every candidate of 20 or more characters lies in such a run; so do all access and hex matches
        self.any = re.compile(r"[A-Za-z0-9+/_=-]{%d,}" % min([20, *(c.width for c in classes)]))

    def base(self, text: str, runs: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
        """(start, kind's place, end) of the known patterns. runs: all places where access and hex can be."""
        out = []
        low = text.lower()
        if any(n in low for n in NAMES):
            out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST["assign"]]
        for kind, pattern in ((1, ACCESS), (2, HEX)):
            for a, b in runs:
                out += [(m.start(), kind, m.end()) for m in pattern.finditer(text, a, b) if m.end() - m.start() >= LEAST[KINDS[kind]]]
        return sorted(out)

    def entropy(self, text: str, runs: list[tuple[int, int]], base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
        found = set()
        for a, b in runs:
            for cls, pattern, needs in self.classes:
                for m in pattern.finditer(text, a, b):
                    if self.allow and self.allow.fullmatch(m[0]):
                        continue
                    for s, e in window_spans(m[0], cls.width, cls.bits, cls.changes):
                        span = m[0][s:e]
                        if all(n.search(span) for n in needs):
                            found.add((m.start() + s, 3, m.start() + e))
        # a span that starts no later and reaches as far covers it; of equal ones those of known patterns come first
        out, reach = [], -1
        for s, end, kind in sorted((s, -e, k) for s, k, e in (*base, *found)):
            if kind == 3 and -end > reach:
                out.append((s, kind, -end))
            reach = max(reach, -end)
        return out

    def spans(self, text: str) -> list[tuple[int, int, int]]:
        runs = [m.span() for m in self.any.finditer(text)]
        base = self.base(text, runs)
        return sorted([*base, *self.entropy(text, runs, base)]) if runs else base


SPANS = "array<struct<kind:string,start:int,end:int>>"


def secret_spans(text: Column, classes: tuple[CharClass, ...] = CLASSES, allow: tuple[str, ...] = ALLOW) -> Column:
    """All spans of a text, by start and then kind."""

    @F.pandas_udf(SPANS)
    def scan(texts: pd.Series) -> pd.Series:
        scanner = Scanner(classes, allow)
        return pd.Series([[{"kind": KINDS[k], "start": s, "end": e} for s, k, e in scanner.spans(t)] if t else [] for t in texts], dtype=object)

    return scan(text)


def scan_secrets(df: DataFrame, text: str = "text", **how) -> DataFrame:
    """df with spans: array of (kind, start, end)."""
    ship_package(df.sparkSession)
    return df.drop("spans").withColumn("spans", secret_spans(F.col(text), **how))


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each document the counts and digest of known patterns, and all spans."""
    found = scan_secrets(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "spans")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    base = F.filter("spans", lambda s: s["kind"] != "entropy")
    return found.select("doc_id", count("assign").alias("n_assign"), count("access").alias("n_access"), count("hex").alias("n_hex"), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))

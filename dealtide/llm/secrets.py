"""Secret scans: fixed patterns, and the guess cost of values that stand where credentials stand.

The guess cost of a value is the least sum over all ways to cut it into dictionary words, dates, repeats, keyboard walks
and brute-force characters, each with the decimal logarithm of the guesses it takes (after Wheeler, zxcvbn, 2016).
A value whose cheapest cut is still costly is a secret, also where no fixed pattern knows it.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from math import log10

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents
from .registry import query

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ASSIGN_WORDS = re.compile(r"passw|secret|token|api_?key", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = {"assign": 0, "access": 1, "hex": 2, "guess": 3}
#: A credential word, a sign of assignment, a value: wider than the fixed pattern in words and in values.
CONTEXT = re.compile(
    r"""(?<![A-Za-z0-9])(?:passwords?|passwd|passphrase|passcode|pwd|pass|pin|secret|credentials?|login|token|auth|bearer|api[_-]?key|access[_-]?key|private[_-]?key)["']?[\x20\t]*(?:[:=]|=>|->)[\x20\t]*["']?([^\s"'<>,;|]+)""",
    re.ASCII | re.IGNORECASE,
)
CONTEXT_WORDS = re.compile(r"pass|pwd|pin|secret|credential|login|token|auth|bearer|key", re.ASCII | re.IGNORECASE)
#: Decimal logarithm of the guesses from which a value counts as a secret.
COSTLY = 8.0

# Common parts of passwords, most frequent first.
WORDS = (
    "password pass admin welcome login user root test guest master hello dragon monkey letmein shadow secret qwerty summer winter spring autumn "
    "love baby angel princess football baseball soccer hunter ranger batman superman michael jordan thomas robert daniel george charlie ashley "
    "jessica jennifer michelle nicole freedom computer internet server system default changeme example sample demo public private access token "
    "key your here value string null none true false the and for you with this that from have not are was all one two three"
).split()
# Rows of common keyboards.
ROWS = ("`1234567890-=", "qwertyuiop[]", "asdfghjkl;'", "zxcvbnm,./", "qwertzuiop", "azertyuiop", "abcdefghijklmnopqrstuvwxyz")

#: Dates with year, month and day, in two orders, and years alone.
DATES = (
    (re.compile(r"(?:19|20)\d\d[-/._]?(?:0[1-9]|1[0-2])[-/._]?(?:0[1-9]|[12]\d|3[01])"), log10(365 * 120)),
    (re.compile(r"(?:0[1-9]|[12]\d|3[01])[-/._]?(?:0[1-9]|1[0-2])[-/._]?(?:19|20)\d\d"), log10(365 * 120)),
    (re.compile(r"(?:19|20)\d\d"), log10(120)),
)
#: Longest unit of a repeat; letters of a keyboard walk at least, and what its first one costs.
UNIT, WALK, FIRST = 8, 3, log10(94)


class Starts:
    """Where pieces of one kind may start, less those that an earlier start always beats.

    A piece from ``s`` costs ``best[s]`` and the logarithm of its length in steps of ``step``. A start loses to an earlier one
    if it does so for its shortest piece, of ``least`` steps, as its lead only shrinks with length. So few are kept, however long the run.
    """

    def __init__(self, step: int, least: int):
        self.step, self.least, self.kept = step, least, []

    def add(self, start: int, cost: float) -> None:
        if all(cost - c < log10(((start - s) / self.step + self.least) / self.least) for s, c in self.kept):
            self.kept.append((start, cost))

    def cheapest(self, end: int) -> float:
        """The least cost of a piece that ends at ``end``, without what its kind costs."""
        first = self.step * self.least
        return min((c + log10((end - s) / self.step) for s, c in self.kept if end - s >= first), default=float("inf"))


class GuessCost:
    """Least cost of a value over all ways to cut it; ``words`` come most frequent first and cost the logarithm of their rank.

    Every part of a value that is a word, a date, a repeat of a unit, or a walk along keyboard rows may be a piece.
    """

    def __init__(self, words: list[str] = WORDS):
        self.words = {w: log10(n + 2) for n, w in reversed(list(enumerate(words)))}
        self.longest = max(map(len, self.words), default=0)
        self.next = {a + b for row in ROWS for a, b in zip(row, row[1:])}
        self.next |= {p[::-1] for p in self.next}

    def word(self, value: str) -> float | None:
        """What a word costs, with its capitals; None if it is none."""
        cost = self.words.get(value.lower())
        if cost is None:
            return None
        odd = sum(c.isupper() for c in value)
        return cost + (0 if not odd else 0.3 if odd == len(value) or (odd == 1 and value[0].isupper()) else 0.3 * odd)

    def __call__(self, value: str) -> float:
        low = value.lower()
        if len(low) != len(value):  # a few letters get longer in lower case
            value = low
        n = len(value)
        dates: dict[int, list[tuple[int, float]]] = {}
        for start in range(n):
            if low[start].isdigit():
                for kind, cost in DATES:
                    if m := kind.match(low, start):
                        dates.setdefault(m.end(), []).append((start, cost))
        best = [0.0] * (n + 1)
        walk = Starts(1, WALK)
        repeats = {unit: [Starts(unit, 2) for _ in range(unit)] for unit in range(1, UNIT + 1)}
        for end in range(n + 1):
            if end:
                costs = [best[end - 1] + 1.0]
                for start in range(max(0, end - self.longest), end - 1):
                    if (cost := self.word(value[start:end])) is not None:
                        costs.append(best[start] + cost)
                costs += [best[start] + cost for start, cost in dates.get(end, ())]
                if low[end - 2 : end] not in self.next:
                    walk = Starts(1, WALK)
                    walk.add(end - 1, best[end - 1])
                costs.append(walk.cheapest(end) + FIRST)
                for unit, by_rest in repeats.items():
                    if end <= unit:
                        continue
                    if low[end - 1] != low[end - 1 - unit]:  # what repeats from here on starts in the last unit
                        by_rest = repeats[unit] = [Starts(unit, 2) for _ in range(unit)]
                        for start in range(end - unit, end):
                            by_rest[start % unit].add(start, best[start])
                    one = low[end - unit : end]
                    costs.append(by_rest[end % unit].cheapest(end) + min(unit, self.words.get(one, 99)))
                best[end] = min(costs)
            walk.add(end, best[end])
            for unit, by_rest in repeats.items():
                by_rest[end % unit].add(end, best[end])
        return best[n]


def base_spans(text: str) -> list[tuple[int, int, str]]:
    found = []
    if ASSIGN_WORDS.search(text):
        found += [(*m.span(), "assign") for m in ASSIGN.finditer(text) if len(m.group(2)) >= 6]
    found += [(*m.span(), "access") for m in ACCESS.finditer(text)]
    found += [(*m.span(), "hex") for m in HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[0], KINDS[s[2]], s[1]))


def costly_spans(text: str, cost: GuessCost, least: float) -> list[tuple[int, int, str]]:
    if not CONTEXT_WORDS.search(text):
        return []
    return [(*m.span(1), "guess") for m in CONTEXT.finditer(text) if len(m.group(1)) >= 6 and cost(m.group(1)) >= least]


def scan(docs: DataFrame, words: list[str] = WORDS, least: float = COSTLY) -> DataFrame:
    """(doc_id, spans) for every row of ``docs`` (doc_id, text); a span is (start, end, kind), code points, end exclusive.

    Kinds: ``assign``, ``access`` and ``hex`` of the fixed patterns, leftmost and not overlapping within a kind, and ``guess`` for
    values in credential context that cost ``least`` or more. Sorted by start, then kind. Null and empty texts have none.
    Repeated rows are each scanned. No shuffle.
    """
    source = docs.select("doc_id", "text")
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cost = GuessCost(words)
        for batch in batches:
            rows = []
            for text in (t.as_py() for t in batch.column(1)):
                spans = base_spans(text) + costly_spans(text, cost, least) if text else []
                rows.append([{"start": s, "end": e, "kind": k} for s, e, k in sorted(spans, key=lambda s: (s[0], KINDS[s[2]], s[1]))])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, kind)], ["doc_id", "spans"])

    return source.mapInArrow(run, f"doc_id {source.schema['doc_id'].dataType.simpleString()}, spans array<struct<start:int,end:int,kind:string>>")


@query("op9_secret_scan")
def op9(spark, sf_dir):
    found = scan(documents(spark, sf_dir))
    of = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    listed = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    base = F.filter("spans", lambda s: s["kind"] != "guess")
    return found.select(
        "doc_id", of("assign"), of("access"), of("hex"), F.sha2(listed(base).cast("binary"), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"),
    )

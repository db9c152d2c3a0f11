"""Secret scans with multipart credential linking.

Strong patterns are secrets by themselves. Weak ones, such as an account name, a mixed token or a server
address, are common in clean text: they count only where the parts that complete a credential stand near.
Each part's interval, widened by a reach, is joined with the intervals of the complementary parts by a
sorted sweep inside each text, so that a text with many parts makes no pairs.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .store import small_batches

#: The strong kinds. A match that is too short is dropped, after it was consumed.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
BASE = ("assign", "access", "hex")

#: The weak kinds.
ACCOUNT = re.compile(r"""\b(?:user(?:name)?|login|account|client_?id|access_?key_?id)["']?\x20*[:=]\x20*["']?([A-Za-z0-9._@-]{3,})""", re.IGNORECASE | re.ASCII)
MIXED = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}={0,2}", re.ASCII)
SERVER = re.compile(r"""\b(?:host|endpoint|server)["']?\x20*[:=]\x20*["']?[A-Za-z0-9.-]+(?::[0-9]+)?""", re.IGNORECASE | re.ASCII)
_SCHEME_END = re.compile(r"""://[^\s"'<>]+""", re.ASCII)
_SCHEME_START = re.compile(r"\b[a-z]", re.IGNORECASE | re.ASCII)
_SCHEME = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+.-")
KINDS = (*BASE, "linked_account", "linked_secret", "linked_endpoint")


class Span(NamedTuple):
    start: int
    end: int
    kind: str


def base_spans(text: str) -> list[Span]:
    """The strong spans, by start and then by kind as listed; positions are code points."""
    found = [Span(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        found += [Span(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [Span(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return sorted(found, key=_order)


def _order(span: Span) -> tuple[int, int, int]:
    return span.start, KINDS.index(span.kind), span.end


class _Intervals:
    """Spans by start, of which it is told whether one lies within ``reach`` of another."""

    def __init__(self, spans: list[Span]):
        self.spans = sorted(spans)
        self.starts = [x.start for x in self.spans]
        self.ends = []  # the furthest end so far
        for x in self.spans:
            self.ends.append(max(x.end, self.ends[-1] if self.ends else 0))

    def near(self, span: Span, reach: int) -> bool:
        last = bisect_left(self.starts, span.end + reach) - 1
        return last >= 0 and self.ends[last] > span.start - reach


def linked_spans(text: str, base: list[Span], reach: int) -> list[Span]:
    """The weak spans that complete a credential.

    An account needs a secret near, a mixed token an access identifier or account, an endpoint both. Spans
    that overlap a strong one add nothing.
    """
    strong = _Intervals(base)
    fresh = lambda spans: [x for x in spans if not strong.near(x, 0)]
    accounts = fresh(Span(m.start(), m.end(), "linked_account") for m in ACCOUNT.finditer(text))
    identifiers = _Intervals([*accounts, *(x for x in base if x.kind == "access")])
    certain = [x for x in base if x.kind != "access"]
    if not identifiers.spans:
        return []
    mixed = fresh(Span(m.start(), m.end(), "linked_secret") for m in MIXED.finditer(text) if _mixed(m[0]))
    named = _Intervals(accounts)
    mixed = [x for x in mixed if identifiers.near(x, reach) and not named.near(x, 0)]
    secrets = _Intervals([*certain, *mixed])
    if not secrets.spans:
        return []
    ends = fresh(Span(start, end, "linked_endpoint") for start, end in endpoints(text))
    return [
        *(x for x in accounts if secrets.near(x, reach)),
        *mixed,
        *(x for x in ends if secrets.near(x, reach) and identifiers.near(x, reach)),
    ]


def endpoints(text: str) -> Iterator[tuple[int, int]]:
    """Server addresses, leftmost and not overlapping: a scheme and what follows it, or a named server.

    A scheme is looked for from its ``://`` back, so that a text of many dots and words is read once.
    """
    at, where = 0, 0
    server = SERVER.search(text)
    tail = _SCHEME_END.search(text)
    while server or tail:
        address = None
        while tail and address is None:
            if tail.start() >= at:
                first = tail.start()
                while first > max(at, where) and text[first - 1] in _SCHEME:
                    first -= 1
                address = _SCHEME_START.search(text, first, tail.start())
            if address is None:
                where = tail.end() if tail.end() <= at else tail.start() + 1
                tail = _SCHEME_END.search(text, max(where, at))
        if server and (address is None or server.start() < address.start()):
            found = server.span()
        elif address:
            found = address.start(), tail.end()
        else:
            return
        yield found
        at = found[1]
        if tail and tail.start() < at:
            tail = _SCHEME_END.search(text, at)
        if server and server.start() < at:
            server = SERVER.search(text, at)


def _mixed(token: str) -> bool:
    return any(map(str.isupper, token)) and any(map(str.islower, token)) and any(map(str.isdigit, token))


def text_spans(text: str, reach: int = 200) -> list[Span]:
    """All spans of a text, in order."""
    base = base_spans(text)
    return sorted([*base, *linked_spans(text, base, reach)], key=_order)


def _said(spans: list[Span]) -> str:
    return ",".join(f"{x.kind}:{x.start}:{x.end}" for x in spans)


_FOUND = T.StructType().add("n_assign", "long").add("n_access", "long").add("n_hex", "long").add("base_sha256", "string").add("spans", "string")


def find_secrets(docs: DataFrame, reach: int = 200) -> DataFrame:
    """Secrets of every row's whole text: (doc_id, n_assign, n_access, n_hex, base_sha256, spans).

    ``spans`` lists kind:start:end in order, comma-joined, in code points with the end exclusive.
    ``base_sha256`` is the hash of that list for the strong kinds alone. ``reach`` is how far apart, in code
    points, the parts of a credential may stand.

    Null and empty texts have no spans. Repeated rows, and rows with a null doc_id, have a row each. Other
    columns are not read. No row is shuffled.
    """

    small_batches(docs.sparkSession)

    @F.pandas_udf(_FOUND)
    def scan(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for part in texts:
            rows = []
            for text in part:
                spans = text_spans(text or "", reach)
                base = [x for x in spans if x.kind in BASE]
                kinds = [x.kind for x in base]
                rows.append((*map(kinds.count, BASE), hashlib.sha256(_said(base).encode()).hexdigest(), _said(spans)))
            yield pd.DataFrame(rows, columns=_FOUND.names)

    return docs.select("doc_id", scan(F.col("text").cast("string")).alias("found")).select("doc_id", "found.*")


def without_secrets(docs: DataFrame, reach: int = 200, mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with each secret's span, or run of overlapping spans, replaced by ``mark``.

    ``n_chars``, where there is such a column, follows. Null texts stay null; no row is dropped.
    """

    small_batches(docs.sparkSession)

    @F.pandas_udf("string")
    def clean(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in texts:
            out = []
            for text in part:
                pieces, at, reached = [], 0, -1
                for span in text_spans(text, reach) if text else ():
                    if span.start >= reached:
                        pieces += [text[at : span.start], mark]
                    reached = at = max(reached, span.end)
                out.append("".join([*pieces, text[at:]]) if pieces else text)
            yield pd.Series(out, dtype=object)

    cleaned = docs.withColumn("text", clean(F.col("text").cast("string")))
    if "n_chars" in docs.columns:
        cleaned = cleaned.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast(docs.schema["n_chars"].dataType)))
    return cleaned.select(*[F.col(f"`{c}`") for c in docs.columns])

"""Periodic runs against plain versions, and odd inputs."""

import hashlib
import random
import re
import time
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from trialframe.llm import runs as R
from trialframe.llm.queries import queries

SF = "/root/testdata/sf0.001"


def plain_runs(words):
    n, out = len(words), []
    for q in range(1, n // 3 + 1):
        i = q
        while i < n:
            j = i
            while j < n and words[j] == words[j - q]:
                j += 1
            start, length = i - q, j - i + q
            if j > i and length >= max(24, 3 * q) and not any(all(words[k] == words[k - p] for k in range(start + p, j)) for p in range(1, q)):
                out.append((start, length, q))
            i = j + 1
    return sorted(out, key=lambda x: (x[0], x[2]))


@settings(max_examples=300, deadline=None)
@given(st.data())
def test_runs_equal_plain_search(data):
    kinds = data.draw(st.integers(1, 4))
    words = data.draw(st.lists(st.integers(0, kinds - 1), max_size=110))
    for _ in range(data.draw(st.integers(0, 3))):
        if len(words) > 30:
            a, p = data.draw(st.integers(0, len(words) - 25)), data.draw(st.integers(1, 20))
            for i in range(a + p, min(len(words), a + p + data.draw(st.integers(0, 90)))):
                words[i] = words[i - p]
    assert [tuple(x) for x in R.word_runs(words)] == plain_runs(words)


def plain_row(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
    runs = plain_runs(words)
    drop = {i for s, length, q in runs for i in range(s + q, s + length)}
    best = max(runs, key=lambda x: (x[1] / x[2], -x[0], -x[2]), default=None)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return (
        len(runs),
        *(best and (*best, 1000 * best[1] // best[2]) or (None,) * 4),
        sha("".join(f"{s},{length},{q}\n" for s, length, q in runs)),
        sha(" ".join(w for i, w in enumerate(words) if i not in drop)),
    )


def test_query_equals_plain_version(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = {r.doc_id: (r.n_runs, r.start, r.length, r.period, r.exponent_milli, r.runs_sha256, r.collapsed_sha256) for r in queries()["op11_periodic_runs"](spark, SF).collect()}
    short = {i: x for i, x in docs.items() if len((x or "").split()) <= 600}
    assert got.keys() == docs.keys() and len(short) > 100
    assert {i: got[i] for i in short} == {i: plain_row(i, x) for i, x in short.items()}
    assert any(x[0] for x in got.values())


def test_odd_rows(spark):
    text = "x " + "a b " * 20
    rows = [(1, None, "z"), (2, "", "z"), (None, text, "z"), (3, text, "z"), (3, text, "z"), (4, " \t\n", None), (5, "é " * 30 + "\u00a0", "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, start string")
    got = sorted(R.periodic_runs(docs).select("doc_id", "n_runs", "start", "length", "period", "n_words", "n_dropped").collect(), key=str)
    assert sorted(map(tuple, got), key=str) == sorted([(1, 0, None, None, None, 0, 0), (2, 0, None, None, None, 0, 0), (4, 0, None, None, None, 0, 0), *[(i, 1, 1, 40, 2, 41, 38) for i in (None, 3, 3)], (5, 1, 0, 30, 1, 31, 29)], key=str)
    assert R.periodic_runs(docs.limit(0)).count() == 0
    assert {tuple(r) for r in R.run_places(docs).collect()} == {(None, 1, 40, 2), (3, 1, 40, 2), (5, 0, 30, 1)}


@pytest.mark.parametrize("make", [lambda n: ["a"] * n, lambda n: [i % 7 for i in range(n)], lambda n: [(i * i) % 11 for i in range(n)], lambda n: list(range(n // 4)) * 4, lambda n: list(map(int, random.Random(1).choices("01", k=n)))])
def test_time_is_nearly_linear(make):
    def took(n):
        words = make(n)
        began = time.process_time()
        R.word_runs(words)
        return time.process_time() - began

    took(2000)
    assert took(80_000) < 16 * max(took(10_000), 0.05)

"""Operators whose results SQL does not hold, against plain versions, on the driver's tables."""

import hashlib
import math
import re
import time

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from trialframe.llm import quality as Q
from trialframe.llm import secrets as S
from trialframe.llm.chat import preference_pairs, with_other_answers
from trialframe.llm.packing import GROUP_PIECES, pack
from trialframe.llm.queries import queries, tokenizer_path

SF = "/root/testdata/sf0.001"


# --- quality ---------------------------------------------------------------------------------------------------


def plain_ftrl(examples, start, epochs=Q.EPOCHS):
    """One shard's weights by the update rules, coordinate by coordinate."""
    bias = 1 << Q.BITS
    w, n = dict(start), {}
    z = {i: -x * (Q.BETA / Q.ALPHA + (0 if i == bias else Q.L2)) - (0 if i == bias else math.copysign(Q.L1, x)) for i, x in start.items() if x}
    for _ in range(epochs):
        for values, label in examples:
            x = {**values, bias: 1.0}
            p = 1 / (1 + math.exp(-max(-30, min(30, sum(w.get(i, 0.0) * v for i, v in x.items())))))
            for i, v in x.items():
                g, was = (p - label) * v, n.get(i, 0.0)
                n[i] = was + g * g
                z[i] = z.get(i, 0.0) + g - (math.sqrt(n[i]) - math.sqrt(was)) / Q.ALPHA * w.get(i, 0.0)
                rate = (Q.BETA + math.sqrt(n[i])) / Q.ALPHA
                w[i] = -z[i] / rate if i == bias else 0.0 if abs(z[i]) <= Q.L1 else -(z[i] - math.copysign(Q.L1, z[i])) / (rate + Q.L2)
    return w


def test_scores_equal_plain_updates(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    order = labels.withColumns({"turn": F.xxhash64("doc_id"), "held": F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0}).filter("not held and quality in (0, 1)").collect()
    texts = {r.doc_id: r.text for r in docs.collect()}
    known = sorted((r.turn, r.quality, r.doc_id) for r in order if r.doc_id in texts)
    names = list(texts)
    places = dict(zip(names, Q.text_features(pa.array([texts[i] for i in names], pa.string())), strict=True))

    def values(doc_id):
        out = {}
        for at in places[doc_id].tolist():
            out[at] = out.get(at, 0) + Q.SCALE / len(places[doc_id])
        return out

    weights = {}
    for _ in range(Q.ROUNDS):
        total = {}
        for shard in range(Q.SHARDS):
            rows = [(values(d), label) for turn, label, d in known if turn % Q.SHARDS == shard]
            for i, x in plain_ftrl(rows, weights).items() if rows else ():
                total[i] = total.get(i, 0.0) + x * len(rows) / len(known)
        weights = total
    expected = {i: 1 / (1 + math.exp(-(weights[1 << Q.BITS] + sum(weights.get(at, 0.0) * v for at, v in values(i).items())))) for i in names}
    got = {r.doc_id: r.score for r in queries()["op2_quality_classifier"](spark, SF).collect()}
    assert got.keys() == expected.keys() and all(abs(got[i] - expected[i]) < 1e-4 for i in names)


def test_features_of_a_very_long_text():
    n = 300_000
    (found,) = Q.text_features(pa.array(["word Other 3.5, " * (n // 3)]))
    assert len(found) == 5 * n - 4 and len(set(found.tolist())) < 30


# --- secrets ---------------------------------------------------------------------------------------------------

ENDPOINT = re.compile(r"""\b(?:[a-z][a-z0-9+.-]*://[^\s"'<>]+|(?:host|endpoint|server)["']?\x20*[:=]\x20*["']?[A-Za-z0-9.-]+(?::[0-9]+)?)""", re.IGNORECASE | re.ASCII)
ASSIGN = re.compile("([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")


def plain_base(text):
    found = [(m.start(), 0, "assign", m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    found += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return [(kind, a, b) for a, _, kind, b in sorted(found)]


def plain_links(text, base, reach):
    """Every part compared with every other."""
    near = lambda x, y, far: x[1] < y[2] + far and y[1] < x[2] + far
    fresh = lambda kind, found: [x for x in ((kind, m.start(), m.end()) for m in found) if not any(near(x, y, 0) for y in base)]
    accounts = fresh("linked_account", S.ACCOUNT.finditer(text))
    names = accounts + [x for x in base if x[0] == "access"]
    mixed = fresh("linked_secret", (m for m in S.MIXED.finditer(text) if re.search("[A-Z]", m[0]) and re.search("[a-z]", m[0]) and re.search("[0-9]", m[0])))
    mixed = [x for x in mixed if any(near(x, y, reach) for y in names) and not any(near(x, y, 0) for y in accounts)]
    secrets = mixed + [x for x in base if x[0] != "access"]
    accounts = [x for x in accounts if any(near(x, y, reach) for y in secrets)]
    ends = [x for x in fresh("linked_endpoint", ENDPOINT.finditer(text)) if any(near(x, y, reach) for y in secrets) and any(near(x, y, reach) for y in names)]
    return accounts + mixed + ends


@pytest.mark.parametrize("sf_dir", ["/root/testdata/sf0.01", "/root/testdata/sf0.1"])
def test_spans_equal_plain_scans(spark, sf_dir):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    said = lambda spans: ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
    rows = queries()["op10_secret_scans"](spark, sf_dir).collect()
    assert len(rows) == len(texts) and sum(r.n_assign + r.n_access + r.n_hex for r in rows) > 0
    for r in rows:
        base = plain_base(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(said(base).encode()).hexdigest()
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(k == kind for k, _, _ in base) for kind in S.BASE]
        spans = base + plain_links(texts[r.doc_id], base, 200)
        assert r.spans == said(sorted(spans, key=lambda x: (x[1], S.KINDS.index(x[0]), x[2])))


def test_a_dump_of_credentials_is_swept():
    line = "login: someone{0} at https://host{0}.example/ Zx9Yw8Vu7Ts6Rq5Po4{0:06d}\n"
    text = "".join(line.format(i) for i in range(10_000))
    began = time.perf_counter()
    spans = S.text_spans(text)
    assert len(spans) == 30_000 and time.perf_counter() - began < 20
    short = "".join(line.format(i) for i in range(40))
    assert sorted(S.text_spans(short)) == sorted(S.Span(a, b, k) for k, a, b in plain_links(short, [], 200))


# --- packing, chat ---------------------------------------------------------------------------------------------


def test_very_many_empty_documents(spark):
    n = 12 * GROUP_PIECES
    docs = spark.range(n).select(F.col("id").alias("doc_id"), F.lit(None).cast("string").alias("text"))
    got = pack(docs, tokenizer_path("word_bpe_49k.json")).groupBy("sequence_id").agg(F.sum("length").alias("n"), F.count_distinct("offset").alias("places"), F.max("offset").alias("last")).collect()
    assert sum(r.n for r in got) == n and all(r.n == r.places == r.last + 1 <= 4096 for r in got) and len(got) <= n / 4096 + 12


def test_most_pairs_share_turns(spark):
    got = queries()["op3_preference_formatting"](spark, SF).collect()
    assert sum(r.prompt_turns > 0 for r in got) > 0.8 * len(got) > 0 and all(r.chosen != r.rejected for r in got if r.prompt_turns > 0 and r.chosen)


def test_pairs_of_odd_conversations(spark):
    kind = "conv_id long, turn long, role string, text string"
    rows = [(0, 0, "user", "hi"), (0, 1, "assistant", "yes"), (1, 0, "user", "hi"), (1, 1, "assistant", "no"), (2, 0, "user", "alone"), (2, 1, "assistant", "so"), (4, 0, "user", "unanswered"), (None, 0, "assistant", "x"), (6, None, "assistant", "y")]
    rows += [(8, 0, "user", "a"), (8, 0, "user", "a"), (8, 0, "user", None), (8, 1, "assistant", None)]
    turns = spark.createDataFrame(rows, kind).withColumn("pair_id", F.lit("clash"))
    got = {r.pair_id: r for r in preference_pairs(with_other_answers(turns)).collect()}
    assert got.keys() == {0, 1, 2, 8}
    assert (got[0].prompt_turns, got[0].chosen, got[0].rejected) == (1, "<|assistant|>\nyes<|end|>\n", "<|assistant|>\nno<|end|>\n")
    assert got[2].rejected == "<|assistant|>\n<|end|>\n" and got[8].prompt_turns == 3
    assert preference_pairs(with_other_answers(spark.createDataFrame([], kind))).count() == 0


# --- the pipeline's stages -------------------------------------------------------------------------------------


def test_stages_on_odd_rows(spark):
    import corpus_pipeline as P

    kind = "doc_id long, text string, lang string, source string, n_chars long"
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(1, text, "en", "a", None), (1, text, "en", "a", None), (1, "other words entirely here and now", "en", None, 3), (None, text, None, "b", None), (3, None, "en", "a", 0), (4, "", "en", "a", 0), (None, None, None, None, None), (5, f"{text} token=abcdef123", "en", "b", 1)]
    docs = spark.createDataFrame(rows, kind)
    kept = P.near_dedup(spark, docs, SF).collect()
    assert sorted(r.text or "" for r in kept) == sorted(["", "", "", text, "other words entirely here and now"])
    clean = P.secret_scans(spark, docs, SF)
    assert clean.columns == docs.columns and clean.count() == len(rows) and clean.filter("text like '%abcdef123%'").count() == 0
    mixed = P.source_mixing(spark, docs, SF)
    assert mixed.columns == docs.columns and mixed.filter("text is null or text = ''").count() == 0
    packed = P.packing(spark, docs, SF).collect()
    assert len(packed) == len(rows) and sum(r.doc_tokens for r in packed) == sum(r.length for r in packed)
    assert P.quality_classifier(spark, docs, SF).columns == docs.columns
    empty = spark.createDataFrame([], kind)
    for name, stage in P.STAGES:
        out = stage(spark, empty, SF)
        assert out.count() == 0, name
        assert name == "packing" or out.columns == docs.columns

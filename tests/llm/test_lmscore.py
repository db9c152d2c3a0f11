"""Language-model scores against plain versions, and odd inputs."""

import collections
import itertools
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from trialframe.llm import lmscore as L
from trialframe.llm.queries import queries
from trialframe.llm.words import text_words

SF = "/root/testdata/sf0.001"


def plain_base(docs):
    """Of each (doc_id, text) in order: (held out, tokens, known ones, N, base score)."""
    lower = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})
    tokens = [[*re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(lower)), None] for _, text in docs]
    held = [i is None or zlib.crc32(str(i).encode()) % 5 == 1 for i, _ in docs]
    counts = collections.Counter(t for x, h in zip(tokens, held, strict=True) if not h for t in x)
    size, distinct = sum(counts.values()), len(counts)
    return [(h, len(x), sum(counts[t] > 0 for t in x), size, sum(math.log10((counts[t] + 0.5) / (size + 0.5 * (distinct + 1))) for t in x)) for x, h in zip(tokens, held, strict=True)]


def same(got, expected):
    return got[:4] == expected[:4] and math.isclose(got[4], expected[4], rel_tol=1e-9, abs_tol=1e-9)


def test_query_equals_plain_counts_and_predicts(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    got = {r.doc_id: r for r in queries()["op13_lm_scoring"](spark, SF).collect()}
    assert got.keys() == {i for i, _ in docs}
    for (i, text), expected in zip(docs, plain_base(docs), strict=True):
        r = got[i]
        assert same((r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score), expected)
        assert r.n_bytes == len((text or "").encode()) and r.score < 0
        assert math.isclose(r.bits_per_byte, -r.score * math.log2(10) / max(1, r.n_bytes), rel_tol=1e-9)
    held = [r for r in got.values() if r.held_out]
    assert sum(r.score for r in held) * -math.log2(10) / sum(r.n_bytes for r in held) < 3.6  # bits a byte, 200 texts learned


def test_odd_rows(spark):
    rows = [(1, None, "k"), (2, "", "k"), (None, "A b", "k"), (3, "Long " * 5 + "x" * 500 + " end. " + "y" * 48 + "\n" + "z" * 47, None), (3, "A b", "k"), (3, "A b", "k"), (4, " \t\n" * 40, "k"), (5, "é E É", "k"), (6, "x" * 96 + " ", "k"), (11, "x" * 500 + "\n" + "X" * 500, "k")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, key string")
    got = sorted((str(r.doc_id), r.n_bytes, r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in L.score_texts(docs).collect())
    plain = sorted((str(i), len((t or "").encode()), *x) for (i, t, _), x in zip(rows, plain_base([r[:2] for r in rows]), strict=True))
    assert len(got) == len(plain) and all(g[:2] == p[:2] and same(g[2:7], p[2:]) for g, p in zip(got, plain, strict=True))
    assert all(math.isfinite(g[7]) and g[7] < 0 for g in got)
    assert L.score_texts(docs.limit(0)).count() == 0
    (nothing,) = L.score_texts(docs.filter("doc_id is null")).collect()  # nothing to learn from
    assert (nothing.train_tokens, nothing.base_score) == (0, 0.0) and math.isclose(nothing.score, -(3 + 3) * 8 * math.log10(2), rel_tol=1e-6)


def learned(texts):
    """A model, and the slice of the texts that it was learned from."""
    part = L._Slice()
    for words in text_words(pa.array(texts)):
        part.add(words, [None] * (words.last - words.first), [False] * (words.last - words.first))
    ((listed,),) = (b.column("keys").to_pylist() for b in part.rows(0))
    keys, often = L._keys_unpacked(listed)
    rows = [(k, n) for k, n in zip(keys.to_pylist(), often.tolist(), strict=True) if k[:1] == b"u"]
    batch = pa.RecordBatch.from_arrays([pa.array([k for k, _ in rows]), pa.array([n for _, n in rows])], names=["key", "c"])
    tables = np.zeros((L.PREDICTORS, 1 << L.TABLE_BITS), np.uint8)
    for b in L._summed(L._counted([batch])):
        for r in b.to_pylist():
            tables[r["predictor"], r["block"] << L.BLOCK_BITS : (r["block"] + 1) << L.BLOCK_BITS] = np.frombuffer(r["states"], np.uint8)
    model = L.Model.new(tables)
    L.Learner(model).step([k[1:] for k, _ in rows], np.array([n for _, n in rows]))
    return model, part, dict(rows)


def test_counts_of_places_are_those_of_the_units():
    draw = random.Random(2)
    model, _, counts = learned([" ".join(draw.choices(["the", "thing", "Than", "a", "x."], k=30)) + "\n" for _ in range(20)])
    keys = [k[1:] for k in counts]
    of = L.unit_bits(keys)
    for k in range(L.PREDICTORS):
        seen = collections.defaultdict(lambda: [0, 0])
        for place, bit, unit in zip(of.places(k).ravel().tolist(), of.bits.ravel().tolist(), np.broadcast_to(of.unit, of.bits.shape).ravel().tolist(), strict=True):
            n = counts[b"u" + keys[unit]]
            seen[place][bit] += n if k < 4 or n > 1 else 0
        places = np.array(list(seen))
        zeros, ones = (np.array([x[i] for x in seen.values()], float) for i in (0, 1))
        assert (model.tables[k][places] == L.states(zeros, ones)).all()


def test_probabilities_of_all_bytes_add_up_to_one():
    model, _, _ = learned(["the thing that the cat saw. \n" * 3])
    for before, stem in itertools.product(b"0nsw", (b"", b"th", b"the ")):
        # of the byte behind a stem: a unit's chance is that of its bytes and its stop, so compare prefixes by their bits
        keys = [bytes([before]) + stem + bytes([x]) for x in range(256) if x not in (0xFE, 0xFF)]
        of = L.unit_bits(keys)
        states = [model.tables[k][of.places(k)] for k in range(L.PREDICTORS)]
        dot, p, _ = model.mixed(of, states)
        p = (p + model.refine(of.node, dot)[0]) / 2
        p = np.where(of.bits == 1, p, 1 - p).prod(0)
        first = np.searchsorted(of.unit, np.arange(len(keys)))
        here = p[first + len(stem)]
        one = L.unit_bits([bytes([before]) + stem])
        states = [model.tables[k][one.places(k)] for k in range(L.PREDICTORS)]
        dot, p, _ = model.mixed(one, states)
        p = (p + model.refine(one.node, dot)[0]) / 2
        stop = np.where(one.bits == 1, p, 1 - p).prod(0)[len(stem)]
        assert here.min() > 0 and here.sum() + stop < 1 and here.sum() + stop > 0.9  # 0xFF has the rest


def test_states_lose_what_they_saw_last():
    for n0, n1 in itertools.product(range(9), range(9)):
        if 0 < n0 + n1 <= 8:
            (state,) = L.states(np.array([float(n0)]), np.array([float(n1)]))
            if n0:
                assert L._LESS[0, state] == L.states(np.array([n0 - 1.0]), np.array([float(n1)]))[0]
            if n1:
                assert L._LESS[1, state] == L.states(np.array([float(n0)]), np.array([n1 - 1.0]))[0]
    n = np.array([9.0, 1e3, 1e12])
    assert L.states(n, n * 0).max() < 256 and L.states(n * 0, n).max() < 256


@pytest.mark.parametrize("text", ["x" * 3_000_000, "word and word. " * 200_000, "é " * 500_000])
def test_very_long_texts(text):
    part = L._Slice()
    (words,) = text_words(pa.array([text]))
    part.add(words, [1], [False])
    rows = list(part.rows(0))
    assert len(L._keys_unpacked(rows[0].column("keys")[0].as_py())[0]) < 70_000 and L._unpacked(rows[-1].column("texts")[0].as_py())["n_bytes"].to_pylist() == [len(text.encode())]


def test_reruns_agree(spark):
    run = lambda: {r.doc_id: (r.base_score, r.score) for r in queries()["op13_lm_scoring"](spark, SF).collect()}
    first, second = run(), run()
    assert all(math.isclose(a, b, rel_tol=1e-9) for i in first for a, b in zip(first[i], second[i], strict=True))


def test_contexts_are_made_where_they_are_used():
    """Counting goes predictor by predictor: one of the last byte does not make those of four bytes or of whole units."""
    keys = [b"0the ", b"wcat\n", b"0" + b"x" * L.UNIT_BYTES, b"0\xff"]
    of = L.unit_bits(keys)
    first = of.places(0)
    assert len(of._last) == 1 and of._whole is None
    assert (L.unit_bits(keys[1:]).places(0) == first[:, 5:]).all() and (of.places(3) == L.unit_bits(keys).places(3)).all()
    assert len(of._last) == 4 and of._whole is None


@pytest.mark.parametrize("kind", [pa.binary(), pa.large_binary()])
def test_packed_keys_of_a_part(kind):
    keys = pa.array([b"ua", b"", b"tword", b"e", b"x" * 255], kind)
    for i, j in itertools.combinations_with_replacement(range(6), 2):
        got, counts = L._keys_unpacked(L._keys_packed(keys.slice(i, j - i), np.arange(i, j)))
        assert got.to_pylist() == keys.slice(i, j - i).to_pylist() and counts.tolist() == list(range(i, j))


def plain_follow(entries):
    """Of each entry (near, far, segment, count): known contexts, whether the segment is the one foreseen, and (others, it) in the near and far context."""
    found = []
    for near, far, segment, count in entries:
        seen = [collections.Counter(), collections.Counter()]
        for n, f, s, c in entries:
            own = 1 if (n, f, s, c) == (near, far, segment, count) and c else 0
            if n == near:
                seen[0][s] += c - own
                seen[1][s] += (c - own) * (f == far)
        gate = 2 if sum(seen[1].values()) else 1 if sum(seen[0].values()) else 0
        counts = seen[gate == 2]
        best = min((-c, s) for s, c in counts.items())[1] if gate else None
        states = [(sum(x.values()) - x[best], x[best]) if gate > k else (0, 0) for k, x in enumerate(seen)]
        found.append([gate | (segment == best) << 2, *(int(L.states(np.array([float(a)]), np.array([float(b)]))[0]) for a, b in states)])
    return found


@pytest.mark.parametrize("seed", range(20))
def test_what_follows_equals_plain_counts(seed):
    draw = random.Random(seed)
    entries = sorted({(draw.randrange(4), draw.randrange(3), draw.randrange(4)): draw.choice([0, 1, 1, 2, 5]) for _ in range(draw.choice([1, 5, 40]))}.items())
    entries = [(*k, c) for k, c in entries]
    got = L.followed(L._Follow(*np.array(entries).T))
    assert got.T.tolist() == plain_follow(entries)


def test_segments_are_all_of_a_text_and_cut_alike_in_copies():
    draw = random.Random(5)
    passage = " ".join("".join(draw.choices("abcdef", k=4)) for _ in range(300))
    texts = [passage, "", "Other words before. " * 3 + passage, "one two three", "again " * 200]
    (words,) = text_words(pa.array(texts))
    of = L._entries(words)
    assert of["per_segment"].sum() == len(of["kind"]) and of["segments"].sum() == len(of["segment"]) and len(of["segments"]) == len(texts)
    assert np.add.reduceat(of["per_segment"], np.cumsum(of["segments"]) - of["segments"]).tolist() == of["per_row"].tolist()
    bounds = np.append(0, np.cumsum(of["segments"]))
    pairs = [set(zip(of["near"][a:b].tolist(), of["segment"][a:b].tolist(), strict=True)) for a, b in itertools.pairwise(bounds)]
    assert (of["near"][bounds[:-1]] == 0).all() and len(pairs[0] & pairs[2]) > len(pairs[0]) - 5 and len(pairs[0]) > 20
    assert of["per_segment"].max() <= L.CUT_AT and not pairs[0] & pairs[4]


def test_packed_follow_lists():
    draw = random.Random(6)
    hashes = np.array([[draw.getrandbits(64) for _ in range(50)] for _ in range(3)], np.uint64)
    hashes[0, ::7] = 0
    take = np.array(draw.choices(range(50), k=400))
    trained = np.array(draw.choices([False, True], k=400))
    found, numbers = L._Follow.distinct(*hashes[:, take], trained)
    back = L._Follow.unpacked(found.packed())
    assert all((getattr(back, c) == getattr(found, c)).all() for c in ("near", "far", "segment", "count")) and (np.diff(back.near) >= 0).all()
    seen = collections.Counter(zip(take.tolist(), trained.tolist(), strict=True))
    for i, of, number in zip(take.tolist(), trained.tolist(), numbers.tolist(), strict=True):
        near, far, segment = (int(x) >> s for x, s in zip(hashes[:, i], (24, 40, 40), strict=True))
        assert number == -1 if not near else (back.near[number], back.far[number], back.segment[number], back.count[number]) == (near, far, segment, seen[i, True] * of)
    empty, _ = L._Follow.distinct(*np.zeros((3, 2), np.uint64), np.ones(2, bool))
    assert len(L._Follow.unpacked(empty.packed()).near) == 0 and list(L._split_follow(3)([pa.RecordBatch.from_pylist([{"slice": 0, "follow": empty.packed()}])])) == []


def test_chances_of_all_segments_add_up_to_one():
    codes = np.array([[x | hit << 2 for x in (1, 2) for hit in (1, 0, 0)], [1, 1, 1, 9, 9, 9], [0, 0, 0, 4, 4, 4]], np.uint8)
    alone = np.log10([0.5, 0.3, 0.2] * 2)
    weights = np.linspace(-1, 1, L._FOLLOW_CELLS)
    assert np.allclose((10 ** L._with_contexts(alone, codes, weights)).reshape(2, 3).sum(1), 1)
    assert (L._with_contexts(alone, np.zeros((3, 6), np.uint8), weights) == alone).all()


def test_words_are_predicted_from_earlier_words(spark):
    """A held-out text that training holds once or more costs less than one of the same words in another order."""
    draw = random.Random(7)
    held = [i for i in range(2000) if zlib.crc32(str(i).encode()) % 5 == 1]
    words = ["".join(draw.choices("abcdefgh", k=draw.randint(2, 6))) for _ in range(150)]
    texts = {i: " ".join(draw.choices(words, k=200)) for i in range(400) if i not in held}
    once, twice, *_ = texts
    texts[1_000_000 if zlib.crc32(b"1000000") % 5 != 1 else 1_000_001] = texts[twice]
    mixed = texts[once].split(" ")
    draw.shuffle(mixed)
    texts |= {held[0]: texts[once], held[1]: texts[twice], held[2]: " ".join(mixed)}
    got = {r.doc_id: r for r in L.score_texts(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    assert all(got[i].held_out for i in held[:3])
    assert got[held[0]].bits_per_byte < 0.5 * got[held[2]].bits_per_byte and got[held[1]].bits_per_byte < 0.5 * got[held[2]].bits_per_byte
    # a text that is learned from does not foresee itself, but its copy does
    assert got[once].bits_per_byte > 0.9 * got[held[2]].bits_per_byte and got[twice].bits_per_byte < 0.5 * got[once].bits_per_byte


@pytest.mark.parametrize("seen", [[], [0], [0, 0, 1, 0, 2, 2, 1, 3], list(range(400)) * 2])
def test_numbers_by_first_occurrence(seen):
    packed = L._first_as_0(np.array(seen, np.int64))
    assert L._numbered(packed).tolist() == seen and (packed == 0).sum() == len(set(seen))


def test_units_seen_once_are_counted_by_every_predictor(spark):
    counts = {b"0once ": 1, b"wonce ": 1, b"wonly ": 3, b"stwice\n": 2, b"n\xff": 1}
    keys = list(counts)
    packed = L._keys_packed(pa.array([b"u" + k for k in keys], pa.binary()), np.array(list(counts.values())))
    model = L.train(spark.createDataFrame([(bytearray(packed),)], "keys binary"), len(packed))
    of = L.unit_bits(keys)
    for k in range(L.PREDICTORS):
        seen = collections.defaultdict(lambda: [0, 0])
        for place, bit, unit in zip(of.places(k).ravel().tolist(), of.bits.ravel().tolist(), np.broadcast_to(of.unit, of.bits.shape).ravel().tolist(), strict=True):
            seen[place][bit] += counts[keys[unit]]
        zeros, ones = (np.array([x[i] for x in seen.values()], float) for i in (0, 1))
        assert (model.tables[k][list(seen)] == L.states(zeros, ones)).all() and (model.tables[k] > 0).sum() == len(seen)

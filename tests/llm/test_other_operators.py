"""Pages, archives, vectors, conversations and the pipeline."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from trialframe.llm.ann import nearest
from trialframe.llm.pages import RUN, main_text, page_blocks
from trialframe.llm.queries import oracle_sql, queries
from trialframe.llm.topk import best, exact_top_k
from trialframe.llm.warc import archive_pages, parse_arc, parse_warc, read_arc

SF = "/root/testdata/sf0.001"
VECTORS = "vec_id long, embedding array<float>"


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query_equals_its_sql(name, compare):
    found, expected = compare(queries()[name], oracle_sql()[name], SF)
    assert found == expected


# --- archives -------------------------------------------------------------------------------------------------


def test_arc_lines_by_version():
    v1 = b"filedesc://x 0.0.0.0 20240101000000 text/plain 76\n1 0 test\nURL IP-address Archive-date Content-type Archive-length\n"
    v1 = v1.replace(b" 76\n", b" %d\n" % (len(v1) - v1.index(b"\n") - 1))
    body = b"HTTP/1.1 200 OK\r\n\r\nhello\nhttp://not.a/record 1 2 3 4\n"
    records = list(parse_arc(v1 + b"\n" + b"http://a/ 1.2.3.4 20240101000000 text/html %d\n" % len(body) + body + b"\n" + b"http://b/ 1.2.3.4 20240101000000 text/html 0\n\n"))
    assert [(r.fields["URL"], r.block, r.error) for r in records] == [("http://a/", body, None), ("http://b/", b"", None)]
    assert list(parse_arc(v1 + b"http://a/ x\n"))[0].error.startswith("bad record line")
    assert list(parse_arc(v1 + b"http://a/ 1 2 t 99\nshort"))[0].error == "cut short"
    assert list(parse_arc(b"junk")) and list(parse_arc(b"")) == []
    assert list(parse_warc(b"WARC/1.1\r\nContent-Length: 9\r\n\r\nabc"))[0][2] == "cut short"


def test_archives_round_trip(spark):
    long = "a\r\n\r\nWARC/1.1\r\né" * 20
    rows = [(4, "http://h/ x", long), (3, None, long), (3, "again", long), (9, "u", None), (10, "u", ""), (None, "u", long), (11, "u", "short\n"), (12, "u", "short\n"), (13, "u", "z" * 300_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("payload", F.lit(1))
    got = archive_pages(pages).collect()
    assert len(got) == len(rows) and all(r.error is None for r in got)
    for page_id, _, html in rows:
        raw = (html or "").encode()
        own = [r for r in got if r.page_id == page_id and r.payload_bytes == len(raw)]
        assert own and all(r.payload_digest == hashlib.sha256(raw).hexdigest() for r in own)
    kinds = sorted((str(r.page_id), r.warc_type, r.refers_to) for r in got)
    assert kinds == sorted([("3", "response", None), ("3", "response", None), ("4", "revisit", 3), ("None", "revisit", 3), ("9", "response", None), ("10", "response", None), ("11", "response", None), ("12", "response", None), ("13", "response", None)])
    assert all((r.payload is None) == (r.warc_type == "revisit") for r in got)
    assert len({r.record_id for r in got}) == len(got)
    # revisits name a record that is there
    firsts = {r.record_id for r in got if r.page_id == 3}
    assert all((r.refers_id in firsts) == (r.warc_type == "revisit") for r in got)
    assert archive_pages(pages.limit(0)).count() == 0


def test_real_archives_byte_for_byte(spark, tmp_path):
    """Old character sets, images, errors, redirects and answers that are no HTTP message, of both versions."""
    import gzip

    from trialframe.llm.warc import ARC_FIELDS, _version_block, parse_warc, read_arc, read_warc, with_revisits, write_warc

    http = lambda status, more, body: f"HTTP/1.0 {status}\r\n{more}\r\n\r\n".encode("latin-1") + body
    blocks = {
        "http://a/latin": ("text/html", http("200 OK", "Content-Type: text/html; charset=iso-8859-1\r\nServer: Caf\xe9", "<p>na\xefve caf\xe9</p>".encode("latin-1"))),
        "http://a/image": ("image/gif", http("200 OK", "Content-Type: image/gif", b"GIF89a" + bytes(range(256)) * 3)),
        "http://a/again": ("image/gif", http("200 Fine", "Content-Type: image/gif\r\nX: 2", b"GIF89a" + bytes(range(256)) * 3)),
        "http://a/gone": ("text/html", http("404 Not Found", "Content-Type: text/html", b"no\0such page\n")),
        "http://a/moved": ("text/html", http("302 Found", "Location: http://b/", b"")),
        "http://a/unix": ("text/html", b"HTTP/1.0 200 OK\nContent-Type: text/html\n\nbody\r\n\r\nmore"),
        "http://a/headless": ("text/html", b"HTTP/1.0 200 OK"),
        "dns:a": ("text/dns", b"20240101\na. 1.2.3.4\n"),
        "http://a/crawler": ("application/octet-stream", bytes(range(255, -1, -1))),
    }
    for version in (1, 2):
        data = _version_block(version, "x.arc", "20240101000000") + b"\n"
        for i, (url, (media, block)) in enumerate(blocks.items()):
            more = f" 200 {'c%d' % i if i % 2 else '-'} {'http://b/' if 'moved' in url else '-'} 0 x.arc" if version == 2 else ""
            data += f"{url} 1.2.3.4 2024010100000{i} {media}{more} {len(block)}\n".encode() + block + b"\n"
        name = tmp_path / f"v{version}"
        name.mkdir()
        (name / "x.arc.gz").write_bytes(gzip.compress(data))
        read = read_arc(spark, f"file://{name}").withColumn("page_id", F.col("record_no"))
        rows = {r.url: r for r in read.collect()}
        assert {u: bytes(r.head) + bytes(r.payload) for u, r in rows.items()} == {u: b for u, (_, b) in blocks.items()} and not any(r.error for r in rows.values())
        assert (rows["http://a/moved"].location, rows["http://a/image"].checksum, rows["http://a/latin"].checksum, rows["http://a/latin"].result) == (("http://b/", "c1", None, "200") if version == 2 else (None,) * 4)
        write_warc(with_revisits(read), f"file://{tmp_path}/warc{version}")
        files = list((tmp_path / f"warc{version}").glob("part-*"))
        held = {}
        for file in files:
            raw = file.read_bytes()
            assert raw.count(b"\x1f\x8b\x08\0\0\0\0\0") >= len(blocks)  # a member for each record
            for fields, block, error in parse_warc(gzip.decompress(raw)):
                assert error is None
                held[fields.get("warc-target-uri")] = fields, block
        for url, (_, block) in blocks.items():
            fields, written_block = held[url]
            head, _, _ = block.partition(b"\r\n\r\n")
            assert written_block == (head + b"\r\n\r\n" if fields["warc-type"] == "revisit" else block)
            assert fields["warc-type"] == ("resource" if not block.startswith(b"HTTP/") else "revisit" if "again" in url else "response")
        assert held["http://a/image"][0].get("x-arc-checksum") == ("c1" if version == 2 else None)
        back = {r.uri: r for r in read_warc(spark, f"file://{tmp_path}/warc{version}").collect()}
        assert {u: (bytes(r.head), bytes(r.payload)) for u, r in back.items() if r.warc_type != "revisit"} == {u: (bytes(rows[u].head), bytes(rows[u].payload)) for u in blocks if "again" not in u}
        assert not any(r.error for r in back.values()) and back["http://a/again"].refers_id == back["http://a/image"].record_id and ARC_FIELDS


def test_old_archives(spark, tmp_path):
    """Two dates, a short one, a DNS answer and pages with one id."""
    from trialframe.llm.warc import ARC_FIELDS, read_arc, read_warc, with_revisits, write_warc

    body = b"x" * 120
    page = lambda n: b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\nX-Page-Id: %d\r\n\r\n" % n + body
    opening = f"1 0 test\n{ARC_FIELDS[1]}\n".encode()
    records = [("http://a/", "1999", "text/html", page(1)), ("http://b/", "20010203040506", "text/html", page(2)), ("dns:a", "200102", "text/dns", b"a 1.2.3.4"), ("http://b/", "20010203040506", "text/html", page(2))]
    data = b"filedesc://t 0.0.0.0 1999 text/plain %d\n" % len(opening) + opening
    for url, date, media, block in records:
        data += f"\n{url} 1.1.1.1 {date} {media} {len(block)}\n".encode() + block
    (tmp_path / "old.arc").write_bytes(data)
    write_warc(with_revisits(read_arc(spark, f"file://{tmp_path}/old.arc")), f"file://{tmp_path}/new")
    got = {r.record_id: r for r in read_warc(spark, f"file://{tmp_path}/new").filter("uri is not null").collect()}
    assert sorted((r.warc_type, r.uri, r.date, r.page_id, r.refers_to) for r in got.values() if r.uri != "dns:a") == [("response", "http://a/", "1999-01-01T00:00:00Z", 1, None)] + 2 * [("revisit", "http://b/", "2001-02-03T04:05:06Z", 2, 1)]
    (dns,) = (r for r in got.values() if r.uri == "dns:a")
    assert (dns.warc_type, dns.payload, dns.date, dns.error) == ("resource", b"a 1.2.3.4", "2001-02-01T00:00:00Z", None)
    assert {got[r.refers_id].page_id for r in got.values() if r.refers_to} == {1}


# --- pages ----------------------------------------------------------------------------------------------------


def test_blocks():
    page = """<html><head><title>T</title><script>var t="</p>";</script></head><body><header>Site</header><nav><ul><li>Home</ul></nav>
      <article class=post><h1>A &amp; B</h1><p><b>One<br><p>two&nbsp; three <i>four</i></p><div class="share-buttons">Share</div><!-- <p>no</p> --><aside>side</aside>
      <form>mail<input></form><section id="comments"><p>nice!</p></section><p>end &eacute;</p></article><footer>&copy; x</footer>"""
    assert [b.text for b in page_blocks(page) if b.role == "main"] == ["A & B", "One", "two three four", "end é"]
    assert page_blocks("") == [] and page_blocks("plain <") [0].text == "plain <"
    assert page_blocks("<p>a<p class='x' b=\"<\">c</p")[-1].text.startswith("c")


def test_host_boilerplate_of_undecided_blocks(spark):
    shared = "all rights reserved by the owners of this site since long ago"
    rows = [(i, f"http://{'h' if i < 6 else 'other'}.example/{i}", f"<p>{' '.join(f'word{i}x{k}' for k in range(20))}</p><div>{shared}</div>") for i in range(7)]
    rows += [(20, None, None), (21, "http://h.example/", ""), (0, rows[0][1], rows[0][2]), (None, "http://h.example/n", f"<div>mine {shared} alone</div>"), (22, "http://h.example/22", f"<article><p>{shared}</p></article>")]
    got = main_text(spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash"))).collect()
    assert len(got) == len(rows) and all(r.n_chars == len(r.text) for r in got)
    by = {r.page_id: r.text for r in got}
    assert by[1] == " ".join(f"word1x{k}" for k in range(20)) and shared in by[6]  # another host's only page
    assert by[20] == by[21] == "" and by[22] == shared and by[None] == "mine\n\nalone"
    assert len(shared.split()) > RUN
    assert main_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def words(name, n):
    return " ".join(f"{name}{k}" for k in range(n))


def page_texts(spark, rows):
    return {r.page_id: r.text for r in main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}


def test_host_runs_decide_beside_an_article(spark):
    notice = words("notice", 14)
    rows = [(i, f"http://h/{i}", f"<div>{words(f'lead{i}x', 12)}</div><article><p>{words(f'art{i}x', 30)}</p></article><div>{notice}</div>") for i in range(5)]
    rows += [(10, "http://alone/", "<article>text</article><div>beside it</div>")]
    got = page_texts(spark, rows)
    for i in range(5):
        assert got[i] == f"{words(f'lead{i}x', 12)}\n\n{words(f'art{i}x', 30)}"
    assert got[10] == "text"  # a host of one page tells nothing


def test_copies_quotations_and_phrases_are_kept(spark):
    own = lambda i: words(f"own{i}x", 40)
    phrase, quoted, notice = words("phrase", 6), words("quoted", 15), words("notice", 12)
    page = lambda i, more="": f"<div>{own(i)} {phrase} {own(i + 500)}{more}</div><div>{notice}</div>"
    rows = [(i, f"http://h/{i}", page(i, f" {quoted} end{i}" if i in (3, 4) else "")) for i in range(12)]
    rows += [(100 + i, f"http://h/7?id={i}", page(7)) for i in range(6)]  # equal pages
    rows += [(200 + i, f"http://h/8/print{i}", f"<div>printed {i}</div>" + page(8)) for i in range(6)]  # nearly equal ones
    rows += [(300 + i, "http://two/", f"<p>{own(900)}</p>") for i in range(2)]
    got = page_texts(spark, rows)
    for i in range(12):
        assert got[i] == f"{own(i)} {phrase} {own(i + 500)}" + (f" {quoted} end{i}" if i in (3, 4) else "")
    for i in range(6):
        assert got[100 + i] == got[7] and got[200 + i] == f"printed {i}\n\n{got[8]}"
    assert got[300] == got[301] == own(900)


def test_marks_of_the_layout():
    page = "<div class='content has-sidebar'><article><p>text</p></article><div class='sidebar'>side</div></div>"
    assert [(b.role, b.text) for b in page_blocks(page)] == [("main", "text"), ("boiler", "side")]
    assert [b.role for b in page_blocks("<div class='no-nav'>x</div><form id=page><main>y</main>z</form>")] == ["open", "main", "boiler"]


def test_what_markup_must_not_lose():
    main = lambda page: [b.text for b in page_blocks(page) if b.role == "main"]
    assert main("<article><p>one <a title=it's href=x>two</a> three don't stop</p></article>") == ["one two three don't stop"]
    assert main('<article><p>a <i title="1 > 0">b</i> c</p></article>') == ["a b c"]
    assert main("<article><p>a<select><option>x<p>after</p></article>") == ["a", "after"]
    assert main("<article><p>a<svg><title>t</title><p>b</p><object>c</object></article>") == ["a", "b", "c"]
    assert main("<article><p>E = <math><mi>m</mi></math> c</p></article>") == ["E = m c"]
    assert main("<div class='search-results-page main-content'><p class=social-history>x</p><p class='notice-board'>y</p><p class='ad-slot-1'>z</p></div>") == ["x", "y"]


def test_very_long_html():
    page = f"<nav>{'<a href=x>home</a> ' * 20_000}</nav><article><p>{'word ' * 100_000}</p></article>"
    assert [len(b.text) for b in page_blocks(page) if b.role == "main"] == [499_999]


def test_host_runs_equal_brute_force(spark):
    """Of pages without an article: what all long stretches that a host's pages share leave over."""
    import random

    from trialframe.llm.pages import LONG

    rng = random.Random(5)
    foot, head = words("foot", 13), words("head", 11)
    pages = {i: [words(f"own{i}a", rng.randint(5, 40)), f"{head} {words(f'own{i}b', rng.randint(3, 20))}", foot, words("short", 8) if i % 3 == 0 else words(f"own{i}c", 8)] for i in range(9)}
    got = page_texts(spark, [(i, "http://h/", "".join(f"<div>{x}</div>" for x in blocks)) for i, blocks in pages.items()])

    def stretches(block):
        tokens = block.split()
        marked = [False] * len(tokens)
        for a in range(len(tokens)):
            for b in range(a + LONG, len(tokens) + 1):
                piece = f" {' '.join(tokens[a:b])} "
                if sum(any(piece in f" {x} " for x in other) for other in pages.values()) >= 3:
                    marked[a:b] = [True] * (b - a)
        kept, run = [], []
        for token, gone in [*zip(tokens, marked, strict=True), ("", True)]:
            if gone and run:
                kept.append(" ".join(run))
                run = []
            elif not gone:
                run.append(token)
        return kept

    for i, blocks in pages.items():
        assert got[i] == "\n\n".join(x for block in blocks for x in stretches(block))


def test_a_stretch_is_repeated_as_a_whole(spark):
    """Runs of six tokens that lie on different pages do not make a long stretch that no other page has."""
    stretch = words("t", 12).split()
    whole = lambda i, x: f"<div>{words(f'own{i}a', 20)} {x} {words(f'own{i}b', 20)}</div>"
    pages = {i: whole(i, " ".join(stretch[:9] if i < 3 else stretch[3:])) for i in range(6)}
    pages[6] = whole(6, " ".join(stretch))
    pages |= {i: whole(i, words("same", 11)) for i in range(7, 10)}
    got = page_texts(spark, [(i, "http://h/", page) for i, page in pages.items()])
    for i in range(7):
        assert got[i] == pages[i][5:-6]
    assert [got[i] for i in range(7, 10)] == [f"{words(f'own{i}a', 20)}\n\n{words(f'own{i}b', 20)}" for i in range(7, 10)]


def test_suffixes_are_sorted_and_compared(spark):
    """Intervals are those of all suffixes that begin alike, in sorted order."""
    import itertools
    import random

    from trialframe.llm.pages import LONG, suffix_array

    rng = random.Random(3)
    keys = sorted({(1,) * RUN + tuple(rng.choices([1, 2], k=rng.randint(0, LONG - RUN))) for _ in range(40)} | {(1, 2), (2,) * LONG, (2,) * RUN + (3,)})
    rows = [(hash(k[:RUN]), list(k), i) for i, k in enumerate(keys)]
    got = suffix_array(spark.createDataFrame(rows + rows[:5], "bucket long, key array<long>, suffix long")).collect()
    assert sorted((r.suffix, r.depth) for r in got) == sorted((i, d) for i, k in enumerate(keys) for d in range(min(RUN, len(k)), len(k) + 1))
    name = {(r.suffix, r.depth): r.interval for r in got}
    for (i, a), (j, b) in itertools.combinations(enumerate(keys), 2):
        for d in range(RUN, min(len(a), len(b)) + 1):
            assert (name[i, d] == name[j, d]) == (a[:d] == b[:d])
            assert name[i, d] == min(x for x, k in enumerate(keys) if k[:d] == a[:d] and len(k) >= d)


# --- vectors --------------------------------------------------------------------------------------------------


def vectors(spark, seed=0, n=900, d=16):
    rng = np.random.default_rng(seed)
    rows = [(i, [float(x) for x in rng.normal(size=d)]) for i in range(n)]
    rows += [(100_001 + i, rows[3][1]) for i in range(30)]
    odd = [(202000, None), (202020, [1.0, None]), (202040, [float("nan")] * d), (202060, [float("inf")] * d), (None, rows[0][1]), (202080, [0.0] * d), (202100, rows[5][1][:3]), (202120, []), (20, rows[20][1])]
    return spark.createDataFrame(rows + odd, VECTORS).withColumn("vector", F.lit("clash")), rows + odd


def usable(rows):
    return [(i, np.array(v, np.float32).astype(float)) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]


def product(a, b):
    n = min(len(a), len(b))
    return sum(x * y for x, y in zip(a[:n], b[:n], strict=True))


def test_exact_search_equals_brute_force(spark):
    df, rows = vectors(spark)
    ints = [(i, [int(np.floor(64 * x)) for x in v]) for i, v in usable(rows)]
    got = {}
    for r in exact_top_k(df).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    for i, v in ints:
        if i % 20 == 0:
            scored = sorted(((product(v, w), j) for j, w in ints if j != i), key=lambda x: (-x[0], x[1]))[:20]
            assert sorted(got[i]) == [(k + 1, j, s) for k, (s, j) in enumerate(scored)]
    assert set(got) == {i for i, _ in ints if i % 20 == 0}


def test_exact_search_of_extremes(spark):
    df = spark.createDataFrame([(0, [1e30, 1.0]), (1, [1e30, 2.0]), (2, [-1e30, 0.0])], "vec_id long, embedding array<double>")
    got = exact_top_k(df).orderBy("rank").collect()
    assert [(r.vec_id, r.score) for r in got] == [(1, 2**63 - 1), (2, -(2**63))]
    assert exact_top_k(df.limit(0)).count() == 0
    assert best(np.array([3, 1, 3, 3]), 2).tolist() == [0, 2]


def test_neighbours_found(spark):
    df, rows = vectors(spark, n=4000)
    known = [(i, v) for i, v in usable(rows) if len(v) and np.any(v)]
    got = {}
    for r in nearest(df).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    exact = dict(known)
    hit = total = 0
    for i, v in known:
        if i % 20 == 0 and i < 2000:
            scored = sorted(((product(v, w), j) for j, w in known if j != i), key=lambda x: (-x[0], x[1]))[:20]
            own = sorted(got[i])
            assert [r for r, _, _ in own] == list(range(1, 21)) and [(-s, j) for _, j, s in own] == sorted((-s, j) for _, j, s in own)
            hit += len({j for _, j, _ in own} & {j for _, j in scored})
            total += 20
            assert all(abs(s - product(v, exact[j])) < 1e-9 for _, j, s in own if j not in (20,))
    assert hit >= 0.9 * total
    assert 202080 not in got and 202120 not in got


def test_neighbours_of_few(spark):
    few = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, [0.5, 0.5]), (3, [-1.0, 0.0])], VECTORS)
    assert [(r.rank, r.vec_id, r.score) for r in nearest(few).orderBy("rank").collect()] == [(1, 1, 0.5), (2, 2, 0.5), (3, 3, -1.0)]
    assert nearest(few.limit(0)).count() == 0


def test_recall_on_the_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = {r.vec_id: np.array(r.embedding, float) for r in df.collect()}
    ids = np.array(sorted(rows))
    table = np.stack([rows[i] for i in ids])
    got = {}
    for r in nearest(df).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    hit = 0
    for i, own in got.items():
        scores = table @ rows[i]
        scores[ids == i] = -np.inf
        hit += len(own & set(ids[np.argsort(-scores)[:20]].tolist()))
    assert hit >= 0.9 * 20 * len(got)


def test_recall_with_uneven_norms(spark):
    rng = np.random.default_rng(7)
    table = (rng.normal(size=(4000, 64)) * rng.lognormal(0, 1, size=(4000, 1))).astype(np.float32).astype(float)
    got = {}
    for r in nearest(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(table)], VECTORS)).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    hit = 0
    for i, own in got.items():
        scores = table @ table[i]
        scores[i] = -np.inf
        hit += len(own & set(np.argsort(-scores)[:20].tolist()))
    assert len(got) == 200 and hit >= 0.9 * 20 * len(got), hit / 20 / len(got)


# --- conversations --------------------------------------------------------------------------------------------


def test_preference_pairs(spark):
    from trialframe.llm.chat import preference_pairs

    rows = [(1, s, t, r, x) for s, turns in (("chosen", ["hi", "good"]), ("rejected", ["hi", "bad", None])) for t, (r, x) in enumerate(zip(["user", "assistant", None], turns))]
    rows += [(2, "chosen", 0, "user", "alone"), (None, "chosen", 0, "user", "x"), (3, "chosen", 0, "user", "a"), (3, "rejected", 0, "user", "a")]
    got = {r.pair_id: r for r in preference_pairs(spark.createDataFrame(rows, "pair_id long, side string, turn long, role string, text string").withColumn("prompt", F.lit(0))).collect()}
    assert set(got) == {1, 3}
    assert got[1].prompt == "<|user|>\nhi<|end|>\n" and got[1].prompt_turns == 1 and got[3].chosen == got[3].rejected == ""
    for text, mask, said in ((got[1].chosen, got[1].chosen_mask, "good"), (got[1].rejected, got[1].rejected_mask, "bad")):
        a, b = map(int, mask.split(":"))
        assert text[a:b] == f"{said}<|end|>\n"


# --- pipeline -------------------------------------------------------------------------------------------------


def test_pipeline_stages(spark):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, sizes = docs.columns, [docs.count()]
    for _, stage in p.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        assert docs.columns == columns
        sizes.append(docs.count())
    assert sizes[0] > sizes[1] > sizes[2] == sizes[3] > 0
    assert random.Random(0) and [s for s, _ in p.STAGES] == ["quality classifier", "MinHash near-dedup", "secret scans", "mixing sources to target weights", "packing"]
    pieces = p.run(spark, SF)
    assert pieces.groupBy("sequence_id").agg(F.sum("length").alias("n")).agg(F.max("n")).first()[0] <= 4096


def test_read_arc_of_nothing(spark, tmp_path):
    (tmp_path / "x.arc").write_bytes(b"")
    assert read_arc(spark, str(tmp_path)).count() == 0


def test_members_are_read_in_linear_time():
    """40,000 members of an archive; copying what is left of it for each takes some minutes."""
    import gzip
    import time

    from trialframe.llm.warc import _unzipped

    members = [gzip.compress(b"%d " % i * 20, mtime=0) for i in range(40_000)]
    started = time.process_time()
    assert _unzipped(b"".join(members)) == b"".join(b"%d " % i * 20 for i in range(40_000))
    assert time.process_time() - started < 5
    assert _unzipped(gzip.compress(b"") + b"\0\0" + gzip.compress(bytes(1 << 20))) == bytes(1 << 20)
    with pytest.raises(EOFError):
        _unzipped(b"".join(members)[:-3])


def test_payloads_are_not_moved(spark, tmp_path):
    """Revisits meet files as they are stored: no exchange holds a payload."""
    from trialframe.llm import warc

    pages = spark.createDataFrame([(i, f"http://x/{i}", f"<p>{i % 3}</p>" * 30) for i in range(12)], "page_id long, url string, html string")
    warc.write_arc(pages, f"{tmp_path}/arc/v2", 2)
    records = warc.read_arc(spark, f"{tmp_path}/arc/*")
    revisits = warc.with_revisits(records).filter("refers_to is not null").select("place", "refers_to", "refers_place", "refers_date")
    told = warc.read_arc(spark, f"{tmp_path}/arc/*", spark.createDataFrame(revisits.collect(), revisits.schema))
    plain = warc.with_revisits(records).select(*told.columns)
    key = lambda r: r["page_id"]
    assert sorted(told.collect(), key=key) == sorted(plain.collect(), key=key)
    assert sum(r["refers_to"] is not None for r in told.collect()) == 9
    moved = [line for line in told._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join" in line]
    assert moved and not any("payload" in line for line in moved)

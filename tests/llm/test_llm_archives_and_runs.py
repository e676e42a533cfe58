"""Archive conversion, tokenizer alignment and run detection against plain versions."""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import random
from itertools import product

import brute
import pytest

from keepsake.llm import alignment, queries, runs, warc
from keepsake.llm.store import new_path, written

SF = "/root/testdata/sf0.001"
ODD = [
    (1, None), (2, ""), (3, "  \n\t "), (4, "one two"), (5, "a b " * 40), (6, "x"), (7, "a b " * 40), (7, "other text of the id"),
    (8, "x  y\n z's <|endoftext|> <s> " * 300), (9, "é" * 900), (None, "lone " * 50), (10, "word " * 20000), (11, "é▁ b"),
    (12, "nul\x00 byte"), (13, "½ ﬁ wide　space"), (14, "12 34 !! " * 9), (15, " a b c d e f g h " * 9 + "z"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")


@pytest.fixture(scope="module")
def odd(spark):
    schema = "doc_id long, text string, runs string, n long, pairs string, chunk int, start int, groups string, w int"
    return spark.createDataFrame([(*r, "r", 1, "p", 2, 3, "g", 4) for r in ODD], schema)


# --- runs ---


def test_runs_of_random_words_equal_brute_force():
    draw = random.Random(3)
    for _ in range(400):
        texts = []
        for _ in range(draw.randint(1, 4)):
            text = []
            while len(text) < draw.randint(0, 150):
                if draw.random() < 0.6:
                    text += [draw.choice("abc") for _ in range(draw.randint(1, 9))] * draw.randint(1, 12)
                else:
                    text += [draw.choice("abcde") for _ in range(draw.randint(1, 5))]
            texts.append([x.encode() for x in text])
        least, exponent = draw.choice([(24, 3), (6, 3), (12, 4), (9, 3), (3, 3)])
        assert runs.runs_of(texts, least, exponent) == [brute.runs(t, least, exponent) for t in texts]


def test_long_and_nested_runs():
    assert runs.runs_of([[b"a"] * 20000]) == [[(0, 20000, 1)]]
    nested = ([b"a", b"b"] * 14 + [b"c"]) * 5
    assert runs.runs_of([nested, [], [b"x"]]) == [brute.runs(nested), [], []]
    fibonacci, before = [b"a", b"b"], [b"a"]
    while len(fibonacci) < 1500:
        fibonacci, before = fibonacci + before, fibonacci
    assert runs.runs_of([fibonacci]) == [brute.runs(fibonacci)]


@pytest.mark.parametrize("which", ["docs", "odd"])
def test_runs_query_equals_brute_force(request, monkeypatch, spark, which):
    frame = request.getfixturevalue(which)
    monkeypatch.setattr(queries, "table", lambda *_: frame)
    got = sorted((tuple(r) for r in queries.op13_runs(spark, SF).collect()), key=repr)
    want = []
    for doc_id, text in (tuple(r) for r in frame.select("doc_id", "text").collect()):
        w = brute.planted(doc_id, text)
        found = brute.runs(w) if len(w) < 5000 else [(0, len(w), 1)]
        best = min(found, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=(None, None, None))
        listed = "".join(f"{s},{n},{q}\n" for s, n, q in found)
        want.append((
            doc_id, len(found), *best, 1000 * best[1] // best[2] if found else None,
            hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(b" ".join(brute.collapsed(w, found))).hexdigest(),
        ))
    assert got == sorted(want, key=repr)


def test_runs_of_no_rows(odd):
    assert runs.find(odd.limit(0)).collect() == []
    assert runs.find(odd.unionByName(odd)).count() == 2 * len(ODD)
    with pytest.raises(ValueError):
        runs.find(odd, exponent=2)


# --- alignment ---


@pytest.mark.parametrize("which", ["docs", "odd"])
def test_alignment_equals_all_pairs(request, spark, which):
    frame = request.getfixturevalue(which)
    rows = [(i, r.text) for i, r in enumerate(frame.select("doc_id", "text").collect()) if len(r.text or "") < 4000]
    some = spark.createDataFrame(rows, "doc_id long, text string")
    aligned = written(alignment.align(some), "aligned-test")
    scored = {r.doc_id: r for r in alignment.scored(aligned).collect()}
    groups = {r.doc_id: r.groups for r in aligned.select("doc_id", "groups").collect()}
    names = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")
    got = {d: (*(r[n] for n in names), groups[d]) for d, r in scored.items()}
    assert got == brute.alignment(rows)


def test_alignment_of_odd_frames(odd, spark, monkeypatch):
    for frame, n in ((odd, len(ODD)), (odd.limit(0), 0), (odd.unionByName(odd), 2 * len(ODD))):
        monkeypatch.setattr(queries, "table", lambda *_, frame=frame: frame)
        rows = queries.op12_alignment(spark, SF).collect()
        assert len(rows) == n
        assert all((r.groups_sha256 == "") == (r.n_groups == 0) and r.n_best <= r.n_links for r in rows)


def test_pairs_ask_in_small_chunks_too(docs, spark, monkeypatch):
    whole = {r.doc_id: r for r in alignment.scored(written(alignment.align(docs), "aligned-test")).collect()}
    import keepsake.llm.alignment as module

    monkeypatch.setattr(module, "CHUNK_LINKS", 500)
    cut = written(alignment.align(docs), "aligned-test")
    assert cut.select("chunk").distinct().count() > 8
    assert {r.doc_id: r for r in alignment.scored(cut).collect()} == whole


def test_leaves_are_all_common_ends():
    draw = random.Random(4)
    for _ in range(2000):
        n = draw.randint(1, 40)
        a, b = (sorted({*draw.sample(range(1, n + 1), draw.randint(1, n)), n}) for _ in range(2))
        found = alignment.leaves(a, b)
        assert [a[a1 - 1] for _, a1, _, _ in found] == sorted(set(a) & set(b)) == [b[b1 - 1] for *_, b1 in found]
        begins = lambda ends, i: ends[i - 1] if i else 0
        links = {p for leaf in found for p in alignment.overlaps(a, b, leaf)}
        assert links == {
            (i, j) for i, j in product(range(len(a)), range(len(b))) if max(begins(a, i), begins(b, j)) < min(a[i], b[j])
        }


# --- archives ---

PAGES = [
    (1, "http://a.example/x y", "<p>same</p>"), (7, None, "<p>same</p>"), (3, "HTTP://B/é\n", "<p>same</p>"), (7, "dns:x", "<p>same</p>"),
    (4, "http://c", None), (5, "http://c", ""), (6, "", "<p>é alone</p>"), (None, "http://d", "<p>none</p>"), (None, "http://d", "<p>none</p>"),
    (9, "http://e", "HTTP/1.1 200 OK\r\n\r\nWARC/1.1\r\n\r\n"), (10, "http://f", "x\n" * 200000), (-2, "http://g", "\r\n\r\n\n"),
]


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame([(*p, "k", "r", 0) for p in PAGES], "page_id long, url string, html string, key string, record string, offset int")


def test_archive_query_of_odd_pages(spark, pages, monkeypatch):
    for frame, given in ((pages, PAGES), (pages.limit(0), []), (pages.unionByName(pages).repartition(3), PAGES + PAGES)):
        monkeypatch.setattr(queries, "table", lambda *_, frame=frame: frame)
        got = sorted((tuple(r) for r in queries.op11_warc(spark, SF).collect()), key=repr)
        bodies = {}
        for page_id, _, html in given:
            bodies.setdefault((html or "").encode(), []).append(page_id)
        want = []
        for body, ids in bodies.items():
            ids.sort(key=lambda i: (i is not None, i), reverse=True)
            digest = base64.b32encode(hashlib.sha1(body).digest()).decode()
            for at, page_id in enumerate(ids):
                want.append((page_id, len(body), digest, "revisit" if at else "response", ids[0] if at else None))
        assert got == sorted(want, key=repr)


def test_smaller_payloads_stay_whole(spark, pages):
    arcs, warcs = new_path(spark, "arc"), new_path(spark, "warc")
    warc.write_arc(pages, arcs)
    warc.convert(spark, arcs, warcs, least=12)
    kinds = {r.payload_bytes: r.record_type for r in warc.read_warc(spark, warcs).collect() if r.payload_bytes < 12}
    assert set(kinds.values()) == {"response"}


def test_a_lost_tasks_file_is_not_read(spark, pages):
    from pathlib import Path

    arcs, warcs = new_path(spark, "arc"), new_path(spark, "warc")
    warc.write_arc(pages.repartition(2), arcs, versions=(2,))
    one = next(Path(arcs.removeprefix("file:")).glob("files/*.gz"))
    (one.parent / "left-over.arc.gz").write_bytes(one.read_bytes())
    warc.convert(spark, arcs, warcs)
    assert warc.read_warc(spark, warcs).count() == len(PAGES)


def test_header_lines_of_either_version():
    for version in (1, 2):
        block = b"HTTP/1.0 200 OK\nServer: x\n\nbody\nof lines\n"
        values = {"URL": "http://h/a b", "IP-address": "1.2.3.4", "Archive-date": "19970315123456", "Content-type": "text/html", "Result-code": "404", "Location": "http://n"}
        text = gzip.decompress(warc.arc_begin(version, "f.arc", "20000101000000")) + gzip.decompress(warc.arc_member(version, values, block))
        text += gzip.decompress(warc.arc_member(version, values | {"URL": "dns:h", "Archive-date": "bad"}, b"answer"))
        (_, first, _), (_, one, body), (offset, two, answer) = warc.arc_records(io.BytesIO(text))
        assert first["URL"] == "filedesc://f.arc" and one["URL"] == "http://h/a b" and body == block and answer == b"answer"
        assert one.get("Result-code") == (None if version == 1 else "404") and text[offset:].startswith(b"dns:h")
        for fields, data, kind, date in ((one, body, "response", "1997-03-15T12:34:56Z"), (two, answer, "response", "2000-01-01T00:00:00Z")):
            made = gzip.decompress(warc.converted("f.arc", offset, fields, data, "2000-01-01T00:00:00Z", None))
            [(head, back)] = warc.warc_records(io.BytesIO(made))
            assert (head["warc-type"], head["warc-date"], back) == (kind, date, data)
            assert head["warc-record-id"] == warc.record_id("f.arc", offset)
            assert head["warc-ip-address"] == "1.2.3.4"
    assert warc.warc_date("970315123456", "") == "1997-03-15T12:34:56Z" and warc.warc_date("050315123456", "") == "2005-03-15T12:34:56Z"
    made = gzip.decompress(warc.converted("f", 0, {"URL": "ftp://x", "Content-type": "image/gif"}, b"GIF", "2000-01-01T00:00:00Z", None))
    assert b"WARC-Type: resource" in made and b"Content-Type: image/gif" in made


def test_broken_archives_are_refused():
    whole = gzip.decompress(warc.arc_member(1, {"URL": "http://h"}, b"12345"))
    with pytest.raises(ValueError):
        list(warc.arc_records(io.BytesIO(whole[:-4])))
    made = gzip.decompress(warc.warc_member({"WARC-Type": "response", "WARC-Block-Digest": "sha1:AAAA"}, b"x"))
    with pytest.raises(ValueError):
        list(warc.warc_records(io.BytesIO(made)))
    assert warc.key_of(b"HTTP/1.1 200\r\nx-archive-key: 5\r\n") == 5

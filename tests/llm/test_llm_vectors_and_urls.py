"""Vector and URL operators against plain versions, and on odd rows."""

from __future__ import annotations

import brute
import numpy as np
import pytest

from pyspark.sql import functions as F

from keepsake.llm import embedding_dedup, neighbours, url_rules
from keepsake.llm.graph import components
from keepsake.llm.packing import Packer
from keepsake.llm.queries import URL_RULES
from keepsake.llm.shingles import gram_hashes, sliding_min
from keepsake.llm.signature_tree import Groups, unite, width_of
from keepsake.llm.token_files import SHARD_BYTES
from keepsake.llm.vectors import valid

SF = "/root/testdata/sf0.001"
VECTORS = "vec_id long, embedding array<float>, label int, list string, leaf int, n string"


def rows_of(x, labels, first=0):
    return [(first + i, [float(v) for v in row], int(k), "l", 0, "n") for i, (row, k) in enumerate(zip(x.astype(np.float32), labels))]


def odd_rows(first):
    nan, inf = float("nan"), float("inf")
    odd = [None, [0.0] * 8, [nan] * 8, [inf] * 8, [None] * 8, [1.0] * 3, []]
    return [(first + i, v, 1, "l", 0, "n") for i, v in enumerate(odd)] + [(first + 50, [1.0] * 8, None, "l", 0, "n")]


def clustered(draw, n, spread):
    centres = draw.normal(size=(12, 8))
    return centres[draw.integers(12, size=n)] + spread * draw.normal(size=(n, 8))


@pytest.fixture(scope="module")
def vectors(spark):
    draw = np.random.default_rng(1)
    x = clustered(draw, 400, 0.25)
    x[100:160] = x[100]
    x[160:180] = 3 * x[100]
    rows = rows_of(x, draw.integers(3, size=400)) + odd_rows(1000)
    return spark.createDataFrame(rows, VECTORS)


def as_rows(df):
    return [(r.vec_id, r.embedding, r.label) for r in df.collect()]


def test_links_equal_brute_force(vectors):
    got = {r.vec_id: (r.n_links, r.component_id) for r in embedding_dedup.dedup(vectors).collect()}
    assert got == brute.embedding_links(as_rows(vectors))
    assert sum(n for n, _ in got.values()) > 1000


def test_links_in_many_lists_and_blocks(vectors, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "LIST_ROWS", 20)
    monkeypatch.setattr(embedding_dedup, "BLOCK", 7)
    test_links_equal_brute_force(vectors)


def test_links_of_no_and_of_repeated_rows(spark, vectors):
    assert embedding_dedup.dedup(vectors.limit(0)).count() == 0
    assert {(r.n_links, r.kept) for r in embedding_dedup.dedup(spark.createDataFrame(odd_rows(5), VECTORS)).collect()} == {(0, True)}
    small = vectors.filter("vec_id < 30")
    once = brute.embedding_links(as_rows(small))
    got = embedding_dedup.dedup(small.unionByName(small)).collect()
    assert len(got) == 60
    assert {r.vec_id: (r.n_links, r.component_id) for r in got} == {i: (2 * n + 1, c) for i, (n, c) in once.items()}


def nearest(vectors, queries, k):
    good = [(r.vec_id, np.array(r.embedding, float)) for r in valid(vectors).collect()]
    ids, x = np.array([i for i, _ in good]), np.stack([v for _, v in good])
    out = {}
    for r in valid(queries).collect():
        score = (x * np.array(r.embedding, float)).sum(1)
        keep = ids != r.vec_id
        order = np.lexsort((ids[keep], -score[keep]))[:k]
        out[r.vec_id] = list(zip(ids[keep][order].tolist(), score[keep][order].tolist()))
    return out


def found(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r["rank"] == len(out[r.query_id])
    return out


def test_neighbours_of_ties_and_odd_rows(spark, vectors):
    queries = vectors.filter("vec_id % 20 = 0")
    got, want = found(neighbours.search(vectors, queries)), nearest(vectors, queries, 20)
    assert got.keys() == want.keys()
    shared = [len({v for v, _ in got[q]} & {v for v, _ in want[q]}) / 20 for q in want]
    assert np.mean(shared) >= 0.95
    for q in want:
        assert len(got[q]) == 20
        scores = dict(want[q])
        assert all(abs(scores[v] - s) < 1e-12 for v, s in got[q] if v in scores)
        assert [x for x in sorted(got[q], key=lambda p: (-p[1], p[0]))] == got[q]


def test_neighbours_of_few_rows_are_all(spark, vectors):
    few = vectors.filter("vec_id < 9")
    got = found(neighbours.search(few, few))
    assert got.keys() == set(range(9)) and all(len(v) == 8 for v in got.values())
    assert [[v for v, _ in got[q]] for q in range(9)] == [[v for v, _ in nearest(few, few, 20)[q]] for q in range(9)]
    assert neighbours.search(vectors.limit(0), few).count() == 0
    assert neighbours.search(few, vectors.limit(0)).count() == 0


def test_neighbours_of_outliers_beside_a_dense_group(spark):
    draw = np.random.default_rng(3)
    x = np.vstack([np.eye(8)[:1].repeat(3000, 0), 3 * draw.normal(size=(60, 8))])
    vectors = spark.createDataFrame(rows_of(x, np.zeros(len(x))), VECTORS)
    repeated = vectors.filter("vec_id = 3000").crossJoin(spark.range(40).select()).unionByName(vectors)
    queries = vectors.filter("vec_id >= 3000 or vec_id % 10 = 0")
    for given in (vectors, repeated):
        got = found(neighbours.search(given, queries))
        assert got.keys() == {r.vec_id for r in queries.collect()}
        assert {len(v) for v in got.values()} == {20} and all(q not in dict(v) for q, v in got.items())


def test_repeated_query_rows_are_one_query(spark, vectors):
    queries = vectors.filter("vec_id % 20 = 0")
    other = queries.limit(1).select("vec_id", F.transform("embedding", lambda v: -v).alias("embedding"))
    got = neighbours.search(vectors, queries.select("vec_id", "embedding").unionByName(queries.select("vec_id", "embedding")).unionByName(other)).collect()
    once = neighbours.search(vectors, queries).collect()
    turned = other.first().vec_id
    assert {r for r in got if r.query_id != turned} == {r for r in once if r.query_id != turned}
    assert len(got) == len(once) + 20 and len({(r.query_id, r.vec_id) for r in once}) == len(once)


def test_neighbours_recall_on_given_vectors(spark):
    vectors = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select("vec_id", "embedding")
    queries = vectors.filter("vec_id % 20 = 0")
    got, want = found(neighbours.search(vectors, queries)), nearest(vectors, queries, 20)
    assert np.mean([len({v for v, _ in got[q]} & {v for v, _ in want[q]}) / 20 for q in want]) >= 0.9


def judged(rules, default, url):
    if url is None or "://" not in url:
        return "", "", None, default
    rest = url.split("://", 1)[1]
    host = next((rest[:i] for i, c in enumerate(rest) if c in "/?#"), rest)
    path = rest[len(host) :].split("?")[0].split("#")[0]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [(len(h + p), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=(0, None, default))
    return host, path, best[1], best[2]


def test_urls_of_all_shapes(spark):
    hosts = ["com", "a.com", "A.Example.COM", "www.example.com", "x.www.example.com", "notexample.com", "example.com.", "net", "b..net", "example.com:80", "com-x.net", "ünet", ""]
    paths = ["", "/", "/en/", "/en", "/EN/x", "/es/1?q=/en/", "/fr/#x", "?x", "#y", "/en/a://b.net/es/", "/en/\nline"]
    urls = [f"http://{h}{p}" for h in hosts for p in paths] + [None, "", "no scheme", "x://", "://a.com/", "http://" + "a." * 3000 + "com/" + "p" * 20000]
    rows = [(i // 2, u, "html", "h", 3) for i, u in enumerate(u for u in urls for _ in range(2))]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string, host string, part int")
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    got = sorted((r.page_id, r.host, r.path, r.rule or "", r.verdict) for r in url_rules.judge(frame, rules).collect())
    assert got == sorted((i, h, p, r or "", v) for i, u, *_ in rows for h, p, r, v in [judged(URL_RULES, "allow", u)])
    assert {r.verdict for r in url_rules.judge(frame, rules.limit(0), "block").collect()} == {"block"}
    assert url_rules.judge(frame.limit(0), rules).count() == 0


def test_nested_rules_with_many_hosts(spark):
    draw = np.random.default_rng(2)
    labels = ["a", "b", "a-b", "c", "ab"]
    name = lambda: ".".join(draw.choice(labels, draw.integers(1, 5)))
    rules = sorted({(name(), str(draw.choice(["/", "/x/", "/x/y/"]))) for _ in range(80)})
    rules = [(h, p, "block" if len(h) % 2 else "allow") for h, p in rules]
    urls = [(i, f"http://{name()}{draw.choice(['/', '/x/', '/x/y/z', ''])}") for i in range(500)]
    frame = spark.createDataFrame(urls, "page_id long, url string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_rules.judge(frame, spark.createDataFrame(rules, "host string, path string, verdict string")).collect()}
    want = {i: judged(rules, "allow", u) for i, u in urls}
    longest = lambda x: (x[0], x[1], len(x[2] or ""))  # noqa: E731  rules of one length may tie
    assert {i: longest(x) for i, x in got.items()} == {i: longest(x) for i, x in want.items()}


def test_components_of_a_long_path(spark):
    links = [(i, i + 1) for i in range(100, 160)] + [(7, 3), (3, 9), (9, 7), (5, 5)]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long"), "test-links").collect()}
    assert got == {**{i: 100 for i in range(100, 161)}, 3: 3, 7: 3, 9: 3}
    assert components(spark.createDataFrame([], "a long, b long"), "test-links").count() == 0


def test_signature_trees_lose_no_link():
    draw = np.random.default_rng(4)
    sets = []
    for n in (1, 5, 30, 40, 200, 260):
        base = draw.integers(1 << 40, size=n)
        sets += [{int(v) for v in np.where(draw.random(n) < 0.08, draw.integers(1 << 40, size=n), base)} for _ in range(20)]
    items = []
    for i, s in enumerate(sets):
        bits = 0
        for v in s:
            bits |= 1 << (v % width_of(len(s)))
        items.append((i, len(s), bits))
    linked = lambda a, b: 180 * len(sets[a] & sets[b]) >= 80 * (len(sets[a]) + len(sets[b]))
    groups = Groups()
    unite(items, groups, linked)
    n = len(sets)
    want = brute.groups(range(n), [(a, b) for a in range(n) for b in range(a) if linked(a, b)])
    assert {i: groups.find(i) for i in range(n)} == want


def test_rolling_hashes_and_minima():
    x = np.random.default_rng(5).integers(0, 9, 300).astype(np.uint64)
    grams = gram_hashes(x, 4)
    same = {}
    for i in range(len(grams)):
        assert same.setdefault(tuple(x[i : i + 4]), grams[i]) == grams[i]
    assert len(set(same.values())) == len(same)
    assert sliding_min(grams, 7).tolist() == [grams[i : i + 7].min() for i in range(len(grams) - 6)]
    assert SHARD_BYTES > 0


def test_packer_over_many_groups_loses_no_id():
    draw = np.random.default_rng(6)
    for tiers in ((2048, 1024, 512, 256, 128), (64, 32)):
        packer, lengths, held = Packer(3, tiers, 1 << 14), [], 0
        for i in range(600):
            n = int(draw.choice([1, 5, tiers[-1], tiers[0], tiers[0] + 1, draw.integers(1, 3 * tiers[0])]))
            lengths.append(n)
            packer.add(i, np.arange(n, dtype=np.uint16))
            if i % 37 == 0:
                packer.pack()
                held = len(packer.rows)
        packer.finish()
        rows = packer.taken().to_pylist()
        assert held < len(rows)
        spans, windows = {}, {}
        for r in rows:
            spans.setdefault(r["doc_id"], []).append((r["start"], r["length"]))
            windows.setdefault((r["sequence_id"], r["window"]), []).append((r["offset"], r["length"]))
        for i, n in enumerate(lengths):
            at = 0
            for start, length in sorted(spans[i]):
                assert start == at
                at += length
            assert at == n
        for (_, window), parts in windows.items():
            at = 0
            for offset, length in sorted(parts):
                assert offset == at
                at += length
            assert at == window
        assert sum(w for _, w in windows) == sum(lengths)

"""Document operators against plain versions, and on odd rows."""

from __future__ import annotations

import re
from collections import defaultdict

import brute
import numpy as np
import pytest
from compare import connect, differences
from pyspark.sql import functions as F

from keepsake.llm import jaccard, language, mixing, packing, queries, substring, token_counts, token_files
from keepsake.llm.store import new_path

SF = "/root/testdata/sf0.001"
PASSAGE = " ".join(f"same{i % 61}" for i in range(120))
ODD = [
    (1, None, "en", "a"), (2, "", None, "a"), (3, "  \n\t ", "en", None), (4, "one two", "en", "b"),
    (5, "a " + PASSAGE + " z", "en", "b"), (6, PASSAGE, "en", "b"), (7, PASSAGE, "fr", None),
    (8, "x  y\n z's <|endoftext|> " * 4000, "en", "c"), (9, "é" * 5000, "fr", "c"), (10, "one two", "en", "b"),
    (11, "ONE Two", "en", "b"), (12, "12 34 !!", "en", "a"), (13, PASSAGE.replace("same7 ", "other7 "), "en", "a"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def odd(spark):
    schema = "doc_id long, text string, lang string, source string, runs string, n string, keys string, score int, part int, bits string"
    return spark.createDataFrame([(*r, "r", "n", "k", 1, 2, "b") for r in ODD], schema)


@pytest.fixture(scope="module")
def none(odd):
    return odd.limit(0)


@pytest.fixture(scope="module")
def twice(odd):
    return odd.unionByName(odd)


def pairs(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


@pytest.mark.parametrize("name", sorted(queries.statements()))
def test_query_equals_sql(spark, name):
    assert differences(queries.all_queries()[name](spark, SF), connect(SF), queries.statements()[name]) == []


def test_every_operator_has_one_query():
    numbers = sorted(int(n[2:].split("_")[0]) for n in queries.all_queries() if n.startswith("op"))
    assert numbers == list(range(1, 14))


@pytest.mark.parametrize("which", ["docs", "odd"])
def test_token_files_read_back(spark, request, which):
    rows = sorted(pairs(request.getfixturevalue(which)))
    folder = new_path(spark, "test-files")
    token_files.write_token_files(request.getfixturevalue(which), folder)
    got = {r.doc_id: r for r in token_files.read_token_files(spark, folder, with_ids=True).collect()}
    start = 0
    for (doc_id, _), ids in zip(rows, brute.token_ids([t for _, t in rows], 2)):
        r = got.pop(doc_id)
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), brute.crc(ids))
        assert np.frombuffer(r.ids, "<u4").tolist() == ids
        start += len(ids)
    assert not got


def test_token_files_of_no_and_of_repeated_rows(spark, none, twice):
    for frame, n in ((none, 0), (twice, 2 * len(ODD))):
        folder = new_path(spark, "test-files")
        token_files.write_token_files(frame, folder)
        rows = token_files.read_token_files(spark, folder).collect()
        assert len(rows) == n
        places = sorted((r.start, r.n_tokens) for r in rows)
        assert all(a + m == b for (a, m), (b, _) in zip(places, places[1:]))


def test_byte_coding_of_all_lengths():
    ranks = np.array([0, 255, 256, 65535, 65536, (1 << 24) - 1, 1 << 24, (1 << 32) - 1, 5], "<u4")
    for n in range(1, len(ranks) + 1):
        control, data = token_files.encode_block(ranks[:n])
        assert len(control) == -(-n // 4)
        assert token_files.decode_block(n, control, data).tolist() == ranks[:n].tolist()
    shard = token_files.encode_shard([3, None, 5], [ranks[:4], ranks[:0], ranks[4:6]])
    table = np.arange(1 << 24, dtype="<u4")
    assert [(d, sum(map(len, p))) for d, p in token_files.decode_shard(shard, table)] == [(3, 4), (None, 0), (5, 2)]


@pytest.mark.parametrize("which", ["docs", "odd"])
def test_packing_covers_every_id_once(request, which):
    frame = request.getfixturevalue(which)
    rows = pairs(frame)
    ids_of = dict(zip([d for d, _ in rows], brute.token_ids([t for _, t in rows], 1)))
    pieces = packing.pack(frame).collect()
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for p in pieces:
        assert p.ids_crc32 == brute.crc(ids_of[p.doc_id][p.start : p.start + p.length]) and p.length > 0
        assert p.doc_tokens == len(ids_of[p.doc_id])
        by_doc[p.doc_id].append((p.start, p.length))
        by_sequence[p.sequence_id].append((p.offset, p.length, p.window, p.step_group))
    for doc_id, ids in ids_of.items():
        at = 0
        for start, length in sorted(by_doc[doc_id]):
            assert start == at
            at += length
        assert at == len(ids)
    steps = defaultdict(int)
    for parts in by_sequence.values():
        at = 0
        for offset, length, *_ in sorted(parts):
            assert offset == at
            at += length
        window, step = parts[0][2:]
        assert at == window and window & (window - 1) == 0 and window <= 2048
        steps[step] += window
    assert max(steps.values()) <= packing.STEP_TOKENS


def test_packing_of_no_and_of_repeated_rows(none, twice):
    assert packing.pack(none).count() == 0
    got = packing.pack(twice).groupBy("doc_id").sum("length").collect()
    once = {r.doc_id: r[1] for r in packing.pack(twice.distinct()).groupBy("doc_id").sum("length").collect()}
    assert {r.doc_id: r[1] for r in got} == {d: 2 * n for d, n in once.items()}


@pytest.mark.parametrize("which", ["docs", "odd"])
def test_substring_equals_brute_force(request, which):
    frame = request.getfixturevalue(which)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring.dedup(frame).collect()}
    assert got == brute.substring(pairs(frame))


def test_substring_of_no_and_of_repeated_rows(spark, none, twice):
    assert substring.dedup(none).count() == 0
    got = substring.dedup(twice).select("doc_id", "n_removed").collect()
    assert len(got) == 2 * len(ODD)
    assert {(r.doc_id, r.n_removed) for r in got} == {(d, v[1]) for d, v in brute.substring([r[:2] for r in ODD]).items()}
    unnamed = spark.createDataFrame([(None, PASSAGE), (1, PASSAGE)], "doc_id long, text string")
    assert [r.n_removed for r in substring.dedup(unnamed).collect()] == [0, 0]


def test_substring_at_the_edge_of_two_references(spark):
    left, right = [f"l{i}" for i in range(80)], [f"r{i}" for i in range(80)]
    texts = [(1, " ".join(left)), (2, " ".join(right)), (3, " ".join(left[40:] + right[:30])), (4, " ".join(left[20:75] + ["new"] + right[3:53]))]
    frame = spark.createDataFrame(texts, "doc_id long, text string")
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring.dedup(frame).collect()}
    assert got == brute.substring(texts)
    assert got[4][1] == 105


@pytest.mark.parametrize("which", ["docs", "odd"])
def test_jaccard_equals_brute_force(request, which):
    frame = request.getfixturevalue(which)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.join(frame).collect()}
    assert got == brute.jaccard(pairs(frame))


def test_jaccard_of_edited_copies(spark):
    draw = np.random.default_rng(3)
    base = [[f"w{draw.integers(400)}" for _ in range(n)] for n in (7, 30, 120, 900)]
    texts = []
    for words in base:
        for _ in range(25):
            copy = list(words)
            for _ in range(draw.integers(0, max(2, len(words) // 20))):
                copy[draw.integers(len(copy))] = f"e{draw.integers(50)}"
            texts.append((len(texts), " ".join(copy)))
    frame = spark.createDataFrame(texts, "doc_id long, text string")
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.join(frame).collect()} == brute.jaccard(texts)


def test_jaccard_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK", 5)
    test_jaccard_of_edited_copies(spark)


def test_jaccard_of_no_and_of_repeated_rows(none, twice):
    assert jaccard.join(none).count() == 0
    got = jaccard.join(twice).collect()
    assert len(got) == 2 * len(ODD)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute.jaccard([r[:2] for r in ODD])


def test_jaccard_with_whole_prefixes_is_the_same(docs):
    assert sorted(jaccard.join(docs, exact=True).collect()) == sorted(jaccard.join(docs).collect())


@pytest.mark.parametrize("often", [lambda grams: grams[:0], lambda grams: grams, lambda grams: grams[::2]], ids=["none", "all", "half"])
def test_jaccard_is_the_same_whichever_shingles_count_as_frequent(docs, monkeypatch, often):
    grams = np.unique(np.concatenate([jaccard.shingles(r.text) for r in docs.select("text").collect()]))
    usual = sorted(map(tuple, jaccard.join(docs).collect()), key=str)
    monkeypatch.setattr(jaccard, "frequent_shingles", lambda _: often(grams))
    assert sorted(map(tuple, jaccard.join(docs).collect()), key=str) == usual


@pytest.mark.parametrize("often", [np.zeros(0, np.uint64), np.arange(0, 200, 3, dtype=np.uint64)], ids=["none", "some"])
def test_linked_sets_meet_by_their_prefixes_in_any_order(often):
    """What the sets do not share, a sixth of all, comes first in the order of hashes."""
    shared = np.arange(1000, 2000, dtype=np.uint64)
    one, other = (np.concatenate([np.arange(first, 200, 2, dtype=np.uint64), shared]) for first in (0, 1))
    assert len(np.intersect1d(jaccard.prefix(one, often), jaccard.prefix(other, often)))


def test_an_id_with_several_texts_is_one_node(spark):
    word = lambda k, n: " ".join(f"{k}{i}" for i in range(n))
    rows = [(5, word("a", 30)), (5, word("b", 30)), (7, word("a", 30) + " x"), (3, "y " + word("b", 30)), (9, word("c", 9)), (2, word("a", 31))]
    for given in (rows, rows[::-1]):
        got = jaccard.join(spark.createDataFrame(given, "doc_id long, text string")).collect()
        assert {(r.doc_id, r.component_id) for r in got} == {(5, 2), (7, 2), (3, 2), (2, 2), (9, 9)} and len(got) == 6


def test_columns_of_any_name_pass_the_mixture(docs):
    given = docs.limit(60)
    for name in ("_first", "_source", "_chars", "_key", "_limit", "_slots", "_offset", "_bucket", "_last", "_inside", "_id", "_digest", "c0", "c2", "weight", "cycle", "slots"):
        given = given.withColumn(name, F.col("lang"))
    mixed = mixing.mix(given)
    assert mixed.columns[: len(given.columns)] == given.columns
    assert mixed.filter("not (_first <=> lang and c0 <=> lang and slots <=> lang)").count() == 0 and mixed.select("doc_id").distinct().count() == 60


@pytest.mark.parametrize("which", ["docs", "odd"])
def test_factors_stand_in_their_references(request, which):
    frame = request.getfixturevalue(which)
    texts = {r.doc_id: brute.words(r.text) for r in frame.select("doc_id", "text").collect()}
    rows = substring.dedup(frame).select("doc_id", "factors", "spans", "n_removed").collect()
    assert any(r.factors for r in rows)
    for r in rows:
        covered = set()
        for f in r.factors:
            assert f.reference < r.doc_id and f.length >= substring.WINDOW
            assert texts[r.doc_id][f.start : f.start + f.length] == texts[f.reference][f.position : f.position + f.length]
            covered |= set(range(f.start, f.start + f.length))
        assert len(covered) == r.n_removed == sum(s.length for s in r.spans)
        for f, g in zip(r.factors, r.factors[1:]):  # greedy: the next one does not continue this one
            step = f.length - substring.WINDOW + 1
            assert (g.reference, g.start, g.position) != (f.reference, f.start + step, f.position + step)


def test_language_on_held_out_texts(spark):
    rows = queries.op5_language(spark, "/root/testdata/sf0.01").collect()
    given = {r.doc_id: r.lang for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    held = [r for r in rows if r.held_out]
    assert len(rows) == len(given) and 0.2 < len(held) / len(rows) < 0.3
    assert sum(r.lang_pred == given[r.doc_id] for r in held) / len(held) > 0.98
    assert all(0 <= r.score <= 1 for r in rows)


def test_language_of_odd_rows(docs, odd, none, twice):
    model = language.fit(docs)
    got = {r.doc_id: r.lang_pred for r in language.identify(odd, model).collect()}
    assert {d for d, x in got.items() if x == "und"} == {1, 2, 3, 12}
    assert language.identify(none, model).count() == 0
    assert language.identify(twice, model).count() == 2 * len(ODD)
    assert {(r.lang_pred, r.score) for r in language.identify(odd, language.fit(none)).collect()} == {("und", 0.0)}
    one = language.identify(odd, language.fit(docs.filter("lang = 'de'"))).collect()
    assert {(r.lang_pred, r.score) for r in one} == {("und", 0.0), ("de", 1.0)}


def test_language_is_learnt_by_a_task_whatever_the_order_of_rows(spark, monkeypatch):
    monkeypatch.setattr(language, "fit_machine", None)  # here only: the workers import their own
    texts = {"en": ("the house and the tree", "this is one of them"), "de": ("das Haus und der Baum", "dies ist eines davon"), "fr": ("la maison et le chat",)}
    rows = [(i // 3, f"{t} {'x' * i}", lang, None, None) for lang, own in texts.items() for t in own for i in range(40)]  # repeated ids
    shape = "doc_id long, text string, lang string, source string, n_chars long"
    model, again = (language.fit(spark.createDataFrame(r, shape).coalesce(1)) for r in (rows, rows[::-1]))
    assert model.langs == ["de", "en", "fr"] and model.pairs == [("germanic", "romance"), ("de", "en")]
    assert (model.weights == again.weights).all() and (model.bias == again.bias).all()
    assert model.predict(["the tree", "der Baum", "le chat", None])[0] == ["en", "de", "fr", "und"]


def test_mixture_deviates_by_less_than_a_block(docs):
    rows = mixing.mix(docs, block_chars=2000).select("source", "doc_id", "mix_slot", "mix_block", "mix_epoch").distinct().collect()
    assert {r.doc_id for r in rows} == {r.doc_id for r in docs.select("doc_id").collect()}
    slots = {(r.mix_slot, r.source) for r in rows}
    assert len({s for s, _ in slots}) == len(slots)
    by_source = defaultdict(dict)
    for r in rows:
        by_source[r.source][r.mix_block] = r.mix_slot
    rates = {s: max((b + 1) / (t + 1) for b, t in blocks.items()) for s, blocks in by_source.items()}
    for source, blocks in by_source.items():
        last = max(blocks)
        if last > 20:
            share = (last + 1) / (blocks[last] + 1)
            assert all(abs((t + 1) * share - (b + 1)) < 1 + share * 2 for b, t in blocks.items()), (source, rates[source])


@pytest.mark.parametrize("sizes", [[4000, 1], [60] + [1] * 150, [3000, 500, 7, 3], [2, 1, 1]])
def test_mixture_keeps_unrounded_shares(spark, monkeypatch, sizes):
    monkeypatch.setattr(mixing, "CYCLE", 100)
    monkeypatch.setattr(mixing, "FOLD", 64)
    block, unit = 100, 20
    rows = [(1000 * s + i % 1000 + 10**7 * (i // 1000), "x" * unit, f"s{s}") for s, n in enumerate(sizes) for i in range(n)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(frame, block_chars=block).groupBy("source").agg(F.count("*").alias("n"), F.count_distinct("doc_id").alias("d")).collect()
    served, power = {r.source: r.n * unit for r in got}, [(n * unit) ** 0.75 for n in sizes]
    assert {r.source: r.d for r in got} == {f"s{s}": n for s, n in enumerate(sizes)}
    for s, p in enumerate(power):
        assert abs(served[f"s{s}"] - p / sum(power) * sum(served.values())) <= 2 * block


def test_mixture_of_odd_rows(spark, odd, none, twice):
    got = mixing.mix(odd).collect()
    assert {r.doc_id for r in got} == {r[0] for r in ODD} and {r.source for r in got} == {"a", "b", "c", None}
    assert mixing.mix(none).count() == 0
    assert mixing.mix(twice).filter("mix_epoch = 0").count() == 2 * len(ODD)
    weights = spark.createDataFrame([("a", 3), ("b", 1)], "_source string, weight long")
    shares = mixing.mix(odd.filter("source in ('a', 'b')"), weights, block_chars=50).groupBy("source").agg({"mix_block": "max"})
    blocks = {r.source: r[1] + 1 for r in shares.collect()}
    assert abs(blocks["a"] - 3 * blocks["b"]) <= 4


def test_token_counts_of_the_vocabularies(spark, monkeypatch, odd, docs):
    import public_tokenizers
    import sentencepiece

    pieces = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    for frame in (odd, docs):
        rows = frame.select("doc_id", "text").collect()
        got = {(r.doc_id, r.version): r.n_tokens for r in token_counts.counts(frame).collect()}
        for r, ids in zip(rows, brute.token_ids([r.text for r in rows], 0)):
            assert got[r.doc_id, "byte-bpe-50k"] == len(ids) - 1
            assert got[r.doc_id, "piece-bpe-32k"] == len(pieces.encode(r.text or ""))
            assert got[r.doc_id, "words-1"] == len(brute.words(r.text))
    monkeypatch.setattr(queries, "table", lambda *_: docs)
    totals = {(r.source, r.lang, r.version): (r.n_docs, r.n_tokens) for r in queries.op9_token_counts(spark, SF).collect()}
    first, want = {}, defaultdict(lambda: [0, 0])
    for r in docs.select("doc_id", "text", "source", "lang").orderBy("doc_id").collect():
        first.setdefault(r.text, r)
    for r in first.values():
        cleaned = re.sub(queries.SIGN_RUNS, "", r.text or "")
        for version, n in (("byte-bpe-50k", len(brute.token_ids([cleaned], 0)[0]) - 1), ("piece-bpe-32k", len(pieces.encode(cleaned))), ("words-1", len(brute.words(cleaned)))):
            want[r.source, r.lang, version][0] += 1
            want[r.source, r.lang, version][1] += n
    assert totals == {k: tuple(v) for k, v in want.items()}


def test_compaction_changes_no_total(spark, odd):
    store = token_counts.Rollup(spark, new_path(spark, "test-rollup"))
    counted = token_counts.counts(odd, token_counts.PATTERNS)
    as_op = lambda df, op: df.withColumn("op", F.lit(op))
    store.compact()
    store.commit("1", as_op(counted, "insert"))
    store.commit("2", as_op(counted.filter("doc_id < 6"), "delete"))
    before, rows = sorted(map(repr, store.totals().collect())), sorted(map(repr, store.ledger().collect()))
    store.compact()
    assert len(store._folders()) == 1 and not store.commit("2", as_op(counted, "insert"))
    assert sorted(map(repr, store.totals().collect())) == before and sorted(map(repr, store.ledger().collect())) == rows
    store.commit("3", as_op(counted.filter("doc_id < 6"), "insert"))
    assert len(store._folders()) == 2
    assert store.ledger().count() == 2 * len(ODD)


def test_rollup_is_additive_and_idempotent(spark, odd, none):
    store = token_counts.Rollup(spark, new_path(spark, "test-rollup"))
    assert store.totals().count() == 0
    counted = token_counts.counts(odd, {"words-1": token_counts.VERSIONS["words-1"]})
    ops = lambda df, op: df.selectExpr(f"'{op}' AS op", "*")
    assert store.commit("1", ops(counted, "insert"))
    assert not store.commit("1", ops(counted, "insert"))
    assert store.commit("2", ops(counted.filter("doc_id = 8").selectExpr("doc_id", "'moved' AS source", "lang", "version", "7L AS n_tokens"), "revise"))
    assert store.commit("3", ops(counted.filter("doc_id in (5, 99)"), "delete"))
    assert store.commit("4", ops(counted.limit(0), "delete"))
    want = defaultdict(lambda: [0, 0])
    for doc_id, text, lang, source in ODD:
        if doc_id != 5:
            n = 7 if doc_id == 8 else len(brute.words(text))
            key = ("moved" if doc_id == 8 else source, lang)
            want[key][0] += 1
            want[key][1] += n
    assert {(r.source, r.lang): [r.n_docs, r.n_tokens] for r in store.totals().collect()} == dict(want)
    assert store.ledger().count() == len(ODD) - 1


def test_rollup_counts_every_row_without_id(spark, odd, tmp_path):
    store = token_counts.Rollup(spark, new_path(spark, "test-rollup"))
    counted = token_counts.counts(odd.withColumn("doc_id", F.when(F.col("doc_id") % 3 != 0, F.col("doc_id"))))
    assert store.commit("1", counted.withColumn("op", F.lit("insert")))
    for op in ("revise", "delete"):
        assert store.commit(op, counted.filter("doc_id is null").withColumn("op", F.lit(op)))
    want = token_counts.counts(odd).groupBy("source", "lang", "version").agg(F.count("*").alias("n"), F.sum("n_tokens").alias("t"))
    assert sorted(map(repr, store.totals().collect())) == sorted(repr(r).replace(" n=", " n_docs=").replace(" t=", " n_tokens=") for r in want.collect())
    assert store.ledger().agg(F.sum("n_rows")).first()[0] == len(token_counts.VERSIONS) * len(ODD)


def test_token_counts_query_without_some_ids(spark, tmp_path):
    texts = [(1, "a b", "x"), (None, "a b", "x"), (None, "c d!! e", "x"), (None, "c d!! e", "x"), (None, "lone one", "y"), (None, "two of $$ us", None), (2, "f", "y"), (3, "f", "y"), (None, None, "y")]
    frame = spark.createDataFrame([(i, t, "en", s) for i, t, s in texts], "doc_id long, text string, lang string, source string")
    frame.coalesce(1).write.parquet(f"{tmp_path}/given")
    next((tmp_path / "given").glob("*.parquet")).replace(tmp_path / "documents.parquet")
    name = "rollup_by_rule"
    assert differences(queries.all_queries()[name](spark, str(tmp_path)), connect(str(tmp_path)), queries.statements()[name]) == []

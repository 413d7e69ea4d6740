"""Operators on single texts and lines, against plain Python and the tokenizers library."""

import brute
import public_tokenizers
import pytest
from conftest import ordered, texts  # noqa: F401
from pyspark.sql import functions as F

from quarryline.llm import bpe, decontaminate, line_dedup, quality, registry, token_counts

WORD, BYTE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")


def pairs(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def order(rows):
    return sorted(rows, key=lambda r: tuple((x is not None, x) for x in r))


@pytest.mark.parametrize("name", ["docs", "odd_docs", "no_docs"])
def test_token_counts(name, request):
    df = request.getfixturevalue(name)
    assert ordered(token_counts.count_tokens(df, BYTE)) == order(brute.op6(pairs(df), BYTE))


@pytest.mark.parametrize("name", ["docs", "odd_docs", "no_docs"])
def test_bpe_round_trip(name, request):
    df = request.getfixturevalue(name)
    assert ordered(bpe.round_trip(df, WORD)) == order(brute.op2(pairs(df), WORD))


def test_encode_then_decode(docs):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(WORD)
    encoded = bpe.encode(docs, WORD)
    want = {d: t.encode(x or "", add_special_tokens=False).ids for d, x in texts()}
    assert {r.doc_id: r.ids for r in encoded.collect()} == want
    assert {r.doc_id: r.decoded for r in bpe.decode(encoded, WORD).collect()} == {d: t.decode(i, skip_special_tokens=False) for d, i in want.items()}


def test_merging_matches_the_library_on_random_pieces():
    import random

    from tokenizers import Tokenizer

    t, counter, codec, rnd = Tokenizer.from_file(BYTE), token_counts.piece_counter(BYTE), bpe.codec(WORD), random.Random(5)
    w = Tokenizer.from_file(WORD)
    for _ in range(1500):
        text = "".join(rnd.choice("aabctheing ' \n\t12ΣéÉ\x1cß!") for _ in range(rnd.randrange(60)))
        assert counter.count(text) == len(t.encode(text, add_special_tokens=False).ids)
        assert codec.encode(text).tolist() == w.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("name", ["docs", "odd_docs", "no_docs"])
def test_contamination(name, request, benchmark):
    df = request.getfixturevalue(name)
    found = decontaminate.find_contamination(df, benchmark)
    got = [(r.doc_id, r.n_words, len(r.hits), len(r["items"]), brute.sha(",".join(sorted(map(str, r["items"])))), len(r.hits) > 0) for r in found.collect()]
    assert order(got) == order(brute.op1(pairs(df), [(r.item_id, r.text) for r in benchmark.collect()]))


def test_contamination_in_several_blocks(docs, odd_docs, benchmark, monkeypatch):
    whole = [ordered(decontaminate.find_contamination(d, benchmark)) for d in (docs, odd_docs)]
    monkeypatch.setattr(decontaminate, "BLOCK_WINDOWS", 4)
    assert len(decontaminate.blocks_of(decontaminate.windows_of(benchmark, 10))) > 1
    assert [ordered(decontaminate.find_contamination(d, benchmark)) for d in (docs, odd_docs)] == whole


def test_decontaminate(docs, benchmark):
    bad = {r[0] for r in brute.op1(pairs(docs), [(r.item_id, r.text) for r in benchmark.collect()]) if r[5]}
    kept = decontaminate.decontaminate(docs, benchmark)
    assert kept.columns == docs.columns and bad
    assert {r.doc_id for r in kept.collect()} == {d for d, _ in texts()} - bad
    cut = {r.doc_id: r.text for r in decontaminate.decontaminate(docs, benchmark, mode="spans").collect()}
    assert len(cut) == len(texts()) and cut[1] is None and cut[4] == texts()[3][1]
    assert cut[20] == "the  the big bad wolf today"


@pytest.mark.parametrize("mode", ["documents", "spans"])
def test_decontaminate_in_several_blocks(docs, odd_docs, no_docs, benchmark, monkeypatch, mode):
    """The same rows and texts however many blocks there are: a cut never makes a new window."""
    joined = docs.sparkSession.createDataFrame([(1, "one two quick brown fox three four five six"), (2, "quick brown quick brown fox fox jumps")], "doc_id long, text string")
    more = benchmark.unionByName(docs.sparkSession.createDataFrame([(30, "two three four", "x"), (31, "brown fox fox", "x"), (32, "quick brown", "x")], benchmark.schema))
    tables = (docs, odd_docs, no_docs, joined)
    run = lambda: [ordered(decontaminate.decontaminate(d, more, mode=mode).select("doc_id", "text")) for d in tables]
    whole = run()
    monkeypatch.setattr(decontaminate, "BLOCK_WINDOWS", 4)
    assert len(decontaminate.blocks_of(decontaminate.windows_of(more, 10))) > 2
    assert run() == whole
    assert decontaminate.decontaminate(docs, more, mode=mode).columns == docs.columns


def test_a_window_that_many_items_hold(spark, docs, monkeypatch):
    monkeypatch.setattr(decontaminate, "ROW_ITEMS", 5)
    items = spark.createDataFrame([(i, "Quick, Brown: fox!", "x") for i in range(100)] + [(7, "dog and runs", "x")], "item_id long, text string, words string")
    assert decontaminate.windows_of(items, 10).count() > 2
    found = {r.doc_id: r["items"] for r in decontaminate.find_contamination(docs, items).collect()}
    assert found[20] == list(range(100)) and found[5] == []


@pytest.mark.parametrize("name", ["docs", "odd_docs", "no_docs"])
def test_line_report(name, request):
    df = request.getfixturevalue(name)
    assert ordered(line_dedup.line_report(df)) == order(brute.op4(pairs(df)))


def test_drop_repeated_lines_keeps_rows_and_columns(docs):
    kept = line_dedup.drop_repeated_lines(docs)
    assert kept.columns == docs.columns
    assert {r.doc_id: r.text for r in kept.collect()} == brute.kept_lines(texts())


def test_emptied_documents_may_go(docs, odd_docs):
    left = {r.doc_id: r.text for r in line_dedup.drop_repeated_lines(docs, drop_emptied=True).collect()}
    whole, before = brute.kept_lines(texts()), dict(texts())
    assert left == {d: t for d, t in whole.items() if t == before[d] or t.strip()}
    assert len(left) < len(whole) and left[3] == " \t\n "
    assert sum(r.doc_id is None for r in line_dedup.drop_repeated_lines(odd_docs, drop_emptied=True).collect()) == 3


def test_no_run_tables_are_left(spark, docs):
    line_dedup.line_report(docs).collect()
    with pytest.raises(Exception):  # noqa: B017
        line_dedup.line_report(docs.withColumn("text", F.raise_error(F.lit("stop")))).collect()
    assert not [t.name for t in spark.catalog.listTables() if t.name.startswith("line_run_")]


def test_line_runs_are_compacted(spark, docs):
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("raw"))
    runs = line_dedup.LineRuns(spark, 4)
    for part in line_dedup.batches_by_id(rows, 5):
        runs.add(part)
    assert len(runs.levels) > 1 and len(runs.levels[0]) < line_dedup.FANOUT
    held = [r.h for t in runs.tables() for r in spark.table(t).collect()]
    assert len(held) == len(set(held))


def test_quality(spark, docs, odd_docs, no_docs):
    labels = spark.createDataFrame([(d, int(d % 2), 0) for d in range(1, 21)] + [(None, 1, 0), (4, None, 0)], "doc_id long, quality int, toxic int")
    machine = quality.train(docs, labels)
    for df in (docs, odd_docs, no_docs):
        scored = quality.score(df, machine).collect()
        assert len(scored) == df.count()
        assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in scored)
    found = quality.features(b"Hello hello, World!\nhello")
    direct = machine.margin(*machine.rows([found]))[0]
    idx, val, _ = machine.rows([found])
    slow = machine.bias + machine.weights[idx] @ val + sum(machine.vectors[idx[i]] @ machine.vectors[idx[j]] * val[i] * val[j] for i in range(len(idx)) for j in range(i + 1, len(idx)))
    assert abs(direct - slow) < 1e-9
    assert quality.keep_good(docs, machine).columns == docs.columns


def test_a_labelled_id_that_is_repeated_is_one_example(spark):
    rows = [(d, f"text number {d} of it", len(f"text number {d} of it")) for d in range(1, 12)]
    many = rows + [(3, "text number 3 of it", 19)] * 300 + [(3, "t", 1)]
    labels = spark.createDataFrame([(d, d % 2, 0) for d in range(1, 12)], "doc_id long, quality int, toxic int")
    schema = "doc_id long, text string, n_chars long"
    one, other = (quality.train(spark.createDataFrame(r, schema), labels) for r in (rows, many))
    assert (one.weights == other.weights).all() and one.bias == other.bias
    # stated sizes are a feature: a wrong one moves the score
    assert one.score([rows[0][1].encode()], [rows[0][2]])[0] == one.score([rows[0][1].encode()])[0] != one.score([rows[0][1].encode()], [10_000])[0]


def test_quality_without_labels(spark, docs):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r.score for r in quality.score(docs, quality.train(docs, none)).collect()} == {0.5}


def test_quality_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = [r for r in registry.op5_quality(spark, sf).collect() if r.held_out and r.doc_id in labels]
    good, bad = ([r.score for r in rows if labels[r.doc_id] == k] for k in (1, 0))
    assert sum((a > b) + 0.5 * (a == b) for a in good for b in bad) / (len(good) * len(bad)) > 0.95
    assert sum(s >= 0.3 for s in good) / len(good) > 0.97

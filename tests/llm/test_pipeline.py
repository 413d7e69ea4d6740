"""The pipeline's rows against plain Python, stage by stage."""

import brute
import corpus_pipeline
import public_tokenizers

from quarryline.llm import quality

SF = "/root/testdata/sf0.001"


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    machine = quality.train(docs, labels)
    good = [r for r in rows if machine.score([(r[1] or "").encode()])[0] >= 0.3]
    before = dict(good)
    kept = [(d, t) for d, t in brute.kept_lines(good).items() if t == before[d] or t.strip(" \t\n\x0b\x0c\r")]
    assert len(kept) < len(good)
    one = {r[0] for r in brute.op7(kept) if r[3]}
    kept = [r for r in kept if r[0] in one]
    clean = {r[0] for r in brute.op1(kept, items) if not r[5]}
    want = brute.op2([r for r in kept if r[0] in clean], public_tokenizers.path("word_bpe_49k.json"))
    got = corpus_pipeline.run(spark, SF)
    assert sorted(map(tuple, got.collect())) == sorted(want)
    assert 0 < len(want) < len(rows)
    assert all(r.n_tokens for r in got.collect())


def test_stages_keep_the_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:2]:
        docs = stage(spark, docs, SF)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]


def staged(spark, rows, schema="doc_id long, text string, lang string, source string, n_chars long, _doc string, id string, tokens int"):
    """The doc_ids and texts that each stage but the last keeps, and the rows of the last."""
    docs, out = spark.createDataFrame(rows, schema), []
    for name, stage in corpus_pipeline.STAGES[1:]:
        docs = stage(spark, docs, SF)
        if name != "bpe":
            assert docs.columns == [c.split(" ")[0] for c in schema.split(", ")]
            out.append([(r.doc_id, r.text) for r in docs.collect()])
    return out, [tuple(r) for r in docs.collect()]


def test_stages_on_nulls_repeats_and_clashing_columns(spark):
    near = [f"near{i}word" for i in range(80)]
    line = "a shared line of some length"
    texts = [
        (1, line), (2, f"{line}\n{line}"), (3, f"own words\n{line}"), (4, None), (5, ""), (6, " \t"),
        (10, " ".join(near)), (11, " ".join([*near[:40], "changed", *near[41:]])), (12, " ".join(near)), (12, " ".join(near)),
        (None, line), (None, " ".join(near)), (None, None), (20, " ".join(f"w{i % 977}x{i}" for i in range(20_000))),
    ]
    rows = [(d, t, None, None, None, "d", "i", 1) for d, t in texts]
    (lines, near_left, clean), last = staged(spark, rows)
    key = lambda r: (r[0] is None, r[0] or 0, r[1] or "")
    # 2 is emptied and goes, 3 loses its line; blank texts and null ids stay as they are
    assert sorted(lines, key=key) == sorted([(d, "own words" if d == 3 else t) for d, t in texts if d not in (2, 12)], key=key)
    assert sorted(near_left, key=key) == sorted([r for r in lines if r[0] != 11], key=key)
    assert sorted(clean, key=key) == sorted(near_left, key=key) and len(last) == len(clean)
    scored = corpus_pipeline.good_documents(spark, spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, _doc string, id string, tokens int"), SF)
    assert scored.count() <= len(rows)


def test_stages_on_empty_tables_and_without_n_chars(spark):
    parts, last = staged(spark, [])
    assert parts == [[], [], []] and last == []
    (lines, *_), last = staged(spark, [(1, "a line of text that is here", None, None), (2, "a line of text that is here\nmore of it", None, None)], "doc_id long, text string, lang string, source string")
    assert sorted(lines) == [(1, "a line of text that is here"), (2, "more of it")] and len(last) == 2
    empty = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    assert corpus_pipeline.good_documents(spark, empty, SF).count() == 0


def test_every_operator_is_registered():
    import __spark_entry__

    names = __spark_entry__.queries()
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11))

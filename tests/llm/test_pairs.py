"""Operators that compare documents, vectors, URLs and values, against plain Python."""

import os

import brute
import numpy as np
import pyarrow as pa
import pytest
from conftest import PASSAGE, ordered, texts
from pyspark.sql import functions as F

from quarryline.llm import common, embedding_near_dedup, minhash_near_dedup, secret_scan, substring_dedup, url_filter


def test_near_duplicates(docs, no_docs):
    assert ordered(minhash_near_dedup.near_duplicates(docs)) == sorted(brute.op7(texts()))
    assert minhash_near_dedup.near_duplicates(no_docs).count() == 0
    kept = minhash_near_dedup.keep_one_of_each(docs)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {r[0] for r in brute.op7(texts()) if r[3]}


def test_near_duplicates_with_repeated_rows_and_null_ids(odd_docs):
    rows = minhash_near_dedup.near_duplicates(odd_docs).collect()
    want = {r[0]: r for r in brute.op7(texts()[6:14])}
    assert len(rows) == odd_docs.count()
    for r in rows:
        assert tuple(r) == want[r.doc_id] if r.doc_id is not None else r.component_id is None and r.kept


def test_a_large_group_of_near_copies(spark, monkeypatch):
    """Texts between which some links lie below the threshold: blocks and chunks are cut small."""
    import random

    monkeypatch.setattr(minhash_near_dedup, "BLOCK", 16)
    monkeypatch.setattr(minhash_near_dedup, "CHUNK", 8)
    rnd = random.Random(3)
    base = [f"b{i}" for i in range(120)]
    rows = []
    for d in range(150):
        words = list(base)
        for _ in range(rnd.randrange(6)):
            words[rnd.randrange(120)] = f"e{rnd.randrange(1000)}"
        rows.append((d, " ".join(words)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert ordered(minhash_near_dedup.near_duplicates(df)) == sorted(brute.op7(rows))


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 60)] + [(100, 101), (101, 102), (100, 102), (7, 7), (200, 201)]
    df = spark.createDataFrame(edges, "a long, b long")
    want = brute.components({x for e in edges for x in e}, edges)
    got = {r.node: r.component for r in common.connected_components(df).collect()}
    assert got == want
    assert common.connected_components(df.where("a < 0")).count() == 0


def vectors():
    import random

    rnd = random.Random(9)
    rows = []
    for i in range(120):
        v = [rnd.gauss(0, 1) for _ in range(16)]
        rows.append((i, v, i % 3))
        if i % 4 == 0:
            rows.append((1000 + i, [x + rnd.gauss(0, 0.12) for x in v], i % 3))
            rows.append((2000 + i, list(v), i % 3))
            rows.append((3000 + i, [2 * x for x in v], (i + 1) % 3))
    return rows + [(5000, None, 1), (5001, [0.0] * 16, 1), (5002, [1.0, None], 1), (5003, [float("nan")] * 16, 1), (5004, [1.0] * 16, None), (5005, [], 1), (5006, [1.0, 2.0], 1), (5007, [1.0, 2.0], 1), (5008, [float("inf"), 2.0], 1)]


@pytest.mark.parametrize("block", [1000, 10])
def test_near_vectors(spark, monkeypatch, block):
    monkeypatch.setattr(embedding_near_dedup, "BLOCK", block)
    rows = [(*r, "x", 1) for r in vectors()]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, fp string, cell int")
    assert ordered(embedding_near_dedup.near_vectors(df)) == sorted(brute.op10(vectors()))
    assert embedding_near_dedup.near_vectors(df.limit(0)).count() == 0
    twice = embedding_near_dedup.near_vectors(df.where("vec_id < 2").union(df.where("vec_id < 2")).withColumn("vec_id", F.when(F.col("vec_id") == 0, F.col("vec_id")))).collect()
    assert len(twice) == 4 and sorted(r.n_links for r in twice) == [0, 0, 1, 1]


@pytest.mark.parametrize("block", [1000, 40])
def test_near_vectors_by_tables_of_cells(spark, monkeypatch, block):
    """A label that is cut into cells: each link once, none below the threshold, 99 % of them found."""
    import random

    import numpy as np

    rnd = random.Random(10)
    monkeypatch.setattr(embedding_near_dedup, "BLOCK", block)
    monkeypatch.setattr(embedding_near_dedup, "plan", lambda n, least: (5, 12))
    rows = []
    for i in range(150):
        v = [rnd.gauss(0, 1) for _ in range(24)]
        rows += [(100 * i + k, [x + rnd.gauss(0, 0.15) for x in v], 1) for k in range(4)]
    rows.append((99_999, rows[0][1], 1))
    x = np.array([r[1] for r in rows])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    cosine = x @ x.T
    degree = {r[0]: int((cosine[k] >= 0.93).sum()) - 1 for k, r in enumerate(rows)}
    got = {r.vec_id: r for r in embedding_near_dedup.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    assert all(got[d].n_links <= n for d, n in degree.items()) and sum(degree.values()) > 1000
    assert sum(r.n_links for r in got.values()) >= 0.99 * sum(degree.values())
    assert all(got[d].component_id // 100 == d // 100 or d == 99_999 for d in got)


def test_plans_of_labels():
    assert embedding_near_dedup.plan(5000, 0.93) == (0, 1)
    depth, tables = embedding_near_dedup.plan(1_000_000, 0.93)
    p = embedding_near_dedup.same_cell(embedding_near_dedup.CELL) ** depth
    assert depth > 8 and (1 - p) ** tables <= embedding_near_dedup.LOST
    # a hundred times the vectors are far less than a hundred times the copies
    assert embedding_near_dedup.plan(100_000_000, 0.93)[1] < 4 * tables


def test_a_stray_in_a_large_bucket(spark, monkeypatch):
    """A bucket's largest component is dealt out about once, and still meets the strays."""
    monkeypatch.setattr(minhash_near_dedup, "BLOCK", 16)
    base = [f"b{i}" for i in range(200)]
    rows = [(d, " ".join([*base[: d % 190], f"e{d}", *base[d % 190 + 1 :]])) for d in range(10, 130)]
    rows += [(1, " ".join([*base[:120], *(f"x{i}" for i in range(80))])), (500, " ".join([*base[:162], *(f"y{i}" for i in range(38))]))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert ordered(minhash_near_dedup.near_duplicates(df)) == sorted(brute.op7(rows))


def test_a_long_text_of_secrets(spark):
    """Places are summed up in runs: as many matches as there are words."""
    text = " ".join(f"é {i:024x}" for i in range(3000)) + " token=abcdef12"
    rows = [(1, text), (2, "x")]
    got = sorted(tuple(r[:5]) for r in secret_scan.scan_secrets(spark.createDataFrame([(*r, "s") for r in rows], "doc_id long, text string, source string")).collect())
    assert got == sorted(brute.op9_base(rows)) and got[0][3] == 3000


def test_secrets(docs, odd_docs, no_docs):
    for df in (docs, odd_docs, no_docs):
        pairs = [(r.doc_id, r.text) for r in df.collect()]
        key = lambda r: (r[0] is not None, r[0] or 0, r[1:])
        got = secret_scan.scan_secrets(df).collect()
        assert sorted((tuple(r[:5]) for r in got), key=key) == sorted(brute.op9_base(pairs), key=key)
    rows = {r.doc_id: r for r in secret_scan.scan_secrets(docs).collect()}
    assert rows[17].n_owned == 1 and rows[17].spans.endswith("owned:48:74")


def test_copied_values_are_examples(spark):
    secret = "x Ab12Cd34Ef56Gh78Ij90Kl y"
    df = spark.createDataFrame([(i, secret, f"s{i % 4}") for i in range(40)] + [(99, "mine Zz12Cd34Ef56Gh78Ij90Kl", "s1"), (98, "mine Zz12Cd34Ef56Gh78Ij90Kl", "s1")], "doc_id long, text string, source string")
    rows = {r.doc_id: r for r in secret_scan.scan_secrets(df).collect()}
    assert rows[3].n_owned == 0 and rows[3].n_example == 1
    assert rows[99].n_owned == 1 and rows[99].spans == "owned:5:27"


def test_a_value_in_many_repositories_of_one_owner_is_not_live(spark):
    rows = [(i, "x Ab12Cd34Ef56Gh78Ij90Kl y", "hot") for i in range(40)] + [(50 + i, "mine Zz12Cd34Ef56Gh78Ij90Kl", "hot") for i in range(2)]
    got = {r.doc_id: r for r in secret_scan.scan_secrets(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert got[3].n_owned == 0 and got[3].spans == ""
    assert got[50].n_owned == 1 and got[50].spans == "owned:5:27"


def urls():
    rows = [None, "", "no scheme", "http://", "HTTP://WWW.Example.COM", "https://www.example.com/en/1?x=1#y", "http://a.example.com/en/2", "http://example.com/fr/3.html", "http://b.net/es/4", "http://notnet/es/4", "ftp://é.net/fr/?q", "http://x.org/en/5", "http://x.org?a/b", "http://deal.shop.net/de/9"]
    rows += [f"http://h{i}.example.com/en/{i}" for i in range(30)] + [f"http://h{i}.example.net/fr/{i}" for i in range(30)] + [f"http://good{i % 3}.com/de/{i}" for i in range(40)] + [f"http://h{i}.example.org/{p}/{i}" for i in range(5) for p in ("en", "fr", "de")]
    return list(enumerate(rows))


def mined(labelled, min_support, min_confidence):
    """Association rules by counting every subset."""
    from itertools import combinations

    n, sets, with_label = len(labelled), {}, {}
    for tokens, label in labelled:
        for size in range(1, len(tokens) + 1):
            for s in combinations(tokens, size):
                sets[s] = sets.get(s, 0) + 1
                with_label[s, label] = with_label.get((s, label), 0) + 1
    least = -(-min_support * n // 1)
    rules = {(s, label): (k / sets[s]) for (s, label), k in with_label.items() if k >= least and k / sets[s] >= min_confidence}
    return {
        (s, label): c for (s, label), c in rules.items() if not any(rules.get((tuple(x for x in s if x != t), label), -1) >= c for t in s if len(s) > 1)
    }


def test_urls(spark):
    rows = urls()
    pages = spark.createDataFrame([(i, u, "x", 1) for i, u in rows] + [(None, rows[5][1], "x", 1), (5, rows[5][1], "x", 1)], "page_id long, url string, host string, tokens int")
    got = {r.page_id: r for r in url_filter.judge_urls(pages, min_support=0.05, min_count=2).collect()}
    assert url_filter.judge_urls(pages).count() == len(rows) + 2
    host, path = url_filter.host_and_path(F.col("url"))
    tokens = {r.page_id: tuple(r.t) for r in pages.withColumns({"h": host, "p": path}).select("page_id", url_filter.url_tokens(F.col("url"), F.col("h"), F.col("p")).alias("t")).collect()}
    judged = {i: brute.op8_rule(u, url_filter.RULES) for i, u in rows}
    rules = mined([(tokens[i], judged[i][1]) for i, _ in rows if judged[i][0] and tokens[i]], 0.05, url_filter.MIN_CONFIDENCE)
    assert rules
    for i, u in rows:
        rule, verdict = judged[i]
        if rule is None:
            fits = sorted((-c, -len(s), list(s), label) for (s, label), c in rules.items() if set(s) <= set(tokens[i]))
            verdict = fits[0][3] if fits else "allow"
        assert tuple(got[i]) == (i, *brute.host_path(u), rule, verdict), u
    assert url_filter.judge_urls(pages.limit(0)).count() == 0


def test_a_long_url_that_is_repeated(spark):
    """As many token sets as subsets of 40 words, under one label and under two."""
    words = "/".join(f"word{i}" for i in range(40))
    rows = [f"http://a.example.com/en/{words}"] * 20 + [f"http://www.example.com/en/{words}/more"] * 20 + [f"http://x.org/{words}"] * 3 + ["http://x.org/more", "http://x.org/word7"]
    got = {r.page_id: r for r in url_filter.judge_urls(spark.createDataFrame(list(enumerate(rows)), "page_id long, url string")).collect()}
    assert got[0].verdict == "block" and got[20].verdict == "allow" and len(got) == len(rows)
    # the words go with either label alike; what only one of them has decides
    assert got[40].verdict == "allow" and got[43].verdict == "allow"


def test_compact_windows_are_those_of_all_subsequences():
    import random

    import numpy as np

    rnd = random.Random(1)
    for most in (12, 10**6):
        parts = [[rnd.randrange(1, most) for _ in range(n)] for n in (60, 3, 7, 0, 33)]
        h = np.array([x for p in parts for x in (0, *p)] + [0], np.uint64)
        found = substring_dedup.compact_windows(h, 7).tolist()
        for i in range(len(h)):
            for j in range(i + 6, len(h)):
                least = h[i : j + 1].min()
                nodes = [c for low, c, high in found if low <= i and j <= high and h[c] == least]
                assert len(nodes) == (0 if least == 0 else 1)
                assert most == 12 or not nodes or i <= nodes[0] <= j


def in_classes(df, **options):
    """doc_id -> row of the documents that hold a repeated passage; every row has to be there."""
    rows = substring_dedup.passage_classes(df, **options).collect()
    assert len(rows) == df.count()
    alone = [r for r in rows if r.n_partners == 0]
    assert all((r.class_id, r.n_repeated, r.passages) == (r.doc_id, 0, "") for r in alone)
    return {r.doc_id: r for r in rows if r.n_partners}


def test_repeated_minima_give_a_row_for_each_run():
    import random

    import numpy as np

    rnd = random.Random(2)
    for most, least in ((2, 3), (3, 7), (5, 10), (12, 7), (10**6, 7)):
        parts = [[rnd.randrange(1, most) for _ in range(n)] for n in (60, 3, 7, 0, 33, 120)]
        h = np.array([x for p in parts for x in (0, *p)] + [0], np.uint64)
        found = substring_dedup.compact_windows(h, least, repeats=True).tolist()
        for i in range(len(h) - least + 1):
            low = h[i : i + least].min()
            if low:
                assert any(a <= i <= c < i + least <= b + 1 and h[c] == low for a, c, b in found)
        assert len(found) <= 3 * len(h) / least * 2


def test_passages(docs, odd_docs, no_docs):
    rows = in_classes(docs)
    assert set(rows) == {7, 8, 9, 10, 11, 12}
    assert rows[11].class_id == rows[12].class_id == 11 and rows[11].passages == "2:62" and rows[12].passages == "3:63"
    assert rows[7].class_id == 7 and rows[10].n_repeated == 80 and len(PASSAGE.split()) == 60
    assert substring_dedup.passage_classes(no_docs).count() == 0
    assert set(in_classes(odd_docs)) == {7, 8, 9, 10, 11, 12}


def unlike(rnd, name, n):
    return [f"{name}{rnd.randrange(10**9)}" for _ in range(n)]


def test_links_that_a_smaller_partial_quote_hides(spark):
    """Two documents with a common passage of 52 words, beside a smaller one that quotes 48 of it:
    all columns against all runs of 50 words."""
    import random
    from collections import defaultdict

    rnd, rows = random.Random(5), []
    for g in range(50):
        passage = unlike(rnd, f"p{g}x", 52)
        at = rnd.randrange(5)
        rows.append((g, [*unlike(rnd, "a", 40), *passage[at : at + 48], *unlike(rnd, "b", 40)]))
        rows += [(1000 + 2 * g + k, [*unlike(rnd, "c", rnd.randrange(70)), *passage, *unlike(rnd, "d", rnd.randrange(70))]) for k in (0, 1)]
    holders, covered = defaultdict(set), defaultdict(set)
    for d, words in rows:
        for i in range(len(words) - 49):
            holders[tuple(words[i : i + 50])].add(d)
    for d, words in rows:
        covered[d] = {k for i in range(len(words) - 49) if len(holders[tuple(words[i : i + 50])]) > 1 for k in range(i, i + 50)}
    got = in_classes(spark.createDataFrame([(d, " ".join(w)) for d, w in rows], "doc_id long, text string"))
    assert set(got) == {d for d in covered if covered[d]} and len(got) == 100
    for d, r in got.items():
        assert r.class_id == d - d % 2 and r.n_partners == 1 and r.n_repeated == len(covered[d])
        assert r.passages == f"{min(covered[d])}:{max(covered[d]) + 1}"


def test_recall_of_similar_passages(spark):
    """Passages of 60 to 120 words with one changed word in about 55, each next to common phrases."""
    import random

    rnd, rows = random.Random(6), []
    phrases = [unlike(rnd, "q", 8) for _ in range(20)]
    for g in range(150):
        passage = unlike(rnd, f"p{g}x", rnd.randrange(60, 120))
        passage[10:18] = rnd.choice(phrases)
        other = list(passage)
        for k in range(len(passage) // 55):
            other[rnd.randrange(len(other))] = f"z{k}{rnd.randrange(10**9)}"
        rows += [(1000 + 2 * g + k, [*unlike(rnd, "c", 50), *p, *unlike(rnd, "d", 50)]) for k, p in enumerate((passage, other))]
    rows += [(k, [*unlike(rnd, "e", 60), *p, *unlike(rnd, "f", 60)]) for k, p in enumerate(phrases)]
    sets = {d: {tuple(w[50 + i : 55 + i]) for i in range(len(w) - 104)} for d, w in rows}
    pairs = [d for d in range(1000, 1300, 2) if 100 * len(sets[d] & sets[d + 1]) >= 75 * len(sets[d] | sets[d + 1])]
    got = in_classes(spark.createDataFrame([(d, " ".join(w)) for d, w in rows], "doc_id long, text string"))
    assert len(pairs) > 100 and all(got[d].class_id == d - d % 2 for d in got)
    assert sum(d in got and d + 1 in got for d in pairs) >= 0.9 * len(pairs)


def test_a_passage_is_found_behind_partial_copies_of_it():
    """Against all 50-word runs, on texts that hold parts of a passage before the whole one."""
    import random

    import numpy as np

    rnd = random.Random(4)
    fresh = lambda n: [rnd.randrange(1, 2**62) for _ in range(n)]
    covered = lambda spans: {x for i, j in spans for x in range(i, j + 1)}
    for length, cut in ((46, 1), (46, 20), (56, 26), (56, 40), (90, 46)):
        passage = fresh(length)
        a = np.array([*fresh(30), *passage, *fresh(30)], np.uint64)
        b = np.array([*fresh(10), *passage[:cut], *fresh(400), *passage[-cut:], *fresh(50), *passage, *fresh(20)], np.uint64)
        own, its = substring_dedup.exact_passages(substring_dedup.run_hashes(a, 46), substring_dedup.run_hashes(b, 46), 46)
        places = {tuple(b[i : i + 46].tolist()) for i in range(len(b) - 45)}
        want = {x for i in range(len(a) - 45) if tuple(a[i : i + 46].tolist()) in places for x in range(i, i + 46)}
        assert want and covered(own) == want
        assert set(range(len(b) - 20 - length, len(b) - 20)) <= covered(its)
        assert want <= covered((i, j) for i, j, _, _ in substring_dedup.common_passages(a, b, 46, 75))
    # one changed word in the middle, and its first half also earlier
    passage = fresh(60)
    a = np.array([*fresh(30), *passage[:28], *fresh(5), *passage[33:], *fresh(30)], np.uint64)
    b = np.array([*fresh(10), *passage[:28], *fresh(400), *passage, *fresh(20)], np.uint64)
    assert (30, 89, 438, 497) in substring_dedup.common_passages(a, b, 46, 75)


def test_a_passage_behind_a_partial_copy_has_rows(spark):
    words = lambda name, n: " ".join(f"{name}{i}" for i in range(n))
    rows = [(1, f"{words('a', 10)} {' '.join(PASSAGE.split()[:30])} {words('b', 460)} {PASSAGE} {words('c', 20)}"), (2, f"{words('d', 20)} {PASSAGE} {words('e', 20)}")]
    got = {d: r.passages for d, r in in_classes(spark.createDataFrame(rows, "doc_id long, text string")).items()}
    assert got == {1: "500:560", 2: "20:80"}


def test_a_passage_whose_min_hashes_have_smaller_holders_elsewhere(spark):
    """Each shingle of the passage stands in smaller documents of its own, in other contexts."""
    words, rows = PASSAGE.split(), []
    for i in range(56 * 12):
        rows.append((i, " ".join([*(f"l{i}x{k}" for k in range(48)), *words[i // 12 : i // 12 + 5], *(f"r{i}x{k}" for k in range(48))])))
    for d in (1000, 1001, 1002):
        rows.append((d, " ".join([*(f"l{d}x{k}" for k in range(60)), *words, *(f"r{d}x{k}" for k in range(60))])))
    got = in_classes(spark.createDataFrame(rows, "doc_id long, text string"))
    assert set(got) == {1000, 1001, 1002}
    assert {(r.class_id, r.passages, r.n_repeated) for r in got.values()} == {(1000, "60:120", 60)}


def test_similar_passages_whose_min_hashes_have_smaller_holders_elsewhere(spark):
    """As above, but of the passage's two holders one has changed a word, so that no 50 words are equal."""
    words, rows = [f"sim{i}ilar" for i in range(70)], []
    for i in range(66 * 6):
        rows.append((i, " ".join([*(f"l{i}x{k}" for k in range(48)), *words[i // 6 : i // 6 + 5], *(f"r{i}x{k}" for k in range(48))])))
    for d, own in ((1000, words), (1001, [*words[:35], "changed", *words[36:]])):
        rows.append((d, " ".join([*(f"l{d}x{k}" for k in range(60)), *own, *(f"r{d}x{k}" for k in range(60))])))
    got = in_classes(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {d: (r.class_id, r.n_partners, r.passages) for d, r in got.items()} == {1000: (1000, 1, "60:130"), 1001: (1000, 1, "60:130")}


@pytest.mark.parametrize("one_by_one", [12, 0])
def test_passages_are_those_of_all_ranges(monkeypatch, one_by_one):
    """Against all pairs of ranges that begin alike and end alike: changed, inserted and moved parts,
    repeated shingles, passages next to parts that are less alike."""
    import numpy as np

    def brute(a, b, least, percent):
        for i, x in zip(*np.nonzero(a[:, None] == b)):
            for j, y in zip(*np.nonzero(a[i + least - 1 :, None] == b[x + least - 1 :])):
                left, right = a[i : i + least + j], b[x : x + least + y]
                if substring_dedup.alike(left, right, percent):
                    yield i, i + least - 1 + j, x, x + least - 1 + y

    monkeypatch.setattr(substring_dedup, "ONE_BY_ONE", one_by_one)
    rng, met = np.random.default_rng(3), 0
    for n in range(120):
        base = rng.integers(0, 1000 if n % 3 else 6, 30)
        a, b = base.copy(), base.copy()
        for z in (a, b):
            z[rng.integers(0, 30, rng.integers(0, 6))] = rng.integers(1000, 2000)
        if n % 3 == 2:
            k, m = rng.integers(1, 29, 2)
            b = np.concatenate([b[k:], b[:k]])
            b = np.concatenate([b[:m], rng.integers(3000, 4000, rng.integers(0, 6)), b[m:]])
        a, b = a.astype(np.uint64), b.astype(np.uint64)
        got, want = substring_dedup.common_passages(a, b, 8, 75), list(brute(a, b, 8, 75))
        met += bool(want)
        assert set(got) <= set(want) if n % 3 else bool(got) == bool(want)
        for k in (0, 2):
            assert {z for w in want for z in range(w[k], w[k + 1] + 1)} <= {z for g in got for z in range(g[k], g[k + 1] + 1)}
    assert met > 40


@pytest.mark.parametrize("dim", [64, 256])
def test_vectors_that_are_all_near_one_another_take_bounded_memory(spark, dim):
    import tracemalloc

    import numpy as np

    rng = np.random.default_rng(20)
    near = rng.normal(size=dim) + rng.normal(size=(1000, dim)) * 0.1
    tracemalloc.start()
    i, j = embedding_near_dedup.linked(near, near, 0.93)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    unit = near / np.linalg.norm(near, axis=1, keepdims=True)
    assert len(i) == (unit @ unit.T >= 0.93).sum() == 1_000_000 and peak < 150 << 20
    if dim == 64:
        rows = [(k, (near[k % 1000] * (1 + 1e-3 * k)).tolist(), 1) for k in range(2000)]
        got = embedding_near_dedup.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()
        assert {(r.n_links, r.component_id) for r in got} == {(1999, 0)}


def test_the_exact_way_loses_nothing(spark, monkeypatch):
    """Where counting asks for more collisions than there are projections, all are still found."""
    import numpy as np

    df = spark.createDataFrame(vectors(), "vec_id long, embedding array<double>, label int")
    assert ordered(embedding_near_dedup.near_vectors(df, exact=True)) == sorted(brute.op10(vectors()))
    monkeypatch.setattr(embedding_near_dedup, "least_count", lambda: 65)
    x = np.random.default_rng(3).normal(size=(40, 5))
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    i, j = embedding_near_dedup.linked(x, x, 0.93, exact=True)
    assert set(zip(i.tolist(), j.tolist())) == set(zip(*(z.tolist() for z in np.nonzero(unit @ unit.T >= 0.93))))
    assert not len(embedding_near_dedup.linked(x, x, 0.93)[0])


def test_components_of_links():
    import numpy as np

    a, b = np.array([5, 9, 3, 8, 20, 7, 7]), np.array([9, 3, 11, 8, 21, 7, 6])
    node, root = embedding_near_dedup._forest(a, b)
    assert dict(zip(node.tolist(), root.tolist())) == {5: 3, 9: 3, 11: 3, 21: 20, 7: 6}
    chain = np.arange(1, 5000)
    node, root = embedding_near_dedup._forest(chain, chain - 1)
    assert len(node) == 4999 and not root.any()


def test_diagonals_are_all_maximal_runs():
    import numpy as np

    def plain(a, b):
        out = []
        for d in range(1 - len(a), len(b)):
            i = max(0, -d)
            while i < len(a) and i + d < len(b):
                first = i
                while i < len(a) and i + d < len(b) and a[i] == b[i + d]:
                    i += 1
                if i > first:
                    out.append((d, first, i - 1))
                i += 1
        return sorted(out)

    rng = np.random.default_rng(9)
    for _ in range(200):
        k = int(rng.integers(1, 5))
        a, b = rng.integers(0, k + 1, rng.integers(1, 40)).astype(np.uint64), rng.integers(0, k, rng.integers(1, 40)).astype(np.uint64)
        assert sorted(map(tuple, substring_dedup.diagonals(a, substring_dedup.Indexed(b)).tolist())) == plain(a, b)


def test_long_texts_of_repeated_words(spark):
    """The work doesn't grow with the square of a repetition; each place is in the result."""
    import time

    lines = [" ".join(["again"] * 20_000), " ".join(["again"] * 19_000), " ".join(f"w{i % 9}" for i in range(20_000)), " ".join(f"w{i % 9}" for i in range(5, 18_000))]
    df = spark.createDataFrame([(k, x) for k, x in enumerate(lines)], "doc_id long, text string")
    began = time.time()
    got = {r.doc_id: (r.class_id, r.n_partners, r.n_repeated) for r in substring_dedup.passage_classes(df).collect()}
    assert got == {0: (0, 1, 20_000), 1: (0, 1, 19_000), 2: (2, 1, 20_000), 3: (2, 1, 17_995)} and time.time() - began < 120


def test_a_line_that_the_smallest_document_repeats(spark):
    """All its places and all its holders are told, not each place with each holder."""
    many = " ".join(f"{PASSAGE} " + " ".join(f"gap{i}x{k}" for k in range(20)) for i in range(12))
    rows = [(0, many), *((d, f"{' '.join(f's{d}x{k}' for k in range(30))} {PASSAGE}") for d in range(1, 9))]
    got = {r.doc_id: r for r in substring_dedup.passage_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(r.class_id == 0 for r in got.values()) and got[0].n_partners == 8 and got[0].n_repeated == 12 * 60
    assert all(got[d].passages == "30:90" for d in range(1, 9))


def test_temporary_tables_of_two_threads(spark, tmp_path):
    """A block that ends deletes its own tables only, not those of another thread or of an outer block."""
    import threading

    from quarryline.llm.common import materialise, temporary_tables

    ready, done, seen = threading.Event(), threading.Event(), {}

    def other():
        with temporary_tables(spark):
            seen["df"] = materialise(spark.range(5), "other")
            ready.set()
            done.wait(60)
            seen["n"] = seen["df"].count()

    thread = threading.Thread(target=other)
    with temporary_tables(spark):
        outer = materialise(spark.range(3), "outer")
        thread.start()
        ready.wait(60)
        with temporary_tables(spark):
            inner, kept = materialise(spark.range(4), "inner"), materialise(spark.range(6), "kept", keep=True)
        assert outer.count() == 3 and kept.count() == 6
        with pytest.raises(Exception, match="(?i)path|file"):
            inner.count()
    done.set()
    thread.join()
    assert seen["n"] == 5
    with pytest.raises(Exception, match="(?i)path|file"):
        outer.count()


@pytest.mark.parametrize("members", [50_000, 1_000_000])
def test_pairs_at_the_threshold_share_a_table_of_a_large_label(members):
    """With the plans that large labels have, and the count that all have."""
    import math

    import numpy as np

    rng, dim = np.random.default_rng(6), 64
    x, z = rng.normal(size=(2, 3000, dim))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    z -= (z * x).sum(1, keepdims=True) * x
    y = 0.93 * x + math.sqrt(1 - 0.93**2) * z / np.linalg.norm(z, axis=1, keepdims=True)
    plan = embedding_near_dedup.plan(members, 0.93)
    assert plan[0] > 5 and (embedding_near_dedup.cells_of(x, *plan, 0.93) == embedding_near_dedup.cells_of(y, *plan, 0.93)).any(1).all()
    along = embedding_near_dedup.directions(dim)
    half = embedding_near_dedup.WINDOW * math.sqrt(2 - 2 * 0.93)
    assert ((np.abs(x @ along - y @ along) <= half).sum(1) >= embedding_near_dedup.least_count()).all()


def test_what_passages_leave_on_disk_while_they_are_found(spark, docs, monkeypatch):
    """A query's shuffle files go when it ends, and the largest tables as soon as they are read."""
    kept, folder, write = [], common.scratch_dir(spark).removeprefix("file://"), common.materialise

    def shuffles():
        found = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return {name for k in range(found.size()) if (name := found.apply(k).getName()).startswith("shuffle_")}

    def seen(df, label, keep=False):
        out = write(df, label, keep)
        kept.append((label, {x.rpartition("-")[0] for x in set(os.listdir(folder)) - others}, len(shuffles() - before)))
        return out

    others, before = set(os.listdir(folder)) if os.path.isdir(folder) else set(), shuffles()
    monkeypatch.setattr(substring_dedup, "materialise", seen)
    assert substring_dedup.passage_classes(docs).count() == len({r.doc_id for r in docs.select("doc_id").collect()})
    at = {label: tables for label, tables, _ in kept}
    assert {"shared-parts", "texts-of-parts", "open-pairs", "passage-classes"} <= set(at)
    assert not at["texts-of-parts"] & {"nodes", "windows", "leaders", "runs"} and "seeds" not in at["passages"]
    assert all(n == 0 for _, _, n in kept), kept
    assert spark.conf.get(common.CLEANUP, None) is None
    spark.conf.set(common.CLEANUP, "false")
    try:
        with common.shuffles_cleaned(spark):
            assert spark.conf.get(common.CLEANUP) == "false"
        assert spark.conf.get(common.CLEANUP) == "false"
    finally:
        spark.conf.unset(common.CLEANUP)


def test_ranges_that_all_functions_cover():
    rng = np.random.default_rng(5)
    for _ in range(300):
        ranges, marks = [], []
        for _ in range(3):
            low = rng.integers(0, 40, rng.integers(0, 6))
            high = low + rng.integers(0, 15, len(low))
            ranges.append(substring_dedup.union(low, high))
            marks.append({x for i, j in zip(low.tolist(), high.tolist(), strict=True) for x in range(i, j + 1)})
            assert marks[-1] == {x for i, j in zip(*(r.tolist() for r in ranges[-1]), strict=True) for x in range(i, j + 1)}
            assert all(np.diff(ranges[-1][0]) > 1)
        low, high = (r.tolist() for r in substring_dedup.in_all(ranges))
        assert set.intersection(*marks) == {x for i, j in zip(low, high, strict=True) for x in range(i, j + 1)}


def test_groups_are_whole():
    rng = np.random.default_rng(6)
    a, b = np.sort(rng.integers(0, 9, 200)), rng.integers(0, 3, 200)
    b = b[np.lexsort((b, a))]
    cuts = [0, 0, 7, 8, 120, 121, 200]
    batches = [pa.RecordBatch.from_arrays([pa.array(x[i:j]) for x in (a, b)], ["a", "b"]) for i, j in zip(cuts, cuts[1:], strict=False)]
    for keys in (1, 2):
        parts = list(substring_dedup.whole_groups(iter(batches), keys))
        assert [x.tolist() for x in map(np.concatenate, zip(*parts, strict=True))] == [a.tolist(), b.tolist()]
        told = [{tuple(r) for r in np.array(part[:keys]).T.tolist()} for part in parts]
        assert sum(map(len, told)) == len(set.union(*told))


def test_hashes_that_a_text_lacks_are_not_searched(monkeypatch):
    """The bounds of a shingle's places are searched once, and of most shingles that the other text lacks never."""
    from quarryline.llm import substring_dedup as S

    rng = np.random.default_rng(5)
    b = rng.integers(1, 2**63, size=4000, dtype=np.uint64) * np.uint64(2)
    b = np.concatenate([b, b[:300], b[100:200]])
    a = np.concatenate([rng.integers(1, 2**63, size=20_000, dtype=np.uint64) * np.uint64(2), b[50:450], b[:1]])
    index, asked, search = S.Indexed(b), [], np.searchsorted
    monkeypatch.setattr(S.np, "searchsorted", lambda line, of, *rest: (asked.append(np.size(of)), search(line, of, *rest))[1])
    low, high = index.places(a)
    assert sum(asked) < 4000
    places: dict[int, list[int]] = {}
    for k, x in enumerate(b.tolist()):
        places.setdefault(x, []).append(k)
    assert [index.order[i:j].tolist() for i, j in zip(low.tolist(), high.tolist(), strict=True)] == [places.get(x, []) for x in a.tolist()]
    assert not any(x.any() for x in S.Indexed(b[:0]).places(a))

"""Merging of similar findings against a plain walk over all of them; sources without comments."""

import io
import random
import re
import tokenize
from difflib import SequenceMatcher

import pytest

from quarryline.operators import artifacts as A
from quarryline.operators import merging as M

SCHEMA = "id long, file string, position int, rule_id string, type string, root string, snippet string, cell int"


def walk(findings, groups):
    """id -> representative, every finding against every earlier one, in order of file and position."""
    of = {name: (primary, exact) for name, primary, exact in groups}
    held, out = [], {}
    for f in sorted(findings, key=lambda f: (f[1] or "", f[2])):
        i, file, _, rule, kind, root, snippet, cell = f
        text, root = re.sub(r"\s+", "", snippet or "").casefold(), re.sub(r":\d+$", "", root or "")
        match = None
        for h in held if file in of else ():
            if h["group"] != of[file][0] or file in h["files"] or h["rule"] != rule:
                continue
            same = bool(root) and h["root"] == root
            if not same and of[file][1]:
                same = h["text"] == text
            elif not same and (not h["text"] or not text):
                same = h["type"] == kind
            elif not same:
                same = SequenceMatcher(None, h["text"], text, autojunk=False).ratio() >= 0.85 or (h["type"] == kind and h["cell"] == cell)
            if same:
                match = h
                break
        if match is None:
            match = {"id": i, "group": of.get(file, (None,))[0], "rule": rule, "root": root, "text": text, "type": kind, "cell": cell, "files": set()}
            held.append(match)
        match["files"].add(file)
        out[i] = match["id"]
    return out


def test_representatives_equal_a_plain_walk(spark):
    rnd = random.Random(16)
    words = ["frame['age']", "frame['Age'] = 1", "model.fit(x)", "model.fit(X, y)", "", None, "a", "df = df.dropna(how='all')", "df=df.dropna(how='any')", "STRASSE", "straße"]
    files = [f"f{k:02d}" for k in range(24)]
    groups = [(f, files[k // 6 * 6], k // 6 == 1) for k, f in enumerate(files) if k < 18]
    profile = [(rnd.choice("RS"), rnd.choice("tu"), rnd.choice([None, "c:1", "c:22", "d"]), rnd.choice(words), rnd.choice([1, 2, None])) for _ in range(9)]
    findings = []
    for f in files:
        # some files repeat one profile, others have things of their own
        own = profile if rnd.random() < 0.4 else [(rnd.choice("RS"), rnd.choice("tu"), rnd.choice([None, "c:1", "c:22", "d"]), rnd.choice(words), rnd.choice([1, 2, None])) for _ in range(rnd.randrange(9))]
        findings += [(len(findings) + k, f, k, r, t, root, text, cell) for k, (r, t, root, text, cell) in enumerate(own)]
    findings.append((len(findings), None, 0, "R", "t", None, "a", 1))
    df, g = spark.createDataFrame(findings, SCHEMA).repartition(3), spark.createDataFrame(groups, "name string, primary string, exact boolean")
    want = walk(findings, groups)
    assert {r.id: r.representative for r in M.representatives(df, g).collect()} == want
    assert len(set(want.values())) < len(want)
    merged = {r.id: (r.n, list(r.files)) for r in M.merged_by_similarity(df, g).collect()}
    assert sum(n for n, _ in merged.values()) == len(findings) and set(merged) == set(want.values())
    shown = {r.id: r.file for r in M.merged_by_similarity(df, g).collect()}
    exact = {f: p for f, p, e in groups if e}
    assert all(shown[f[0]] == exact.get(f[1], f[1]) for f in findings if f[0] in shown)


def test_the_order_decides_between_similar_findings(spark):
    """b is like a and like c, which are not alike; two of one file are never one."""
    a, b, c = "x" * 40, "x" * 34 + "y" * 8, "x" * 28 + "y" * 16
    assert M.same_finding({"root": "", "text": a, "type": "t", "cell": 1}, {"root": "", "text": b, "type": "u", "cell": 2}, False) == (SequenceMatcher(None, a, b, autojunk=False).ratio() >= 0.85)
    rows = [(1, "p", 1, "R", "t1", None, a, 1), (2, "q", 1, "R", "t2", None, b, 2), (3, "q", 2, "R", "t3", None, b, 3), (4, "r", 1, "R", "t4", None, c, 4)]
    groups = [(f, "p", False) for f in "pqr"]
    got = {r.id: r.representative for r in M.representatives(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(groups, "name string, primary string, exact boolean")).collect()}
    assert got == walk(rows, groups) and got[3] == 3


def test_no_findings_and_no_groups(spark):
    none, g = spark.createDataFrame([], SCHEMA), spark.createDataFrame([], "name string, primary string, exact boolean")
    assert M.representatives(none, g).count() == 0 and M.merged_by_similarity(none, g).count() == 0
    one = spark.createDataFrame([(7, "p", 1, "R", None, None, None, None)], SCHEMA)
    assert [tuple(r) for r in M.representatives(one, g).collect()] == [(7, 7)]


SOURCES = {
    "": "",
    "# only": "",
    "x = 1  # one\ny = '# no'  # yes": "x=1y='#no'",
    's = """a # b\n# c"""  # d': 's="""a#b#c"""',
    "r = r'\\'  # '\nq = 1": "r=r'\\'#'q=1",
    "r = r'\\\\'  # '\nq = 1": "r=r'\\\\'q=1",
    "a = [1,  # one\n  2]  # two": "a=[1,2]",
    "b = 1 + \\\n  2  # c": "b=1+\\2",
    "f'{x}#{y!r:>{w}}'  # z": "f'{x}#{y!r:>{w}}'",
    "s = 'unterminated # kept\n  # dropped\nt": "s='unterminated#keptt",
    "if x:\n    y\n  z # kept\n# dropped": "ifx:yz#kept",
    "(1 # kept\n# dropped": "(1#kept",
    "b'#' b\"#\" u'#'#c": "b'#'b\"#\"u'#'",
    "é = 'ß'  # ü": "é='ß'",
    "x = 1 # a\r\ny = 2 # b": "x=1y=2",
}


@pytest.mark.parametrize("source", SOURCES)
def test_comment_free_sources(source):
    assert re.sub(r"\s+", "", A.comment_free(source)) == SOURCES[source]


def test_comments_are_those_of_the_tokenizer():
    rnd = random.Random(5)
    parts = ["x", " = ", "'a'", '"#"', "# c", "\n", "(", ")", "1", "'''", "\\", "f'{x}'", " "]
    for _ in range(800):
        source = "".join(rnd.choice(parts) for _ in range(rnd.randrange(12)))
        try:
            kept = tokenize.untokenize(t for t in tokenize.generate_tokens(io.StringIO(source).readline) if t.type != tokenize.COMMENT)
        except (tokenize.TokenError, SyntaxError):
            continue
        if "\\" not in source:  # joined lines are written in another way
            assert re.sub(r"\s+", "", A.comment_free(source)) == re.sub(r"\s+", "", kept)


def test_near_pairs_of_code(spark):
    rows = [(1, "a = 1  # " + "first " * 30), (2, "a = 1  # " + "other " * 30), (3, None), (4, "b = '#'"), (5, "b = '# '  # x")]
    df = spark.createDataFrame(rows, "name long, text string")
    assert A.near_pairs(df, "name", "text").count() == 0
    # what is equal without comments is one artifact of several names
    plain = {r.name: r.text for r in A.without_comments(df, "text").collect()}
    assert plain[1].rstrip() == plain[2].rstrip() == "a = 1" and plain[3] is None and plain[4] == "b = '#'"

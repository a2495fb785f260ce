"""Spelling variants against brute force over all pairs, with partitions cut into small blocks too."""

import random
import re
import zlib
from collections import Counter, defaultdict

import pandas as pd
import pytest

from tablescope.llm import queries, spelling

SF = "/root/testdata/sf0.001"


def plain(rows):
    """Result rows by word, from all words and the texts with one code point left out."""
    n = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    n = {w: k for w, k in n.items() if k >= 3 and len(w) >= 5}
    meet = defaultdict(set)
    for w in n:  # near words share what is left without one code point, or one is what is left of the other
        meet[w].add(w)
        for k in range(len(w)):
            meet[w[:k] + w[k + 1 :]].add(w)
    near = defaultdict(set)
    for group in meet.values():
        for a in group:
            near[a].update(b for b in group if b != a and one_edit(a, b))
    out = {}
    for w in n:
        best = min(((-n[b], b) for b in near[w]), default=None)
        form = best[1] if best and -best[0] >= 2 * n[w] else None
        out[w] = [form, n[w], len(near[w]), n[form] if form else None]
    for w in n:
        root = w
        while out[root][0]:
            root = out[root][0]
        out[w].append(root)
    return out


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def same(found, expected):
    assert len(found) == len(expected)
    for row in found.itertuples():
        form, n, n_near, form_n, root = expected[row.word]
        got_form = None if pd.isna(row.form) else row.form
        assert (got_form, row.n, row.n_near, row.root) == (form, n, n_near, root), row.word
        assert pd.isna(row.form_n) if form_n is None else row.form_n == form_n


def test_op12(spark):
    docs = pd.read_parquet(f"{SF}/documents.parquet")
    expected = plain(zip(docs.doc_id, docs.text, strict=True))
    assert sum(x[0] is not None for x in expected.values()) > 10
    same(queries.queries()["op12_spelling"](spark, SF).toPandas(), expected)


@pytest.mark.parametrize("block", [spelling.BLOCK, 3])
def test_blocks(spark, block):
    rng = random.Random(block)
    rows = []
    for doc_id in range(40):
        words = ["".join(rng.choice("abÀ÷") for _ in range(rng.choice([5, 5, 6, 6, 7, 12]))) for _ in range(120)]
        rows.append((doc_id, " ".join(w.upper() if rng.random() < 0.1 else w for w in words)))
    rows.append((41, "chain " * 3 + "chaix " * 8 + "chaxx " * 20 + "chxxx " * 50 + "cxxxx " * 120))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    expected = plain(rows)
    assert len(expected) > 200 and max(x[2] for x in expected.values()) > 5
    assert expected["chain"][4] == "cxxxx"
    same(spelling.variants(df, block=block).toPandas(), expected)


def test_acceptor():
    words = ["aab", "ab", "abab", "b", "bab", "", "x" * 3000]
    acceptor = spelling.Acceptor(words)
    assert sorted(spelling.agreed(acceptor, acceptor.start, acceptor, acceptor.start)) == sorted(words)
    assert len(acceptor.states) < sum(map(len, words))
    pairs = list(spelling.one_edit(acceptor, acceptor))
    assert len(pairs) == len(set(pairs))
    assert set(pairs) == {(a, b) for a in words for b in words if one_edit(a, b)}


def test_odd_rows(spark):
    schema = "n long, word string, form string, doc_id long, text string, i int"
    long_word = "q" * 200_000
    rows = [(1, None), (2, ""), (None, "hellö hellö wörld hello"), (3, "hello " * 7), (3, "hello " * 7), (4, f"{long_word} " * 3), (5, "日本語 12 a b")]
    df = spark.createDataFrame([(0, "w", "f", k, t, 1) for k, t in rows], schema)
    same(spelling.variants(df).toPandas(), plain(rows))
    assert spelling.variants(df.limit(0)).count() == 0
    text_ids = df.withColumn("doc_id", df.doc_id.cast("string"))
    same(spelling.variants(text_ids).toPandas(), plain(rows))

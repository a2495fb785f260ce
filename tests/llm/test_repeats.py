"""Repeated passages against a plain dictionary of windows, with hot windows and small shards too."""

import hashlib
import random
import re

import pandas as pd
import pytest

from tablescope.llm import queries, repeats

SF = "/root/testdata/sf0.001"


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def plain(rows):
    """Kept words by row number."""
    key = lambda k, p: (rows[k][0] is None, rows[k][0] or 0, p)
    first = {}
    for k, (_, text) in enumerate(rows):
        w = words(text)
        for p in range(len(w) - 19):
            window = tuple(w[p : p + 20])
            first[window] = min(first.get(window, key(k, p)), key(k, p))
    out = []
    for k, (_, text) in enumerate(rows):
        w = words(text)
        gone = {p + j for p in range(len(w) - 19) if first[tuple(w[p : p + 20])] < key(k, p) for j in range(20)}
        out.append((len(w), len(gone), " ".join(x for p, x in enumerate(w) if p not in gone)))
    return out


def same(found, rows):
    expected = sorted((str(k), *x) for (k, _), x in zip(rows, plain(rows), strict=True))
    got = sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept) for r in found.collect())
    assert got == expected


def test_op11(spark):
    docs = pd.read_parquet(f"{SF}/documents.parquet").sort_values("doc_id")
    rows = list(zip(docs.doc_id, docs.text, strict=True))
    found = queries.queries()["op11_repeats"](spark, SF).orderBy("doc_id").collect()
    for row, (n, gone, kept) in zip(found, plain(rows), strict=True):
        assert (row.n_words, row.n_removed) == (n, gone)
        assert row.kept_sha256 == hashlib.sha256(kept.encode()).hexdigest()
    assert sum(r.n_removed for r in found) > 1000


@pytest.mark.parametrize(("shard", "hot"), [(repeats.SHARD, repeats.HOT), (50, 5), (7, 1)])
def test_shards(spark, monkeypatch, shard, hot):
    rng = random.Random(shard)
    passages = [[f"p{k}w{rng.randrange(9)}" for _ in range(rng.choice([20, 25, 60]))] for k in range(12)]
    rows = []
    for k in range(90):
        text = [f"own{k}x{rng.randrange(6)}" for _ in range(rng.randrange(30))]
        for _ in range(rng.randrange(4)):
            p = rng.choice(passages)
            a = rng.randrange(4)
            text += p[a : len(p) - rng.randrange(3)] + [f"y{rng.randrange(40)}"] * rng.randrange(30)
        if k % 3 == 0:
            text += passages[0] + ["tail", str(k)] * 2
        rows.append((rng.choice([k, k, None]), " ".join(text)))
    rows += [rows[5], rows[6], (3, rows[40][1])]
    if shard < 50:
        monkeypatch.setattr(repeats.math, "isqrt", lambda _: 1)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    same(repeats.without_repeats(df, shard=shard, hot=hot), rows)


def test_automata():
    windows = [([f"a{k}" for k in range(j, j + 20)], (False, j, 0)) for j in range(5)]
    found = repeats.Phrases([(" ".join(w).encode(), at) for w, at in windows])
    text = [f"a{k}".encode() for k in range(24)]
    assert sorted(found.repeated(3, text)) == [0, 1, 2, 3]
    assert sorted(found.repeated(None, text)) == [0, 1, 2, 3, 4]


def test_odd_rows(spark):
    long_text = "a b " * 30_000 + "one " * 20_000 + "\t\r\n" * 1000 + "x" * 100_000
    same_20 = " ".join(f"é{k}" for k in range(20))
    rows = [(1, None), (2, ""), (3, " \n"), (4, long_text), (None, same_20), (None, same_20), (5, same_20), (6, same_20.replace(" ", "\n \x0b")), (6, same_20 + " z")]
    schema = "shard int, spans string, doc_id long, text string, words string, text_hash int"
    df = spark.createDataFrame([(1, "s", k, t, "w", 2) for k, t in rows], schema)
    same(repeats.without_repeats(df), rows)
    assert repeats.repeats(df.limit(0)).count() == 0
    names = [(None if k is None else f"k{k}", t) for k, t in rows]
    df = spark.createDataFrame(names, "doc_id string, text string")
    found = {(r.doc_id, r.n_words): r.n_removed for r in repeats.repeats(df).collect()}
    assert found["k5", 20] == 0 and found["k6", 20] == 20 and found["k6", 21] == 20 and found[None, 20] == 20

"""Near copies against all pairs in plain Python."""

import random
import re
from collections import defaultdict

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tablescope.llm import near_copies

DATA = "/root/testdata"


def shingles(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    return frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()


def similar(a, b):
    shared = len(a & b)
    return a == b or 5 * shared >= 4 * (len(a) + len(b) - shared)


def all_links(texts):
    """All pairs of ids with a similarity of at least 0.8: pairs that share no shingle are left out by an inverted list."""
    sets = {k: shingles(t) for k, t in texts.items()}
    where, pairs = defaultdict(list), set()
    for k in sorted(sets):
        # Sets that link miss at most a fifth of each other, so the first shingles of both in a fixed order meet.
        items = sorted(sets[k])[: len(sets[k]) // 5 + 1] if sets[k] else [None]
        other = {j for x in items for j in where[x]}
        pairs |= {(j, k) for j in other if similar(sets[j], sets[k])}
        for x in items:
            where[x].append(k)
    return pairs


def roots(ids, pairs):
    root = {k: k for k in ids}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a, b in pairs:
        low, high = sorted((find(a), find(b)))
        root[high] = low
    return {k: find(k) for k in ids}


@pytest.mark.parametrize("size", ["sf0.001", "sf0.01"])
def test_recall_and_precision(spark, size):
    frame = pd.read_parquet(f"{DATA}/{size}/documents.parquet").set_index("doc_id")
    texts = frame.text.to_dict()
    pairs = all_links(texts)
    different = {(a, b) for a, b in pairs if shingles(texts[a]) != shingles(texts[b])}
    docs = spark.read.parquet(f"{DATA}/{size}/documents.parquet")
    signed, found = near_copies.groups(docs)
    member = signed.join(found, "class").select(F.col("first.id").alias("best"), "root", "key")
    keyed = near_copies.keyed(docs, "doc_id", "text").select("key", "id")
    got = member.join(keyed, "key").select("id", "root", "best").toPandas().set_index("id")
    kept = [p for p in different if got.root[p[0]] == got.root[p[1]]]
    assert different and len(kept) >= 0.9 * len(different)
    assert all(got.root[a] == got.root[b] for a, b in pairs - different)
    # No group is larger than the links allow, and the smallest id stands for it.
    want = roots(texts, pairs)
    for _, ids in got.groupby("root"):
        assert len({want[k] for k in ids.index}) == 1 and set(ids.best) == {min(ids.index)}
    stay = {r["doc_id"] for r in near_copies.keep_first(docs).select("doc_id").collect()}
    assert stay == set(got.best)


def test_large_buckets(spark):
    """Near copies of one text, and texts with a long passage in common that are too unlike to link."""
    rng = random.Random(3)
    base = [f"w{rng.randrange(10**6)}" for _ in range(300)]
    texts = {}
    for k in range(400):
        w = list(base)
        w[rng.randrange(300)] = f"x{k}"
        texts[k] = " ".join(w)
    common = " ".join(f"c{rng.randrange(10**6)}" for _ in range(150))
    for k in range(400, 600):
        texts[k] = common + " " + " ".join(f"y{k}.{j}" for j in range(40))
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(7)
    stay = {r["doc_id"] for r in near_copies.keep_first(docs).collect()}
    want = roots(texts, all_links(texts))
    assert stay == set(want.values()) and 0 in stay and len(stay) == 201


def test_rows_without_id_and_repeated_rows(spark):
    text = {x: " ".join(f"{x}{k}" for k in range(30)) for x in "abc"}
    rows = [
        (1, text["a"], "p"), (None, text["a"], "q"), (2, text["b"], "p"), (2, text["b"], "q"), (2, text["c"], "p"),
        (3, text["c"].upper(), "p"), (None, "x y", "p"), (None, "X  y", "q"), (None, "x y", "p"), (None, None, "p"), (None, "", "q"),
        (9, " \n", "q"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, key string").withColumn("class", F.lit("own"))
    kept = near_copies.keep_first(docs)
    assert kept.columns == docs.columns
    found = sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=str)
    assert found[:-1] == sorted([(1, text["a"]), (2, text["b"]), (2, text["c"]), (9, " \n")], key=str)
    assert found[-1][0] is None and found[-1][1] in ("x y", "X  y")
    assert near_copies.keep_first(docs.limit(0)).count() == 0


def test_bands_meet_at_the_promised_rate():
    rng = random.Random(5)
    met = 0
    for k in range(300):
        shared = [rng.randrange(2**63) for _ in range(80)]
        a, b = (sorted(shared + [rng.randrange(2**63) for _ in range(10)]) for _ in range(2))
        x, y = (near_copies.bands(near_copies.np.array(s, "uint64")) for s in (a, b))
        met += bool((x == y).any())
    assert met >= 290

"""No link between different texts is lost, at the threshold too."""

import random

from pyspark.sql import functions as F
from test_near_copies import all_links, roots

from tablescope.llm import near_copies


def edges(rng):
    """Chains whose neighbours lie just above the threshold: ten words at the end are exchanged for new ones at each step."""
    texts = {}
    for chain in range(150):
        words = [f"{chain}.{rng.randrange(10**6)}" for _ in range(94)]
        for step in range(4):
            texts[len(texts)] = " ".join(words)
            words = words[10:] + [f"{chain}.{step}.{k}" for k in range(10)]
    return texts


def test_every_link_at_the_threshold(spark):
    texts = edges(random.Random(11))
    pairs = all_links(texts)
    assert len(pairs) == 450
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(5)
    signed, found = near_copies.groups(docs)
    keyed = near_copies.keyed(docs, "doc_id", "text").select("key", "id")
    got = {r["id"]: r["first"]["id"] for r in signed.join(found, "class").join(keyed, "key").select("id", "first").collect()}
    assert got == roots(texts, pairs)


def test_links_that_bands_and_leaders_leave_out(spark, monkeypatch):
    """Without any bucket the prefixes alone find every link."""
    texts = edges(random.Random(12))
    none = lambda buckets, sets: sets.select("class", F.col("class").alias("head")).limit(0)
    monkeypatch.setattr(near_copies, "links", none)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(5)
    stay = {r["doc_id"] for r in near_copies.keep_first(docs).collect()}
    assert stay == set(roots(texts, all_links(texts)).values()) and len(stay) == 150


def sharing(rng, number):
    """Texts that share 82 shingles of 100 with each other: a similarity of 0.69."""
    common = [f"c{rng.randrange(10**9)}" for _ in range(86)]
    return [" ".join(common + [f"{k}.{rng.randrange(10**9)}" for _ in range(18)]) for k in range(number)]


def test_texts_below_the_threshold_do_not_meet(spark):
    """A passage in many texts makes neither rows of a join nor pairs of sets with the square of their number."""
    rows = [near_copies.shingles(x) for x in sharing(random.Random(13), 120)]
    sets = [(k, len(x), near_copies.sketch(x).tolist()) for k, x in enumerate(rows)]
    classes = spark.createDataFrame(sets, "class long, n long, bits array<long>")
    # The passage is known from no sample and stands in front of each prefix.
    common = set(rows[0].tolist()).intersection(*(x.tolist() for x in rows))
    order = [sorted(x.view("int64").tolist(), key=lambda y: (y % 2**64 not in common, y)) for x in rows]
    meeting = spark.createDataFrame([(y, k, at) for k, x in enumerate(order) for at, y in enumerate(x[:21])], "item long, class long, at int")
    member = classes.select("class", F.col("class").alias("root")).limit(0)
    assert near_copies.crossings(meeting, member, classes).count() < 0.15 * 12 * 120 * 119 / 2
    assert near_copies.bridges(meeting, member, classes).count() < 0.2 * 120 * 119 / 2


def test_sketches_rule_out_no_link():
    rng = near_copies.np.random.default_rng(14)
    for n in (0, 1, 90, 255, 257, 400, 520, 3000):
        a = rng.integers(0, 2**64, n, "uint64")
        for gone, new in ((0, 0), (n // 10, n // 10), (n // 5, 0), (0, n // 4)):
            b = near_copies.np.append(a[gone:], rng.integers(0, 2**64, new, "uint64"))
            x, y = near_copies.sketch(a), near_copies.sketch(b)
            if len(x) < len(y):
                x, y = y, x
            assert len(x) <= 2 * len(y)
            for words in (len(y), near_copies.SKETCH):
                both = [near_copies.np.bitwise_xor.reduce(z.reshape(-1, words), axis=0) for z in (x, y)]
                assert near_copies.np.bitwise_count((both[0] ^ both[1]).view("uint64")).sum() <= gone + new


def test_sketches_of_two_sizes_are_folded(spark):
    rng = near_copies.np.random.default_rng(15)
    a = rng.integers(0, 2**64, 300, "uint64")
    b = a[:250]
    pair = [(near_copies.sketch(a).tolist(), near_copies.sketch(b).tolist())]
    assert [len(x) for x in pair[0]] == [8, 4]
    df = spark.createDataFrame(pair, "bits array<long>, others array<long>")
    x = near_copies.np.bitwise_xor.reduce(near_copies.sketch(a).reshape(-1, 4), axis=0) ^ near_copies.sketch(b)
    want = int(near_copies.np.bitwise_count(x.view("uint64")).sum())
    for one, two in (("bits", "others"), ("others", "bits")):
        assert df.select(near_copies.differing(one, two)).first()[0] == want <= 50


def test_buckets_of_unlike_classes_end(spark, monkeypatch):
    """A bucket of unlike classes makes no more pairs than its first leaders; what it leaves out is found by the prefixes."""
    rows = [near_copies.shingles(x) for x in sharing(random.Random(16), 300)]
    sets = [(k, len(x), x.view("int64").tolist(), near_copies.sketch(x).tolist()) for k, x in enumerate(rows)]
    sets = spark.createDataFrame(sets, "class long, n long, items array<long>, bits array<long>")
    buckets = sets.select("class", F.lit(0).alias("band"), F.lit(7).cast("long").alias("value"))
    met, alike = [], near_copies.alike

    def counted(pairs, sets):
        met.append(pairs.count())
        return alike(pairs, sets)

    monkeypatch.setattr(near_copies, "alike", counted)
    assert near_copies.links(buckets, sets).count() == 0
    assert len(met) == 1 and met[0] < 3 * near_copies.LEADERS * 300


def test_bloom_filter_holds_every_key_and_few_others(spark):
    keys = spark.range(20_000).select(F.md5(F.col("id").cast("string")).cast("binary").alias("key"))
    others = spark.range(20_000, 40_000).select(F.md5(F.col("id").cast("string")).cast("binary").alias("key"))
    may = near_copies.may_hold(keys)("key")
    assert keys.filter(may).count() == 20_000 and others.filter(may).count() < 400
    nothing = near_copies.may_hold(keys.limit(0))("key")
    assert others.filter(nothing).count() == 0 and others.filter(~nothing).count() == 20_000


def test_crowded_bloom_filter_drops_no_row(spark, monkeypatch):
    monkeypatch.setattr(near_copies, "MOST_BITS", 1 << 6)
    texts = edges(random.Random(17))
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(5)
    stay = [r["doc_id"] for r in near_copies.keep_first(docs).collect()]
    assert sorted(stay) == sorted(set(roots(texts, all_links(texts)).values()))


def test_sample_of_shingles_grows_with_the_table(spark, monkeypatch):
    """A passage in one text of eighty is known to be frequent, however small the least sample is."""
    monkeypatch.setattr(near_copies, "SAMPLE", 8)
    passage = " ".join(f"p{k}" for k in range(20))
    rows = [(k, f"{passage} own{k}" if k % 80 == 0 else f"a{k} b{k} c{k} d{k} e{k} f{k}") for k in range(8000)]
    docs = near_copies.keyed(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text")
    known = set(near_copies.frequent_shingles(docs, 8000)[0].tolist())
    assert set(near_copies.shingles(passage).tolist()) <= known

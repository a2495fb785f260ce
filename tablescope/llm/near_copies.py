"""Near copies by five-word shingles: SimHash groups, MinHash bands and prefixes propose, the shared shingles decide.

Rows whose texts have the same set of shingles form a class, and only classes are compared. Two classes link when their
sets have a Jaccard similarity of at least 0.8; linked classes form a group, and one document of each group stays. Groups are
those of all links: none between different texts is lost.

First most links are found cheaply. Classes that a leaf of the SimHash tree links (:mod:`simhash`, three bits) are one bucket of
candidates, and those that agree in a band of MinHash values are further ones. A bucket is worked off in rounds. Leaders are
drawn, all its classes are compared with them by their whole sets, and what is like a leader leaves the bucket, as the
leaders do. Every round draws ``LEADERS`` times as many leaders, and a bucket goes on only if all but one in ``LEADERS`` of its
classes left it, so that no round makes more pairs of it than the first; a bucket of unlike classes ends there. This can miss a
link: a pair at 0.8 shares no band with a probability of 0.006, of a pair one class may leave with a leader that the other is
unlike, and buckets end early.

Then the rest is made up. Two sets that link share at least four fifths of either, so, with all shingles in one fixed order, the
first fifth (and one more) of both have a shingle in common. Classes that meet so, far enough in front for their two sizes, often
enough, and are not in one group so far, are compared by their whole sets. Any order is right; shingles that are frequent in a
sample come last, so that common passages bring few together.

Neither rows nor texts move that are not asked for: a Bloom filter of bounded size, which knows the keys asked for, stands before
the joins that tell them exactly. No whole set moves for a pair that its sketches rule out. A sketch has one bit for each remainder of the shingles, which is
their number there modulo two; two sketches differ in no more bits than the sets in shingles.

Defined results: a null text has no words and counts as empty, and all texts without words are copies of each other; a text
of fewer than five words is one shingle; A-Z count as a-z. Of a group the row with the smallest id stays (rows without id
stand last), of its rows one with the smallest digest of the text, and of equal ids and texts one. An empty table gives
an empty result. Columns other than the id and the text are carried along under any name.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablescope.llm import simhash
from tablescope.llm.common import encoded, map_batches, share, staged

WIDTH = 5  # words of a shingle
BANDS, VALUES = 13, 5  # MinHash bands, and values of each
LEADERS = 8  # leaders of a bucket in the first round, and the growth of their number from round to round
MEMBERS = 4096  # comparisons of one leader in one task; leaders with more are copied to several

SKETCH = 4  # words of 64 bits of the smallest sketch, and of those that classes carry into their meetings
SHARED = 64  # of so many shingles of the smaller set one more is asked for in common among the first ones

SAMPLE, PART = 4096, 8  # documents, or one in so many if that is more, that tell the frequent shingles, which only decide how many classes meet
FREQUENT = 100_000  # of them as many are known to each task

MOST_BITS = 1 << 27  # of a Bloom filter: 16 MB in each task
PLACES = 4  # bits that it sets for a key

_DRAW = np.random.default_rng(simhash.SEED)
FACTORS = _DRAW.integers(0, 2**63, BANDS * VALUES, np.uint64) * np.uint64(2) + np.uint64(1)
OFFSETS = _DRAW.integers(0, 2**64, BANDS * VALUES, np.uint64)
BASE, MIX = (_DRAW.integers(0, 2**63, 2, np.uint64) * np.uint64(2) + np.uint64(1)).tolist()


def shingles(text: str | None, width: int = WIDTH) -> np.ndarray:
    """Hashes of the distinct shingles, in order."""
    words = encoded(text).lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    width = min(width, len(words))
    n = len(words) - width + 1
    found = np.zeros(n, np.uint64)
    for k in range(width):
        found = found * np.uint64(BASE) + hashes[k : k + n]
    found ^= found >> np.uint64(31)
    found *= np.uint64(MIX)
    return np.unique(found ^ (found >> np.uint64(29)))


def bands(items: np.ndarray) -> np.ndarray:
    """One value for each band: a hash of its MinHash values; none for an empty set."""
    if not len(items):
        return np.zeros(0, np.int64)
    low = np.full(len(FACTORS), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(items), 8192):
        low = np.minimum(low, (items[None, at : at + 8192] * FACTORS[:, None] + OFFSETS[:, None]).min(axis=1))
    return np.array([xxhash.xxh64_intdigest(x.tobytes()) for x in low.reshape(BANDS, VALUES)], np.uint64).view(np.int64)


def fingerprint(items: np.ndarray) -> int:
    """The SimHash of a set: a bit is 1 if it is set in over half the shingles; zero for an empty set."""
    votes = np.zeros(64, np.int64)
    for at in range(0, len(items), 65_536):
        bits = np.unpackbits(items[at : at + 65_536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        votes += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * votes > len(items), bitorder="little").view("<u8")[0])


def sketch(items: np.ndarray) -> np.ndarray:
    """The numbers of shingles, modulo two, by their remainder: at least one bit for each shingle.

    Sizes are powers of two, so a sketch is folded to a smaller one by combining its parts with exclusive or.
    """
    words = SKETCH
    while 64 * words < len(items):
        words *= 2
    odd = np.bincount((items & np.uint64(64 * words - 1)).astype(np.int64), minlength=64 * words) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<i8")


def row_key(id_: Column, text: Column) -> Column:
    """Sixteen bytes that stand for an id and a text."""
    name = F.coalesce(F.concat(F.lit("="), id_.cast("string")), F.lit("-"))
    return F.unhex(F.md5(F.concat(name, F.lit("\n"), F.coalesce(text, F.lit(""))).cast("binary")))


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``key, id, text, row``: whole rows travel in a column of their own, so that no name of theirs meets one of these."""
    return docs.select(
        row_key(F.col(id_col), F.col(text_col)).alias("key"),
        F.col(id_col).alias("id"),
        F.col(text_col).alias("text"),
        F.struct(*docs.columns).alias("row"),
    )


def signatures(rows: DataFrame) -> DataFrame:
    """``key, id, class, fp, n, bands, bits`` for each row of ``key, id, text``; ``n`` is the size of the set."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        classes, prints, sizes, values, bits = [], [], [], [], []
        for text in batch.column("text").to_pylist():
            items = shingles(text)
            classes.append(xxhash.xxh64_intdigest(items.tobytes()))
            prints.append(fingerprint(items))
            sizes.append(len(items))
            values.append(bands(items))
            bits.append(sketch(items))
        longs = [pa.array(np.array(x, np.uint64).view(np.int64)) for x in (classes, prints, sizes)]
        return pa.RecordBatch.from_arrays(
            [batch.column("key"), batch.column("id"), *longs, *(pa.array(x, pa.list_(pa.int64())) for x in (values, bits))],
            ["key", "id", "class", "fp", "n", "bands", "bits"],
        )

    kind = rows.schema["id"].dataType.simpleString()
    schema = f"key binary, id {kind}, class long, fp long, n long, bands array<long>, bits array<long>"
    return map_batches(rows.select("key", "id", "text"), schema, work)


def places(hashes: np.ndarray, size: int) -> np.ndarray:
    """The bits of a Bloom filter of ``size`` bits, a power of two, that stand for each hash."""
    h = hashes.view(np.uint64)
    step = (h >> np.uint64(32)) | np.uint64(1)
    return (h[:, None] + np.arange(PLACES, dtype=np.uint64) * step[:, None]) & np.uint64(size - 1)


def may_hold(keys: DataFrame) -> Callable[[str], Column]:
    """A test of columns that is true for every key of ``keys`` and false for nearly all others."""
    size = min(MOST_BITS, 1 << max(10, (16 * keys.count()).bit_length()))

    def words(batch: pa.RecordBatch) -> pa.RecordBatch:
        at = np.unique(places(batch.column("h").to_numpy(), size))
        word, first = np.unique(at >> np.uint64(6), return_index=True)
        bits = np.bitwise_or.reduceat(np.uint64(1) << (at & np.uint64(63)), first)
        return pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)) for x in (word, bits)], ["word", "bits"])

    found = map_batches(keys.select(F.xxhash64("key").alias("h")), "word long, bits long", words)
    found = found.groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    held = np.zeros(size // 64, np.uint64)
    held[found.column("word").to_numpy()] = found.column("bits").to_numpy().view(np.uint64)
    get = share(keys.sparkSession, held)

    def test(hashes: pd.Series) -> pd.Series:
        at = places(hashes.to_numpy(), size)
        bits = get()[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))
        return pd.Series((bits & np.uint64(1)).all(axis=1))

    udf = F.pandas_udf(test, "boolean")
    return lambda column: udf(F.xxhash64(column))


def frequent_shingles(rows: DataFrame, total: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that repeat in a sample of the ``total`` rows, in order, and their numbers there."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [shingles(text) for text in batch.column("text").to_pylist()]
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(found).view(np.int64))], ["item"])

    # A shingle that is not seen twice stands in a number of texts that grows with the table, unless the sample does too.
    sample = max(SAMPLE, total // PART)
    picked = rows.filter(F.pmod(F.xxhash64("key"), F.lit(1 << 24)) * F.lit(total) < F.lit(sample << 24))
    counted = map_batches(picked.select("text"), "item long", work).groupBy("item").agg(F.count("*").alias("n"))
    known = counted.filter("n > 1").orderBy(F.desc("n"), "item").limit(FREQUENT).toArrow()
    items, n = known.column("item").to_numpy().view(np.uint64), known.column("n").to_numpy()
    order = np.argsort(items)
    return items[order], n[order]


def prefix(items: np.ndarray, known: np.ndarray, numbers: np.ndarray) -> np.ndarray:
    """The first shingles of a set, rare ones first: one more than a set that links to this one may lack."""
    if len(known):
        at = np.minimum(np.searchsorted(known, items), len(known) - 1)
        items = items[np.lexsort((items, np.where(known[at] == items, numbers[at], 0)))]
    return items[: len(items) - -(-4 * len(items) // 5) + 1]


def meetings(rows: DataFrame, total: int) -> DataFrame:
    """``item, class, at``: the classes that have a shingle in their prefix which another class has in its own, and its place there."""
    get = share(rows.sparkSession, frequent_shingles(rows, total))

    def first(batch: pa.RecordBatch) -> pa.RecordBatch:
        classes, found = [], []
        for text in batch.column("text").to_pylist():
            items = shingles(text)
            found.append(prefix(items, *get()))
            classes.append(xxhash.xxh64_intdigest(items.tobytes()))
        classes = np.repeat(np.array(classes, np.uint64), [len(x) for x in found])
        longs = [pa.array(x.view(np.int64)) for x in (np.concatenate(found), classes)]
        places = pa.array(np.concatenate([np.arange(len(x), dtype=np.int32) for x in found]))
        return pa.RecordBatch.from_arrays([*longs, places], ["item", "class", "at"])

    def met(batches):
        held = [tuple(b.column(c).to_numpy() for c in ("item", "class", "at")) for b in batches if b.num_rows]
        if not held:
            return
        item, kind, at = (np.concatenate(x) for x in zip(*held, strict=True))
        del held
        order = np.lexsort((kind, item))
        item, kind, at = item[order], kind[order], at[order]
        new = np.append(True, (item[1:] != item[:-1]) | (kind[1:] != kind[:-1]))
        item, kind, at = item[new], kind[new], at[new]
        same = item[1:] == item[:-1]
        shared = np.append(same, False) | np.append(False, same)
        yield pa.RecordBatch.from_arrays([pa.array(x[shared]) for x in (item, kind, at)], ["item", "class", "at"])

    # A task holds twenty bytes for each row of its partition.
    schema = "item long, class long, at int"
    return map_batches(rows.select("text"), schema, first).repartition("item").mapInArrow(met, schema)


def differing(bits: str, others: str) -> Column:
    """The number of bits in which two sketches of any sizes differ, the larger one folded."""
    fold = "if(size({0}) > size({1}), {0}[k] ^ {0}[k + size({1})], {0}[k])"  # sizes that fit differ by one fold at most
    one, two = fold.format(bits, others), fold.format(others, bits)
    return F.expr(f"aggregate(sequence(0, least(size({bits}), size({others})) - 1), 0, (x, k) -> x + bit_count(({one}) ^ ({two})))")


def crossings(meeting: DataFrame, member: DataFrame, classes: DataFrame) -> DataFrame:
    """``class, head, n, m``: a row for each shingle in which classes of different groups (``class, root``) meet far enough in front.

    Two sets of ``n`` and ``m`` shingles link if they share ``least`` of them. After the ``c``-th shared one in the order there are
    ``least - c`` more in either set, so the first ``c`` all lie before the places ``n - least + c`` and ``m - least + c``.
    """
    words = [f"b{i}" for i in range(SKETCH)]
    folded = [F.expr(f"aggregate(sequence({i}, size(bits) - 1, {SKETCH}), 0L, (x, k) -> x ^ bits[k])").alias(w) for i, w in enumerate(words)]
    placed = meeting.join(member, "class", "left").select("item", "class", "at", F.coalesce("root", "class").alias("root"))
    mixed = placed.groupBy("item").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low < high").select("item")
    left = placed.join(mixed, "item", "left_semi").join(classes.select("class", "n", *folded), "class")
    left = staged(left, "mixed")
    names = {"class": "head", "at": "there", "root": "other", "n": "m"} | {w: f"o{w}" for w in words}
    right = left.select("item", *[F.col(c).alias(to) for c, to in names.items()])
    fits = (F.col("class") < F.col("head")) & (F.col("root") != F.col("other"))
    fits &= F.col("at") + least_shared() < F.col("n") + wanted_shared()
    fits &= F.col("there") + least_shared() < F.col("m") + wanted_shared()
    fits &= 9 * sum(F.bit_count(F.col(w).bitwiseXOR(F.col(f"o{w}"))) for w in words) <= F.col("n") + F.col("m")
    return left.join(right, "item").filter(fits).select("class", "head", "n", "m")


def least_shared() -> Column:
    """The fewest shingles that sets of ``n`` and ``m`` share if they link."""
    return F.expr("(4 * (n + m) + 8) div 9")


def wanted_shared() -> Column:
    """So many of them must be among the first ones: more for larger sets, as far as the prefixes reach."""
    return F.least(least_shared() - F.expr("(4 * greatest(n, m) + 4) div 5 - 1"), F.expr(f"1 + least(n, m) div {SHARED}"))


def bridges(meeting: DataFrame, member: DataFrame, classes: DataFrame) -> DataFrame:
    """``class, head``: the classes of different groups that may link by what their first shingles share."""
    met = crossings(meeting, member, classes).groupBy("class", "head", "n", "m").agg(F.count("*").alias("common"))
    return met.filter(F.col("common") >= wanted_shared()).select("class", "head")


def sets_of(rows: DataFrame, signed: DataFrame, wanted: DataFrame) -> DataFrame:
    """``class, n, items, bits`` for the classes whose texts have the keys of ``wanted`` (``class, key``)."""
    # Only rows of equal id and text can repeat a class here.
    repeated = staged(signed.groupBy("key").agg(F.count("*").alias("count")).filter("count > 1").select("key"), "repeated")
    wanted = staged(wanted, "wanted")
    texts = rows.select("key", "text").filter(may_hold(wanted)("key")).join(wanted, "key")
    once = texts.join(repeated, "key", "left_anti")
    several = texts.join(repeated, "key", "left_semi").dropDuplicates(["key"])
    return staged(shingle_sets(once.union(several).select("class", "text")), "sets")


def shingle_sets(rows: DataFrame) -> DataFrame:
    """``class, n, items, bits`` for each row of ``class, text``."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        items = [shingles(text) for text in batch.column("text").to_pylist()]
        sizes = pa.array([len(x) for x in items], pa.int64())
        lists = [pa.array(x, pa.list_(pa.int64())) for x in ([x.view(np.int64) for x in items], [sketch(x) for x in items])]
        return pa.RecordBatch.from_arrays([batch.column("class"), sizes, *lists], ["class", "n", "items", "bits"])

    return map_batches(rows.select("class", "text"), "class long, n long, items array<long>, bits array<long>", work)


def fitting(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """``class, head, n, m`` for the rows of ``pairs`` that sizes and sketches do not rule out.

    ``shared / (n + m - shared) >= 4 / 5`` in whole numbers is ``9 * shared >= 4 * (n + m)``, or nine times the shingles that
    only one set has are at most ``n + m``.
    """
    sizes = classes.select("class", "n", "bits")
    near = F.when(9 * F.least("n", "m") >= 4 * (F.col("n") + F.col("m")), 9 * differing("bits", "others") <= F.col("n") + F.col("m"))
    return (
        pairs.join(sizes, "class")
        .join(sizes.select(F.col("class").alias("head"), F.col("n").alias("m"), F.col("bits").alias("others")), "head")
        .filter(near)
        .select("class", "head", "n", "m")
    )


def alike(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The rows ``class, head`` of ``pairs`` whose sets have a similarity of at least 0.8; sets move for those that may."""
    pairs = fitting(pairs, sets)
    pairs = staged(pairs.select("class", "head", "n", "m"), "pairs")
    parts = pairs.groupBy("head").agg(F.ceil(F.count("*") / MEMBERS).cast("int").alias("parts"))
    members = (
        pairs.join(parts, "head")
        .withColumn("part", F.pmod(F.xxhash64("class"), F.col("parts")).cast("int"))
        .join(sets.select("class", "items"), "class")
    )
    heads = (
        sets.select(F.col("class").alias("head"), F.col("items").alias("others"))
        .join(parts, "head")
        .select("head", "others", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    )
    shared = F.size(F.array_intersect("items", "others"))
    return members.join(heads, ["head", "part"]).filter(9 * shared >= 4 * (F.col("n") + F.col("m"))).select("class", "head")


def links(buckets: DataFrame, sets: DataFrame) -> DataFrame:
    """``class, head``: like classes among those that share a bucket (``class, band, value``)."""
    bucket = ["band", "value"]
    found, leaders = [], LEADERS
    # A bucket goes on with at most so many classes.
    buckets = buckets.withColumn("most", F.lit(2**63 - 1))
    while True:
        order = F.xxhash64(F.lit(leaders), "class")
        stats = buckets.groupBy(bucket).agg(
            F.count("*").alias("count"), F.min(order).alias("first"), F.max("most").alias("most")
        ).filter("count > 1 and count <= most").drop("most")
        # The first class of a bucket leads, and others by a draw, so that as many lead as the round asks for. The draw is the
        # same for all buckets: a group that meets in many of them is compared with few leaders.
        drawn = F.pmod(F.xxhash64(F.lit(-leaders), "class"), F.lit(1 << 24)) * F.col("count") < F.lit(
            (leaders - 1) << 24
        )
        buckets = staged(
            buckets.join(stats, bucket).select("class", *bucket, "count", ((order == F.col("first")) | drawn).alias("leads")), "buckets"
        )
        if buckets.isEmpty():
            break
        heads = buckets.filter("leads").select(*bucket, F.col("class").alias("head"))
        met = buckets.drop("count").join(heads, bucket).filter(F.col("class") != F.col("head"))
        # Two leaders meet once.
        met = met.filter(~F.col("leads") | (F.col("class") < F.col("head")))
        like = staged(alike(met.select("class", "head").distinct(), sets), "like")
        found.append(like)
        gone = like.join(heads, "head").select("class", *bucket).distinct()
        buckets = buckets.filter(~F.col("leads")).join(gone, ["class", *bucket], "left_anti")
        buckets = buckets.select("class", *bucket, F.expr(f"count div {LEADERS}").alias("most"))
        leaders *= LEADERS
    result = sets.select("class", F.col("class").alias("head")).limit(0)
    for like in found:
        result = result.union(like)
    return result


def grouped(pairs: DataFrame) -> DataFrame:
    """``class, root`` for each class of the links ``class, head``."""
    member = simhash.components(pairs.select(F.col("class").alias("fp"), F.col("head").alias("other")))
    return staged(member.select(F.col("fp").alias("class"), "root"), "members")


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """``key, class`` for each row of ``docs``, and ``class, root, first`` for each class.

    The root is the same throughout a group, and ``first`` holds the id and the key of the row that stands for the group.
    """
    rows = keyed(docs, id_col, text_col)
    signed = staged(signatures(rows), "signatures")
    row = F.struct(F.col("id").isNull().alias("nameless"), "id", "key")
    classes = staged(
        signed.groupBy("class").agg(
            F.min(row).alias("first"), F.min("fp").alias("fp"), F.min("n").alias("n"),
            F.first("bands").alias("bands"), F.first("bits").alias("bits"),
        ),
        "classes",
    )
    # A leaf of the tree ties a fingerprint to the smallest one it reaches there, which is the bucket of both.
    near = staged(simhash.class_links(classes.select("fp").distinct()).distinct(), "near")
    some = classes.filter(F.size("bands") > 0)
    banded = (
        classes.select("class", F.posexplode("bands").alias("band", "value"))
        .unionByName(some.select("class", F.lit(BANDS).alias("band"), F.col("fp").alias("value")))
        .unionByName(some.join(near, "fp").select("class", F.lit(BANDS).alias("band"), F.col("other").alias("value")))
    )
    shared = banded.groupBy("band", "value").agg(F.count("*").alias("count")).filter("count > 1").select("band", "value")
    buckets = staged(banded.join(shared, ["band", "value"], "left_semi").select("class", "band", "value"), "buckets")
    keys = classes.select("class", "first.key")
    sets = sets_of(rows, signed, keys.join(buckets.select("class").distinct(), "class", "left_semi"))
    member = grouped(links(buckets, sets))
    meeting = staged(meetings(rows, signed.count()), "meetings")
    open_ = staged(fitting(bridges(meeting, member, classes), classes).select("class", "head"), "open")
    ends = open_.select("class").union(open_.select(F.col("head").alias("class"))).distinct()
    more = staged(alike(open_, sets_of(rows, signed, keys.join(ends, "class", "left_semi"))), "bridges")
    if not more.isEmpty():
        # The groups themselves are linked now; a class without a group is one of its own.
        known = [member.select(F.col("class").alias(c), F.col("root").alias(f"{c}_root")) for c in ("class", "head")]
        ends = more.join(known[0], "class", "left").join(known[1], "head", "left")
        joined = grouped(ends.select(F.coalesce("class_root", "class").alias("class"), F.coalesce("head_root", "head").alias("head")))
        top = joined.select(F.col("class").alias("root"), F.col("root").alias("top"))
        both = member.unionByName(joined.select("class", F.col("class").alias("root")).join(member, "class", "left_anti"))
        member = staged(both.join(top, "root", "left").select("class", F.coalesce("top", "root").alias("root")), "members")
    rooted = classes.join(member, "class", "left").select("class", F.coalesce("root", "class").alias("root"), "first")
    best = rooted.groupBy("root").agg(F.min("first").alias("first"))
    found = staged(rooted.select("class", "root").join(best, "root").select("class", "root", "first"), "groups")
    return signed.select("key", "class"), found


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each group of near copies."""
    signed, found = groups(docs, id_col, text_col)
    stays = found.select(F.col("first.key").alias("key")).distinct()
    counted = signed.groupBy("key").agg(F.count("*").alias("count"))
    dropped = counted.join(stays, "key", "left_anti").select("key")
    repeated = staged(counted.filter("count > 1").join(stays, "key", "left_semi").select("key"), "repeated")
    dropped = staged(dropped.union(repeated), "dropped")
    rows = keyed(docs, id_col, text_col).select("key", "row")
    # Whole rows only move if they may be dropped, and meet for the few keys that repeat.
    may = may_hold(dropped)("key")
    once = rows.filter(~may).union(rows.filter(may).join(dropped, "key", "left_anti"))
    several = rows.filter(may).join(repeated, "key", "left_semi").dropDuplicates(["key"])
    return once.union(several).select("row.*")

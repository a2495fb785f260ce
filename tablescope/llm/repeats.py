"""Removal of repeated passages with sharded Aho-Corasick automata.

A window is ``WINDOW`` consecutive words; one that also starts earlier in the corpus is repeated, and its words go.

1. *Where windows can recur.* Each window is tied to one of its runs of ``ANCHOR`` words, the one of smallest hash (the
   anchor), so equal windows have equal anchors and about one run in eight is one. Anchors are counted over all documents;
   only windows of an anchor that occurs twice can recur. A bit map of those anchors, of bounded size, lets tasks see this for
   themselves; what it lets through in error is found not to recur later.
2. *Shards.* The stretch of words behind each such anchor goes to the shard of the anchor, so equal windows meet. In a
   shard, windows seen at two places are confirmed as recurring by their words, an Aho-Corasick automaton of them is
   compiled, and all stretches are streamed through it; each occurrence behind the first is repeated.
3. *Hot anchors.* Anchors that occur more often than ``hot`` (the square root of all occurrences) would crowd a shard. Their
   windows are counted by their words, combined in the tasks before the exchange. Windows above ``hot`` occurrences are at most eight
   times that root in number: they are compiled into automata of bounded size that are broadcast, and every document
   is streamed through them. The other windows of hot anchors go to shards one by one, by their own hash, and no more than ``hot`` of
   a kind meet.
4. *Documents* meet the spans found in shards in one join, drop the words, and are hashed.

All steps compare words, so results are exact; hashes only decide what meets where.

Defined results: a null or empty text has no words and keeps nothing (the digest of an empty text); a null id comes after
all others; rows of one id are one document for the order of places, so equal rows of one id keep or lose the same words and
do not repeat each other; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablescope.llm.common import map_batches, share, staged

WINDOW = 20
ANCHOR = 6
SHARD = 3000  # stretches of a shard, on average; small automata stay in the cache of a core
HOT = 2000  # anchors that occur no more often than this are never hot
MOST_BITS = 28  # the bit map has 2**28 bits at most: 32 MB
PHRASES = 20_000  # windows of one automaton of hot windows
CHUNK = 2_000_000  # bytes of documents that are hashed together; a longer document is a chunk of its own

_ODD = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_PLACE_BITS = 28
_OTHER = "\1"


class _Powers:
    """Powers of an odd number and of its inverse, modulo 2**64."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > len(self.up):
            size = max(n, 2 * len(self.up))
            self.up, self.down = (
                np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, x, np.uint64)])) for x in (_ODD, _INVERSE)
            )
        return self.up[:n], self.down[:n]


_powers = _Powers()


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _run_hashes(values: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A hash of ``values[begin:end]`` for each pair, from prefix sums."""
    up, down = _powers.get(len(values) + 1)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values * up[:-1])])
    return mixed((sums[end] - sums[begin]) * down[begin])


class Chunk:
    """Some whole documents of a batch as one array of bytes: their words, and the hashes of runs of words."""

    def __init__(self, data: np.ndarray, edges: np.ndarray):
        space = _SPACE[data]
        before, after = np.append(True, space[:-1]), np.append(space[1:], True)
        inner = edges[(edges > 0) & (edges < len(data))]
        before[inner], after[inner - 1] = True, True
        self.data = data
        self.begin = np.flatnonzero(~space & before)
        self.end = np.flatnonzero(~space & after) + 1
        self.first_word = np.searchsorted(self.begin, edges)
        self.doc = np.repeat(np.arange(len(edges) - 1), np.diff(self.first_word))
        self.hashes = _run_hashes(data.astype(np.uint64) + np.uint64(1), self.begin, self.end)

    def runs(self, size: int) -> np.ndarray:
        """Hashes of all runs of ``size`` words; those that cross documents mean nothing."""
        begin = np.arange(max(0, len(self.hashes) - size + 1))
        return _run_hashes(self.hashes, begin, begin + size)

    def anchors(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each anchor: its hash, and the first and the last of the windows tied to it."""
        number = max(0, len(self.hashes) - WINDOW + 1)
        runs = self.runs(ANCHOR)
        # The upper bits of a hash over its position: the least of a window is its leftmost smallest run.
        least = runs >> np.uint64(_PLACE_BITS) << np.uint64(_PLACE_BITS) | np.arange(len(runs), dtype=np.uint64)
        width, choices = 1, WINDOW - ANCHOR + 1
        while 2 * width <= choices:
            least = np.minimum(least[: len(least) - width], least[width:])
            width *= 2
        least = np.minimum(least[:number], least[choices - width : choices - width + number])
        windows = np.flatnonzero(self.doc[:number] == self.doc[WINDOW - 1 :]) if number else np.zeros(0, np.int64)
        at = (least[windows] & np.uint64(2**_PLACE_BITS - 1)).astype(np.int64)
        new = np.flatnonzero(np.append(True, at[1:] != at[:-1])) if len(at) else at
        return runs[at[new]], windows[new], windows[np.append(new[1:], len(at)) - 1] if len(at) else at

    def text(self, first: int, last: int) -> bytes:
        """The bytes from one word to another."""
        return self.data[self.begin[first] : self.end[last]].tobytes()


def chunks(texts: pa.Array) -> Iterator[tuple[int, Chunk]]:
    """The documents of a batch in chunks of about ``CHUNK`` bytes, each with the number of its first document."""
    texts = pc.fill_null(texts, b"").cast(pa.large_binary())
    edges = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(edges, edges[at] + CHUNK, "right")) - 1)
        yield at, Chunk(data[edges[at] : edges[to]], edges[at : to + 1] - edges[at])
        at = to


def anchor_counts(docs: DataFrame) -> DataFrame:
    """``anchor, n``: the anchors that occur twice or more."""

    def count(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [chunk.anchors()[0] for _, chunk in chunks(batch.column("text"))]
        anchors, n = np.unique(np.concatenate(found), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(anchors.view(np.int64)), pa.array(n)], ["anchor", "n"])

    counts = map_batches(docs.select("text"), "anchor long, n long", count)
    return counts.groupBy("anchor").agg(F.sum("n").alias("n")).filter("n > 1")


class BitMap:
    """A Bloom filter of two bits for each anchor; ``bits`` is the binary logarithm of its size."""

    def __init__(self, bits: int):
        self.bits = bits
        self.map = np.zeros(2**bits // 8, np.uint8)

    def slots(self, anchors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        mask = np.uint64(2**self.bits - 1)
        return (anchors & mask).astype(np.int64), ((anchors >> np.uint64(32)) & mask).astype(np.int64)

    def has(self, anchors: np.ndarray) -> np.ndarray:
        a, b = (self.map[s >> 3] >> (s & 7).astype(np.uint8) & 1 for s in self.slots(anchors))
        return (a & b).astype(bool)


def bit_map(anchors: DataFrame, count: int) -> BitMap:
    """The bit map of a table of anchors: pages of it are made in tasks, and the driver joins them up."""
    found = BitMap(min(MOST_BITS, max(16, math.ceil(math.log2(16 * max(1, count))))))

    def spread(batch: pa.RecordBatch) -> pa.RecordBatch:
        slots = np.unique(np.concatenate(BitMap(found.bits).slots(batch.column("anchor").to_numpy().view(np.uint64))))
        return pa.RecordBatch.from_arrays([pa.array((slots >> 16).astype(np.int32)), pa.array(slots & 65535)], ["page", "slot"])

    def page(table: pa.Table) -> pa.Table:
        bits = np.zeros(65536, np.uint8)
        bits[table.column("slot").to_numpy()] = 1
        return pa.table({"page": table.column("page")[:1], "bits": [np.packbits(bits, bitorder="little").tobytes()]})

    # One slot of a page arrives once from each batch at most, so a page's rows are bounded by its size and the tasks.
    pages = map_batches(anchors, "page int, slot long", spread).distinct()
    for row in pages.groupBy("page").applyInArrow(page, "page int, bits binary").toLocalIterator():
        found.map[row.page * 8192 : (row.page + 1) * 8192] = np.frombuffer(row.bits, np.uint8)
    return found


def place(doc_id, start: int) -> tuple:
    """Places in the order that decides which occurrence is first."""
    return doc_id is None, 0 if doc_id is None else doc_id, start


def hot_windows(docs: DataFrame, anchors: set[int], hot: int) -> list[tuple[bytes, tuple]]:
    """Windows of hot anchors with more than ``hot`` occurrences, and the first place of each."""
    wanted = share(docs.sparkSession, np.array(sorted(anchors), np.uint64))
    schema = T.StructType(
        [
            T.StructField("window", T.BinaryType()),
            T.StructField("n", T.LongType()),
            T.StructField("no_id", T.BooleanType()),
            docs.schema["doc_id"],
            T.StructField("start", T.LongType()),
        ]
    )

    def count(batch: pa.RecordBatch) -> pa.RecordBatch:
        found: dict[bytes, list] = {}
        keys = batch.column("doc_id").to_pylist()
        for at, chunk in chunks(batch.column("text")):
            anchors, first, last = chunk.anchors()
            for k in np.flatnonzero(np.isin(anchors, wanted())):
                doc = chunk.doc[first[k]]
                words = chunk.text(first[k], last[k] + WINDOW - 1).split()
                for j in range(last[k] - first[k] + 1):
                    here = place(keys[at + doc], int(first[k] + j - chunk.first_word[doc]))
                    row = found.setdefault(b" ".join(words[j : j + WINDOW]), [0, here])
                    row[0] += 1
                    row[1] = min(row[1], here)
        rows = list(found.values())
        arrays = [
            pa.array(found.keys(), pa.binary()),
            pa.array([r[0] for r in rows], pa.int64()),
            pa.array([r[1][0] for r in rows], pa.bool_()),
            pa.array([None if r[1][0] else r[1][1] for r in rows], batch.schema.field("doc_id").type),
            pa.array([r[1][2] for r in rows], pa.int64()),
        ]
        return pa.RecordBatch.from_arrays(arrays, schema.fieldNames())

    counted = map_batches(docs.select("doc_id", "text"), schema, count)
    counted = counted.groupBy("window").agg(F.sum("n").alias("n"), F.min(F.struct("no_id", "doc_id", "start")).alias("at"))
    rows = counted.filter(F.col("n") > hot).collect()
    return [(bytes(r.window), place(None if r["at"].no_id else r["at"].doc_id, r["at"].start)) for r in rows]


class Phrases:
    """Automata of windows of known first places; one automaton holds ``PHRASES`` windows at most."""

    def __init__(self, windows: list[tuple[bytes, tuple]]):
        self.parts = []
        for at in range(0, len(windows), PHRASES):
            symbols: dict[bytes, str] = {}
            automaton = ahocorasick.Automaton()
            for window, first in windows[at : at + PHRASES]:
                key = "".join(symbols.setdefault(w, chr(len(symbols) + 2)) for w in window.split(b" "))
                automaton.add_word(key, first)
            automaton.make_automaton()
            self.parts.append((symbols, automaton))

    def repeated(self, doc_id, words: list[bytes]) -> Iterator[int]:
        """Starts of the windows whose first place is before this one."""
        for symbols, automaton in self.parts:
            for end, first in automaton.iter("".join([symbols.get(w, _OTHER) for w in words])):
                start = end - WINDOW + 1
                if first < place(doc_id, start):
                    yield start


def repeated_spans(ids: list, starts: list[int], texts: list[bytes]) -> tuple[list[int], list[int], list[int]]:
    """Spans of words (number of the stretch, begin, end) of one shard that lie in repeated windows."""
    rank = {x: k for k, x in enumerate(sorted({x for x in ids if x is not None}))}
    split = [x.split() for x in texts]
    often = (w for w, n in Counter(chain.from_iterable(split)).items() if n > 1)
    symbols = {w: chr(k + 2) for k, w in enumerate(often)}
    # Words that stand here once are in no recurring window; fragments lie between them.
    fragments, origin, row = [], [], []
    for k, words in enumerate(split):
        base = (rank[ids[k]] if ids[k] is not None else len(rank)) << 40 | starts[k]
        for part in re.finditer(f"[^{_OTHER}]{{{WINDOW},}}", "".join([symbols.get(w, _OTHER) for w in words])):
            fragments.append(part[0])
            origin.append(base + part.start())
            row.append(k)
    # Confirmed: windows at two places, with the first of them.
    seen: dict[str, int] = {}
    recurring: set[str] = set()
    for fragment, base in zip(fragments, origin, strict=True):
        for p in range(len(fragment) - WINDOW + 1):
            window = fragment[p : p + WINDOW]
            before = seen.setdefault(window, base + p)
            if before != base + p:
                recurring.add(window)
                if base + p < before:
                    seen[window] = base + p
    if not recurring:
        return [], [], []
    automaton = ahocorasick.Automaton()
    for window in recurring:
        automaton.add_word(window, seen[window])
    seen.clear()
    automaton.make_automaton()
    found = np.array(list(automaton.iter(_OTHER.join(fragments))), np.int64).reshape(-1, 2)
    sizes = np.array([len(x) for x in fragments], np.int64)
    begins = np.cumsum(sizes + 1) - sizes - 1
    at = found[:, 0] - WINDOW + 1
    part = np.searchsorted(begins, at, "right") - 1
    where = np.array(origin, np.int64)[part] + at - begins[part]
    late = where > found[:, 1]
    part, start = part[late], where[late] & (2**40 - 1)
    if not len(part):
        return [], [], []
    # Windows of a fragment that touch are one span.
    new = np.flatnonzero(np.concatenate([[True], (part[1:] != part[:-1]) | (start[1:] > start[:-1] + WINDOW)]))
    last = np.append(new[1:], len(part)) - 1
    return np.array(row)[part[new]].tolist(), start[new].tolist(), (start[last] + WINDOW).tolist()


def _stretches(docs: DataFrame, known: BitMap, hot: set[int], windows: list[bytes], shards: int) -> DataFrame:
    """``shard, doc_id, text_hash, start, words``: what has to be compared, each stretch in the shard of its anchor."""
    spark = docs.sparkSession
    model = share(spark, (known, np.array(sorted(hot), np.uint64), frozenset(windows)))
    schema = T.StructType(
        [T.StructField("shard", T.IntegerType()), docs.schema["doc_id"]]
        + [T.StructField(c, T.LongType()) for c in ("text_hash", "start")]
        + [T.StructField("words", T.BinaryType())]
    )

    def cut(batch: pa.RecordBatch) -> pa.RecordBatch:
        known, hot, windows = model()
        shard, row, begin, text = [], [], [], []

        def add(chunk: Chunk, at: int, keys: np.ndarray, first: np.ndarray, last: np.ndarray) -> None:
            doc = chunk.doc[first]
            shard.append((keys % np.uint64(shards)).astype(np.int32))
            row.append(at + doc)
            begin.append(first - chunk.first_word[doc])
            a, b = chunk.begin[first].tolist(), chunk.end[last + WINDOW - 1].tolist()
            view = chunk.data.tobytes()
            text.extend([view[i:j] for i, j in zip(a, b, strict=True)])

        for at, chunk in chunks(batch.column("text")):
            anchors, first, last = chunk.anchors()
            crowded = np.isin(anchors, hot)
            cool = known.has(anchors) & ~crowded
            add(chunk, at, anchors[cool], first[cool], last[cool])
            if crowded.any():
                ranges = zip(first[crowded].tolist(), last[crowded].tolist(), strict=True)
                single = np.array(list(chain.from_iterable(range(a, b + 1) for a, b in ranges)))
                rare = [b" ".join(chunk.text(a, a + WINDOW - 1).split()) not in windows for a in single]
                single = single[np.array(rare)]
                add(chunk, at, chunk.runs(WINDOW)[single], single, single)
        rows = pa.array(np.concatenate(row))
        arrays = [
            pa.array(np.concatenate(shard)),
            batch.column("doc_id").take(rows),
            batch.column("text_hash").take(rows),
            pa.array(np.concatenate(begin)),
            pa.array(text, pa.binary()),
        ]
        return pa.RecordBatch.from_arrays(arrays, schema.fieldNames())

    return map_batches(docs, schema, cut)


def without_repeats(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shard: int = SHARD, hot: int = HOT
) -> DataFrame:
    """``doc_id, n_words, n_removed, kept`` for each row: the words that stay, joined by one space."""
    spark: SparkSession = docs.sparkSession
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    docs = docs.withColumn("text_hash", F.xxhash64("text"))
    counts = staged(anchor_counts(docs), "anchors")
    number, total = counts.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    hot = max(hot, math.isqrt(total))
    crowded = {r.anchor % 2**64 for r in counts.filter(F.col("n") > hot).select("anchor").collect()}
    frequent = hot_windows(docs, crowded, hot) if crowded else []
    known = bit_map(counts.select("anchor"), number)
    shards = max(1, -(-total // shard))
    stretches = _stretches(docs, known, crowded, [w for w, _ in frequent], shards)
    span = T.StructType(
        [docs.schema["doc_id"]] + [T.StructField(c, T.LongType()) for c in ("text_hash", "a", "b")]
    )

    def locate(table: pa.Table) -> pa.Table:
        ids, starts, texts = (table.column(c).to_pylist() for c in ("doc_id", "start", "words"))
        row, a, b = repeated_spans(ids, starts, texts)
        row = pa.array(row, pa.int64())
        return pa.table(
            {
                "doc_id": table.column("doc_id").take(row),
                "text_hash": table.column("text_hash").take(row),
                "a": pa.array(a, pa.int64()),
                "b": pa.array(b, pa.int64()),
            }
        )

    spans = stretches.groupBy("shard").applyInArrow(locate, span)
    spans = spans.groupBy("doc_id", "text_hash").agg(F.collect_list(F.struct("a", "b")).alias("spans"))
    spans = spans.select(F.col("doc_id").alias("other_id"), F.col("text_hash").alias("other_hash"), "spans")
    same = F.col("doc_id").eqNullSafe(F.col("other_id")) & (F.col("text_hash") == F.col("other_hash"))
    phrases = share(spark, frequent)
    built: list[Phrases] = []
    out = T.StructType(
        [docs.schema["doc_id"]]
        + [T.StructField(c, T.LongType()) for c in ("n_words", "n_removed")]
        + [T.StructField("kept", T.BinaryType())]
    )

    def drop(batch: pa.RecordBatch) -> pa.RecordBatch:
        if not built:
            built.append(Phrases(phrases()))
        n_words, n_removed, kept = [], [], []
        columns = (batch.column(c).to_pylist() for c in ("doc_id", "text", "spans"))
        for key, text, spans in zip(*columns, strict=True):
            words = text.split() if text else []
            edge = np.zeros(len(words) + 1, np.int64)
            for s in spans or ():
                edge[s["a"]] += 1
                edge[s["b"]] -= 1
            for start in built[0].repeated(key, words):
                edge[start] += 1
                edge[start + WINDOW] -= 1
            stay = np.cumsum(edge)[:-1] == 0
            n_words.append(len(words))
            n_removed.append(len(words) - int(stay.sum()))
            kept.append(b" ".join([words[k] for k in np.flatnonzero(stay)]) if n_removed[-1] else b" ".join(words))
        arrays = [batch.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64())]
        arrays.append(pa.array(kept, pa.binary()))
        return pa.RecordBatch.from_arrays(arrays, out.fieldNames())

    joined = docs.join(spans, same, "left").select("doc_id", "text", "spans")
    return map_batches(joined, out, drop).withColumn("kept", F.col("kept").cast("string"))


def repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_words, n_removed, kept_sha256`` for each row of ``docs``."""
    found = without_repeats(docs, id_col, text_col)
    return found.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))

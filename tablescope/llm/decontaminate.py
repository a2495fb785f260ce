"""Benchmark decontamination by Wu-Manber search over words.

The patterns are the windows of ``width`` consecutive words of every benchmark item (an item of fewer words is one
window). The search walks a document with a block of two words: a shift table says how far the next possible occurrence
lies, so most positions are never looked at; where the shift is zero, the block's bucket names the windows that end in
it, and a comparison of all words confirms them.

Patterns are searched in shards of a bounded number of words: one pass over the documents for each shard, which adds its
finds to the row. The passes need no shuffle. Between two shards the rows are written to the shared folder, so a task
holds the tables of one shard, however large the benchmark is.

Defined results: null or empty texts have no words and are never contaminated; items without words or text
have no window, and items without id hit words but are not listed; repeated rows and ids are judged one by one, repeated items count once; an empty benchmark or table gives
unchanged or no rows; other columns are ignored (``drop_contaminated`` hands them on).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablescope.llm.common import encoded, map_batches, share, staged

WIDTH = 10
SHARD_WORDS = 1_000_000
SEPARATORS = bytes.maketrans(
    bytes(range(0x30)) + bytes(range(0x3A, 0x61)) + bytes(range(0x7B, 0x80)), b" " * (0x30 + 0x27 + 5)
)


def words(text: str | None) -> list[bytes]:
    """Words of digits, small letters and anything beyond ASCII, after A-Z became small."""
    return encoded(text).lower().translate(SEPARATORS).split()


class Searcher:
    """Wu-Manber tables for windows of one length."""

    def __init__(self, windows: dict[tuple[int, ...], list[int]], length: int):
        self.length = length
        self.windows = windows
        self.block = min(2, length)
        self.shift: dict[tuple[int, ...], int] = {}
        self.buckets: dict[tuple[int, ...], list[tuple[int, ...]]] = {}
        for window in windows:
            for end in range(self.block, length + 1):
                key = window[end - self.block : end]
                self.shift[key] = min(self.shift.get(key, length), length - end)
            self.buckets.setdefault(window[length - self.block :], []).append(window)

    def find(self, ids: list[int]) -> Iterator[tuple[int, list[int]]]:
        """Start of each occurrence and the items of its window; id 0 is a word of no item."""
        length, block, shift, n = self.length, self.block, self.shift, len(ids)
        far = length - block + 1
        end = length
        while end <= n:
            if not ids[end - 1]:
                end += length
                continue
            step = shift.get(tuple(ids[end - block : end]), far)
            if step:
                end += step
                continue
            part = tuple(ids[end - length : end])
            for window in self.buckets[part[length - block :]]:
                if window == part:
                    yield end - length, self.windows[window]
            end += 1


class Patterns:
    """One shard of items, ready to search."""

    def __init__(self, items: list[tuple[str | None, str]], width: int):
        self.names = [name for name, _ in items]
        self.vocabulary: dict[bytes, int] = {}
        by_length: dict[int, dict[tuple[int, ...], list[int]]] = {}
        for number, (_, text) in enumerate(items):
            found = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words(text)]
            size = min(width, len(found))
            for at in range(len(found) - size + 1 if size else 0):
                owners = by_length.setdefault(size, {}).setdefault(tuple(found[at : at + size]), [])
                if number not in owners[-1:]:
                    owners.append(number)
        self.searchers = [Searcher(windows, size) for size, windows in sorted(by_length.items())]

    def search(self, found: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Spans of words inside occurrences, joined where they touch, and the names of the items found."""
        look = self.vocabulary.get
        ids = [look(w, 0) for w in found]
        spans, names = [], set()
        for searcher in self.searchers:
            for start, owners in searcher.find(ids):
                spans.append((start, start + searcher.length))
                names.update(self.names[k] for k in owners)
        # Items without an id hit words, but have no name to list.
        return joined(spans), names - {None}


def joined(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def shards(benchmark: DataFrame, id_col: str, text_col: str, shard_words: int) -> Iterator[list[tuple[str | None, str]]]:
    """The items in lists of about ``shard_words`` words; the driver holds one list at a time."""
    items = benchmark.select(F.col(id_col).cast("string").alias("name"), F.col(text_col).alias("text"))
    items = items.filter(F.col("text").isNotNull())
    size, shard = 0, []
    for row in items.toLocalIterator():
        shard.append((row.name, row.text))
        size += len(words(row.text))
        if size >= shard_words:
            yield shard
            size, shard = 0, []
    if shard:
        yield shard


def _find(
    docs: DataFrame, benchmark: DataFrame, width: int, shard_words: int, text_col: str, id_col: str, item_col: str
) -> DataFrame:
    """``docs`` as column ``row``, with the spans and items found by all shards."""
    spark = docs.sparkSession
    out = docs.select(
        F.struct(*[docs[c] for c in docs.columns]).alias("row"),
        docs[text_col].alias("text"),
        F.lit(None).cast("array<struct<a:int,b:int>>").alias("spans"),
        F.lit(None).cast("array<string>").alias("items"),
    )
    for number, shard in enumerate(shards(benchmark, id_col, item_col, shard_words)):
        if number:
            out = staged(out, "searched")
        shared = share(spark, Patterns(shard, width))

        def work(batch: pa.RecordBatch, shared=shared) -> pa.RecordBatch:
            patterns = shared()
            texts = batch.column("text").to_pylist()
            spans, items = batch.column("spans").to_pylist(), batch.column("items").to_pylist()
            for k, text in enumerate(texts):
                found, names = patterns.search(words(text))
                if found:
                    before = [(x["a"], x["b"]) for x in spans[k] or ()]
                    spans[k] = [{"a": a, "b": b} for a, b in joined(before + found)]
                    items[k] = sorted(names.union(items[k] or ()))
            fields = [batch.schema.field(c) for c in ("row", "text", "spans", "items")]
            arrays = [batch.column("row"), batch.column("text")]
            arrays += [pa.array(spans, fields[2].type), pa.array(items, fields[3].type)]
            return pa.RecordBatch.from_arrays(arrays, schema=pa.schema(fields))

        out = map_batches(out, out.schema, work)
    return out


def contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    width: int = WIDTH,
    shard_words: int = SHARD_WORDS,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
) -> DataFrame:
    """For each row of ``docs``: its words, the words inside occurrences, and the items with an occurring window."""
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    found = _find(docs, benchmark, width, shard_words, "text", item_id_col, item_text_col)
    schema = T.StructType(
        [docs.schema["doc_id"]]
        + [T.StructField(c, T.LongType()) for c in ("n_words", "n_hit", "n_items")]
        + [
            T.StructField("items_sha256", T.StringType()),
            T.StructField("contaminated", T.BooleanType()),
            T.StructField("hit_spans", T.ArrayType(T.ArrayType(T.IntegerType()))),
        ]
    )

    def summary(batch: pa.RecordBatch) -> pa.RecordBatch:
        spans = [[[x["a"], x["b"]] for x in row or ()] for row in batch.column("spans").to_pylist()]
        items = [sorted(row or ()) for row in batch.column("items").to_pylist()]
        hit = np.array([sum(b - a for a, b in row) for row in spans], np.int64)
        arrays = [
            batch.column("row").field(0),
            pa.array([len(words(x)) for x in batch.column("text").to_pylist()], pa.int64()),
            pa.array(hit),
            pa.array([len(x) for x in items], pa.int64()),
            pa.array([hashlib.sha256(",".join(x).encode()).hexdigest() for x in items], pa.string()),
            pa.array(hit > 0),
            pa.array(spans, pa.list_(pa.list_(pa.int32()))),
        ]
        return pa.RecordBatch.from_arrays(arrays, schema.fieldNames())

    return map_batches(found, schema, summary)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, text_col: str = "text") -> DataFrame:
    """``docs`` without the rows that hold a window of a benchmark item."""
    found = _find(docs, benchmark, width, SHARD_WORDS, text_col, "item_id", "text")
    return found.filter(F.col("spans").isNull()).select("row.*")

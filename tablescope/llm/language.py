"""Language identification with bit-sliced Bloom filters over character n-grams.

All languages share one filter: a table of ``2 ** bits`` slots, each a mask with one bit for every language (a further
table for every ``PLANE`` languages). An n-gram
sets the bit of each language it is typical of at ``HASHES`` slots; the conjunction of those slots gives, in one look-up,
all languages that contain it. A text's n-grams are counted for each language by the set bits; the count that false
positives would add (the filled share of a language's slice to the power of the hashes) is taken off, and the language
with most n-grams left decides.

An n-gram is typical of a language if its share among the language's n-grams is at least ``TYPICAL`` of its largest share
in any language. Shares come from all documents that may be learned from; n-grams are counted in each task first. The
filter has as many slots as the language with most typical n-grams needs for a filled share of ``FILL``, and cells only as
wide as the number of languages asks for. Its memory is bounded by ``FILTER_BYTES``: a language whose n-grams would fill
more than ``MOST_FILL`` of the largest filter keeps those with the highest counts, with a warning.

Defined results: null texts and texts without letters are ``und`` with score 0, as is every text if nothing could be
learned; equal counts go to the language that is first by name; null languages and ids are not learned from, rows with
null ids are not held out; repeated rows count each; other columns are ignored.
"""

from __future__ import annotations

import warnings
from dataclasses import dataclass
from math import ceil, log, log2

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablescope.llm.common import map_batches, remainder, share, staged

SIZE = 4
BITS = 20  # at least; more with many n-grams
HASHES = 2
FILL = 0.25
MOST_FILL = 0.5
FILTER_BYTES = 1 << 27
CHUNK_BITS = 16  # slots of the filter that are built together
TYPICAL = 0.3
LEAST = 3
PLANE = 63  # languages in one mask
HELD_ROWS = 2_000_000
UNKNOWN = "und"


def fold_table() -> np.ndarray:
    """Letters as themselves in small form, everything else as a space. Beyond the basic plane, a number for 32,768."""
    table = np.full(0x110000, 32, np.uint64)
    for c in (c for c in range(0x40000) if chr(c).isalpha()):
        low = chr(c).lower()
        sign = ord(low) if len(low) == 1 else c
        table[c] = sign if sign < 0x10000 else 0x8000 + sign % 0x8000
    return table


def grams(text: str | None, fold: np.ndarray) -> np.ndarray:
    """The n-grams of the letters of a text, as numbers; words are kept apart by one space."""
    if not text:
        return np.zeros(0, np.uint64)
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    signs = fold[codes]
    if not (signs != 32).any():
        return np.zeros(0, np.uint64)
    signs = np.concatenate([[32], signs, [32]]).astype(np.uint64)
    space = signs == 32
    signs = signs[~(space & np.concatenate([[False], space[:-1]]))]
    n = len(signs) - SIZE + 1
    if n < 1:
        signs = np.concatenate([signs, np.full(SIZE - len(signs), 32, np.uint64)])
        n = 1
    out = np.zeros(n, np.uint64)
    for k in range(SIZE):
        out = (out << np.uint64(16)) | signs[k : k + n]
    return out


def slots(found: np.ndarray, bits: int = BITS) -> list[np.ndarray]:
    """The slots of each n-gram, one array for each hash."""
    out = []
    for factor in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)[:HASHES]:
        mixed = (found ^ (found >> np.uint64(31))) * np.uint64(factor)
        out.append((mixed >> np.uint64(64 - bits)).astype(np.int64))
    return out


@dataclass
class Model:
    languages: list[str]
    masks: np.ndarray  # a row of slots for every PLANE languages

    def __post_init__(self):
        self.masks = np.atleast_2d(self.masks)
        self.wrong = (self.counts(self.masks) / self.masks.shape[1]) ** HASHES

    def counts(self, masks: np.ndarray) -> np.ndarray:
        """How many of the masks hold each language's bit."""
        numbers = range(len(self.languages))
        return np.array([np.count_nonzero(masks[k // PLANE] & masks.dtype.type(1 << k % PLANE)) for k in numbers])

    def predict(self, found: np.ndarray) -> tuple[str, float]:
        if not len(found) or not self.languages:
            return UNKNOWN, 0.0
        first, *rest = slots(found, int(np.log2(self.masks.shape[1])))
        hit = self.masks[:, first]
        for more in rest:
            hit &= self.masks[:, more]
        counts = self.counts(hit)
        true = np.maximum(counts - len(found) * self.wrong, 0) / (1 - np.minimum(self.wrong, 0.99))
        best = int(true.argmax())
        total = true.sum()
        return self.languages[best], float(min(1.0, true[best] / total)) if total else 0.0


def gram_counts(rows: DataFrame) -> DataFrame:
    """``gram, lang, n`` over all rows, counted in each task before the shuffle."""

    def run(batches):
        fold = fold_table()
        held: dict[str, list] = {}
        size = 0

        def merged(parts: list) -> tuple[np.ndarray, np.ndarray]:
            keys, back = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
            return keys, np.bincount(back, np.concatenate([c for _, c in parts])).astype(np.int64)

        def out():
            for lang, parts in held.items():
                keys, counts = merged(parts)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys.view(np.int64)), pa.array([lang] * len(keys), pa.string()), pa.array(counts)],
                    ["gram", "lang", "n"],
                )
            held.clear()

        for batch in batches:
            texts, langs = batch.column("text").to_pylist(), batch.column("lang").to_pylist()
            for lang in sorted(set(langs)):
                waiting, letters = [], 0
                for text in (t for t, x in zip(texts, langs, strict=True) if x == lang):
                    waiting.append(grams(text, fold))
                    letters += len(waiting[-1])
                    if letters > HELD_ROWS:
                        held.setdefault(lang, []).append(np.unique(np.concatenate(waiting), return_counts=True))
                        waiting, letters = [], 0
                if waiting:
                    held.setdefault(lang, []).append(np.unique(np.concatenate(waiting), return_counts=True))
                if len(held[lang]) > 1:
                    held[lang] = [merged(held[lang])]
            size = sum(len(k) for parts in held.values() for k, _ in parts)
            if size > HELD_ROWS:
                yield from out()
        yield from out()

    return rows.mapInArrow(run, "gram long, lang string, n long").groupBy("gram", "lang").agg(F.sum("n").alias("n"))


def bits_for(n: int, most: int) -> int:
    """Bits of the number of slots that ``n`` n-grams fill by ``FILL``; at least ``BITS`` if the memory allows, ``most`` at most."""
    return min(most, max(BITS, ceil(log2(max(1, n) * HASHES / -log(1 - FILL)))))


def most_counted(typical: DataFrame, sizes: dict[str, int], room: int) -> DataFrame:
    """``typical`` with at most ``room`` n-grams of each language, those with the highest counts; equal counts stay or go together."""
    large = [lang for lang, n in sizes.items() if n > room]
    if not large:
        return typical
    warnings.warn(f"more than {room} n-grams are typical of {', '.join(large)}: those with the highest counts are kept", stacklevel=3)
    # A row for each count that occurs: about the square root of the n-grams read.
    seen = typical.filter(F.col("lang").isin(large)).groupBy("lang", "n").agg(F.count("*").alias("rows")).collect()
    keep = F.lit(True)
    for lang in large:
        left, least = room, None
        for n, rows in sorted(((r["n"], r["rows"]) for r in seen if r["lang"] == lang), reverse=True):
            left -= rows
            if left < 0:
                break
            least = n
        # Where even the first counts tie too often, a hash decides.
        some = F.col("n") >= least if least else F.pmod(F.xxhash64("gram"), F.lit(sizes[lang])) < room
        keep = keep & ((F.col("lang") != lang) | some)
    return typical.filter(keep)


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """The filter learned from all documents with a language that are not held out."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    rows = rows.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & (remainder("doc_id", 4) != 2))
    counted = staged(gram_counts(rows.select("text", "lang")), "grams")
    totals = sorted(counted.groupBy("lang").agg(F.sum("n").alias("total")).collect())
    languages = [r["lang"] for r in totals]
    planes = max(1, -(-len(languages) // PLANE))
    kind = next(np.dtype(f"u{n}") for n in (1, 2, 4, 8) if min(len(languages), PLANE) <= 8 * n)
    if not languages:
        return Model([], np.zeros((planes, 1 << BITS), kind))
    # One row for each language is broadcast.
    bits = docs.sparkSession.createDataFrame(
        [(r["lang"], float(r["total"]), k // PLANE, 1 << k % PLANE) for k, r in enumerate(totals)],
        "lang string, total double, plane int, bit long",
    )
    share_ = F.col("n") / F.col("total")
    typical = staged(
        counted.join(F.broadcast(bits), "lang")
        .select("gram", "lang", "plane", "bit", "n", share_.alias("share"))
        .withColumn("most", F.max("share").over(W.partitionBy("gram")))  # a row for each language at most
        .filter((F.col("share") >= TYPICAL * F.col("most")) & (F.col("n") >= LEAST))
        .select("gram", "lang", "plane", "bit", "n"),
        "typical",
    )
    sizes = {r["lang"]: r["size"] for r in typical.groupBy("lang").agg(F.count("*").alias("size")).collect()}
    most = int(log2(FILTER_BYTES // (planes * kind.itemsize)))
    size = bits_for(max(sizes.values(), default=0), most)
    kept = most_counted(typical, sizes, int((1 << size) * -log(1 - MOST_FILL) / HASHES))
    step = min(CHUNK_BITS, size)

    def placed(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = slots(batch.column("gram").to_numpy().view(np.uint64), size)
        repeated = [np.concatenate([batch.column(c).to_numpy()] * len(found)) for c in ("plane", "mask")]
        at = np.concatenate(found)
        names = ["chunk", "slot", "plane", "mask"]
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (at >> step, at & ((1 << step) - 1), *repeated)], names)

    def built(pdf: pd.DataFrame) -> pd.DataFrame:
        part = np.zeros(1 << step, np.int64)
        np.bitwise_or.at(part, pdf["slot"].to_numpy(), pdf["mask"].to_numpy())
        cells = part.view(np.uint64).astype(kind).tobytes()
        return pd.DataFrame({"chunk": pdf["chunk"].iloc[:1], "plane": pdf["plane"].iloc[:1], "cells": [cells]})

    # The filter's bytes come to the driver, ``FILTER_BYTES`` at most.
    parts = (
        map_batches(
            kept.groupBy("gram", "plane").agg(F.bit_or("bit").alias("mask")), "chunk long, slot long, plane int, mask long", placed
        )
        .groupBy("chunk", "plane")
        .applyInPandas(built, "chunk long, plane int, cells binary")
    )
    masks = np.zeros((planes, 1 << size), kind)
    for r in parts.collect():
        masks[r["plane"], r["chunk"] << step : (r["chunk"] + 1) << step] = np.frombuffer(r["cells"], kind)
    return Model(languages, masks)


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` for each row of ``docs``."""
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    docs = docs.withColumn("held_out", F.coalesce(remainder("doc_id", 4) == 2, F.lit(False)))
    shared = share(docs.sparkSession, model)
    schema = T.StructType(
        [
            docs.schema["doc_id"],
            docs.schema["held_out"],
            T.StructField("lang_pred", T.StringType()),
            T.StructField("score", T.DoubleType()),
        ]
    )

    def run(batches):
        fold = fold_table()
        for batch in batches:
            found = [shared().predict(grams(x, fold)) for x in batch.column("text").to_pylist()]
            names, scores = zip(*found, strict=True) if found else ((), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array(names, pa.string()), pa.array(scores, pa.float64())],
                schema.fieldNames(),
            )

    return docs.mapInArrow(run, schema)

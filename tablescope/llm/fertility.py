"""Tokeniser fertility: how a public vocabulary splits a document, with rejection bands per language or script.

Three measures describe the words of a document under a vocabulary with byte fallback: characters per token, the share of
byte pieces, and the entropy of its tokens (relative to the largest that so many tokens can have). Prose of one language
keeps to a narrow range of each; sign soup, code points of other scripts and repeated phrases do not.

The bands come from all documents: for each group (the language, or the script where no language is given) and measure a
histogram of fixed bins gives the quartiles, and a band reaches ``REACH`` quartile distances beyond them. Entropy falls
with repetition and depends on length, so its bands are kept for classes of length. Groups of fewer than ``MIN_GROUP``
documents take the bands of all documents together.

Defined results: null or empty texts have no words and fail the base rule; repeated rows and null ids are judged one by
one; a null language falls back to the script; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablescope.llm.common import encoded, map_batches, staged

BYTES = range(3, 259)  # ids of the byte pieces in the vocabulary
SPACE = b" \t\n\x0b\x0c\r"
SYMBOLS = b"#*$%&|<>"
WINDOW = 8
CACHE_WORDS = 300_000
BIN = 0.02
REACH = 4.0
LEAST_REACH = 0.1
MIN_GROUP = 50
MEASURES = ["chars_per_token", "byte_share", "entropy"]


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Pieces(dict):
    """Ids of a word's pieces as 16-bit numbers; words are encoded in lists and a bounded number is kept."""

    def __init__(self, path: str):
        import sentencepiece

        super().__init__()
        self.encode = sentencepiece.SentencePieceProcessor(model_file=path).encode

    def of(self, words: list[bytes]) -> np.ndarray:
        new = list({w for w in words if w not in self})
        if new:
            if len(self) > CACHE_WORDS:
                self.clear()
                new = list(set(words))
            found = self.encode([w.decode("utf-8", "replace") for w in new], num_threads=1)
            self.update((w, np.array(x, np.uint16).tobytes()) for w, x in zip(new, found, strict=True))
        return np.frombuffer(b"".join(map(self.__getitem__, words)), np.uint16)


def repeated(words: list[bytes], width: int = WINDOW) -> int:
    """Words that stand in a window of ``width`` words found at least twice, overlaps counted."""
    n = len(words) - width + 1
    if n < 2:
        return 0
    codes = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    window = np.zeros(n, np.uint64)
    factor = np.uint64(0x9E3779B97F4A7C15)
    for k in range(width):
        window = (window ^ (window >> np.uint64(29))) * factor + codes[k : k + n]
    order = np.argsort(window, kind="stable")
    same = window[order[1:]] == window[order[:-1]]
    twice = np.zeros(n, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    starts = np.flatnonzero(twice)
    edges = np.zeros(len(words) + 1, np.int32)
    np.add.at(edges, starts, 1)
    np.add.at(edges, starts + width, -1)
    return int((np.cumsum(edges) > 0).sum())


def script_of(sign: str) -> str:
    return unicodedata.name(sign, "OTHER").split(" ")[0].split("-")[0] if sign.isalpha() else ""


def script(text: str) -> str:
    """The script of most letters, by the first word of their names; ASCII letters are LATIN."""
    if text.isascii():
        return "LATIN" if any(map(str.isalpha, text)) else "NONE"
    signs, counts = np.unique(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4"), return_counts=True)
    total: dict[str, int] = {}
    for sign, count in zip(signs.tolist(), counts.tolist(), strict=True):
        name = script_of(chr(sign))
        if name:
            total[name] = total.get(name, 0) + count
    return max(sorted(total), key=total.get) if total else "NONE"


def measure(text: str | None, pieces: Pieces) -> tuple:
    """Counts of the base rule, then tokens and the three measures (null without words)."""
    data = encoded(text)
    words = data.split()
    spaces = len(data) - len(data.translate(None, SPACE))
    symbols = len(data) - len(data.translate(None, SYMBOLS))
    lines = [x for x in data.split(b"\n") if x.strip()]
    counts = (len(words), len(text or "") - spaces, symbols, len(lines) - len(set(lines)), repeated(words))
    if not words:
        return (*counts, 0, None, None, None)
    ids = pieces.of(words)
    seen = np.bincount(ids)
    share = seen[seen > 0] / len(ids)
    entropy = float(-(share * np.log2(share)).sum() / np.log2(max(len(ids), 2)))
    bytes_ = int(seen[BYTES.start : BYTES.stop].sum())
    return (*counts, len(ids), counts[1] / len(ids), bytes_ / len(ids), entropy)


def measured(docs: DataFrame, vocabulary: str, id_col: str, text_col: str, lang_col: str | None) -> DataFrame:
    lang = F.col(lang_col).cast("string") if lang_col else F.lit(None).cast("string")
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), lang.alias("lang"))
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_tokens"]
    schema = T.StructType(
        [docs.schema["doc_id"], T.StructField("band", T.StringType())]
        + [T.StructField(c, T.LongType()) for c in counts]
        + [T.StructField(c, T.DoubleType()) for c in MEASURES]
    )

    def run(batches):
        pieces = Pieces(vocabulary)
        for batch in batches:
            texts = batch.column("text").to_pylist()
            band = [
                lang if lang is not None else f"script:{script(text or '')}"
                for lang, text in zip(batch.column("lang").to_pylist(), texts, strict=True)
            ]
            found = list(zip(*[measure(x, pieces) for x in texts], strict=True)) or [()] * 9
            arrays = [batch.column("doc_id"), pa.array(band, pa.string())]
            arrays += [pa.array(x, pa.int64()) for x in found[:6]] + [pa.array(x, pa.float64()) for x in found[6:]]
            yield pa.RecordBatch.from_arrays(arrays, schema.fieldNames())

    return docs.mapInArrow(run, schema)


def length_class(n_tokens: Column) -> Column:
    """Doublings of the number of tokens."""
    return F.floor(F.log2(F.greatest(n_tokens, F.lit(1)))).cast("int")


def bands(found: DataFrame) -> DataFrame:
    """``measure, band, size, low, high``: from histograms of all documents that pass the base rule.

    ``band`` null stands for all groups, ``size`` is null but for the entropy.
    """
    cells = found.select(
        "band",
        length_class(F.col("n_tokens")).alias("size"),
        F.explode(
            F.array(
                *[
                    F.struct(F.lit(m).alias("measure"), F.floor(F.col(m) / BIN).cast("int").alias("bin"))
                    for m in MEASURES
                ]
            )
        ).alias("c"),
    ).select(
        "band", "c.*", F.when(F.col("c.measure") == "entropy", F.col("size")).alias("size")
    )
    counted = staged(cells.groupBy("measure", "band", "size", "bin").agg(F.count("*").alias("n")), "bands")
    counted = counted.unionByName(
        counted.groupBy("measure", "size", "bin").agg(F.sum("n").alias("n")).withColumn("band", F.lit(None).cast("string"))
    )
    # Windows run over bins, whose number is fixed for each group.
    group = W.partitionBy("measure", "band", "size")
    ranked = counted.select(
        "*",
        F.sum("n").over(group).alias("total"),
        F.sum("n").over(group.orderBy("bin").rowsBetween(W.unboundedPreceding, W.currentRow)).alias("upto"),
    )

    def quartile(share: float) -> Column:
        return F.min(F.when(F.col("upto") >= share * F.col("total"), (F.col("bin") + 0.5) * BIN))

    quartiles = ranked.groupBy("measure", "band", "size", "total").agg(
        quartile(0.25).alias("q1"), quartile(0.75).alias("q3")
    )
    reach = REACH * F.greatest(F.col("q3") - F.col("q1"), F.lit(LEAST_REACH / REACH))
    return quartiles.filter((F.col("total") >= MIN_GROUP) | F.col("band").isNull()).select(
        "measure", "band", "size", (F.col("q1") - reach).alias("low"), (F.col("q3") + reach).alias("high")
    )


def fertility(
    docs: DataFrame,
    vocabulary: str | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str | None = "lang",
) -> DataFrame:
    """Counts, verdicts and measures for each row of ``docs``."""
    found = staged(measured(docs, vocabulary or default_vocabulary(), id_col, text_col, lang_col), "fertility")
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    found = found.withColumn("base_failed", failed).withColumn("size", length_class(F.col("n_tokens")))
    limits = staged(bands(found.filter(~failed)), "limits")
    # The common bands are a fixed number of rows: one for each measure and class of length.
    common = {(r["measure"], r["size"]): r for r in limits.filter(F.col("band").isNull()).collect()}
    own = limits.filter(F.col("band").isNotNull())
    inside = F.lit(True)
    for m in MEASURES:
        keys = ["band", "size"] if m == "entropy" else ["band"]
        found = found.join(
            own.filter(F.col("measure") == m).select(*keys, F.col("low").alias(f"{m}_low"), F.col("high").alias(f"{m}_high")),
            keys,
            "left",
        )
        for side in ("low", "high"):
            shared = F.coalesce(
                *[
                    F.when(F.col("size").eqNullSafe(size) if size is not None else F.lit(True), F.lit(r[side]))
                    for (measure, size), r in common.items()
                    if measure == m
                ],
                F.lit(None).cast("double"),
            )
            found = found.withColumn(f"{m}_{side}", F.coalesce(f"{m}_{side}", shared))
        inside = inside & F.coalesce(F.col(m).between(F.col(f"{m}_low"), F.col(f"{m}_high")), F.lit(True))
    return found.select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        (~F.col("base_failed") & inside).alias("kept"),
        "band",
        "n_tokens",
        *MEASURES,
    )

"""Token counts by section: every document is encoded once, its tokens are joined with the sections they lie in.

A section is a paragraph (text between line ends) or starts where the caller says. Tokens and sections are intervals of
the document's UTF-8 bytes, both in order, so the interval join is one binary search of the token ends and starts in the
section bounds. A token that crosses a boundary is allocated by a rule: ``first`` gives it to the section of its first
byte, ``largest`` to the section with most of its bytes (the earlier one of equals), ``split`` shares it by bytes. Bytes
between sections (line ends) belong to the section before them. All rules keep the sum: the sections' tokens add up to
the document's.

Defined results: a null or empty text is one empty section without tokens; repeated rows and null ids are counted one by
one; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import base64

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablescope.llm.common import encoded, map_batches

RULES = ("first", "largest", "split")


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


class Encoder:
    """Token ids of a text and the length in bytes of every token."""

    def __init__(self, path: str):
        import public_tokenizers
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.encoding = tiktoken.Encoding(
            "public", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}
        )
        self.sizes = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, number in ranks.items():
            self.sizes[number] = len(token)

    def ends(self, text: str) -> np.ndarray:
        """The byte at which each token ends."""
        return np.cumsum(self.sizes[self.encoding.encode_to_numpy(text, disallowed_special=())])


def paragraphs(data: bytes) -> np.ndarray:
    """Bounds of the text between line ends: starts of all sections, then the end of the text."""
    marks = np.flatnonzero(np.frombuffer(data, np.uint8) == 10) + 1
    return np.concatenate([[0], marks[marks < len(data)], [len(data)]])


def allocate(ends: np.ndarray, bounds: np.ndarray, rule: str) -> np.ndarray:
    """Tokens of each section (the spans between ``bounds``); ``split`` gives fractions."""
    n = len(bounds) - 1
    if not len(ends):
        return np.zeros(n)
    starts = np.concatenate([[0], ends[:-1]])
    first = np.searchsorted(bounds, starts, "right") - 1
    last = np.searchsorted(bounds, ends, "left") - 1
    if rule == "first":
        return np.bincount(first, minlength=n).astype(float)
    inside = first == last
    counts = np.bincount(first[inside], minlength=n).astype(float)
    for token in np.flatnonzero(~inside):
        a, b = first[token], last[token]
        cuts = np.clip(bounds[a : b + 2], starts[token], ends[token])
        share = np.diff(cuts) / (ends[token] - starts[token])
        if rule == "largest":
            counts[a + int(share.argmax())] += 1
        else:
            counts[a : b + 1] += share
    return counts


def named(data: bytes, starts: list[int] | None) -> np.ndarray:
    """Bounds of sections that start at the given code points; a start beyond the text is left out."""
    places = np.flatnonzero((np.frombuffer(data, np.uint8) & 0xC0) != 0x80)
    inner = sorted({int(places[k]) for k in starts or () if k is not None and 0 < k < len(places)})
    return np.array([0, *inner, len(data)])


def attribute(
    docs: DataFrame,
    rule: str = "largest",
    vocabulary: str | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    starts_col: str | None = None,
) -> DataFrame:
    """For each row of ``docs``: its tokens, and those of each section with the section's place in code points.

    ``starts_col`` names an array of code points at which sections start; without it sections are paragraphs.
    """
    if rule not in RULES:
        raise ValueError(f"rule is one of {RULES}")
    path = vocabulary or default_vocabulary()
    starts = F.col(starts_col).cast("array<int>") if starts_col else F.lit(None).cast("array<int>")
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), starts.alias("starts"))
    section = T.StructType(
        [T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("tokens", T.DoubleType())]
    )
    schema = T.StructType(
        [
            docs.schema["doc_id"],
            T.StructField("n_tokens", T.LongType()),
            T.StructField("n_sections", T.LongType()),
            T.StructField("n_crossing", T.LongType()),
            T.StructField("sections", T.ArrayType(section)),
        ]
    )

    def run(batches):
        encoder = Encoder(path)
        for batch in batches:
            totals, crossings, sections = [], [], []
            for text, starts in zip(batch.column("text").to_pylist(), batch.column("starts").to_pylist(), strict=True):
                data = encoded(text)
                ends, bounds = encoder.ends(text or ""), named(data, starts) if starts_col else paragraphs(data)
                counts = allocate(ends, bounds, rule)
                # A bound that no token ends at is crossed by one.
                inner = bounds[1:-1]
                crossings.append(len(inner) - int(np.isin(inner, ends).sum()))
                signs = np.cumsum((np.frombuffer(data, np.uint8) & 0xC0) != 0x80)
                places = np.concatenate([[0], signs])[bounds].tolist()
                totals.append(len(ends))
                sections.append(
                    [{"start": a, "end": b, "tokens": c} for a, b, c in zip(places, places[1:], counts.tolist(), strict=False)]
                )
            kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("tokens", pa.float64())]))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array(totals, pa.int64()),
                    pa.array([len(x) for x in sections], pa.int64()),
                    pa.array(crossings, pa.int64()),
                    pa.array(sections, kind),
                ],
                schema.fieldNames(),
            )

    return docs.mapInArrow(run, schema)

"""Order-preserving packing of documents into token sequences by dynamic programming.

A task reads its documents in table order as one stream of tokens and cuts it into windows of at most ``limit`` tokens.
``cost[i] = min over j of cost[j] + padding(i - j) + penalty(i) + WINDOW_COST``, where the candidates ``i`` are ends of documents (no
penalty), ends of sentences, and every ``STRIDE``-th token of a sentence too long for a window. Padding fills a window
up to ``limit``; windows whose length is a power of two, from ``SHORTEST_POWER``, need none. Within reach of ``i``, ``limit - i`` is the same for
all ``j``, so the best ``j`` has the smallest ``cost[j] + j``: a monotone queue hands it over in constant time. The
powers of two are a few direct look-ups.

The stream is solved in blocks of documents; the last window of a block goes back into the next one. Nothing is
shuffled, and a task holds one block. Windows never span two tasks, and a sequence id joins the task's number with a
running number, so that a task run again gives the same rows.

Defined results: a null or empty text is its end token alone; repeated rows and ids are packed one by one, null ids
stay null; an empty table gives no pieces; other columns are ignored.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from array import array
from bisect import bisect_left
from collections import deque
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

LIMIT = 4096
END_TOKEN = 2
BLOCK_TOKENS = 1 << 19
SENTENCE_PENALTY = 8.0
TOKEN_PENALTY = 64.0
STRIDE = 64
CACHE_WORDS = 400_000
WINDOW_COST = 64.0
SHORTEST_POWER = 256


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class Words(dict):
    """Ids of single words, found on first use; holds a bounded number of words."""

    def __init__(self, model):
        super().__init__({" ": b"", "\n": b"", "\r": b""})
        self.tokenize = model.tokenize
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [c for c in range(256) if c not in set(shown)]
        self.signs = {c: chr(256 + k) for k, c in enumerate(hidden)}

    def __missing__(self, word: str) -> bytes:
        # The model reads bytes as signs: visible ones as themselves, all others from 256 up.
        signs = word if word.isascii() else word.encode().decode("latin-1").translate(self.signs)
        found = array("I", [x.id for x in self.tokenize(signs)]).tobytes()
        if len(self) >= CACHE_WORDS:
            self.clear()
            self.update({" ": b"", "\n": b"", "\r": b""})
        self[word] = found
        return found


class WordEncoder:
    """Token ids of whole texts, equal to the tokenizer's own, with the ids of words kept.

    The tokenizer splits texts at white space and between letters, digits and other signs before it merges. For texts
    of characters that its normal form leaves alone (but for capitals), the words are found here and each goes to its
    model once. All other texts go to the tokenizer as a whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        plain = [chr(c) for c in [*range(0x20, 0x7F), *range(0xA1, 0x130), *range(0x131, 0x180), *range(0x2010, 0x2028)]]
        letters = "".join(c for c in plain if unicodedata.category(c)[0] == "L")
        numbers = "".join(c for c in plain if unicodedata.category(c)[0] == "N")
        self.other = re.compile(f"[^\\t\\n\\r{re.escape(''.join(plain))}]|<\\|")
        # White space behind a closing sign and line ends stay, as marks of sentence ends without ids.
        self.pieces = re.compile(
            f"[{letters}]+|(?<=[.!?]) |[\\r\\n]|[{numbers}]|'(?:s|t|re|ve|m|ll|d)|[^ \\t\\n\\r{letters}{numbers}]+"
        ).findall
        self.words = Words(self.tokenizer.model)

    def encode(self, text: str) -> tuple[bytes, list[int]]:
        """Ids as little-endian 32-bit numbers, and the numbers of tokens up to each sentence end."""
        if self.other.search(text):
            found = self.tokenizer.encode(text, add_special_tokens=False)
            starts = [a for a, _ in found.offsets]
            return array("I", found.ids).tobytes(), [bisect_left(starts, m.start()) for m in ENDS.finditer(text)]
        pieces = self.pieces(text.lower())
        parts = list(map(self.words.__getitem__, pieces))
        at = list(accumulate(map(len, parts)))
        return b"".join(parts), [n // 4 for n, w in zip(at, pieces, strict=True) if w in SENTENCE_ENDS]


SENTENCE_ENDS = frozenset(" \r\n")
# The same marks in any text: line ends, white space behind a closing sign, and the place behind signs that no space follows.
STOPS = "\u3002\uff01\uff1f\uff61\uff0e"
CLOSING = "!?.\u2026\u037e\u0589\u061f\u06d4\u0964\u0965\u104a\u104b\u1362\u1367\u17d4\u203c\u203d\u2047-\u2049"
BEHIND = "\u300d\u300f\u3011\u300b\uff09\u201d\u2019"
ENDS = re.compile(f"[\\r\\n\\x85\u2028\u2029]|(?<=[{CLOSING}])\\s|(?<=[{STOPS}])(?![{STOPS}{BEHIND}])|(?<=[{STOPS}][{BEHIND}])(?![{BEHIND}])")


def candidates(doc_ends: list[list[int]], sizes: list[int], limit: int) -> tuple[list[int], list[float]]:
    """Positions in the stream where a window may end, and their penalties."""
    places, penalties, base = [], [], 0
    for ends, size in zip(doc_ends, sizes, strict=True):
        last = 0
        for end in [*ends, size]:
            if end - last > limit:
                for k in range(last + STRIDE, end, STRIDE):
                    places.append(base + k)
                    penalties.append(TOKEN_PENALTY)
            if last < end < size:
                places.append(base + end)
                penalties.append(SENTENCE_PENALTY)
            last = max(last, end)
        base += size
        places.append(base)
        penalties.append(0.0)
    return places, penalties


def cut(places: list[int], penalties: list[float], limit: int) -> list[int]:
    """The window ends of least cost; the last place is always one."""
    cost = {0: 0.0}
    back: dict[int, int] = {}
    queue = deque([(0.0, 0)])
    powers = [1 << k for k in range(limit.bit_length()) if SHORTEST_POWER <= 1 << k <= limit]
    known = cost.get
    for place, penalty in zip(places, penalties, strict=True):
        low = place - limit
        while queue[0][1] < low:
            queue.popleft()
        value, start = queue[0]
        best = value + limit - place
        for power in powers:
            before = known(place - power)
            if before is not None and before <= best:
                best, start = before, place - power
        best += penalty + WINDOW_COST
        cost[place] = best
        back[place] = start
        value = best + place
        while queue and queue[-1][0] >= value:
            queue.pop()
        queue.append((value, place))
    ends, place = [], places[-1]
    while place:
        ends.append(place)
        place = back[place]
    return ends[::-1]


class Packer:
    """Turns a stream of documents into pieces, block by block."""

    def __init__(self, limit: int, task: int):
        self.limit = limit
        self.next = task << 40
        self.held: list[tuple] = []  # id, row's whole size, start of what is left, ids left, its sentence ends

    def add(self, doc_id, ids: bytes, ends: list[int]) -> None:
        self.held.append((doc_id, len(ids) // 4, 0, ids, ends))

    def flush(self, last: bool) -> Iterator[tuple]:
        """Pieces of the block's windows; all but the last window unless the stream is over."""
        if not self.held:
            return
        sizes = [len(x[3]) // 4 for x in self.held]
        ends = cut(*candidates([x[4] for x in self.held], sizes, self.limit), self.limit)
        if not last:
            ends.pop()
        held, at, begin = iter(self.held), 0, 0
        doc = next(held)
        taken = 0
        for end in ends:
            while at < end:
                doc_id, total, start, ids, _ = doc
                size = min(len(ids) // 4 - taken, end - at)
                part = ids[4 * taken : 4 * (taken + size)]
                yield doc_id, start + taken, size, zlib.crc32(part), total, self.next, at - begin
                taken += size
                at += size
                if 4 * taken == len(ids):
                    doc, taken = next(held, None), 0
            begin = end
            self.next += 1
        rest = []
        if doc:
            doc_id, total, start, ids, doc_ends = doc
            rest = [(doc_id, total, start + taken, ids[4 * taken :], [e - taken for e in doc_ends if e > taken])]
        self.held = rest + list(held)


def pack(
    docs: DataFrame,
    limit: int = LIMIT,
    end_token: int = END_TOKEN,
    vocabulary: str | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    block_tokens: int = BLOCK_TOKENS,
) -> DataFrame:
    """Pieces of all documents, each with its place in a sequence; ``vocabulary`` names the tokenizer's file."""
    path = vocabulary or default_vocabulary()
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    names = ["start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    schema = T.StructType([docs.schema["doc_id"]] + [T.StructField(c, T.LongType(), False) for c in names])
    end = np.array([end_token], "<u4").tobytes()

    def run(batches):
        encoder = WordEncoder(path)
        packer = Packer(limit, TaskContext.get().partitionId())
        tokens, kind = 0, None

        def rows(pieces) -> Iterator[pa.RecordBatch]:
            pieces = list(pieces)
            if pieces:
                first, *rest = zip(*pieces, strict=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(first, kind), *[pa.array(x, pa.int64()) for x in rest]], schema.fieldNames()
                )

        for batch in batches:
            kind = batch.column("doc_id").type
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                ids, ends = encoder.encode(text or "")
                packer.add(doc_id, ids + end, ends)
                tokens += len(ids) // 4 + 1
                if tokens >= block_tokens:
                    yield from rows(packer.flush(False))
                    tokens = 0
        yield from rows(packer.flush(True))

    return docs.mapInArrow(run, schema)

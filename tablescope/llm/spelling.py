"""Spelling variants by finite-state composition: acceptor, one-edit transducer, acceptor.

The words of the corpus are counted, and each word's near words (one inserted, deleted or replaced code point) come from
composing the minimised acceptor of the vocabulary with a one-edit transducer and with the acceptor again. The composition
is cut by the state in which it starts to be interesting: two near words differ either behind their first half, and then
both lead the acceptor of the forward readings to the same state after that half, or within it, and then both lead the
acceptor of the backward readings to the same state after the other half. So a partition is a length and a half word; a
task minimises the acceptor of what may follow, composes and enumerates the accepted pairs. Each pair is accepted in one
partition only. Partitions with very many words are cut into blocks, and each pair of blocks is composed by itself.

A word's form is its most frequent near word if that is at least twice as frequent as the word; roots follow forms by
pointer doubling, with as many rounds as the longest chain has binary digits.

Defined results: a null or empty text has no words; a null id counts as an empty text in the checksum; repeated rows count as often as they
stand there; equal counts are ordered by code points; a table without words gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablescope.llm.common import encoded, map_batches, staged

RUN = re.compile("[A-Za-zÀ-ÿ]+")
DROP = 97
MIN_LENGTH = 5
MIN_COUNT = 3
TIMES = 2
BLOCK = 20_000  # words of a partition that are composed at once

State = tuple[bool, tuple[tuple[str, int], ...]]


def words_of(doc_id: object, text: str | None) -> Counter[str]:
    """Words of a text with their counts; one code point is deleted where the checksum says so."""
    found: Counter[str] = Counter()
    start = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
    for run, count in Counter(RUN.findall(encoded(text).lower().decode("utf-8", "replace"))).items():
        h = zlib.crc32(run.encode(), start)
        if h % DROP == 0:
            at = h % len(run)
            run = run[:at] + run[at + 1 :]
        if len(run) >= MIN_LENGTH:
            found[run] += count
    return found


def vocabulary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``word, n``: every word with its occurrences in all texts; counts leave a task once per batch."""
    docs = docs.select(F.col(id_col).cast("string").alias("doc_id"), F.col(text_col).alias("text"))

    def count(batch: pa.RecordBatch) -> pa.RecordBatch:
        found: Counter[str] = Counter()
        for key, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
            found.update(words_of(key, text))
        return pa.RecordBatch.from_arrays(
            [pa.array(found.keys(), pa.string()), pa.array(found.values(), pa.int64())], ["word", "n"]
        )

    counts = map_batches(docs, "word string, n long", count)
    return counts.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= MIN_COUNT)


class Acceptor:
    """The minimised acyclic acceptor of a list of words; equal states are one."""

    def __init__(self, words: list[str]):
        self.states: list[State] = []
        self.known: dict[State, int] = {}
        self.start = self._state(sorted(set(words)))

    def _state(self, words: list[str]) -> int:
        # Words of the state in order, with the number of characters read; a stack, since words may be very long.
        done: list[list[tuple[str, int]]] = [[]]
        final = [False]
        last = ""
        for word in [*words, None]:
            shared = 0
            if word is not None:
                while shared < min(len(last), len(word)) and last[shared] == word[shared]:
                    shared += 1
            for depth in range(len(last), shared, -1):
                done[depth - 1].append((last[depth - 1], self._known(final.pop(), tuple(done.pop()))))
            if word is None:
                break
            for _ in range(len(word) - shared):
                done.append([])
                final.append(False)
            final[-1] = True
            last = word
        return self._known(final[0], tuple(done[0]))

    def _known(self, final: bool, edges: tuple[tuple[str, int], ...]) -> int:
        state = (final, edges)
        number = self.known.setdefault(state, len(self.states))
        if number == len(self.states):
            self.states.append(state)
        return number


def agreed(left: Acceptor, p: int, right: Acceptor, q: int) -> Iterator[str]:
    """Words that ``left`` accepts from ``p`` and ``right`` from ``q``: the composition once the edit is made."""
    stack = [(p, q, "")]
    while stack:
        p, q, read = stack.pop()
        (end, edges), (other_end, others) = left.states[p], right.states[q]
        if end and other_end:
            yield read
        if edges and others:
            to = dict(others)
            stack += [(s, to[c], read + c) for c, s in edges if c in to]


def one_edit(left: Acceptor, right: Acceptor) -> Iterator[tuple[str, str]]:
    """Pairs of a word of ``left`` and a word of ``right`` at one edit, each once.

    The transducer reads equal symbols, makes one edit where the words first differ, and reads equal symbols again. The
    edit replaces a symbol, drops the symbol of the left word, or adds that of the right word; what follows the latter two
    must not start with the symbol itself, since the words would first differ later.
    """
    stack = [(left.start, right.start, "")]
    while stack:
        p, q, read = stack.pop()
        edges, others = left.states[p][1], right.states[q][1]
        to = dict(others)
        for c, s in edges:
            if c in to:
                stack.append((s, to[c], read + c))
            for rest in agreed(left, s, right, q):
                if not rest.startswith(c):
                    yield read + c + rest, read + rest
            for other, t in others:
                if other != c:
                    for rest in agreed(left, s, right, t):
                        yield read + c + rest, read + other + rest
        for c, t in others:
            for rest in agreed(left, p, right, t):
                if not rest.startswith(c):
                    yield read + rest, read + c + rest


def first_difference(a: str, b: str) -> int:
    at = 0
    while at < min(len(a), len(b)) and a[at] == b[at]:
        at += 1
    return at


def near_pairs(words: list[str], others: list[str], length: int, forward: bool) -> Iterator[tuple[str, str]]:
    """Near words of two blocks of a partition whose shorter word has ``length`` code points."""
    half = length // 2
    if forward:
        cut, left, right = words[0][:half] if words else "", [w[half:] for w in words], [w[half:] for w in others]
        pairs = ((cut + a, cut + b) for a, b in one_edit(Acceptor(left), Acceptor(right)))
    else:
        back = length - half
        cut = words[0][len(words[0]) - back :] if words else ""
        left, right = ([w[: len(w) - back][::-1] for w in side] for side in (words, others))
        pairs = ((a[::-1] + cut, b[::-1] + cut) for a, b in one_edit(Acceptor(left), Acceptor(right)))
    for a, b in pairs:
        if min(len(a), len(b)) == length and (first_difference(a, b) >= half) == forward:
            yield a, b


def neighbours(words: DataFrame, block: int = BLOCK) -> DataFrame:
    """``word, n_near, form, form_n`` for every word with a near word; ``words`` holds ``word, n``.

    Within a partition each word meets the others in one composition, so what leaves a task is one row for each word.
    """
    size = F.length("word")
    # A word is the shorter or an equal one of a pair in the partitions of its length, the longer one in those below.
    lengths = F.when(size > MIN_LENGTH, F.array(size, size - 1)).otherwise(F.array(size))
    parts = words.select("word", "n", F.explode(lengths).alias("length")).select(
        "*", F.explode(F.array(F.lit(True), F.lit(False))).alias("forward")
    )
    half = F.floor(F.col("length") / 2).cast("int")
    back = F.col("length") - half
    parts = parts.withColumn(
        "half",
        F.when(F.col("forward"), F.substring("word", F.lit(1), half)).otherwise(F.substring("word", size - back + 1, back)),
    )
    key = ["length", "forward", "half"]
    # A partition of many words is cut into blocks; the cells are the pairs of them.
    large = parts.groupBy(*key).agg(F.count("*").alias("words")).filter(F.col("words") > block)
    large = large.select(*key, F.ceil(F.col("words") / block).cast("int").alias("blocks"))
    own = F.pmod(F.xxhash64(F.lit(7), "word"), F.col("blocks")).cast("int")
    cells = F.transform(
        F.sequence(F.lit(0), F.col("blocks") - 1),
        lambda k: F.struct(F.least(F.col("own"), k).alias("i"), F.greatest(F.col("own"), k).alias("j")),
    )
    cut = (
        parts.join(large, key)
        .withColumn("own", own)
        .select(*key, "word", "n", "own", F.explode(cells).alias("c"))
        .select(*key, "c.i", "c.j", "own", "word", "n")
    )
    whole = parts.join(large, key, "left_anti").select(
        *key, F.lit(0).alias("i"), F.lit(0).alias("j"), F.lit(0).alias("own"), "word", "n"
    )

    def compose(table: pa.Table) -> pa.Table:
        length, forward, i, j = (table.column(c)[0].as_py() for c in ("length", "forward", "i", "j"))
        words, counts = table.column("word").to_pylist(), table.column("n").to_pylist()
        n = dict(zip(words, counts, strict=True))
        found: dict[str, list] = {}

        def near(a: str, b: str) -> None:
            row = found.setdefault(a, [0, (0, "")])
            row[0] += 1
            row[1] = min(row[1], (-n[b], b))

        if len(words) > 1:
            owner = table.column("own").to_pylist()
            left = [w for w, o in zip(words, owner, strict=True) if o == i]
            right = left if i == j else [w for w, o in zip(words, owner, strict=True) if o == j]
            for a, b in near_pairs(left, right, length, forward) if left and right else ():
                near(a, b)
                if i != j:
                    near(b, a)
        return pa.table(
            {
                "word": pa.array(found.keys(), pa.string()),
                "n_near": pa.array([x[0] for x in found.values()], pa.int64()),
                "form_n": pa.array([-x[1][0] for x in found.values()], pa.int64()),
                "form": pa.array([x[1][1] for x in found.values()], pa.string()),
            }
        )

    found = whole.union(cut).groupBy(*key, "i", "j").applyInArrow(compose, "word string, n_near long, form_n long, form string")
    best = F.min(F.struct((-F.col("form_n")).alias("less"), "form")).alias("best")
    return (
        found.groupBy("word")
        .agg(F.sum("n_near").alias("n_near"), best)
        .select("word", "n_near", F.col("best.form").alias("form"), (-F.col("best.less")).alias("form_n"))
    )


def roots(forms: DataFrame) -> DataFrame:
    """``word, root``: the last form of each word that has one; ``forms`` holds ``word, form``.

    Each round doubles the steps that a row has behind it. Forms are at least twice as frequent as their words, so a chain
    is no longer than the counts have binary digits, and there are few rounds.
    """
    found = staged(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        onward = found.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = staged(
            found.join(onward, "root", "left").select(
                "word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")
            ),
            "roots",
        )
        found = moved.select("word", "root")
        if moved.filter("moved").isEmpty():
            return found


def variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` for every word of the vocabulary."""
    words = staged(vocabulary(docs, id_col, text_col), "words")
    near = staged(words.join(neighbours(words, block), "word", "left"), "near")
    is_form = F.col("form_n") >= TIMES * F.col("n")
    judged = near.select(
        "word",
        "n",
        F.coalesce("n_near", F.lit(0)).alias("n_near"),
        F.when(is_form, F.col("form")).alias("form"),
        F.when(is_form, F.col("form_n")).alias("form_n"),
    )
    rooted = roots(judged.filter(F.col("form").isNotNull()))
    return judged.join(rooted, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )

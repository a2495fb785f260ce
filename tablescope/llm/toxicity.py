"""Toxicity by a weighted finite-state grammar over clauses.

Words are classed by lexicons: threats, targets, negations and verbs of reported speech are fixed lists, insults are learned
from labelled documents with their weights (log odds), as words and as stems that several words share. Five weighted
transducers are transition tables over these classes: insult and threat mark at most one word each as the one that is scored,
target accepts a clause with one marked word and weighs it by whether a target stands before or behind it, negation
weighs a mark in its reach, reported speech one in its clause. :func:`compose` makes one automaton of them; a clause's
output is the sum over its paths, so each insult or threat counts once. A threat without a target has no path. A document's
score is a logistic function of what its matched clauses put out.

An insult must stand in many different places of toxic documents (counted as distinct neighbours) and be rare in other
ones, so that the words of one text copied many times don't count as insults.

The model is fitted on at most ``SAMPLE`` labelled rows, those with the smallest hash of their id, and holds every word of
theirs that is telling enough. Everything else sees all rows and whole texts.

Defined results: a null or empty text scores like any text without a match; rows with a null id are not held out and
are not learned from; of several labels for an id the largest counts; without labelled rows of both kinds every score
is 0; repeated rows are scored one by one; other columns are ignored (``drop_toxic`` hands them on).
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Hashable, Iterable
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablescope.llm.common import map_batches, remainder, share, staged

SAMPLE = 20_000
MIN_PLACES = 6
MIN_ODDS = 1.8
STEMS = range(4, 9)
MIN_STEM_ODDS = 2.5
MIN_STEM_WORDS = 4
CACHE_WORDS = 200_000
THRESHOLD = 0.5

# Words of the four classes that are not learned, in English, German, French and Spanish.
THREATS = """
kill kills killed killing murder hurt hurts harm beat beats beating destroy destroys crush stab stabs shoot shoots burn burns
strangle punch smash hang hunt slaughter töten töte tötet umbringen bringe schlagen schlage schlägt verletzen verletze erschießen
erstechen vernichten verbrennen tuer tue tuerai tuerais frapper frappe frapperai brûler brûlerai détruire détruirai blesser
étrangler massacrer matar mato mataré mataremos golpear golpearé quemar quemaré destruir destruiré herir apuñalar estrangular
""".split()
TARGETS = """
you your yours yourself yourselves u ya du dich dir dein deine deinen deinem deiner deines ihr euch euer eure tu te toi ton ta
tes vous votre vos usted ustedes tú ti tus vosotros vuestro
""".split()
NEGATIONS = """
not no never nobody none neither nor without cannot isn't aren't wasn't weren't don't doesn't didn't won't wouldn't can't couldn't
shouldn't nicht kein keine keinen keinem keiner keines nie niemals niemand ohne ne pas jamais aucun aucune sans nunca jamás tampoco
ningún ninguna nadie sin
""".split()
REPORTS = """
said says say saying wrote writes claims claimed quoted quotes quoting reported reports stated states called calls alleged
according sagte sagt sagten schrieb schreibt behauptet behauptete berichtet berichtete zitiert laut dit disait écrit écrivait
déclare déclaré affirme affirmait selon dijo dice decía escribió escribe afirma afirmó declaró según
""".split()

CLAUSE = re.compile(r"[.!?;:|\n\r]+")
WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)?").findall


# Symbols of the tapes: classes of words, any other word, and words marked to be scored.
INSULT, THREAT, TARGET, NEGATION, REPORT, OTHER = "insult", "threat", "target", "negation", "report", "other"
INSULT_MARK, THREAT_MARK = "insult!", "threat!"
SYMBOLS = (INSULT, THREAT, TARGET, NEGATION, REPORT, OTHER, INSULT_MARK, THREAT_MARK)


class Classes(dict):
    """Class and weight of a word, None for most; found on first use, a bounded number is kept."""

    def __init__(self, insults: dict[str, float], stems: dict[str, float]):
        super().__init__()
        self.insults, self.stems = insults, stems
        self.fixed = {}
        for kind, words in ((THREAT, THREATS), (TARGET, TARGETS), (NEGATION, NEGATIONS), (REPORT, REPORTS)):
            self.fixed |= dict.fromkeys(words, (kind, 1.0))

    def __missing__(self, word: str) -> tuple[str, float] | None:
        if len(self) >= CACHE_WORDS:
            self.clear()
        found = self.fixed.get(word)
        if found is None:
            stem = next((word[:k] for k in reversed(STEMS) if word[:k] in self.stems), None)
            weight = self.insults.get(word, self.stems.get(stem))
            found = (INSULT, weight) if weight else None
        self[word] = found
        return found


@dataclass(frozen=True)
class Transducer:
    """Arcs ``(state, symbol) -> [(next state, written symbol, weight)]``, a start, and a weight for each final state.

    A symbol without an arc of a state has none for it; the weight of a path is the product along it.
    """

    start: Hashable
    arcs: dict[tuple[Hashable, str], list[tuple[Hashable, str, float]]]
    final: dict[Hashable, float]

    def paths(self, symbols: Iterable[str]) -> list[tuple[list[str], float]]:
        """What is written on each path over ``symbols``, with its weight."""
        found = [(self.start, [], 1.0)]
        for symbol in symbols:
            found = [
                (after, [*written, out], weight * more)
                for state, written, weight in found
                for after, out, more in self.arcs.get((state, symbol), [])
            ]
        return [(written, weight * self.final[state]) for state, written, weight in found if state in self.final]


def compose(first: Transducer, second: Transducer) -> Transducer:
    """One transducer that writes what ``second`` writes on reading what ``first`` writes; only states that are reached."""
    start = (first.start, second.start)
    by_state: dict = {}
    for (state, symbol), found in first.arcs.items():
        by_state.setdefault(state, []).append((symbol, found))
    arcs: dict = {}
    todo, seen = [start], {start}
    while todo:
        state = left, right = todo.pop()
        for symbol, found in by_state.get(left, ()):
            for next_left, middle, weight in found:
                for next_right, out, more in second.arcs.get((right, middle), ()):
                    after = (next_left, next_right)
                    arcs.setdefault((state, symbol), []).append((after, out, weight * more))
                    if after not in seen:
                        seen.add(after)
                        todo.append(after)
    final = {s: first.final[s[0]] * second.final[s[1]] for s in seen if s[0] in first.final and s[1] in second.final}
    return Transducer(start, arcs, final)


def copying(states: Iterable[Hashable], symbols: Iterable[str]) -> dict:
    """Arcs that stay in their state and write what they read."""
    return {(state, symbol): [(state, symbol, 1.0)] for state in states for symbol in symbols}


def marker(symbol: str, mark: str) -> Transducer:
    """Writes each ``symbol`` either as any other word or, once, as ``mark``."""
    arcs = copying((0, 1), SYMBOLS)
    arcs[0, symbol] = [(0, OTHER, 1.0), (1, mark, 1.0)]
    arcs[1, symbol] = [(1, OTHER, 1.0)]
    return Transducer(0, arcs, {0: 1.0, 1: 1.0})


def target_transducer(strength: float, threat: float) -> Transducer:
    """Accepts one marked word; a target anywhere in the clause strengthens an insult and is needed by a threat."""
    marks = (None, INSULT_MARK, THREAT_MARK)
    states = [(mark, near) for mark in marks for near in (False, True)]
    arcs = copying(states, set(SYMBOLS) - {INSULT_MARK, THREAT_MARK})
    arcs |= {(state, TARGET): [((state[0], True), OTHER, 1.0)] for state in states}
    arcs |= {((None, near), m): [((m, near), m, 1.0)] for near in (False, True) for m in marks[1:]}
    final = {
        (INSULT_MARK, False): 1.0,
        (INSULT_MARK, True): 1 + strength,
        (THREAT_MARK, True): threat * (1 + strength),
    }
    return Transducer((None, False), arcs, final)


def negation_transducer(factor: float, reach: int) -> Transducer:
    """Weighs a mark within ``reach`` words behind a negation; the state counts the words that it still holds for."""
    arcs = {}
    for left in range(reach + 1):
        arcs |= {(left, s): [(max(0, left - 1), s, 1.0)] for s in SYMBOLS}
        arcs |= {(left, m): [(max(0, left - 1), m, factor if left else 1.0)] for m in (INSULT_MARK, THREAT_MARK)}
        arcs[left, NEGATION] = [(reach, OTHER, 1.0)]
    return Transducer(0, arcs, dict.fromkeys(range(reach + 1), 1.0))


def report_transducer(factor: float) -> Transducer:
    """Weighs a clause with a verb of reported speech, before or behind what is reported."""
    arcs = copying((0, 1), SYMBOLS) | {(k, REPORT): [(1, OTHER, 1.0)] for k in (0, 1)}
    return Transducer(0, arcs, {0: 1.0, 1: factor})


class Automaton:
    """A composed transducer as matrices over its states, one for each symbol and whether the word was marked."""

    def __init__(self, machine: Transducer):
        states = {machine.start: 0}
        for (state, _), found in machine.arcs.items():
            for s in (state, *(after for after, _, _ in found)):
                states.setdefault(s, len(states))
        self.start = np.zeros(len(states))
        self.start[0] = 1.0
        self.final = np.zeros(len(states))
        for state, weight in machine.final.items():
            self.final[states[state]] = weight
        self.plain = {s: np.zeros((len(states), len(states))) for s in SYMBOLS}
        self.marked = {s: np.zeros((len(states), len(states))) for s in SYMBOLS}
        for (state, symbol), found in machine.arcs.items():
            for after, out, weight in found:
                side = self.marked if out in (INSULT_MARK, THREAT_MARK) else self.plain
                side[symbol][states[state], states[after]] += weight

    def weigh(self, marks: Iterable[tuple[str, float]]) -> float:
        """The sum over all paths; a word's own weight counts on the paths that mark it."""
        at = self.start
        for symbol, weight in marks:
            step = at @ self.plain[symbol]
            if symbol in (INSULT, THREAT):
                step += weight * (at @ self.marked[symbol])
            at = step
        return float(at @ self.final)


@dataclass
class Grammar:
    """The composed transducers. ``insults`` and ``stems`` map words and their beginnings to weights."""

    insults: dict[str, float]
    stems: dict[str, float] = field(default_factory=dict)
    threat: float = 1.0
    target: float = 0.5
    negated: float = 0.3
    reported: float = 0.4
    reach: int = 3  # words a negation holds for

    def __post_init__(self):
        self.classes = Classes(self.insults, self.stems)
        self.automaton = Automaton(reduce(compose, self.transducers()))

    def transducers(self) -> list[Transducer]:
        return [
            marker(INSULT, INSULT_MARK),
            marker(THREAT, THREAT_MARK),
            target_transducer(self.target, self.threat),
            negation_transducer(self.negated, self.reach),
            report_transducer(self.reported),
        ]

    def clause(self, marks: list[tuple[str, float] | None]) -> float:
        kept, run = [], 0
        for mark in marks:
            run = 0 if mark else run + 1
            # Further words in a row change no state: all that ends in one is a negation's reach.
            if run <= self.reach:
                kept.append(mark or (OTHER, 1.0))
        return self.automaton.weigh(kept)

    def features(self, text: str | None) -> tuple[float, float, float]:
        """What the matched clauses put out together, how many there are, and their density, all on a log scale."""
        total, matched, n = 0.0, 0, 0
        look = self.classes.__getitem__
        for part in CLAUSE.split(text.lower()) if text else ():
            marks = list(map(look, WORD(part)))
            n += len(marks)
            if any(mark and mark[0] in (INSULT, THREAT) for mark in marks):
                out = self.clause(marks)
                total += out
                matched += out > 0
        return math.log1p(total), math.log1p(matched), math.log1p(1000 * total / (n + 50))


@dataclass
class Model:
    grammar: Grammar
    weights: list[float]

    def score(self, text: str | None) -> float:
        if not self.weights:
            return 0.0
        z = self.weights[0] + sum(w * x for w, x in zip(self.weights[1:], self.grammar.features(text), strict=True))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def places(text: str | None) -> set[tuple[str, int]]:
    """Words of a text, each with a hash of its two neighbours."""
    words = WORD(text.lower()) if text else []
    around = zip(["", *words], words, [*words[1:], ""], strict=False)
    return {(w, hash_pair(a, b)) for a, w, b in around}


def hash_pair(a: str, b: str) -> int:
    from zlib import crc32

    return crc32(f"{a} {b}".encode())


def logistic(x: np.ndarray, y: np.ndarray, n: np.ndarray, penalty: float = 1e-3) -> list[float]:
    """Weights of a logistic regression on rows that stand for ``n`` documents each (Newton steps)."""
    x = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (n * (p - y)) + penalty * w
        hessian = (x * (n * p * (1 - p))[:, None]).T @ x + penalty * np.eye(len(w))
        step = np.linalg.solve(hessian, gradient)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w.tolist()


def fit(
    docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text"
) -> Model:
    """The model learned from labelled rows that are not held out."""
    spark = docs.sparkSession
    chosen = (
        labels.select(F.col(id_col).alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
        .filter(F.col("toxic").isNotNull() & (remainder("doc_id", 5) != 0))
        .groupBy("doc_id")
        .agg(F.max("toxic").alias("toxic"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(sample)
    )
    # At most ``sample`` pairs of numbers are broadcast.
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "doc_id")

    def words(batch: pa.RecordBatch) -> pa.RecordBatch:
        seen: Counter = Counter()
        for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
            seen.update((w, p if toxic else 0, toxic) for w, p in places(text))
        word, place, toxic = zip(*seen, strict=True) if seen else ((), (), ())
        return pa.RecordBatch.from_arrays(
            [pa.array(word, pa.string()), pa.array(place, pa.int64()), pa.array(toxic, pa.int32()),
             pa.array(list(seen.values()), pa.int64())],
            ["word", "place", "toxic", "n"],
        )

    # One row for each word, kind and (in toxic texts) place; a word's places are counted, not its copies.
    counted = staged(
        map_batches(rows, "word string, place long, toxic int, n long", words)
        .groupBy("word", "place", "toxic")
        .agg(F.sum("n").alias("n"))
        .groupBy("word")
        .agg(
            F.count(F.when(F.col("toxic") == 1, 1)).alias("bad_places"),
            F.sum(F.when(F.col("toxic") == 0, F.col("n")).otherwise(0)).alias("good"),
        ),
        "words",
    )
    total = counted.agg(F.sum("bad_places"), F.sum("good")).first()
    if not total[0] or not total[1]:
        return Model(Grammar({}), [])
    odds = F.log((F.col("bad_places") + 0.5) / total[0]) - F.log((F.col("good") + 0.5) / total[1])

    def strongest(found: DataFrame, least: float) -> dict[str, float]:
        found = found.withColumn("odds", odds).filter((F.col("bad_places") >= MIN_PLACES) & (F.col("odds") >= least))
        return {r["word"]: min(r["odds"], 6.0) for r in found.collect()}

    stems = (
        counted.select("*", F.explode(F.array(*[F.lit(k) for k in STEMS])).alias("k"))
        .filter(F.length("word") > F.col("k"))
        .groupBy(F.substring("word", F.lit(1), F.col("k")).alias("word"))
        .agg(F.sum("bad_places").alias("bad_places"), F.sum("good").alias("good"), F.count("*").alias("words"))
        .filter(F.col("words") >= MIN_STEM_WORDS)
    )
    grammar = Grammar(strongest(counted.filter(F.length("word") > 3), MIN_ODDS), strongest(stems, MIN_STEM_ODDS))
    shared = share(spark, grammar)

    def measured(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = np.round([shared().features(x) for x in batch.column("text").to_pylist()], 2)
        return pa.RecordBatch.from_arrays(
            [*(pa.array(found[:, k]) for k in range(3)), batch.column("toxic")], ["a", "b", "c", "toxic"]
        )

    grid = (
        map_batches(rows, "a double, b double, c double, toxic int", measured)
        .groupBy("a", "b", "c", "toxic")
        .count()
        .toPandas()
        .sort_values(["a", "b", "c", "toxic"])
    )
    weights = logistic(grid[["a", "b", "c"]].to_numpy(), grid["toxic"].to_numpy(float), grid["count"].to_numpy(float))
    return Model(grammar, weights)


def toxicity(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, held_out, score, predicted`` for each row of ``docs``."""
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    docs = docs.withColumn("held_out", F.coalesce(remainder("doc_id", 5) == 0, F.lit(False)))
    shared = share(docs.sparkSession, model)
    schema = T.StructType(
        [
            docs.schema["doc_id"],
            docs.schema["held_out"],
            T.StructField("score", T.DoubleType()),
            T.StructField("predicted", T.IntegerType()),
        ]
    )

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        scores = np.array([shared().score(x) for x in batch.column("text").to_pylist()])
        return pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id"),
                batch.column("held_out"),
                pa.array(scores),
                pa.array((scores >= THRESHOLD).astype(np.int32)),
            ],
            schema.fieldNames(),
        )

    return map_batches(docs, schema, work)


def drop_toxic(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` without the rows predicted toxic."""
    shared = share(docs.sparkSession, model)

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = batch.column(batch.schema.names.index(text_col)).to_pylist()
        return batch.filter(pa.array([shared().score(x) < THRESHOLD for x in texts]))

    return map_batches(docs, docs.schema, work)

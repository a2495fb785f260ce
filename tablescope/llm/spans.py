"""Regular expression matches with their places, as column expressions.

Spark extracts the matches of a pattern and the text between them; their lengths give every match its place in code
points. Patterns are Java's; quantifiers that could run over a long text are possessive, so that they neither recurse
nor step back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK = 256
PAGE = 1024
SPAN = "array<struct<start:int,end:int,value:string>>"


def matches(text: Column, pattern: str) -> Column:
    """All leftmost non-overlapping matches, as texts."""
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def placed(text: Column, found: Column, pattern: str) -> Column:
    """``found`` (the matches of ``pattern``) as spans with start and end.

    Places are running sums of lengths. They are summed up in blocks of ``BLOCK`` matches and the blocks by their totals, so
    that the arrays that grow step by step stay short, however many matches a text has.
    """
    between = F.slice(F.split(text, pattern, -1), F.lit(1), F.size(found))
    empty = F.struct(F.lit(0).alias("at"), F.array().cast(SPAN).alias("out"))

    def step(state: Column, pair: Column) -> Column:
        start = state["at"] + pair["gap"]
        end = start + pair["size"]
        span = F.struct(start.alias("start"), end.alias("end"), pair["m"].alias("value"))
        return F.struct(end.alias("at"), F.concat(state["out"], F.array(span)).alias("out"))

    pairs = F.zip_with(
        between,
        found,
        lambda b, m: F.struct(F.char_length(b).alias("gap"), F.char_length(m).alias("size"), m.alias("m")),
    )

    def summed(pairs: Column) -> Column:
        last = F.floor((F.size(pairs) - 1) / BLOCK).cast("int")
        return F.transform(
            F.sequence(F.lit(0), last), lambda k: F.aggregate(F.slice(pairs, k * BLOCK + 1, F.lit(BLOCK)), empty, step)
        )

    def moved(blocks: Column) -> Column:
        starts = F.aggregate(
            blocks,
            F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out")),
            lambda s, b: F.struct((s["at"] + b["at"]).alias("at"), F.concat(s["out"], F.array(s["at"])).alias("out")),
            lambda s: s["out"],
        )
        return F.zip_with(
            blocks,
            starts,
            lambda b, at: F.transform(
                b["out"],
                lambda x: F.struct((x["start"] + at).alias("start"), (x["end"] + at).alias("end"), x["value"].alias("value")),
            ),
        )

    spans = F.flatten(once(once(pairs, summed), moved))
    return F.when(F.size(found) > 0, spans).otherwise(F.array().cast(SPAN))


def once(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, though ``use`` names it in a function or several times."""
    return F.element_at(F.transform(F.array(value), use), 1)


def pages(text: Column) -> Column:
    """The text in pieces of ``PAGE`` code points, so that a place in a long text is found without reading up to it."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PAGE}}}+"), F.lit(0))


def cut(pages: Column, start: Column, end: Column) -> Column:
    """The code points from ``start`` to ``end``, at most ``PAGE`` of them, of a text in pages."""
    first = F.floor(start / PAGE).cast("int")
    near = F.array_join(F.slice(pages, first + 1, F.lit(2)), "")
    return F.substring(near, start - first * PAGE + 1, end - start)


def add_spans(df: DataFrame, text_col: str, patterns: dict[str, str]) -> DataFrame:
    """``df`` with a column of spans for each named pattern. Each pattern runs over a text once, twice if it matches."""
    kept = list(df.columns)
    df = df.select("*", *[matches(F.col(text_col), p).alias(name) for name, p in patterns.items()])
    return df.select(*kept, *[placed(F.col(text_col), F.col(name), p).alias(name) for name, p in patterns.items()])


def free_name(df: DataFrame, name: str) -> str:
    """``name``, or a longer one if ``df`` has such a column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def written(kind: str | Column, span: Column) -> Column:
    """``kind:start:end``."""
    kind = F.lit(kind) if isinstance(kind, str) else kind
    return F.concat_ws(":", kind, span["start"].cast("string"), span["end"].cast("string"))

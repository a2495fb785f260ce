"""Personal data: patterns propose spans, check sums confirm them, words nearby adjust their score.

Only DataFrame functions are used. The kinds are e-mail addresses, IPv4 addresses (parts up to 255), payment cards
(Luhn), phone numbers (8 to 15 digits) and, beyond these, bank account numbers (IBAN, remainder 1 modulo 97). A span's
score is its kind's own plus a bonus for a context word within ``NEAR`` code points; a span counts from ``THRESHOLD``.

Defined results: null texts are empty texts and have no spans; very long runs of digits or letters are matched without
recursion; repeated rows and null ids give a row each; other columns are ignored (``redact`` hands them on, and a column
``n_chars`` follows the new text).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablescope.llm.spans import add_spans, cut, digits, free_name, pages, written

KINDS = ["email", "ip", "card", "phone", "iban"]
BASE = KINDS[:4]
# A run that starts in the middle of a longer one can only match behind the previous match; \G stands for that place.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9]){15,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
}
SCORES = {"email": 80, "ip": 50, "card": 70, "phone": 60, "iban": 80}
BONUS = 20
THRESHOLD = 50
NEAR = 40
CONTEXT = {
    "email": "mail|contact|kontakt|correo|courriel|write to",
    "ip": "address|server|host|login|adresse|dirección",
    "card": "card|visa|master|amex|credit|payment|karte|carte|tarjeta",
    "phone": "phone|tel|call|mobile|fax|telefon|téléphone|llame|móvil",
    "iban": "iban|account|bank|konto|compte|cuenta",
}


def luhn(number: Column) -> Column:
    """Whether a text of digits has a Luhn sum divisible by ten."""

    def step(state: Column, sign: Column) -> Column:
        value = sign.cast("int") * F.when(state["double"], 2).otherwise(1)
        return F.struct(
            (state["sum"] + F.when(value > 9, value - 9).otherwise(value)).alias("sum"), (~state["double"]).alias("double")
        )

    begin = F.struct(F.lit(0).alias("sum"), F.lit(False).alias("double"))
    signs = F.filter(F.split(F.reverse(number), ""), lambda c: c != "")
    return F.aggregate(signs, begin, step, lambda s: s["sum"] % 10 == 0)


def mod97(account: Column) -> Column:
    """Whether an account number has remainder 1, its first four signs moved to the end and letters read from 10 up."""
    plain = F.replace(account, F.lit(" "), F.lit(""))
    moved = F.concat(F.substring(plain, 5, 40), F.substring(plain, 1, 4))
    signs = F.filter(F.split(moved, ""), lambda c: c != "")

    def step(state: Column, sign: Column) -> Column:
        letter = F.ascii(sign) - 55
        return F.when(F.ascii(sign) >= 65, (state * 100 + letter) % 97).otherwise((state * 10 + F.ascii(sign) - 48) % 97)

    return F.aggregate(signs, F.lit(0), step, lambda r: r == 1)


def valid(kind: str, value: Column) -> Column:
    number = digits(value)
    if kind == "ip":
        short = F.transform(F.split(value, r"\."), lambda p: F.regexp_replace(p, "^0+", ""))
        return F.forall(short, lambda p: (F.length(p) < 3) | ((F.length(p) == 3) & (p <= "255")))
    if kind == "card":
        size = F.length(number)
        return F.when((size >= 16) & (size <= 19), luhn(number)).otherwise(False)
    if kind == "phone":
        return F.length(number).between(8, 15)
    if kind == "iban":
        return mod97(value)
    return F.lit(True)


def score(kind: str, text: Column, span: Column) -> Column:
    """The score of a span of a text in pages."""
    start = F.greatest(span["start"] - NEAR, F.lit(0))
    before = cut(text, start, span["start"])
    after = cut(text, span["end"], span["end"] + NEAR)
    near = F.lower(F.concat_ws(" ", before, after)).rlike(CONTEXT[kind])
    return F.lit(SCORES[kind]) + F.when(near, BONUS).otherwise(0)


def find(df: DataFrame, text_col: str) -> DataFrame:
    """``df`` (whose text is not null) with columns ``email`` ... ``iban``: arrays of start, end, value and score."""
    kept = list(df.columns)
    df = add_spans(df, text_col, PATTERNS)
    some = sum((F.size(k) for k in KINDS), F.lit(0)) > 0
    text = free_name(df, "pages")
    df = df.withColumn(text, F.when(some, pages(F.col(text_col))))
    found = [
        F.transform(
            F.filter(F.col(k), lambda s: valid(k, s["value"])),
            lambda s: F.struct(
                s["start"].alias("start"), s["end"].alias("end"), score(k, F.col(text), s).alias("score")
            ),
        ).alias(k)
        for k in KINDS
    ]
    return df.select(*kept, *found)


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts and spans for each row of ``docs``; ``scores`` are per cent, in the order of ``spans``."""
    docs = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    found = find(docs, "text")

    def listed(kinds: list[str]) -> Column:
        return F.array_join(F.concat(*[F.transform(k, lambda s: written(k, s)) for k in kinds]), ",")

    scores = F.concat(*[F.transform(k, lambda s: s["score"].cast("string")) for k in KINDS])
    return found.select(
        "doc_id",
        *[F.size(k).cast("long").alias(f"n_{k}") for k in BASE],
        F.sha2(listed(BASE), 256).alias("base_sha256"),
        listed(KINDS).alias("spans"),
        F.size("iban").cast("long").alias("n_iban"),
        F.array_join(scores, ",").alias("scores"),
    )


def redact(docs: DataFrame, text_col: str = "text", threshold: int = THRESHOLD) -> DataFrame:
    """``docs`` with every span of a sufficient score replaced by its kind in brackets; overlapping spans become one."""
    held, new = free_name(docs, "held"), free_name(docs, "redacted")
    whole = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias(held), F.coalesce(docs[text_col], F.lit("")).alias("text"))
    found = find(whole, "text")
    tagged = [
        F.transform(
            F.filter(k, lambda s: s["score"] >= threshold),
            lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.lit(f"[{k.upper()}]").alias("tag")),
        )
        for k in KINDS
    ]
    found = found.select(held, "text", F.array_sort(F.concat(*tagged)).alias("spans"))

    def step(state: Column, span: Column) -> Column:
        gap = F.substring(F.col("text"), state["at"] + 1, span["start"] - state["at"])
        apart = span["start"] >= state["at"]
        out = F.when(apart, F.concat(state["out"], F.array(gap, span["tag"]))).otherwise(state["out"])
        return F.struct(F.greatest(state["at"], span["end"]).alias("at"), out.alias("out"))

    begin = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))
    rest = F.char_length("text")
    text = F.aggregate(
        F.col("spans"),
        begin,
        step,
        lambda s: F.concat(F.array_join(s["out"], ""), F.substring(F.col("text"), s["at"] + 1, rest)),
    )
    found = found.select(held, F.when(F.size("spans") > 0, text).alias(new))
    out = []
    for c in docs.columns:
        value = F.col(held)[c]
        if c == text_col:
            value = F.coalesce(F.col(new), value)
        elif c == "n_chars":
            value = F.when(F.col(new).isNotNull(), F.char_length(new).cast(docs.schema[c].dataType)).otherwise(value)
        out.append(value.alias(c))
    return found.select(*out)

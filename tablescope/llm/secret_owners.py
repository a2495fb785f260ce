"""Secret scan with corpus-wide ownership frequency.

Only DataFrame functions are used. Patterns propose candidates: assignments to names like ``password``, access keys, long
hexadecimal numbers, and (kind ``key``) other long runs of letters and digits. Every candidate's value is hashed, and the
hashes are aggregated over the whole corpus by distinct repositories and owners. A value that many owners or very many
repositories have is a copied example; one that few have is specific to them, and it looks live unless it is a placeholder or too
regular. The first three kinds are always reported; a ``key`` is added when it is owner-specific, looks live, and overlaps
no other span.

One value may stand in a third of all rows: frequencies combine on the map side, and spans meet their frequencies in a
join salted by row. Rows with spans move as spans only; texts never move.

Defined results: null texts are empty texts and have no spans; null owners or repositories count as one; repeated rows
and null ids give a row each; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tablescope.llm.common import staged
from tablescope.llm.spans import add_spans, written

KINDS = ["assign", "access", "hex", "key"]
PATTERNS = {
    "assign": r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]++""",
    "access": r"AKIA[A-Z0-9]{14,}+",
    "hex": r"[0-9a-f]{16,}+",
    "key": r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}+",
}
VALUE = r"""^(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?"""
PLACEHOLDER = r"(?i)example|sample|dummy|changeme|placeholder|your|xxxx|0000|1234"
SHARED_OWNERS = 3
SHARED_REPOS = 20  # so many repositories are copies even of one owner
MIN_ENTROPY = 3.0
SALTS = 8


def entropy(value: Column) -> Column:
    """Bits per sign of a text that is not empty."""
    signs = F.filter(F.split(value, ""), lambda c: c != "")
    size = F.size(signs)

    def part(sign: Column) -> Column:
        share = F.size(F.filter(signs, lambda c: c == sign)) / size
        return -share * F.log2(share)

    return F.aggregate(F.array_distinct(signs), F.lit(0.0), lambda total, sign: total + part(sign))


def candidates(df: DataFrame, text_col: str) -> DataFrame:
    """``df`` with a column ``found``: spans with number of kind, hash of the value, and whether it looks live."""
    kept = list(df.columns)
    df = add_spans(df, text_col, PATTERNS)

    def spans(number: int, kind: str) -> Column:
        value = (lambda s: F.regexp_replace(s["value"], VALUE, "")) if kind == "assign" else (lambda s: s["value"])
        found = F.transform(
            kind,
            lambda s: F.struct(
                s["start"].alias("start"), F.lit(number).alias("kind"), s["end"].alias("end"), value(s).alias("value")
            ),
        )
        if kind == "assign":
            found = F.filter(found, lambda s: F.length(s["value"]) >= 12)
        if kind == "key":
            found = F.filter(found, lambda s: s["value"].rlike("[0-9]") & s["value"].rlike("[A-Za-z]"))
        return found

    df = df.select(*kept, *[spans(n, k).alias(k) for n, k in enumerate(KINDS)])
    df = df.select(*kept, F.concat(*KINDS).alias("found"))
    live = F.transform(
        "found",
        lambda s: F.struct(
            s["start"].alias("start"),
            s["kind"].alias("kind"),
            s["end"].alias("end"),
            F.sha2(s["value"], 256).alias("hash"),
            (~s["value"].rlike(PLACEHOLDER) & (entropy(s["value"]) >= MIN_ENTROPY)).alias("live"),
        ),
    )
    return df.select(*kept, live.alias("found"))


def apart(spans: DataFrame) -> DataFrame:
    """``spans`` without those of kind ``key`` that overlap another span of their row; one row's spans are read in order."""
    order = ["start", "kind", "end"]
    # Both windows look back, which takes one pass each: the second one over the spans from behind.
    forward = Window.partitionBy("row").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    back = Window.partitionBy("row").orderBy(*[F.desc(c) for c in order]).rowsBetween(Window.unboundedPreceding, -1)
    base = F.col("kind") < 3
    before = F.max(F.when(base, F.col("end"))).over(forward)
    after = F.min(F.when(base, F.col("start"))).over(back)
    spans = spans.withColumn("before", before).withColumn("after", after)
    free = (F.coalesce("before", F.lit(0)) <= F.col("start")) & (F.coalesce("after", F.col("end")) >= F.col("end"))
    return spans.filter(base | free).drop("before", "after")


def ownership(found: DataFrame) -> DataFrame:
    """``hash, n_repos, n_owners`` from rows of hash, owner and repository."""
    return (
        found.groupBy("hash", "owner", "repo")
        .agg(F.lit(1).alias("one"))
        .groupBy("hash", "owner")
        .agg(F.count("*").alias("repos"))
        .groupBy("hash")
        .agg(F.sum("repos").alias("n_repos"), F.count("*").alias("n_owners"))
    )


def secrets(
    docs: DataFrame,
    owner: Column | None = None,
    repo: Column | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    shared_owners: int = SHARED_OWNERS,
    shared_repos: int = SHARED_REPOS,
) -> DataFrame:
    """Counts and spans for each row of ``docs``.

    The owner is the column ``source`` and a repository one language of it, unless other columns are given.
    """
    owner = F.col("source") if owner is None else owner
    repo = F.concat_ws("/", F.col("source"), F.col("lang")) if repo is None else repo
    docs = docs.select(
        F.monotonically_increasing_id().alias("row"),
        F.col(id_col).alias("doc_id"),
        F.coalesce(owner.cast("string"), F.lit("")).alias("owner"),
        F.coalesce(repo.cast("string"), F.lit("")).alias("repo"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"),
    )
    # Written once, so a row keeps its number and each text is scanned once.
    scanned = staged(candidates(docs, "text").drop("text"), "secrets")
    some = scanned.select("row", "doc_id", "owner", "repo", F.explode("found").alias("s"))
    some = apart(some.select("row", "doc_id", "owner", "repo", "s.*"))
    owned = ownership(some).select("*", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    judged = some.withColumn("salt", F.pmod("row", F.lit(SALTS)).cast("int")).join(owned, ["hash", "salt"])
    copied = (F.col("n_owners") >= shared_owners) | (F.col("n_repos") >= shared_repos)
    judged = judged.filter((F.col("kind") < 3) | (F.col("live") & ~copied))
    span = F.struct("start", "kind", "end", copied.alias("copied"), (F.col("live") & ~copied).alias("live"))
    spans = judged.groupBy("row").agg(F.sort_array(F.collect_list(span)).alias("spans"))
    # Every row that has candidates meets its judged spans again by its number; all others have none.
    with_spans = scanned.filter(F.size("found") > 0).select("row", "doc_id").join(spans, "row", "left")
    none = F.array().cast(spans.schema["spans"].dataType)
    rows = with_spans.select("doc_id", F.coalesce("spans", none).alias("spans")).unionAll(
        scanned.filter(F.size("found") == 0).select("doc_id", none.alias("spans"))
    )
    names = F.array(*[F.lit(k) for k in KINDS])

    def listed(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: written(F.get(names, s["kind"]), s)), ",")

    def count(test) -> Column:
        return F.size(F.filter("spans", test)).cast("long")

    return rows.select(
        "doc_id",
        *[count(lambda s: s["kind"] == n).alias(f"n_{k}") for n, k in enumerate(KINDS[:3])],
        F.sha2(listed(F.filter("spans", lambda s: s["kind"] < 3)), 256).alias("base_sha256"),
        listed(F.col("spans")).alias("spans"),
        count(lambda s: s["kind"] == 3).alias("n_key"),
        count(lambda s: s["copied"]).alias("n_copied"),
        count(lambda s: s["live"]).alias("n_live"),
    )

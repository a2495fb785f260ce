"""The registered queries of this folder: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tablescope.llm import (
    decontaminate,
    fertility,
    html_text,
    language,
    packing,
    pii,
    repeats,
    secret_owners,
    simhash,
    spelling,
    token_spans,
    toxicity,
    whitening,
)
from tablescope.llm.common import table


def op1_fertility(spark: SparkSession, folder: str) -> DataFrame:
    return fertility.fertility(table(spark, folder, "documents"))


def op2_secret_owners(spark: SparkSession, folder: str) -> DataFrame:
    return secret_owners.secrets(table(spark, folder, "documents"))


def op3_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(table(spark, folder, "documents"))


def op4_token_spans(spark: SparkSession, folder: str) -> DataFrame:
    return token_spans.attribute(table(spark, folder, "documents"))


def op5_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    found = decontaminate.contamination(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    return found.drop("hit_spans")


def op6_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return toxicity.toxicity(docs, toxicity.fit(docs, table(spark, folder, "labels")))


def op7_language(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return language.identify(docs, language.fit(docs))


def op8_pii(spark: SparkSession, folder: str) -> DataFrame:
    return pii.personal_data(table(spark, folder, "documents"))


def op9_html_text(spark: SparkSession, folder: str) -> DataFrame:
    pages = table(spark, folder, "pages")
    return html_text.main_text(pages, html_text.fit(pages))


def op10_simhash(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, folder, "documents"))


def op11_repeats(spark: SparkSession, folder: str) -> DataFrame:
    return repeats.repeats(table(spark, folder, "documents"))


def op12_spelling(spark: SparkSession, folder: str) -> DataFrame:
    return spelling.variants(table(spark, folder, "documents"))


def op13_whitening(spark: SparkSession, folder: str) -> DataFrame:
    return whitening.whiten(table(spark, folder, "embeddings"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [
        op1_fertility,
        op2_secret_owners,
        op3_packing,
        op4_token_spans,
        op5_decontaminate,
        op6_toxicity,
        op7_language,
        op8_pii,
        op9_html_text,
        op10_simhash,
        op11_repeats,
        op12_spelling,
        op13_whitening,
    ]
    return {f.__name__: f for f in found}


# Words as the operator reads them; A-Z become small first.
_WORDS = (
    "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
    "'[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
)

OP5 = f"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, {_WORDS} AS w FROM documents),
i AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS} AS w FROM benchmark),
s AS (SELECT item, w, least({decontaminate.WIDTH}, len(w)) AS n FROM i WHERE len(w) > 0),
win AS (SELECT DISTINCT item, n, array_to_string(w[p : p + n - 1], ' ') AS k
        FROM (SELECT item, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM s)),
places AS (SELECT r, n, p, array_to_string(w[p : p + n - 1], ' ') AS k
           FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS p
                 FROM d JOIN (SELECT DISTINCT n FROM s) ON len(w) >= n)),
occ AS (SELECT r, p, places.n, item FROM places JOIN win ON places.k = win.k AND places.n = win.n),
hits AS (SELECT r, count(DISTINCT q) AS n_hit FROM (SELECT r, unnest(range(p, p + n)) AS q FROM occ) GROUP BY r),
items AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names
          FROM (SELECT DISTINCT r, item FROM occ) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(names, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hits USING (r) LEFT JOIN items USING (r)
"""


_SPLIT = "regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')"

OP11 = f"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, {_SPLIT} AS w FROM documents),
win AS (SELECT r, doc_id, p, array_to_string(w[p : p + {repeats.WINDOW} - 1], ' ') AS k
        FROM (SELECT r, doc_id, w, unnest(range(1, len(w) - {repeats.WINDOW} + 2)) AS p FROM d)),
late AS (SELECT r, p FROM (SELECT r, p, rank() OVER (PARTITION BY k ORDER BY doc_id NULLS LAST, p) AS place FROM win)
         WHERE place > 1),
gone AS (SELECT DISTINCT r, unnest(range(p, p + {repeats.WINDOW})) AS q FROM late),
spread AS (SELECT r, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS q FROM d),
kept AS (SELECT r, count(*) AS n, string_agg(word, ' ' ORDER BY q) AS words
         FROM spread ANTI JOIN gone USING (r, q) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(words, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (r)
"""


def oracle_sql() -> dict[str, str]:
    """The other queries need a tokenizer, a learned model, XXH64 or a page parser; tests compare them with plain code."""
    return {"op5_decontaminate": OP5, "op11_repeats": OP11}

"""Every operator and stage on nulls, empty and long texts, repeated rows, empty tables and columns with clashing names."""

import os

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tablescope.llm import (
    decontaminate,
    fertility,
    html_text,
    language,
    packing,
    pii,
    secret_owners,
    simhash,
    token_spans,
    toxicity,
)

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = "word " * 40_000 + "1" * 50_000 + " 1" * 20_000 + "a." * 20_000 + "<" * 20_000 + "\n" * 1000
ROWS = [
    (1, None, None, None, None),
    (2, "", "en", "s", 0),
    (3, " \t\n ", "en", "s", 4),
    (4, LONG, "en", "s", len(LONG)),
    (5, "one two three four", "en", "s", 18),
    (5, "one two three four", "en", "s", 18),
    (None, "one two three four", None, "s", 18),
    (6, "日本語 😀   é", "ja", None, 9),
    (7, "one two three four", "en", "t", 18),
]
# Names that the operators use for columns of their own.
EXTRA = ["row", "fp", "score", "spans", "band", "held", "redacted", "leaf", "found", "items", "size", "start", "toxic", "email"]


def extended(df):
    return df.select(*[F.lit(k).alias(c) for k, c in enumerate(EXTRA)], *df.columns)


@pytest.fixture(scope="module")
def odd(spark):
    return extended(spark.createDataFrame(ROWS, DOCS)).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return extended(spark.createDataFrame([], DOCS))


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(5, 1, 0), (5, 1, 1), (7, 1, None), (None, 0, 1)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def items(spark):
    rows = [(1, None), (2, ""), (3, "Two THREE"), (3, "Two THREE"), (None, "one")]
    return spark.createDataFrame(rows, "item_id long, text string").withColumn("spans", F.lit(1))


def operators(labels, items):
    return {
        "fertility": fertility.fertility,
        "secrets": secret_owners.secrets,
        "attribute": token_spans.attribute,
        "contamination": lambda d: decontaminate.contamination(d, items),
        "toxicity": lambda d: toxicity.toxicity(d, toxicity.fit(d, labels)),
        "identify": lambda d: language.identify(d, language.fit(d)),
        "personal_data": pii.personal_data,
        "near_duplicates": simhash.near_duplicates,
    }


NAMES = ["fertility", "secrets", "attribute", "contamination", "toxicity", "identify", "personal_data", "near_duplicates"]


@pytest.mark.parametrize("name", NAMES)
def test_one_row_for_each_row(odd, empty, labels, items, name):
    work = operators(labels, items)[name]
    found = work(odd).collect()
    assert sorted(str(r["doc_id"]) for r in found) == sorted(str(r[0]) for r in ROWS)
    assert work(empty).count() == 0
    by_id = {r["doc_id"]: r.asDict() for r in found}
    if name == "fertility":
        assert by_id[1]["n_words"] == by_id[3]["n_words"] == 0 and by_id[1]["base_failed"] and not by_id[1]["kept"]
        assert by_id[1]["band"] == "script:NONE" and by_id[None]["band"] == "script:LATIN"
    if name == "secrets":
        assert by_id[1]["spans"] == "" and by_id[4]["n_hex"] == 1
    if name == "attribute":
        assert by_id[1]["n_tokens"] == 0 and by_id[1]["n_sections"] == 1
        assert all(sum(s["tokens"] for s in r["sections"]) == r["n_tokens"] for r in found)
    if name == "contamination":
        assert by_id[5]["n_hit"] == 3 and by_id[5]["n_items"] == 1 and not by_id[1]["contaminated"]
    if name == "toxicity":
        assert all(0 <= r["score"] <= 1 for r in found) and not by_id[None]["held_out"]
    if name == "identify":
        assert by_id[1]["lang_pred"] == by_id[3]["lang_pred"] == "und" and by_id[5]["lang_pred"] == "en"
    if name == "personal_data":
        assert by_id[1]["n_email"] == 0 and by_id[1]["spans"] == ""
    if name == "near_duplicates":
        assert by_id[1]["fingerprint"] == "0" * 16 and by_id[3]["component_id"] == 1
        assert by_id[7]["component_id"] == by_id[None]["component_id"] == 5


def test_packing_odd_rows(odd, empty):
    pieces = packing.pack(odd).toPandas()
    assert packing.pack(empty).count() == 0
    assert (pieces[pieces.doc_id == 1][["length", "doc_tokens"]] == 1).all().all()
    assert pieces.length.sum() == pieces.groupby(pieces.doc_id.fillna(-1)).doc_tokens.first().sum() + 5
    assert pieces.groupby("sequence_id").length.sum().max() <= packing.LIMIT


def test_pages(spark):
    schema = "page_id long, url string, html string, text string, n_chars int"
    rows = [
        (1, None, None, "x", 1),
        (None, "u", "", "x", 1),
        (2, "u", "plain &amp; simple", None, 1),
        (2, "u", "plain &amp; simple", None, 1),
        (3, "u", "<p>" * 30_000 + "deep" + "<" * 30_000, None, 1),
        (4, "u", "<nav>a b c<article><h1>A short title</h1><p>one\n two<br>x</p></article><div class='comment'>bad words here</div>", "", 1),
    ]
    pages = spark.createDataFrame(rows, schema)
    found = html_text.main_text(pages, html_text.fit(pages)).collect()
    text = {r["page_id"]: r["text"] for r in found}
    assert len(found) == 6 and text[1] == text[None] == "" and text[2] == "plain & simple"
    assert text[4] == "A short title\none two x" and all(r["n_chars"] == len(r["text"]) for r in found)
    none = spark.createDataFrame([], schema)
    assert html_text.main_text(none, html_text.fit(none)).count() == 0


@pytest.mark.parametrize("number", range(len(corpus_pipeline.STAGES) - 1))
def test_stages_keep_columns(spark, odd, empty, number):
    _, stage = corpus_pipeline.STAGES[number]
    kept = stage(spark, odd, SF)
    assert kept.columns == odd.columns and dict(kept.dtypes) == dict(odd.dtypes)
    rows = kept.select("doc_id", "text").collect()
    assert stage(spark, empty, SF).count() == 0
    ids = [r["doc_id"] for r in rows]
    if number == 1:
        assert sorted(ids) == [1, 4, 5, 6]
    else:
        assert len(ids) == len(ROWS)


def test_last_stage(spark, odd, empty):
    name, stage = corpus_pipeline.STAGES[-1]
    assert name == "packing" and stage(spark, odd, SF).count() >= len(ROWS) and stage(spark, empty, SF).count() == 0
    assert os.path.exists(packing.default_vocabulary())

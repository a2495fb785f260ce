"""CSV files, the whole run, and conversation tables."""

import pytest
from pyspark.sql import functions as F

from tablescope import load_analyse_clean
from tablescope.operators import context, conversations
from tablescope.operators.schema import SEMANTIC_TYPES
from tablescope.plans.columns import local_rows
from tablescope.sources.csv import load_csv


def test_mixed_encodings(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes('name,n\n"Köln, am Rhein",1\nÅ,NA\n'.encode())
    (tmp_path / "b.csv").write_bytes('name,n\n"né ""x""",3\n'.encode("latin-1"))
    loaded = load_csv(spark, str(tmp_path))
    assert sorted(tuple(r) for r in loaded.df.collect()) == sorted([("Köln, am Rhein", 1), ("Å", None), ('né "x"', 3)])
    assert len(loaded.latin1_files) == 1
    assert dict(loaded.df.dtypes) == {"name": "string", "n": "bigint"}


def test_named_encoding(spark, tmp_path):
    (tmp_path / "c.csv").write_bytes("s\nKöln\n".encode("latin-1"))
    assert load_csv(spark, str(tmp_path), encoding="ISO-8859-1").df.first()[0] == "Köln"


def test_types_and_missing_texts(spark, tmp_path):
    lines = ["i,f,b,s,d,e", "1,1.5,True,x,2024-01-01,", "n/a,NaN,false,null,2024-01-02,", "-3,1e3,,7,2024-01-03,"]
    (tmp_path / "t.csv").write_text("\n".join(lines))
    df = load_csv(spark, str(tmp_path)).df
    assert dict(df.dtypes) == {
        "i": "bigint", "f": "double", "b": "boolean", "s": "string", "d": "string", "e": "double",
    }
    assert {r["i"] for r in df.collect()} == {1, None, -3}


def test_numbers_beyond_whole_range_become_double(spark, tmp_path):
    (tmp_path / "n.csv").write_text("n\n1\n99999999999999999999\n")
    assert dict(load_csv(spark, str(tmp_path)).df.dtypes) == {"n": "double"}


@pytest.fixture(scope="module")
def run(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("run")
    lines = ["Order Date,Amount (USD),Status"]
    lines += [f"2024-01-{i % 28 + 1:02d},{'' if i % 10 == 0 else i * 1.5},{'open' if i % 5 else ' open'}" for i in range(60)]
    (folder / "orders.csv").write_text("\n".join(lines))
    return load_analyse_clean(spark, str(folder))


def test_run_reports(run):
    assert run.raw.columns == ["order_date", "amount_usd", "status"]
    assert run.schema["time_columns"].first()["column"] == "order_date"
    assert run.quality["missing_summary"].first()["total_missing"] == 6
    assert run.clean.filter("amount_usd IS NULL OR status <> 'open'").count() == 0
    assert {r["semantic_type"] for r in run.schema["column_categories"].collect()} == set(SEMANTIC_TYPES)
    assert run.clustering is None
    info = run.info().first()
    assert (info["rows"], info["has_time_series"], info["target_column"]) == (60, True, "status")


def test_run_charts_and_context(run):
    assert {"quality_gauge", "missing_values", "distributions", "time_series"} <= set(run.charts)
    for chart in run.charts.values():
        chart.collect()
    text = context.context_text(run.context(with_profile=True))
    for title in ("DATASET OVERVIEW", "SCHEMA INTELLIGENCE", "DATA QUALITY", "STATISTICAL PROFILE", "DATA SAMPLE"):
        assert title in text
    assert "rows: 60\n" in text and "columns: order_date, amount_usd, status" in text


def test_large_input_is_staged_as_columns(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "x.csv").write_text("My Key,v\n" + "\n".join(f"{i},{i % 7}" for i in range(200)))
    found = load_analyse_clean(
        spark, str(tmp_path / "in"), stage_to=str(tmp_path / "staged"), run_clustering=False, with_charts=False
    )
    assert found.raw.columns == ["my_key", "v"] and found.raw.count() == 200
    assert [r["original"] for r in found.names.collect()] == ["My Key", "v"]
    found.release()
    assert not (tmp_path / "staged").exists()


def test_files_with_other_column_orders_meet_by_name(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id,city\n1,Köln\n", encoding="utf-8")
    (tmp_path / "b.csv").write_text("city,id\nBonn,2\n", encoding="utf-8")
    (tmp_path / "c.csv").write_bytes("city,id,size\nMünchen,3,9\n".encode("latin-1"))
    rows = load_csv(spark, str(tmp_path)).df.orderBy("id").collect()
    assert [(r["id"], r["city"], r["size"]) for r in rows] == [(1, "Köln", None), (2, "Bonn", None), (3, "München", 9)]


def test_samples(spark):
    df = spark.range(5000).select((F.col("id") % 1000).alias("a"), F.col("id").alias("b"))
    assert context.context_sample(df, order_by=["b"]).count() == 100
    big = context.context_sample(df, 500, "hash").collect()
    assert len(big) == 500 and big == context.context_sample(df.repartition(7), 500, "hash").collect()


def turns(spark, n):
    """One very long conversation beside short ones: system, then user and assistant in turn."""
    long = spark.range(n).select(
        F.lit(1).cast("bigint").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "system").when(F.col("id") % 2 == 1, "user").otherwise("assistant").alias("role"),
        F.concat(F.lit("t"), F.col("id").cast("string")).alias("text"),
    )
    short = local_rows(
        spark,
        [(2, 0, "user", "q"), (2, 1, "assistant", "r" * 3000), (2, 2, "user", "open"), (3, 0, "user", "alone")],
        "conv_id bigint, turn bigint, role string, text string",
    )
    return long.unionByName(short).repartition(6)


def test_long_conversation_is_numbered_across_chunks(spark):
    found = conversations.conversation_queries(turns(spark, 5001))
    rows = {r["number"]: r["query"] for r in found.filter("conv_id = 1").collect()}
    assert rows == {i + 1: f"t{2 * i + 1}" for i in range(2500)}


def test_messages_put_system_first_and_prompt_last(spark):
    prompts = local_rows(spark, [(1, "new"), (3, "more")], "conv_id bigint, text string")
    shuffled = turns(spark, 3001).withColumn("role", F.when(F.col("turn") == 2500, "system").otherwise(F.col("role")))
    rows = conversations.conversation_messages(shuffled, prompts).collect()
    by_place = {(r["conv_id"], r["position"]): (r["role"], r["content"]) for r in rows}
    assert by_place[(1, 1)] == ("system", "t0") and by_place[(1, 2)] == ("system", "t2500")
    assert by_place[(1, 3)] == ("user", "t1") and by_place[(1, 3002)] == ("user", "new")
    assert by_place[(3, 2)] == ("user", "more") and len(by_place) == len(rows) == 3001 + 4 + 2


def test_recent_results(spark):
    rows = conversations.conversation_context(turns(spark, 41)).collect()
    by_id = {r["conv_id"]: r for r in rows}
    assert set(by_id) == {1, 2}
    assert by_id[1]["n_results"] == 5 and by_id[1]["context"].endswith("Question: t39\nResult: t40")
    assert by_id[2]["context"].endswith("Result: " + "r" * 500)


GOOD = '{"dataset_overview": "o", "insights": [{"description": "d"}], "anomalies": [{"affected_columns": ["a", "b"]}]}'


@pytest.mark.parametrize(
    "text,path",
    [
        (GOOD, "plain"),
        (f"  {GOOD}\n", "plain"),
        (f"```json\n{GOOD}\n```", "fenced"),
        (f"```\n{GOOD}```  ", "fenced"),
        (f"Sure! {GOOD} Bye.", "embedded"),
        (f"{GOOD} and more", "embedded"),
        (f"{GOOD} {GOOD}", "fallback"),
        (f"{GOOD},{GOOD}", "fallback"),
        ("no json", "fallback"),
        ("[1, 2]", "fallback"),
        ("3", "fallback"),
        ("", "fallback"),
        ("{broken: }", "fallback"),
    ],
)
def test_response_paths(make, text, path):
    row = conversations.llm_json_extract(make([(1, text)], "id int, r string"), "id", "r").first()
    assert row["parse_path"] == path
    assert (row["parse_warning"] is not None) == (path == "fallback")
    if path == "fallback":
        assert (row["dataset_overview"], row["n_insights"]) == (text, 1)
    else:
        assert (row["dataset_overview"], row["n_insights"], row["n_anomalies"]) == ("o", 1, 1)


def test_response_rows_have_defaults(make):
    rows = conversations.llm_insight_rows(make([(1, GOOD)], "id int, r string"), "id", "r").collect()
    assert {tuple(r) for r in rows} == {
        (1, "insight", 1, "Insight", "d", "", ""), (1, "anomaly", 1, "Anomaly", "", "", "a, b"),
    }

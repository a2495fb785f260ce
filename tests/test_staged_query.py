"""The whole run over CSV files stages the parsed table."""

from conftest import SF
from query_set.spark_queries import queries


def test_passes_do_not_parse_the_text_again(spark):
    clean = queries()["load_analyse_clean"](spark, SF)
    assert clean.inputFiles() and all(f.endswith(".parquet") for f in clean.inputFiles())

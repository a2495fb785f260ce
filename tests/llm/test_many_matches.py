"""Texts with very many matches: right places, and time in proportion to the text."""

import time

import pytest

from tablescope.llm import pii, secret_owners


def seconds(action):
    start = time.perf_counter()
    found = action()
    return time.perf_counter() - start, found


@pytest.mark.parametrize("n", [1, 255, 256, 257, 2000])
def test_places(spark, n):
    text = "".join(f"é😀{'x' * (k % 7)} u{k}@ab{k}.co, " for k in range(n))
    row = pii.personal_data(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    want, at = [], 0
    for k in range(n):
        at = text.index(f"u{k}@ab{k}.co", at)
        want.append(f"email:{at}:{at + len(f'u{k}@ab{k}.co')}")
    assert row["n_email"] == n and row["spans"] == ",".join(want)


def test_context_is_that_around_the_span(spark):
    far = "mail" + "é" * 41
    texts = [f"{'a ' * k}{word} x@y.org {end}" for k in (0, 500, 505, 511, 512, 3000) for word, end in (("mail", ""), (far, "z"), ("", "e-mail"))]
    rows = pii.personal_data(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()
    for row, text in zip(rows, texts, strict=True):
        a = text.index("x@y.org")
        near = "mail" in text[max(0, a - 40) : a] or "mail" in text[a + 7 : a + 47]
        assert row["scores"] == ("100" if near else "80")


def test_time_follows_the_text(spark):
    def run(n):
        docs = spark.createDataFrame([(1, "a@b.co " * n, "s", "en")], "doc_id long, text string, source string, lang string")
        return seconds(lambda: pii.personal_data(docs).select("n_email").first()[0])

    run(100)
    half, n = run(50_000)
    whole, twice = run(100_000)
    assert (n, twice) == (50_000, 100_000) and whole < 20 and whole < 4 * half + 2
    keys = "".join(f"password={k:012d}abcd " for k in range(20_000))
    docs = spark.createDataFrame([(1, keys, "s", "en")], "doc_id long, text string, source string, lang string")
    took, row = seconds(lambda: secret_owners.secrets(docs).first())
    assert row["n_assign"] == 20_000 and took < 30

"""The registered queries against plain code over the whole small tables."""

import hashlib
import html
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pandas as pd
import public_tokenizers
import pytest
import xxhash
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from test_near_copies import all_links, roots
from tablescope.llm import (
    decontaminate,
    html_text,
    language,
    packing,
    pii,
    queries,
    secret_owners,
    simhash,
    token_spans,
    toxicity,
)

SF = "/root/testdata/sf0.001"


def read(name):
    return pd.read_parquet(f"{SF}/{name}.parquet")


@pytest.fixture(scope="module")
def docs():
    return read("documents").set_index("doc_id")


def run(spark, name):
    found = queries.queries()[name](spark, SF).toPandas()
    return found.set_index("page_id" if "page_id" in found else "doc_id")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text)


def small(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def digest(parts):
    return hashlib.sha256(",".join(parts).encode()).hexdigest()


def test_op1(spark, docs):
    import sentencepiece

    vocabulary = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    found = run(spark, "op1_fertility")
    assert len(found) == len(docs)
    for doc_id, text in docs.text.items():
        row, w = found.loc[doc_id], words(text)
        places = {}
        for k in range(len(w) - 7):
            places.setdefault(tuple(w[k : k + 8]), []).append(k)
        inside = {p + j for v in places.values() if len(v) > 1 for p in v for j in range(8)}
        lines = [x for x in text.split("\n") if words(x)]
        assert (row.n_words, row.word_chars, row.n_repeat_words) == (len(w), sum(map(len, w)), len(inside))
        assert row.n_symbols == sum(c in "#*$%&|<>" for c in text) and row.n_dup_lines == len(lines) - len(set(lines))
        assert row.base_failed == (len(w) < 20 or 100 * len(inside) > 30 * len(w))
        assert not (row.kept and row.base_failed)
        ids = vocabulary.encode(" ".join(text.split()))
        share = np.array(list(Counter(ids).values())) / len(ids)
        assert row.n_tokens == len(ids)
        assert row.entropy == pytest.approx(-(share * np.log2(share)).sum() / np.log2(max(2, len(ids))))
    good = read("labels").set_index("doc_id").join(found, how="inner")
    assert good[(good.quality == 1) & ~good.base_failed].kept.mean() > 0.9


def test_op2(spark, docs):
    found = run(spark, "op2_secret_owners")
    name = "(?:" + "|".join("".join(f"[{c}{c.upper()}]" for c in w) for w in ("password", "passwd", "secret", "token")) + "|[aA][pP][iI]_?[kK][eE][yY])"
    assign = re.compile(name + r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
    for doc_id, text in docs.text.items():
        spans = [(m.start(), 0, m.end()) for m in assign.finditer(text) if len(m[1]) >= 12]
        spans += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
        spans += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
        row = found.loc[doc_id]
        assert row.base_sha256 == digest(f"{secret_owners.KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans))
        assert (row.n_assign, row.n_access, row.n_hex) == tuple(sum(k == n for _, k, _ in spans) for n in range(3))


def test_op2_owners(spark):
    shared, own = "token=Qx7Rt2Lm9Zk4Vb6Nw", "token=Hy3Gs8Dp5Fc1Jm0Ba"
    key = "zK3mQ9xT7vB2nL5pR8wY4"
    rows = [(k, f"{shared} and 0123", f"s{k}", "en") for k in range(5)] + [(9, f"{own} {key}", "s9", "en")]
    rows += [(k, f"x {own}", "s9", "de") for k in (10, 11)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    found = secret_owners.secrets(docs).toPandas().set_index("doc_id")
    many = found.loc[range(5)]
    assert (many.n_copied == 1).all() and (many.n_live == 0).all()
    assert found.n_copied[9] == 0 and found.n_live[9] == 2 and found.n_key[9] == 1 and found.n_live[10] == 1
    # A value in very many repositories of one owner is copied as well.
    rows = [(k, own, "s9", f"r{k}") for k in range(secret_owners.SHARED_REPOS)]
    wide = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    few = secret_owners.secrets(wide.limit(secret_owners.SHARED_REPOS - 1)).toPandas()
    wide = secret_owners.secrets(wide).toPandas()
    assert (wide.n_copied == 1).all() and (wide.n_live == 0).all() and (few.n_copied == 0).all()
    assert found.spans[9] == f"assign:0:{len(own)},key:{len(own) + 1}:{len(own) + 1 + len(key)}"


def test_op3(spark, docs):
    found = queries.queries()["op3_packing"](spark, SF).toPandas()
    check_pieces(found, docs.text)
    sizes = found.groupby("sequence_id").length.sum()
    padding = (packing.LIMIT - sizes[(sizes & (sizes - 1)) != 0]).sum()
    assert padding < 0.03 * sizes.sum()


def check_pieces(found, texts):
    """Pieces cover the tokenizer's ids of every text, and lie without gaps in their sequences."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.default_vocabulary())
    by_id = dict(list(found.groupby("doc_id")))
    assert set(by_id) == set(texts.index)
    for doc_id, text in texts.items():
        ids = np.array([*tokenizer.encode(text, add_special_tokens=False).ids, 2], "<u4").tobytes()
        at = 0
        for row in by_id[doc_id].sort_values("start").itertuples():
            assert row.start == at and row.doc_tokens == len(ids) // 4
            assert row.ids_crc32 == zlib.crc32(ids[4 * at : 4 * (at + row.length)])
            at += row.length
        assert 4 * at == len(ids)
    placed = found.sort_values(["sequence_id", "offset"])
    assert (placed.groupby("sequence_id").length.cumsum() - placed.length == placed.offset).all()
    assert placed.groupby("sequence_id").length.sum().max() <= packing.LIMIT


def test_cut_is_optimal():
    rng = np.random.default_rng(3)
    for _ in range(20):
        places = sorted({int(x) for x in rng.integers(1, 3000, 60)} | set(range(400, 3001, 400)))
        penalties = [float(x) for x in rng.choice([0, 8, 64], len(places))]

        def price(cuts, places=places, penalties=penalties, limit=512):
            total, before = 0.0, 0
            for c in cuts:
                size = c - before
                total += penalties[places.index(c)] + packing.WINDOW_COST
                total += 0 if size in (256, 512) else limit - size
                before = c
            return total

        best = {0: (0.0, [])}
        for k, place in enumerate(places):
            choices = [best[p] for p in [0, *places[:k]] if place - p <= 512 and p in best]
            best[place] = min((price([*cuts, place]), [*cuts, place]) for _, cuts in choices)
        assert price(packing.cut(places, penalties, 512)) == best[places[-1]][0]


def test_word_encoder_equals_tokenizer():
    encoder = packing.WordEncoder(packing.default_vocabulary())
    texts = ["It's 3.14!  (don't) 'S we'LL\r\nOK?", "ÄÖÜ œuvre İstanbul ﬁ é x y", "<|endoftext|> a", "!!'s''t 12 ½ ²", "“q” – €5…", "\x85a\x1cb c", "ΑΣ ΑΣ.", ""]
    for text in texts:
        assert encoder.encode(text)[0] == np.array(encoder.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def test_op3_sentence_ends_in_any_text(spark):
    encoder = packing.WordEncoder(packing.default_vocabulary())
    for text in ("One two. Three four! Five?\nSix seven. Eight", "It's 3.14! (don't) be.\r\n\r\nOK? Yes."):
        ids, ends = encoder.encode(text)
        more, found = encoder.encode(text + " \u2122")
        assert more[: len(ids)] == ids and found[: len(ends)] == ends and len(ends) > 3
    for text, pieces in (
        ("Он пришёл домой. Она ушла! Кто там?", ["Он пришёл домой.", " Она ушла!"]),
        ("今日は雨です。明日は「晴れ。」と言う！終", ["今日は雨です。", "明日は「晴れ。」", "と言う！"]),
        ("Bonjour\xa0! Il pleut.\xa0Oui", ["Bonjour\xa0!", " Il pleut."]),
    ):
        ids, ends = encoder.encode(text)
        want = np.cumsum([len(encoder.tokenizer.encode(x, add_special_tokens=False).ids) for x in pieces])
        assert ends == want.tolist()
    # Documents of half a window and a bit: without cuts inside them, half of each window is padding.
    sentence = "Мы шли по длинной дороге к старому дому. "
    size = len(encoder.encode(sentence)[0]) // 4
    docs = spark.createDataFrame([(k, sentence * (2100 // size)) for k in range(60)], "doc_id long, text string").coalesce(1)
    sizes = packing.pack(docs).toPandas().groupby("sequence_id").length.sum()
    assert (packing.LIMIT - sizes[(sizes & (sizes - 1)) != 0]).sum() < 0.03 * sizes.sum()


def test_op4(spark, docs):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    found = run(spark, "op4_token_spans")
    for doc_id, text in docs.text.items():
        row = found.loc[doc_id]
        assert row.n_tokens == len(tokenizer.encode(text, add_special_tokens=False).ids)
        assert "".join(text[s["start"] : s["end"]] for s in row.sections) == text
        assert sum(s["tokens"] for s in row.sections) == row.n_tokens


def test_op4_rules(spark):
    # Sections cut the long word's tokens: bytes 0-2, 2-9 and the rest.
    docs = spark.createDataFrame([(1, "éxtraordinary words", [2, 9, 99, None])], "doc_id long, text string, cuts array<int>")
    ends = token_spans.Encoder(token_spans.default_vocabulary()).ends("éxtraordinary words").tolist()
    bounds = [0, 3, 10, 20]
    for rule in token_spans.RULES:
        row = token_spans.attribute(docs, rule, starts_col="cuts").first()
        want = [0.0] * 3
        for a, b in zip([0, *ends], ends, strict=False):
            part = [max(0, min(b, y) - max(a, x)) / (b - a) for x, y in zip(bounds, bounds[1:], strict=False)]
            if rule == "split":
                want = [w + p for w, p in zip(want, part, strict=True)]
            else:
                want[next(k for k, p in enumerate(part) if p) if rule == "first" else part.index(max(part))] += 1
        assert [s["tokens"] for s in row["sections"]] == pytest.approx(want)
        assert row["n_crossing"] == sum(b not in ends for b in bounds[1:-1])


def windows(items):
    found = {}
    for name, text in items:
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", small(text or ""))
        n = min(10, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            found.setdefault(tuple(w[k : k + n]), set()).add(str(name))
    return found


def test_op5(spark, docs):
    found = run(spark, "op5_decontaminate")
    bench = read("benchmark")
    look = windows(zip(bench.item_id, bench.text, strict=True))
    for doc_id, text in docs.text.items():
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", small(text))
        hit, items = set(), set()
        for n in {len(k) for k in look}:
            for k in range(len(w) - n + 1):
                if names := look.get(tuple(w[k : k + n])):
                    items |= names
                    hit.update(range(k, k + n))
        row = found.loc[doc_id]
        assert (row.n_words, row.n_hit, row.n_items, row.contaminated) == (len(w), len(hit), len(items), bool(hit))
        assert row.items_sha256 == digest(sorted(items))
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    sql = con.execute(queries.oracle_sql()["op5_decontaminate"]).df().set_index("doc_id")
    assert sql.loc[found.index, list(found.columns)].astype(str).equals(found.astype(str))


def test_op5_shards_and_short_items(spark):
    docs = spark.createDataFrame([(1, "a b c d e"), (2, "x A-B c"), (3, "q")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "b c"), (2, "C d E"), (10, "a"), (4, "z z")], "item_id long, text string")
    whole = decontaminate.contamination(docs, items).orderBy("doc_id").collect()
    parts = decontaminate.contamination(docs, items, shard_words=2).orderBy("doc_id").collect()
    assert whole == parts
    assert [(r["n_hit"], r["n_items"]) for r in whole] == [(5, 3), (3, 2), (0, 0)]
    nameless = items.select(F.lit(None).cast("long").alias("item_id"), "text")
    found = decontaminate.contamination(docs, nameless).orderBy("doc_id").collect()
    assert [(r["n_hit"], r["n_items"], r["contaminated"]) for r in found] == [(5, 0, True), (3, 0, True), (0, 0, False)]


def test_op6(spark):
    found = run(spark, "op6_toxicity")
    crc = pd.Series([zlib.crc32(str(k).encode()) % 5 == 0 for k in found.index], found.index)
    assert (found.held_out == crc).all() and found.score.between(0, 1).all()
    assert (found.predicted == (found.score >= 0.5)).all()
    # Held-out accuracy needs more than the smallest table's handful of toxic rows.
    folder = "/root/testdata/sf0.01"
    got = queries.queries()["op6_toxicity"](spark, folder).toPandas()
    got = got.merge(pd.read_parquet(f"{folder}/labels.parquet"), on="doc_id")
    held = got[got.held_out]
    assert (held.predicted == held.toxic).mean() > 0.95 and held[held.toxic == 1].predicted.mean() > 0.6


def test_grammar():
    grammar = toxicity.Grammar({"clown": 2.0}, {"lumph": 1.0})
    score = lambda text: grammar.features(text)[0]
    assert score("nice day") == 0 < score("not a clown") < score("he said clown") < score("a clown") < score("you clown")
    assert score("lumphish") > 0 and score("I will kill time") == 0 < score("I will not kill you") < score("kill you")
    assert score("I will kill you") == score("kill you") == score("you I will kill")
    assert score("clown you") == score("you clown") > score("you clown, he said")
    assert score("not here. a clown") == score("a clown")


def test_composed_grammar_equals_its_transducers_in_turn():
    grammar = toxicity.Grammar({}, {})
    rng = random.Random(11)
    kinds = [toxicity.INSULT, toxicity.THREAT, toxicity.TARGET, toxicity.NEGATION, toxicity.REPORT, None, None]
    for _ in range(300):
        clause = [(kind, rng.choice([0.5, 2.0]) if kind == toxicity.INSULT else 1.0) if kind else None
                  for kind in rng.choices(kinds, k=rng.randrange(9))]
        got = grammar.clause(clause)
        # One transducer after another, path by path.
        tapes = [([mark[0] if mark else toxicity.OTHER for mark in clause], 1.0)]
        for machine in grammar.transducers():
            tapes = [(out, w * more) for tape, w in tapes for out, more in machine.paths(tape)]
        chosen = [(next(k for k, s in enumerate(tape) if s.endswith("!")), w) for tape, w in tapes]
        assert got == pytest.approx(sum(w * clause[k][1] for k, w in chosen))
        # The rule in words: what each insult or threat counts.
        here = [mark[0] if mark else None for mark in clause]
        want = 0.0
        for k, mark in enumerate(clause):
            if mark and mark[0] in (toxicity.INSULT, toxicity.THREAT):
                near = toxicity.TARGET in here
                weight = mark[1] if mark[0] == toxicity.INSULT else grammar.threat * near
                weight *= 1 + grammar.target * near
                weight *= grammar.negated if toxicity.NEGATION in here[max(0, k - grammar.reach) : k] else 1
                want += weight * (grammar.reported if toxicity.REPORT in here else 1)
        assert got == pytest.approx(want)


def test_op7(spark, docs):
    found = run(spark, "op7_language")
    held = pd.Series([zlib.crc32(str(k).encode()) % 4 == 2 for k in found.index], found.index)
    assert (found.held_out == held).all() and found.score.between(0, 1).all()
    joined = found.join(docs.lang)
    assert (joined[held].lang_pred == joined[held].lang).mean() > 0.95


def test_bloom_filter_returns_every_language():
    fold = language.fold_table()
    grams = {name: np.unique(language.grams(text, fold)) for name, text in {"a": "hello world", "b": "hallo welt world"}.items()}
    masks = np.zeros(1 << 12, np.uint64)
    for k, found in enumerate(grams.values()):
        for slot in language.slots(found, 12):
            masks[slot] |= np.uint64(1 << k)
    model = language.Model(list(grams), masks)
    for k, found in enumerate(grams.values()):
        hit = masks[language.slots(found, 12)[0]] & masks[language.slots(found, 12)[1]]
        assert ((hit >> np.uint64(k)) & np.uint64(1)).all()
    assert model.predict(language.grams("Hello!", fold))[0] == "a" and model.predict(language.grams("12", fold)) == ("und", 0.0)


def test_op7_many_languages(spark):
    """More languages than one mask holds: each writes with words of its own."""
    alphabet = "abcdefghijklmnopqrstuvwxyz"
    words = [a + b + "x" + b + a for a in alphabet[:10] for b in alphabet[10:18]]
    rows = [(k, f"{word} " * 6, f"l{n:02}") for n, word in enumerate(words) for k in (4 * n, 4 * n + 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.fit(docs)
    assert len(model.languages) == 80 > language.PLANE and model.masks.shape[0] == 2
    found = language.identify(docs, model).join(docs.select("doc_id", "lang"), "doc_id")
    learned = docs.filter("crc32(cast(cast(doc_id as string) as binary)) % 4 != 2").select("lang").distinct()
    assert found.join(learned, "lang").filter("lang_pred != lang").count() == 0


def test_op7_script_with_many_ngrams(spark):
    """Five million n-grams of one language; its text with a few words of another one is still its own."""
    rng = np.random.default_rng(7)
    ids = [k for k in range(200) if zlib.crc32(str(k).encode()) % 4 != 2]
    large = ["".join(map(chr, rng.integers(0x4E00, 0x9F00, 250_000))) for _ in range(20)]
    rows = [(ids[k], large[k % 20], "zh") for k in range(60)]
    rows += [(k, "the quick brown fox jumps over the lazy dog", "en") for k in ids[60:70]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(8)
    model = language.fit(docs)
    assert model.wrong.max() < 0.1
    found = language.grams(large[3][:900] + " the quick brown fox jumps over the lazy dog", language.fold_table())
    name, score = model.predict(found)
    assert name == "zh" and 0.9 < score < 1


def test_op7_bounded_filter_keeps_the_most_frequent(spark, monkeypatch):
    monkeypatch.setattr(language, "FILTER_BYTES", 1 << 10)
    ids = [k for k in range(400) if zlib.crc32(str(k).encode()) % 4 != 2]
    rng = np.random.default_rng(3)
    rare = "".join(map(chr, rng.integers(0x4E00, 0x9F00, 5000)))
    often = "".join(map(chr, rng.integers(0x4E00, 0x9F00, 200)))
    rows = [(k, rare, "zh") for k in ids[:3]] + [(k, often, "zh") for k in ids[3:20]] + [(k, "hello world", "en") for k in ids[20:30]]
    with pytest.warns(UserWarning, match="typical of zh"):
        model = language.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert model.masks.shape == (1, 1 << 10) and model.wrong.max() < 0.3
    fold = language.fold_table()
    assert model.predict(language.grams(often, fold))[0] == "zh" and model.predict(language.grams("Hello World", fold))[0] == "en"


def luhn(number):
    digits = [int(c) * (1 + k % 2) for k, c in enumerate(reversed(number))]
    return sum(d - 9 if d > 9 else d for d in digits) % 10 == 0


def personal(text):
    spans = [("email", m) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    spans += [("ip", m) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if max(map(int, m[0].split("."))) < 256]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        number = re.sub("[^0-9]", "", m[0])
        if 16 <= len(number) <= 19 and luhn(number):
            spans.append(("card", m))
    spans += [("phone", m) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 8 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return [f"{kind}:{m.start()}:{m.end()}" for kind, m in spans]


def test_op8(spark, docs):
    odd = [
        "a@b.c_x@d.ee.f.. .x@y a@b@c.d 1.2.3.4.5.6.7.8 256.1.1.1 001.002.003.0004",
        "+1 (123) 555-7777 +12 +1+2 34567890 +49 170 1234567 - +1--------",
        "4111 1111 1111 1111 4111-1111 😀 4111111111111111 x é a@b.co 41111111111111112",
    ]
    frame = spark.createDataFrame(list(enumerate([*docs.text, *odd])), "doc_id long, text string")
    found = pii.personal_data(frame).toPandas().set_index("doc_id")
    for k, text in enumerate([*docs.text, *odd]):
        spans = personal(text)
        assert found.base_sha256[k] == digest(spans) and set(spans) <= set(found.spans[k].split(","))
        assert [found.loc[k, f"n_{n}"] for n in pii.BASE] == [sum(s.startswith(n) for s in spans) for n in pii.BASE]


def test_op8_accounts_scores_and_redaction(spark):
    text = "my iban DE89 3704 0044 0532 0130 00, not DE00 3704 0044 0532 0130 00; phone +49 170 1234567"
    docs = spark.createDataFrame([(1, text, 5)], "doc_id long, text string, n_chars long")
    row = pii.personal_data(docs).first()
    assert row["spans"] == "phone:76:91,iban:8:35" and row["scores"] == "80,100" and row["n_iban"] == 1
    new = pii.redact(docs).first()
    assert new["text"] == "my iban [IBAN], not DE00 3704 0044 0532 0130 00; phone [PHONE]" and new["n_chars"] == len(new["text"])


def test_op9(spark):
    found = run(spark, "op9_html_text")
    for row in read("pages").itertuples():
        article = re.search("<article>(.*)</article>", row.html, re.S)[1]
        blocks = (re.sub("<[^>]*>", "", b) for b in re.split("</?(?:p|h1)>", article))
        lines = (" ".join(html.unescape(b).split()) for b in blocks)
        assert found.text[row.page_id] == "\n".join(x for x in lines if x)


def test_op9_region():
    weights = html_text.Weights({("w", "div.x"): 0.9, ("t", "div.x"): 0.9})
    page = "<div class=ad>buy it now</div><script>x('</p>')</script><p>Main text &lt;here&gt; is\tlong.</p><div class=x>More of it</div>"
    assert html_text.extract(page, weights) == "Main text <here> is long.\nMore of it"


@pytest.mark.parametrize(
    "page",
    [
        "<div class='layout has-sidebar'><article><p>{}</p></article><div class=sidebar>buy it now</div></div>",
        "<main class='main with-sidebar'><p>{}</p></main><div class='site-footer'>legal</div>",
        "<article class='post comment-status-open'><p>{}</p></article><div class='comments'><article>no</article></div>",
        "<div class=sidebar><div class=widget>ad</div><main><p>{}</p></main></div>",
        "<div class=sidebar><p>{}</p></div>",
        "<article><p>{}</p><select><option>a</article>",
        "<video src=x><p>{}</p>",
    ],
)
def test_op9_class_names_keep_the_text(page):
    text = "The main text of the page has quite a few words."
    assert html_text.extract(page.format(text), html_text.Weights()).split("\n")[0] == text
    assert "no" not in html_text.extract(page.format(text), html_text.Weights()).split()


LONG_P = "<p>" + "The main text of the page has quite a few words. " * 20 + "</p>"
EDGES = [
    LONG_P + "<ul>" + "".join(f"<li>w{k}</li>" for k in range(10)) + "</ul>",
    LONG_P + "<table>" + "".join(f"<tr><td>c{k}</td><td>d{k}</td></tr>" for k in range(60)) + "</table>",
    "<ul>" + "".join(f"<li>w{k}</li>" for k in range(10)) + "</ul>" + LONG_P,
    "<p>An intro.</p><table>" + "".join(f"<tr><td>c{k}</td></tr>" for k in range(60)) + "</table>" + LONG_P,
    LONG_P + "<figure><img src=a><img src=b><img src=c><figcaption>Three</figcaption></figure><p>End.</p>",
    "<h1>Title</h1><section><p>A.</p><section><dl><dt>x</dt><dd>y</dd></dl></section></section>" + LONG_P + "<pre>z</pre>",
]


@pytest.mark.parametrize("fitted", [False, True])
@pytest.mark.parametrize("k", range(len(EDGES)))
def test_op9_keeps_the_edges_of_an_article(spark, k, fitted):
    weights = html_text.fit(spark.read.parquet(f"{SF}/pages.parquet")) if fitted else html_text.Weights()
    around = "<nav><a href=x>Home</a></nav><div class=content>{}</div><footer>legal words of the site</footer>"
    for page in (f"<header>Site</header><article>{EDGES[k]}</article><footer>legal words</footer>", around.format(f"<main>{EDGES[k]}</main>")):
        shown = re.sub(r"<(/?)(p|li|td|tr|table|ul|figure|figcaption|h1|section|dl|dt|dd|pre)>", "\n", EDGES[k])
        lines = [" ".join(x.split()) for x in re.sub("<[^>]*>", "", shown).split("\n")]
        assert html_text.extract(page, weights) == "\n".join(x for x in lines if x)


@given(st.data())
def test_op9_generated_pages(data):
    kinds = ["<p>{}</p>", "<ul><li>{}</li><li>{}</li></ul>", "<table><tr><td>{}</td><td>{}</td></tr></table>", "<h2>{}</h2>",
             "<figure><img src=i><figcaption>{}</figcaption></figure>", "<section><p>{}</p><blockquote>{}</blockquote></section>"]
    n, lines, parts = 0, [], []
    for kind in data.draw(st.lists(st.sampled_from(kinds), min_size=1, max_size=8)):
        texts = []
        for _ in range(kind.count("{}")):
            n += 1
            texts.append(f"t{n} " + "word " * data.draw(st.integers(0, 30)))
        lines += [x.strip() for x in texts]
        parts.append(kind.format(*texts))
    page = f"<nav><ul><li><a>Home</a></li></ul></nav><article>{''.join(parts)}</article><aside>related words</aside>"
    assert html_text.extract(page, html_text.Weights()) == "\n".join(lines)


def test_op9_short_end_without_labels():
    page = f"<div class=content>{LONG_P}<p>Short end.</p></div>"
    assert html_text.extract(page, html_text.Weights()).endswith("Short end.")


def test_op9_drops_no_shown_text():
    page = "<article><p>Given that <math><mi>x</mi><mo>=</mo><mn>2</mn></math> we see it.</p><noscript>all plain words</noscript><object>and more of it</object></article>"
    assert html_text.extract(page, html_text.Weights()) == "Given that x=2 we see it.\nall plain wordsand more of it"
    page = "<article><p>One two three</p><svg><text>no</text></svg><textarea>no</textarea><div class='cookie-notice'>no</div></article>"
    assert html_text.extract(page, html_text.Weights()) == "One two three"


def fingerprint(text):
    w = words(small(text))
    shingles = [" ".join(w[k : k + 3]) for k in range(max(1, len(w) - 2))] if w else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def smallest(prints, radius=3):
    """Component ids by comparing all pairs."""
    root = {k: k for k in prints}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    keys = sorted(prints)
    for x, a in enumerate(keys):
        for b in keys[:x]:
            if bin(prints[a] ^ prints[b]).count("1") <= radius:
                a_, b_ = sorted((find(a), find(b)))
                root[b_] = a_
    return {k: find(k) for k in keys}


@pytest.mark.parametrize(("leaf", "block"), [(simhash.LEAF, simhash.BLOCK), (8, 1000), (16, 5)])
def test_op10(spark, docs, leaf, block):
    found = simhash.near_duplicates(spark.read.parquet(f"{SF}/documents.parquet"), leaf=leaf, block=block)
    found = found.toPandas().set_index("doc_id")
    prints = {k: fingerprint(t) for k, t in docs.text.items()}
    want = smallest(prints)
    assert {k: int(v, 16) for k, v in found.fingerprint.items()} == prints
    assert found.component_id.to_dict() == want


def test_routing_meets_every_pair_once():
    rng = np.random.default_rng(1)
    fps = np.unique(rng.integers(0, 1 << 63, 60, dtype=np.uint64)[:, None] ^ (np.uint64(1) << rng.integers(0, 64, (1, 12)).astype(np.uint64)))
    levels = simhash.plan_levels(fps, len(fps), 3, 20)
    code, role, routed = simhash.route(fps, levels, len(fps), 3, 20)
    met = Counter()
    for leaf in np.unique(code):
        at = np.flatnonzero(code == leaf)
        for x, i in enumerate(at):
            for j in at[:x]:
                if role[i] == role[j] == 0 or role[i] != role[j]:
                    met[tuple(sorted((int(routed[i]), int(routed[j]))))] += 1
    near = [(int(a), int(b)) for a in fps for b in fps if a < b and bin(int(a) ^ int(b)).count("1") <= 3]
    assert len(levels) > 3 and near and all(met[p] == 1 for p in near)


def test_pipeline(spark, docs):
    """The stages one by one in plain code, with the scores of the learned model."""
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "simhash", "decontaminate", "pii", "packing"]
    found = corpus_pipeline.run(spark, SF).toPandas()
    frame = spark.read.parquet(f"{SF}/documents.parquet")
    model = toxicity.fit(frame, spark.read.parquet(f"{SF}/labels.parquet"))
    texts = {k: t for k, t in docs.text.items() if model.score(t) < 0.5}
    first = roots(texts, all_links(texts))
    texts = {k: t for k, t in texts.items() if first[k] == k}
    bench = read("benchmark")
    look = windows(zip(bench.item_id, bench.text, strict=True))
    plain = {}
    for k, text in texts.items():
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", small(text))
        if not any(tuple(w[a : a + n]) in look for n in {len(x) for x in look} for a in range(len(w) - n + 1)):
            at, out = 0, []
            for kind, a, b in sorted((s.split(":") for s in personal(text)), key=lambda s: (int(s[1]), int(s[2]))):
                if int(a) >= at:
                    out += [text[at : int(a)], f"[{kind.upper()}]"]
                at = max(at, int(b))
            plain[k] = "".join(out) + text[at:]
    assert 0 < len(plain) < len(docs)
    check_pieces(found, pd.Series(plain))

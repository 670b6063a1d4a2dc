"""Language identification, surrogates and the pipeline."""

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from seqweave.llm import langid, pii, queries

SYLLABLES = {"en": "th er on an in ed re the and ing".split(), "fr": "ou eau que é ai oi ment le ré".split(), "de": "ch sch ei ung en ü ß und der".split()}


def text_in(lang, rng, n=60):
    return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randint(1, 4))) for _ in range(n))


@pytest.fixture(scope="module")
def labelled(spark):
    rng = random.Random(1)
    rows = [(i, text_in(lang, rng, rng.randint(5, 90)), lang, f"{lang}.host" if rng.random() < 0.7 else "mixed") for i in range(600) for lang in [rng.choice(list(SYLLABLES))]]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").cache()


def test_held_out_accuracy(labelled):
    model = langid.fit(labelled.filter("doc_id < 300"))
    held = labelled.filter("doc_id >= 300")
    got = langid.identify(held, model, "doc_id", "text").join(held.select("doc_id", "lang"), "doc_id")
    assert got.filter("language = lang").count() / got.count() > 0.98
    assert got.filter("not kept").count() == 0


def test_evidence_is_fused(spark, labelled):
    model = langid.fit(labelled)
    rows = [(1000, "a b", "de", "fr.host"), (1001, "a b", None, "fr.host"), (1002, text_in("en", random.Random(2)), "de", "de.host"), (1003, "12 %% 34", "en", "en.host"), (1004, None, None, None), (1005, "", "en", None), (None, text_in("fr", random.Random(3)), "xx-YY", "x")]
    df = labelled.unionByName(spark.createDataFrame(rows, labelled.schema)).withColumn("language", F.lit("clash"))
    got = {r["doc_id"]: r for r in langid.identify(df, model, "doc_id", "text", declared=F.col("lang"), host=F.col("source"), suffix=F.element_at(F.split("source", r"\."), -1), parent=F.lit(None).cast("string")).collect()}
    assert got[1001]["language"] == "fr"  # the host decides
    assert got[1002]["language"] == "en"  # the text does
    assert not got[1003]["kept"] and not got[1004]["kept"] and not got[1005]["kept"] and got[1004]["probability"] is None
    assert got[None]["language"] == "fr"


def plain_fusion(rows, model, kappa=langid.KAPPA, wrong=langid.WRONG):
    """(language, probability) of (text, declared, suffix, host, parent) rows: all evidence added up in plain loops."""
    langs = model.languages
    n, known = len(langs), [x for x in langs if x != langid.UND]
    prior = [math.log(langid.UND_PRIOR if x == langid.UND else (1 - langid.UND_PRIOR) / (n - 1)) for x in langs]

    def softmax(logs):
        top = max(logs)
        e = [math.exp(x - top) for x in logs]
        return [x / sum(e) for x in e]

    evidence = [model.evidence(r[0]) for r in rows]
    alone = [None if e is None else softmax([a + b for a, b in zip(e, prior, strict=True)]) for e in evidence]

    def counts(of):
        out = defaultdict(lambda: [0.0] * n)
        for r, p in zip(rows, alone, strict=True):
            if p is not None and of(r) is not None:
                out[of(r)] = [a + b for a, b in zip(out[of(r)], p, strict=True)]
        return out

    everything = counts(lambda r: 0).get(0, [0.0] * n)
    base = [(x + math.exp(p)) / (sum(everything) + 1) for x, p in zip(everything, prior, strict=True)]
    smooth = lambda c, towards: [(x + kappa * t) / (sum(c) + kappa) for x, t in zip(c, towards, strict=True)]
    says, suffixes, parents, hosts = counts(lambda r: r[1] if r[1] in known else None), counts(lambda r: r[2]), counts(lambda r: r[4] if r[3] is not None else None), counts(lambda r: (r[3], r[4]) if r[3] is not None else None)
    out = []
    for (_, declared, suffix, host, parent), e in zip(rows, evidence, strict=True):
        if e is None:
            out.append((langid.UND, None))
            continue
        logs = list(e)
        for i, lang in enumerate(langs):
            if declared in known:
                logs[i] += math.log((says[declared][i] + kappa * ((1 - wrong) if declared == lang else wrong / len(known))) / (sum(c[i] for c in says.values()) + kappa))
            if suffix is not None:
                logs[i] += math.log(smooth(suffixes[suffix], base)[i] / base[i])
            above = base if parent is None else smooth(parents[parent], base)
            logs[i] += math.log(base[i] if host is None else smooth(hosts[host, parent], above)[i])
        p = softmax(logs)
        out.append((langs[max(range(n), key=lambda i: p[i])], max(p)))
    return out


def test_fusion_equals_plain_loops(spark, labelled):
    """Text, declaration, suffix, host and parent, alone and together, null and missing."""
    rng = random.Random(6)
    model = langid.fit(labelled.filter("doc_id < 300"))
    rows = []
    for _ in range(250):
        lang = rng.choice(list(SYLLABLES))
        text = rng.choice([text_in(lang, rng, rng.randint(1, 12)), " ".join(rng.choice("abcdefghijklm") for _ in range(6)), "", None, "12"])
        host = rng.choice([None, f"{lang}.host", "a.com", "b.com", "rare"])
        rows.append((text, rng.choice([None, lang, lang, rng.choice(list(SYLLABLES)), "xx"]), rng.choice([None, lang, "com"]), host, rng.choice([None, "com"]) if host in ("a.com", "b.com") else None))
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "doc_id long, text string, declared string, suffix string, host string, parent string")
    got = langid.identify(df, model, "doc_id", "text", declared=F.col("declared"), suffix=F.col("suffix"), host=F.col("host"), parent=F.col("parent")).collect()
    want = plain_fusion(rows, model)
    for r in got:
        language, probability = want[r["doc_id"]]
        if language == langid.UND and rows[r["doc_id"]][1] == "xx" and probability is not None:
            language = "xx"
        assert r["language"] == language and (r["probability"] is None) == (probability is None)
        assert probability is None or abs(r["probability"] - probability) < 1e-6
    assert len(got) == 250 and len({r["language"] for r in got}) >= 4


def test_no_label_is_evidence_for_what_it_was_fitted_to(labelled):
    model = langid.fit(labelled, sample=50)
    told = labelled.select("lang", langid.unseen(model, "doc_id", "lang").alias("seen"))
    assert told.filter("seen is null").groupBy("lang").count().filter("count <> 50").count() == 0
    assert told.filter("seen <> lang").count() == 0 and told.filter("seen is not null").count() == 600 - 150


def test_counts_are_those_of_the_texts(spark, labelled):
    model = langid.fit(labelled, sample=10**6)
    found = {}
    for r in labelled.collect():
        np.add.at(found.setdefault(r["lang"], np.zeros(langid.BUCKETS)), langid.trigrams(r["text"]), 1)
    assert np.array_equal(model.table, langid.Model(found).table)


def test_keys_that_repeat(spark, labelled):
    """Where a key has most rows, its hash says little about the others' order."""
    df = labelled.withColumn("doc_id", F.when(F.col("doc_id") % 3 > 0, 7).otherwise(F.col("doc_id")))
    assert langid.fit(df, sample=20).languages == ["de", "en", "fr", langid.UND]


def test_pages(spark, folder, tmp_path):
    """All four kinds of evidence on pages, and edge cases: no html, no text, tags only, very long, no host."""
    rng = random.Random(2)
    body = lambda lang, n=80: " ".join(f"<p>{text_in(lang, rng, 10)}</p>" for _ in range(n // 10))
    rows = [(i, f"http://{lang}.example.{lang}/x/{i}", f'<!DOCTYPE html><html lang="{lang}-XX"><script>the the the</script>{body(lang)}') for i in range(60) for lang in [rng.choice(list(SYLLABLES))]]
    rows += [(100, None, None), (101, "http://de.example.de/", ""), (102, "http://fr.example.fr/", "<html><p></p>"), (103, "no host", body("fr")), (104, "http://en.example.en/", body("en", 30_000)), (None, "http://x/", "<p>12</p>"), (105, "http://de.example.de/q", "<p>a b</p>")]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    labelled_rows = [(i, text_in(lang, rng, 60), lang, "s", 1) for i in range(200) for lang in [rng.choice(list(SYLLABLES))]]
    spark.createDataFrame(labelled_rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["page_id"]: r for r in queries.language_id_pages(spark, str(tmp_path)).collect()}
    assert len(got) == len(rows)
    assert all(got[i]["language"] == url[7:9] and got[i]["kept"] for i, url, _ in rows[:60])
    assert not any(got[i]["kept"] for i in (100, 101, 102, None)) and got[103]["language"] == "fr" and got[104]["language"] == "en" and got[105]["language"] == "de"


def test_noise_is_no_language(spark, labelled):
    model = langid.fit(labelled)
    rng = random.Random(4)
    noise = " ".join("".join(rng.choice("qxzjkvwyQXZJ") for _ in range(9)) for _ in range(80))
    got = langid.identify(spark.createDataFrame([(1, noise)], "doc_id long, text string"), model, "doc_id", "text").first()
    assert got["language"] == langid.UND and not got["kept"]


def test_rare_languages_are_kept(spark, labelled):
    """A language of few rows among many has a model, declared or not; one without any model isn't rejected if declared."""
    greek = lambda rng: " ".join("".join(rng.choice("αβγδεζηθικλμνξοπρστυφχψω") for _ in range(6)) for _ in range(60))
    russian = lambda rng: " ".join("".join(rng.choice("абвгдежзиклмнопрст") for _ in range(6)) for _ in range(60))
    rng = random.Random(8)
    many = labelled.crossJoin(spark.range(10)).select((F.col("doc_id") + 1000 * F.col("id")).alias("doc_id"), "text", "lang", "source")
    rows = [(20_000 + i, greek(rng), "el", "h") for i in range(6)] + [(20_100, greek(rng), None, "h"), (20_200, russian(rng), "ru-RU", "h"), (20_300, " 12 ", "ru", "h")]
    df = many.unionByName(spark.createDataFrame(rows, labelled.schema))
    model = langid.fit(df, sample=100)
    assert model.languages == ["de", "el", "en", "fr", langid.UND]
    got = {r["doc_id"]: r for r in langid.identify(df, model, "doc_id", "text", declared=F.col("lang"), host=F.col("source")).filter("doc_id >= 20000").collect()}
    assert all(got[i]["kept"] and got[i]["language"] == "el" for i in (*range(20_000, 20_006), 20_100))
    assert got[20_200]["kept"] and got[20_200]["language"] == "ru"
    assert not got[20_300]["kept"] and got[20_300]["language"] == langid.UND


def test_without_labels_or_rows(spark, docs, none, folder):
    model = langid.fit(docs.withColumn("lang", F.lit(None).cast("string")))
    assert model.languages == [langid.UND]
    got = langid.identify(docs, model, "doc_id", "text")
    assert got.filter("kept").count() > 100
    assert queries.op6_language_id(spark, str(folder / "none")).count() == 0
    assert queries.op6_language_id(spark, str(folder / "all")).count() == docs.count()


# Surrogates -----------------------------------------------------------------------------------------------------------

PRIVATE = "Write to Ann.12@mail7.example.com or +1 (017) 555-7713, card 4111111111111111 or 9807915762804490, host 97.51.17.173. token = \"b44e15e09fd311c3cf3163b66d5a9875b883d8ce\" SSN 123-45-6789, DE89370400440532013000. Frau Weber met Mr. John Smith; Smith and Weber left. ann.12@MAIL7.example.com"
SECRETS = ["ann.12@mail7", "(017) 555-7713", "4111111111111111", "9807915762804490", "97.51.17.173", "b44e15e09fd311c3cf3163b66d5a9875b883d8ce", "123-45-6789", "370400440532013000", "weber", "smith", "john"]


def test_surrogates(spark):
    clean = "Version 4.0 of 12 items, 3.14 and 1999-2001. The mr of it."
    rows = [(1, PRIVATE), (2, PRIVATE), (3, clean), (4, None), (5, ""), (6, "und.34@mail7.example.com! UND.34@MAIL7.EXAMPLE.COM"), (None, "Herr Иванов")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_entities", F.lit("clash"))
    got = {r["doc_id"]: r for r in pii.replace_pii(df).collect()}
    new = got[1]["text"]
    assert new == got[2]["text"] and got[1]["n_entities"] == 14
    assert not [s for s in SECRETS if s in new.lower()]
    assert got[3]["text"] == clean and got[4]["text"] is None and got[5]["text"] == "" and got[4]["n_entities"] == 0
    m = re.match(r"Write to (\S+@\S+) or \+1 \((\d{3})\) (\d{3}-\d{4}), card (\d{16}) or (\d{16}), host (\d+\.\d+\.\d+\.\d+)\. token = \"([0-9a-f]{40})\" SSN (\d{3}-\d\d-\d{4}), DE\d{20}\. Frau (\w+) met Mr\. (\w+) (\w+); (\w+) and (\w+) left\. (\S+)$", new)
    assert m, new
    assert m[9] == m[13] and m[11] == m[12] and m[9][0].isupper()
    assert m[1].lower() == m[14].lower()  # one address, however it is written
    assert pii._luhn(m[4])
    a, b = re.findall(r"\S+@[\w.]+", got[6]["text"])
    assert b == a.upper()
    assert pii.script_of(got[None]["text"].split()[1]) == "cyrillic"
    assert not pii.find(clean)


def test_first_names_keep_gender():
    he = {pii.draw_surrogate("given:m", n, 0, "k") for n in ("john", "peter", "hans")}
    she = {pii.draw_surrogate("given:f", n, 0, "k") for n in ("ann", "eve", "mary")}
    assert all(n.endswith("a") for n in she) and not any(n.endswith("a") for n in he)


@pytest.mark.parametrize("exceptions", [20_000, 0])
def test_distinct_names(spark, exceptions):
    """All names stay distinct and go on, over both ways to look exceptions up."""
    names = [f"N{'abcdefghij'[i % 10]}{'abcdefghij'[i // 10]}x" for i in range(60)]
    spark_rows = [(i, f"Mr {n} wrote; {n} left") for i, n in enumerate(names)] + [(100, f"Mr {names[0]}"), (101, "Herr S7")]
    df = spark.createDataFrame(spark_rows, "doc_id long, text string")
    found = pii.entities(df)
    assert found.count() == len({n.lower() for n in names}) + 1
    out = {r["doc_id"]: r["text"] for r in pii.replace_pii(df, exceptions=exceptions).collect()}
    new = [out[i].split()[1].rstrip(";") for i in range(60)]
    assert len({x.lower() for x in new}) == 60 and out[100].split()[1] == new[0]
    assert all(out[i].split()[-2] == new[i] for i in range(60))


@pytest.mark.parametrize("exceptions", [20_000, 0])
def test_one_person_whatever_the_title(spark, exceptions):
    """A given name's gender is decided once for each document, and by the others where its own titles tell none."""
    rows = [(1, "Mr John Smith met Dr John Smith. John left. Dr Mary Bell and Mary."), (2, "Prof John Smith, Frau Mary Bell"), (3, "Dr Mary Bell. Dr Kim Bell"), (4, "Mrs Kay Smith-O'Neil; Kay Smith-O'Neil's hat; Smith-O'Neil")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["text"] for r in pii.replace_pii(df, key="k", exceptions=exceptions).collect()}
    m = re.fullmatch(r"Mr (\w+) (\w+) met Dr (\w+) (\w+)\. (\w+) left\. Dr (\w+) (\w+) and (\w+)\.", got[1])
    assert m[1] == m[3] == m[5] and m[2] == m[4] and m[6] == m[8]
    n = re.fullmatch(r"Prof (\w+) (\w+), Frau (\w+) (\w+)", got[2])
    o = re.fullmatch(r"Dr (\w+) (\w+)\. Dr (\w+) (\w+)", got[3])
    assert (n[1], n[2], n[4]) == (m[1], m[2], m[7]) and n[3] == m[6] == o[1] and n[3].endswith("a") and not m[1].endswith("a") and o[2] == o[4] == m[7]
    p = re.fullmatch(r"Mrs (\w+) (\w+); (\w+) (\w+)'s hat; (\w+)", got[4])
    assert p[1] == p[3] and p[2] == p[4] == p[5]


def planted(rng):
    """A text, and the (begin, end, kind) of the entities in it."""
    digits = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    word = lambda a, b: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(a, b)))
    kinds = {
        "email": lambda: f"{word(1, 9)}.{digits(2)}@{word(2, 8)}.example.com", "phone": lambda: f"+{rng.randint(1, 99)} ({digits(3)}) {digits(3)}-{digits(4)}", "account": lambda: next(x for x in iter(lambda: "4" + digits(15), None) if pii._luhn(x)), "ssn": lambda: f"{digits(3)}-{digits(2)}-{digits(4)}",
        "ip": lambda: ".".join(str(rng.randint(0, 255)) for _ in range(4)), "secret": lambda: "".join(rng.choice("0123456789abcdef") for _ in range(39)) + "f", "iban": lambda: "DE" + digits(20), "surname": lambda: word(3, 8).capitalize(),
    }
    text, places = "", []
    for _ in range(rng.randint(0, 30)):
        text += " ".join(word(1, 8) for _ in range(rng.randint(1, 5))) + " "
        kind = rng.choice(list(kinds))
        what = kinds[kind]()
        text += "Herr " if kind == "surname" else ""
        places.append((len(text), len(text) + len(what), kind))
        text += what + rng.choice([" ", ", ", ". ", "; ", " - "])
    return text + "end", places


def test_surrogates_of_planted_entities(spark):
    """Held against places known beforehand: all else stays, forms stay, and over the corpus the same entity, however it is
    written, has the same surrogate and different ones have different ones."""
    rng = random.Random(12)
    texts = [planted(rng) for _ in range(120)]
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(texts)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in pii.replace_pii(df, key="k").collect()}
    surrogate = {}
    shape = lambda x: re.sub(r"[a-z]+", "a", re.sub(r"[A-Z][a-z]*", "A", re.sub(r"\d", "0", x)))
    for i, (text, places) in enumerate(texts):
        assert [(a, b, k) for a, b, k, _ in pii.find(text)] == places and got[i]["n_entities"] == len(places)
        new, at, rest = got[i]["text"], 0, 0
        for j, (a, b, kind) in enumerate(places):
            before = text[rest:a]
            assert new.startswith(before, at)
            at += len(before)
            stop = text[b : places[j + 1][0] if j + 1 < len(places) else len(text)]
            end = new.index(stop, at)
            old, drawn = text[a:b], new[at:end]
            assert surrogate.setdefault((kind, old.lower()), drawn.lower()) == drawn.lower() and drawn.lower() != old.lower()
            if kind in ("phone", "account", "ssn", "iban"):
                assert shape(drawn) == shape(old)
            if kind in ("phone", "iban"):
                assert drawn.split()[0][:2] == old.split()[0][:2]
            if kind == "account":
                assert pii._luhn(drawn) == pii._luhn(old)
            if kind == "secret":
                assert len(drawn) == len(old) and re.fullmatch("[0-9a-f]+", drawn)
            at, rest = end, b
        assert new[at:] == text[rest:]
    assert len(set(surrogate.items())) == len(surrogate) == len({(k, s) for (k, _), s in surrogate.items()})
    assert not {s for s in surrogate.values()} & {n for _, n in surrogate}


def test_long_numbers_are_no_accounts_unless_something_says_so():
    numbers = {x: [k for *_, k, _ in pii.find(x)] for x in ("at 4111111111111111 it", "at 4111111111111112 it", "Konto-Nr. 4111111111111112", "account number: 9807915762804490", "card 4111111111111112 or 9807915762804491", "4111 1111 1111 1112", "n 9807915762804490, 9807915762804491", "no account here, far from it and all that: 9807915762804490")}
    assert list(numbers.values()) == [["account"], [], ["account"], ["account"], ["account", "account"], ["account"], [], []]


def test_long_texts_without_blanks():
    import time

    began = time.perf_counter()
    for text in ("x" * 10_000_000, "ab." * 300_000, "g1" * 500_000, "@" * 300_000, "a@" * 300_000, "key=" * 200_000, "a-" * 300_000, "f" * 1_000_000 + "z", "1." * 300_000):
        assert pii.find(text) == []
    assert len(pii.find("Mr Abc Def " * 20_000)) == 40_000
    assert time.perf_counter() - began < 60


def test_key_from_configuration(spark):
    df = spark.createDataFrame([(1, "card 4111111111111111")], "doc_id long, text string")
    text = lambda: pii.replace_pii(df).first()["text"]
    assert text() != text()
    spark.conf.set(pii.KEY_SETTING, "of the house")
    try:
        assert text() == text() == pii.replace_pii(df, key="of the house").first()["text"]
    finally:
        spark.conf.unset(pii.KEY_SETTING)


def test_draws_until_distinct(spark):
    rows = [("ip", f"1.2.3.{i}") for i in range(50)] + [("given:m", "a" * i) for i in range(1, 200)]
    again = pii.drawn_again(spark.createDataFrame(rows, "kind string, norm string"), "k")
    attempt = {(r["kind"], r["norm"]): r["attempt"] for r in again.collect()}
    final = {(k, pii.draw_surrogate(k, n, attempt.get((k, n), 0), "k")) for k, n in rows}
    assert len(final) == len(rows) and not final & set(rows)


def test_surrogates_of_edge_cases(spark, docs, none, folder):
    assert queries.op8_pii(spark, str(folder / "all")).count() == docs.count()
    assert queries.op8_pii(spark, str(folder / "none")).count() == 0


# Pipeline -------------------------------------------------------------------------------------------------------------


def plain_single(rows):
    """(doc_id, text) of one row of each component of texts that share four fifths of their shingles, by comparing all."""
    words = [[w.decode() for w in (r["text"] or "").encode().lower().split()] for r in rows]
    sets = [{" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set() for w in words]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for j in range(len(rows)):
        for i in range(j):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                root[find(j)] = find(i)
    first = {}
    for i, r in enumerate(rows):
        rank = (r["doc_id"] is None, r["doc_id"] or 0, np.uint64(xxhash.xxh64_intdigest((r["text"] or "").encode(), 42)).view(np.int64))
        first[find(i)] = min(first.get(find(i), (rank, r["doc_id"], r["text"])), (rank, r["doc_id"], r["text"]))
    return sorted(repr(x[1:]) for x in first.values())


def test_pipeline(spark, docs, rows, folder):
    """Each stage on what the one before it kept, held against plain versions."""
    sf_dir = str(folder / "all")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["language_id", "near_duplicates", "personal_data", "mixing", "packing"]
    now = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kept = stages["language_id"](spark, now, sf_dir).collect()
    letters = [r for r in rows if re.search(r"[^\W\d_]", r[1] or "")]
    assert sorted(repr(tuple(r)) for r in kept) == sorted(map(repr, letters))
    now = spark.createDataFrame(kept, now.schema)
    single = stages["near_duplicates"](spark, now, sf_dir).collect()
    assert sorted(repr((r["doc_id"], r["text"])) for r in single) == plain_single(kept)
    now = spark.createDataFrame(single, now.schema)
    spark.conf.set(pii.KEY_SETTING, "k")
    try:
        private = stages["personal_data"](spark, now, sf_dir)
        assert private.columns == corpus_pipeline.COLUMNS
        want = {(r["doc_id"], r["text"]): (pii.rewrite(r["text"], {}, set(), "k")[0] if r["text"] else r["text"]) for r in single}
        got = {(r["doc_id"], r["text"]) for r in private.collect()}
        assert got == {(d, t) for (d, _), t in want.items()}
        mixed = stages["mixing"](spark, private, sf_dir).cache()
    finally:
        spark.conf.unset(pii.KEY_SETTING)
    assert mixed.columns == corpus_pipeline.COLUMNS and mixed.filter("n_chars <> length(text)").count() == 0
    n_words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    total = sum(n_words(t) for _, t in got)
    out = mixed.collect()
    assert abs(sum(n_words(r["text"]) for r in out) - 1.5 * total) <= 4 and total > 0
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    packed = stages["packing"](spark, mixed, sf_dir).collect()
    assert sum(r["length"] for r in packed) == sum(len(tokenizer.encode(r["text"] or "", add_special_tokens=False).ids) + 1 for r in out)
    per = Counter()
    for r in packed:
        per[r["sequence_id"]] += r["length"]
    assert all(n <= 2048 and n & (n - 1) == 0 for n in per.values())
    assert corpus_pipeline.run(spark, sf_dir).count() > 0
    assert corpus_pipeline.run(spark, str(folder / "none")).count() == 0

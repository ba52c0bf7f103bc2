"""Languages by fused evidence."""

from __future__ import annotations

import math
import random
import time

import pytest
from pyspark.sql import functions as F

from utilscope.llm.language_id import (
    Settings, TooManyLanguages, document_evidence, identify_languages, keep_identified, language_code, page_evidence,
)

SCHEMA = "key long, text string, declared string, suffix string, host string, domain string"
EN = "the quick brown fox and the lazy dog were there with that thing"
DE = "der schnelle braune fuchs und der faule hund waren nicht mit dem ding"


def rows(spark, extra):
    base = [(i, f"{EN} {i}", "en", "com", "a.x.com", "x.com") for i in range(20)]
    base += [(100 + i, f"{DE} {i}", "de", "de", "b.y.de", "y.de") for i in range(20)]
    return spark.createDataFrame(base + extra, SCHEMA)


def test_text_wins_over_a_wrong_declaration_and_evidence_decides_where_text_is_thin(spark):
    extra = [(1000, DE, "en", "com", "a.x.com", "x.com"), (1001, "i", "de", "de", "b.y.de", "y.de"),
             (1002, "i", None, None, "b.y.de", "y.de"), (1003, "i", None, None, "new.y.de", "y.de")]
    got = {r["key"]: r for r in identify_languages(rows(spark, extra)).collect()}
    assert [got[k]["language"] for k in (0, 100, 1000, 1001, 1002, 1003)] == ["en", "de", "de", "de", "de", "de"]
    assert got[1001]["probability"] > got[1003]["probability"]


def test_host_priors_are_smoothed_towards_the_domain_without_the_row_itself(spark):
    alone = [(1000, "i", None, None, "one.z.org", "z.org")]
    got = {r["key"]: r for r in identify_languages(rows(spark, alone)).collect()}
    balanced = [(1000, "i", None, None, None, None)]
    other = {r["key"]: r for r in identify_languages(rows(spark, balanced)).collect()}
    assert math.isclose(got[1000]["probability"], other[1000]["probability"], abs_tol=0.02)


def test_rejects_nulls_repeated_rows_and_an_empty_table(spark):
    extra = [(None, None, None, None, None, None), (7, "", "en", "com", "a.x.com", "x.com"), (7, "12 34 !!", "en", None, None, None),
             (8, "the " * 100_000, None, None, None, None), (8, "the " * 100_000, None, None, None, None)]
    got = identify_languages(rows(spark, extra)).collect()
    assert len(got) == 45
    assert sorted((r["key"] or -1) for r in got if r["rejected"]) == [-1, 7, 7]
    assert [r["language"] for r in got if r["key"] == 8 and not r["rejected"]][:2] != []
    assert identify_languages(rows(spark, []).limit(0)).collect() == []


def test_the_parts_of_a_page(spark):
    df = spark.createDataFrame(
        [(1, "http://Blog.A.example.com:80/x?y", "<!DOCTYPE html><html class=x lang='EN-us'><script>s</script><p>Hi"), (2, None, None),
         (3, "not an address", "text")], "page_id long, url string, html string")
    got = page_evidence(df).collect()
    assert (got[0]["declared"], got[0]["suffix"], got[0]["host"], got[0]["domain"]) == ("en", "com", "blog.a.example.com", "example.com")
    assert got[0]["text"].split() == ["Hi"] and got[1]["host"] is None and got[2]["suffix"] is None


def test_kept_documents_are_whole_rows(documents):
    pairs = [(i, EN) for i in range(8)] + [(9, "..."), (9, "the and"), (None, None), (10, "A.")]
    kept = keep_identified(documents(pairs), Settings())
    assert kept.columns == documents(pairs).columns
    assert sorted(r["doc_id"] for r in kept.collect()) == [*range(8), 9, 10]


def test_documents_stand_for_pages(documents):
    assert document_evidence(documents([(1, "x")])).first()["host"] == "src"


def test_a_rare_language_is_known_at_any_size(spark):
    """5 of 2,045 rows declare it, and a sample of a hundred rows would hardly hold one of them."""
    many = [(10_000 + i, f"{EN} {i}", "en", None, None, None) for i in range(2000)]
    hu = "ez egy gyors barna róka és egy lusta kutya volt ott azzal a dologgal"
    rare = [(1000 + i, f"{hu} {i}", "hu", None, None, None) for i in range(5)]
    got = {r["key"]: r for r in identify_languages(rows(spark, many + rare), Settings(sample_rows=100)).collect()}
    assert {(got[1000 + i]["language"], got[1000 + i]["rejected"]) for i in range(5)} == {("hu", False)}
    assert (got[0]["language"], got[100]["language"], got[10_000]["language"]) == ("en", "de", "en")


def test_a_text_unlike_all_languages_is_rejected(spark):
    strange = {1000: "Η γρήγορη καφέ αλεπού πηδάει πάνω από το τεμπέλικο σκυλί", 1001: "быстрая коричневая лиса прыгает через ленивую собаку"}
    more = [(2000 + i, f"{EN} {DE if i % 2 else EN} {i}", "de" if i % 2 else "en", None, None, None) for i in range(400)]
    extra = [(k, v, "en", "com", "a.x.com", "x.com") for k, v in strange.items()]
    got = identify_languages(rows(spark, more + extra)).collect()
    assert {r["key"] for r in got if r["rejected"]} == set(strange)


def test_codes_have_one_form(spark):
    tags = ["en", "EN", "en-US", " de_AT", "english", "", None, "x-klingon", "fil", "1a"]
    got = spark.createDataFrame([(t,) for t in tags], "tag string").select(language_code(F.col("tag"))).collect()
    assert [r[0] for r in got] == ["en", "en", "en", "de", None, None, None, None, "fil", None]


def test_languages_beyond_the_model_size_stop_the_job(spark):
    with pytest.raises(TooManyLanguages):
        identify_languages(rows(spark, []), Settings(most_model_bytes=1 << 17))


def plain_grams(text: str) -> list[int]:
    """The trigram buckets of a text."""
    mapped = [b if b >= 128 else ord(chr(b).lower()) if chr(b).isalpha() else 32 for b in text.encode()]
    threes = zip(mapped, mapped[1:], mapped[2:])
    return [
        (((a << 16) | (b << 8) | c) * 2654435761) % 2 ** 32 >> 18
        for a, b, c in threes if not (a == b == 32 or b == c == 32)
    ]


def plain_languages(data, settings):
    """The scores of every row in plain Python, for tables small enough to be the sample as a whole."""
    told = [declared for _, text, declared, *_ in data if declared and text]
    languages = sorted(d for d in set(told) if told.count(d) >= settings.least_rows)
    size = range(len(languages))
    counts = [[0.5] * 16384 for _ in languages]
    for _, text, declared, *_ in data:
        if text and declared in languages:
            for gram in plain_grams(text):
                counts[languages.index(declared)][gram] += 1
    sums = [sum(c) for c in counts]
    text_logs, own = [], []
    for _, text, *_ in data:
        grams = plain_grams(f" {text or ''} ")
        weight = min(len(grams), settings.evidence_grams) / max(len(grams), 1)
        text_logs.append([weight * sum(math.log(counts[i][g] / sums[i]) for g in grams) for i in size])
        odds = [math.exp(x - max(text_logs[-1])) for x in text_logs[-1]]
        own.append([x / sum(odds) if grams else 0.0 for x in odds])

    def summed(column, value, without=None):
        members = [r for r in range(len(data)) if data[r][column] == value and r != without]
        return [sum(own[r][i] for r in members) for i in size]

    # A declaration, suffix, host or domain counts only with a text that has letters.
    known = [{row[c] for r, row in enumerate(data) if row[c] is not None and any(own[r])} for c in range(6)]
    whole = [sum(o[i] for o in own) for i in size]
    overall = [(w + 1) / (sum(whole) + len(languages)) for w in whole]
    result = []
    for r, row in enumerate(data):
        scores = list(text_logs[r])
        for column in (2, 3):
            if row[column] in known[column]:
                mine = summed(column, row[column])
                for i in size:
                    scores[i] += math.log((mine[i] + settings.pseudo) / (whole[i] + settings.pseudo * len(known[column])))
        prior = overall
        for column in (5, 4):
            others = summed(column, row[column], r) if row[column] is not None else [0.0] * len(languages)
            prior = [(o + settings.strength * p) / (sum(others) + settings.strength) for o, p in zip(others, prior)]
        scores = [round(s + math.log(p), 6) for s, p in zip(scores, prior)]
        best = scores.index(max(scores))
        grams = len(plain_grams(f" {row[1] or ''} "))
        background = math.log(settings.background) - min(grams, settings.evidence_grams) * math.log(16384)
        unlike = math.exp(min(background - text_logs[r][best], 500))
        probability = 1 / (sum(math.exp(s - scores[best]) for s in scores) + unlike)
        by_text = languages[text_logs[r].index(max(text_logs[r]))] if grams else None
        result.append((row[0], languages[best], probability, by_text, grams == 0 or probability < settings.least_probability))
    return result


@pytest.mark.parametrize("seed", range(3))
def test_equals_the_plain_computation(spark, seed):
    """All evidence, alone and together, NULLs, texts without letters and repeated rows, over five languages."""
    draw = random.Random(seed)
    words = {n: ["".join(draw.choices("abcdefghijklmnopqrsé"[i * 3:i * 3 + 8], k=draw.randint(2, 7))) for _ in range(30)]
             for i, n in enumerate(["aa", "bb", "cc", "dd", "ee"])}
    data = []
    for key in range(180):
        name = draw.choice(list(words))
        text = draw.choice([None, "", "12 -", "é"] + [" ".join(draw.choices(words[name], k=draw.randint(1, 9)))] * 9)
        told = draw.choice([None, name, name, draw.choice(list(words)), "zz" if key % 60 == 0 else name])
        domain = draw.choice([None, f"{name}.net", "mixed.org"])
        host = domain and draw.choice([f"{part}.{domain}" for part in "ab"])
        data.append((key, text, told, draw.choice([None, name, "org"]), host, domain))
    data += [(1000 + i, *data[0][1:]) for i in range(3)]
    got = {r["key"]: tuple(r) for r in identify_languages(spark.createDataFrame(data, SCHEMA)).collect()}
    expected = plain_languages(data, Settings())
    assert len(got) == len(expected)
    for key, language, probability, by_text, rejected in expected:
        row = got[key]
        assert (row[2], row[4], row[5]) == (language, by_text, rejected), (key, row)
        assert math.isclose(row[3], probability, abs_tol=2e-5)


def test_the_plan_does_not_grow_with_the_square_of_the_languages(spark):
    """Two hundred languages: a frame of some four seconds, whose plan holds no sum over all of them for each."""
    codes = [a + b for a in "abcdefghijklmnopqrst" for b in "abcdefghij"]
    data = [(i * 10 + j, f"{code} {code * 3} {j}", code, None, None, None) for i, code in enumerate(codes) for j in range(5)]
    started = time.monotonic()
    found = identify_languages(spark.createDataFrame(data, SCHEMA))
    built = time.monotonic() - started
    plan = len(found._jdf.queryExecution().optimizedPlan().toString())
    few = identify_languages(spark.createDataFrame(data[:20], SCHEMA))
    assert plan < 60 * len(few._jdf.queryExecution().optimizedPlan().toString())
    assert built < 60
    assert len({r["language"] for r in found.collect()}) > 190

"""Reading levels: parsing, coverage against brute force, calibration, and agreement with held-out readers."""

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from talliard.llm import reading
from talliard.llm.reading import calibrate, coverage, reading_levels, spoken, vocabulary
from talliard.sources.tables import table

DOCS = "doc_id BIGINT, text STRING, lang STRING, words STRING"
RATINGS = "doc_id BIGINT, rater STRING, grade INT"


def docs(spark, texts, lang="en"):
    return spark.createDataFrame([(i, t, lang, "x") for i, t in enumerate(texts)], DOCS)


def test_dialogue(spark):
    texts = [
        "1\n00:00:01,000 --> 00:00:02,000\nZEB: The <i>dog</i>\nruns.\n\n2\n00:00:03,000 --> 00:00:04,000\n[DOOR SLAMS]\n\n3\nO0:0l:05.5 -> 00:01:06.5\nSubtitles by someone\n\n4\n0:00:07,1-->0:00:08,2\n- It isn't far!",
        "WEBVTT\n\n00:01.000 --> 00:02.000\nDonâ€™t goâ€¦\n\n00:02.000 --> 00:03.000\n♪ la la ♪\n\n00:03.000 --> 00:04.000\nget it at www.x.example now\n\n00:05.000 --> 00:06.000\n== x presents ==",
        "1\n00:00:01,000 --> 00:00:02,000\nâ€œStop.â€\x9d\n\n2\n00:00:03,000 --> 00:00:04,000\nΓÇ£Now.ΓÇ¥ Ã¢â‚¬Å“So.\n",
        "1\n00:00:01,000 --> 00:00:02,000\nno marks here\n\n2\n00:00:03,000 --> 00:00:04,000\nnone there\n",
        None,
        "",
        "1\n00:00:01,000 --> 00:00:02,000\n(sighs)\n",
    ]
    rows = spoken(docs(spark, texts)).orderBy("doc_id").collect()
    assert rows[0]["words"] == ["the", "dog", "runs", "it", "isn't", "far"] and rows[0]["n_sentences"] == 2
    assert rows[1]["words"][-2:] == ["don’t", "go"] and rows[1]["n_sentences"] == 1
    assert rows[2]["words"] == ["stop", "now", "so"] and rows[2]["n_sentences"] == 3
    assert rows[3]["n_words"] == 5 and rows[3]["n_sentences"] == 2
    assert [r["n_words"] for r in rows[4:]] == [0, 0, 0]


def test_long_text(spark):
    r = spoken(docs(spark, ["word. " * 300_000])).head()
    assert r["n_words"] == 300_000 and r["n_sentences"] == 300_000
    r = spoken(docs(spark, ["1\n00:00:01,000 --> 00:00:02,000\nOne. Two. An end " + "-" * 1000])).head()
    assert r["n_sentences"] == 3


def brute(rows):
    freq = defaultdict(Counter)
    for lang, words in rows:
        freq[lang].update(words)
    out = []
    for lang, words in rows:
        if not words:
            out.append(None)
            continue
        rank = sorted(sum(1 for c in freq[lang].values() if c >= freq[lang][w]) for w in words)
        out.append(rank[max(1, math.ceil(len(words) * reading.SHARE)) - 1])
    return out


@pytest.mark.parametrize("frequent", [200_000, 30, 1])
def test_coverage_is_exact_with_any_number_of_frequent_words(spark, monkeypatch, frequent):
    monkeypatch.setattr(reading, "FREQUENT", frequent)
    rnd = random.Random(7)
    rows = [(rnd.choice(["en", "de", "un"]), [f"w{'x' * int(rnd.paretovariate(0.7))}"[:60] for _ in range(rnd.choice([0, 1, 5, 40]))]) for _ in range(60)]
    df = spark.createDataFrame(
        [(i, i, l, l, w, len(w), 1) for i, (l, w) in enumerate(rows)],
        "row BIGINT, doc_id BIGINT, tag STRING, lang STRING, words ARRAY<STRING>, n_words INT, n_sentences INT",
    )
    got = {r["doc_id"]: r["coverage_rank"] for r in coverage(df, vocabulary(df)).collect()}
    assert [got[i] for i in range(len(rows))] == brute(rows)


def test_calibration_finds_the_break_and_the_ridge_solution(spark):
    rng = np.random.default_rng(2)
    x1, x2 = rng.uniform(4, 8, 80).round(2), rng.uniform(1, 3, 80)
    y = np.where(x1 > 6, 9, 3) + 0.7 * x1 + 1.5 * x2 + rng.normal(0, 0.3, 80)
    rows = [("en", float(a), float(b), float(c)) for a, b, c in zip(y, x1, x2)] + [("xx", 3.0, 1.0, 1.0)]
    fits = calibrate(spark.createDataFrame(rows, "fit STRING, rating DOUBLE, x1 DOUBLE, x2 DOUBLE")).collect()
    assert [(r["upper"], r["edge"], r["base"]) for r in fits if r["fit"] == "xx"] == [(False, None, 3.0)]
    for r in (r for r in fits if r["fit"] == "en"):
        assert x1[x1 <= 6].max() < r["edge"] < x1[x1 > 6].min()
        side = (x1 > 6) == r["upper"]
        a = np.column_stack([x1[side] - x1[side].mean(), x2[side] - x2[side].mean()])
        b = np.linalg.solve(a.T @ a + np.diag([reading.PRIOR_RANK, reading.PRIOR_LENGTH]), a.T @ (y[side] - y[side].mean()))
        assert np.allclose([r["b1"], r["b2"], r["base"]], [*np.maximum(b, reading.LEAST), y[side].mean()])


def test_no_ratings_leave_the_published_scale(spark):
    df = docs(spark, ["1\n00:00:01,000 --> 00:00:02,000\nThe cat sat. The dog ran.\n", None])
    rows = {r["doc_id"]: r for r in reading_levels(df, spark.createDataFrame([(0, "r", None), (0, "r", 99), (None, "r", 5)], RATINGS)).collect()}
    assert abs(rows[0]["grade"] - (0.39 * 3 + 11.8 * 1.5 - 15.59)) < 1e-9
    assert rows[1]["grade"] is None and rows[1]["coverage_rank"] is None and rows[1]["n_words"] == 0
    assert reading_levels(df.limit(0), spark.createDataFrame([], RATINGS)).count() == 0


@pytest.mark.parametrize("needed", [4, 99])
def test_more_demanding_documents_get_higher_grades(spark, monkeypatch, needed):
    """By rarer words or by longer sentences, with ratings that say so or that don't; the rank decides, not the length alone."""
    monkeypatch.setattr(reading, "RATED", needed)
    text = lambda words, per: "1\n00:00:01,000 --> 00:00:02,000\n" + " ".join(" ".join(words[i : i + per]) + "." for i in range(0, len(words), per))
    letters = lambda i: "q" + "".join(chr(97 + int(d)) for d in str(i))
    common = [letters(i % 5) for i in range(60)]
    texts = [text(common, n) for n in (3, 5, 6, 10, 12)]
    texts += [text([letters(100 * k + i) for i in range(20 + 5 * k)] + common[: 40 - 5 * k], 6) for k in range(1, 5)]
    df = docs(spark, texts)
    for high in ((12, 13, 14, 16), (16, 15, 14, 13)):
        ratings = [(i, "r", g) for i, g in enumerate((2, 3, 3, 4, 5, *high))]
        grades = [r["grade"] for r in reading_levels(df, spark.createDataFrame(ratings, RATINGS)).orderBy("doc_id").collect()]
        assert grades[:5] == sorted(set(grades[:5])) and max(grades[:5]) < 10 <= min(grades[5:])


def test_held_out_readers_agree(spark):
    at = "/root/testdata/sf0.1"
    ratings = table(spark, at, "reading_label")
    half = F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0
    levels = reading_levels(table(spark, at, "documents"), ratings.where(half)).where("grade IS NOT NULL")
    held = ratings.where(~half & F.col("grade").between(1, 18)).groupBy("doc_id").agg(F.median("grade").alias("rating"), F.count("grade").alias("n"))
    rows = levels.join(held, "doc_id").select("grade", "rating").collect()
    error = sorted(abs(r["grade"] - r["rating"]) for r in rows)
    assert len(rows) > 100 and error[len(error) // 2] < 1.3
    right = sum((r["grade"] >= 10) == (r["rating"] >= 10) for r in rows) / len(rows)
    assert right > 0.9

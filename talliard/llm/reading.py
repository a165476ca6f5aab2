"""Reading level of the words spoken in subtitle files (problem 8).

1. Dialogue: SQL expressions cut a file at its timing lines into cues, drop adverts, sound descriptions, tags and speaker
   labels, and undo the usual wrong decodings of punctuation.
2. Vocabulary: words are counted per language over all documents. A word's rank is the number of words of its language
   that are at least as frequent. A document's *coverage rank* is the size of the smallest such vocabulary that covers
   ``SHARE`` of its words.
3. Sentence complexity: words per sentence. A file without sentence marks has one sentence per cue.
4. Calibration, in SQL, per language: the readers' ratings (median per document) against the logarithms of coverage rank and of
   words per sentence. Ratings jump where a text leaves the common vocabulary, so the line has one break: the coverage rank at
   which two groups of ratings, the upper one rated higher, differ least within themselves. On either side of it the grade
   is a ridge regression on both measures, with slopes of at least ``LEAST``, so that more demanding documents get higher
   grades everywhere. One refit without ratings that lie far off the first fit keeps single readers' slips out.

A language with fewer than ``RATED`` rated documents uses the fit over all languages, in which both measures count in
standard deviations from their language's mean.

Frequent words (at least one in ``FREQUENT`` of all words, hence at most FREQUENT words) are sent to all executors, and a
document whose share is covered by them is done there and then. For the rest, and only for their rare words, ranks are
joined by a shuffle; there no word is frequent enough to be a hot key.

Defined results
  * No dialogue (null or '' text, adverts only): n_words 0, and null rank and grade. Null ids and repeated rows keep their rows.
  * Languages are compared by the first two letters without case and blanks; null and 'und' are one language.
  * Without ratings (or none between 1 and 18) the grade is the published Flesch-Kincaid scale's at its average of 1.5 syllables
    per word, so that it tells documents apart by sentences only. Extra columns aren't read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from talliard.workspace import broadcast_if_small, materialize, spread

#: Share of a document's words that its vocabulary must cover.
SHARE = 0.9
#: A word is frequent if it is at least one in so many of all words.
FREQUENT = 200_000
#: Rated documents that a language needs for a fit of its own, and those that either side of the break must have.
RATED, SIDE = 20, 2
#: Weights that draw the slopes of coverage rank and of sentence length to 0, and the least slope.
PRIOR_RANK, PRIOR_LENGTH, LEAST = 1.0, 5.0, 0.05
#: Ratings further than this from the first fit are left out of the second.
FAR_OFF = 4.0

#: A line of times in small letters: digits, what stands for them after character recognition, separators, an arrow.
_TIMING = r"(?m)^[\d:.,;oli \t\ufeffï»¿]*+-{1,2}>[^\n]*$"
_BREAK = "\u001e"
_ADVERT = (
    r"https?:|www\.|\w\.(?:example|invalid|com|net|org|info|tv|io)\b"
    r"|\b(?:subtitles?|captions?|captioning|subbed|synced|corrected|encoded|ripped|sponsored|translated|timed)\b[^\n]{0,40}\bby\b"
    r"|\bremove all ads\b|\bvip member\b|(?m:^[ \t]*[-=~]{2}[^\n]*[-=~]{2}\s*$)"
)
#: Every advert has one of these; the whole pattern is tried only where one is found.
_ADVERT_SIGN = r"\.(?:example|invalid|com|net|org|info|tv|io)\b|http|www\.| by\b| ads|vip |[-=~]{2}"
_NOTE = r"(?:♪|♫|#|\?|�)"
_SOUND = (
    r"\[[^\]\x1e]*\]|\([^)\x1e]*\)|\{[^}\x1e]*\}|<[^>\x1e]*>|\*[^*\n\x1e]*\*"
    rf"|(?m:^[ \t-]*{_NOTE}(?: [^\n\x1e]*)? {_NOTE}\s*$)"
)
_LABEL = r"(?m)^[\s\-–—\"“”«‘']*+\p{L}[\p{L}'’. ]{0,24}+:\s"
_WORD = r"\p{L}+(?:['’]\p{L}+)*"
_CLOSE = r"(?=[\s\x1e\"”’»')\]]|$)"


def _misread(text: str, code: str) -> str:
    """The UTF-8 bytes of text in a one-byte encoding; bytes without a meaning there stand for themselves."""
    return "".join(bytes([b]).decode(code, "ignore") or chr(b) for b in text.encode())


def _garbled() -> list[tuple[str, str]]:
    """(wrong, right) for common characters that were misread once or twice, longest first."""
    right = "’‘“”…–—♪♫«»¿¡éèêëàâäáíóúñçöüßôîïû"
    pairs = {}
    for code in ("cp1252", "cp437", "latin-1"):
        for c in right:
            once = _misread(c, code)
            pairs |= {once: c, _misread(once, code): c}
    return sorted(pairs.items(), key=lambda p: -len(p[0]))


def _repaired(text: Column) -> Column:
    """text with wrong decodings undone; only texts that show the marks of one are touched."""
    fixed = text
    for wrong, c in _garbled():
        fixed = F.replace(fixed, F.lit(wrong), F.lit(c))
    return F.when(text.rlike("[ÃÂâÎΓ├┬][^a-zA-Z\\s]"), fixed).otherwise(text)


def language(c: Column | str) -> Column:
    return F.coalesce(F.nullif(F.substring(F.lower(F.trim(c)), 1, 2), F.lit("un")), F.lit("un"))


def spoken(docs: DataFrame) -> DataFrame:
    """(row, doc_id, tag, lang, words, n_words, n_sentences), written once; ``row`` tells rows apart."""
    low = F.lower(_repaired(F.coalesce("text", F.lit(""))))
    cues = F.filter(F.split(low, _TIMING), lambda c: ~(c.rlike(_ADVERT_SIGN) & c.rlike(_ADVERT)))
    said = F.regexp_replace(F.concat_ws(f"{_BREAK}\n", cues), _SOUND, " ")
    said = F.regexp_replace(said, _LABEL, " ")
    marks = F.regexp_count("said", F.lit(rf"[.!?…]+{_CLOSE}"))
    firm = F.regexp_count("said", F.lit(rf"[.!…]+{_CLOSE}"))
    # Backwards, so that only what stands behind the last letter is looked at.
    open_ = F.reverse("said").rlike(r"^[^.!?…\p{L}]*+\p{L}").cast("int")
    cued = F.regexp_count("said", F.lit(r"(?:^|\x1e)[^\x1e\p{L}]*\p{L}"))
    n = F.size("words")
    table = (
        spread(docs.select("doc_id", "text", "lang")).select(F.monotonically_increasing_id().alias("row"), "doc_id", F.col("lang").alias("tag"), language("lang").alias("lang"), said.alias("said"))
        .withColumn("words", F.regexp_extract_all("said", F.lit(_WORD), F.lit(0)))
        .select(
            "row",
            "doc_id",
            "tag",
            "lang",
            "words",
            n.alias("n_words"),
            F.when(firm * 100 < n, cued).otherwise(F.greatest(marks + open_, F.lit(1))).alias("n_sentences"),
        )
    )
    return materialize(table, "spoken")


def vocabulary(said: DataFrame) -> DataFrame:
    """(lang, word, n): how often each word occurs in a language, over all documents."""
    return said.select("lang", F.explode("words").alias("word")).groupBy("lang", "word").agg(F.count(F.lit(1)).alias("n"))


def _frequent(vocab: DataFrame, total: int) -> dict[str, tuple[pa.Array, np.ndarray]]:
    """By language, the frequent words and their ranks; at most FREQUENT words in all, by the definition of frequent."""
    rows = vocab.where(F.col("n") * FREQUENT >= total).toArrow()
    out = {}
    langs = rows.column("lang").combine_chunks() if rows.num_rows else pa.array([], pa.string())
    for lang in pc.unique(langs).to_pylist():
        own = rows.filter(pc.equal(rows.column("lang"), lang))
        n = own.column("n").to_numpy()
        out[lang] = (own.column("word").combine_chunks(), len(n) - np.searchsorted(np.sort(n), n, "left"))
    return out


def _needed(n: Column) -> Column:
    """How many of n words make up the share."""
    return F.greatest(F.ceil(n * F.lit(SHARE)), F.lit(1)).cast("int")


def coverage(said: DataFrame, vocab: DataFrame) -> DataFrame:
    """said with ``coverage_rank``, without the words."""
    total = vocab.agg(F.coalesce(F.sum("n"), F.lit(0))).head()[0]
    known = _frequent(vocab, total)
    rare = 1 << 40

    @F.arrow_udf("rank bigint, known bigint")
    def covered(words: pa.Array, lang: pa.Array, needed: pa.Array) -> pa.Array:
        rank, frequent = np.full(len(words), -1, np.int64), np.zeros(len(words), np.int64)
        for code in pc.unique(lang).to_pylist():
            at = np.flatnonzero(pc.equal(lang, code).to_numpy(zero_copy_only=False))
            own = words.take(pa.array(at))
            size = pc.list_value_length(own).to_numpy(zero_copy_only=False).astype(np.int64)
            dictionary, ranks = known.get(code, (pa.array([], pa.string()), np.empty(0, np.int64)))
            found = pc.index_in(own.flatten(), value_set=dictionary).fill_null(len(ranks)).to_numpy()
            r = np.append(ranks, rare)[found]
            doc = np.repeat(np.arange(len(at)), size)
            frequent[at] = np.bincount(doc[r < rare], minlength=len(at))
            r = np.sort(doc * (rare * 2) + r) % (rare * 2)  # documents of a batch are few enough for 63 bits
            begin = np.cumsum(size) - size
            some = np.flatnonzero(size)
            rank[at[some]] = r[begin[some] + needed.take(pa.array(at[some])).to_numpy() - 1]
        rank = np.where(rank >= rare, -2, rank)
        return pa.StructArray.from_arrays([pa.array(rank), pa.array(frequent)], ["rank", "known"])

    first = materialize(
        said.withColumn("needed", _needed(F.col("n_words"))).withColumn("c", covered("words", "lang", "needed")).select(
            "row", "doc_id", "tag", "lang", "n_words", "n_sentences", "needed", "c.rank", "c.known",
        ),
        "coverage",
    )
    late = first.where("rank = -2")
    columns = [c for c in first.columns if c not in ("needed", "rank", "known")]
    done = first.where("rank <> -2").select(*columns, F.nullif("rank", F.lit(-1)).alias("coverage_rank"))
    if late.isEmpty():
        return done
    # Ranks of rare words: words per frequency, added up from the top, for each language.
    steps = vocab.groupBy("lang", "n").agg(F.count(F.lit(1)).alias("words"))
    above = Window.partitionBy("lang").orderBy(F.desc("n")).rowsBetween(Window.unboundedPreceding, 0)
    steps = steps.select("lang", "n", F.sum("words").over(above).alias("rank"))
    ranks = vocab.where(F.col("n") * FREQUENT < total).join(broadcast_if_small(steps), ["lang", "n"]).select("lang", "word", "rank")
    asked = broadcast_if_small(late.select("row", "needed", "known"))
    words = said.join(asked, "row").select("row", "lang", "needed", "known", F.explode("words").alias("word"))
    at = F.row_number().over(Window.partitionBy("row").orderBy("rank"))
    found = words.join(ranks, ["lang", "word"]).withColumn("at", at).where(F.col("at") == F.col("needed") - F.col("known"))
    late = late.select(*columns).join(found.select("row", F.col("rank").alias("coverage_rank")), "row").select(*columns, "coverage_rank")
    return done.unionByName(late)


def _break(rated: DataFrame) -> DataFrame:
    """(fit, edge): the value of x1 that parts the ratings of a fit best, null where nothing does. Ratings are added up per value
    first, so that what is sorted in one place is bounded by the vocabulary."""
    y = F.col("rating")
    per = rated.groupBy("fit", "x1").agg(F.count(F.lit(1)).alias("n"), F.sum(y).alias("s"), F.sum(y * y).alias("q"))
    by = Window.partitionBy("fit")
    upto, whole = by.orderBy("x1").rowsBetween(Window.unboundedPreceding, 0), by.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    per = per.select("fit", "x1", F.lead("x1").over(by.orderBy("x1")).alias("next"), *[
        F.sum(c).over(w).alias(c + k) for c in "nsq" for w, k in ((upto, "1"), (whole, "0"))
    ])
    per = per.select("*", *[(F.col(c + "0") - F.col(c + "1")).alias(c + "2") for c in "nsq"])
    inner = F.col("q0") - F.col("s1") * F.col("s1") / F.col("n1") - F.col("s2") * F.col("s2") / F.col("n2")
    fair = (F.col("n1") >= SIDE) & (F.col("n2") >= SIDE) & (F.col("s2") * F.col("n1") > F.col("s1") * F.col("n2"))
    best = F.min(F.when(fair, F.struct(inner.alias("d"), "x1", "next"))).alias("b")
    return per.groupBy("fit").agg(best).select("fit", ((F.col("b.x1") + F.col("b.next")) / 2).alias("edge"))


def calibrate(rated: DataFrame) -> DataFrame:
    """(fit, upper, edge, base, m1, m2, b1, b2) from (fit, rating, x1, x2): below or above ``edge`` the grade is
    base + b1 * (x1 - m1) + b2 * (x2 - m2)."""
    rows = rated.join(broadcast_if_small(_break(rated)), "fit").withColumn("upper", F.coalesce(F.col("x1") > F.col("edge"), F.lit(False)))
    y, n = F.col("rating"), F.count(F.lit(1))
    sums = rows.groupBy("fit", "upper").agg(
        F.first("edge").alias("edge"), F.avg(y).alias("base"), F.avg("x1").alias("m1"), F.avg("x2").alias("m2"),
        (F.var_pop("x1") * n).alias("s11"), (F.var_pop("x2") * n).alias("s22"), (F.covar_pop("x1", "x2") * n).alias("s12"),
        (F.covar_pop(F.col("x1"), y) * n).alias("s1y"), (F.covar_pop(F.col("x2"), y) * n).alias("s2y"),
    )
    a, b, c = F.col("s11") + PRIOR_RANK, F.col("s22") + PRIOR_LENGTH, F.col("s12")
    det = a * b - c * c
    return sums.select(
        "fit", "upper", "edge", "base", "m1", "m2",
        F.greatest((F.col("s1y") * b - F.col("s2y") * c) / det, F.lit(LEAST)).alias("b1"),
        F.greatest((F.col("s2y") * a - F.col("s1y") * c) / det, F.lit(LEAST)).alias("b2"),
    )


def _graded(rows: DataFrame, fits: DataFrame) -> DataFrame:
    """rows (fit, x1, x2) with ``line``, the grade of their fit; null where there is no fit."""
    sides = F.map_from_entries(F.collect_list(F.struct("upper", F.struct("base", "m1", "m2", "b1", "b2"))))
    fits = fits.groupBy("fit").agg(F.first("edge").alias("edge"), sides.alias("sides"))
    side = F.element_at("sides", F.coalesce(F.col("x1") > F.col("edge"), F.lit(False)))
    line = side["base"] + side["b1"] * (F.col("x1") - side["m1"]) + side["b2"] * (F.col("x2") - side["m2"])
    return rows.join(broadcast_if_small(fits), "fit", "left").select(*rows.columns, line.alias("line"))


def reading_levels(docs: DataFrame, ratings: DataFrame) -> DataFrame:
    """(doc_id, lang, n_words, words_per_sentence, coverage_rank, grade) of each row of ``docs`` (doc_id, text, lang).
    ``ratings``: doc_id, grade."""
    said = spoken(docs)
    levels = coverage(said, materialize(vocabulary(said), "vocabulary"))
    per = F.when(F.col("n_words") > 0, F.col("n_words") / F.col("n_sentences"))
    levels = levels.withColumn("per", per).withColumn("r1", F.log(F.col("coverage_rank"))).withColumn("r2", F.log("per"))
    levels = materialize(levels, "levels")
    median = ratings.where("grade BETWEEN 1 AND 18").groupBy("doc_id").agg(F.median("grade").alias("rating"))
    rated = materialize(levels.where("r1 IS NOT NULL").select("doc_id", "lang", "r1", "r2").join(median, "doc_id"), "rated")
    own = rated.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= RATED).select("lang", F.lit(True).alias("own"))
    usual = levels.groupBy("lang").agg(*[f(c).alias(f"{k}{c}") for c in ("r1", "r2") for k, f in (("m", F.avg), ("d", F.stddev_pop))])
    usual = materialize(usual.join(own, "lang", "left"), "languages")
    z = [F.when(F.col(f"d{c}") > 0, (F.col(c) - F.col(f"m{c}")) / F.col(f"d{c}")).when(F.col(c).isNotNull(), F.lit(0.0)) for c in ("r1", "r2")]
    pooled = rated.join(broadcast_if_small(usual), "lang").select(F.lit("*").alias("fit"), "rating", z[0].alias("x1"), z[1].alias("x2"))
    single = rated.join(broadcast_if_small(own), "lang").select(F.col("lang").alias("fit"), "rating", F.col("r1").alias("x1"), F.col("r2").alias("x2"))
    known = materialize(pooled.unionByName(single), "known")
    near = _graded(known, calibrate(known)).where(F.abs(F.col("rating") - F.col("line")) <= FAR_OFF).drop("line")
    fits = materialize(calibrate(materialize(near, "near")), "fits")
    alone = F.coalesce("own", F.lit(False))
    rows = levels.join(broadcast_if_small(usual), "lang").select(
        "doc_id", "tag", "n_words", "per", "coverage_rank", F.when(alone, F.col("lang")).otherwise("*").alias("fit"),
        F.when(alone, F.col("r1")).otherwise(z[0]).alias("x1"), F.when(alone, F.col("r2")).otherwise(z[1]).alias("x2"),
    )
    published = 0.39 * F.col("per") + 11.8 * 1.5 - 15.59
    return _graded(rows, fits).select(
        "doc_id", F.col("tag").alias("lang"), "n_words", F.col("per").alias("words_per_sentence"), "coverage_rank",
        F.coalesce("line", published).alias("grade"),
    )


def profile(levels: DataFrame) -> DataFrame:
    """(lang, school_grade, n_docs, n_words): documents by language tag and whole grade, null where nothing is spoken."""
    return levels.groupBy("lang", F.floor("grade").alias("school_grade")).agg(
        F.count(F.lit(1)).alias("n_docs"), F.sum("n_words").alias("n_words")
    )

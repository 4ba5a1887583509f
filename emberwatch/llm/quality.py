"""Quality rules: text counts, and a log-likelihood ratio of hashed n-grams against a trusted target.

All native: DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, shared_folder, words_of

#: Windows of so many words are looked for twice in a text.
WINDOW = 5


def _once(value: Column, use) -> Column:
    """use(value) with value evaluated once per row, also where use reads it in a lambda."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def n_repeat_words(words: Column) -> Column:
    """Words within windows of WINDOW words that occur at least twice in the array.

    Distinct window hashes prove most texts free of repeats. The others sort their windows as
    text, so that equal ones are neighbours, and add up the words that they cover.
    """
    starts = F.when(F.size(words) >= WINDOW, F.sequence(F.lit(0), F.size(words) - WINDOW)).otherwise(F.array().cast("array<int>"))
    hashes = F.transform(starts, lambda i: F.xxhash64(*[F.get(words, i + j) for j in range(WINDOW)]))
    windows = F.sort_array(F.transform(starts, lambda i: F.struct(F.array_join(F.slice(words, i + 1, WINDOW), " ").alias("text"), i.alias("at"))))

    def repeated(w: Column) -> Column:
        same = lambda i, j: F.coalesce(F.get(w, i)["text"] == F.get(w, j)["text"], F.lit(False))
        found = F.filter(F.sequence(F.lit(0), F.size(w) - 1), lambda i: same(i, i + 1) | ((i > 0) & same(i, F.greatest(i - 1, F.lit(0)))))
        return F.sort_array(F.transform(found, lambda i: F.get(w, i)["at"]))

    def covered(at: Column) -> Column:
        return F.aggregate(
            at, F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).cast("long").alias("n")),
            lambda s, x: F.struct(x.alias("last"), (s["n"] + F.least(F.lit(WINDOW), x - s["last"])).alias("n")),
            lambda s: s["n"],
        )

    distinct = _once(hashes, lambda h: F.size(F.array_distinct(h)) == F.size(h))
    return F.when(distinct, F.lit(0).cast("long")).otherwise(_once(_once(windows, repeated), covered))


def grams(words: Column, buckets: int) -> Column:
    """Buckets of the words and of the pairs of neighbours: crc32 modulo `buckets`."""
    hashed = lambda x: (F.crc32(x.cast("binary")) % buckets).cast("int")
    pairs = F.when(F.size(words) > 1, F.sequence(F.lit(1), F.size(words) - 1)).otherwise(F.array().cast("array<int>"))
    return F.concat(
        F.transform(words, hashed),
        F.transform(pairs, lambda i: hashed(F.concat(F.get(words, i - 1), F.lit(" "), F.get(words, i)))),
    )


def gram_weights(docs: DataFrame, *, text: str = "text", trusted: str = "trusted", buckets: int = 1 << 14, smoothing: float = 4.0) -> DataFrame:
    """(bucket, raw, target, weight): log of target against raw multinomial, for every bucket, to 6 digits.

    docs has a boolean column `trusted`; all rows are the raw corpus, the true ones the
    target. The target is smoothed by `smoothing` grams a bucket that are spread like the raw corpus, so a small
    target makes small weights. Buckets without grams, and all without any target gram, weigh 0.
    """
    shared_folder(docs.sparkSession)
    found = _once(words_of(F.col(text)), lambda w: grams(w, buckets))
    one = docs.select(F.explode(found).alias("bucket"), F.coalesce(trusted, F.lit(False)).alias("trusted"))
    counts = one.groupBy("bucket").agg(F.count("*").alias("raw"), F.count_if("trusted").alias("target"))
    every = docs.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket"))
    full = every.join(counts, "bucket", "left").select(
        "bucket", F.coalesce("raw", F.lit(0)).alias("raw"), F.coalesce("target", F.lit(0)).alias("target")
    ).checkpoint()
    total = full.agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).first()
    if not total["target"]:
        return full.withColumn("weight", F.lit(0.0))
    prior = smoothing * buckets
    ratio = (F.col("target") * float(total["raw"]) / F.col("raw") + prior) / (float(total["target"]) + prior)
    return full.withColumn("weight", F.when(F.col("raw") > 0, F.round(F.log(ratio), 6)).otherwise(0.0))


def verdict(weights: DataFrame, *, text: str = "text", buckets: int = 1 << 14, least: float = -0.2) -> Column:
    """A struct of n_words, word_chars, n_repeat_words, llr, base_failed and kept of a text.

    weights is a table of exactly `buckets` rows (`gram_weights`); it becomes one constant
    array of that fixed size.
    """
    known = weights.select("bucket", F.format_string("%.6f", "weight").alias("w")).collect()  # `buckets` rows
    values = ",".join(r["w"] for r in sorted(known))
    table = F.split(F.lit(values), ",").cast("array<double>")  # folded once

    def judged(c: Column) -> Column:
        failed = (c["n_words"] < 10) | (c["n_repeat_words"] * 100 > c["n_words"] * 20)
        return F.struct(
            *[c[n].alias(n) for n in ("n_words", "word_chars", "n_repeat_words", "llr")],
            failed.alias("base_failed"), (~failed & (c["llr"] >= least)).alias("kept"),
        )

    counts = _once(table, lambda weights: _once(words_of(F.col(text)), lambda w: F.struct(
        F.size(w).cast("long").alias("n_words"),
        F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
        n_repeat_words(w).alias("n_repeat_words"),
        _once(grams(w, buckets), lambda g: F.when(
            F.size(g) > 0, F.round(F.aggregate(g, F.lit(0.0), lambda s, b: s + F.get(weights, b)) / F.size(g), 6) + F.lit(0.0)
        ).otherwise(0.0)).alias("llr"),
    )))
    return _once(counts, judged)


def quality_rules(docs: DataFrame, weights: DataFrame, *, doc_id: str = "doc_id", text: str = "text", buckets: int = 1 << 14, least: float = -0.2) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, llr, base_failed, kept), a row per row of docs.

    The counts are of the whole text. base_failed: n_words < 10 or 100 * n_repeat_words >
    20 * n_words. llr: mean weight of the text's grams, to 6 digits (0 without grams). kept:
    not base_failed and llr >= least.

    A null text counts as empty: no words, so base_failed. Repeated rows each get a row; other
    columns are ignored.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    counted = docs.select(
        F.col(doc_id).alias("doc_id"),
        (F.length(body) - F.length(F.regexp_replace(body, r"[#*$%&|<>]", ""))).cast("long").alias("n_symbols"),
        _once(F.filter(F.split(body, "\n"), lambda x: x.rlike(WORD)), lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        verdict(weights, text=text, buckets=buckets, least=least).alias("v"),
    )
    return counted.select(
        "doc_id", "v.n_words", "v.word_chars", "n_symbols", "n_dup_lines", "v.n_repeat_words", "v.llr", "v.base_failed", "v.kept"
    )


def with_trust(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(text, trusted): whether a label row marks the document as good (quality 1) and not toxic."""
    good = labels.where("doc_id is not null").groupBy("doc_id").agg(
        F.max((F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0)).alias("trusted")
    )
    # always merged: a broadcast where labels are few would only hide how the join grows
    return docs.select("doc_id", "text").join(good.hint("merge"), "doc_id", "left").select("text", "trusted")


def filtered(docs: DataFrame, labels: DataFrame, *, least: float = -0.2) -> DataFrame:
    """The rows of docs, all columns, that the rules keep, with weights learnt from docs and labels."""
    shared_folder(docs.sparkSession)
    weights = gram_weights(with_trust(docs, labels)).checkpoint()
    return docs.where(verdict(weights, least=least)["kept"])

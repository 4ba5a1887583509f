"""Language identification by prediction by partial matching over frozen byte contexts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, shared_folder, slices, staged

#: Languages of a model; more are learnt as several models, each with a pass over the texts.
LANGUAGES = 16
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_THREE = (1 << 24) - 1


def _runs(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """At each byte of all texts, it and the three before it as one number; and its text. A text is led by three line feeds."""
    lead = b"\n\n\n"
    data = np.frombuffer(b"".join(lead + (t or b"").translate(_LOWER) for t in texts), np.uint8).astype(np.uint32)
    lengths = np.fromiter((len(t or b"") + 3 for t in texts), np.int64, len(texts))
    row = np.repeat(np.arange(len(texts)), lengths)
    use = np.ones(len(data), dtype=bool)
    starts = np.cumsum(lengths) - lengths
    for i in range(3):
        use[starts + i] = False
    key = data.copy()
    for back in (1, 2, 3):
        key[back:] |= data[:-back] << np.uint32(8 * back)
    return key[use], row[use]


def _chances(context: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """By method C, for the counts of seen symbols: the chance of each, and (context, chance of its escape) rows."""
    contexts, at = np.unique(context, return_inverse=True)
    total, kinds = np.bincount(at, count), np.bincount(at)
    return count / (total + kinds)[at], np.stack([contexts, kinds / (total + kinds)], axis=1) if len(contexts) else np.zeros((0, 2))


def _rows_of(keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """The place of each wanted number among sorted keys, -1 if it is not there."""
    if not len(keys):
        return np.full(len(wanted), -1)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, at, -1)


class Model:
    """Code lengths in bits, per language, of a byte after the three before it.

    Counts are kept for contexts of three, two, one and no bytes. A byte that a context has seen has
    the chance count / (n + kinds), n being the context's bytes and kinds its distinct ones; else the
    context escapes, at kinds / (n + kinds), to the one shorter by a byte (method C, without
    exclusion), down to equal chances of the 256 bytes. Contexts never seen escape for free. Runs of
    three and four bytes are kept only as far as a language has seen them.
    """

    def __init__(self, langs: list[str], lang: np.ndarray, key: np.ndarray, count: np.ndarray) -> None:
        self.langs = langs
        key = key.astype(np.int64)
        self.four_keys = np.unique(key)
        self.three_keys = np.unique(np.concatenate([key & _THREE, key >> 8]))
        size = len(langs)
        self.four = np.zeros((len(self.four_keys), size), np.float32)
        self.three = np.zeros((len(self.three_keys), size), np.float32)
        self.leave_three = np.zeros((len(self.three_keys), size), np.float32)
        self.leave_two = np.zeros((1 << 16, size), np.float32)
        self.two = np.zeros((1 << 16, size), np.float32)
        for i in range(size):
            own = lang == i
            self._learn(i, key[own], count[own].astype(np.float64))

    def _learn(self, i: int, key: np.ndarray, count: np.ndarray) -> None:
        def order(length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            """Seen runs of a context of this length and a byte, and their counts and contexts."""
            runs, at = np.unique(key & ((1 << (8 * length + 8)) - 1), return_inverse=True)
            return runs, np.bincount(at, count, len(runs)), runs >> 8

        one = np.full(256, 1 / 256)
        runs, n, context = order(0)
        seen, leave = _chances(context, n)
        if len(leave):
            one *= leave[0, 1]
        one[runs] = seen
        two = np.tile(one, 256)
        runs, n, context = order(1)
        seen, leave = _chances(context, n)
        for c, chance in leave:
            two[int(c) * 256 : int(c) * 256 + 256] *= chance
        two[runs] = seen
        self.two[:, i] = -np.log2(two)
        runs, n, context = order(2)
        seen, leave = _chances(context, n)
        self.leave_two[leave[:, 0].astype(np.int64), i] = -np.log2(leave[:, 1])
        self.three[:, i] = self.leave_two[self.three_keys >> 8, i] + self.two[self.three_keys & 0xFFFF, i]
        self.three[_rows_of(self.three_keys, runs), i] = -np.log2(seen)
        seen, leave = _chances(key >> 8, count)
        self.leave_three[_rows_of(self.three_keys, leave[:, 0].astype(np.int64)), i] = -np.log2(leave[:, 1])
        context, shorter = (_rows_of(self.three_keys, k) for k in (self.four_keys >> 8, self.four_keys & _THREE))
        self.four[:, i] = self.leave_three[context, i] + self.three[shorter, i]
        self.four[_rows_of(self.four_keys, key), i] = -np.log2(seen)

    def of_runs(self, keys: np.ndarray) -> np.ndarray:
        """The bits of a byte after three, per language, for runs of four as numbers."""
        keys = keys.astype(np.int64)
        known = _rows_of(self.four_keys, keys)
        out = self.four[np.maximum(known, 0)] if len(self.four_keys) else np.zeros((len(keys), len(self.langs)), np.float32)
        new = np.flatnonzero(known < 0)
        rest = keys[new]
        shorter, context = _rows_of(self.three_keys, rest & _THREE), _rows_of(self.three_keys, rest >> 8)
        bits = self.leave_two[(rest >> 8) & 0xFFFF] + self.two[rest & 0xFFFF]
        seen = shorter >= 0
        bits[seen] = self.three[shorter[seen]]
        left = context >= 0
        bits[left] += self.leave_three[context[left]]
        out[new] = bits
        return out

    def bits(self, texts: list[bytes | None]) -> np.ndarray:
        """The code length of each whole text in each language."""
        key, row = _runs(texts)
        out = np.zeros((len(texts), len(self.langs)))
        distinct, at = np.unique(key, return_inverse=True)
        table = self.of_runs(distinct)
        for s in range(0, len(key), 1 << 18):
            bits, r = table[at[s : s + (1 << 18)]], row[s : s + (1 << 18)]
            first = np.flatnonzero(np.diff(r, prepend=-1))
            out[r[first]] += np.add.reduceat(bits.astype(np.float64), first)
        return out


def trained(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", rows: int = 4000) -> list[Model]:
    """Models of all languages in docs, in order of their names, from about `rows` texts of each (all if it has fewer).

    Which texts is decided by a hash of the id and the text, so any order or partitioning gives the
    same. Rows without text or lang are left out. Counting is distributed; the counts of runs of four
    bytes (some 10^5 a language) and the names of the languages come to the driver, the counts of
    LANGUAGES languages at a time.
    """
    spark = docs.sparkSession
    shared_folder(spark)
    own = docs.where(F.col(text).isNotNull() & F.col(lang).isNotNull()).select(
        F.col(doc_id).cast("string").alias("id"), F.col(lang).cast("string").alias("lang"), F.col(text).alias("text")
    )
    sizes = staged(own.groupBy("lang").count(), "languages")
    langs = [r["lang"] for r in sizes.select("lang").collect()]
    langs.sort()
    if not langs:
        return []
    numbers = spark.createDataFrame([(n, i) for i, n in enumerate(langs)], "lang string, number long")
    shares = sizes.join(numbers, "lang").select("lang", "number", (F.lit(float(rows)) / F.col("count")).alias("share"))
    chance = F.pmod(F.xxhash64(F.lit(7), "id", "text"), F.lit(1 << 30)) / float(1 << 30)
    few = len(langs) <= 100_000
    drawn = own.join(F.broadcast(shares) if few else shares, "lang").where(chance < F.col("share"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, end, texts in slices(batch, "_bytes"):
                key, row = _runs(texts)
                own = batch.column("number").slice(start, end - start).to_numpy()
                found, n = np.unique(key.astype(np.int64) + (own[row] << 32), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(n)], ["key", "n"])

    bytes_ = drawn.select("number", F.col("text").cast("binary").alias("_bytes"))
    counts = staged(bytes_.mapInArrow(count, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")), "runs")
    models = []
    for a in range(0, len(langs), LANGUAGES):
        part = counts.where((F.col("key") >= a << 32) & (F.col("key") < (a + LANGUAGES) << 32)).toPandas()
        key = part["key"].to_numpy(np.int64)
        models.append(Model(langs[a : a + LANGUAGES], (key >> 32) - a, key & 0xFFFFFFFF, part["n"].to_numpy(np.int64)))
    return models


def _best(rows: DataFrame, model: Model, bytes_: str, names: list[str], ddl: str) -> DataFrame:
    """names and lang, bits, weight: the best language of a model, its code length, and the sum of the chances over its own."""
    sent = rows.sparkSession.sparkContext.broadcast(model)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for batch in batches:
            for start, end, texts in slices(batch, bytes_, 1 << 20):
                bits = model.bits(texts)
                best = bits.argmin(1)
                weight = np.exp2(np.minimum(0, bits.min(1, keepdims=True) - bits)).sum(1)
                yield pa.RecordBatch.from_arrays(
                    [
                        *(batch.column(n).slice(start, end - start) for n in names),
                        pa.array([model.langs[i] for i in best], pa.string()), pa.array(bits.min(1)), pa.array(weight),
                    ],
                    names=[*names, *_FOUND],
                )

    return rows.mapInArrow(emit, f"{ddl}, {_FOUND[0]} string, {_FOUND[1]} double, {_FOUND[2]} double")


_FOUND = ["__lang", "__bits", "__weight"]


def identified(docs: DataFrame, models: list[Model], *, text: str = "text") -> DataFrame:
    """docs' columns and lang_pred, score.

    The language with the shortest code of the whole text; ties go to the first name. score: its chance
    among the learnt languages, taken as equally likely before. A null text, one without any letter,
    and any text for no models have `und` and 0.0. Columns with the new names are replaced. Several
    models each have a pass over the texts, whose results are joined by a number of the row.
    """
    names = [c for c in docs.columns if c not in ("lang_pred", "score")]
    bytes_, letters, uid = fresh(docs, "_bytes", "_letters", "_uid")
    quoted = lambda fields: ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in fields)
    own = docs.select(
        *[F.col(f"`{n.replace('`', '``')}`") for n in names], F.col(text).rlike(r"\p{L}").alias(letters), F.col(text).cast("binary").alias(bytes_)
    )
    lang, bits, weight = (F.col(c) for c in _FOUND)
    if not models:
        found = own.withColumns({_FOUND[0]: F.lit(None).cast("string"), _FOUND[1]: F.lit(0.0), _FOUND[2]: F.lit(1.0)})
    elif len(models) == 1:
        kept = own.select(*[c for c in own.columns if c != bytes_]).schema.fields
        found = _best(own, models[0], bytes_, [f.name for f in kept], quoted(kept))
    else:
        own = staged(own.withColumn(uid, F.monotonically_increasing_id()), "texts")
        narrow = own.select(uid, bytes_)
        parts = [_best(narrow, m, bytes_, [uid], f"`{uid}` bigint") for m in models]
        every = parts[0]
        for part in parts[1:]:
            every = every.unionByName(part)
        best = F.min(F.struct(bits.alias("bits"), lang.alias("lang"))).alias("best")
        all_of = F.collect_list(F.struct(bits.alias("bits"), weight.alias("weight"))).alias("parts")  # one per model
        total = F.aggregate("parts", F.lit(0.0), lambda a, x: a + x["weight"] * F.pow(F.lit(2.0), F.col("best.bits") - x["bits"]))
        told = every.groupBy(uid).agg(best, all_of).select(
            uid, F.col("best.lang").alias(_FOUND[0]), F.col("best.bits").alias(_FOUND[1]), total.alias(_FOUND[2])
        )
        found = own.join(told, uid)
    known: Column = F.coalesce(F.col(letters), F.lit(False)) & lang.isNotNull()
    return found.select(
        *[F.col(f"`{n.replace('`', '``')}`") for n in names],
        F.when(known, lang).otherwise("und").alias("lang_pred"), F.when(known, 1 / weight).otherwise(0.0).alias("score"),
    )

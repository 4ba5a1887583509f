"""Language-model scores: a hashed maximum-entropy model with class-factored softmax."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import shared_folder, slices, staged, unstage

#: The end of a text, counted as a token; no word is empty.
END = b""
#: Rows of weights that travel together, and partial sums that one task adds up.
BLOCK, FAN_IN = 64, 64
#: Training tokens from which one model learns before models are averaged; it sends all the rows it met.
PART_TOKENS = 1 << 23
#: Places whose chances are made at a time, in rows of at least NARROW weights; more of narrower ones.
CHUNK, NARROW = 1024, 128
#: Symbols that a part learns from at a time.
RUN = 1 << 18
#: Words that a task counts before it sends their counts.
WAITING = 1 << 22
#: Rows met so often in a batch are summed one by one.
OFTEN = 64
#: Classes of more members than this have sets of members.
WHOLE = 96


@dataclass
class Shape:
    """Sizes of the model; the defaults are the least ones, `of` has those for a corpus.

    The classes * members most frequent tokens, ranked, form `classes` classes of `members`. All
    others form `rare` classes by their last byte. Features are the word before, the second and third before (skips) and the
    two before as a pair, hashed to class_rows rows of class weights and, together with the class, to member_rows rows of
    member weights. With more than one of `sets`, a softmax gives the set of the member (neighbours in rank) and another
    one the member in its set. Each has weights of its own, together a quarter more than without sets: with as many, held-out
    texts of sf0.1 were less likely than without. At most `direct` of the most frequent words have their counts in each task.
    """

    classes: int = 16
    members: int = 64
    rare: int = 16
    class_rows: int = 1 << 14
    member_rows: int = 1 << 14
    direct: int = 1 << 18
    rounds: int = 2
    batch: int = 8192
    rate: float = 0.25
    sets: int = 1

    @classmethod
    def of(cls, tokens: int, vocabulary: int) -> Shape:
        """Modelled words grow with the root of the vocabulary, classes and members alike; rows with the cube root of the tokens."""
        side = max(1.0, vocabulary / (1 << 16)) ** 0.25
        rows = round((1 << 14) * max(1.0, tokens / (1 << 24)) ** (1 / 3))
        classes, members = round(16 * side), round(64 * side)
        sets = round(members**0.5) if members > WHOLE else 1
        return cls(classes, members, classes, rows, rows, max(1 << 18, 2 * classes * members), sets=sets)

    @property
    def known(self) -> int:
        return self.classes * self.members

    @property
    def symbol(self) -> type:
        """The least type that holds all symbols."""
        return np.uint16 if self.known + self.rare <= 1 << 16 else np.uint32

    @property
    def set_members(self) -> int:
        return -(-self.members // self.sets)

    @property
    def tables(self) -> list[tuple[int, int]]:
        """Rows and columns of the weights of classes, of members or sets, and of members in sets."""
        wide = self.class_rows, self.classes + self.rare
        if self.sets == 1:
            return [wide, (self.member_rows, self.members)]
        each = self.member_rows * self.members * 5 // 8
        return [wide, *((max(1, each // w), w) for w in (self.sets, self.set_members))]

    @property
    def rates(self) -> list[float]:
        """A step's rate by table; rows of few weights have larger gradients by their width, so steps are held back."""
        return [self.rate, self.rate] if self.sets == 1 else [self.rate, self.rate / 2, self.rate * 2 / 3]


def split_words(texts: list[bytes | None]) -> tuple[pa.Array, np.ndarray]:
    """The lower-cased words (A-Z) of all texts, and how many each has; null has none."""
    found = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(pa.array(texts, pa.binary()), b"").view(pa.string())))
    words, ends = found.flatten().view(pa.binary()), np.asarray(found.offsets)
    real = np.asarray(pc.binary_length(words)) > 0  # spaces at the ends of a text are led and followed by empty ones
    sizes = np.diff(np.append(0, np.cumsum(real))[ends - ends[0]])
    return words.filter(pa.array(real)), sizes


class Vocabulary:
    """Symbols of tokens: rank for the most frequent, then one per class of rare words.

    `more` are rare words that have a number too, after the ranks.
    """

    def __init__(self, shape: Shape, frequent: list[tuple[bytes, int]], more: list[bytes] | tuple = ()) -> None:
        self.shape = shape
        self.words = pa.array([w for w, _ in frequent], pa.binary())
        self.more = {w: i for i, w in enumerate(more, len(frequent))}
        self.end = [w for w, _ in frequent].index(END)

    def tokens(self, texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """`symbols` of texts whose words are at hand."""
        return self.symbols(pa.array([w for words in texts for w in words], pa.binary()), np.array([len(x) for x in texts], np.int64))

    def symbols(self, words: pa.Array, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Symbols of texts of so many words, each led by three ends as context and closed by one; whether each is a token to predict; numbers of words, or -1."""
        found = np.asarray(pc.fill_null(pc.index_in(words, value_set=self.words), -1)).astype(np.int64)
        own, rare = found.copy(), np.flatnonzero(found < 0)
        if self.more:
            others = words.take(pa.array(rare)).to_numpy(zero_copy_only=False).tolist()
            found[rare] = np.fromiter(map(self.more.get, others, repeat(-1)), np.int64, len(rare))
        _, offsets, data = words.buffers()
        last = np.frombuffer(offsets, np.int32)[words.offset + 1 :][rare] - 1
        own[rare] = self.shape.known + np.frombuffer(data or b"", np.uint8)[last].astype(np.int64) % self.shape.rare
        ends = np.cumsum(sizes + 4)
        use = np.ones(len(found) + 4 * len(sizes), bool)
        word = use.copy()
        for i in range(1, 5):
            word[ends - (i if i == 1 else sizes + i)] = False
        use[np.concatenate([ends - sizes - i for i in (2, 3, 4)])] = False
        symbols, numbers = (np.full(len(use), self.end) for _ in range(2))
        symbols[word], numbers[word] = own, found
        return symbols, use, numbers


class Weights:
    def __init__(self, shape: Shape, class_bias: np.ndarray, member_bias: np.ndarray) -> None:
        self.shape = shape
        self.class_bias, self.member_bias = class_bias.astype(np.float32), member_bias.astype(np.float32)
        if shape.sets > 1:
            chance = np.zeros((shape.classes, shape.sets * shape.set_members))
            chance[:, : shape.members] = np.exp(member_bias)
            chance = chance.reshape(shape.classes, shape.sets, shape.set_members)
            of_set = chance.sum(2)
            with np.errstate(divide="ignore", invalid="ignore"):  # places without a member: no chance
                self.set_bias = np.log(of_set).astype(np.float32)
                inner = np.log(chance / of_set[:, :, None]).astype(np.float32)
            self.inner_bias = np.nan_to_num(inner, nan=0, neginf=-np.inf).reshape(-1, shape.set_members)
        self.tables = [np.zeros(x, np.float32) for x in shape.tables]

    def features(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Four hashes of the context of each place, one per row."""
        one, two, three = (symbols[at - i].astype(np.uint64) for i in (1, 2, 3))
        base = np.stack([one * np.uint64(4), two * np.uint64(4) + np.uint64(1), three * np.uint64(4) + np.uint64(2), (one * np.uint64(1 << 20) + two) * np.uint64(4) + np.uint64(3)])
        return (base + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)

    @staticmethod
    def rows(hashes: np.ndarray, size: int) -> np.ndarray:
        return (((hashes ^ (hashes >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(32)) * np.uint64(size) >> np.uint64(32)).astype(np.intp)

    def chunk(self, table: int) -> int:
        """Places whose chances by this table are made at a time."""
        return CHUNK * max(1, NARROW // self.tables[table].shape[1])

    def logits(self, table: int, rows: np.ndarray, bias: np.ndarray, out: np.ndarray, more: np.ndarray) -> None:
        """Sums of the places' rows and bias into `out`; `more` is room for a row each."""
        weights = self.tables[table]
        weights.take(rows[0], 0, out=out, mode="clip")
        for r in rows[1:]:
            weights.take(r, 0, out=more, mode="clip")
            out += more
        out += bias

    def exps(
        self, table: int, rows: np.ndarray, bias: np.ndarray, out: np.ndarray, more: np.ndarray, column: np.ndarray
    ) -> tuple[np.ndarray, np.ndarray]:
        """exp of the logits into `out`; their sums, and the logits in the right columns.

        Only where a sum leaves the range of its type are logits taken less the greatest of their place.
        """
        ones, place = np.ones(out.shape[1], np.float32), np.arange(len(out)) * out.shape[1] + column
        self.logits(table, rows, bias, out, more)
        right = out.take(place)
        with np.errstate(over="ignore"):
            np.exp(out, out=out)
            sums = out @ ones
        if len(sums) and not (sums.min() > 1e-30 and sums.max() < 1e30):
            self.logits(table, rows, bias, out, more)
            out -= out.max(1, keepdims=True)
            right = out.take(place)
            np.exp(out, out=out)
            sums = out @ ones
        return sums, right

    def parts(self, features: np.ndarray, target: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """For classes, then members, or sets and members in them: table, the places that it concerns, rows of weights,
        biases, right column."""
        shape = self.shape
        known = target < shape.known
        group = np.where(known, target // shape.members, shape.classes + target - shape.known)
        yield 0, np.arange(len(target)), self.rows(features, len(self.tables[0])), self.class_bias[None], group
        own = np.flatnonzero(known)
        group, member = group[own], target[own] % shape.members
        hashes = features[:, own] + (group.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
        rows = self.rows(hashes, len(self.tables[1]))
        if shape.sets == 1:
            yield 1, own, rows, self.member_bias.take(group, 0), member
            return
        of, inner = np.divmod(member, shape.set_members)
        yield 1, own, rows, self.set_bias.take(group, 0), of
        hashes += (of.astype(np.uint64) + np.uint64(1)) * np.uint64(0xA0761D6478BD642F)
        yield 2, own, self.rows(hashes, len(self.tables[2])), self.inner_bias.take(group * shape.sets + of, 0), inner

    def log_chances(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Natural log of the chance of the symbols at these places."""
        out = np.zeros(len(at))
        x_of, more = ([np.empty((self.chunk(t), x.shape[1]), np.float32) for t, x in enumerate(self.tables)] for _ in range(2))
        for s in range(0, len(at), self.shape.batch):
            place = at[s : s + self.shape.batch]
            for t, own, rows, bias, column in self.parts(self.features(symbols, place), symbols[place]):
                for a in range(0, len(own), self.chunk(t)):
                    b = min(len(own), a + self.chunk(t))
                    sums, right = self.exps(t, rows[:, a:b], bias if len(bias) == 1 else bias[a:b], x_of[t][: b - a], more[t][: b - a], column[a:b])
                    out[s + own[a:b]] += right - np.log(sums)
        return out

    def learn(self, symbols: np.ndarray, at: np.ndarray, squares: list[np.ndarray], touched: list[np.ndarray]) -> None:
        """Gradient steps (a rate per row, falling with its past gradients) over batches of places in order.

        A batch's chances are made for a chunk of places at a time, which stay in the cache.
        """
        slopes = [np.empty((self.shape.batch, x.shape[1]), np.float32) for x in self.tables]
        more = [np.empty((self.chunk(t), x.shape[1]), np.float32) for t, x in enumerate(self.tables)]
        for s in range(0, len(at), self.shape.batch):
            place = at[s : s + self.shape.batch]
            for t, own, rows, bias, column in self.parts(self.features(symbols, place), symbols[place]):
                n, chunk = len(own), self.chunk(t)
                if not n:
                    continue
                slope, table = slopes[t][:n], self.tables[t]
                for a in range(0, n, chunk):
                    b = min(n, a + chunk)
                    x = slope[a:b]
                    sums, _ = self.exps(t, rows[:, a:b], bias if len(bias) == 1 else bias[a:b], x, more[t][: b - a], column[a:b])
                    x *= (1 / sums)[:, None]
                slope.reshape(-1)[np.arange(n) * slope.shape[1] + column] -= 1
                met, count, sums = _sums_by_row(slope, rows, chunk)
                touched[t][met] += count
                for a in range(0, len(met), chunk):
                    some, step = met[a : a + chunk], sums[a : a + chunk]
                    square = squares[t][some] + np.einsum("ij,ij->i", step, step) / step.shape[1]
                    squares[t][some] = square
                    step *= (-self.shape.rates[t] / np.sqrt(square + 1e-6))[:, None]
                    step += table.take(some, 0, out=more[t][: len(some)], mode="clip")
                    table[some] = step


def _sums_by_row(slope: np.ndarray, rows: np.ndarray, chunk: int = CHUNK) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each row of weights, how often it is met, and the sum of the slopes of the places that meet it.

    Most are met a few times: the first meetings of `chunk` rows, met about as often, are added up at once, then the
    second ones, and so on, while their sums stay in the cache. The few that are met often are summed one by one.
    """
    met = np.sort((rows.astype(np.int64) << 32 | np.arange(rows.shape[1])).ravel())  # a row's meetings, in order of places
    place, met = met & 0xFFFFFFFF, met >> 32
    first = np.append(0, np.flatnonzero(met[1:] != met[:-1]) + 1)
    count = np.diff(first, append=len(met))
    by_count = np.argsort(OFTEN - np.minimum(count, OFTEN).astype(np.uint8), kind="stable")
    first, count = first[by_count], count[by_count]
    sums = np.empty((len(first), slope.shape[1]), np.float32)
    often = int((count >= OFTEN).sum())
    ones = np.ones(int(count[:often].max(initial=0)), np.float32)
    more = np.empty((min(chunk, len(first)), slope.shape[1]), np.float32)
    for i in range(often):
        np.dot(ones[: count[i]], slope.take(place[first[i] : first[i] + count[i]], 0), out=sums[i])
    for a in range(often, len(first), chunk):
        begin, times, some = first[a : a + chunk], count[a : a + chunk], sums[a : a + chunk]
        slope.take(place[begin], 0, out=some, mode="clip")
        for n, upto in enumerate(np.searchsorted(-times, -np.arange(1, times[0]), side="left").tolist(), 1):
            some[:upto] += slope.take(place[begin[:upto] + n], 0, out=more[:upto], mode="clip")
    return met[first], count, sums


def token_counts(docs: DataFrame) -> DataFrame:
    """(word, n) of the column _bytes: lower-cased words (A-Z), and END once per row."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, size, rows = [], 0, 0
        for batch in batches:
            for _, _, texts in slices(batch, "_bytes", 1 << 20):
                words, _ = split_words(texts)
                waiting.append(words)
                size, rows = size + len(words), rows + len(texts)
                if size >= WAITING:
                    yield counted(waiting, rows)
                    waiting, size, rows = [], 0, 0
        if rows:
            yield counted(waiting, rows)

    def counted(words: list[pa.Array], rows: int) -> pa.RecordBatch:
        found = pa.chunked_array(words, pa.binary()).value_counts()
        return pa.RecordBatch.from_arrays(
            [pa.concat_arrays([found.field("values"), pa.array([END], pa.binary())]), pa.concat_arrays([found.field("counts"), pa.array([rows], pa.int64())])], ["word", "n"]
        )

    return docs.select("_bytes").mapInArrow(emit, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _numbered(docs: DataFrame, sent: Broadcast[Vocabulary]) -> DataFrame:
    """(_part, _place, _symbols): the symbols of each text, led by three ends and closed by one, as bytes."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = sent.value
        kind = np.dtype(vocabulary.shape.symbol)
        for batch in batches:
            for start, stop, texts in slices(batch, "_bytes", 1 << 20):
                words, sizes = split_words(texts)
                symbols = vocabulary.symbols(words, sizes)[0].astype(kind)
                ends = np.append(0, np.cumsum(sizes + 4) * kind.itemsize).astype(np.int32)
                made = pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(ends), pa.py_buffer(symbols)])
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(start, stop - start) for c in ("_part", "_place")), made], ["_part", "_place", "_symbols"])

    return docs.select("_part", "_place", "_bytes").mapInArrow(emit, "_part long, _place long, _symbols binary")


def _round(docs: DataFrame, parts: int, weights: Weights) -> None:
    """One round of distributed updates: each part's texts (_part, in order) step from the same weights; rows are then
    averaged, weighted by how often each part met them."""
    sent = docs.sparkSession.sparkContext.broadcast(weights)
    widths = [t.shape[1] for t in weights.tables]

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        start = sent.value
        kind = start.shape.symbol
        part, own, squares, touched, waiting, size = None, None, [], [], [], 0

        def learn() -> None:
            symbols = np.frombuffer(b"".join(waiting), kind).astype(np.int64)
            use = np.ones(len(symbols), bool)
            first = np.cumsum([0, *map(len, waiting)])[:-1] // np.dtype(kind).itemsize
            for i in range(3):
                use[first + i] = False
            own.learn(symbols, np.flatnonzero(use), squares, touched)

        def told() -> pa.RecordBatch:
            if waiting:
                learn()
            blocks, values = [], []
            for t, table in enumerate(own.tables):
                sums = np.hstack([(table - start.tables[t]) * touched[t][:, None], touched[t][:, None]]).astype(np.float32)
                for b in np.unique(np.flatnonzero(touched[t]) // BLOCK):
                    blocks.append(len(own.tables) * int(b) + t)
                    values.append(sums[b * BLOCK : (b + 1) * BLOCK].tobytes())
            return pa.RecordBatch.from_arrays(
                [pa.array(blocks, pa.int64()), pa.array([part] * len(blocks), pa.int64()), pa.array(values, pa.binary())], ["block", "task", "sums"]
            )

        for batch in batches:
            for first, _, texts in slices(batch, "_symbols", 1 << 20):
                for group, text in zip(batch.column("_part").slice(first, len(texts)).to_pylist(), texts, strict=True):
                    if group != part:
                        if own is not None:
                            yield told()
                        part, own, waiting, size = group, Weights(start.shape, start.class_bias, start.member_bias), [], 0
                        own.tables = [t.copy() for t in start.tables]
                        squares, touched = ([np.zeros(len(t), np.float32) for t in own.tables] for _ in range(2))
                    # steps are over the part's texts, however they come in batches
                    waiting.append(text)
                    size += len(text) // np.dtype(kind).itemsize
                    if size >= RUN:
                        learn()
                        waiting, size = [], 0
        if own is not None:
            yield told()

    def add(table: pa.Table) -> pa.Table:
        total = np.zeros(0, np.float32)
        for value in table.column("sums").to_pylist():
            own = np.frombuffer(value, np.float32)
            total = own.copy() if not len(total) else total + own
        return pa.table({"block": table.column("block").slice(0, 1), "task": pa.array([table.column("task")[0].as_py()]), "sums": pa.array([total.tobytes()], pa.binary())})

    schema = "block long, task long, sums binary"
    partial = docs.select("_part", "_symbols").mapInArrow(emit, schema)
    width = 1
    while True:
        width *= FAN_IN
        grouped = partial.withColumn("group", F.floor(F.col("task") / width)).groupBy("block", "group")
        partial = grouped.applyInArrow(add, schema)
        if width >= parts:
            break
    for r in partial.collect():  # at most the rows of the tables
        b, t = divmod(r["block"], len(widths))
        sums = np.frombuffer(r["sums"], np.float32).reshape(-1, widths[t] + 1)
        weights.tables[t][b * BLOCK : (b + 1) * BLOCK] += sums[:, :-1] / np.maximum(sums[:, -1:], 1)


def _threshold(counts: DataFrame, most: int) -> int:
    """A count that at most `most` words reach, from the number of words per eighth of a power of two."""
    step = F.floor(F.log2("n") * 8).alias("step")
    found, least = 0, 1 << 62
    for r in sorted(counts.groupBy(step).count().collect(), reverse=True):  # some hundred rows
        found += r["count"]
        if found > most:
            break
        least = int(np.ceil(2 ** (r["step"] / 8) - 1e-9))
    return least


def _biases(shape: Shape, counts: np.ndarray, rare: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    known = (counts + 0.1).reshape(shape.classes, shape.members)
    groups = np.concatenate([known.sum(1), rare])
    return np.log(groups / groups.sum()), np.log(known / known.sum(1, keepdims=True))


def scored(docs: DataFrame, held_out: Column, *, doc_id: str = "doc_id", text: str = "text", shape: Shape | None = None) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score), a row per row of docs.

    Tokens are the words, A-Z in lower case, and one end. Rows that are not held out are training. base_score: sum of
    log10((c + 0.1) / (N + 0.1 * (V + 1))). score: log10 chance of the text in the model: the chance of the
    token's class given its context, times that of the token in its class, given the context too for frequent ones, by
    training counts (plus 0.1; unseen ones of a class together 0.1) for rare ones. So the chances add up to one.

    Without a shape, the model's sizes follow the training tokens and their vocabulary (Shape.of).
    All training text is read in each of: counting, and `rounds` parts that make one pass of gradient updates. Counts
    of the `direct` most frequent words go to each task; those of others are joined.

    A null text is empty: its one token is the end. An empty table, and one without training rows, works: N is 0 then.
    Repeated rows each train and each get a row. Other columns are ignored.
    """
    spark = docs.sparkSession
    shared_folder(spark)
    own = docs.select(F.col(doc_id).alias("doc_id"), held_out.alias("held_out"), F.col(text).cast("binary").alias("_bytes"))
    training = own.where(~F.col("held_out"))
    counts = staged(token_counts(training), "token-counts")
    total = counts.agg(F.sum("n").alias("n"), F.count("*").alias("v")).first()
    n, v = total["n"] or 0, total["v"] or 0
    shape = shape or Shape.of(n, v)
    least = _threshold(counts, shape.direct)
    top = counts.where(F.col("n") >= least).toArrow()
    direct = dict(zip(top.column("word").to_pylist(), top.column("n").to_pylist(), strict=True))
    direct[END] = training.count()
    frequent = sorted(((w, c) for w, c in direct.items() if w != END), key=lambda x: (-x[1], x[0]))[: shape.known - 1]
    frequent = sorted([*frequent, (END, direct[END])], key=lambda x: -x[1])
    frequent += [(b"\x00 %d" % i, 0) for i in range(shape.known - len(frequent))]  # fillers: no word has a space
    names = spark.createDataFrame([(bytearray(w),) for w, _ in frequent], "word binary")
    last = F.conv(F.hex(F.substring("word", -1, 1)), 16, 10).cast("int")
    masses = counts.join(F.broadcast(names), "word", "left_anti").groupBy((last % shape.rare).alias("r")).agg(F.sum(F.col("n") + 0.1).alias("m")).collect()
    rare = np.full(shape.rare, 0.1)
    for r in masses:
        rare[r["r"]] += r["m"]
    weights = Weights(shape, *_biases(shape, np.array([c for _, c in frequent], float), rare))
    part = F.pmod(F.xxhash64(F.lit(3), "_bytes"), F.lit(shape.rounds))
    # texts are dealt to parts, and ordered, by a hash: tokens alone say how many models are averaged, and of which texts
    parts, place = max(1, -(-n // (PART_TOKENS * shape.rounds))), F.xxhash64("doc_id", "_bytes")
    known = spark.sparkContext.broadcast(Vocabulary(shape, frequent))
    for i in range(shape.rounds):
        own_texts = training.where(part == i).select(F.pmod(place, F.lit(parts)).alias("_part"), place.alias("_place"), "_bytes")
        # symbols are dealt, which are shorter than texts
        _round(_numbered(own_texts, known).repartition("_part").sortWithinPartitions("_part", "_place"), parts, weights)
    # one look-up per word gives its symbol and its count
    own_words = set(w for w, _ in frequent)
    others = [w for w in direct if w not in own_words]
    logs10 = np.log10(np.array([c for _, c in frequent] + [direct[w] for w in others], float) + 0.1)
    sent = spark.sparkContext.broadcast((weights, Vocabulary(shape, frequent, others), logs10, np.log10(rare), direct[END] == 0))
    floor = np.log10(n + 0.1 * (v + 1))
    kinds = [pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.list_(pa.binary()), pa.list_(pa.int64())]
    names_out = ["n_tokens", "n_known", "base", "score", "rest", "times"]

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, vocabulary, logs10, rare, zero = sent.value
        for batch in batches:
            for start, stop, texts in slices(batch, "_bytes", 1 << 21):
                words, sizes = split_words(texts)
                symbols, use, numbers = vocabulary.symbols(words, sizes)
                at = np.flatnonzero(use)
                chance = weights.log_chances(symbols, at) / np.log(10)
                later = numbers[at] < 0  # words whose counts are joined later
                counted = np.where(later, 0, logs10.take(numbers[at], mode="clip"))
                is_rare = symbols[at] >= weights.shape.known
                chance[is_rare] += counted[is_rare] - rare[symbols[at][is_rare] - weights.shape.known]
                first = np.cumsum(sizes + 1) - sizes - 1
                base, score, open_ = (np.add.reduceat(x, first) for x in (counted - floor, chance, later.astype(np.int64)))
                unknown = iter(words.take(pa.array(np.flatnonzero(later[np.delete(np.arange(len(at)), first + sizes)]))).to_pylist())
                rest = [Counter(islice(unknown, k)) if k else {} for k in open_.tolist()]
                columns = [batch.column(c).slice(start, stop - start) for c in ("rid", "doc_id", "held_out")]
                made = (sizes + 1, sizes + 1 - open_ - zero, base, score, [list(x) for x in rest], [list(x.values()) for x in rest])
                columns += [pa.array(c, k) for c, k in zip(made, kinds, strict=True)]
                yield pa.RecordBatch.from_arrays(columns, ["rid", "doc_id", "held_out", *names_out])

    kind = own.schema["doc_id"].dataType.simpleString()
    made = staged(
        own.withColumn("rid", F.monotonically_increasing_id()).select("rid", "doc_id", "held_out", "_bytes").mapInArrow(
            emit, f"rid long, doc_id {kind}, held_out boolean, n_tokens long, n_known long, base double, score double, rest array<binary>, times array<long>"
        ), "scores",
    )
    rest = made.select("rid", F.explode(F.arrays_zip("rest", "times")).alias("x")).select("rid", F.col("x.rest").alias("word"), F.col("x.times").alias("times"))
    found = rest.join(counts.where(F.col("n") < least), "word", "left").groupBy("rid").agg(
        F.sum(F.when(F.col("n") > 0, F.col("times")).otherwise(0)).alias("more_known"),
        F.sum(F.col("times") * F.log10(F.coalesce("n", F.lit(0)) + F.lit(0.1))).alias("more"),
    )
    found = staged(found, "rest-scores")
    unstage(counts)
    more = lambda c: F.coalesce(c, F.lit(0))
    return made.drop("rest", "times").join(found, "rid", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + more("more_known")).alias("n_known"), F.lit(n).cast("long").alias("train_tokens"),
        (F.col("base") + more("more")).alias("base_score"), (F.col("score") + more("more")).alias("score"),
    )

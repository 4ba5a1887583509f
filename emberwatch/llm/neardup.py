"""Near-duplicate documents by SetSketch registers, bands, joint likelihood and exact sets."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, WordHashes, fresh, mixed, shared_folder, slices, staged, unstage
from .components import components

#: Rows of an estimation cell on either side; cells, not whole buckets, meet in a task.
CELL = 256
#: Buckets of at most so many nodes are compared by a join.
SMALL = 32


class Sketch:
    """SetSketch parameters: `bands` times `rows` registers, values spaced by powers of `base`.

    A register is floor(1 - log_base(x)) for the least x of exponentially distributed hashes
    of the set (rate `rate`), cut to 0..65535. Registers of a union are the maxima of the
    registers, so sketches merge. Equal registers are the likelier, the more similar two sets.
    """

    def __init__(self, bands: int = 20, rows: int = 5, base: float = 1.001, rate: float = 20.0) -> None:
        self.bands, self.rows, self.base, self.rate = bands, rows, base, rate
        self.size = bands * rows

    def registers(self, hashes: np.ndarray) -> np.ndarray:
        """The registers of a non-empty set of 64-bit hashes."""
        low = hashes.astype(np.uint32)[:, None]
        high = (hashes >> np.uint64(32)).astype(np.uint32)[:, None] | np.uint32(1)
        index = np.arange(1, self.size + 1, dtype=np.uint32)[None, :]
        least = np.full(self.size, 0xFFFFFFFF, dtype=np.uint32)
        for at in range(0, len(hashes), 1024):
            v = low[at : at + 1024] + high[at : at + 1024] * index
            v ^= v >> np.uint32(16)
            v *= np.uint32(0x7FEB352D)
            v ^= v >> np.uint32(15)
            v *= np.uint32(0x846CA68B)
            v ^= v >> np.uint32(16)
            np.minimum(least, v.min(axis=0), out=least)
        x = -np.log1p(-(least + 0.5) / 2.0**32) / self.rate
        return np.clip(np.floor(1 - np.log(x) / np.log(self.base)), 0, 65535).astype("<u2")

    def log_likelihood(self, above: np.ndarray, below: np.ndarray, share: np.ndarray, jaccard: float | np.ndarray):
        """Of the counts of registers above and below the other's, if the sets' similarity is jaccard.

        share: first set's part of the sum of both sizes.
        """
        chance = lambda x: -np.log1p(-np.clip(x, 1e-12, 1) * (self.base - 1) / self.base) / np.log(self.base)
        more = np.clip(chance(share - (1 - share) * jaccard), 1e-12, 1)
        less = np.clip(chance((1 - share) - share * jaccard), 1e-12, 1)
        same = np.clip(1 - more - less, 1e-12, 1)
        return above * np.log(more) + below * np.log(less) + (self.size - above - below) * np.log(same)

    def may_reach(self, a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, least: float) -> np.ndarray:
        """False where the likelihood rules a similarity of `least` out (4.5 deviations), row by row."""
        above, below = (a > b).sum(-1), (a < b).sum(-1)
        share = n_a / (n_a + n_b)
        fits = self.log_likelihood(above, below, share, least)
        best = np.full(np.shape(above), -np.inf)
        for j in np.linspace(least / 4, least, 16):
            best = np.maximum(best, self.log_likelihood(above, below, share, j))
        return 2 * (best - fits) <= 20


def shingles(words: np.ndarray, k: int) -> np.ndarray:
    """The distinct hashes, sorted, of runs of k word hashes; of the whole sequence if shorter."""
    if not len(words):
        return words
    if len(words) < k:
        return mixed(np.array([xxhash.xxh3_64_intdigest(words.tobytes(), seed=len(words))], dtype=np.uint64))
    total = np.zeros(len(words) - k + 1, dtype=np.uint64)
    for i in range(k):
        total = total * np.uint64(0x9E3779B97F4A7C15) + words[i : i + len(total)]
    return np.unique(mixed(total))


def _sets(batches: Iterator[pa.RecordBatch], k: int, emit, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    hashes = WordHashes()
    for batch in batches:
        rest = [n for n in batch.schema.names if n != "bytes"]
        for start, end, texts in slices(batch, "bytes"):
            made = [emit(shingles(hashes.of((t or b"").lower().split()), k)) for t in texts]
            own = [batch.column(n).slice(start, end - start) for n in rest]
            yield pa.RecordBatch.from_arrays(
                [*own, *(pa.array(v, f.type) for v, f in zip(zip(*made), list(schema)[len(own):], strict=True))],
                schema=schema,
            )


def _key(hashes: np.ndarray) -> bytes | None:
    return xxhash.xxh3_128_digest(hashes.tobytes()) if len(hashes) else None


def sketches(docs: DataFrame, doc_id: str, text: str, k: int, sketch: Sketch) -> DataFrame:
    """(doc_id, text_hash, n_shingles, node, registers); node is a digest of the set, null if empty."""
    schema = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), ("n_shingles", pa.int64()), ("node", pa.binary()), ("registers", pa.binary())])

    def emit(h: np.ndarray) -> tuple:
        return len(h), _key(h), sketch.registers(h).tobytes() if len(h) else None

    own = docs.select(
        F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"),
        F.col(text).cast("binary").alias("bytes"),
    )
    return own.mapInArrow(
        lambda batches: _sets(batches, k, emit, schema),
        "doc_id long, text_hash long, n_shingles long, node binary, registers binary",
    )


def _sets_of(wanted: DataFrame, nodes: DataFrame, docs: DataFrame, doc_id: str, text: str, k: int) -> DataFrame:
    """(node, shingles) of the wanted nodes, from the texts of their representatives."""
    wanted = nodes.join(wanted, "node").select("rep_id", "rep_hash").checkpoint()
    schema = pa.schema([("node", pa.binary()), ("shingles", pa.list_(pa.int64()))])
    own = docs.select(
        F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"),
        F.col(text).cast("binary").alias("bytes"),
    )
    both = (own.text_hash == wanted.rep_hash) & own.doc_id.eqNullSafe(wanted.rep_id)
    texts = own.join(wanted, both, "left_semi").select("bytes")
    made = texts.mapInArrow(
        lambda batches: _sets(batches, k, lambda h: (_key(h), h.view(np.int64)), schema),
        "node binary, shingles array<bigint>",
    )
    return made.dropDuplicates(["node"])


def _verified(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, doc_id: str, text: str, k: int, least: int) -> DataFrame:
    """The pairs (a, b) for which 100 * intersection size >= least * union size."""
    ends = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    sets = staged(_sets_of(ends, nodes, docs, doc_id, text, k), "shingle-sets")
    one = sets.select(F.col("node").alias("a"), F.col("shingles").alias("set_a"))
    two = sets.select(F.col("node").alias("b"), F.col("shingles").alias("set_b"))
    both = F.size(F.array_intersect("set_a", "set_b"))
    union = F.size("set_a") + F.size("set_b") - F.col("both")
    good = (
        pairs.join(one, "a").join(two, "b")
        .select("a", "b", "set_a", "set_b", both.alias("both"))
        .where(F.col("both") * 100 >= union * least).select("a", "b").checkpoint()
    )
    unstage(sets)
    return good


def _fits_size(n_a: Column, n_b: Column, least: int) -> Column:
    return F.least(n_a, n_b) * 100 >= F.greatest(n_a, n_b) * least


def _likely(pairs: DataFrame, nodes: DataFrame, sketch: Sketch, least: int) -> DataFrame:
    """The pairs whose registers do not rule out the similarity."""
    own = nodes.select("node", "registers", "n_shingles")
    one = own.toDF("a", "reg_a", "n_a")
    two = own.toDF("b", "reg_b", "n_b")
    full = pairs.join(one, "a").join(two, "b").select("a", "b", "reg_a", "reg_b", "n_a", "n_b")
    schema = pa.schema([("a", pa.binary()), ("b", pa.binary())])

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                reg = [_matrix(part.column(c).to_pylist(), sketch) for c in ("reg_a", "reg_b")]
                size = [part.column(c).to_numpy() for c in ("n_a", "n_b")]
                mask = sketch.may_reach(*reg, *size, least / 100)
                yield pa.RecordBatch.from_arrays(
                    [part.column(c).filter(pa.array(mask)) for c in ("a", "b")], schema=schema
                )

    return full.mapInArrow(keep, "a binary, b binary")


def _matrix(registers: list[bytes], sketch: Sketch) -> np.ndarray:
    return np.frombuffer(b"".join(registers), dtype="<u2").reshape(-1, sketch.size)


def _small_pairs(members: DataFrame, labels: DataFrame, least: int) -> DataFrame:
    """Pairs of different components in buckets of at most SMALL nodes."""
    own = members.where(F.col("met") <= SMALL).join(labels, "node", "left").select(
        "key", "node", "n_shingles", F.coalesce("label", "node").alias("label")
    ).checkpoint()
    mixed_keys = own.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high")
    own = own.join(mixed_keys.select("key").checkpoint(), "key", "left_semi").checkpoint()
    one = own.select("key", F.col("node").alias("a"), F.col("n_shingles").alias("n_a"), F.col("label").alias("label_a"))
    two = own.select("key", F.col("node").alias("b"), F.col("n_shingles").alias("n_b"), F.col("label").alias("label_b"))
    return one.join(two, "key").where(
        (F.col("a") < F.col("b")) & (F.col("label_a") != F.col("label_b")) & _fits_size(F.col("n_a"), F.col("n_b"), least)
    ).select("a", "b").distinct()


def _cell_links(members: DataFrame, labels: DataFrame, nodes: DataFrame, docs: DataFrame, doc_id: str, text: str, k: int, sketch: Sketch, least: int) -> DataFrame:
    """Links that join different components in buckets of more than SMALL nodes.

    A bucket is dealt into cells of at most about CELL by CELL rows: blocks of its largest component
    against blocks of the rest, and blocks of the rest against each other. A cell compares
    full sets where the registers allow it, likeliest pairs first, skips what it
    has connected already, and so returns fewer links than it has rows. A pair is looked
    at only in the bucket of the first band that its ends share.
    """
    own = members.where(F.col("met") > SMALL).join(labels, "node", "left").select(
        "key", "band", "node", F.coalesce("label", "node").alias("label")
    ).checkpoint()
    parts = own.groupBy("key", "label").agg(F.count("*").alias("n")).checkpoint()
    largest = parts.groupBy("key").agg(
        F.max(F.struct("n", "label")).alias("top"), F.sum("n").alias("all"), F.count("*").alias("parts")
    ).where("parts > 1").select(
        "key", F.col("top.label").alias("top"),
        F.ceil(F.col("top.n") / CELL).alias("top_blocks"),
        F.ceil((F.col("all") - F.col("top.n")) / CELL).alias("rest_blocks"),
    ).checkpoint()
    rows = own.join(largest, "key").withColumn("is_top", F.col("label") == F.col("top")).withColumn(
        "block", F.pmod(F.xxhash64("node"), F.when(F.col("is_top"), F.col("top_blocks")).otherwise(F.col("rest_blocks")))
    ).checkpoint()
    sets = staged(_sets_of(rows.select("node").distinct(), nodes, docs, doc_id, text, k), "cell-sets")
    every = lambda n, make: F.transform(F.sequence(F.lit(0).cast("long"), F.col(n) - 1), make)
    cell = lambda kind, i, j: F.struct(F.lit(kind).alias("kind"), i.alias("i"), j.alias("j"))
    block = F.col("block")
    cells = F.when(F.col("is_top"), every("rest_blocks", lambda j: cell(0, block, j))).otherwise(F.concat(
        every("top_blocks", lambda i: cell(0, i, block)),
        every("rest_blocks", lambda j: cell(1, F.least(block, j), F.greatest(block, j))),
    ))
    dealt = rows.join(sets, "node").join(nodes.select("node", "registers"), "node").withColumn("cell", F.explode(cells))
    dealt = dealt.select("key", "band", "node", "label", "is_top", "block", "registers", "shingles", "cell.*")

    def links(table: pa.Table) -> pa.Table:
        kind, i, j, band = (table.column(c)[0].as_py() for c in ("kind", "i", "j", "band"))
        top, at = table.column("is_top").to_numpy(zero_copy_only=False), table.column("block").to_numpy()
        left = np.flatnonzero(top) if kind == 0 else np.flatnonzero(at == i)
        right = np.flatnonzero(~top) if kind == 0 else np.flatnonzero(at == j)
        reg = _matrix(table.column("registers").to_pylist(), sketch)
        whole = [frozenset(x) for x in table.column("shingles").to_pylist()]
        size = np.fromiter(map(len, whole), np.int64, len(whole))
        node = table.column("node").to_pylist()
        label = np.unique(np.array(table.column("label").to_pylist(), dtype=object), return_inverse=True)[1]
        n, m = size[left][:, None], size[right][None, :]
        x, y = np.nonzero((label[left][:, None] != label[right][None, :]) & (np.minimum(n, m) * 100 >= np.maximum(n, m) * least))
        x, y = left[x], right[y]
        likely = []
        for s in range(0, len(x), 1 << 14):
            p, q = x[s : s + (1 << 14)], y[s : s + (1 << 14)]
            same = (reg[p] == reg[q]).reshape(len(p), sketch.bands, sketch.rows)
            own = same[:, :band].all(-1).sum(-1) == 0
            p, q, same = p[own], q[own], same[own].sum((1, 2))
            own = sketch.may_reach(reg[p], reg[q], size[p], size[q], least / 100)
            likely.append(np.stack([same[own], p[own], q[own]]))
        pairs = np.concatenate(likely, 1) if likely else np.zeros((3, 0), np.int64)
        above = list(range(label.max() + 1))

        def root(v: int) -> int:
            while above[v] != v:
                above[v] = above[above[v]]
                v = above[v]
            return v

        found = []
        for u in np.argsort(-pairs[0], kind="stable"):
            a, b = int(pairs[1, u]), int(pairs[2, u])
            one, two = root(label[a]), root(label[b])
            if one != two:
                both = len(whole[a] & whole[b])
                if both * 100 >= (size[a] + size[b] - both) * least:
                    above[max(one, two)] = min(one, two)
                    found.append(sorted((node[a], node[b])))
        return pa.table({"a": pa.array([a for a, _ in found], pa.binary()), "b": pa.array([b for _, b in found], pa.binary())})

    made = dealt.groupBy("key", "kind", "i", "j").applyInArrow(links, "a binary, b binary").distinct().checkpoint()
    unstage(sets)
    return made


def near_duplicates(
    docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", k: int = 5, least: int = 85,
    sketch: Sketch | None = None,
) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept, n_links, node, component, text_hash): a row per row of docs.

    Texts are sets of distinct k-word shingles (A-Z lower-cased; the whole sequence if there are fewer
    words). Rows with the same set are one node. Nodes that share a band of registers are
    candidates. In each bucket the node that meets the most others is compared with the
    rest; what is not connected then is compared in pairs (small buckets) or in cells (large
    ones), so that every candidate pair is either
    connected or compared. Links need
    100 * intersection >= least * union of the full sets. component_id is the smallest doc_id
    that can be reached; n_links counts the links of the row's set to other sets that were confirmed on the way
    (at least one if it has any); node and component are
    digests of the set and of the component's smallest set (null for empty sets).

    Nulls and texts without words are empty sets: linked with nothing, component_id is their
    own id. Null ids never become a component_id unless no other is there; kept compares
    null-safely. Repeated rows share a node. Other columns are ignored.
    """
    sketch = sketch or Sketch()
    shared_folder(docs.sparkSession)
    drawn = staged(sketches(docs, doc_id, text, k, sketch), "sketches")
    nodes = staged(
        drawn.where("node is not null").groupBy("node").agg(
            F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash")).alias("rep"),
            F.max("n_shingles").alias("n_shingles"), F.min("registers").alias("registers"),
        ).select("node", F.col("rep.doc_id").alias("rep_id"), F.col("rep.text_hash").alias("rep_hash"), "n_shingles", "registers"),
        "nodes",
    )
    width = 2 * sketch.rows
    keys = F.array(*[F.xxhash64(F.lit(i), F.substring("registers", i * width + 1, width)) for i in range(sketch.bands)])
    rows = nodes.select("node", "n_shingles", F.posexplode(keys).alias("band", "key"))
    sizes = rows.groupBy("key").agg(F.count("*").alias("met")).where("met > 1").checkpoint()
    members = staged(rows.join(sizes, "key"), "members")
    degrees = members.groupBy("node").agg(F.sum("met").alias("degree")).checkpoint()
    hubs = members.join(degrees, "node").groupBy("key").agg(
        F.max(F.struct("degree", "node", "n_shingles")).alias("hub")
    ).select("key", F.col("hub.node").alias("hub"), F.col("hub.n_shingles").alias("n_hub")).checkpoint()
    stars = members.join(hubs, "key").where(
        (F.col("node") != F.col("hub")) & _fits_size(F.col("n_shingles"), F.col("n_hub"), least)
    ).select(F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b")).distinct().checkpoint()
    links = _verified(_likely(stars, nodes, sketch, least).checkpoint(), nodes, docs, doc_id, text, k, least)
    labels = components(links)
    few = _small_pairs(members, labels, least).join(stars, ["a", "b"], "left_anti")
    few = _likely(few, nodes, sketch, least).checkpoint()
    more = _cell_links(members, labels, nodes, docs, doc_id, text, k, sketch, least)
    links = links.union(_verified(few, nodes, docs, doc_id, text, k, least)).union(more).distinct().checkpoint()
    labels = components(links)
    degree = links.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("n_links"))
    grouped = nodes.join(labels, "node").select("node", "rep_id", "label").checkpoint()
    least_id = grouped.groupBy("label").agg(F.min("rep_id").alias("least_id")).checkpoint()
    named = grouped.join(least_id, "label").join(degree, "node").select("node", "label", "least_id", "n_links").checkpoint()
    named = staged(
        nodes.select("node", "rep_id").join(named, "node", "left").select(
            "node", F.coalesce("label", "node").alias("component"), F.coalesce("least_id", "rep_id").alias("least_id"), F.coalesce("n_links", F.lit(0)).alias("n_links")
        ),
        "node-components",
    )
    for own in (members, nodes):
        unstage(own)
    return drawn.select("doc_id", "text_hash", "n_shingles", "node").join(named, "node", "left").select(
        "doc_id", "n_shingles",
        F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("least_id")).alias("component_id"),
        F.when(F.col("node").isNull(), True).otherwise(F.col("doc_id").eqNullSafe(F.col("least_id"))).alias("kept"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), "node", "component", "text_hash",
    )


def deduplicated(
    docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", k: int = 5, least: int = 85,
    sketch: Sketch | None = None,
) -> DataFrame:
    """The rows of docs with all their columns, one row of each group of near-duplicates.

    The row with the smallest id stays (nulls last; then the smallest text hash). Rows that
    repeat id and text count as one. Rows without words all stay.
    """
    keys = fresh(docs, "_no_id", "_id", "_hash")
    found = near_duplicates(docs, doc_id=doc_id, text=text, k=k, least=least, sketch=sketch)
    best = found.where("node is not null").groupBy("component").agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash")).alias("best")
    ).select(
        F.col("best.no_id").alias(keys[0]), F.coalesce("best.doc_id", F.lit(0)).alias(keys[1]),
        F.col("best.text_hash").alias(keys[2]),
    ).checkpoint()
    own = F.col(doc_id).cast("long")
    keyed = docs.withColumns({keys[0]: own.isNull(), keys[1]: F.coalesce(own, F.lit(0)), keys[2]: F.xxhash64(text)})
    worded = F.coalesce(F.col(text).rlike(WORD), F.lit(False))
    some = keyed.where(worded).dropDuplicates(keys).join(best, keys, "left_semi")
    return some.select(docs.columns).union(keyed.where(~worded).select(docs.columns))

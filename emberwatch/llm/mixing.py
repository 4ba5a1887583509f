"""Mixing sources: temperature weights, then whole epochs and a budgeted block permutation.

All native: DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import fresh, shared_folder, staged, unstage, words_of

#: Source rows up to which their table is broadcast (a few hundred bytes each).
FEW_SOURCES = 100_000
#: Digits of a block's key by which blocks are first summed, so that only one in 16^KEY_DIGITS of a source's is ordered.
KEY_DIGITS = 3


def exponent(sources: DataFrame, *, repeats: float | None = None, entropy: float | None = None) -> float:
    """The exponent a in 0..1 of the weights p^a / sum(p^a), to 6 digits, found by bisection.

    sources has the tokens per source. repeats: the least a (flattest mix) at which no source is read more
    than `repeats` times while each is read at least once. entropy: the greatest a (closest
    to the natural shares) at which the weights have at least this part of the greatest
    entropy. Each job tests the 31 points of five halvings. 1.0 if there is no such a with `repeats`, 0.0 with
    `entropy`, 1.0 without tokens.
    """
    if (repeats is None) == (entropy is None):
        raise ValueError("give either repeats or entropy")
    known = sources.where("tokens > 0")
    total = known.agg(F.sum("tokens").alias("t"), F.count("*").alias("n")).first()
    if not total["n"] or total["n"] == 1:
        return 1.0
    p, a = F.col("tokens") / float(total["t"]), F.col("a")
    low, high = 0, 1 << 30  # a in units of 2^-30
    while high - low > 1:
        points = sorted({low + (high - low) * i // 32 for i in range(1, 32)} - {low})
        tried = known.select(p.alias("p"), F.explode(F.array(*[F.lit(x) for x in points])).alias("point")).withColumn("a", F.col("point") / float(1 << 30))
        power = F.pow("p", a)
        sums = tried.groupBy("point").agg(
            F.sum(power).alias("z"), F.sum(power * a * F.log("p")).alias("e"),
            (F.max(F.pow("p", a - 1)) / F.min(F.pow("p", a - 1))).alias("most"),
        )
        if repeats is not None:
            flat = F.col("most") > repeats  # still too flat
        else:
            flat = F.log("z") - F.col("e") / F.col("z") >= entropy * F.log(F.lit(float(total["n"])))
        edge = sums.agg(F.max(F.when(flat, F.col("point"))).alias("low"), F.min(F.when(~flat, F.col("point"))).alias("high")).first()
        low, high = edge["low"] if edge["low"] is not None else low, edge["high"] if edge["high"] is not None else high
    found = (high if repeats is not None else low) / (1 << 30)
    scale = 1_000_000
    return (min(scale, -int(-found * scale // 1)) if repeats is not None else int(found * scale)) / scale


def _key(*parts: Column) -> Column:
    return F.md5(F.concat_ws(":", *[F.coalesce(x.cast("string"), F.lit("")) for x in parts]).cast("binary"))


def _block(doc_id: Column, blocks: Column) -> Column:
    return F.conv(F.substring(_key(doc_id), 1, 8), 16, 10).cast("long") % blocks


def plan(units: DataFrame, *, repeats: float | None = None, entropy: float | None = None, budget: int | None = None, block_tokens: int = 1 << 20) -> DataFrame:
    """One row per source: tokens, docs, weight, target (tokens), epochs, blocks, last_block_key, last_doc_key.

    units: (source, doc_id, tokens), one row per source and id. A source is read `epochs` times whole, then once more
    up to the block and document of the last two columns, so that it gives at most
    `target` tokens. Without a budget the targets are the least that read every source at least once.
    """
    shared_folder(units.sparkSession)
    sources = units.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("docs")).checkpoint()
    a = exponent(sources, repeats=repeats, entropy=entropy)
    some = F.when(F.col("tokens") > 0, F.col("tokens"))
    sums = sources.agg(F.sum("tokens").alias("t")).first()["t"] or 1
    share = some / float(sums)
    norm = sources.agg(F.sum(F.pow(share, F.lit(a))).alias("z"), F.min(F.pow(share, F.lit(a - 1))).alias("least")).first()
    z, least = norm["z"] or 1.0, norm["least"] or 1.0
    weight = F.coalesce(F.round(F.pow(share, F.lit(a)) / z, 9), F.lit(0.0))
    if budget is None:
        target = F.floor(F.col("tokens") * F.round(F.pow(share, F.lit(a - 1)) / least, 6))
    else:
        target = F.floor(F.lit(float(budget)) * weight)
    planned = sources.select(
        "source", "tokens", "docs", weight.alias("weight"), F.coalesce(target, F.lit(0)).cast("long").alias("target"),
        F.greatest(F.lit(1), F.ceil(F.greatest(F.col("tokens") / block_tokens, F.col("docs") / 10_000))).cast("long").alias("blocks"),
    ).withColumn("epochs", F.when(some.isNull(), F.lit(1)).otherwise(F.expr("target div tokens")).cast("long"))
    planned = planned.withColumn("rest", F.when(some.isNull(), F.lit(0)).otherwise(F.col("target") - F.col("epochs") * F.col("tokens"))).checkpoint()
    own = _with_sources(units, planned.where("rest > 0").select("source", "blocks", "epochs", "rest"))
    own = own.withColumn("block", _block(F.col("doc_id"), F.col("blocks")))
    blocks = own.groupBy("source", "block", "epochs", "rest").agg(F.sum("tokens").alias("tokens")).withColumn(
        "block_key", _key(F.col("source"), F.col("block"), F.col("epochs"))
    )
    # keys are hashes: the first digits say in which small part of the order the rest ends
    blocks = staged(blocks.withColumn("digits", F.substring("block_key", 1, KEY_DIGITS)), "blocks")
    coarse = blocks.groupBy("source", "digits", "rest").agg(F.sum("tokens").alias("tokens"))
    through = F.sum("tokens").over(Window.partitionBy("source").orderBy("digits"))
    part = coarse.withColumn("through", through).where("through > rest").groupBy("source").agg(
        F.min(F.struct("digits", (F.col("through") - F.col("tokens")).alias("before"))).alias("part")
    ).select("source", "part.*")
    order = Window.partitionBy("source").orderBy("block_key")
    few = blocks.join(part, ["source", "digits"]).withColumn("through", F.col("before") + F.sum("tokens").over(order))
    last = few.where("through > rest").groupBy("source").agg(
        F.min(F.struct("block_key", "block", (F.col("rest") - F.col("through") + F.col("tokens")).alias("left"))).alias("last")
    ).select("source", "last.*").checkpoint()
    docs = _with_sources(own.select("source", "doc_id", "tokens", "block", "epochs"), last.select("source", F.col("block").alias("last_block"), "left"))
    docs = docs.where(F.col("block") == F.col("last_block")).withColumn("doc_key", _key(F.col("doc_id"), F.col("epochs")))
    fits = docs.withColumn("through", F.sum("tokens").over(Window.partitionBy("source").orderBy("doc_key"))).where("through <= left")
    ends = fits.groupBy("source").agg(F.max("doc_key").alias("last_doc_key"))
    ends = last.select("source", F.col("block_key").alias("last_block_key")).join(ends, "source", "left")
    return planned.join(ends, "source", "left").select(
        "source", "tokens", "docs", "weight", "target", "epochs", "blocks",
        F.coalesce("last_block_key", F.lit("")).alias("last_block_key"), F.coalesce("last_doc_key", F.lit("")).alias("last_doc_key"),
    ).checkpoint()


def _with_sources(rows: DataFrame, sources: DataFrame) -> DataFrame:
    """rows joined with a checkpointed table of sources; broadcast if that has few rows."""
    few = sources.limit(FEW_SOURCES + 1).count() <= FEW_SOURCES
    return rows.join(F.broadcast(sources) if few else sources, "source")


def mix(
    docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", source: str = "source",
    repeats: float | None = None, entropy: float | None = None, budget: int | None = None, block_tokens: int = 1 << 20,
) -> DataFrame:
    """docs' columns, once per epoch in which the row is read, and epoch, block, block_key, doc_key, weight, n_tokens.

    Tokens are words. Weights are the sources' token shares to the exponent that meets
    `repeats` or `entropy` (see `exponent`). Reading the rows ordered by (epoch, block_key, doc_key) mixes the sources
    block by block, permuted anew in each epoch; the last epoch of a source ends at its
    token target. Without `budget` every row is read at least once.

    A null source counts as the empty name, a null text as empty. Sources without tokens have weight 0
    and are read once. Rows with the same source and id are read together. Existing
    columns with the new names are replaced. An empty table gives none.
    """
    new = ["epoch", "block", "block_key", "doc_key", "weight", "n_tokens"]
    name = F.coalesce(F.col(source).cast("string"), F.lit(""))
    units = staged(
        docs.select(name.alias("source"), F.col(doc_id).alias("doc_id"), F.size(words_of(F.col(text))).cast("long").alias("tokens"))
        .groupBy("source", "doc_id").agg(F.sum("tokens").alias("tokens")), "units",
    )
    inner = ["source", "weight", "epochs", "blocks", "last_block", "last_doc", "block", "epoch"]
    c = dict(zip(inner, fresh(docs, *[f"_{n}" for n in inner]), strict=True))
    planned = plan(units, repeats=repeats, entropy=entropy, budget=budget, block_tokens=block_tokens).select(
        F.col("source").alias(c["source"]), F.col("weight").alias(c["weight"]), F.col("epochs").alias(c["epochs"]), F.col("blocks").alias(c["blocks"]),
        F.col("last_block_key").alias(c["last_block"]), F.col("last_doc_key").alias(c["last_doc"]),
    )
    unstage(units)
    few = planned.count() <= FEW_SOURCES
    own = docs.drop(*new).withColumn(c["source"], name).join(F.broadcast(planned) if few else planned, c["source"])
    own = own.withColumn(c["block"], _block(F.col(doc_id), F.col(c["blocks"])))
    block_key = _key(F.col(c["source"]), F.col(c["block"]), F.col(c["epochs"]))
    partly = (block_key < F.col(c["last_block"])) | ((block_key == F.col(c["last_block"])) & (_key(F.col(doc_id), F.col(c["epochs"])) <= F.col(c["last_doc"])))
    times = F.col(c["epochs"]) + F.when(partly, 1).otherwise(0)
    read = F.when(times > 0, F.sequence(F.lit(0).cast("long"), times - 1)).otherwise(F.array().cast("array<long>"))
    return own.withColumn(c["epoch"], F.explode(read)).select(
        *[n for n in docs.columns if n not in new], F.col(c["epoch"]).alias("epoch"), F.col(c["block"]).alias("block"),
        _key(F.col(c["source"]), F.col(c["block"]), F.col(c["epoch"])).alias("block_key"), _key(F.col(doc_id), F.col(c["epoch"])).alias("doc_key"),
        F.col(c["weight"]).alias("weight"), F.size(words_of(F.col(text))).cast("long").alias("n_tokens"),
    )

"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Documents fall by hash into blocks of their source, at most MAX_BLOCKS each. A
source's target gives how many block draws it makes: whole passes over its
blocks and a part of one more. The tree recursively splits these exact quotas
among the output shards: a node hands a hypergeometric draw of its blocks to its
left half and the rest to its right; nodes of a level are split by different
tasks, FAN levels at a time. Each source's blocks, permuted anew in every pass,
are then dealt to the shards by quota, so that no draw is used twice, and rows
are shuffled within their shard. No window or task holds more than the blocks of
a source, the sources of a node or the documents of one block or shard.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, column, durable

MAX_BLOCKS = 1 << 18
#: Levels of the tree that one task descends below a node.
FAN = 4


def _keys(docs: DataFrame, seed: int) -> list[Column]:
    """Source key (null apart from every string), size and two hashes of a row."""
    text = F.coalesce(column(docs, "text", "string"), F.lit(""))
    source, h = column(docs, "source", "string"), F.xxhash64(text)
    doc = column(docs, "doc_id", "long")
    return [
        F.coalesce(source, F.lit("")).alias("_s"), source.isNull().alias("_null"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("_size"),
        F.xxhash64(F.lit(seed), doc, h).alias("_place"), F.xxhash64(F.lit(seed + 1), doc, h).alias("_order"),
    ]


def targets(rows: DataFrame, weights: tuple[float, ...], most: float) -> DataFrame:
    """Per source: _s, _null, source_size, target. Sources by code point, null
    last, take the weights in turn; the sum of all sizes is shared by weight
    under a limit of `most` times the source's size (a water level)."""
    by = rows.groupBy("_s", "_null").agg(F.sum("_size").alias("source_size"), F.count("*").alias("rows"))
    rank = F.row_number().over(Window.orderBy("_null", "_s")) - 1
    by = by.withColumn("w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (rank % len(weights) + 1).cast("int")))
    by = by.withColumn("cap", most * F.col("source_size")).withColumn("ratio", F.col("cap") / F.col("w"))
    level = Window.orderBy("ratio", "_null", "_s")
    every = Window.partitionBy()
    before = F.coalesce(F.sum("cap").over(level.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum("w").over(level.rowsBetween(0, Window.unboundedFollowing))
    by = by.withColumn("lam", (F.sum("source_size").over(every) - before) / rest)
    by = by.withColumn("lam", F.max(F.when(F.col("lam") <= F.col("ratio"), F.col("lam"))).over(every))
    return by.withColumn("target", F.least("cap", F.coalesce(F.col("lam") * F.col("w"), F.col("cap")))).select("_s", "_null", "source_size", "rows", "target")


def split_quotas(quotas: np.ndarray, shards: int, seed: int, path: int = 1) -> np.ndarray:
    """(sources x shards) draws: the splitting tree over exact quotas below the
    node `path` (1: the root; 2 * path and 2 * path + 1: its halves). Row sums are
    the quotas; columns differ by one at most."""
    out = np.zeros((len(quotas), shards), np.int64)

    def node(q: np.ndarray, lo: int, hi: int, path: int) -> None:
        if hi - lo == 1 or not q.sum():
            out[:, lo] += q
            return
        mid = (lo + hi) // 2
        rng = np.random.default_rng((seed, path))
        left = rng.multivariate_hypergeometric(q, int(q.sum()) // 2, method="marginals")
        node(left, lo, mid, 2 * path)
        node(q - left, mid, hi, 2 * path + 1)

    node(quotas.astype(np.int64), 0, shards, path)
    return out


def _splitter(levels: int, seed: int):
    """Splits a node's quotas among the nodes so many levels below."""

    def split(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["_null", "_s"])
        node = int(pdf["node"].iloc[0])
        got = split_quotas((pdf["hi"] - pdf["lo"]).to_numpy(), 1 << levels, seed, node)
        s, g = np.nonzero(got)
        hi = (np.cumsum(got, 1) + pdf["lo"].to_numpy()[:, None])[s, g]
        return pd.DataFrame({"_s": pdf["_s"].to_numpy()[s], "_null": pdf["_null"].to_numpy()[s], "node": (node << levels) + g, "lo": hi - got[s, g], "hi": hi})

    return split


def deal(quotas: DataFrame, levels: int, seed: int) -> DataFrame:
    """(_s, _null, shard, lo, hi): the draws lo to hi - 1 of a source go to that
    one of 2**levels shards. quotas: _s, _null, q."""
    nodes = quotas.select("_s", "_null", F.lit(1).cast("long").alias("node"), F.lit(0).cast("long").alias("lo"), F.col("q").alias("hi")).where("q > 0")
    down = 0
    while down < levels:
        step = min(FAN, levels - down)
        nodes = nodes.groupBy("node").applyInPandas(_splitter(step, seed), "_s string, _null boolean, node long, lo long, hi long")
        down += step
    return nodes.select("_s", "_null", (F.col("node") - (1 << levels)).alias("shard"), "lo", "hi")


def plan(docs: DataFrame, weights=(5.0, 2.0, 1.0), most: float = 3.0, seed: int = 11, block_words: int = 1 << 16, shard_words: int | None = None):
    """(rows, sources, draws): rows has _s, _null, _size, _place, _order and
    doc_id of every document; draws has a row for each block and pass: _s,
    _null, _block, epoch, shard, cut (rows whose _order is above it aren't
    drawn; null: none is). All three are durable and small. A shard has about
    `shard_words` words; the default follows the data: a 64th of all, but 2**17
    at least and 2**24 at most. The number of shards has no limit."""
    rows = durable(docs.select(column(docs, "doc_id", "long").alias("doc_id"), *_keys(docs, seed)), "mix-rows")
    sized = durable(targets(rows, weights, most), "mix-targets")
    total = float(sized.agg(F.sum("target")).first()[0] or 0.0)
    block_words = max(block_words, int(total) >> 28)  # so many draws that numpy's generator takes them
    blocks_of = F.least(F.lit(MAX_BLOCKS), F.greatest(F.lit(1), F.ceil(F.col("source_size") / block_words))).cast("int")
    sources = sized.withColumn("n_blocks", blocks_of)
    placed = rows.join(sources, ["_s", "_null"]).withColumn("_block", F.pmod("_place", "n_blocks"))
    blocks = placed.groupBy("_s", "_null", "_block").agg(F.sum("_size").alias("words")).join(sources, ["_s", "_null"])
    passes = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(1)).cast("int")
    draws = blocks.withColumn("passes", passes).withColumn("epoch", F.explode(F.sequence(F.lit(0), F.col("passes"))))
    order = Window.partitionBy("_s", "_null", "epoch").orderBy(F.xxhash64(F.lit(seed), F.col("epoch"), F.col("_block")), "_block")
    draws = draws.withColumn("at", F.row_number().over(order)).withColumn("cum", F.sum("words").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    need = F.when(F.col("epoch") < F.col("passes"), F.lit(float("inf"))).otherwise(F.col("target") - F.col("passes") * F.col("source_size"))
    draws = draws.withColumn("need", need - (F.col("cum") - F.col("words"))).where("need > 0 or (epoch < passes)")
    draws = draws.select("_s", "_null", "_block", "epoch", "at", "need", (F.col("need") < F.col("words")).alias("part"))
    # of a block that is drawn in part: its rows by hash, as long as they fit
    cutting = placed.join(draws.where("part").select("_s", "_null", "_block", "need"), ["_s", "_null", "_block"])
    inside = Window.partitionBy("_s", "_null", "_block").orderBy("_order").rangeBetween(Window.unboundedPreceding, 0)
    cuts = cutting.withColumn("cum", F.sum("_size").over(inside)).groupBy("_s", "_null", "_block").agg(F.max(F.when(F.col("cum") <= F.col("need"), F.col("_order"))).alias("cut"))
    draws = draws.join(cuts, ["_s", "_null", "_block"], "left").withColumn("cut", F.when(F.col("part"), F.coalesce("cut", F.lit(-(1 << 63)))))
    dealt = Window.partitionBy("_s", "_null").orderBy("epoch", "at")
    draws = durable(draws.withColumn("draw", F.row_number().over(dealt) - 1), "mix-draws")
    size = shard_words or min(1 << 24, max(1 << 17, int(total) >> 6))
    levels = max(0, int(np.ceil(np.log2(max(1.0, total / size)))))
    split = deal(draws.groupBy("_s", "_null").agg(F.count("*").alias("q")), levels, seed)
    split = split.select("_s", "_null", "shard", F.explode(F.sequence("lo", F.col("hi") - 1)).alias("draw"))
    draws = durable(draws.join(split, ["_s", "_null", "draw"]).select("_s", "_null", "_block", "epoch", "shard", "cut"), "mix-plan")
    return rows, sources, draws


def _drawn(rows: DataFrame, sources: DataFrame, draws: DataFrame, how: str) -> DataFrame:
    placed = rows.join(sources.select("_s", "_null", "source_size", "target", "n_blocks"), ["_s", "_null"]).withColumn("_block", F.pmod("_place", "n_blocks"))
    return placed.join(draws, ["_s", "_null", "_block"], how)


def mix_counts(docs: DataFrame, **kw) -> DataFrame:
    """One row per row of docs: doc_id, size, source_size, target, taken, shards
    (the output shards that draw it, once for each draw; taken is its size as
    often).

    size: words (null text: 0). Rows equal in doc_id and text are taken alike.
    Sources without words have target 0 and, sizes being 0, taken 0. An empty
    table gives an empty table; other columns are ignored."""
    rows, sources, draws = plan(docs, **kw)
    # a block is drawn four times at most
    per = draws.groupBy("_s", "_null", "_block").agg(F.sort_array(F.collect_list(F.struct("epoch", "shard", "cut"))).alias("drawn"))
    own = F.filter(F.coalesce("drawn", F.array().cast("array<struct<epoch: int, shard: bigint, cut: bigint>>")), lambda d: d["cut"].isNull() | (F.col("_order") <= d["cut"]))
    out = _drawn(rows, sources, per, "left").withColumn("shards", F.transform(own, lambda d: d["shard"]))
    return out.select("doc_id", F.col("_size").alias("size"), "source_size", "target", (F.size("shards") * F.col("_size")).alias("taken"), "shards")


def mix(docs: DataFrame, seed: int = 11, **kw) -> DataFrame:
    """The mix itself: (row, shard, epoch), row being a struct of all columns of
    docs, whatever their names; rows are repeated as drawn, dealt to their shards
    and shuffled there. Nulls and ties as in mix_counts; an empty table gives an
    empty table."""
    _, sources, draws = plan(docs, seed=seed, **kw)
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    out = _drawn(docs.select(row, *_keys(docs, seed)), sources, draws, "inner").where("cut is null or _order <= cut")
    out = out.select("row", "shard", "epoch", F.xxhash64("_order", "epoch").alias("_key"))
    return out.repartition("shard").sortWithinPartitions("shard", "_key").drop("_key")

"""Mixing sources to target weights.

Sizes are tokens of a public tokenizer. A source's budget is its share of the mixture's size; it is
met by whole repetitions of the source and, for the rest, by the documents whose hash lies below a
threshold. The threshold is found without sorting: tokens are summed by source and hash bucket
(``BUCKETS`` a level), the bucket in which the budget is used up is the boundary, and only that
bucket is split again, level by level, until it holds one hash. The mixture is then a filter. Thresholds
are nested: a larger budget keeps every document of a smaller one.

The size of the mixture is the largest at which no source with text falls short of its share with
its repetitions, unless a size is given; sources that then fall short give all their repetitions.

Defined results: null and empty texts have no tokens and are never chosen; a source of the targets
without documents and a source of documents without a target are reported with 0 tokens chosen (the latter
only if asked for) and bound nothing; documents with equal ids share a hash and are kept or left
together; null sources are a source without target; empty tables give a report of zeros.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import pandas as pd
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dugout.session import cut, long_rows, slices, spread

#: Buckets of a level and levels: 3 x 12 bits of the hash.
BITS, LEVELS = 12, 3
BUCKETS = 1 << BITS
#: The tokenizer's files; a parameter, never copied.
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"


#: Fixed value: the public pattern that cuts a text into pieces for this vocabulary.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def _counter(path: str):
    """Counts tokens of whole texts."""
    import base64

    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    enc = tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return lambda texts: [len(x) for x in enc.encode_ordinary_batch(texts, num_threads=1)]


def with_tokens(docs: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """(doc_id, source, tokens) of (doc_id, source, text). The tokenizer's file is sent along where the driver has it; else
    every executor must have it under its path."""
    long_rows(docs.sparkSession)
    here = os.path.exists(tokenizer)
    if here:
        docs.sparkSession.sparkContext.addFile(tokenizer)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        count = _counter(SparkFiles.get(os.path.basename(tokenizer)) if here else tokenizer)
        for pdf in batches:
            texts = [t if isinstance(t, str) else "" for t in pdf["text"]]
            yield pdf[["doc_id", "source"]].assign(tokens=[n for k, end in slices(texts) for n in count(texts[k:end])])

    return spread(docs.select("doc_id", "source", "text")).mapInPandas(run, "doc_id bigint, source string, tokens bigint")


def place(key: str) -> Column:
    """A document's hash in 36 bits."""
    return F.shiftrightunsigned(F.xxhash64(F.col(key), F.lit("mix")), 64 - BITS * LEVELS)


def thresholds(sized: DataFrame, budgets: DataFrame) -> DataFrame:
    """(source, below): documents with a hash under ``below`` use up at most the budget (source, budget)."""
    at = budgets.where("budget > 0").select("source", F.lit(0).cast("long").alias("prefix"), F.col("budget").cast("double").alias("left"))
    h = sized.select("source", "tokens", place("doc_id").alias("h"))
    for level in range(LEVELS):
        up, down = BITS * (LEVELS - level), BITS * (LEVELS - 1 - level)
        # a boundary bucket a source: as many rows as there are targets
        kept = h.withColumn("prefix", F.shiftright("h", up)).join(at.select("source", "prefix"), ["source", "prefix"])
        hist = kept.groupBy("source", "prefix", F.shiftright("h", down).alias("b")).agg(F.sum("tokens").alias("t"))
        w = Window.partitionBy("source").orderBy("b").rowsBetween(Window.unboundedPreceding, Window.currentRow)  # at most BUCKETS rows
        cum = hist.withColumn("upto", F.sum("t").over(w)).join(at, ["source", "prefix"])
        over = cum.where("upto > left").groupBy("source").agg(F.min_by(F.struct("b", (F.col("left") - (F.col("upto") - F.col("t"))).alias("left")), "b").alias("m"))
        at = cut(over.select("source", F.col("m.b").alias("prefix"), F.col("m.left").alias("left")))
    return at.select("source", F.col("prefix").alias("below"))


def plan(sized: DataFrame, targets: DataFrame, size: float | None = None) -> DataFrame:
    """(source, target_share, max_repeats, documents, available, budget, copies, below): how each target source is used."""
    have = sized.where("tokens > 0").groupBy("source").agg(F.sum("tokens").alias("available"), F.count(F.lit(1)).alias("documents"))
    t = cut(targets.where(F.col("source").isNotNull() & (F.col("target_share") > 0)).join(have, "source", "left").select(
        "source", "target_share", F.greatest(F.lit(0), F.coalesce("max_repeats", F.lit(1))).alias("max_repeats"), F.coalesce("documents", F.lit(0)).alias("documents"),
        F.coalesce("available", F.lit(0)).alias("available")))
    if size is None:
        size = t.where("available > 0 and max_repeats > 0").agg(F.min(F.col("available") * F.col("max_repeats") / F.col("target_share"))).first()[0] or 0.0
    b = t.withColumn("budget", F.least(F.floor(F.lit(float(size)) * F.col("target_share") + 1e-6), F.col("available") * F.col("max_repeats")).cast("long"))
    b = b.withColumn("copies", F.when(F.col("available") > 0, F.floor(F.col("budget") / F.col("available"))).otherwise(0).cast("int"))
    b = cut(b.withColumn("rest", F.col("budget") - F.col("copies") * F.col("available")))
    cutoffs = thresholds(sized.where("tokens > 0"), b.select("source", F.col("rest").alias("budget")))
    return b.join(cutoffs, "source", "left").withColumn("below", F.coalesce("below", F.lit(0).cast("long"))).drop("rest")


def mixture(sized: DataFrame, planned: DataFrame) -> DataFrame:
    """(doc_id, source, tokens, times) of the documents chosen; ``times`` counts whole repetitions and the partial one."""
    use = planned.where("copies > 0 or below > 0").select("source", "copies", "below")
    times = F.col("copies") + F.when(place("doc_id") < F.col("below"), 1).otherwise(0)
    return sized.where("tokens > 0").join(use, "source").select("doc_id", "source", "tokens", times.cast("int").alias("times")).where("times > 0")


def report(mix: DataFrame, planned: DataFrame) -> DataFrame:
    """(source, target_share, actual_share, documents, available, budget, chosen_documents, chosen_tokens, most_times)."""
    got = cut(mix.groupBy("source").agg(F.count(F.lit(1)).alias("chosen_documents"), F.sum(F.col("tokens") * F.col("times")).alias("chosen_tokens"),
                                        F.max("times").alias("most_times")))
    total = got.agg(F.sum("chosen_tokens")).first()[0] or 0
    z = lambda c: F.coalesce(c, F.lit(0))
    return planned.join(got, "source", "left").select(
        "source", "target_share", F.round(z("chosen_tokens") / F.lit(float(max(total, 1))), 6).alias("actual_share"), "documents", "available", "budget",
        z("chosen_documents").alias("chosen_documents"), z("chosen_tokens").alias("chosen_tokens"), z("most_times").alias("most_times"), "max_repeats")

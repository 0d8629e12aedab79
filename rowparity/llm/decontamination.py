"""Benchmark decontamination by spaced-seed hashing; DataFrame functions only.

A mask names the token positions whose words are hashed; the positions between
them may differ.  Hashes of the benchmark's and the documents' tokens under
the same masks are joined.  A hit says that a document and an item may agree
along a diagonal (the difference of their positions); every such diagonal is
then verified token by token around the hit.

An item is found in a document if, along a diagonal, some ``WINDOW`` tokens in
a row agree in at least ``MATCHES``.  The two masks leave no such window out:
whichever three of 15 tokens differ, one of the masks fits beside them (the
tests try all).  Items with fewer tokens are found where all of them agree.
An item shorter than both masks is one seed of all its tokens, which the
documents' runs of that length are held against.

Texts may be as long as a row can be.  A document keeps the diagonals that its
seeds hit, and of its tokens only the windows along them.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import row_key, same_row, written

MASKS = ("11010000011", "111011")
WINDOW, MATCHES = 15, 12
#: Seeds of the benchmark that are broadcast (about 100 bytes each); with more, the join shuffles.
BROADCAST_SEEDS = 500_000


def token_hashes(text: str) -> Column:
    """Hashes of the lower-cased runs of letters and digits in a text."""
    words = F.split(F.trim(F.regexp_replace(F.lower(F.coalesce(F.col(text).cast("string"), F.lit(""))), r"[^\p{L}\p{N}]+", " ")), " ")
    return F.transform(F.filter(words, lambda w: w != ""), lambda w: F.xxhash64(w))


#: Items with fewer tokens have a mask of their own, all ones.
LEAST = min(map(len, MASKS))


def seeds(tokens: str, masks: list[str]) -> Column:
    """By mask, the hashes of the masked tokens at each position where the mask fits."""
    found = []
    for mask in masks:
        on = [k for k, c in enumerate(mask) if c == "1"]
        fits = F.sequence(F.lit(0), F.size(tokens) - len(mask))
        places = F.when(F.size(tokens) >= len(mask), fits).otherwise(F.array().cast("array<int>"))
        found.append(F.transform(places, _hash_at(tokens, on, int(mask, 2))))
    return F.array(*found)


def _hash_at(tokens: str, on: list[int], tag: int):
    return lambda i: F.xxhash64(F.lit(tag), *(F.get(F.col(tokens), i + k) for k in on))


def _seed_rows(rows: DataFrame, masks: list[str], *keys: str) -> DataFrame:
    """(*keys, seed, at) of rows with ``tokens``."""
    by_mask = rows.select(*keys, F.explode(seeds("tokens", masks)).alias("seeds"))
    return by_mask.select(*keys, F.posexplode("seeds").alias("at", "seed"))


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, text_key, item_id, n_matched): the items found in each document.

    n_matched is the most tokens that agree in a window (in all of a short
    item).  Null and empty texts hold nothing, and items without a token are
    in nothing; rows with equal ids and texts give one row; empty tables give
    an empty one.
    """
    items = benchmark.select("item_id", token_hashes("text").alias("tokens")).where(F.size("tokens") > 0).distinct()
    items = written(items.withColumn("n", F.size("tokens")), "items")
    lengths = sorted(r["n"] for r in items.where(F.col("n") < LEAST).select("n").distinct().collect())
    found = [_seed_rows(items.where(F.col("n") >= LEAST), list(MASKS), "item_id", "n")]
    found += [_seed_rows(items.where(F.col("n") == n), ["1" * n], "item_id", "n") for n in lengths]
    item_seeds = written(reduce(DataFrame.union, found).withColumnRenamed("at", "item_at").distinct(), "item-seeds")
    texts = docs.select(*row_key(), token_hashes("text").alias("tokens"))
    keyed = _seed_rows(texts, [*MASKS, *("1" * n for n in lengths)], "doc_id", "text_key")
    small = item_seeds.count() <= BROADCAST_SEEDS
    hits = keyed.join(F.broadcast(item_seeds) if small else item_seeds, "seed")
    hits = hits.select("doc_id", "text_key", "item_id", "n", (F.col("at") - F.col("item_at")).alias("diagonal")).distinct()
    found = hits.groupBy("doc_id", "text_key").agg(F.collect_list(F.struct("item_id", "n", "diagonal")).alias("hits"))
    found = written(found, "hits")

    # only texts with a hit are cut into tokens again
    each = docs.select(*row_key(), "text")
    with_hits = each.join(found.hint("merge"), same_row(each, found))
    with_hits = with_hits.select(each["doc_id"], each["text_key"], token_hashes("text").alias("tokens"), "hits")
    first = lambda h: F.greatest(F.lit(0), h["diagonal"])
    window = lambda h: F.slice("tokens", first(h) + 1, h["n"] + h["diagonal"] - first(h))
    pairs = F.transform("hits", lambda h: F.struct(h["item_id"].alias("item_id"), h["diagonal"].alias("diagonal"), window(h).alias("window")))
    pairs = with_hits.select("doc_id", "text_key", F.explode(pairs).alias("hit")).select("doc_id", "text_key", "hit.*")
    pairs = pairs.join(items.withColumnRenamed("tokens", "item_tokens"), "item_id")
    pairs = pairs.withColumn("low", F.greatest(F.lit(0), -F.col("diagonal")))
    same = F.transform("window", lambda t, i: (F.get("item_tokens", i + F.col("low")) == t).cast("int"))
    pairs = pairs.select("doc_id", "text_key", "item_id", "n", same.alias("same"))
    total = lambda a: F.aggregate(a, F.lit(0), lambda s, x: s + x)
    windows = F.transform(F.sequence(F.lit(1), F.size("same") - WINDOW + 1), lambda k: total(F.slice("same", k, WINDOW)))
    best = F.when(F.size("same") >= WINDOW, F.array_max(windows)).when(F.col("n") < WINDOW, total(F.col("same")))
    pairs = pairs.withColumn("best", best)
    enough = F.when(F.col("n") >= WINDOW, F.col("best") >= MATCHES).otherwise(F.col("best") == F.col("n"))
    return pairs.where(enough).groupBy("doc_id", "text_key", "item_id").agg(F.max("best").cast("long").alias("n_matched"))


def without_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the documents in which an item is found."""
    bad = written(leaks(docs, benchmark).select("doc_id", "text_key").distinct(), "leaks").hint("merge")
    same = docs["doc_id"].eqNullSafe(bad["doc_id"]) & (F.xxhash64(docs["text"]) == bad["text_key"])
    return docs.join(bad, same, "left_anti")


def op9_spaced_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document that holds a benchmark item, with the item."""
    found = leaks(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select("doc_id", "item_id", "n_matched")


ORACLE_OP9 = rf"""
with d as (
  select doc_id, list_filter(string_split_regex(lower(text), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '') tokens from documents
), b as (
  select item_id, list_filter(string_split_regex(lower(text), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '') tokens from benchmark
), dt as (
  select doc_id, len(tokens) n_doc, unnest(tokens) token, generate_subscripts(tokens, 1) - 1 pos from d
), bt as (
  select item_id, len(tokens) n, unnest(tokens) token, generate_subscripts(tokens, 1) - 1 pos from b
), same as (
  select doc_id, item_id, dt.pos - bt.pos diagonal, bt.pos, n, least(n, n_doc - (dt.pos - bt.pos)) - greatest(0, -(dt.pos - bt.pos)) fits
  from dt join bt using (token)
), counted as (
  select *, count(*) over (partition by doc_id, item_id, diagonal order by pos range between current row and {WINDOW - 1} following) hits from same
)
select doc_id, item_id, max(hits) n_matched from counted
where (n >= {WINDOW} and fits >= {WINDOW} and hits >= {MATCHES}) or (n < {WINDOW} and hits = n)
group by doc_id, item_id
"""

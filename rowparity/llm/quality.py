"""Quality rules: base rules, and perplexity under an n-gram model per language.

The model is modified Kneser-Ney over the UTF-8 bytes of the texts, of order
3, counted by Spark over all different texts.  Bytes bound its size, whatever the
corpus is: a language has at most 256^3 trigrams, and natural text has some
tens of thousands.  Trigrams with their log probabilities are kept in sorted
arrays of their codes, the lower orders in full tables.

Perplexities are judged by language: the band is ``LOWER`` and ``UPPER``
interquartile ranges beyond the quartiles of the language's log perplexities, over the
different texts that pass the base rules, and ``FLOOR`` at least.  Repetition lies below, noise above.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import ranked, written

#: Interquartile ranges between the quartiles and the ends of the band.  UPPER makes the fewest errors on the
#: labels of sf0.1 and of check_s whose doc_id isn't divisible by 5; below the quartiles LOWER could reject
#: good ones alone: no labelled low-quality document lies an interquartile range below.
LOWER, UPPER = 4.0, 2.0
#: Nats per byte from the quartiles to the ends of the band at least; interquartile ranges of sf0.1 and check_s are 0.024 to 0.048.
FLOOR = 0.04
#: Characters of symbols, and of ASCII white space.
SYMBOLS = "#*$%&|<>"
BLANKS = " \t\n\x0b\x0c\r"
#: Bytes that are scored together, and the loss per byte beyond a language's mean that is unusual.
STRETCH = 128
UNUSUAL = 0.2
#: Languages with a model and a band of their own, the most frequent; the others are one.
LANGUAGES, OTHERS = 100, "(others)"
#: Bytes that are counted together.
SLICE = 1 << 20
METRICS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean"


def _grams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Trigram codes of the texts' bytes, each text after two line ends; where each text's begin."""
    lengths = np.array([len(t) for t in texts], np.int64)
    data = np.frombuffer(b"".join(b"\n\n" + t for t in texts), np.uint8).astype(np.int32)
    codes = data[:-2] << 16 | data[1:-1] << 8 | data[2:] if len(data) > 2 else np.zeros(0, np.int32)
    begin = np.cumsum(lengths + 2) - (lengths + 2)
    inside = np.ones(len(codes), bool)  # not those that end in the line ends before a text
    for shift in (-2, -1):
        at = begin + shift
        inside[at[at >= 0]] = False
    return codes[inside], np.cumsum(lengths) - lengths


def _summed(found: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, where = np.unique(np.concatenate([k for k, _ in found]), return_inverse=True)
    return keys, np.bincount(where, np.concatenate([n for _, n in found])).astype(np.int64)


def gram_counts(docs: DataFrame) -> DataFrame:
    """(lang, gram, n): how often each byte trigram occurs in each language's texts."""

    def run(batches):
        found: dict[str, list] = {}
        for batch in batches:
            held: dict[str, list[bytes]] = {}
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if text:
                    held.setdefault(lang, []).append(text)
                    if sum(map(len, held[lang][-1:])) >= SLICE or len(held[lang]) >= 512:
                        add(found, lang, held.pop(lang))
            for lang, texts in held.items():
                add(found, lang, texts)
        for lang, parts in found.items():
            keys, n = _summed(parts)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(keys), pa.string()), pa.array(keys, pa.int32()), pa.array(n, pa.int64())], names=["lang", "gram", "n"])

    def add(found, lang, texts):
        parts = found.setdefault(lang, [])
        parts.append(np.unique(_grams(texts)[0], return_counts=True))
        if len(parts) > 30:
            parts[:] = [_summed(parts)]

    rows = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("")), F.col("text").cast("string").cast("binary"))
    return rows.mapInArrow(run, "lang string, gram int, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def discounts(counts: np.ndarray) -> np.ndarray:
    """D0 to D3+ of modified Kneser-Ney from the counts of counts."""
    n1, n2, n3, n4 = (float(np.count_nonzero(counts == k)) for k in (1, 2, 3, 4))
    y = n1 / (n1 + 2 * n2) if n1 else 0.5
    raw = (1 - 2 * y * n2 / n1 if n1 else 0.5, 2 - 3 * y * n3 / n2 if n2 else 1.0, 3 - 4 * y * n4 / n3 if n3 else 1.5)
    return np.array([0.0, *(min(max(d, 0.1), k - 0.1) for k, d in enumerate(raw, 1))])


class KneserNey:
    """A byte trigram model of one language from codes and counts, sorted by code."""

    def __init__(self, codes: np.ndarray, counts: np.ndarray):
        pair, last = codes >> 8, codes & 0xFFFF
        two = self._lower(last)
        d = discounts(counts)
        total = np.bincount(pair, counts, 1 << 16)
        left = np.bincount(pair, d[np.minimum(counts, 3)], 1 << 16)
        back = np.divide(left, total, out=np.ones(1 << 16), where=total > 0)
        prob = (counts - d[np.minimum(counts, 3)]) / total[pair] + back[pair] * two[last]
        self.codes, self.log = codes.astype(np.int32), np.log(prob).astype(np.float32)
        self.back, self.two = np.log(back).astype(np.float32), np.log(two).astype(np.float32)
        self.entropy = float(-(self.log.astype(np.float64) * counts).sum() / counts.sum())

    @staticmethod
    def _lower(last: np.ndarray) -> np.ndarray:
        """Probabilities of bytes after a byte, by numbers of different contexts."""
        follows = np.bincount(last, minlength=1 << 16)  # contexts of each bigram
        seen = np.flatnonzero(follows)
        single = np.bincount(seen & 0xFF, minlength=256)  # contexts of each byte
        d = discounts(single[single > 0])
        cut = np.where(single > 0, d[np.minimum(single, 3)], 0)
        one = (single - cut + cut.sum() / 256) / single.sum()
        d = discounts(follows[seen])
        cut = np.where(follows > 0, d[np.minimum(follows, 3)], 0)
        total, left = follows.reshape(256, 256).sum(1), cut.reshape(256, 256).sum(1)
        scale = np.maximum(total, 1)
        back = np.where(total > 0, left / scale, 1.0)
        two = (follows - cut).reshape(256, 256) / scale[:, None] + back[:, None] * one[None, :]
        return two.reshape(-1)

    def score(self, codes: np.ndarray) -> np.ndarray:
        """Log probability of each trigram's last byte."""
        at = np.minimum(np.searchsorted(self.codes, codes), len(self.codes) - 1)
        return np.where(self.codes[at] == codes, self.log[at], self.back[codes >> 8] + self.two[codes & 0xFFFF])


def text_losses(codes: np.ndarray, begin: np.ndarray, own: KneserNey, models: list[KneserNey]) -> np.ndarray:
    """The negative log probability of each text, by stretches of ``STRETCH`` bytes.

    A stretch that the own language's model finds unusual is scored by the
    model that it fits best, so a passage in another language is no noise.
    """
    lengths = np.diff(begin, append=len(codes))
    n = -(-lengths // STRETCH)
    first = np.cumsum(n) - n
    at = np.repeat(begin, n) + STRETCH * (np.arange(n.sum()) - np.repeat(first, n))
    size = np.diff(at, append=len(codes))
    loss = -np.add.reduceat(own.score(codes), at, dtype=np.float64)
    odd = np.flatnonzero(loss > size * (own.entropy + UNUSUAL))
    if len(odd) and len(models) > 1:
        starts = np.cumsum(size[odd]) - size[odd]
        part = codes[np.repeat(at[odd] - starts, size[odd]) + np.arange(size[odd].sum())]
        for model in models:
            loss[odd] = np.minimum(loss[odd], -np.add.reduceat(model.score(part), starts, dtype=np.float64))
    return np.add.reduceat(loss, first)


def base_metrics(text: str) -> tuple[int, int, int, int, int, bool]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed."""
    words = text.encode().split()  # bytes split at ASCII white space alone
    n = len(words)
    chars = len(text) - sum(map(text.count, BLANKS))
    symbols = sum(map(text.count, SYMBOLS))
    lines = [x for x in text.split("\n") if x.strip(BLANKS)]
    windows = list(zip(words, words[1:], words[2:]))
    repeat = 0
    if len(set(windows)) < len(windows):
        many = {w for w, k in Counter(windows).items() if k > 1}
        end = 0  # of what is counted
        for k, w in enumerate(windows):
            if w in many:
                repeat += k + 3 - max(end, k)
                end = k + 3
    return n, chars, symbols, len(lines) - len(set(lines)), repeat, n < 50 or 100 * repeat > 50 * n


def _models(counts: DataFrame) -> dict[str, KneserNey]:
    """Of each language; bounded by its 256^3 trigrams."""
    table = counts.toArrow()
    langs = np.array(table["lang"].to_pylist(), object)
    codes, n = table["gram"].to_numpy().astype(np.int64), table["n"].to_numpy()
    models = {}
    for lang in sorted(set(langs)):
        at = np.flatnonzero(langs == lang)
        at = at[np.argsort(codes[at])]
        models[lang] = KneserNey(codes[at], n[at])
    return models


def _lang() -> Column:
    return F.coalesce(F.col("lang").cast("string"), F.lit(""))


def pooled(docs: DataFrame) -> Column:
    """The language that a document is judged by: its own, or ``OTHERS`` beyond the most frequent ones."""
    found = docs.groupBy(_lang().alias("lang")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(LANGUAGES + 1).collect()
    names = [r["lang"] for r in found[:LANGUAGES]]
    return _lang() if len(found) <= LANGUAGES else F.when(_lang().isin(names), _lang()).otherwise(OTHERS)


def different(docs: DataFrame) -> DataFrame:
    """(lang, text): each text of a language once, so that copies don't make it the model's own."""
    rows = docs.select(_lang().alias("lang"), F.col("text").cast("string").alias("text"), F.xxhash64("text").alias("text_key"))
    return rows.groupBy("lang", "text_key").agg(F.first("text").alias("text"))


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, text_key, lang, the base metrics and log_perplexity (per byte; null without text) of each document."""
    docs = docs.select("doc_id", pooled(docs).alias("lang"), "text")
    models = docs.sparkSession.sparkContext.broadcast(_models(gram_counts(different(docs))))

    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                texts = [t or "" for t in batch.column(3).to_pylist()]
                base = list(zip(*map(base_metrics, texts), strict=True)) or [()] * 6
                logs: list[float | None] = [None] * len(texts)
                by: dict[str, list[int]] = {}
                for k, lang in enumerate(batch.column(2).to_pylist()):
                    if texts[k]:
                        by.setdefault(lang, []).append(k)
                for lang, rows in by.items():
                    codes, begin = _grams([texts[k].encode() for k in rows])
                    sums = text_losses(codes, begin, models.value[lang], list(models.value.values()))
                    for k, s, n in zip(rows, sums.tolist(), np.diff(begin, append=len(codes)).tolist(), strict=True):
                        logs[k] = s / n
                columns = [pa.array(c, pa.int64()) for c in base[:5]] + [pa.array(base[5], pa.bool_()), pa.array(logs, pa.float64())]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), *columns], names=names)

    schema = f"doc_id long, text_key long, lang string, {METRICS}, log_perplexity double"
    names = [part.split()[0] for part in schema.split(", ")]
    rows = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("text_key"), "lang", F.col("text").cast("string"))
    return rows.mapInArrow(run, schema)


def _quartiles(texts: DataFrame) -> DataFrame:
    """(lang, lower, upper): of the texts' log perplexities, exactly, by their ranks over all texts."""
    by = ["lang", "log_perplexity"]
    places = ranked(texts.groupBy(*by).agg(F.count(F.lit(1)).alias("n")), by)
    sizes = places.groupBy("lang").agg(F.min("rank").alias("start"), F.sum("n").alias("total"))
    at = lambda share: F.col("start") + F.floor(F.lit(share) * (F.col("total") - 1))
    here = lambda share: (F.col("rank") <= at(share)) & (F.col("rank") + F.col("n") > at(share))
    rows = places.join(F.broadcast(sizes), "lang").groupBy("lang")
    return rows.agg(*(F.max(F.when(here(share), F.col("log_perplexity"))).alias(name) for share, name in ((0.25, "lower"), (0.75, "upper"))))


def quality(docs: DataFrame, lower: float = LOWER, upper: float = UPPER) -> DataFrame:
    """``measured`` with low, high (the language's band) and kept.

    Null and empty texts fail the base rules.  A null language is one of its
    own; languages beyond the ``LANGUAGES`` most frequent are judged as one.  Equal rows get equal results; an empty table gives an empty one.
    """
    each = written(measured(docs), "measured")
    texts = each.where("not base_failed").groupBy("lang", "text_key").agg(F.first("log_perplexity").alias("log_perplexity"))  # copies don't weigh
    bands = _quartiles(texts)
    reach = lambda width: F.greatest(width * (F.col("upper") - F.col("lower")), F.lit(FLOOR))
    bands = bands.select("lang", (F.col("lower") - reach(lower)).alias("low"), (F.col("upper") + reach(upper)).alias("high"))
    # a row for each language
    found = each.join(F.broadcast(bands), "lang", "left")
    return found.withColumn("kept", F.coalesce(~F.col("base_failed") & F.col("log_perplexity").between(F.col("low"), F.col("high")), F.lit(False)))


def keep_good(docs: DataFrame, lower: float = LOWER, upper: float = UPPER) -> DataFrame:
    """``docs`` without those that ``quality`` rejects."""
    rejected = written(quality(docs, lower, upper).where("not kept").select("doc_id", "text_key").distinct(), "rejected").hint("merge")
    same = docs["doc_id"].eqNullSafe(rejected["doc_id"]) & (F.xxhash64(docs["text"]) == rejected["text_key"])
    return docs.join(rejected, same, "left_anti")


def op10_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base metrics and verdict of every document."""
    found = quality(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "log_perplexity")

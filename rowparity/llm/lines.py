r"""Repeated runs of lines: a suffix array over line ids by distributed prefix doubling; DataFrame functions only.

A document is the sequence of its lines' ids (two 64-bit hashes; blank lines
don't count).  A suffix begins at each line.  Level k sorts the suffixes by
their first 2^k lines: a suffix's rank there is the number of suffixes before
its group.  Level k + 1 sorts the pairs (rank of the first half, rank of the
second half), which each suffix gets by a join with the suffix 2^k lines on.
A group is an interval of the suffix array whose longest common prefix is
2^k lines or more.  Suffixes alone in their group have no copy and leave, so
the rounds end when no run of 2^k lines occurs twice.

Groups are counted before they are sorted or joined back, map-side first, so a
line that a third of all rows share is one row of each task.  Nothing is held
for a document but its text and the places of its repeated lines.

A line is deleted if it lies in a run of ``min_lines`` lines or more that also
begins earlier in the corpus, ordered by document id and line.  With 1, the
default, that is any repeated run.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import dropped, ranked, written

MIN_LINES = 1
WORD = r"[^\x20\x09-\x0D]+"
#: Stands for a null id, before all others.
NO_ID = -(1 << 63)
PLACE = ["id", "text_key", "at"]


def _key() -> list[Column]:
    """A document: its id and a hash of its text."""
    return [F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("id"), F.xxhash64("text").alias("text_key")]


def _split() -> Column:
    return F.split(F.coalesce(F.col("text").cast("string"), F.lit("")), "\n")


def _order() -> Column:
    """Where a suffix begins in the corpus; documents have fewer than 2^31 lines."""
    return (F.col("id").cast("decimal(20,0)") * F.lit(1 << 31).cast("decimal(11,0)") + F.col("at").cast("decimal(10,0)")).cast("decimal(38,0)")


def suffixes(docs: DataFrame) -> DataFrame:
    """(id, text_key, at, one, two): the line id at each suffix; lines are numbered without blank ones."""
    worded = F.filter(_split(), lambda x: x.rlike(WORD))
    ids = F.transform(worded, lambda x: F.struct(F.xxhash64(x).alias("one"), F.xxhash64(F.lit("2"), x).alias("two")))
    rows = docs.select(*_key(), F.posexplode(ids).alias("at", "line"))
    return rows.select(*PLACE, "line.one", "line.two")


def _level(rows: DataFrame, by: list[str], name: str) -> DataFrame:
    """(id, text_key, at, rank, later) of the suffixes (*PLACE, *by) whose group has others."""
    groups = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.min(_order()).alias("first")).where("n > 1")
    ranks = ranked(groups, by).drop("n")
    # always by shuffle: the groups grow with the corpus; adaptive execution splits a group that many rows share
    found = rows.join(ranks.hint("merge"), by).select(*PLACE, "rank", (_order() > F.col("first")).alias("later"))
    found = written(found, name)
    dropped(ranks)
    return found


def _shifted(level: DataFrame, lines: int) -> DataFrame:
    """(id, text_key, at, second): the rank of the suffix that begins ``lines`` on."""
    return level.select("id", "text_key", (F.col("at") - lines).alias("at"), F.col("rank").alias("second"))


def repeated_runs(docs: DataFrame, min_lines: int = MIN_LINES) -> DataFrame:
    """(id, text_key, starts, longest) of the documents with a run that also begins earlier.

    ``starts`` are the lines where a run of ``min_lines`` lines does;
    ``longest`` is the greatest 2^k for which one of 2^k lines does.
    """
    rows = written(suffixes(docs), "suffixes")
    level = _level(rows, ["one", "two"], "level-0")
    once = written(level.distinct(), "level-0")  # equal rows of documents are one place
    for table in (rows, level):
        dropped(table)
    level, lines, windows, deepest = once, 1, None, []
    while not level.isEmpty():
        later = level.where("later")
        if lines <= min_lines < 2 * lines:
            wide = later if lines == min_lines else _window(level, min_lines - lines).where("later")
            windows = written(wide.select(*PLACE), "windows")
        deepest.append(written(later.select("id", "text_key").distinct().withColumn("longest", F.lit(lines)), "deepest"))
        pairs = written(level.withColumnRenamed("rank", "first_half").drop("later").join(_shifted(level, lines), PLACE), "pairs")
        below = _level(pairs, ["first_half", "second"], f"level-{len(deepest)}")
        for table in (pairs, level):
            dropped(table)
        level, lines = below, 2 * lines
    found = level.select("id", "text_key").withColumn("longest", F.lit(0)).where("false")
    for table in deepest:
        found = found.union(table)
    found = found.groupBy("id", "text_key").agg(F.max("longest").alias("longest"))
    if windows is None:
        return found.withColumn("starts", F.array().cast("array<int>"))
    starts = windows.groupBy("id", "text_key").agg(F.collect_list("at").alias("starts"))
    found = written(found.join(starts, ["id", "text_key"], "left"), "repeated")
    for table in (windows, *deepest):
        dropped(table)
    return found


def _window(level: DataFrame, on: int) -> DataFrame:
    """(*PLACE, later) of runs between two levels: a run is named by the ranks of its first and its last 2^k lines."""
    pairs = level.withColumnRenamed("rank", "first_half").drop("later").join(_shifted(level, on), PLACE)
    return _level(written(pairs, "pairs"), ["first_half", "second"], "window")


def deduplicated(docs: DataFrame, min_lines: int = MIN_LINES) -> DataFrame:
    """The columns of ``docs``, with the results in a struct ``line_dedup``.

    ``line_dedup`` has n_lines, n_removed, longest_run (see ``repeated_runs``;
    0 without one) and text: the text without later copies, the text as it was
    where nothing goes.  Blank lines stay.  A null text has no lines; an empty
    one has one blank line.  Texts may have up to 2^31 lines; one text is one
    row.  Rows with one doc_id and one text are one place in the corpus and are
    no copies of each other; a null id comes before all others, and of two
    texts with one id neither is earlier at equal lines.  An empty table gives
    an empty one.  A column of ``docs`` with the name line_dedup is replaced.
    """
    names = [c for c in docs.columns if c != "line_dedup"]
    found = repeated_runs(docs, min_lines)
    rows = docs.select(F.struct(*(docs[f"`{c}`"] for c in names)).alias("doc"), *_key())
    # always by shuffle: what is removed grows with the corpus
    rows = rows.join(found.hint("merge"), ["id", "text_key"], "left")
    gone = F.flatten(F.transform("starts", lambda s: F.sequence(s, s + min_lines - 1)))
    rows = rows.withColumn("text", F.col("doc").getField("text").cast("string")).withColumn("lines", _split()).withColumn("gone", F.when(F.size("starts") > 0, F.array_distinct(gone)))
    numbers = F.filter(F.transform("lines", lambda x, i: F.when(x.rlike(WORD), i)), lambda i: i.isNotNull())
    rows = rows.withColumn("numbers", F.when(F.col("gone").isNotNull(), numbers))
    kept = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.transform("gone", lambda k: F.get("numbers", k)))
    rows = rows.withColumn("kept", F.when(F.col("gone").isNotNull(), kept))
    changed = F.col("kept").isNotNull()
    text = F.array_join(F.transform("kept", lambda i: F.get(F.col("lines"), i)), "\n")
    n = F.when(F.col("text").isNull(), 0).otherwise(F.size("lines"))
    result = F.struct(
        n.cast("long").alias("n_lines"),
        F.when(changed, n - F.size("kept")).otherwise(0).cast("long").alias("n_removed"),
        F.coalesce("longest", F.lit(0)).cast("long").alias("longest_run"),
        F.when(changed, text).otherwise(F.col("text")).alias("text"),
    )
    rows = rows.select("doc", result.alias("result"))
    return rows.select(*(F.col("doc").getField(c).alias(c) for c in names), F.col("result").alias("line_dedup"))


def without_repeats(docs: DataFrame, min_lines: int = MIN_LINES) -> DataFrame:
    """``docs`` with the shortened texts and their n_chars; documents of which no word is left go."""
    found = deduplicated(docs, min_lines)
    result = F.col("line_dedup")
    found = found.where((result["n_removed"] == 0) | result["text"].rlike(WORD))
    changed = result["n_removed"] > 0
    columns = []
    for field in docs.schema.fields:
        value = F.col(f"`{field.name}`")
        if field.name == "text":
            value = F.when(changed, result["text"]).otherwise(value).alias("text")
        elif field.name == "n_chars":
            value = F.when(changed, F.length(result["text"]).cast(field.dataType)).otherwise(value).alias("n_chars")
        columns.append(value)
    return found.select(*columns)


def op6_line_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines removed from every document, its longest repeated run, and a digest of what is left."""
    found = deduplicated(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    result = F.col("line_dedup")
    digest = F.md5(result["text"].cast("binary")).alias("kept_md5")
    return found.select("doc_id", *(result[c].alias(c) for c in ("n_lines", "n_removed", "longest_run")), digest)


ORACLE_OP6 = r"""
with l as (
  select doc_id, unnest(string_split(text, chr(10))) line, generate_subscripts(string_split(text, chr(10)), 1) - 1 nr from documents
), p as (
  select *, row_number() over (partition by doc_id order by nr) pos from l where regexp_matches(line, '[^\x20\x09-\x0D]')
), pairs as (
  select a.doc_id, a.nr, a.pos, b.doc_id other, a.pos - b.pos diagonal
  from p a join p b on a.line = b.line and (b.doc_id < a.doc_id or b.doc_id = a.doc_id and b.pos < a.pos)
), islands as (
  select *, pos - row_number() over (partition by doc_id, other, diagonal order by pos) island from pairs
), runs as (
  select doc_id, count(*) n from islands group by doc_id, other, diagonal, island
), longest as (
  select doc_id, cast(2 ** floor(log2(max(n))) as bigint) longest_run from runs group by doc_id
), gone as (
  select distinct doc_id, nr from pairs
)
select l.doc_id, count(*) n_lines, count(gone.nr) n_removed, coalesce(any_value(longest_run), 0) longest_run,
  md5(coalesce(string_agg(l.line, chr(10) order by l.nr) filter (where gone.nr is null), '')) kept_md5
from l left join gone on gone.doc_id = l.doc_id and gone.nr = l.nr left join longest on longest.doc_id = l.doc_id group by l.doc_id
"""

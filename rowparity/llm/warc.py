"""WARC archives, written by Spark's text writer and read by boundary chains.

A record ends with two line ends, which the text writer puts between rows as
its separator; so archives are written inside the JVM to any store that Spark
can write to.  Files are gzipped as a whole; offsets count unpacked bytes.

Reading doesn't trust the magic string, which a payload may hold as well.
Tasks cut the files at every place of it: gzipped ones as streams, plain ones
by byte ranges.  Each piece is a candidate whose own header says where its
successor begins.  Pieces that follow one another so are runs, which begin
anew wherever a candidate elsewhere points.  Pointer jumping from the starts
of the files, by joins, finds the runs that the chains reach, in as many steps
as the logarithm of their number.  The other pieces lie in payloads.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import dropped, new_path, written

MAGIC = "WARC/1.1\r\n"
END = "\r\n\r\n"
#: Begins the id of a record without page_id.
UNNAMED = "urn:payload:"
#: Bytes of payload from which on equal payloads are stored once.
REVISIT_FROM = 1000
#: Stands for a null page_id.
NO_PAGE = -(1 << 63)
#: Bytes of payload for each archive, on average.
ARCHIVE_BYTES = 8 << 20


def record_types(pages: DataFrame, archives: int = 1, revisit_from: int = REVISIT_FROM) -> DataFrame:
    """``pages`` (page_id, url, payload) with payload_bytes, payload_digest, record_type and refers_to.

    Of the records with one payload of at least ``revisit_from`` bytes, that
    with the largest page_id is the response and the others revisit it.  Rows
    that tie for it (repeated rows) are all responses; a null page_id is less
    than any other.

    Ids and digests alone decide it; payloads are dealt out once, by page, to
    the tasks that write ``archives`` files, so a payload that a third of all
    pages share is in all of them.
    """
    sized = pages.select(
        F.col("page_id").cast("long"),
        F.coalesce(F.col("page_id").cast("long"), F.lit(NO_PAGE)).alias("page"),
        F.col("url").cast("string"),
        F.coalesce(F.col("payload"), F.lit(b"")).alias("payload"),
    )
    sized = sized.select("*", F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha1("payload").alias("payload_digest"))
    large = written(sized.where(F.col("payload_bytes") >= revisit_from).select("page", "payload_digest"), "large")
    first = large.groupBy("payload_digest").agg(F.count(F.lit(1)).alias("n"), F.max("page").alias("first_id")).where("n > 1").drop("n")
    later = large.join(first.hint("merge"), "payload_digest").where("page <> first_id").distinct()
    later = written(later, "revisits")
    dropped(large)
    dealt = sized.repartition(archives, "page", "payload_digest")
    joined = dealt.join(later.hint("shuffle_hash"), ["page", "payload_digest"], "left")
    revisit = F.col("first_id").isNotNull()
    return joined.select(
        "page_id", "url", "payload", "payload_bytes", "payload_digest",
        F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        F.when(F.col("first_id") != NO_PAGE, F.col("first_id")).alias("refers_to"),
    )


def _records(rows: DataFrame) -> DataFrame:
    """The WARC record of each row, as one column; the trailing line ends are the writer's."""
    line = lambda name, value: F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit("\r\n")), F.lit(""))
    uri = lambda c: F.concat(F.lit("urn:page:"), c.cast("string"))
    # a header is one line
    target = F.regexp_replace(F.trim("url"), r"[\x00-\x1f\x7f]", " ")
    response = F.col("record_type") == "response"
    stored = F.when(response, F.col("payload")).otherwise(F.lit(b""))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("payload_bytes").cast("string"), F.lit(END))
    head = F.concat(
        F.lit(MAGIC),
        F.lit("WARC-Type: "), "record_type", F.lit("\r\n"),
        line("WARC-Record-ID", F.concat(F.lit("<"), F.coalesce(uri(F.col("page_id")), F.concat(F.lit(UNNAMED), "payload_digest")), F.lit(">"))),
        line("WARC-Target-URI", target),
        F.lit("WARC-Date: 1970-01-01T00:00:00Z\r\n"),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "payload_digest")),
        line("WARC-Refers-To", F.concat(F.lit("<"), uri(F.col("refers_to")), F.lit(">"))),
        F.when(response, "").otherwise("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\n"),
        line("X-Full-Payload-Length", F.col("payload_bytes").cast("string")),
        F.lit("Content-Type: application/http; msgtype=response\r\nContent-Length: "),
        (F.octet_length(http) + F.octet_length(stored)).cast("string"),
        F.lit(END),
    )
    # casting binary to string keeps the bytes
    return rows.select(F.concat(head, http, stored.cast("string")).alias("value"))


def write_archives(rows: DataFrame, path: str) -> None:
    """Writes rows of ``record_types`` as WARC files below ``path``."""
    _records(rows).write.option("lineSep", END).option("compression", "gzip").text(path)


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    """(file, block, id, piece): what lies between magic strings, in the order of ``id`` in each block of a file."""
    found = spark.read.option("lineSep", MAGIC).option("pathGlobFilter", "part-*").text(path)
    return found.select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("id"),
        F.col("value").cast("binary").alias("piece"),
    )


def _parsed() -> dict[str, Column]:
    """What ``piece`` says as a record, without its magic string; ``reach`` is where it ends, ``whole`` if it does so there."""
    size, ends = F.octet_length("piece"), F.octet_length(F.lit(END))
    head = F.substring_index(F.col("piece").cast("string"), END, 1)
    field = lambda name, value: F.regexp_extract(head, rf"(?imd)^{name}:[ \t]*{value}[ \t]*\r?$", 1)
    page = lambda name: field(name, r"<urn:page:(-?\d{1,19})>").try_cast("long")
    block = F.octet_length(head) + ends
    reach = F.when(block <= size, block + field("Content-Length", r"(\d{1,18})").try_cast("long") + ends)
    inner = F.substring_index(F.substring(F.col("piece"), block + 1, size).cast("string"), END, 1)
    start = block + F.octet_length(inner) + ends
    payload = F.substring(F.col("piece"), start + 1, F.greatest(size - ends - start, F.lit(0)))
    response = field("WARC-Type", r"(\w+)") == "response"
    return {
        "size": size.cast("long"),
        "reach": reach,
        "whole": F.coalesce((reach == size) & (F.substring(F.col("piece"), size - ends + 1, ends) == F.lit(END.encode())), F.lit(False)),
        "page_id": page("WARC-Record-ID"),
        "record_type": field("WARC-Type", r"(\w+)"),
        "refers_to": page("WARC-Refers-To"),
        "payload_bytes": F.when(response, F.octet_length(payload).cast("long")).otherwise(field("X-Full-Payload-Length", r"(\d{1,18})").try_cast("long")),
        "payload_digest": field("WARC-Payload-Digest", r"sha1:([0-9a-f]{40})"),
        "read_digest": F.when(response, F.sha1(payload)),
        "payload": F.when(response, payload),
    }


def _placed(pieces: DataFrame) -> DataFrame:
    """The pieces' ``_parsed`` columns with ``at``, the place of the magic string before each, and ``follower``.

    The piece before a file's first magic string is empty; it has ``at`` -10
    and the follower 0, so the chain begins there.
    """
    parsed = _parsed()
    del parsed["payload"]
    nodes = written(pieces.select("file", "block", "id", *(c.alias(n) for n, c in parsed.items())), "nodes")
    before = lambda c, w: F.coalesce(F.sum(c).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    taken = F.col("size") + len(MAGIC)
    blocks = nodes.groupBy("file", "block").agg(F.sum(taken).alias("taken"))
    starts = blocks.select("file", "block", before("taken", Window.partitionBy("file").orderBy("block")).alias("begins"))
    begin = F.col("begins") + before(taken, Window.partitionBy("file", "block").orderBy("id"))
    rows = nodes.join(starts, ["file", "block"]).withColumn("begin", begin)
    follower = F.when(F.col("begin") == 0, 0).otherwise(F.col("begin") + F.col("reach"))
    return written(rows.withColumn("at", F.col("begin") - len(MAGIC)).withColumn("follower", follower).drop("begins", "begin"), "placed")


def _runs(placed: DataFrame) -> DataFrame:
    """``placed`` with ``run``, the ``at`` of the run's first piece."""
    here = Window.partitionBy("file", "block").orderBy("id")
    rows = placed.withColumn("before", F.lag("follower").over(here)).withColumn("next", F.lead("at").over(here))
    aims = rows.where("follower is not null and not (follower <=> next)").select("file", F.col("follower").alias("at")).distinct()
    rows = rows.join(aims.withColumn("aimed", F.lit(True)), ["file", "at"], "left")
    first = ~F.col("before").eqNullSafe(F.col("at")) | F.col("aimed").isNotNull()
    run = F.last(F.when(first, F.col("at")), ignorenulls=True).over(here)
    return written(rows.withColumn("run", run).drop("before", "next", "aimed"), "runs")


def reachable(steps: DataFrame) -> DataFrame:
    """The rows (file, run) of ``steps`` (file, run, jump) that the chains from the run at -10 reach.

    Pointer jumping: what is marked marks what lies a jump ahead, and jumps
    are doubled, until no more is marked.
    """
    start = F.col("run") == -len(MAGIC)
    state, marked = written(steps.select("file", "run", "jump", start.alias("mark")), "steps"), -1
    while (n := state.where("mark").count()) > marked:
        marked = n
        hit = state.where("mark and jump is not null").select("file", F.col("jump").alias("run")).distinct().withColumn("hit", F.lit(True))
        far = state.where("jump is not null").select("file", F.col("run").alias("jump"), F.col("jump").alias("farther"))
        marks = F.col("mark") | F.col("hit").isNotNull()
        found = state.join(hit, ["file", "run"], "left").join(far, ["file", "jump"], "left")
        later = written(found.select("file", "run", F.col("farther").alias("jump"), marks.alias("mark")), "steps")
        dropped(state)
        state = later
    return state.where("mark").select("file", "run")


def _several(rows: DataFrame, pieces: DataFrame) -> DataFrame:
    """(file, at, piece) of the reached records that are cut into several pieces, put together."""
    here, over = Window.partitionBy("file", "block").orderBy("id"), Window.partitionBy("file").orderBy("block")
    last = rows.where("reached").groupBy("file", "block").agg(F.max("at").alias("latest"))
    blocks = rows.select("file", "block").distinct().join(last, ["file", "block"], "left")
    carried = blocks.select("file", "block", F.max("latest").over(over.rowsBetween(Window.unboundedPreceding, -1)).alias("carried"))
    owner = F.coalesce(F.max(F.when(F.col("reached"), F.col("at"))).over(here), F.col("carried"))
    owned = rows.join(carried, ["file", "block"]).select("file", "id", "at", owner.alias("owner"))
    cut = rows.where("reached and not whole and at >= 0").select("file", F.col("at").alias("owner"))
    parts = pieces.select("file", "id", "piece").join(owned.join(cut, ["file", "owner"]), ["file", "id"])
    joined = F.array_sort(F.collect_list(F.struct("at", "piece")))
    text = F.array_join(F.transform(joined, lambda x: x["piece"].cast("string")), MAGIC)
    return parts.groupBy("file", F.col("owner").alias("at")).agg(text.cast("binary").alias("piece"))


def read_archives(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """The records of the WARC files below ``path``.

    (file, offset, page_id, record_type, refers_to, payload_bytes,
    payload_digest, and if ``payloads`` payload).  A response's digest is that
    of the payload as read, held against the header; a revisit has the
    header's and no payload.  Raises where the chain of records doesn't lead
    from a file's start to its end.
    """
    pieces = written(_pieces(spark, path), "pieces")
    placed = _placed(pieces)
    runs = _runs(placed)
    dropped(placed)
    steps = runs.groupBy("file", "run").agg(F.max_by("follower", "at").alias("jump"))
    reached = reachable(steps)
    ends = runs.groupBy("file").agg(F.max(F.col("at") + len(MAGIC) + F.col("size")).alias("end"))
    done = steps.join(reached, ["file", "run"]).groupBy("file").agg(F.max("jump").alias("last"))
    wrong = ends.join(done, "file", "left").where("not (`last` <=> `end`)").select("file").take(1)
    if wrong:
        raise ValueError(f"the chain of records doesn't lead to the end of {wrong[0].file}")
    rows = runs.join(reached.withColumn("reached", F.lit(True)), ["file", "run"], "left").withColumn("reached", F.col("reached").isNotNull())
    rows = written(rows, "reached")
    alone = rows.where("reached and whole and at >= 0")
    names = [n for n in _parsed() if payloads or n != "payload"]
    parse = lambda df: df.select("file", "at", *(_parsed()[n].alias(n) for n in names))
    alone = parse(alone.select("file", "id", "at").join(pieces, ["file", "id"])) if payloads else alone.select("file", "at", *names)
    found = alone.unionByName(parse(_several(rows, pieces)))
    right = F.col("whole") & ((F.col("record_type") != "response") | F.col("payload_digest").eqNullSafe(F.col("read_digest")))
    fault = F.raise_error(F.concat(F.col("file"), F.lit(": the payload isn't that of its digest, at "), F.col("at").cast("string")))
    digest = F.when(right, F.col("payload_digest")).otherwise(fault.cast("string")).alias("payload_digest")
    columns = ["file", F.col("at").alias("offset"), "page_id", "record_type", "refers_to", "payload_bytes", digest]
    return found.select(*columns, *(["payload"] if payloads else []))


def round_trip(pages: DataFrame, path: str, archive_bytes: int = ARCHIVE_BYTES, payloads: bool = True) -> DataFrame:
    """Writes ``pages`` (page_id, url, html) as archives below ``path`` and reads them back.

    A null html is an empty payload.  Repeated rows get a record each; an
    empty table gives archives without records.  Other columns are not read.
    """
    size = pages.agg(F.sum(F.octet_length("html"))).first()[0] or 0
    # dealt out evenly, so that no archive outgrows a task
    payloads = pages.select("page_id", "url", F.col("html").cast("string").cast("binary").alias("payload"))
    write_archives(record_types(payloads, int(size // archive_bytes) + 1), path)
    return read_archives(pages.sparkSession, path, payloads)


def op3_boundary_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The records of all pages, as read back from archives."""
    found = round_trip(spark.read.parquet(f"{sf_dir}/pages.parquet"), new_path(spark, "warc"), payloads=False)
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")

"""Whether two sets of calls come from the same individual."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def genotype_calls(records: DataFrame) -> DataFrame:
    """(sample, locus, genotype) of fully called genotypes; phase doesn't matter.

    ``records`` has contig, pos, alleles and samples (map of sample to array
    of allele numbers, null where one is missing).
    """
    each = records.select(F.to_json(F.struct("contig", "pos", "alleles")).alias("locus"), F.explode("samples").alias("sample", "gt"))
    called = (F.size("gt") > 0) & F.forall("gt", lambda x: x.isNotNull())
    return each.where(called).select("sample", "locus", F.array_join(F.array_sort("gt"), "/").alias("genotype"))


def concordance(first: DataFrame, second: DataFrame) -> DataFrame:
    """(first, second, shared, matches, concordance) of every pair of samples, those without a shared locus too.

    Repeated loci multiply.  Calls are counted by (locus, sample, genotype)
    before the join, so repeats are numbers, not rows.
    """
    a = first.groupBy("locus", F.col("sample").alias("first"), F.col("genotype").alias("g")).agg(F.count(F.lit(1)).alias("m"))
    b = second.groupBy("locus", F.col("sample").alias("second"), F.col("genotype").alias("h")).agg(F.count(F.lit(1)).alias("n"))
    times = F.col("m") * F.col("n")
    found = a.join(b, "locus").groupBy("first", "second").agg(F.sum(times).alias("shared"), F.sum(F.when(F.col("g") == F.col("h"), times).otherwise(0)).alias("matches"))
    names = first.select(F.col("sample").alias("first")).distinct().crossJoin(second.select(F.col("sample").alias("second")).distinct())  # samples, not records
    out = names.join(found, ["first", "second"], "left").fillna(0, ["shared", "matches"])
    return out.withColumn("concordance", F.col("matches") / F.greatest(F.col("shared"), F.lit(1)))


def status(shared: Column, agreement: Column) -> Column:
    # fixed values: the labels and their limits
    return F.when(shared < 20, "insufficient calls").when(agreement >= 0.98, "match").when(agreement >= 0.90, "possible match").otherwise("mismatch")


def best_matches(pairs: DataFrame) -> list:
    """Each first sample's match: the pairs in order of agreement, each sample used once; who is left gets its best pair.

    ``pairs`` has a row for each pair of samples; the driver holds those.
    """
    ordered = pairs.orderBy(F.desc("concordance"), F.desc("shared"), "second", "first").collect()
    taken: dict[str, object] = {}
    seconds: set[str] = set()
    for row in ordered:
        if row["first"] not in taken and row["second"] not in seconds:
            taken[row["first"]] = row
            seconds.add(row["second"])
    for row in ordered:
        taken.setdefault(row["first"], row)
    return list(taken.values())


def pileup(reads: DataFrame, sites: DataFrame, min_depth: int, min_mapping: int = 20, min_base: int = 13) -> DataFrame:
    """(contig, pos, ref, alt, depth, alt_depth, genotype) at known sites.

    ``reads`` has contig, start (from 0), mapping_quality, cigar (array of
    structs op, len), sequence and qualities (array).  Every aligned base is
    placed by the running lengths of its CIGAR operations, then joined with
    the sites by place.  Unmapped reads have no contig and are left out.
    """
    good = reads.where((F.col("mapping_quality") >= min_mapping) & F.col("contig").isNotNull())
    ends = lambda ops: F.transform(F.sequence(F.lit(1), F.size("cigar")), lambda k: F.aggregate(F.slice("cigar", 1, k), F.lit(0), lambda s, c: s + F.when(c["op"].isin(*ops), c["len"]).otherwise(0)))
    placed = good.withColumns({"on_reference": ends((0, 2, 3, 7, 8)), "on_read": ends((0, 1, 4, 7, 8))})
    part = placed.select("contig", "start", "sequence", "qualities", F.posexplode("cigar").alias("k", "c"), "on_reference", "on_read").where(F.col("c.op").isin(0, 7, 8))
    base = part.select(
        "contig", "sequence", "qualities", F.explode(F.sequence(F.lit(0), F.col("c.len") - 1)).alias("i"),
        (F.col("start") + F.get("on_reference", F.col("k")) - F.col("c.len")).alias("from"), (F.get("on_read", F.col("k")) - F.col("c.len")).alias("read_from"),
    )
    base = base.select("contig", (F.col("from") + F.col("i") + 1).cast("long").alias("pos"), F.upper(F.substring("sequence", F.col("read_from") + F.col("i") + 1, F.lit(1))).alias("base"), F.get("qualities", F.col("read_from") + F.col("i")).alias("quality"))
    hit = base.where(F.col("quality") >= min_base).join(sites.where((F.length("ref") == 1) & (F.length("alt") == 1)), ["contig", "pos"])
    counts = hit.groupBy("contig", "pos", "ref", "alt").agg(F.count_if((F.col("base") == F.upper("ref")) | (F.col("base") == F.upper("alt"))).alias("depth"), F.count_if(F.col("base") == F.upper("alt")).alias("alt_depth"))
    share = F.col("alt_depth") / F.col("depth")
    return counts.where(F.col("depth") >= max(1, min_depth)).withColumn("genotype", F.when(share < 0.2, "0/0").when(share > 0.8, "1/1").otherwise("0/1"))

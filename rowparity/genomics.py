"""Alignments and variants: what identifies a record, which fields a profile compares, what a change is called.

Records keep the columns of their source; ``prepare`` adds those that the
comparison needs.  Headers are small and are held by the driver.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .functions import buckets
from .operators import match, metrics, normalize, regions
from .sources import bam, bcf, vcf

# fixed values: the fields and profiles of both kinds, the flags that tell the records of a template apart, the CIGAR letters
ALIGNMENT = ("read_name", "flags", "reference", "position", "mapping_quality", "cigar", "mate", "template_length", "sequence", "qualities", "tags")
VARIANT = ("locus", "identifiers", "alleles", "quality", "filters", "info", "samples")
PROFILES = {
    "alignment": {"strict": ALIGNMENT, "core": ALIGNMENT[:-1], "mapping": ALIGNMENT[:-3]},
    "variant": {"strict": VARIANT, "calls": ("locus", "alleles", "filters", "samples"), "genotypes": ("locus", "alleles", "samples")},
}
KEYS = {"alignment": ["read_name", "role"], "variant": ["contig", "pos", "alleles"]}
ROLE = 0x40 | 0x80 | 0x100 | 0x800
OPERATIONS = "MIDNSHP=XB"
DIRECT = {"mapping_quality": "MAPQ", "reference": "reference", "cigar": "CIGAR", "quality": "QUAL", "filters": "filters"}
READ_GROUP = ("SM", "LB", "PL", "PU")


@dataclass(frozen=True)
class Options:
    """What a comparison leaves out of the records, and where it looks."""

    ignore_tags: tuple[str, ...] = ()
    ignore_info: tuple[str, ...] = ()
    include: DataFrame | None = None
    exclude: DataFrame | None = None
    reference: DataFrame | None = None


def kind_of(path: str) -> str | None:
    """alignment, variant, or None for a plain table."""
    name = path.lower().rstrip("/")
    if name.endswith(".bam"):
        return "alignment"
    return "variant" if name.endswith((".vcf", ".vcf.gz", ".vcf.bgz", ".bcf")) else None


def fields_for(kind: str, profile: str) -> list[str]:
    """The fields of a profile; a profile of the other kind raises."""
    if profile not in PROFILES[kind]:
        raise ValueError(f"{kind} files have the profiles {', '.join(PROFILES[kind])}, not {profile}")
    return list(PROFILES[kind][profile])


def read(spark: SparkSession, path: str) -> DataFrame:
    """The records of a file by its suffix."""
    if path.lower().endswith(".bcf"):
        return bcf.read(spark, path)
    return bam.read(spark, path) if kind_of(path) == "alignment" else vcf.read(spark, path)


def _without(column: str, names: tuple[str, ...]) -> Column:
    return F.map_filter(column, lambda k, _: ~k.isin(*names)) if names else F.col(column)


def prepare(records: DataFrame, kind: str, options: Options = Options(), numbers: dict[tuple[str, str], str] | None = None) -> DataFrame:
    """Records with the keys and fields of their kind, in the regions asked for.

    With a reference, variants are split by allele and moved left first;
    ``numbers`` are the header's, as ``vcf_numbers`` gives them.
    """
    if kind == "alignment":
        out = records.withColumns({"role": F.col("flags").bitwiseAND(F.lit(ROLE)), "tags": _without("tags", options.ignore_tags)})
    else:
        if options.reference is not None:
            records = normalized(records, options.reference, numbers or {})
        out = records.withColumns({"locus": F.struct("contig", "pos", "stop"), "info": _without("info", options.ignore_info)})
    if options.include is None and options.exclude is None:
        return out
    placed = located(out, kind)
    return regions.allowed(placed, options.include, options.exclude).select(*out.columns)


def located(records: DataFrame, kind: str) -> DataFrame:
    """Adds contig, start and end: half-open, from 0; an unplaced record has a start below 0."""
    if kind == "variant":
        return records.withColumns({"start": F.col("pos") - 1, "end": F.col("stop")})
    length = F.aggregate("cigar", F.lit(0).cast("long"), lambda n, c: n + F.when(c["op"].isin(0, 2, 3, 7, 8), c["len"]).otherwise(0))
    end = F.when(F.col("position") < 0, F.col("position")).otherwise(F.col("position") + F.greatest(F.lit(1), F.coalesce(length, F.lit(1))))
    return records.withColumns({"contig": F.col("reference"), "start": F.col("position"), "end": end})


def split_alleles(records: DataFrame, numbers: dict[tuple[str, str], str]) -> DataFrame:
    """A row (.., ref, alt) for each alternate allele; one without any keeps a null alt.

    A genotype's own allele becomes 1 and any other 0.  Values of INFO and
    FORMAT with one number for each allele are cut to the row's; those with
    one for each genotype stay whole.
    """
    rows = records.select(*(c for c in records.columns if c != "alleles"), F.col("alleles")[0].alias("ref"), F.posexplode_outer(F.slice("alleles", 2, F.size("alleles"))).alias("nth", "alt"))
    nth = F.coalesce("nth", F.lit(0))

    def cut(section: str, key: Column, value: Column) -> Column:
        each, all_ = (F.lit(False) if not names else key.isin(*names) for names in ([n for (s, n), x in numbers.items() if s == section and x == letter] for letter in "AR"))
        parts = F.split(value, ",")
        return F.when(each, F.get(parts, nth)).when(all_, F.concat_ws(",", F.get(parts, F.lit(0)), F.get(parts, nth + 1))).otherwise(value)

    def called(value: Column) -> Column:
        own = F.concat(F.lit(r"(?<!\d)"), (nth + 1).cast("string"), F.lit(r"(?!\d)"))
        return F.replace(F.regexp_replace(F.regexp_replace(value, own, F.lit("#")), r"\d+", "0"), F.lit("#"), F.lit("1"))

    def sample(one: Column) -> Column:
        values = F.transform_values(one["values"], lambda k, v: F.when(k == "GT", called(v)).otherwise(cut("format", k, v)))
        return F.struct(values.alias("values"), one["phased"].alias("phased"))

    return rows.withColumns({"info": F.transform_values("info", lambda k, v: cut("info", k, v)), "samples": F.transform_values("samples", lambda _, s: sample(s))}).drop("nth")


def normalized(records: DataFrame, reference: DataFrame, numbers: dict[tuple[str, str], str]) -> DataFrame:
    """Variants with one alternate allele each, trimmed and moved left against a reference (``normalize.read_fasta``)."""
    rows = split_alleles(records, numbers)
    rest = [c for c in rows.columns if c not in ("contig", "pos", "ref", "alt")]
    kinds = T.StructType([rows.schema[c] for c in rest])
    packed = rows.select("contig", "pos", "ref", "alt", F.to_json(F.struct(*rest), {"ignoreNullFields": "false"}).alias("rest"))
    moved = normalize.left_normalized(packed, reference).withColumn("rest", F.from_json("rest", kinds))
    out = moved.select("contig", "pos", *(F.col(f"rest.{c}").alias(c) for c in rest), F.filter(F.array("ref", "alt"), lambda x: x.isNotNull()).alias("alleles"))
    out = out.withColumn("stop", F.coalesce(F.element_at("info", "END").cast("long"), F.col("pos") + F.length(F.col("alleles")[0]) - 1))
    return out.select(*records.columns)


def _genotype(samples: Column, name: Column) -> Column:
    """A sample's alleles joined by slashes, whatever the phase; null where there is no genotype."""
    return F.replace(F.element_at(F.element_at(samples, name)["values"], "GT"), F.lit("|"), F.lit("/"))


def _text(field: str, value: Column) -> Column:
    if field == "filters":
        return buckets.list_text(value)
    if field == "cigar":
        letters = F.array(*(F.lit(x) for x in OPERATIONS))
        return F.array_join(F.transform(value, lambda c: F.concat(c["len"].cast("string"), F.get(letters, c["op"]))), "")
    return value


def labels(found: DataFrame, fields: list[str]) -> Column:
    """The texts of what changed in a modified pair of ``match.changes``, as an array."""
    out = []
    for f in fields:
        if f"{f}_before" not in found.columns:
            continue
        before, after = F.col(f"{f}_before"), F.col(f"{f}_after")
        if f == "flags":
            one, two = buckets.flag_states(before), buckets.flag_states(after)
            moves = F.transform(F.filter(F.map_keys(one), lambda k: F.element_at(one, k) != F.element_at(two, k)), lambda k: F.concat(k, F.lit(": "), F.element_at(one, k), F.lit(" → "), F.element_at(two, k)))
        elif f in DIRECT:
            moves = F.array(buckets.transition(DIRECT[f], _text(f, before), _text(f, after)))
        elif f == "tags":
            plain = lambda m: F.transform_values(m, lambda _, t: F.concat(t["type"], F.lit(":"), t["value"]))
            moves = match.map_transitions("tag", plain(before), plain(after))
        elif f == "info":
            moves = match.map_transitions("INFO", before, after)
        elif f == "samples":
            names = F.array_sort(F.array_union(F.map_keys(before), F.map_keys(after)))
            other = F.filter(names, lambda s: ~_genotype(before, s).eqNullSafe(_genotype(after, s)))
            said = F.transform(other, lambda s: F.concat(F.lit("genotype "), s, F.lit(": "), buckets.value_text(_genotype(before, s)), F.lit(" → "), buckets.value_text(_genotype(after, s))))
            moves = F.when(F.size(said) > 0, said).otherwise(F.array(F.lit("sample FORMAT values changed")))
        else:
            moves = F.array(F.lit(f"{f.replace('_', ' ')} changed"))
        out.append(F.when(match.differs(found, f), moves).otherwise(F.array().cast("array<string>")))
    return F.concat(*out) if out else F.array().cast("array<string>")


def structure(spark: SparkSession, path: str) -> dict[str, dict[str, object]]:
    """The header's definitions that records depend on: {section: {name: value}}."""
    out: dict[str, dict[str, object]] = {}
    if kind_of(path) == "alignment":
        text, found = bam.read_alignment_header(path)
        out["contig"] = dict(found)
        for line in text.splitlines():
            if line.startswith("@RG"):
                tags = dict(x.split(":", 1) for x in line.split("\t")[1:] if ":" in x)
                out.setdefault("group", {})[tags.get("ID", "")] = {k: tags.get(k) for k in READ_GROUP}
        return out
    rows = bcf.header_rows(path) if path.lower().endswith(".bcf") else [tuple(r) for r in vcf.header(spark, path).collect()]
    for section, name, value in rows:
        out.setdefault(section, {})[name] = None if section == "sample" else value
    return out


def vcf_numbers(found: dict[str, dict[str, object]]) -> dict[tuple[str, str], str]:
    """(info or format, name) to Number, of a ``structure``."""
    return {(s, name): str(v).partition(":")[0] for s in ("info", "format") for name, v in found.get(s, {}).items()}


def structure_messages(first: dict[str, dict[str, object]], second: dict[str, dict[str, object]], most: int = 10) -> list[str]:
    """Sentences on two structures, those on the reference first; lists are cut at ``most`` names."""
    said: list[str] = []
    # fixed values: what the sections are called in reports
    for section, label in (("contig", "Contigs"), ("group", "Read groups"), ("sample", "Samples"), ("info", "INFO definitions"), ("format", "FORMAT definitions"), ("filter", "FILTER definitions")):
        a, b = first.get(section, {}), second.get(section, {})
        said += [f"{label} {what}: {', '.join(sorted(names)[:most])}" for what, names in (("added", b.keys() - a.keys()), ("removed", a.keys() - b.keys())) if names]
        moved = sorted(n for n in a.keys() & b.keys() if a[n] != b[n])
        if section == "group":
            said += [f"Read group {n} changed: {', '.join(k for k in READ_GROUP if a[n][k] != b[n][k])}" for n in moved]
        elif moved:
            said.append(f"{'Contig lengths differ' if section == 'contig' else f'{label} changed'}: {', '.join(moved[:most])}")
    a, b = first.get("contig", {}), second.get("contig", {})
    if a.keys() | b.keys() and (len(a.keys() & b.keys()) < 0.8 * len(a.keys() | b.keys()) or any(a[n] != b[n] for n in a.keys() & b.keys())):
        said.insert(0, "Reference compatibility warning: contig names or lengths indicate different reference definitions.")
    return said


def attribution(found: DataFrame, kind: str) -> dict[str, int]:
    """Changes by read group, or modified records by sample whose genotype or phase differs; the most frequent first.

    A pair counts for the second record's read group, or the first's where
    that has none.  Without tags or samples among the fields there is nothing.
    """
    column = "tags" if kind == "alignment" else "samples"
    if f"{column}_before" not in found.columns:
        return {}
    if kind == "alignment":
        group = lambda when: F.element_at(f"tags_{when}", "RG")["value"]
        names = found.select(F.coalesce(group("after"), group("before")).alias("name"))
    else:
        before, after = F.col("samples_before"), F.col("samples_after")
        call = lambda m, s: F.struct(_genotype(m, s), F.element_at(m, s)["phased"])
        every = F.array_union(F.map_keys(before), F.map_keys(after))
        other = F.filter(every, lambda s: ~call(before, s).eqNullSafe(call(after, s)))
        names = found.where("status = 'modified'").select(F.explode(other).alias("name"))
    counts = names.where("name is not null").groupBy("name").agg(F.count(F.lit(1)).alias("n"))
    return {r["name"]: r["n"] for r in counts.orderBy(F.desc("n"), "name").collect()}


def places(found: DataFrame, kind: str) -> DataFrame:
    """(contig, position, status) of changes; the position, from 0, is the second record's if there are two."""
    if kind == "variant":
        return found.select("contig", (F.col("pos") - 1).alias("position"), "status")
    side = lambda f: F.when(F.col("status") == "left_only", F.col(f"{f}_before")).otherwise(F.col(f"{f}_after"))
    return found.select(side("reference").alias("contig"), side("position").alias("position"), "status").where("contig is not null and position >= 0")


def _named(metric: str, values: Column) -> Column:
    return F.transform(values, lambda v: F.struct(F.lit(metric).alias("metric"), v.alias("bucket")))


def histograms(records: DataFrame, kind: str, fields: list[str]) -> DataFrame:
    """(metric, bucket, n) of the metrics whose fields are compared, in one pass; a record may have several values."""
    bit = lambda n: F.array((F.col("flags").bitwiseAND(F.lit(n)) != 0).cast("double"))
    one = lambda value, step, most: F.array(buckets.bucket(value, step, most).cast("double"))
    found: list[tuple[str, str, Column]] = []  # field, metric, values
    if kind == "alignment":
        size = F.abs("template_length")
        found += [("mapping_quality", "mapping_quality", one(F.col("mapping_quality"), 5, 255)), ("sequence", "read_length", one(F.coalesce(F.length("sequence"), F.lit(0)), 250, 100_000))]
        found += [("template_length", "insert_size", one(F.when(size > 0, size), 100, 10_000))]
        found += [("flags", f"{name}_rate", bit(n)) for name, n in (("unmapped", 4), ("duplicate", 0x400), ("secondary", 0x100), ("supplementary", 0x800))]
    else:
        numbers = lambda key: F.filter(F.transform(F.split(F.element_at("info", key), ","), lambda v: v.try_cast("double")), lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
        called = F.transform(F.map_values("samples"), lambda s: F.filter(F.split(F.element_at(s["values"], "GT"), "[/|]"), lambda a: a != "."))
        mixed = F.transform(F.filter(called, lambda g: F.size(g) > 0), lambda g: (F.size(F.array_distinct(g)) > 1).cast("double"))
        found += [
            ("quality", "variant_quality", one(F.col("quality"), 10, 1_000)), ("info", "depth", F.transform(numbers("DP"), lambda v: buckets.bucket(v, 10, 10_000).cast("double"))),
            ("info", "allele_frequency", F.transform(numbers("AF"), lambda v: buckets.half_even(v, 20))), ("samples", "heterozygous_rate", mixed),
            ("filters", "filtered_rate", F.array((F.size(F.array_except("filters", F.array(F.lit("PASS")))) > 0).cast("double"))),
        ]
    rows = [_named(name, values) for field, name, values in found if field in fields]
    if not rows:
        return records.sparkSession.createDataFrame([], "metric string, bucket double, n long")
    pairs = F.flatten(F.array(*(F.coalesce(r, F.array().cast("array<struct<metric:string,bucket:double>>")) for r in rows)))
    return records.select(F.inline(pairs)).where("bucket is not null").groupBy("metric", "bucket").agg(F.count(F.lit(1)).alias("n"))


def shifts(left: DataFrame, right: DataFrame, kind: str, fields: list[str]) -> list[dict]:
    """The metrics that moved most: name, distance, and each side's median (its mean for a rate)."""
    sides = [histograms(df, kind, fields).persist() for df in (left, right)]
    moved = metrics.shifts(*sides).collect()
    middle = [{r["metric"]: (r["median"], r["mean"]) for r in df.groupBy("metric").agg(F.percentile("bucket", 0.5, F.col("n")).alias("median"), (F.sum(F.col("bucket") * F.col("n")) / F.sum("n")).alias("mean")).collect()} for df in sides]
    for df in sides:
        df.unpersist()
    return [{"metric": r["metric"], "distance": r["distance"], "first": middle[0][r["metric"]][k], "second": middle[1][r["metric"]][k]} for r in moved for k in [int(r["metric"].endswith("_rate"))]]

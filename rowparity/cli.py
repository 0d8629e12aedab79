"""Command line: ``python -m rowparity compare|batch|baseline-create|baseline-check|matrix|identity|manifest ...``.

Exit codes: 0 equivalent or passed, 1 different or failed, 2 an error.
"""

from __future__ import annotations

import argparse
import json
import sys
import time
from collections import Counter
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import artifacts, genomics, report
from .batch import run as run_batch
from .compare import labels
from .functions.canon import record_digest
from .genomics import Options
from .inputs import Pair, load, pair
from .operators import baseline, identity, match, matrix, normalize, policy, regions, tracks
from .sources import bam, bcf, joined, manifest, vcf


def _parser() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="rowparity", description=__doc__)
    commands = parser.add_subparsers(dest="command", required=True)

    def command(name: str, *positional: str) -> argparse.ArgumentParser:
        sub = commands.add_parser(name)
        for p in positional:
            sub.add_argument(p)
        sub.add_argument("--keys", type=lambda s: s.split(","), help="identity columns; those of the kind if left out")
        sub.add_argument("--fields", type=lambda s: s.split(","), help="compared columns; the profile's, or all shared ones, if left out")
        sub.add_argument("--profile", default="strict", help="strict, core or mapping for alignments; strict, calls or genotypes for variants")
        sub.add_argument("--reference", help="FASTA file")
        sub.add_argument("--normalize", action="store_true", help="split variants and move them left against --reference")
        sub.add_argument("--ignore-tag", action="append", default=[])
        sub.add_argument("--ignore-info", action="append", default=[])
        sub.add_argument("--region", action="append", default=[], metavar="CONTIG:FIRST-LAST")
        sub.add_argument("--regions", metavar="BED", help="compare only these")
        sub.add_argument("--exclude-regions", metavar="BED")
        sub.add_argument("--cache", metavar="FOLDER", help="keep decoded inputs there as Parquet and read them again")
        sub.add_argument("--force", action="store_true", help="replace outputs")
        return sub

    one = command("compare", "first", "second")
    one.add_argument("--explain", action="store_true")
    one.add_argument("--name-a")
    one.add_argument("--name-b")
    one.add_argument("--max-examples", type=int, default=10, help="changes that reports show, and places that --igv-batch visits")
    for kind in ("json", "html", "svg", "igv-batch", "difference-table", "reproducibility"):
        one.add_argument(f"--{kind}")
    for kind in ("write-diff", "tracks"):
        one.add_argument(f"--{kind}", metavar="FOLDER")
    many = command("batch", "manifest")
    many.add_argument("--policy")
    many.add_argument("--max-examples", type=int, default=0, help="changes that reports show of each comparison")
    many.add_argument("--output", help="a folder for all reports")
    many.add_argument("--max-modified", type=int, default=0)
    many.add_argument("--max-modified-fraction", type=float)
    many.add_argument("--max-only", type=int, default=0)
    many.add_argument("--max-only-fraction", type=float)
    many.add_argument("--min-overlap", type=float, default=0.0)
    many.add_argument("--allow-structural-differences", action="store_true")
    many.add_argument("--fail-transition", action="append", default=[])
    for kind in ("write-diff", "tracks"):
        many.add_argument(f"--{kind}", metavar="FOLDER", help="one folder for each comparison below it")
    for name in ("create", "check"):
        sub = command(f"baseline-{name}", "manifest", "baseline")
        if name == "check":
            sub.add_argument("--json")
    same = command("identity", "first", "second")
    same.add_argument("--json")
    same.add_argument("--sites", help="VCF of known single-base sites, for alignments")
    same.add_argument("--min-depth", type=int, default=5)
    command("manifest", "before", "after", "output").add_argument("--dry-run", action="store_true", help="print the manifest")
    grid = command("matrix")
    grid.add_argument("paths", nargs="+")
    grid.add_argument("--json")
    grid.add_argument("--html")
    return parser


def _options(spark: SparkSession, o: argparse.Namespace, normalize_: bool | None = None, reference: str | None = None) -> Options:
    """The options of a comparison; a manifest's entry may say otherwise about normalising."""
    fasta = reference or o.reference
    wanted = o.normalize if normalize_ is None else normalize_
    if wanted and not fasta:
        raise ValueError("--normalize needs --reference")
    include = regions.read_bed(spark, o.regions) if o.regions else None
    if o.region:
        named = spark.createDataFrame([regions.parse_region(r) for r in o.region], "contig string, start long, end long")
        include = named if include is None else include.union(named)
    exclude = regions.read_bed(spark, o.exclude_regions) if o.exclude_regions else None
    return Options(tuple(o.ignore_tag), tuple(o.ignore_info), include, exclude, normalize.read_fasta(spark, fasta) if wanted else None)


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> int:
    options = _parser().parse_args(args)
    options.arguments = list(args if args is not None else sys.argv[1:])
    try:
        return _COMMANDS[options.command](spark or SparkSession.builder.getOrCreate(), options)
    except Exception as e:  # the boundary to the shell
        print(f"error: {e}", file=sys.stderr)
        return 2


def _write_diff(spark: SparkSession, both: Pair, found: DataFrame, first: str, second: str, target: str, force: bool) -> None:
    """Four files of records, only in one or modified, in the format of the inputs (Parquet for plain tables)."""
    named = (("left_only", "before", "only-in-first", first), ("right_only", "after", "only-in-second", second), ("modified", "before", "modified-first", first), ("modified", "after", "modified-second", second))
    others = [f for f in both.fields or both.left.columns if f not in both.keys]
    needed = set(genomics.PROFILES[both.kind]["strict"]) if both.kind else set()
    if needed - {*both.keys, *others}:
        raise ValueError("--write-diff needs the strict profile")
    with artifacts.workspace(target, force) as folder:
        for status, suffix, name, source in named:
            rows = found.where(F.col("status") == status).select(*both.keys, *(F.col(f"{f}_{suffix}").alias(f) for f in others))
            if both.kind == "alignment":
                bam.write(rows.orderBy("reference", "position", "read_name"), f"{folder}/{name}.bam", *bam.read_alignment_header(source))
            elif source.lower().endswith(".bcf"):
                bcf.write(rows, f"{folder}/{name}.bcf", bcf.header(source))
            elif both.kind == "variant":
                head = vcf.header_text(spark, source)
                joined.write(vcf.lines(rows, head[-1].split("\t")[9:]), f"{folder}/{name}.vcf", head)
            else:
                rows.write.parquet(f"{folder}/{name}")


def _write_tracks(spark: SparkSession, both: Pair, found: DataFrame, target: str, force: bool) -> None:
    if both.kind is None:
        raise ValueError("--tracks needs alignments or variants")
    changes = genomics.places(found, both.kind)
    sides = [genomics.located(df, both.kind).select("contig", F.col("start").alias("position")) for df in (both.left, both.right)]
    sizes = spark.createDataFrame(list(both.contigs.items()), "contig string, length long")
    with artifacts.workspace(target, force) as folder:
        tracks.write_tracks(tracks.windows(*sides, changes), str(folder), lengths=sizes)
        joined.write(tracks.bed(changes.withColumn("status", F.replace(F.replace("status", F.lit("left_only"), F.lit("only_in_first")), F.lit("right_only"), F.lit("only_in_second")))), f"{folder}/changes.bed")


def _compare(spark: SparkSession, o: argparse.Namespace) -> int:
    began = time.monotonic()
    outputs = [p for p in (o.json, o.html, o.svg, o.igv_batch, o.difference_table, o.reproducibility, o.write_diff, o.tracks) if p]
    places = [str(Path(p).resolve()) for p in outputs]
    if len({*places}) < len(places) or {*places} & {str(Path(p).resolve()) for p in (o.first, o.second)}:
        raise ValueError("outputs must differ from each other and from the inputs")
    if taken := [p for p in places if Path(p).exists() and not o.force]:
        raise FileExistsError(f"{taken[0]} exists")
    both = pair(spark, o.first, o.second, o.keys, o.fields, o.profile, _options(spark, o), o.cache)
    if o.igv_batch and both.kind is None:
        raise ValueError("--igv-batch needs alignments or variants")
    visits: list[tuple[str, int]] = []

    def use(found: DataFrame) -> None:
        fields = [f for f in both.fields or both.left.columns if f not in both.keys]
        if o.difference_table:
            match.write_ledger(match.ledger(found, both.keys, fields), o.difference_table, o.force, "gzip" if o.difference_table.endswith(".gz") else "none")
        if o.write_diff:
            _write_diff(spark, both, found, o.first, o.second, o.write_diff, o.force)
        if o.tracks:
            _write_tracks(spark, both, found, o.tracks, o.force)
        if o.igv_batch:
            visits.extend((r["contig"], r["position"]) for r in genomics.places(found, both.kind).select("contig", "position").distinct().orderBy("contig", "position").limit(o.max_examples).collect())

    default = labels(o.first, o.second)
    result = both.compare((o.name_a or default[0], o.name_b or default[1]), bool(o.explain or outputs), use, o.max_examples)
    print(report.text(result), end="")
    made = {o.json: result.to_json, o.html: lambda: report.html(result), o.svg: lambda: report.svg(result)}
    made[o.igv_batch] = lambda: tracks.igv_batch(visits, [o.first, o.second], o.reference or "genome")
    made[o.reproducibility] = lambda: artifacts.reproducibility(result.to_dict(), o.arguments, [o.first, o.second], o.reference, time.monotonic() - began)
    for path, text in made.items():
        if path:
            artifacts.write_text(path, text(), o.force)
    return int(not result.equivalent)


def _entries(spark: SparkSession, path: str) -> list[dict]:
    base = Path(path).resolve().parent
    rows = [r.asDict() for r in manifest.read(spark, path).collect()]
    return [r | {k: r[k] if r[k].startswith("/") or "://" in r[k] else str(base / r[k]) for k in ("before", "after")} for r in rows]


def _entry_pair(spark: SparkSession, o: argparse.Namespace, entry: dict) -> Pair:
    said = (entry.get("normalize") or "").lower()
    if said not in ("", "true", "yes", "1", "false", "no", "0"):
        raise ValueError(f"normalize is true or false, not {said!r}")
    options = _options(spark, o, said in ("true", "yes", "1") if said else None, entry.get("reference"))
    return pair(spark, entry["before"], entry["after"], o.keys, o.fields, entry.get("profile") or o.profile, options, o.cache)


def _batch(spark: SparkSession, o: argparse.Namespace) -> int:
    entries = _entries(spark, o.manifest)
    document = policy.load(Path(o.policy).read_text()) if o.policy else None
    base = policy.Policy(o.max_modified, o.max_only, o.max_modified_fraction, o.max_only_fraction, o.min_overlap, o.allow_structural_differences, tuple(o.fail_transition))
    names = artifacts.slugs([f"{e['sample']} {e['stage']}" for e in entries])

    def use(entry: dict, both: Pair, found: DataFrame) -> None:
        name = names[f"{entry['sample']} {entry['stage']}"]
        if o.write_diff:
            Path(o.write_diff).mkdir(exist_ok=True)
            _write_diff(spark, both, found, entry["before"], entry["after"], f"{o.write_diff}/{name}", o.force)
        if o.tracks:
            Path(o.tracks).mkdir(exist_ok=True)
            _write_tracks(spark, both, found, f"{o.tracks}/{name}", o.force)

    found = run_batch(spark, entries, lambda entry: _entry_pair(spark, o, entry), base, document, use=use if o.write_diff or o.tracks else None, examples=o.max_examples)
    print(report.batch_text(found), end="")
    if o.output:
        with artifacts.workspace(o.output, o.force) as folder:
            (folder / "batch.json").write_text(json.dumps(found.to_dict(), indent=2, sort_keys=True))
            (folder / "batch.html").write_text(report.batch_html(found))
            (folder / "junit.xml").write_text(report.junit(found))
            (folder / "multiqc.json").write_text(report.multiqc(found))
            artifacts.write_manifest(folder, {"passed": found.passed})
    return int(not found.passed)


def _tables(spark: SparkSession, o: argparse.Namespace, side: str) -> tuple[dict, list[str]]:
    tables, fields = {}, o.fields
    for e in _entries(spark, o.manifest):
        kind, df = genomics.kind_of(e[side]), load(spark, e[side], o.cache)
        if kind:
            numbers = genomics.vcf_numbers(genomics.structure(spark, e[side]))
            df = genomics.prepare(df, kind, _options(spark, o, reference=e.get("reference")), numbers)
            fields = fields or genomics.fields_for(kind, e.get("profile") or o.profile)
        tables[e["sample"], e["stage"]] = df
    return tables, fields or next(iter(tables.values())).columns


def _create(spark: SparkSession, o: argparse.Namespace) -> int:
    baseline.create(*_tables(spark, o, "before")).write.mode("overwrite" if o.force else "error").json(o.baseline)
    return 0


def _check(spark: SparkSession, o: argparse.Namespace) -> int:
    after = baseline.create(*_tables(spark, o, "after"))
    rows = baseline.check(baseline.validated(spark.read.schema(after.schema).json(o.baseline)), after).orderBy("sample", "stage").collect()
    for r in rows:
        print(f"{'ok  ' if r['passed'] else 'FAIL'} {r['sample']} / {r['stage']}" + (f": {', '.join(r['changed_fields'])}" if r["changed_fields"] else ""))
    if o.json:
        artifacts.write_text(o.json, json.dumps([r.asDict(recursive=True) for r in rows], indent=2, sort_keys=True), o.force)
    return int(not all(r["passed"] for r in rows))


def _matrix(spark: SparkSession, o: argparse.Namespace) -> int:
    digests, options = None, _options(spark, o)
    for path in o.paths:
        kind, df = genomics.kind_of(path), load(spark, path, o.cache)
        if kind:
            df = genomics.prepare(df, kind, options, genomics.vcf_numbers(genomics.structure(spark, path)))
        fields = o.fields or (genomics.fields_for(kind, o.profile) if kind else df.columns)
        part = df.select(F.lit(path).alias("name"), record_digest(df, fields).alias("h"))
        digests = part if digests is None else digests.union(part)
    pairs = matrix.similarities(digests).persist()
    value = {(r["a"], r["b"]): r["similarity"] for r in pairs.collect()}
    odd = sorted(r["name"] for r in matrix.outliers(pairs).collect())
    names = matrix.order(o.paths, {(min(a, b), max(a, b)): v for (a, b), v in value.items()})
    rows = [[1.0 if a == b else value[min(a, b), max(a, b)] for b in names] for a in names]
    for a, row in zip(names, rows, strict=True):
        print(f"{a}\t" + "\t".join(f"{v:.3f}" for v in row) + ("\toutlier" if a in odd else ""))
    if o.json:
        artifacts.write_text(o.json, json.dumps({"names": names, "similarity": rows, "outliers": odd}, indent=2), o.force)
    if o.html:
        artifacts.write_text(o.html, report.matrix_html(names, rows, odd), o.force)
    return 0


def _calls(spark: SparkSession, o: argparse.Namespace, path: str) -> DataFrame:
    """(sample, locus, genotype): of a variant file's samples, or of an alignment at known sites, named by the file."""
    if genomics.kind_of(path) == "variant":
        return identity.genotype_calls(vcf.genotypes(load(spark, path, o.cache)))
    if not o.sites:
        raise ValueError("--sites is needed for alignments")
    known = load(spark, o.sites).where((F.size("alleles") == 2) & (F.length(F.col("alleles")[0]) == 1) & F.col("alleles")[1].rlike("^[ACGTacgt]$"))
    known = known.select("contig", "pos", F.col("alleles")[0].alias("ref"), F.col("alleles")[1].alias("alt"))
    if known.isEmpty():
        raise ValueError(f"{o.sites} has no site with one alternative of a single base")
    reads = genomics.located(load(spark, path, o.cache), "alignment").where(F.col("flags").bitwiseAND(F.lit(0x704)) == 0)
    called = identity.pileup(reads, known, o.min_depth)
    return called.select(F.lit(path).alias("sample"), F.to_json(F.struct("contig", "pos", F.array("ref", "alt").alias("alleles"))).alias("locus"), "genotype")


def _identity(spark: SparkSession, o: argparse.Namespace) -> int:
    calls = [_calls(spark, o, p) for p in (o.first, o.second)]
    pairs = identity.concordance(*calls).withColumn("status", identity.status(F.col("shared"), F.col("concordance"))).persist()
    best = identity.best_matches(pairs)
    for r in best:
        print(f"{r['first']}\t{r['second']}\t{r['shared']:,} shared\t{r['concordance']:.1%}\t{r['status']}")
    if o.json:
        artifacts.write_text(o.json, json.dumps([r.asDict() for r in best], indent=2), o.force)
    return int(not best or any(r["status"] not in ("match", "possible match") for r in best))


def _manifest(spark: SparkSession, o: argparse.Namespace) -> int:
    sides = []
    for root in (o.before, o.after):
        names = sorted(str(p.relative_to(root)) for p in Path(root).rglob("*") if p.name.lower().endswith(manifest.SUFFIXES))
        sides.append(spark.createDataFrame([(n,) for n in names], "path string"))
    rows = manifest.pair(*sides).orderBy("path").collect()
    if missing := [f"{r['path']} ({r['status']})" for r in rows if r["status"] != "paired"]:
        raise ValueError(f"unpaired files: {', '.join(missing[:10])}")
    twice = [k for k, n in Counter((r["sample"], r["stage"]) for r in rows).items() if n > 1]
    if twice:
        raise ValueError(f"duplicate sample and stage: {', '.join(twice[0])}")
    lines = ["\t".join(manifest.REQUIRED), *("\t".join([r["sample"], r["stage"], *(str(Path(side).resolve() / r["path"]) for side in (o.before, o.after))]) for r in rows)]
    if o.dry_run:
        print("\n".join(lines))
        return 0
    artifacts.write_text(o.output, "\n".join(lines) + "\n", o.force)
    return 0


_COMMANDS = {"identity": _identity, "manifest": _manifest, "compare": _compare, "batch": _batch, "baseline-create": _create, "baseline-check": _check, "matrix": _matrix}

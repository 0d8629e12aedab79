import json

import pytest
from pyspark.sql import functions as F

from rowparity.functions import buckets
from rowparity.operators import baseline, fingerprint, headers, identity, match, matrix, metrics, policy, regions, sketch, tracks
from rowparity.sources import manifest, vcf
from rowparity.streaming import fingerprint as stream


def test_intervals(spark):
    rows = [("a", 5, 9), ("a", 1, 5), ("a", 20, 30), ("a", 22, 25), ("b", 0, 1)]
    out = regions.merge(spark.createDataFrame(rows, "contig string, start long, end long"))
    assert sorted(tuple(r) for r in out.collect()) == [("a", 1, 9), ("a", 20, 30), ("b", 0, 1)]


def test_regions_and_unplaced_records(spark):
    records = spark.createDataFrame([(1, "a", 10, 14), (2, "a", 14, 15), (3, None, -1, -1), (4, "b", 10, 14), (5, "a", 100_000, 100_001), (5, "a", 100_000, 100_001)], "id int, contig string, start long, end long")
    spans = spark.createDataFrame([("a", 13, 14), ("a", 14, 14 + 1), ("a", 50_000, 200_000)], "contig string, start long, end long")
    ids = lambda df: sorted(r.id for r in df.collect())
    assert ids(regions.allowed(records, spans, None, 8)) == [1, 2, 5, 5]
    assert ids(regions.allowed(records, None, spans, 8)) == [3, 4]
    assert ids(regions.allowed(records, spans, spans.where("end = 14"))) == [2, 5, 5]
    assert ids(regions.allowed(records, None, None)) == [1, 2, 3, 4, 5, 5]


def test_region_text_and_bed(spark, tmp_path):
    assert regions.parse_region("chr1:1,000-2,000") == ("chr1", 999, 2000)
    for bad in ("chr1", "chr1:5-4", "chr1:0-3", ":1-2"):
        with pytest.raises(ValueError):
            regions.parse_region(bad)
    (tmp_path / "a.bed").write_text("# x\ntrack name=t\n\nchr1\t5\t9\tname\nchr2 1 2\n")
    assert sorted(tuple(r) for r in regions.read_bed(spark, str(tmp_path / "a.bed")).collect()) == [("chr1", 5, 9), ("chr2", 1, 2)]
    (tmp_path / "b.bed").write_text("chr1\t9\t5\n")
    with pytest.raises(Exception, match="not a BED line"):
        regions.read_bed(spark, str(tmp_path / "b.bed")).collect()


def test_windows(spark):
    place = lambda rows: spark.createDataFrame(rows, "contig string, position long")
    counts = tracks.windows(place([("a", 10), ("a", 11), (None, 5)]), place([("a", 10), ("a", 11)]), place([("a", 11), ("a", -1)]))
    row = tracks.density(counts, lengths=spark.createDataFrame([("a", 1000)], "contig string, length long")).first()
    assert (row.n_left, row.n_right, row.changes, row.start, row.end, row.fraction, row.coverage_log2) == (2, 2, 1, 0, 1000, 0.25, 0.0)
    assert [r.value for r in tracks.bedgraph(tracks.density(counts), "fraction").collect()] == ["a 0 1000000 0.25"]


def test_written_tracks_and_changes(spark, tmp_path):
    place = lambda rows: spark.createDataFrame(rows, "contig string, position long")
    counts = tracks.windows(place([("chr1", 9)]), place([("chr1", 9)]), place([("chr1", 9)] * 3))
    tracks.write_tracks(counts, str(tmp_path / "t"), lengths=spark.createDataFrame([("chr1", 1000)], "contig string, length long"))
    line = lambda name: [r.value for r in spark.read.text(str(tmp_path / "t" / f"{name}.bedGraph")).collect()]
    assert (line("density"), line("rate"), line("coverage_log2")) == (["chr1 0 1000 3"], ["chr1 0 1000 1"], ["chr1 0 1000 0"])
    assert spark.read.option("sep", "\t").option("header", True).csv(str(tmp_path / "t" / "contig-summary.tsv")).first().contig == "chr1"
    assert tracks.igv_batch([("chr1", 9)], ["a.bam"], "hg38") == "new\ngenome hg38\nload a.bam\ngoto chr1:1-110\n"
    with pytest.raises(ValueError):
        tracks.igv_batch([], [], "hg38")
    a, b = spark.createDataFrame([(1, "x"), (2, "y"), (4, "s")], "k int, v string"), spark.createDataFrame([(1, "z"), (3, "w"), (4, "s")], "k int, v string")
    match.write_changes(match.changes(a, b, ["k"], ["k", "v"]), ["k"], ["v"], str(tmp_path / "c"))
    read = lambda name: [tuple(r) for r in spark.read.parquet(str(tmp_path / "c" / name)).collect()]
    assert [read(n) for n in ("only-in-first", "only-in-second", "modified-first", "modified-second")] == [[(2, "y")], [(3, "w")], [(1, "x")], [(1, "z")]]


def test_distributions(spark):
    hist = spark.createDataFrame([("m", 0.0, 3), ("m", 10.0, 1), ("e", 5.0, 2), ("e", 7.0, 2)], "metric string, bucket double, n long")
    other = spark.createDataFrame([("m", 0.0, 1), ("m", 10.0, 1)], "metric string, bucket double, n long")
    assert [(r.metric, r.distance) for r in metrics.shifts(hist, other).collect()] == [("m", 0.25)]
    assert {r.metric: r.median for r in metrics.medians(hist).collect()} == {"m": 0.0, "e": 6.0}
    many = spark.range(100).select(F.lit("m").alias("metric"), F.col("id").cast("double").alias("bucket"), F.lit(1).cast("long").alias("n"))
    out = metrics.bins(many).collect()
    assert len(out) == 25 and all(r.n == 4 for r in out)
    row = spark.sql("select -1 a, 0.125 b").select(buckets.floor_div(F.col("a"), 1_000_000).alias("f"), buckets.half_even(F.col("b"), 20).alias("h")).first()
    assert row.f == -1 and float(row.h) == 0.1
    numbers = [0.0, 0.25, -1.5, 123456.0, 1234567.0, 1e-5, 0.000123456789, 1 / 3, 100.0, 999999.7, 1e300]
    out = spark.createDataFrame([(i, x) for i, x in enumerate(numbers)], "i int, x double").orderBy("i").select(buckets.six_digits(F.col("x")).alias("t")).collect()
    assert [r.t for r in out] == [f"{x:.6g}" for x in numbers]


def test_sketches(spark):
    one = spark.range(300).select(F.md5(F.col("id").cast("string")).alias("h"))
    two = spark.range(150, 450).select(F.md5(F.col("id").cast("string")).alias("h"))
    empty = one.limit(0)
    exact, guess = sketch.exact_containment(one, two).first(), sketch.containment(sketch.kmv(one), sketch.kmv(two)).first()
    assert exact.containment == 0.5 and abs(guess.containment - 0.5) < 1e-9
    assert sketch.containment(empty, empty).first().containment == 1 and sketch.containment(one, empty).first().containment == 0
    big = spark.range(50_000).select(F.md5(F.col("id").cast("string")).alias("h"))
    assert abs(sketch.cardinality(sketch.kmv(big)).first().n / 50_000 - 1) < 0.15


RULE = {"name": "r", "match": {"stage": "*"}, "set": {"max_only": 1}}
BAD = (
    *({"version": 1, "defaults": {k: v}} for k, v in (
        ("max_modified", -1), ("max_modified", True), ("max_only", 1.5), ("max_only_fraction", 1.1), ("min_overlap", None), ("min_overlap", "1"),
        ("allow_structural_differences", 1), ("deny_fields", "a"), ("deny_fields", [""]), ("allow_transitions", [1]), ("transition_default", "warn"))),
    [], {"version": True}, {"version": 1, "extra": 1}, {"version": 1, "rules": {}}, {"version": 1, "defaults": []},
    *({"version": 1, "rules": [RULE | change]} for change in ({"name": ""}, {"match": {}}, {"match": {"stage": 1}}, {"set": {}}, {"more": 1})),
    {"version": 1, "rules": [RULE, RULE]},
)


def test_policy():
    text = json.dumps({"version": 1, "defaults": {"max_modified": 5}, "rules": [{"name": "calls", "match": {"stage": "VAR*"}, "set": {"deny_fields": ["samples"], "severity": "warning"}}]})
    found, names = policy.resolve(policy.Policy(), policy.load(text), sample="a", stage="variants")
    assert names == ("calls",) and found.deny_fields == ("samples",) and found.max_modified == 5 and found.transition_default == "fail"
    assert policy.resolve(policy.Policy(), policy.load(text), sample="a", stage="reads")[1] == ()
    for bad in ({"version": 2}, {"version": 1, "defaults": {"nope": 1}}, {"version": 1, "rules": [{"name": "r", "match": {"x": "y"}}]}, {"version": 1, "defaults": {"severity": "loud"}}, *BAD):
        with pytest.raises(ValueError):
            policy.load(json.dumps(bad))


def test_policy_violations(spark):
    rows = spark.sql("select 1000L n_left, 1000L n_right, 1200L modified, 0L left_only, 1L right_only, 0.5D overlap, false structure_equal, array('samples') changed_fields, map('genotype s: 0/1 → 1/1', 2) transitions")
    limits = policy.Policy(deny_fields=("samples",), deny_transitions=("GENOTYPE*",), min_overlap=0.9)
    row = policy.evaluate(rows, limits).first()
    assert row.violations == [
        "modified records 1,200 exceed 0", "sample-only records 1 exceed 0", "identity overlap 50.0% is below 90.0%", "structural header differs",
        "forbidden changed fields: samples", "forbidden transition 'GENOTYPE*' occurred 2 times",
    ] and not row.passed
    loose = policy.Policy(max_modified=None, max_only=None, allow_structural_differences=True, transition_default="fail", allow_transitions=("genotype",))
    row = policy.evaluate(rows, loose).first()
    assert row.violations == [] and row.passed
    assert policy.evaluate(rows, policy.Policy(severity="warning")).first().passed


def test_baselines_and_headers(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y")], "k int, v string")
    b = spark.createDataFrame([(1, "x"), (2, "z")], "k int, v string")
    first = baseline.create({("s", "t"): a}, ["k", "v"])
    assert [tuple(r) for r in baseline.check(first, baseline.create({("s", "t"): a.orderBy(F.desc("k"))}, ["k", "v"])).collect()] == [("s", "t", True, [])]
    assert [tuple(r) for r in baseline.check(first, baseline.create({("s", "t"): b}, ["k", "v"])).collect()] == [("s", "t", False, ["v"])]
    names = lambda rows: spark.createDataFrame(rows, "name string, value string")
    found = headers.differences(names([("chr1", "1000"), ("x", None)]), names([("chr1", "2000"), ("y", "1")]))
    assert headers.messages("Contigs", found) == ["Contigs added: y", "Contigs removed: x", "Contigs changed: chr1"]
    assert not headers.compatible({"chr1": 1000}, {"chr1": 2000}) and headers.compatible({"chr1": 1}, {"chr1": 1}) and headers.compatible({}, {})


VCF = """##fileformat=VCFv4.3
##contig=<ID=chr1,length=1000>
##INFO=<ID=DP,Number=1,Type=Integer,Description="d">
##FORMAT=<ID=GT,Number=1,Type=String,Description="g">
#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\tsample\tother
chr1\t10\t.\tA\tC,G\t60\tPASS\tDP=20;DB\tGT\t0/1\t1|1
chr1\t20\trs1\tAT\tA\t.\t.\t.\tGT:DP\t./.:3\t0/0:4
"""


def test_vcf(spark, tmp_path):
    (tmp_path / "a.vcf").write_text(VCF)
    rows = vcf.read(spark, str(tmp_path / "a.vcf")).orderBy("pos").collect()
    assert (rows[0].contig, rows[0].pos, rows[0].stop, rows[0].identifiers, rows[0].alleles, rows[0].quality, rows[0].filters, rows[0].info) == ("chr1", 10, 10, None, ["A", "C", "G"], 60.0, ["PASS"], {"DP": "20", "DB": "true"})
    assert rows[0].samples["other"].phased and rows[0].samples["sample"]["values"] == {"GT": "0/1"} and rows[1].stop == 21 and rows[1].samples["other"]["values"]["DP"] == "4"
    assert {tuple(r) for r in vcf.header(spark, str(tmp_path / "a.vcf")).collect()} >= {("contig", "chr1", "1000"), ("info", "DP", "1:Integer"), ("sample", "sample", "9")}
    assert vcf.split_alleles(vcf.read(spark, str(tmp_path / "a.vcf"))).count() == 3
    vcf.write(vcf.read(spark, str(tmp_path / "a.vcf")), str(tmp_path / "out"))
    back = sorted(r.value for r in spark.read.text(str(tmp_path / "out")).collect())
    assert back == ["chr1\t10\t.\tA\tC,G\t60.0\tPASS\tDB;DP=20", "chr1\t20\trs1\tAT\tA\t.\t.\t."]


def test_identity(spark):
    rows = [("c", i, ["A", "C"], {"s": [0, 1], "t": [1, 1], "u": [0, None]}) for i in range(30)]
    calls = identity.genotype_calls(spark.createDataFrame(rows, "contig string, pos long, alleles array<string>, samples map<string,array<int>>"))
    pairs = identity.concordance(calls, calls.where("sample = 's'"))
    found = {(r.first, r.second): (r.shared, r.concordance, r.status) for r in pairs.withColumn("status", identity.status(F.col("shared"), F.col("concordance"))).collect()}
    assert found == {("s", "s"): (30, 1.0, "match"), ("t", "s"): (30, 0.0, "mismatch")}
    assert [(r["first"], r["second"]) for r in identity.best_matches(pairs)] == [("s", "s"), ("t", "s")]


def test_pileup(spark):
    schema = "contig string, start int, mapping_quality int, cigar array<struct<op:int,len:int>>, sequence string, qualities array<int>"
    reads = [("c", 10, 30, [(0, 4)], "ACGT", [40] * 4), ("c", 8, 30, [(4, 1), (0, 2), (1, 1), (0, 2)], "GTTGCC", [40] * 6), ("c", 10, 10, [(0, 4)], "TTTT", [40] * 4), ("c", 11, 30, [(0, 1)], "c", [12]), (None, -1, 30, [(0, 1)], "A", [40])]
    sites = spark.createDataFrame([("c", 12, "C", "T"), ("c", 11, "A", "C"), ("c", 99, "A", "C"), ("c", 11, "AT", "C")], "contig string, pos long, ref string, alt string")
    out = {(r.pos): (r.depth, r.alt_depth, r.genotype) for r in identity.pileup(spark.createDataFrame(reads, schema), sites, 1).collect()}
    assert out == {12: (2, 0, "0/0"), 11: (2, 1, "0/1")}


def test_matrix(spark):
    rows = [(n, str(h)) for n, low, high in (("a", 0, 50), ("b", 0, 50), ("c", 100, 150), ("d", 0, 40)) for h in range(low, high)]
    pairs = matrix.similarities(spark.createDataFrame(rows, "name string, h string"))
    value = {(r.a, r.b): r.similarity for r in pairs.collect()}
    assert value["a", "b"] == 1 and value["a", "c"] == 0 and value["a", "d"] == 0.8
    assert [r.name for r in matrix.outliers(pairs).collect()] == ["c"]
    order = matrix.order(["a", "b", "c", "d"], value)
    assert sorted(order) == ["a", "b", "c", "d"] and abs(order.index("a") - order.index("b")) == 1 and order.index("c") in (0, 3)


def test_manifest(spark, tmp_path):
    good = tmp_path / "m.tsv"
    good.write_text("sample\tstage\tbefore\tafter\n# a comment\ns\tt\ta.vcf\tb.vcf\n")
    assert manifest.read(spark, str(good)).count() == 1
    for bad in ("sample\tstage\tbefore\ns\tt\ta\n", "sample\tstage\tbefore\tafter\nx\ty\ta\tb\nx\ty\tc\td\n", "sample\tstage\tbefore\tafter\tnope\nx\ty\ta\tb\tc\n", "sample\tstage\tbefore\tafter\nx\t\ta\tb\n"):
        (tmp_path / "bad.tsv").write_text(bad)
        with pytest.raises(ValueError):
            manifest.read(spark, str(tmp_path / "bad.tsv"))


def test_a_stream_adds_up(spark, tmp_path):
    df = spark.range(1000).select("id", (F.col("id") % 7).cast("string").alias("v"))
    source = str(tmp_path / "in")
    df.repartition(4).write.parquet(source)
    rows = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(source)
    stream.append(rows, ["id", "v"], str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    parts = spark.read.parquet(str(tmp_path / "out"))
    assert parts.select("batch").distinct().count() == 4
    whole = fingerprint.fingerprints(df, ["id", "v"])
    assert sorted(map(tuple, stream.total(parts.drop("batch")).select(whole.columns).collect())) == sorted(map(tuple, whole.collect()))

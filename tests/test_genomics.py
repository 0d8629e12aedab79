import gzip
import json
import struct

import pytest
from pyspark.sql import functions as F
from test_sources import block, write

from rowparity import genomics
from rowparity.cli import main
from rowparity.compare import Comparison
from rowparity.inputs import pair
from rowparity.operators import normalize
from rowparity.report import findings, shift_text, svg, transition_matrix
from rowparity.sources import bam, bcf, vcf

HEAD = (
    "##fileformat=VCFv4.3\n##FILTER=<ID=PASS,Description=\"ok\">\n##FILTER=<ID=q10,Description=\"low\">\n##contig=<ID=chr1,length=1000>\n"
    "##INFO=<ID=DP,Number=1,Type=Integer,Description=\"x\">\n##INFO=<ID=AF,Number=A,Type=Float,Description=\"x\">\n##INFO=<ID=DB,Number=0,Type=Flag,Description=\"x\">\n"
    "##FORMAT=<ID=GT,Number=1,Type=String,Description=\"x\">\n##FORMAT=<ID=AD,Number=R,Type=Integer,Description=\"x\">\n#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\ts1\ts2\n"
)
LINES = [
    "chr1\t11\trs1\tA\tC,G\t60\tPASS\tDP=20;AF=0.5,0.25;DB\tGT:AD\t1/2:3,4,5\t0|1:7,8,9",
    "chr1\t31\t.\tAT\tA\t.\tq10\tDP=300\tGT:AD\t./.:.\t1|1:0,9",
    "chr1\t51\t.\tG\t.\t7.5\t.\t.\tGT:AD\t0/0:1\t0/0:2",
]


def one(value):
    """A typed BCF value."""
    if isinstance(value, str):
        return bytes([min(len(value), 15) << 4 | 7]) + (bytes([0x11, len(value)]) if len(value) >= 15 else b"") + value.encode()
    if isinstance(value[0], float):
        return bytes([len(value) << 4 | 5]) + struct.pack(f"<{len(value)}f", *value)
    code, kind = ("b", 1) if all(-120 < v < 128 for v in value) else ("h", 2)
    return bytes([len(value) << 4 | kind]) + struct.pack(f"<{len(value)}{code}", *value)


def as_bcf(path):
    """LINES by hand: the dictionary is PASS, q10, DP, AF, DB, GT, AD."""

    def record(pos, size, qual, name, alleles, filters, info, formats):
        shared = struct.pack("<iii", 0, pos, size) + qual + struct.pack("<HHI", len(info), len(alleles), len(formats) << 24 | 2)
        shared += (one(name) if name else b"\x07") + b"".join(map(one, alleles)) + (one(filters) if filters else b"\x00") + b"".join(one([k]) + v for k, v in info)
        each = b"".join(one([k]) + bytes([n << 4 | 1]) + values for k, n, values in formats)
        return struct.pack("<II", len(shared), len(each)) + shared + each

    gt = lambda *v: bytes(v)
    rows = [
        record(10, 1, struct.pack("<f", 60), "rs1", ["A", "C", "G"], [0], [(2, one([20])), (3, one([0.5, 0.25])), (4, b"\x00")], [(5, 2, gt(4, 6, 2, 5)), (6, 3, bytes([3, 4, 5, 7, 8, 9]))]),
        record(30, 2, struct.pack("<I", 0x7F800001), None, ["AT", "A"], [1], [(2, one([300]))], [(5, 2, gt(0, 0, 4, 5)), (6, 2, struct.pack("<bbbb", -128, -127, 0, 9))]),
        record(50, 1, struct.pack("<f", 7.5), None, ["G"], [], [], [(5, 2, gt(2, 2, 2, 2)), (6, 1, bytes([1, 2]))]),
    ]
    text = HEAD.encode() + b"\0"
    data = b"BCF\2\2" + struct.pack("<I", len(text)) + text + b"".join(rows)
    path.write_bytes(b"".join(gzip.compress(data[k : k + 37]) for k in range(0, len(data), 37)) + gzip.compress(b""))
    return str(path)


@pytest.fixture
def files(tmp_path):
    (tmp_path / "a.vcf").write_text(HEAD + "\n".join(LINES) + "\n")
    return str(tmp_path / "a.vcf"), as_bcf(tmp_path / "b.bcf")


def test_bcf_equals_vcf(spark, files):
    text, packed = files
    assert pair(spark, text, packed).compare().equivalent
    first = {r.pos: r for r in bcf.read(spark, packed).collect()}
    assert first[11].samples["s1"]["values"] == {"GT": "1/2", "AD": "3,4,5"} and first[11].samples["s2"].phased and first[31].quality is None
    assert first[31].samples["s1"]["values"]["AD"] == "." and first[51].alleles == ["G"] and first[11].info["DB"] == "true"
    assert genomics.structure(spark, text) == genomics.structure(spark, packed)


WIDE = (
    "##fileformat=VCFv4.3\n##contig=<ID=chr2,length=9>\n##contig=<ID=chr1,length=99>\n##FILTER=<ID=low,Description=\"x\">\n"
    + "".join(f"##INFO=<ID={n},Number=.,Type={t},Description=\"x\">\n" for n, t in (("I", "Integer"), ("F", "Float"), ("S", "String"), ("B", "Flag"), ("END", "Integer")))
    + "".join(f"##FORMAT=<ID={n},Number=.,Type={t},Description=\"x\">\n" for n, t in (("GT", "String"), ("N", "Integer"), ("P", "Float"), ("T", "String")))
    + "#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\ts1\ts2\n"
)
WIDE_LINES = [
    "chr1\t3\tx;y\tA\t" + "C" * 40 + "\t0.25\tPASS\tI=127,-120,128;S=" + "w" * 300 + "\tGT:N:P:T\t0|1|2:40000,.,-40000:0.5,.:long text\t.:.:.:.",
    "chr1\t9\t.\tA\t<DEL>\t.\tlow\tB;END=70;F=.;I=" + ",".join(map(str, range(20))) + "\tGT:T\t1/.:\u00e9\t100|101:.",
    "chr2\t1\t.\tA\tC\t.\t.\t.\tGT\t0\t1",
]


def test_bcf_written_and_read(spark, files, tmp_path):
    given, out = bcf.read(spark, files[1]), str(tmp_path / "out.bcf")
    bcf.write(given, out, bcf.header(files[1]))
    assert sorted(bcf.read(spark, out).collect(), key=lambda r: r.pos) == sorted(given.collect(), key=lambda r: r.pos)
    with pytest.raises(Exception, match="exists"):
        bcf.write(given, out, bcf.header(files[1]))
    (tmp_path / "wide.vcf").write_text(WIDE + "\n".join(WIDE_LINES) + "\n")
    wide = vcf.read(spark, str(tmp_path / "wide.vcf"))
    bcf.write(wide, out, WIDE, force=True)
    assert pair(spark, str(tmp_path / "wide.vcf"), out).compare().equivalent
    rows = bcf.read(spark, out).collect()
    assert [(r.contig, r.pos, r.stop) for r in rows] == [("chr2", 1, 1), ("chr1", 3, 3), ("chr1", 9, 70)]
    assert rows[1].samples["s1"]["values"]["N"] == "40000,.,-40000" and rows[2].samples["s2"]["values"]["GT"] == "100|101"
    for bad, why in (("chr3", "define chr3"), ("chr1", "32-bit")):
        row = wide.where("pos = 3").withColumn("contig", F.lit(bad)).withColumn("info", F.expr("map('I', '3000000000')"))
        with pytest.raises(Exception, match=why):
            bcf.write(row, str(tmp_path / "bad.bcf"), WIDE)
    bcf.write(wide.limit(0), str(tmp_path / "none.bcf"), WIDE)
    assert bcf.read(spark, str(tmp_path / "none.bcf")).count() == 0
    assert main(["compare", files[1], str(tmp_path / "none.bcf"), "--write-diff", str(tmp_path / "diff")], spark) == 1
    assert [r.pos for r in bcf.read(spark, str(tmp_path / "diff" / "only-in-first.bcf")).collect()] == [11, 31, 51]


def test_bcf_cut_off(spark, files, tmp_path):
    (tmp_path / "c.bcf").write_bytes(gzip.compress(gzip.decompress(open(files[1], "rb").read())[:-3]))
    with pytest.raises(Exception, match="cut off"):
        bcf.read(spark, str(tmp_path / "c.bcf")).collect()


def test_written_vcf_reads_back(spark, files, tmp_path):
    records = vcf.read(spark, files[0])
    (tmp_path / "w.vcf").write_text(HEAD + "".join(r.value + "\n" for r in vcf.lines(records, ["s1", "s2"]).collect()))
    assert pair(spark, files[0], str(tmp_path / "w.vcf")).compare().equivalent


def test_written_bam_reads_back(spark, tmp_path):
    tags = b"NMC\x07" + b"RGZlane-a\0" + b"XAAq" + b"XBBs" + struct.pack("<ihh", 2, -1, 5) + b"XFf" + struct.pack("<f", 1.5)
    path = write(tmp_path / "a.bam", [block("r0", 20, tags=tags), block("r1", 0, pos=-1, flags=4, ref=-1), block("*", 1)])
    rows, head = bam.read(spark, path), bam.read_alignment_header(path)
    bam.write(rows.repartition(3), str(tmp_path / "b.bam"), *head)
    assert pair(spark, path, str(tmp_path / "b.bam")).compare().equivalent
    with pytest.raises(Exception, match="exists"):
        bam.write(rows, str(tmp_path / "b.bam"), *head)
    bam.write(rows.where("false"), str(tmp_path / "b.bam"), *head, force=True)
    assert bam.read(spark, str(tmp_path / "b.bam")).count() == 0 and len(list(tmp_path.iterdir())) == 2


def test_labels(spark, tmp_path, files):
    changed = [
        "chr1\t11\trs2\tA\tC,G\t50\tq10\tDP=21;XX=1\tGT:AD\t1/1:3,4,5\t0|1:7,8,9",
        "chr1\t31\t.\tAT\tA\t.\tq10\tDP=300\tGT:AD\t./.:.\t1|1:0,8",
        "chr1\t51\t.\tG\t.\t7.5\t.\t.\tGT:AD\t0/0:1\t0/0:2",
    ]
    (tmp_path / "c.vcf").write_text(HEAD.replace("chr1,length=1000", "chr1,length=900") + "\n".join(changed) + "\n")
    out = pair(spark, files[0], str(tmp_path / "c.vcf")).compare()
    assert out.transitions == {x: 1 for x in ("identifiers changed", "QUAL: 60.0 → 50.0", "filters: PASS → q10", "INFO added: XX", "INFO removed: AF", "INFO removed: DB", "INFO value changed: DP", "genotype s1: 1/2 → 1/1", "sample FORMAT values changed")}
    assert out.structure[0].startswith("Reference compatibility") and "Contig lengths differ: chr1" in out.structure
    one_, two = write(tmp_path / "a.bam", [block("r", 20, tags=b"NMC\x07XAAq")]), write(tmp_path / "b.bam", [block("r", 30, pos=11, flags=0x410, tags=b"NMC\x08XBAq")])
    found = pair(spark, one_, two).compare()
    assert set(found.transitions) == {"MAPQ: 20 → 30", "position changed", "duplicate flag: clear → set", "strand: forward → reverse", "tag added: XB", "tag removed: XA", "tag value changed: NM"}
    ignoring = pair(spark, one_, two, profile="strict", options=genomics.Options(ignore_tags=("NM", "XA", "XB"))).compare()
    assert "tags" not in ignoring.changed_fields
    assert pair(spark, one_, two, profile="mapping").fields == list(genomics.ALIGNMENT[:-3])
    with pytest.raises(ValueError, match="profiles"):
        genomics.fields_for("variant", "core")


def test_mates_are_apart(spark, tmp_path):
    a = write(tmp_path / "a.bam", [block("r", 20, flags=0x41), block("r", 30, flags=0x81)])
    b = write(tmp_path / "b.bam", [block("r", 30, flags=0x81), block("r", 21, flags=0x41)])
    out = pair(spark, a, b).compare()
    assert (out.identical, out.modified, out.transitions) == (1, 1, {"MAPQ: 20 → 21": 1})


def test_regions(spark, files, tmp_path, capsys):
    (tmp_path / "c.vcf").write_text(HEAD + "\n".join([LINES[0], LINES[1].replace("300", "301"), LINES[2]]) + "\n")
    (tmp_path / "r.bed").write_text("chr1\t30\t40\n")
    both = ["compare", files[0], str(tmp_path / "c.vcf")]
    assert main(both, spark) == 1
    assert main([*both, "--region", "chr1:11-20"], spark) == 0
    assert main([*both, "--regions", str(tmp_path / "r.bed")], spark) == 1 and "records 1 and 1" in capsys.readouterr().out.splitlines()[-2]
    assert main([*both, "--exclude-regions", str(tmp_path / "r.bed")], spark) == 0
    assert main([*both, "--ignore-info", "DP"], spark) == 0
    assert main([*both, "--profile", "genotypes"], spark) == 0
    assert main([*both, "--profile", "mapping"], spark) == 2


def test_splitting_and_normalising(spark, files, tmp_path):
    (tmp_path / "r.fa").write_text(">chr1\n" + "C" * 10 + "A" + "C" * 17 + "GATTTT" + "C" * 16 + "G" + "C" * 40 + "\n")
    numbers = genomics.vcf_numbers(genomics.structure(spark, files[0]))
    assert numbers["info", "AF"] == "A" and numbers["format", "AD"] == "R"
    records = vcf.read(spark, files[0])
    out = genomics.normalized(records, normalize.read_fasta(spark, str(tmp_path / "r.fa")), numbers).orderBy("pos", "alleles").collect()
    assert [(r.pos, r.alleles, r.stop) for r in out] == [(11, ["A", "C"], 11), (11, ["A", "G"], 11), (30, ["AT", "A"], 31), (51, ["G"], 51)] or out[2].pos == 31
    assert [r.samples["s1"]["values"] for r in out[:2]] == [{"GT": "1/0", "AD": "3,4"}, {"GT": "0/1", "AD": "3,5"}]
    assert [r.info["AF"] for r in out[:2]] == ["0.5", "0.25"] and out[0].samples["s2"].phased
    assert main(["compare", files[0], files[0], "--normalize"], spark) == 2
    assert main(["compare", *files, "--normalize", "--reference", str(tmp_path / "r.fa")], spark) == 0


def test_outputs(spark, files, tmp_path, capsys):
    (tmp_path / "c.vcf").write_text(HEAD + "\n".join([LINES[0].replace("1/2", "2/2"), LINES[2], LINES[2].replace("51", "61")]) + "\n")
    args = ["compare", files[0], str(tmp_path / "c.vcf")]
    for name in ("html", "svg", "igv-batch", "difference-table", "reproducibility", "write-diff", "tracks"):
        args += [f"--{name}", str(tmp_path / name)]
    assert main(args, spark) == 1
    names = {"only-in-first": [31], "only-in-second": [61], "modified-first": [11], "modified-second": [11]}
    for name, places in names.items():
        assert [r.pos for r in vcf.read(spark, str(tmp_path / "write-diff" / f"{name}.vcf")).collect()] == places
    assert (tmp_path / "tracks/changes.bed").read_text() == "chr1\t10\t11\tmodified;x1\nchr1\t30\t31\tonly_in_first;x1\nchr1\t60\t61\tonly_in_second;x1\n"
    assert "goto chr1:" in (tmp_path / "igv-batch").read_text() and "genotype s1: 1/2 → 2/2" in (tmp_path / "svg").read_text()
    assert len(json.loads((tmp_path / "reproducibility").read_text())["inputs"][0]["sha256"]) == 64
    assert spark.read.option("sep", "\t").option("header", True).csv(str(tmp_path / "difference-table")).count() == 3
    assert main(args, spark) == 2 and "exists" in capsys.readouterr().err
    assert main(["compare", files[0], str(tmp_path / "c.vcf"), "--profile", "calls", "--write-diff", str(tmp_path / "other")], spark) == 2


def test_written_alignments(spark, tmp_path):
    a = write(tmp_path / "a.bam", [block("r0", 20), block("r1", 30), block("r2", 40)])
    b = write(tmp_path / "b.bam", [block("r0", 20), block("r1", 31), block("r3", 40)])
    assert main(["compare", a, b, "--write-diff", str(tmp_path / "d"), "--tracks", str(tmp_path / "t")], spark) == 1
    assert {n: [r.read_name for r in bam.read(spark, str(tmp_path / "d" / f"{n}.bam")).collect()] for n in ("only-in-first", "only-in-second", "modified-first")} == {"only-in-first": ["r2"], "only-in-second": ["r3"], "modified-first": ["r1"]}
    assert bam.references(str(tmp_path / "d/only-in-first.bam")) == [("chr1", 1000)]


def test_batch_and_matrix_options(spark, files, tmp_path, capsys):
    (tmp_path / "c.vcf").write_text(HEAD + "\n".join([LINES[0].replace("1/2", "2/2"), *LINES[1:]]) + "\n")
    (tmp_path / "m.tsv").write_text(f"sample\tstage\tbefore\tafter\tprofile\nS\tone\t{files[0]}\t{files[1]}\t\nS\ttwo\t{files[0]}\tc.vcf\tcalls\n")
    assert main(["batch", str(tmp_path / "m.tsv"), "--max-modified", "1"], spark) == 0
    assert main(["batch", str(tmp_path / "m.tsv"), "--max-modified", "1", "--fail-transition", "genotype*", "--tracks", str(tmp_path / "t")], spark) == 1
    assert "forbidden transition" in capsys.readouterr().out and {p.name for p in (tmp_path / "t").iterdir()} == {"s-one", "s-two"}
    assert main(["matrix", *files, "--json", str(tmp_path / "x.json"), "--html", str(tmp_path / "x.html")], spark) == 0
    assert json.loads((tmp_path / "x.json").read_text())["similarity"] == [[1.0, 1.0], [1.0, 1.0]]
    assert main(["baseline-create", str(tmp_path / "m.tsv"), str(tmp_path / "base"), "--profile", "genotypes"], spark) == 0
    assert main(["baseline-check", str(tmp_path / "m.tsv"), str(tmp_path / "base"), "--profile", "genotypes", "--json", str(tmp_path / "b.json")], spark) == 1
    assert [r["passed"] for r in json.loads((tmp_path / "b.json").read_text())] == [True, False]


def test_identity_of_alignments(spark, tmp_path):
    sites = "".join(f"chr1\t{p}\t.\t{r}\tT\t.\t.\t.\n" for p, r in ((11, "A"), (12, "C")))
    (tmp_path / "s.vcf").write_text("##fileformat=VCFv4.3\n#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\n" + sites)
    a = write(tmp_path / "a.bam", [block(f"r{k}", 60) for k in range(6)])
    b = write(tmp_path / "b.bam", [block(f"q{k}", 60) for k in range(7)])
    assert main(["identity", a, b], spark) == 2
    assert main(["identity", a, b, "--sites", str(tmp_path / "s.vcf"), "--json", str(tmp_path / "i.json")], spark) == 1
    assert [(r["shared"], r["matches"], r["status"]) for r in json.loads((tmp_path / "i.json").read_text())] == [(2, 2, "insufficient calls")]


def test_shifts(spark, tmp_path, files):
    (tmp_path / "c.vcf").write_text(HEAD + "\n".join([LINES[0].replace("1/2", "1/1").replace("0|1", "1|1").replace("DP=20", "DP=45"), *LINES[1:]]) + "\n")
    out = pair(spark, files[0], str(tmp_path / "c.vcf")).compare()
    assert [(x["metric"], round(x["distance"], 6), x["first"], x["second"]) for x in out.shifts] == [("depth", 0.5, 160.0, 170.0), ("heterozygous_rate", 0.4, 0.4, 0.0)]
    assert findings(out)[1] == "Depth moved from a median of 160 to 170." and shift_text(out.shifts[1]) == "Heterozygous rate fell from 40.0% to 0.0%."
    records = vcf.read(spark, files[0])
    found = {(r.metric, r.bucket): r.n for r in genomics.histograms(records, "variant", list(genomics.VARIANT)).collect()}
    assert found == {("variant_quality", 60): 1, ("variant_quality", 0): 1, ("depth", 20): 1, ("depth", 300): 1, ("allele_frequency", 0.5): 1, ("allele_frequency", 0.25): 1, ("heterozygous_rate", 1): 2, ("heterozygous_rate", 0): 3, ("filtered_rate", 0): 2, ("filtered_rate", 1): 1}
    one_, two = write(tmp_path / "a.bam", [block("r", 22), block("s", 22)]), write(tmp_path / "b.bam", [block("r", 61, flags=4), block("s", 22)])
    assert [(x["metric"], x["distance"], x["second"]) for x in pair(spark, one_, two).compare().shifts] == [("mapping_quality", 0.5, 40.0), ("unmapped_rate", 0.5, 0.5)]
    assert genomics.histograms(records, "variant", ["locus"]).count() == 0


def test_figures():
    result = Comparison("a", "b", 3, 3, False, True, ["samples"], 1.0, 0.5, "related datasets", 1, 2, 0, 0, {"samples": 2}, {"genotype s<1: 0/1 → 1/1": 2, "genotype t: 1/1 → 0/0": 1})
    assert "genotype s&lt;1" in svg(result)
    states, cells = transition_matrix(result)
    assert states == ["1/1", "0/1", "0/0"] and cells == [[0, 0, 1], [2, 0, 0], [0, 0, 0]]
    assert "No changes" in svg(Comparison("a", "b", 0, 0, True, True, [], 1.0, 1.0, "empty datasets"))


def test_attribution(spark, files, tmp_path):
    (tmp_path / "c.vcf").write_text(HEAD + "\n".join([LINES[0].replace("1/2", "2/2"), LINES[1].replace("1|1", "1/1")]) + "\n")
    assert pair(spark, files[0], str(tmp_path / "c.vcf")).compare().attribution == {"s1": 1, "s2": 1}
    group = lambda name: {"RG": ("Z", name)} if name else {"NM": ("i", "1")}
    rows = [("modified", group("a"), group("b")), ("modified", group("a"), group(None)), ("left_only", group("a"), None), ("right_only", None, group(None))]
    kind = "map<string,struct<type:string,value:string>>"
    found = spark.createDataFrame(rows, f"status string, tags_before {kind}, tags_after {kind}")
    assert genomics.attribution(found, "alignment") == {"a": 2, "b": 1} and genomics.attribution(found.drop("tags_before"), "alignment") == {}


def test_info_texts(spark, tmp_path):
    """A value is all that follows the first "="; of a repeated key the last value counts."""
    (tmp_path / "d.vcf").write_text(HEAD + "chr1\t5\t.\tA\tC\t.\t.\tAN=x=1;DB;E=;AN2=3;AN=y=2;.\tGT\t0/0\t0/1\n")
    assert vcf.read(spark, str(tmp_path / "d.vcf")).first().info == {"AN": "y=2", "DB": "true", "E": "", "AN2": "3"}

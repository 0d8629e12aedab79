import gzip
import random
import struct
import zlib

import pytest
from pyspark.sql import functions as F

from rowparity.compare import compare, labels
from rowparity.functions import buckets
from rowparity.operators import match, normalize
from rowparity.sources import bam

FIELDS = ["read_name", "flags", "reference", "position", "mapping_quality", "cigar", "sequence", "qualities", "tags"]


def block(name, mapq, pos=10, flags=0, tags=b"", ref=0, bases=b"\x12\x48"):
    body = struct.pack("<iiBBHHHiiii", ref, pos, len(name) + 1, mapq, 0, 1, flags, 4, -1, -1, 0)
    body += name.encode() + b"\0" + struct.pack("<I", 4 << 4) + bases + bytes([40] * 4) + tags
    return struct.pack("<i", len(body)) + body


def write(path, records, text=b"@SQ\tSN:chr1\tLN:1000\n"):
    data = b"BAM\1" + struct.pack("<i", len(text)) + text + struct.pack("<i", 1) + struct.pack("<i", 5) + b"chr1\0" + struct.pack("<i", 1000) + b"".join(records)
    size = random.Random(len(data)).randint(5, 60)
    path.write_bytes(b"".join(gzip.compress(data[k : k + size]) for k in range(0, len(data), size)) + gzip.compress(b""))
    return str(path)


def test_bam_records(spark, tmp_path):
    tags = b"NMC\x07" + b"RGZlane-a\0" + b"XAAq" + b"XBBs" + struct.pack("<ihh", 2, -1, 5) + b"XFf" + struct.pack("<f", 1.5)
    path = write(tmp_path / "a.bam", [block("r0", 20, tags=tags), block("r1", 0, pos=-1, flags=4, ref=-1), block("*", 1)])
    rows = bam.read(spark, path).collect()
    assert len(rows) == 3 and bam.references(path) == [("chr1", 1000)]
    a = rows[0]
    assert (a.read_name, a.reference, a.position, a.mapping_quality, a.sequence, a.qualities, a.cigar[0].len) == ("r0", "chr1", 10, 20, "ACGT", [40] * 4, 4)
    assert {k: (v.type, v.value) for k, v in a.tags.items()} == {"NM": ("i", "7"), "RG": ("Z", "lane-a"), "XA": ("A", "q"), "XB": ("B", "s,-1,5"), "XF": ("f", "1.5")}
    assert rows[1].reference is None and rows[1].position == -1 and rows[2].read_name is None
    assert bam.read(spark, path, path).count() == 6
    (tmp_path / "b.bam").write_bytes(gzip.compress(gzip.decompress((tmp_path / "a.bam").read_bytes())[:-3]))
    with pytest.raises(Exception, match="cut off"):
        bam.read(spark, str(tmp_path / "b.bam")).collect()


def index(path, parts, shift=0):
    """A BAI index beside ``path`` with a chunk for each record, and figures that aren't places."""
    data, packed = gzip.decompress(open(path, "rb").read()), open(path, "rb").read()
    members, at = [], 0  # (place in the file, place in the data)
    while at < len(packed):
        inflate = zlib.decompressobj(31)
        members.append((at, members[-1][2] if members else 0, (members[-1][2] if members else 0) + len(inflate.decompress(packed[at:]))))
        at = len(packed) - len(inflate.unused_data)
    begin, places = len(data) - sum(map(len, parts)), []
    for p in parts:
        member = next(m for m in members if m[1] <= begin < m[2])
        places.append(member[0] << 16 | begin - member[1])
        begin += len(p)
    places[-1] += shift
    chunks = b"".join(struct.pack("<QQ", x, x + 1) for x in places)
    figures = struct.pack("<IiQQQQ", 37450, 2, places[0], places[-1], 7, 1)
    head = b"BAI\1" + struct.pack("<ii", 1, 2) + struct.pack("<Ii", 4681, len(places))
    with open(f"{path}.bai", "wb") as out:
        out.write(head + chunks + figures + struct.pack("<iQ", 1, places[0]) + struct.pack("<Q", 0))


def test_indexed_bam_is_read_by_several_tasks(spark, tmp_path):
    parts = [block(f"r{k}", k % 60, pos=k) for k in range(200)]
    path = write(tmp_path / "a.bam", parts)
    whole = bam.read(spark, path)
    assert whole.rdd.getNumPartitions() == 1
    expected = [r.read_name for r in whole.collect()]
    index(path, parts)
    for split in (1, 700, 5000, 1 << 30):
        cut = bam.read(spark, path, path, split=split)
        assert cut.rdd.getNumPartitions() == 2 * (1 + len(bam.cuts(path, split)))
        assert [r.read_name for r in cut.collect()] == 2 * expected == 2 * [f"r{k}" for k in range(200)]
    assert len(bam.cuts(path, 700)) > 3 and bam.cuts(path, 1 << 30) == []
    index(path, parts, shift=1)
    with pytest.raises(Exception, match="index"):
        bam.read(spark, path, split=1).collect()


def test_compared_alignments(spark, tmp_path):
    one = bam.read(spark, write(tmp_path / "a.bam", [block("r0", 20), block("r1", 30)]))
    two = bam.read(spark, write(tmp_path / "b.bam", [block("r1", 40), block("r0", 20)]))
    mapq = F.when(match.changed("mapping_quality"), buckets.transition("MAPQ", F.col("mapping_quality_before"), F.col("mapping_quality_after")))
    out = compare(one, two, ["read_name"], FIELDS, explain=True, transitions=[mapq])
    assert (out.identical, out.modified, out.overlap, out.changed_fields, out.transitions, out.field_changes) == (1, 1, 1.0, ["mapping_quality"], {"MAPQ: 30 → 40": 1}, {"mapping_quality": 1})
    assert not out.equivalent and out.relation == "likely the same dataset" and '"only_in_first": 0' in out.to_json()
    same = compare(one, bam.read(spark, write(tmp_path / "c.bam", [block("r1", 30), block("r0", 20)], b"@CO\tother\n")), ["read_name"], FIELDS, explain=True)
    assert same.equivalent and same.identical == 2 and same.relation == "identical logical records"


def test_empty_tables_and_structure(spark):
    a = spark.createDataFrame([], "k int, v string")
    out = compare(a, a, ["k"], explain=True)
    assert out.equivalent and out.relation == "empty datasets" and out.overlap == 1
    out = compare(a, spark.createDataFrame([(1, "x", 2)], "k int, v string, w int"), ["k"])
    assert out.structure == ["Columns added: w"] and out.overlap == 0 and out.relation == "different datasets"


def test_labels():
    assert labels("x/a.sorted.bam", "x/b.vcf.gz") == ("a", "b")
    assert labels("old/a.bam", "new/a.dedup.bam") == ("old/a", "new/a")
    assert labels("x/a.bam", "x/a.bam") == ("a (A)", "a (B)")


def test_normalisation_is_leftmost_and_keeps_the_haplotype(spark, tmp_path):
    r = random.Random(4)
    sequence = "".join(r.choice("ACGT") for _ in range(20)) + "A" * 35 + "CACACACACACA" + "".join(r.choice("AC") for _ in range(40))
    (tmp_path / "r.fa").write_text(">chr1 one\n" + "\n".join(sequence[k : k + 17] for k in range(0, len(sequence), 17)) + "\n>chr2\nAAAA\n")
    reference = normalize.read_fasta(spark, str(tmp_path / "r.fa"), 10)
    assert reference.where("contig = 'chr1'").count() == -(-len(sequence) // 10)
    rows = [(0, "chr1", 5, "<DEL>", "A"), (1, "chrX", 5, "CA", "A")]
    for i in range(2, 120):
        pos = r.randint(1, len(sequence) - 8)
        n = r.randint(1, 6)
        ref = sequence[pos - 1 : pos - 1 + n]
        alt = r.choice([ref[0], ref + sequence[pos - 1 + n], ref[:-1] + "G", ref + ref])
        if alt != ref:
            rows.append((i, "chr1", pos, ref, alt))
    out = normalize.left_normalized(spark.createDataFrame(rows, "id int, contig string, pos long, ref string, alt string"), reference, 10)
    found = {x.id: x for x in out.collect()}
    assert len(found) == len(rows)
    assert (found[0].pos, found[0].ref) == (5, "<DEL>") and found[1].pos == 5
    for i, _, pos, ref, alt in rows[2:]:
        x = found[i]
        change = lambda p, a, b: sequence[: p - 1] + b + sequence[p - 1 + len(a) :]
        assert change(pos, ref, alt) == change(x.pos, x.ref, x.alt) and sequence[x.pos - 1 :].startswith(x.ref)
        assert x.ref[-1] != x.alt[-1] or x.pos == 1
        assert len(x.ref) == 1 or len(x.alt) == 1 or x.ref[0] != x.alt[0]

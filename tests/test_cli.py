import json

import pytest

from rowparity import artifacts
from rowparity.cli import main

HEAD = "##fileformat=VCFv4.3\n##contig=<ID=chr1,length=1000>\n#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\tsample\n"


def vcf(path, *genotypes):
    path.write_text(HEAD + "".join(f"chr1\t{10 * (k + 1)}\t.\tA\tC\t60\tPASS\tDP=20\tGT\t{g}\n" for k, g in enumerate(genotypes)))
    return str(path)


@pytest.fixture
def tree(tmp_path):
    for name, calls in (("a", ("0/1", "0/1")), ("b", ("0/1", "0/1")), ("c", ("0/1", "1/1"))):
        vcf(tmp_path / f"{name}.vcf", *calls)
    (tmp_path / "m.tsv").write_text("sample\tstage\tbefore\tafter\nS\tfirst\ta.vcf\tb.vcf\nS\tsecond\ta.vcf\tc.vcf\n")
    return tmp_path


def test_compare(spark, tree, capsys):
    a, b, c = (str(tree / f"{n}.vcf") for n in "abc")
    assert main(["compare", a, b], spark) == 0
    assert "a and b: equivalent" in capsys.readouterr().out
    assert main(["compare", a, c, "--explain", "--json", str(tree / "o.json"), "--html", str(tree / "o.html")], spark) == 1
    assert "identical 1, modified 1" in capsys.readouterr().out
    found = json.loads((tree / "o.json").read_text())
    assert found["changed_fields"] == ["samples"] and found["only_in_first"] == 0 and "samples changed" in (tree / "o.html").read_text()
    assert main(["compare", a, c, "--json", str(tree / "o.json")], spark) == 2
    assert main(["compare", a, str(tree / "none.vcf")], spark) == 2


def test_examples_and_cache(spark, tree, capsys):
    a, c = (str(tree / f"{n}.vcf") for n in "ac")
    out, kept = tree / "o.json", tree / "kept"
    args = ["compare", a, c, "--json", str(out), "--html", str(tree / "o.html"), "--cache", str(kept), "--force"]
    assert main(args, spark) == 1
    found = json.loads(out.read_text())["examples"]
    assert [(x["status"], x["key"]["pos"], "0/1" in str(x["before"]), "1/1" in str(x["after"])) for x in found] == [("modified", 20, True, True)]
    assert "1/1" in (tree / "o.html").read_text()
    entries = sorted(kept.glob("*/*"))
    assert len(entries) == 2 and main(args, spark) == 1 and sorted(kept.glob("*/*")) == entries
    assert main([*args, "--max-examples", "0"], spark) == 1 and json.loads(out.read_text())["examples"] == []
    for part in kept.glob("*/*/*.parquet"):  # unreadable entries are misses
        part.write_bytes(b"no")
    for check in kept.glob("*/*/.*.crc"):
        check.unlink()
    assert main(args, spark) == 1 and len(list(kept.glob("*/*"))) == 4
    vcf(tree / "c.vcf", "0/1", "0/1", "0/1")  # another size
    assert main(args, spark) == 1 and len(list(kept.glob("*/*"))) == 5
    assert [x["status"] for x in json.loads(out.read_text())["examples"]] == ["right_only"]


def test_batch(spark, tree, capsys):
    out = str(tree / "out")
    assert main(["batch", str(tree / "m.tsv"), "--output", out], spark) == 1
    text = capsys.readouterr().out
    assert "1 of 2 comparisons" in text and "modified records 1 exceed 0" in text and "S: first differs at second" in text
    assert 'tests="2" failures="1"' in (tree / "out/junit.xml").read_text()
    assert set(json.loads((tree / "out/manifest.json").read_text())["files"]) == {"batch.html", "batch.json", "junit.xml", "multiqc.json"}
    (tree / "p.json").write_text(json.dumps({"version": 1, "defaults": {"transition_default": "allow"}, "rules": [{"name": "r", "match": {"stage": "sec*"}, "set": {"deny_fields": ["samples"], "severity": "warning"}}]}))
    assert main(["batch", str(tree / "m.tsv"), "--policy", str(tree / "p.json"), "--output", out], spark) == 2
    assert main(["batch", str(tree / "m.tsv"), "--policy", str(tree / "p.json"), "--output", out, "--force"], spark) == 0
    assert "forbidden changed fields: samples" in capsys.readouterr().out


def test_baseline_and_matrix(spark, tree, capsys):
    fields = ["--fields", "contig,pos,alleles,samples"]
    assert main(["baseline-create", str(tree / "m.tsv"), str(tree / "base"), *fields], spark) == 0
    assert main(["baseline-check", str(tree / "m.tsv"), str(tree / "base"), *fields], spark) == 1
    assert capsys.readouterr().out == "ok   S / first\nFAIL S / second: samples\n"
    part = next((tree / "base").glob("*.json"))
    lines = [x for p in sorted((tree / "base").glob("*.json")) for x in p.read_text().splitlines()]
    for text, fault in ((lines[0] + "\n{", "missing values"), ("\n".join([*lines, lines[0]]), "repeated fields"), ("", "is empty")):
        for p in [*(tree / "base").glob("*.json"), *(tree / "base").glob(".*.crc")]:
            p.unlink()
        part.write_text(text)
        assert main(["baseline-check", str(tree / "m.tsv"), str(tree / "base"), *fields], spark) == 2
        assert fault in capsys.readouterr().err
    assert main(["matrix", *(str(tree / f"{n}.vcf") for n in "abc")], spark) == 0
    assert "0.500" in capsys.readouterr().out


def test_identity_and_manifest(spark, tree, capsys):
    calls = ["0/1", "1|1", "0/0"] * 10
    one, two = vcf(tree / "x.vcf", *calls), vcf(tree / "y.vcf", *(c.replace("|", "/") for c in calls))
    assert main(["identity", one, two], spark) == 0
    assert "30 shared\t100.0%\tmatch" in capsys.readouterr().out
    assert main(["identity", one, vcf(tree / "z.vcf", *["0/0"] * 30)], spark) == 1
    for side in ("before", "after"):
        (tree / side / "calls").mkdir(parents=True)
        vcf(tree / side / "calls" / "s1.vcf", "0/1")
    args = ["manifest", str(tree / "before"), str(tree / "after"), str(tree / "new.tsv")]
    assert main(args, spark) == 0 and (tree / "new.tsv").read_text().split("\n")[1].startswith("s1\tcalls\t")
    assert main(["batch", str(tree / "new.tsv")], spark) == 0
    vcf(tree / "before" / "calls" / "s2.vcf", "0/1")
    assert main([*args, "--force"], spark) == 2 and "missing after" in capsys.readouterr().err


def test_workspaces(tmp_path):
    target = tmp_path / "out"
    with artifacts.workspace(str(target)) as folder:
        (folder / "x.txt").write_text("1")
    assert (target / "x.txt").read_text() == "1"
    with pytest.raises(FileExistsError), artifacts.workspace(str(target)):
        pass
    with pytest.raises(RuntimeError), artifacts.workspace(str(target), force=True):
        raise RuntimeError
    assert (target / "x.txt").exists() and len(list(tmp_path.iterdir())) == 1
    (tmp_path / "mine").mkdir()
    for bad in (tmp_path / "mine", tmp_path / "no" / "where", "/"):
        with pytest.raises(ValueError), artifacts.workspace(str(bad), force=True):
            pass
    assert artifacts.slugs(["A b", "a-B", "!!"]) == {"A b": "a-b", "a-B": "a-b-a", "!!": "item"}

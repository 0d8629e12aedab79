import random

import corpus_pipeline
from rowparity.llm.decontamination import leaks
from rowparity.llm.lines import deduplicated
from rowparity.llm.quality import quality
from rowparity.llm.simhash import near_duplicates


def table(spark, tmp_path):
    r = random.Random(11)
    words = ["".join(r.choice("aeioutnsrl") for _ in range(r.randint(2, 6))) for _ in range(400)]
    line = lambda: " ".join(r.choice(words) for _ in range(r.randint(8, 14)))
    texts = ["\n".join(line() for _ in range(r.randint(8, 20))) for _ in range(60)]
    passage = " ".join(r.choice(words) for _ in range(30))
    rows = [*texts, texts[3], texts[4].replace(" ", "  ", 1), texts[5] + "\n" + passage, "\n".join(texts[6].split("\n")[:4]) + "\n" + texts[7], None, "", "too short", "# $ % " * 200]
    docs = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(rows)] + [(8, texts[8], "en", "s", 1), (None, line() * 9, None, None, None)]
    folder = str(tmp_path)
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder, spark.read.parquet(f"{folder}/documents.parquet")


def test_stages(spark, tmp_path):
    folder, docs = table(spark, tmp_path)
    columns = docs.columns
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "line_dedup", "near_dedup", "benchmark_decontamination", "packing"]
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, docs = docs, corpus_pipeline.written(stage(spark, docs, folder), name)
        assert docs.columns == columns and docs.dtypes == before.dtypes
        kept[name] = {r.doc_id for r in docs.collect()}
        if name == "quality_rules":
            assert kept[name] == {r.doc_id for r in quality(before).where("kept").collect()}
        elif name == "line_dedup":
            result = deduplicated(before).where("line_dedup.n_removed = 0 or line_dedup.text rlike '[^ \\t\\n\\r]'")
            assert sorted(map(str, kept[name])) == sorted({str(r.doc_id) for r in result.collect()})
        elif name == "near_dedup":
            assert len(kept[name]) == docs.count() == near_duplicates(before).select("component_id").distinct().count()
        else:
            assert kept[name] == {r.doc_id for r in before.collect()} - {r.doc_id for r in leaks(before, spark.read.parquet(f"{folder}/benchmark.parquet")).collect()}
    assert 60 not in kept["line_dedup"] and 62 in kept["near_dedup"] and 62 not in kept["benchmark_decontamination"]
    assert set(range(60)) <= kept["benchmark_decontamination"]
    packed = corpus_pipeline.run(spark, folder).collect()
    assert {r.doc_id for r in packed} == kept["benchmark_decontamination"]


def test_empty_documents(spark, tmp_path):
    folder = str(tmp_path)
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    assert corpus_pipeline.run(spark, folder).collect() == []

import random
import zlib

import numpy as np

from rowparity.llm.toxicity import fit, scored, toxicity, train


def corpus(n, seed=1):
    r = random.Random(seed)
    bad = ["blorg", "snark", "vile"]
    rows, labels = [], []
    for i in range(n):
        words = [f"w{r.randint(0, 80)}" for _ in range(r.randint(5, 60))]
        toxic = int(r.random() < 0.2)
        if toxic:
            words[r.randrange(len(words))] = r.choice(bad).upper() + r.choice(["", ",", "!"])
        rows.append((i, " ".join(words)))
        labels.append((i, 1, toxic))
    return rows, labels


def test_held_out_accuracy(spark, documents):
    rows, labels = corpus(1500)
    out = toxicity(documents(rows, extra=True), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    truth = {i: t for i, _, t in labels}
    held = [r for r in out if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in out)
    assert len(out) == 1500 and 200 < len(held) < 400
    assert np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.97
    assert all((r.score >= 0.5) == (r.predicted == 1) and 0 <= r.score <= 1 for r in out)


def test_labels_of_the_held_out_fold_are_not_read(spark, documents):
    rows, labels = corpus(300)
    flipped = [(i, q, 1 - t if zlib.crc32(str(i).encode()) % 5 == 0 else t) for i, q, t in labels]
    models = [train(documents(rows), spark.createDataFrame(x, "doc_id long, quality int, toxic int")) for x in (labels, flipped)]
    assert np.array_equal(models[0][0], models[1][0]) and models[0][1] == models[1][1]


def test_edge_rows(spark, documents):
    rows, labels = corpus(120)
    rows += [(500, None), (501, ""), (502, "..."), (None, "vile"), (3, rows[3][1]), (503, "blorg " * 30000)]
    model = train(documents(rows), spark.createDataFrame([*labels, (900, 1, 1), (None, 1, 1), (4, None, None)], "doc_id long, quality int, toxic int"))
    out = scored(documents(rows), model).collect()
    assert len(out) == len(rows)
    by = {r.doc_id: r.score for r in out}
    assert by[500] == by[501] == by[502]
    assert scored(documents([]), model).collect() == []
    nothing = toxicity(documents(rows), spark.createDataFrame([], "doc_id long, quality int, toxic int")).collect()
    assert len({r.score for r in nothing}) == 1


def test_risk_needs_no_negative_labels():
    """Texts 0 to 39 hold the word 1; half the unlabelled texts do too, and the prior says so."""
    positive = (np.array([1, 2] * 40), np.arange(0, 80, 2))
    unlabelled = (np.array([1, 2] * 30 + [3, 2] * 30), np.arange(0, 120, 2))
    weights, bias = fit(positive, unlabelled, 0.5)
    assert weights[1] + weights[2] + bias > 0 > weights[3] + weights[2] + bias

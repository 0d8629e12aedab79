import math
import random
import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from rowparity.llm.quality import FLOOR, OTHERS, KneserNey, _grams, base_metrics, gram_counts, keep_good, quality, text_losses


def brute_base(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[k : k + 3]) for k in range(len(words) - 2)]
    many = Counter(windows)
    covered = {j for k, w in enumerate(windows) if many[w] > 1 for j in (k, k + 1, k + 2)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    dups = sum(x in lines[:k] for k, x in enumerate(lines))
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dups, len(covered), len(words) < 50 or 100 * len(covered) > 50 * len(words)


def brute_model(texts):
    """Interpolated modified Kneser-Ney straight from its definition."""
    three = Counter((a, b, c) for t in texts for a, b, c in zip(b"\n\n" + t, b"\n" + t, t))
    two, one = Counter((b, c) for _, b, c in three), Counter()
    for _, c in two:
        one[c] += 1

    def cut(counts):
        n = [0] + [sum(v == k for v in counts.values()) for k in (1, 2, 3, 4)]
        y = n[1] / (n[1] + 2 * n[2]) if n[1] else 0.5
        d = [1 - 2 * y * n[2] / n[1] if n[1] else 0.5, 2 - 3 * y * n[3] / n[2] if n[2] else 1.0, 3 - 4 * y * n[4] / n[3] if n[3] else 1.5]
        d = [min(max(x, 0.1), k - 0.1) for k, x in enumerate(d, 1)]
        return lambda v: 0 if not v else d[min(v, 3) - 1]

    d1, d2, d3 = cut(one), cut(two), cut(three)

    def p1(c):
        return (one[c] - d1(one[c])) / one.total() + sum(map(d1, one.values())) / one.total() / 256

    def p2(b, c):
        n = {k: v for k, v in two.items() if k[0] == b}
        if not n:
            return p1(c)
        return (two[b, c] - d2(two[b, c])) / sum(n.values()) + sum(map(d2, n.values())) / sum(n.values()) * p1(c)

    def p3(a, b, c):
        n = {k: v for k, v in three.items() if k[:2] == (a, b)}
        if not n:
            return p2(b, c)
        return (three[a, b, c] - d3(three[a, b, c])) / sum(n.values()) + sum(map(d3, n.values())) / sum(n.values()) * p2(b, c)

    return p3


def test_base_metrics_against_brute_force():
    r = random.Random(1)
    texts = ["", " ", "a", "a b c", "a a a a a", "x\n\nx\n x\nx", "\x0b#|é\x1f %\r\n", *(" ".join(r.choice("ab#\n") for _ in range(r.randint(0, 120))) for _ in range(200))]
    for t in texts:
        assert base_metrics(t) == brute_base(t)


def test_model_against_definition(spark, documents):
    texts = [b"the cat sat on the mat", b"the dog sat", "é mate".encode(), b"t", b"thththth the"]
    table = gram_counts(documents([*enumerate(t.decode() for t in texts), (9, None), (8, "")])).toPandas().sort_values("gram")
    model, brute = KneserNey(table.gram.to_numpy(np.int64), table.n.to_numpy()), brute_model(texts)
    new = b"the hat \xff on a mat"
    codes, _ = _grams([new])
    expected = [math.log(brute(a, b, c)) for a, b, c in zip(b"\n\n" + new, b"\n" + new, new)]
    assert np.allclose(model.score(codes), expected, atol=1e-4)
    for a, b in ((116, 104), (10, 10), (200, 201)):
        assert abs(sum(brute(a, b, c) for c in range(256)) - 1) < 1e-9
    codes, begin = _grams([new * 30, b"x", new])
    losses = text_losses(codes, begin, model, [model])
    assert np.allclose(losses, -np.add.reduceat(model.score(codes).astype(float), begin), rtol=1e-6)


def test_documents(spark, documents):
    r = random.Random(3)
    words = ["".join(r.choice("aeioutnsrl") for _ in range(r.randint(2, 6))) for _ in range(300)]
    good = [(i, " ".join(r.choice(words) for _ in range(r.randint(60, 200)))) for i in range(60)]
    noise = "".join(chr(r.randint(33, 126)) if r.random() < 0.8 else " " for _ in range(900))
    rows = [*good, (60, noise), (61, None), (62, ""), (63, "short"), (64, "aa " * 400), (None, good[0][1]), (3, good[3][1]), (65, " ".join(words * 60))]
    out = {(row.doc_id, row.n_words): row for row in quality(documents(rows, extra=True)).collect()}
    for i, t in rows:
        row = out[i, len((t or "").encode().split())]
        assert (row.n_words, row.word_chars, row.n_symbols, row.n_dup_lines, row.n_repeat_words, row.base_failed) == brute_base(t or "")
    assert not out[60, len(noise.split())].kept and not out[64, 400].kept and all(out[i, len(t.split())].kept for i, t in good)
    kept = keep_good(documents(rows, extra=True))
    assert sorted(str(row.doc_id) for row in kept.collect()) == sorted(str(i) for i, t in [*good, (None, ""), (3, "")])
    assert kept.columns == documents(rows, extra=True).columns
    assert quality(documents([])).collect() == [] and keep_good(documents([])).collect() == []


def test_copies_of_one_text_move_no_band(spark, documents):
    r = random.Random(6)
    words = ["".join(r.choice("aeioutnsrl") for _ in range(r.randint(2, 6))) for _ in range(300)]
    good = [" ".join(r.choice(words) for _ in range(r.randint(60, 200))) for _ in range(60)]
    rows = [*enumerate(good), *((100 + k, good[7]) for k in range(90))]
    out = quality(documents(rows)).where("doc_id < 60").collect()
    assert len(out) == 60 and all(row.kept for row in out)
    alone = quality(documents([(k, good[7]) for k in range(9)])).collect()
    assert all(row.kept and row.low < row.log_perplexity < row.high for row in alone)


def test_symbols_behind_words_leave_the_band(spark, documents):
    r = random.Random(6)
    words = ["".join(r.choice("aeioutnsrl") for _ in range(r.randint(2, 6))) for _ in range(300)]
    good = [" ".join(r.choice(words) for _ in range(r.randint(60, 200))) for _ in range(60)]
    marked = [(100 + n, " ".join(w + "%" * (k % n == 0) for k, w in enumerate(r.choices(words, k=150)))) for n in (3, 4, 5, 6, 8, 10, 12, 15, 20, 30)]
    out = {row.doc_id: row for row in quality(documents([*enumerate(good), *marked])).collect()}
    assert all(out[k].kept for k in range(60)) and not out[103].kept and not out[104].kept and not out[104].base_failed


def test_quartiles_and_rare_languages(spark, documents, monkeypatch):
    r = random.Random(4)
    words = ["".join(r.choice("aeioutnsrl") for _ in range(r.randint(2, 6))) for _ in range(300)]
    rows = [(i, " ".join(r.choice(words) for _ in range(r.randint(60, 90)))) for i in range(40)]
    table = documents(rows).withColumn("lang", F.when(F.col("doc_id") < 25, "en").otherwise(F.concat(F.lit("x"), "doc_id")))
    monkeypatch.setattr("rowparity.llm.quality.LANGUAGES", 1)
    out = quality(table, 0, 0).collect()
    assert {row.lang for row in out} == {"en", OTHERS}
    for lang in ("en", OTHERS):
        losses = sorted(row.log_perplexity for row in out if row.lang == lang and not row.base_failed)
        ends = [losses[(len(losses) - 1) * k // 4] for k in (1, 3)]
        assert all(abs(row.low - ends[0] + FLOOR) < 1e-12 and abs(row.high - ends[1] - FLOOR) < 1e-12 for row in out if row.lang == lang)

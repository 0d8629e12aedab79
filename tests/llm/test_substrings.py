import hashlib
import random
from collections import Counter

import pytest

from rowparity.llm import substrings
from rowparity.llm.substrings import front_coded, merged, remove_repeats


def brute(rows, width=200):
    texts = [(t or "").encode() for _, t in rows]
    seen = Counter(t[k : k + width] for t in texts for k in range(len(t) - width + 1))
    out = []
    for (i, _), t in zip(rows, texts, strict=True):
        gone = bytearray(len(t))
        for k in range(len(t) - width + 1):
            if seen[t[k : k + width]] > 1:
                gone[k : k + width] = b"\1" * width
        kept = bytes(b for b, g in zip(t, gone, strict=True) if not g)
        spans = sum(1 for k in range(len(t)) if gone[k] and (k == 0 or not gone[k - 1]))
        out.append((str(i), len(t), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def run(df):
    return sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in remove_repeats(df).collect())


def cases():
    r = random.Random(4)
    word = lambda: "".join(r.choice("abcdé") for _ in range(r.randint(2, 7)))
    text = lambda n: " ".join(word() for _ in range(n))
    passage, other = text(80), text(60)
    texts = [text(100) + passage + text(50), passage, text(20) + passage[:230] + text(30), passage[40:260], "a" * 900, "ab" * 300, "a" * 199, "", None, "x", passage[:199], passage[:200]]
    texts += [text(300)] * 3 + [other + passage, passage + other, other[:150] + text(9) + other[150:], text(12) + passage[5:205]]
    for _ in range(25):
        base = list(passage)
        for _ in range(r.randint(1, 4)):
            base[r.randrange(len(base))] = "#"
        texts.append(text(r.randint(0, 30)) + "".join(base) + text(r.randint(0, 30)))
    return [(i, t) for i, t in enumerate(texts)] + [(None, text(90)), (3, texts[3])]


def test_against_brute_force(spark, documents):
    rows = cases()
    assert run(documents(rows, extra=True)) == brute(rows)


def test_small_blocks_and_hot_anchors(spark, documents, monkeypatch):
    monkeypatch.setattr(substrings, "HOT_ANCHOR", 3)
    rows = cases()
    assert run(documents(rows)) == brute(rows)


def test_repeats_across_the_seams_of_a_long_text(spark, documents):
    """Texts are hashed in pieces of BLOCK // 2 starts; a passage lies on each seam of one over three pieces long."""
    r = random.Random(5)
    half = substrings.BLOCK // 2
    long = bytearray(r.choices(b"abcdefgh ", k=3 * half + 1000))
    passages = [bytes(r.choices(b"abcdefgh ", k=320)) for _ in range(3)]
    for k, p in enumerate(passages, 1):
        long[k * half - 60 * k : k * half - 60 * k + 320] = p
    rows = [(0, long.decode()), *((k, "x" * k + p.decode() + "y" * k) for k, p in enumerate(passages, 1))]
    assert run(documents(rows)) == brute(rows)
    found = {row.doc_id: row for row in remove_repeats(documents(rows)).collect()}
    assert [(x["from"], x["to"]) for x in found[0].spans] == [(k * half - 60 * k, k * half - 60 * k + 320) for k in (1, 2, 3)]
    short = remove_repeats(documents(rows), whole=False)
    assert "kept" not in short.columns and {row.doc_id: row.kept_sha256 for row in short.collect()} == {
        i: hashlib.sha256(row.kept).hexdigest() for i, row in found.items()
    }


def test_empty_table(spark, documents):
    assert remove_repeats(documents([])).collect() == []


@pytest.mark.parametrize("k", [1, 2, 3, 5, 8])
def test_merge_of_front_coded_runs(k):
    r = random.Random(k)
    runs = [sorted("".join(r.choice("ab") for _ in range(r.randint(0, 9))).encode() for _ in range(r.randint(0, 40))) for _ in range(k)]
    out = list(merged([front_coded(x) for x in runs]))
    assert [s for _, s, _ in out] == sorted(s for x in runs for s in x)
    for (_, a, _), (_, b, share) in zip(out, out[1:]):
        assert a[:share] == b[:share] and (a[share : share + 1] != b[share : share + 1] or a == b)

import random
import re

import numpy as np
import pytest
import xxhash

from rowparity.llm import simhash
from rowparity.llm.simhash import golay_keys, linked, near_duplicates, one_of_each, simhashes


def brute_print(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    shingles = [" ".join(words[k : k + 4]) for k in range(len(words) - 3)] if len(words) >= 4 else ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints):
    nodes = list(range(len(prints)))
    def find(x):
        while nodes[x] != x:
            x = nodes[x]
        return x
    for a in range(len(prints)):
        for b in range(a):
            if (prints[a] ^ prints[b]).bit_count() <= 4:
                nodes[find(a)] = find(b)
    return [find(k) for k in range(len(prints))]


def test_fingerprints_against_brute_force():
    r = random.Random(2)
    texts = ["", " \t\n", "One", "a b c", "A b\x0bC d", "É É é x y z", "word " * 3000, *(" ".join(r.choice("abcdefgh") for _ in range(r.randint(1, 900))) for _ in range(40))]
    assert simhashes([t.encode() for t in texts]).tolist() == [brute_print(t) for t in texts]


def test_keys_lose_no_link():
    r = random.Random(3)
    for _ in range(400):
        a = r.getrandbits(64)
        b = a
        for bit in r.sample(range(64), r.randint(0, 4)):
            b ^= 1 << bit
        row, key = golay_keys(np.array([a, b], np.uint64))
        assert set(key[row == 0]) & set(key[row == 1])


def test_components_of_chains_and_groups(spark):
    r = random.Random(5)
    prints = []
    for _ in range(30):  # chains of 3-bit steps, and dense groups
        x = r.getrandbits(64)
        for _ in range(r.randint(1, 12)):
            prints.append(x)
            for bit in r.sample(range(64), r.randint(1, 4)):
                x ^= 1 << bit
    centre = r.getrandbits(64)
    prints += [centre ^ (1 << a) ^ (1 << b) for a in range(20) for b in range(a)]
    check_components(spark, prints)


@pytest.mark.parametrize("one_cell", [4, 10**6])
def test_components_in_crowded_buckets(spark, monkeypatch, one_cell):
    monkeypatch.setattr(simhash, "ONE_CELL", one_cell)
    r = random.Random(6)
    low, centre = r.getrandbits(43), r.getrandbits(21)
    prints = [low | r.getrandbits(21) << 43 for _ in range(400)]  # equal in two segments: all in the same buckets
    prints += [low | (centre ^ 1 << a ^ 1 << b) << 43 for a in range(21) for b in range(a)]
    check_components(spark, prints)


def check_components(spark, prints):
    prints = sorted(set(prints))
    signed = [x - (1 << 64) if x >> 63 else x for x in prints]
    out = {row.node: row.component for row in linked(spark.createDataFrame([(x,) for x in signed], "fingerprint long")).collect()}
    found, expected = {}, {}
    for x, c in zip(signed, brute_components(prints), strict=True):
        found.setdefault(out.get(x, x), set()).add(x)
        expected.setdefault(c, set()).add(x)
    assert sorted(map(sorted, found.values())) == sorted(map(sorted, expected.values()))


@pytest.fixture(scope="module")
def texts():
    r = random.Random(8)
    base = [" ".join("".join(r.choice("abcde") for _ in range(4)) for _ in range(120)) for _ in range(6)]
    rows = [(10 * k + j, b if j == 0 else b.replace(b[:4], "zzzz", 1) if j == 1 else b.upper()) for k, b in enumerate(base) for j in range(3)]
    return [*rows, (90, None), (91, ""), (92, " \n"), (93, "one"), (94, "ONE"), (95, "one two"), (0, rows[0][1]), (None, base[1]), (None, "alone here")]


def test_documents_against_brute_force(spark, documents, texts):
    out = near_duplicates(documents(texts, extra=True)).collect()
    prints = [brute_print(t) for _, t in texts]
    least = {}
    groups = brute_components(prints)
    for (i, _), c in zip(texts, groups, strict=True):
        least[c] = min((x for x in (i, least.get(c)) if x is not None), default=None)
    expected = sorted((str(i), p, str(least[c])) for (i, _), p, c in zip(texts, prints, groups, strict=True))
    assert sorted((str(r.doc_id), r.fingerprint % (1 << 64), str(r.component_id)) for r in out) == expected
    kept = one_of_each(documents(texts)).collect()
    assert len(kept) == len(set(groups))
    assert near_duplicates(documents([])).collect() == []


def test_components_with_null_and_repeated_ids_keep_one_each(spark, documents):
    r = random.Random(12)
    base = [" ".join("".join(r.choice("abcde") for _ in range(4)) for _ in range(120)) for _ in range(9)]
    ids = [None, None, None, None, 7, 7, 7, 3, 4]
    rows = [*zip(ids, base, strict=True), (None, base[0].upper()), (7, base[1]), (7, base[4].upper())]
    kept = one_of_each(documents(rows)).collect()
    assert sorted(row.text.lower() for row in kept) == sorted(base)
    assert {row.doc_id for row in kept if row.text.lower() == base[1]} == {7}

import random

import numpy as np

import corpus_pipeline
from rowparity.llm import jaccard


def test_near_dedup_stage_against_brute_force(spark, documents):
    r = random.Random(21)
    word = lambda: "".join(r.choice("abcde") for _ in range(4))
    texts = []
    for _ in range(12):  # chains and stars of copies with more and more words replaced
        base = [word() for _ in range(r.choice([8, 60, 150, 400]))]
        for step in range(8):
            texts.append(" ".join(base))
            copy = list(base)
            for at in r.sample(range(len(copy)), 1 + len(copy) * step // 120):
                copy[at] = word()
            base = copy if r.random() < 0.5 else base
            texts.append(" ".join(copy))
    texts += [texts[0].upper(), "", " \n", "one", "ONE", "one two"]

    def brute_set(text):
        words = text.lower().split()
        return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))}

    sets, nodes = list(map(brute_set, texts)), list(range(len(texts)))

    def find(x):
        while nodes[x] != x:
            x = nodes[x]
        return x

    for a in range(len(texts)):
        for b in range(a):
            if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                one, two = sorted((find(a), find(b)))
                nodes[two] = one
    assert sorted(row.doc_id for row in corpus_pipeline.near_dedup(spark, documents(list(enumerate(texts)), extra=True), "").collect()) == sorted({find(k) for k in range(len(texts))})


def test_candidates_are_all_pairs_that_golay_keys_reach(spark):
    rng = np.random.default_rng(4)
    width = (46 * jaccard.TABLES + jaccard.CHECKED) // 8
    rows = rng.integers(0, 256, (60, width), np.uint8)
    near = rows.copy()
    for row, table in zip(near, rng.integers(0, jaccard.TABLES, len(near)), strict=True):  # two bits differ in one pair of words, a half elsewhere
        bits = np.unpackbits(row)
        kept = bits[46 * table : 46 * table + 46].copy()
        kept[rng.choice(46, 2, replace=False)] ^= 1
        bits[: -jaccard.CHECKED] = rng.integers(0, 2, len(bits) - jaccard.CHECKED)
        bits[46 * table : 46 * table + 46] = kept
        row[:] = np.packbits(bits)
    hot = np.tile(rng.integers(0, 256, width, np.uint8), (80, 1))  # beyond RUN under each key
    hot[:, -1] ^= np.arange(80, dtype=np.uint8)
    data = [(k, row.tobytes()) for k, row in enumerate(np.concatenate([rows, near, hot]))]
    found = jaccard.candidates(spark.createDataFrame(data, "node long, print binary")).collect()
    pairs = {(r.a, r.b) for r in found if r.run is None}
    assert {(k, k + 60) for k in range(60)} == {p for p in pairs if p[0] < 120}
    assert {(120, k) for k in range(121, 200)} <= pairs
    runs = {}
    for r in found:
        if r.run is not None:
            runs.setdefault(r.run, set()).add(r.a)
    assert set(range(120, 200)) in runs.values()


def test_fingerprints_of_sets_at_the_threshold_meet():
    rng = np.random.default_rng(9)
    for shared, own in ((8, 1), (40, 5), (400, 50)):
        sets = [np.unique(rng.integers(0, 1 << 64, shared + own, np.uint64)) for _ in range(100)]
        twins = [np.concatenate([s[:shared], rng.integers(0, 1 << 64, own, np.uint64)]) for s in sets]
        one, two = jaccard.prints(sets), jaccard.prints(twins)
        met = set()
        for (row, key), (row2, key2) in zip(*(jaccard.table_keys(x, range(jaccard.TABLES)) for x in (one, two)), strict=True):
            met |= {int(x) >> 24 for x in np.intersect1d(row << 24 | key, row2 << 24 | key2)}
        assert met == set(range(100))
        assert np.bitwise_count(one[:, -16:] ^ two[:, -16:]).sum(axis=1).max() <= jaccard.MOST


def test_members_of_hot_runs_are_one_row_each(spark):
    rng = np.random.default_rng(5)
    width = 46 * jaccard.TABLES + jaccard.CHECKED
    rows = np.packbits(rng.integers(0, 2, width) ^ (rng.random((90, width)) < 0.04), axis=1)  # many different runs
    found = jaccard.candidates(spark.createDataFrame([(k, row.tobytes()) for k, row in enumerate(rows)], "node long, print binary")).collect()
    assert sorted(r.a for r in found if r.run is not None) == list(range(90))


def test_hot_runs_of_several_components_against_all_pairs(spark, documents):
    r, rng = random.Random(3), np.random.default_rng(3)
    base = [f"w{k}" for k in range(120)]
    texts = []
    for _ in range(170):  # one template, copies that are about 0.8 alike: some linked, some not
        copy = list(base)
        for at in r.sample(range(120), r.choice([1, 2, 3, 4, 5])):
            copy[at] = f"x{r.randrange(10**6)}"
        texts.append(" ".join(copy))
    sets = [jaccard.shingles(t.encode()) for t in texts]
    nodes = [jaccard._node(s) for s in sets]
    component = rng.integers(0, 3, len(texts))
    alike = lambda a, b: 0.8 * len(np.union1d(sets[a], sets[b])) <= len(np.intersect1d(sets[a], sets[b]))
    pairs = [(a, b) for b in range(len(texts)) for a in range(b) if component[a] != component[b]]
    wanted = {tuple(sorted((nodes[a], nodes[b]))) for a, b in pairs if alike(a, b)}
    data = [(n, int(c), len(s), p.tobytes(), jaccard.parity_map(s).tobytes()) for n, c, s, p in zip(nodes, component, sets, jaccard.prints(sets), strict=True)]
    found = {(p.a, p.b) for p in jaccard.apart(spark.createDataFrame(data, "node long, component long, n int, print binary, map binary"), 0.8).collect()}
    assert wanted and wanted <= found <= {tuple(sorted((nodes[a], nodes[b]))) for a, b in pairs}
    assert len(found) < 0.9 * len(pairs)

    links = {k: {k} for k in range(len(texts))}
    for b in range(len(texts)):
        for a in range(b):
            if links[a] is not links[b] and alike(a, b):
                links[a] |= links[b]
                links.update({k: links[a] for k in links[a]})
    grouped = {row.doc_id: row.component for row in jaccard.groups(documents(list(enumerate(texts)))).collect()}
    assert len(set(grouped.values())) == len({min(x) for x in links.values()})
    assert all(grouped[k] == grouped[min(x)] for k, x in links.items())

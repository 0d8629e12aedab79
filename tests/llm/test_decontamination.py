import random
import re
from itertools import combinations

from rowparity.llm.decontamination import MASKS, MATCHES, WINDOW, leaks, without_leaks


def test_masks_leave_no_window_out():
    places = [{at + k for k, c in enumerate(m) if c == "1"} for m in MASKS for at in range(WINDOW - len(m) + 1)]
    for wrong in combinations(range(WINDOW), WINDOW - MATCHES):
        assert any(not p & set(wrong) for p in places)


def tokens(text):
    return re.findall(r"[^\W_]+", (text or "").lower())


def brute(docs, items):
    found = {}
    for i, t in docs:
        d = tokens(t)
        for item, text in items:
            b = tokens(text)
            for diagonal in range(-len(b), len(d)):
                same = [b[k] == d[k + diagonal] for k in range(max(0, -diagonal), min(len(b), len(d) - diagonal))]
                if len(b) < WINDOW:
                    best = sum(same) if sum(same) == len(b) else 0
                else:
                    best = max((sum(same[k : k + WINDOW]) for k in range(len(same) - WINDOW + 1)), default=0)
                    best = best if best >= MATCHES else 0
                if best:
                    found[str(i), item] = max(best, found.get((str(i), item), 0))
    return sorted((i, item, n) for (i, item), n in found.items())


def cases():
    r = random.Random(9)
    word = lambda: "".join(r.choice("abcé") for _ in range(r.randint(1, 4)))
    text = lambda n: [word() for _ in range(n)]
    items = [(k, text(r.choice([1, 3, 5, 7, 14, 15, 16, 30, 40]))) for k in range(14)]
    docs = []
    for i in range(60):
        _, passage = r.choice(items)
        cut = r.randint(0, 6)
        passage = list(passage[cut:] if r.random() < 0.4 else passage)
        for _ in range(r.randint(0, 5)):
            if passage:
                passage[r.randrange(len(passage))] = word()
        docs.append((i, " ".join(text(r.randint(0, 25)) + passage + text(r.randint(0, 25)))))
    docs += [(70, None), (71, ""), (72, "... !"), (73, ", ".join(items[5][1]).upper() + "."), (74, " ".join(items[6][1]) * 2), (75, "a " * 4000), (None, " ".join(items[7][1])), (3, docs[3][1]), (3, docs[3][1])]
    items = [(k, " ".join(t)) for k, t in items]
    return docs, [*items, (50, None), (51, ""), (52, items[4][1]), (4, items[4][1]), (53, "a " * 40)]


def test_against_brute_force(spark, documents):
    docs, items = cases()
    benchmark = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "1 as tokens", "2 as seed")
    table = documents(docs, extra=True)
    out = sorted((str(r.doc_id), r.item_id, r.n_matched) for r in leaks(table, benchmark).collect())
    assert out == brute(docs, items)
    bad = {i for i, _, _ in out}
    kept = without_leaks(table, benchmark)
    assert kept.columns == table.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(i) for i, _ in docs if str(i) not in bad)


def test_the_shuffled_join_is_the_same(spark, documents, monkeypatch):
    docs, items = cases()
    monkeypatch.setattr("rowparity.llm.decontamination.BROADCAST_SEEDS", 0)
    out = leaks(documents(docs), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert sorted((str(r.doc_id), r.item_id, r.n_matched) for r in out) == brute(docs, items)


def test_empty_tables(spark, documents):
    docs, items = cases()
    assert leaks(documents([]), spark.createDataFrame(items, "item_id long, text string")).collect() == []
    assert leaks(documents(docs), spark.createDataFrame([], "item_id long, text string")).collect() == []


def test_short_items(spark, documents):
    items = spark.createDataFrame([(1, "capital of France is Paris"), (2, "seven"), (3, "...")], "item_id long, text string")
    docs = [(1, "The capital of France is Paris, they say."), (2, "the capital of France was Paris"), (3, "six, Seven; seven"), (4, "...")]
    assert sorted(map(tuple, leaks(documents(docs), items).select("doc_id", "item_id", "n_matched").collect())) == [(1, 1, 5), (3, 2, 1)]

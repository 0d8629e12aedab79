import random
import re

import pytest

from rowparity.llm.lines import deduplicated, without_repeats


def brute(rows, least):
    """Deletes the lines of runs of ``least`` lines that also begin earlier; longest runs in powers of two."""
    docs, begins = [], []
    for i, t in rows:
        lines = t.split("\n") if t is not None else []
        place = [k for k, x in enumerate(lines) if re.search(r"[^\x20\x09-\x0D]", x)]
        docs.append((i, lines, place))
        begins += [((-1 if i is None else i, at), len(docs) - 1) for at in range(len(place))]
    out = [[str(i), len(lines), set(), 0, lines] for i, lines, _ in docs]
    n = 1
    while True:
        earliest, found = {}, []
        for (key, at), row in begins:
            _, lines, place = docs[row]
            if at + n <= len(place):
                body = tuple(lines[k] for k in place[at : at + n])
                earliest[body] = min(earliest.get(body, (key, at)), (key, at))
                found.append((body, (key, at), row))
        later = [(at, row) for body, (key, at), row in found if (key, at) > earliest[body]]
        for at, row in later:
            if n == least:
                out[row][2].update(docs[row][2][at : at + n])
            if n & (n - 1) == 0:
                out[row][3] = max(out[row][3], n)
        if not later and n >= least:
            return sorted((i, k, len(g), m, "\n".join(x for k, x in enumerate(lines) if k not in g)) for i, k, g, m, lines in out)
        n += 1


def run(df, least):
    columns = ("n_lines", "n_removed", "longest_run")
    return sorted((str(r.doc_id), *(r.line_dedup[c] for c in columns), r.line_dedup.text or "") for r in deduplicated(df, least).collect())


def cases():
    r = random.Random(6)
    line = lambda: " ".join(r.choice("abcdefgh") for _ in range(r.randint(1, 6)))
    passage = [line() for _ in range(8)]
    rows = []
    for i in range(30):
        body = [line() for _ in range(r.randint(0, 10))]
        cut = r.randint(0, 4)
        for at in {r.randint(0, len(body)) for _ in range(r.randint(0, 2))}:
            body[at:at] = passage[cut : cut + r.randint(2, 8)]
        if r.random() < 0.4:
            body.insert(r.randint(0, len(body)), r.choice(["", " \t", "\r"]))
        rows.append((i, "\n".join(body)))
    same = "x y z"
    return [*rows, (40, None), (41, ""), (42, "\n\n"), (43, "\n".join([same] * 9)), (44, "\n".join([same] * 4)), (45, "one long line " * 500), (46, "one long line " * 500), (None, rows[3][1]), (7, rows[7][1])]


@pytest.mark.parametrize("least", [1, 2, 3])
def test_against_brute_force(spark, documents, least):
    assert run(documents(cases(), extra=True), least) == brute(cases(), least)


def test_documents_without_words_left_go(spark, documents):
    text = "\n".join(f"line {k} of the text" for k in range(6))
    rows = [(1, text), (2, text), (3, "head\n" + text), (4, ""), (5, None)]
    table = documents(rows, extra=True)
    out = without_repeats(table)
    assert out.columns == table.columns and [f.dataType for f in out.schema.fields] == [f.dataType for f in table.schema.fields]
    assert sorted((r.doc_id, r.text, r.n_chars) for r in out.collect() if r.doc_id != 5) == [(1, text, len(text)), (3, "head", 4), (4, "", 0)]
    assert without_repeats(documents([])).collect() == []


def test_long_and_common_lines(spark, documents):
    """A line of 24 words in many documents goes from all but the first; so does one of a million characters."""
    short, long = " ".join(f"w{k}" for k in range(24)), "word " * 200_000
    rows = [(i, f"own {i}\n{short}\n{long if i in (7, 9) else i}") for i in range(50)]
    rows.append((99, "\n".join(f"{k} of many" for k in range(60_000))))
    out = {r.doc_id: r.line_dedup for r in deduplicated(documents(rows)).collect()}
    assert [i for i in range(50) if out[i].n_removed] == list(range(1, 50))
    assert out[9].n_removed == 2 and out[9].longest_run == 2 and out[9].text == "own 9"
    assert out[0].text == rows[0][1] and out[99].n_removed == 0


def test_names_that_the_operator_uses(spark, documents):
    table = documents([(1, "a b\nc"), (2, "a b\nd")])
    for name in ("id", "text_key", "at", "lines", "starts", "longest", "gone", "kept", "numbers", "doc", "line_dedup"):
        table = table.selectExpr("*", f"'{name}' as {name}")
    out = deduplicated(table).orderBy("doc_id").collect()
    assert [r.line_dedup.text for r in out] == ["a b\nc", "d"] and out[0].kept == "kept" and out[1].doc == "doc"

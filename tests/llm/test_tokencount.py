import random

from hypothesis import given, settings
from hypothesis import strategies as st

from rowparity.llm.tokencount import Automaton, byte_automaton, token_counts


def greedy(word, first, later):
    at, n = 0, 0
    while at < len(word):
        pieces = later if at else first
        best = max((len(p) for p in pieces if p and word.startswith(p, at)), default=0)
        if not best:
            return 1
        at += best
        n += 1
    return n


@settings(max_examples=300, deadline=None)
@given(st.sets(st.text("abc", min_size=1, max_size=5), max_size=12), st.sets(st.text("abc", min_size=1, max_size=5), max_size=12), st.text("abcd", max_size=14))
def test_against_greedy(first, later, word):
    first, later, word = [p.encode() for p in first], [p.encode() for p in later], word.encode()
    assert Automaton(first, later).count(word) == greedy(word, first, later)


def test_documents(spark, documents):
    import base64

    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    pieces = [base64.b64decode(line.split()[0]) for line in open(path, "rb")]
    first, later = {p for p in pieces if p[:1] == b" "}, {p for p in pieces if p[:1] != b" "}
    longest = max(map(len, pieces))

    def count(word):
        at, n = 0, 0
        while at < len(word):
            at += next(k for k in range(longest, 0, -1) if word[at : at + k] in (later if at else first))
            n += 1
        return n

    r = random.Random(1)
    texts = ["", None, " \n", "hello world", "ünïcode\tワード", "a" * 5000, "x " * 3000, *("".join(chr(r.choice([32, 97, 101, 233, 116, 104, 0x1F600])) for _ in range(200)) for _ in range(20))]
    out = token_counts(documents([*enumerate(texts), (3, texts[3]), (None, "null")], extra=True)).collect()
    expected = [(i, t) for i, t in [*enumerate(texts), (3, texts[3]), (None, "null")]]
    assert sorted((str(r.doc_id), r.n_bytes, r.n_words, r.n_tokens) for r in out) == sorted(
        (str(i), len((t or "").encode()), len((t or "").encode().split()), sum(count(b" " + w) for w in (t or "").encode().split())) for i, t in expected
    )
    assert token_counts(documents([])).collect() == [] and byte_automaton(path) is byte_automaton(path)

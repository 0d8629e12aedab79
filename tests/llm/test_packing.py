import random
import zlib
from array import array

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from rowparity.llm.packing import pack, pack_documents, packing_plan, token_bytes

PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = ["", None, "<|endoftext|> a <|ENDOFTEXT|>", "Σ it's ΑΣ ,'s", "a\tb\x1cc  d\r\n", "ÀÉ é İ", "x,, y., z.", "日本 語.", "don't. we've, 12.5", "д İ. Σİ, \ufb2a."]
ALPHABET = [*"aXZ  \n\t\r.,;'’-_01!()<|>[]#é\u0301ßİıſ\u212a\u00c5\u00a0\u2009\u3000中ДʼnΣσς\u200b\ufeff😀\x00\x1c\x85", "the", "ing", "<|endoftext|>", " the ", "n't", "...", "'s"]


def test_ids_equal_the_tokenizers():
    coder = Tokenizer.from_file(PATH)
    for text, data in zip(ODD, token_bytes(ODD, PATH), strict=True):
        assert np.frombuffer(data, "<u4").tolist() == [*coder.encode(text or "", add_special_tokens=False).ids, 0]


def test_ids_of_random_texts():
    coder, r = Tokenizer.from_file(PATH), random.Random(5)
    for _ in range(40):
        texts = ["".join(r.choice(ALPHABET) for _ in range(r.randint(0, 40))) for _ in range(100)]
        for text, data in zip(texts, token_bytes(texts, PATH), strict=True):
            assert np.frombuffer(data, "<u4").tolist() == [*coder.encode(text, add_special_tokens=False).ids, 0], text


def check_places(rows, capacity):
    sequences = {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(sequences)


@pytest.mark.parametrize("counts", [{}, {1: 5000}, {2048: 7}, {1025: 9, 1023: 4, 512: 3, 511: 1}, {k: 1 + k % 7 for k in range(1, 2049)}])
def test_plan_places_each_piece_once(counts):
    runs = packing_plan(counts, 2048)
    for length, n in counts.items():
        ranks = sorted((a, b) for k, a, b, *_ in runs if k == length)
        assert [a for a, _ in ranks] == [0, *[b for _, b in ranks[:-1]]] and ranks[-1][1] == n
    sequences = max((s + b - a for _, a, b, s, *_ in runs), default=0)
    assert sequences <= 1.02 * sum(k * n for k, n in counts.items()) / 2048 + 2 or counts.keys() == {1025, 1023, 512, 511}


def test_documents_round_trip(spark, documents):
    texts = [*ODD, "word " * 5000, "word " * 2047, "w" * 30_000, *["same text here"] * 40]
    rows = [(i, t) for i, t in enumerate(texts)] + [(3, ODD[3]), (None, "null id")]
    out = pack_documents(documents(rows, extra=True)).collect()
    check_places(out, 2048)
    coder = Tokenizer.from_file(PATH)
    expected = []
    for i, t in rows:
        data = np.array([*coder.encode(t or "", add_special_tokens=False).ids, 0], "<u4").tobytes()
        for k in range(0, len(data), 8192):
            part = data[k : k + 8192]
            expected.append((-1 if i is None else i, k // 8192, k // 4, len(part) // 4, zlib.crc32(part)))
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in out) == sorted(expected)


def test_few_sequences_and_empty_table(spark, documents):
    pieces = spark.createDataFrame([(i, 0, 0, 1 + i * 37 % 900, i) for i in range(3000)], "doc_id long, piece int, start long, length long, ids_crc32 long")
    total = sum(1 + i * 37 % 900 for i in range(3000))
    assert check_places(pack(pieces).collect(), 2048) <= total / 2048 + 2
    assert pack_documents(documents([])).collect() == []


def test_any_other_vocabulary_encodes_whole_texts():
    texts = ["Hello  World, it's here.\n\tTabs", "", None, "a " * 3000, "Ünïcode 東京"]
    default, other = (public_tokenizers.path(name) for name in ("word_bpe_49k.json", "byte_bpe_50k.json"))
    for path in (default, other, default):
        tokenizer = Tokenizer.from_file(path)
        expected = [array("I", [*tokenizer.encode(t or "", add_special_tokens=False).ids, 0]).tobytes() for t in texts]
        assert list(token_bytes(texts, path)) == expected

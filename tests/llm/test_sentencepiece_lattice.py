import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest

from kilowatch.llm import sentencepiece_lattice as L

PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def own():
    return L.Lattice(PATH)


def plain(own, text):
    """Best sequence by trying every piece at every place of the whole text."""
    if not text:
        return []
    chars = L.SPACE + text.replace(L.SPACE, L._OWN_SPACE).replace(" ", L.SPACE)
    best = [(0.0, 0, None)]
    for end in range(1, len(chars) + 1):
        options = [(best[end - 1][0] + own.unknown, 0, None)]
        for start in range(max(0, end - 20), end):
            if chars[start:end] in own.scores:
                score, i = own.scores[chars[start:end]]
                options.append((best[start][0] + score, end - start, i))
        best.append(max(options, key=lambda o: o[:2]))
    out, at = [], len(chars)
    while at:
        _, length, i = best[at]
        out.append([i] if length else own._bytes(chars[at - 1]))
        at -= length or 1
    return [i for ids in reversed(out) for i in ids]


def corpus():
    r = random.Random(4)
    rows = ["", " ", "   ", "a", " a  b ", "▁", "a▁ ▁b", "line\nnext\ttab\x00", "東京 🙂 ñandú", "the " * 5000, "x" * 3000, " " * 2000, "Ünïcode <s> </s> <unk> <0x41>", "hello world, hello"]
    return rows + ["".join(r.choice(["the", "in", "er", " ", " ", "a", "é", "東", "\n", "▁", "ing", "zq"]) for _ in range(40)) for _ in range(300)]


def test_equals_trying_all_pieces_and_round_trips(own):
    for text in corpus():
        ids = np.frombuffer(own.encode(text), "<i4").tolist()
        assert ids == plain(own, text), repr(text)
        assert own.decode(ids) == text


def test_rows_of_a_table(documents, own):
    rows = list(enumerate(corpus())) + [(None, "no id"), (3, None), (4, "twice"), (4, "twice")]
    found = L.encoded(documents(rows), PATH).collect()
    want = []
    for i, t in rows:
        ids = plain(own, t or "")
        want.append((i, ids, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), hashlib.sha256((t or "").encode()).hexdigest(), True))
    assert sorted(map(tuple, found), key=str) == sorted(want, key=str)
    assert L.encoded(documents([]), PATH).collect() == []

import random
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from kilowatch.llm import queries
from kilowatch.llm import token_files as T

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def plain():
    whole = Tokenizer.from_file(PATH)
    whole.encode_special_tokens = True
    return lambda text: whole.encode(text, add_special_tokens=False).ids


AWKWARD = [
    "", " ", "  ", "a", " a", "a ", "a  b", "a   b  ", "\n\n a \n b", "it's we'll I'VE", "x \n\n  y\tz w 　q", "! !!! 0 12 345",
    "<|endoftext|> ünïcode 東京 🙂 á", "tab\t tab \t", "\x1c \x1c a \x00b", "a" * 5000, " " * 3000, "no-break  space  em", "end \n",
]


def test_pieces_give_the_ids_of_the_whole_text(plain):
    own = T.Encoder(PATH, 2)
    r = random.Random(1)
    mixed = ["".join(r.choice([" ", " ", "\n", "\t", "a", "Be", "'s", "é", ".", "12", " ", "!", "東"]) for _ in range(60)) for _ in range(500)]
    words = [" ".join(r.choice(["the.", "Ünï", "a,b", "x\ny", "(q)", "it's", "12%", "zz" * 40, "n\0l", "--"]) for _ in range(30)) for _ in range(300)]
    for text in AWKWARD + mixed + words:
        pieces = T.cut(text)
        assert "".join(p[0] if type(p) is tuple else " " + p for p in pieces) == text
    texts = AWKWARD + mixed + words
    encode = lambda given: own(pa.array(given, pa.string())).to_pylist()
    assert encode([]) == [] and own(pa.array(["x", *texts], pa.string()).slice(1)).to_pylist() == encode(texts)
    for text, ids in zip(texts * 2, encode(texts) + encode(texts[::-1])[::-1], strict=True):
        assert np.frombuffer(ids, "<u2").tolist() == plain(text), repr(text)


def test_files_hold_all_documents_in_order(spark, documents, plain, tmp_path):
    r = random.Random(2)
    rows = [(r.randrange(-50, 10**6), r.choice(AWKWARD) + str(k)) for k in range(150)] + [(3, None), (None, "no id"), (4, "twice"), (4, "twice")]
    for width, end_id, case in ((2, 0, rows), (4, 7, rows[:30]), (2, 0, []), (2, 0, rows[:1])):
        path = str(tmp_path / f"w{width}-{len(case)}")
        T.write_token_files(documents(case).repartition(3), path, PATH, width, end_id)
        ordered = [(i, plain(t or "") + [end_id]) for i, t in case]
        found = sorted((tuple(x) for x in T.read_documents(spark, path, width).collect()), key=lambda x: x[1])
        assert [x[0] for x in found] == sorted((i for i, _ in ordered), key=lambda i: (i is not None, i or 0))
        assert [x[1] for x in found] == [sum(x[2] for x in found[:k]) for k in range(len(found))]
        crc = [(i, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())) for i, ids in ordered]
        assert sorted(((i, n, c) for i, _, n, c in found), key=str) == sorted(crc, key=str)
        mapped = T.Tokens(path, width)
        assert len(mapped) == len(case)
        for k, (i, start, n, c) in enumerate(found):
            assert mapped.doc_id(k) == (T.NO_ID if i is None else i) and len(mapped[k]) == n
            assert zlib.crc32(mapped[k].astype("<u4").tobytes()) == c


def test_an_end_id_has_to_fit(documents, tmp_path):
    with pytest.raises(ValueError):
        T.write_token_files(documents([]), str(tmp_path / "x"), PATH, 2, 70_000)


ADDED = ["one <|endoftext|> two", "<|endoftext|>", "a<|endoftext|>b  c", "<|endoftext|><|endoftext|> ", " x\n<|endoftext|>", "<|endoftext|", "<|ENDOFTEXT|> a"]


def test_added_tokens_get_the_ids_of_the_plain_call(spark, documents, tmp_path):
    whole = Tokenizer.from_file(PATH)
    own = T.Encoder(PATH, 2, True)
    texts = [*ADDED, *AWKWARD, *ADDED[::-1], "one <|endoftext|> three"]
    for text, ids in zip(texts, own(pa.array(texts, pa.string())).to_pylist(), strict=True):
        assert np.frombuffer(ids, "<u2").tolist() == whole.encode(text, add_special_tokens=False).ids, repr(text)
    assert own(pa.array([], pa.string())).to_pylist() == []
    documents(list(enumerate(texts))).write.parquet(str(tmp_path / "documents.parquet"))
    found = sorted(tuple(r) for r in queries.op9_token_files(spark, str(tmp_path)).collect())
    ids = [[*whole.encode(t, add_special_tokens=False).ids, T.END_ID] for t in texts]
    assert found == [(k, sum(map(len, ids[:k])), len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for k, x in enumerate(ids)]


def test_ranges_are_bounded_by_bytes(spark, documents, plain, tmp_path, monkeypatch):
    rows = [(k, "a " * (500 if 300 <= k < 320 else 3)) for k in range(400)] + [(310, "b " * 3000), (500, "")] + [(500, "c " * 700)] * 3 + [(None, "d")]
    monkeypatch.setattr(T, "RANGE_BYTES", 2500)
    path = str(tmp_path / "files")
    known = T.write_token_files(documents(rows), path, PATH).collect()
    bounds = T._ranges(documents(rows).select("doc_id", "text"), 4, 2500).bounds
    held = {}
    for i, t in rows:
        held.setdefault(sum(b <= (i or 0) for b in bounds), []).append((i, len(t)))
    assert all(sum(n for _, n in r) <= 2500 or len({i for i, _ in r}) == 1 for r in held.values()) and {310, 500} <= {r[0][0] for r in held.values()}
    assert max(r["n_ids"] for r in known) == max(sum(len(plain(t)) + 1 for i, t in rows if i == k) for k in (310, 500))
    found = sorted(T.read_documents(spark, path).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in found] == [None, *sorted(i for i, _ in rows if i is not None)]
    assert sum(r["n_tokens"] for r in found) == sum(len(plain(t)) + 1 for _, t in rows)

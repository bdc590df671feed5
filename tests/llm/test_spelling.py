import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from kilowatch.llm import spelling as S


def words_of(rows):
    found = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 31 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            if len(run) >= 7:
                found[run] += 1
    return {w: n for w, n in found.items() if n >= 2}


def edits(word, letters):
    cut = [(word[:k], word[k:]) for k in range(len(word) + 1)]
    found = {a + b[1:] for a, b in cut if b} | {a + c + b[1:] for a, b in cut if b for c in letters} | {a + c + b for a, b in cut for c in letters}
    return found - {word}


def plain(rows):
    words = words_of(rows)
    letters = set("".join(words))
    form, near_count = {}, {}
    for word, n in words.items():
        near = [w for w in edits(word, letters) if w in words]
        near_count[word] = len(near)
        best = min(near, key=lambda w: (-words[w], w), default=None)
        form[word] = best if best is not None and words[best] >= 10 * n else None
    out = []
    for word, n in words.items():
        root = word
        while form[root] is not None:
            root = form[root]
        out.append((word, n, near_count[word], form[word], words.get(form[word]), root))
    return sorted(out, key=str)


def corpus(seed):
    r = random.Random(seed)
    base = ["".join(r.choice("abcdeéÿÀts") for _ in range(r.randrange(7, 12))) for _ in range(40)]
    base += ["aaaaaaaa", "aaaaaaaaa", "abababab", "babababa", "ababababa", "straßen", "Straßenbahn", "÷×÷×÷×÷"]
    rows = []
    for doc in range(300):
        words = []
        for _ in range(r.randrange(0, 60)):
            word = base[min(int(r.expovariate(0.15)), len(base) - 1)]
            if r.random() < 0.15:
                at = r.randrange(len(word))
                word = r.choice([word[:at] + word[at + 1 :], word[:at] + r.choice("xyé") + word[at + 1 :], word[:at] + r.choice("xyé") + word[at:]])
            words.append(word.upper() if r.random() < 0.1 else word)
        rows.append((doc, r.choice([" ", ", ", "-", "1", "ő", " ", "€"]).join(words)))
    return rows + [(None, "Nullenidentität Nullenidentität"), (3, rows[3][1]), (4, None), (5, ""), (6, "long" * 3000 + " " + "long" * 3000 + " " + "long" * 2999 + "lon " * 2)]


def found(frame):
    return sorted(map(tuple, frame.select("word", "n", "n_near", "form", "form_n", "root").collect()), key=str)


@pytest.mark.parametrize("symbols", [2, 6])
def test_equals_brute_force(documents, symbols, monkeypatch):
    monkeypatch.setattr(S, "HELD_BYTES", 5000)
    rows = corpus(symbols)
    want = plain(rows)
    assert sum(w[3] is not None for w in want) > 20 and any(w[3] != w[5] for w in want if w[3])
    assert found(S.variants(documents(rows).repartition(3), symbols=symbols)) == want


def test_chains_of_forms_end_at_the_root(documents):
    chain = ["lantern", "lanterne", "lanternes", "xlanternes"]
    rows = [(k, " ".join([w] * (2 * 10**k))) for k, w in enumerate(chain)]
    ids = iter(i for i in range(10_000) if all(zlib.crc32(f"{i}:{w}".encode()) % 31 for w in chain))
    rows = [(next(ids), text) for _, text in rows]
    got = {r["word"]: (r["form"], r["root"]) for r in S.variants(documents(rows)).collect()}
    assert got == {"lantern": ("lanterne", "xlanternes"), "lanterne": ("lanternes", "xlanternes"), "lanternes": ("xlanternes", "xlanternes"), "xlanternes": (None, "xlanternes")}


def test_empty_and_wordless_tables(documents):
    assert found(S.variants(documents([]))) == found(S.variants(documents([(1, None), (2, "short words only ok")]))) == []


def test_neighbourhoods_hold_every_edit_once():
    """Deletions and upward replacements from either side reach every reduced word within one edit, and no other."""
    words = ["".join(w) for n in range(1, 5) for w in __import__("itertools").product("abc", repeat=n)]
    codes = S._Codes(words)
    own = S._keys(codes.whole)
    name = dict(zip(own.tolist(), words))
    pairs = Counter((name.get(near), name[of]) for a, b in codes.neighbours(3) for near, of in zip(a.tolist(), b.tolist()))
    assert max(n for (near, _), n in pairs.items() if near) == 1
    unordered = {tuple(sorted(p)) for p in pairs if p[0]}
    assert unordered == {tuple(sorted((a, b))) for a in words for b in [*edits(a, "abc"), a] if b in name.values()}
    assert len(np.unique(own)) == len(words)


def test_plan_compares_inside_the_join(documents):
    _, pairs = S.near_pairs(S.vocabulary(documents(corpus(1))))
    plan = pairs._jdf.queryExecution().optimizedPlan().toString()
    assert "levenshtein" in next(line for line in plan.splitlines() if "Join Inner" in line and "levenshtein" in line)
    assert "Cartesian" not in pairs._jdf.queryExecution().executedPlan().toString()

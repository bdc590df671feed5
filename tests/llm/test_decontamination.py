import random
import re
from collections import Counter

import numpy as np

from kilowatch.llm import decontamination as D
from kilowatch.llm.common import shingle_hashes

R = random.Random(8)
VOCABULARY = [f"wörd{k}" for k in range(400)]


def prose(n):
    return [R.choice(VOCABULARY) for _ in range(n)]


ITEMS = [(k, prose(R.randrange(8, 60))) for k in range(30)] + [(30, ["two", "words"]), (31, prose(6))]


def brute(docs, items):
    """Best similarity of each item over all windows of its size, weights by the items of its shingle size."""
    bag = lambda w, n: Counter(tuple(w[k : k + n]) for k in range(len(w) - n + 1))
    found = {}
    for size in {min(5, len(w)) for _, w in items}:
        group = [(i, w) for i, w in items if min(5, len(w)) == size]
        having = Counter(s for _, w in group for s in bag(w, size))
        weight = lambda s: 1 + np.log(len(group) / max(1, having[s]))
        for d, words in docs:
            for i, w in group:
                for k in range(max(1, len(words) - len(w) + 1)) if len(words) >= size else ():
                    a, b = bag(w, size), bag(words[k : k + len(w)], size)
                    if a.keys() & b.keys():
                        s = sum(weight(x) * n for x, n in (a & b).items()) / sum(weight(x) * n for x, n in (a | b).items())
                        if s >= 0.8:
                            found[d, i] = max(found.get((d, i), 0), round(s, 9))
    return found


def test_equals_comparing_all_windows(spark, documents):
    docs = []
    for d in range(60):
        words = prose(R.randrange(0, 300))
        for _ in range(R.randrange(3)):
            passage = list(R.choice(ITEMS)[1])
            if R.random() < 0.4 and len(passage) > 20:
                passage[R.choice((0, -1))] = "edited"
            at = R.randrange(len(words) + 1)
            words[at:at] = passage
        docs.append((d, words))
    rows = [(d, re.sub(" ", ", ", " ".join(w).title()) + ".") for d, w in docs] + [(None, None), (None, " ".join(ITEMS[0][1])), (99, "--- ...")]
    items = spark.createDataFrame([(i, " ".join(w), 1) for i, w in ITEMS] + [(None, None, 2), (77, " ", 3)], "item_id bigint, text string, doc_id int")
    want = brute([*docs, (None, ITEMS[0][1])], ITEMS)
    assert len(want) > 20
    for block in (2000, 8):
        found = D.contaminated(documents(rows), items, block=block).collect()
        if block == 2000:
            assert {(r["doc_id"], r["item_id"]): round(r["similarity"], 9) for r in found} == want
        else:
            assert {(d, i) for d, i in want if d == 0} <= {(r["doc_id"], r["item_id"]) for r in found}
    kept = D.clean(documents(rows), items)
    assert kept.columns == documents(rows).columns
    assert {r["doc_id"] for r in kept.collect()} == ({d for d, _ in docs} | {99, None}) - ({d for d, _ in want} - {None})
    assert D.contaminated(documents([]), items).collect() == [] and D.contaminated(documents(rows), items.limit(0)).collect() == []


def test_index_misses_no_fingerprint_within_the_radius():
    rows = [(k, np.array([R.getrandbits(64) for _ in range(12)], np.uint64)) for k in range(300)]
    items = D.Items(5, rows, D.RADIUS, 0.8)
    prints = items.prints[:200].copy()
    for k in range(200):
        for bit in R.sample(range(64), R.randrange(24)):
            prints[k] ^= np.uint64(1 << bit)
    near = np.bitwise_count(prints[:, None] ^ items.prints[None, :]) <= D.RADIUS
    assert {tuple(p) for p in np.argwhere(near).tolist()} == set(zip(*(x.tolist() for x in items.candidates(prints))))
    assert len(shingle_hashes(rows[0][1], 5)) == 8


def test_inner_edits_and_a_shared_preamble_are_found_as_by_comparing_all_windows():
    r = random.Random(15)
    own = lambda k, n: [f"i{k}x{r.randrange(10**9)}" for _ in range(n)]
    preamble = own("p", 12)
    items = [(k, preamble + own(k, 90)) for k in range(60)] + [(100 + k, own(k, 49)) for k in range(60)]
    docs = []
    for i, words in items:
        for _ in range(4):
            copy = list(words)
            if i < 100:
                copy[:12] = own("d", 12)
            else:
                copy[r.randrange(5, 44)] = "edited"
            docs.append((len(docs), own("d", 5) + copy + own("d", 5)))
    want = brute_of_own(docs, items)
    rows = [(i, " ".join(w)) for i, w in items]
    whole, narrow = D.Index(rows), D.Index(rows, D.RADIUS)
    found = {(d, m[0]): round(m[1], 9) for d, w in docs for m in whole(" ".join(w))}
    assert found == want and len(want) > 300
    near = {(d, m[0]) for d, w in docs for m in narrow(" ".join(w))}
    assert near <= want.keys() and len(near) >= 0.99 * len(want)


def test_recall_of_the_radius_where_similarity_is_least():
    """Passages edited until they are hardly similar enough, found by the radius and by comparing all windows."""
    r = random.Random(21)
    own = lambda k, n: [f"i{k}x{r.randrange(10**9)}" for _ in range(n)]
    shared = own("p", 15)
    items = [(k, [*shared[: r.choice((0, 8, 15))], *own(k, r.randrange(30, 150))]) for k in range(150)]
    rows = [(i, " ".join(w)) for i, w in items]
    whole, narrow = D.Index(rows), D.Index(rows, D.RADIUS)
    least = found = 0
    for _, words in items * 4:
        copy = list(words)
        for _ in range(max(1, len(words) // r.choice((25, 30, 40, 45)))):
            copy[r.randrange(len(copy))] = "edited"
        text = " ".join(own("d", 4) + copy + own("d", 4))
        all_, near = ({m[0]: m for m in index(text)} for index in (whole, narrow))
        assert near.items() <= all_.items()
        close = [i for i, m in all_.items() if m[1] < 0.83]
        least, found = least + len(close), found + sum(i in near for i in close)
    print("recall below 0.83:", found, "of", least)
    assert least > 60 and found >= 0.95 * least


def brute_of_own(docs, items):
    """As `brute`, for documents that can only hold the item of their own number."""
    having = Counter(tuple(w[k : k + 5]) for _, w in items for k in range(len(w) - 4))
    weight = lambda x: 1 + np.log(len(items) / max(1, having[x]))
    bag = lambda w: Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
    found = {}
    for d, words in docs:
        i, w = items[d // 4]
        for k in range(len(words) - len(w) + 1):
            a, b = bag(w), bag(words[k : k + len(w)])
            s = sum(weight(x) * n for x, n in (a & b).items()) / sum(weight(x) * n for x, n in (a | b).items())
            if s >= 0.8:
                found[d, i] = max(found.get((d, i), 0), round(s, 9))
    return found


def test_repeated_words_are_compared_too():
    index = D.Index([(1, "a " * 30), (2, "b c " * 12)])
    assert [m[:4] for m in index("x " * 9 + "a " * 500 + "b c " * 40)] == [(1, 1.0, 9, 30), (2, 1.0, 509, 24)]


def test_blocks_change_no_result(spark, documents):
    r = random.Random(3)
    shared = [f"s{k}" for k in range(14)]
    items = [(k, shared[: r.choice((0, 8, 14))] + [f"w{r.randrange(500)}" for _ in range(r.randrange(6, 40))]) for k in range(40)] + [(50, ["two", "words"]), (51, ["two", "more"])]
    docs = []
    for d in range(80):
        passage = list(r.choice(items)[1])
        if len(passage) > 12:
            passage[r.choice((0, 1, 2, 3, -1, -2, -3))] = "edited"
            passage[: r.randrange(4)] = shared[:2]
        docs.append((d, " ".join(["x", *passage, "y"] + shared * r.randrange(2))))
    frame = spark.createDataFrame([(i, " ".join(w)) for i, w in items], "item_id bigint, text string")
    whole, *others = ([tuple(x) for x in sorted(D.contaminated(documents(docs), frame, block=b).collect())] for b in (2000, 8, 20))
    assert len(whole) > 30 and all(o == whole for o in others)

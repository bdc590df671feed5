"""Quality classifier: a generalised additive model with pairwise interactions.

Features are figures of a text's form: lengths, shares of kinds of characters, repetition. Each feature is cut into bins
at quantiles of the training rows. Boosting goes round the features: in each turn a tree of at most three leaves over the
bins of one feature is fitted to the current gradients and added, damped, to that feature's table. When the single tables
stand, the pairs of features whose coarse grid explains most of what is left get tables of their own in the same way, with
trees that split either feature once. A score is the logistic function of the sum of table entries: bin numbers and
additions over arrays.

Training uses at most about `SAMPLE` labelled rows, chosen by a hash of the id; the features of those texts, some dozens of
numbers each, come to the driver. Scoring reads every text once and shuffles nothing.

Null and empty texts get the features of an empty text and a score like any other. Rows whose label or id is null are not
used for training; repeated label rows count once each. Without training rows, or with one label only, the score is
the smoothed share of label 1 (0.5 without rows). Labels, language, source and ids are no inputs of a score.
"""

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F, types as T

from kilowatch.llm.common import WHITE, _spans, shingle_hashes, texts, word_hashes

SAMPLE = 30_000
ROUNDS, PAIR_ROUNDS, RATE = 150, 60, 0.15
BINS, GRID, PAIRS = 48, 12, 6
REGULAR = 5.0
THRESHOLD = 0.7

FEATURES = (
    "log_chars log_words mean_word sd_word longest_word letters digits spaces punctuation symbols upper lines odd_words unlike_words "
    "distinct_words top_word repeated_lines repeated_shingles words_a_sentence entropy short_words capitals accents doubled_words"
).split()

_KIND = np.zeros((256, 8), bool)
for _c in range(256):
    _ch = chr(_c)
    _KIND[_c] = [
        _c >= 128 or _ch.isalpha(), _c < 128 and _ch.isdigit(), bool(WHITE[_c]), _c < 128 and _ch in ".,;:!?'\"()-",
        _c < 128 and not _ch.isalnum() and not WHITE[_c] and _ch not in ".,;:!?'\"()-", _c < 128 and _ch.isupper(), _c == 10, _ch in ".!?",
    ]
_LETTER, _SYMBOL, _UPPER, _STOP = _KIND[:, 0], _KIND[:, 4], _KIND[:, 5], _KIND[:, 7]
_STEP = 1 << 22


def features(text):
    """The numbers of FEATURES, in their order."""
    raw = text.encode()
    data = np.frombuffer(raw, np.uint8)
    histogram = np.bincount(data, minlength=256) if len(data) else np.zeros(256, int)
    n = max(1, len(data))
    kinds = histogram @ _KIND / n
    share = histogram[histogram > 0] / n
    counts = np.zeros(4, np.int64)
    lengths = []
    for at in range(0, len(data), _STEP):  # words of very long texts, stretch by stretch
        block = data[at : at + _STEP]
        starts, ends = _spans(block, WHITE)
        if not len(starts):
            continue
        lengths.append(ends - starts)
        odd = np.concatenate(([0], np.cumsum(_SYMBOL[block])))
        other = np.concatenate(([0], np.cumsum(~_LETTER[block])))
        counts += [(odd[ends] > odd[starts]).sum(), ((other[ends] - other[starts]) * 2 > ends - starts).sum(), _UPPER[block[starts]].sum(), _STOP[block[ends - 1]].sum()]
    size = np.concatenate(lengths) if lengths else np.zeros(1, np.int64)
    words = word_hashes(raw)
    m = max(1, len(words))
    _, often = np.unique(words, return_counts=True) if len(words) else (None, np.zeros(1, int))
    runs = shingle_hashes(words, 3)
    lines = [x for x in raw.split(b"\n") if x]
    return [
        np.log1p(len(text)), np.log1p(len(words)), size.mean(), size.std(), np.log1p(size.max()), kinds[0], kinds[1], kinds[2], kinds[3], kinds[4], kinds[5],
        kinds[6], counts[0] / m, counts[1] / m, len(often) / m, often.max() / m, 1 - len(set(lines)) / max(1, len(lines)), 1 - len(np.unique(runs)) / max(1, len(runs)),
        np.log1p(m / max(1, int(counts[3]))), float(-(share * np.log2(share)).sum()), (size < 4).mean(), counts[2] / m, histogram[128:].sum() / n,
        (words[1:] == words[:-1]).sum() / m,
    ]


def matrix(batch):
    return np.array([features(t or "") for t in batch], np.float32).reshape(len(batch), len(FEATURES))


# ---- model ----------------------------------------------------------------------------------------------------------


def _best_cuts(g, h, leaves):
    """Values of the bins of a tree over ordered bins, from sums of gradients and hessians; splits greedily."""
    parts = [(0, len(g))]
    G, H = np.concatenate(([0], np.cumsum(g))), np.concatenate(([0], np.cumsum(h)))
    value = lambda a, b: (G[b] - G[a]) ** 2 / (H[b] - H[a] + REGULAR)
    while len(parts) < leaves:
        best = (1e-9, None, None)
        for a, b in parts:
            if b - a > 1:
                cut = np.arange(a + 1, b)
                gain = value(a, cut) + value(cut, b) - value(a, b)
                k = int(np.argmax(gain))
                if gain[k] > best[0]:
                    best = (gain[k], (a, b), int(cut[k]))
        if best[1] is None:
            break
        parts.remove(best[1])
        parts += [(best[1][0], best[2]), (best[2], best[1][1])]
    out = np.zeros(len(g))
    for a, b in parts:
        out[a:b] = (G[b] - G[a]) / (H[b] - H[a] + REGULAR)
    return out


def _quarters(g, h):
    """Values of a tree over a grid that splits each of both features once, and its gain."""
    G, H = (np.pad(x.cumsum(0).cumsum(1), ((1, 0), (1, 0))) for x in (g, h))
    a, b = np.arange(1, GRID)[:, None], np.arange(1, GRID)[None, :]
    corners = [
        [M[a, b], M[a, -1] - M[a, b], M[-1, b] - M[a, b], M[-1, -1] - M[a, -1] - M[-1, b] + M[a, b]] for M in (G, H)
    ]
    gain = sum(x**2 / (y + REGULAR) for x, y in zip(*corners))
    i, j = np.unravel_index(int(np.argmax(gain)), gain.shape)
    leaf = [x[i, j] / (y[i, j] + REGULAR) for x, y in zip(*corners)]
    out = np.zeros((GRID, GRID))
    out[: i + 1, : j + 1], out[: i + 1, j + 1 :], out[i + 1 :, : j + 1], out[i + 1 :, j + 1 :] = leaf
    return out, float(gain[i, j] - G[-1, -1] ** 2 / (H[-1, -1] + REGULAR))


class Additive:
    """Intercept, a table per feature and a table per chosen pair."""

    def __init__(self, X, y):
        X, y = np.asarray(X, np.float32).reshape(-1, len(FEATURES)), np.asarray(y, float)
        share = (y.sum() + 1) / (len(y) + 2)
        self.base = float(np.log(share / (1 - share)))
        quantiles = lambda n: [np.unique(np.quantile(X[:, f], np.arange(1, n) / n)) if len(X) else np.zeros(0) for f in range(X.shape[1])]
        self.cuts, self.coarse = quantiles(BINS), quantiles(GRID)
        self.tables = [np.zeros(len(c) + 1) for c in self.cuts]
        self.pairs = {}
        if len(set(y.tolist())) == 2:
            self._fit(X, y)

    @staticmethod
    def _bins(X, cuts):
        return [np.searchsorted(c, X[:, f], side="left") for f, c in enumerate(cuts)]

    def _fit(self, X, y):
        bins, coarse = self._bins(X, self.cuts), self._bins(X, self.coarse)
        total = np.full(len(y), self.base)

        def slopes():
            p = 1 / (1 + np.exp(-total))
            return y - p, p * (1 - p)

        for _ in range(ROUNDS):
            for f, b in enumerate(bins):
                g, h = slopes()
                size = len(self.tables[f])
                step = RATE * _best_cuts(np.bincount(b, g, size), np.bincount(b, h, size), 3)
                self.tables[f] += step
                total += step[b]

        def grid(f1, f2):
            g, h = slopes()
            at = coarse[f1] * GRID + coarse[f2]
            return at, *(np.bincount(at, w, GRID * GRID).reshape(GRID, GRID) for w in (g, h))

        gains = {p: _quarters(*grid(*p)[1:])[1] for p in itertools.combinations(range(len(FEATURES)), 2)}
        self.pairs = {p: np.zeros((GRID, GRID)) for p in sorted(gains, key=lambda p: (-gains[p], p))[:PAIRS]}
        for _ in range(PAIR_ROUNDS):
            for p, table in self.pairs.items():
                at, g, h = grid(*p)
                step = RATE * _quarters(g, h)[0]
                table += step
                total += step.ravel()[at]

    def score(self, X):
        """Probability of label 1 for rows of features."""
        total = np.full(len(X), self.base)
        for table, b in zip(self.tables, self._bins(X, self.cuts)):
            total += table[b]
        coarse = self._bins(X, self.coarse) if self.pairs else []
        for (f1, f2), table in self.pairs.items():
            total += table[coarse[f1], coarse[f2]]
        return 1 / (1 + np.exp(-total))


# ---- tables ---------------------------------------------------------------------------------------------------------


def held_out(doc_id):
    """Rows that training never sees."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(docs, labels, sample=SAMPLE, id_col="doc_id", text_col="text"):
    """The model of the labelled texts outside the held-out part.

    Only ids of sampled rows, at most about `sample` numbers, are sent to all tasks to find the texts.
    """
    known = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("quality").cast("int").alias("quality")).dropna()
    known = known.filter(~held_out(F.col("doc_id")))
    count = known.count()
    if count > sample:
        known = known.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int((1 << 20) * sample / count))
    chosen = texts(docs, id_col, text_col).join(F.broadcast(known), "doc_id").select("doc_id", "quality", "text")

    def run(batches):
        for batch in batches:
            rows = matrix(batch["text"].to_pylist())
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["quality"], pa.array(list(rows), pa.list_(pa.float32()))], ["doc_id", "quality", "features"])

    rows = sorted(tuple(r) for r in chosen.mapInArrow(run, "doc_id bigint, quality int, features array<float>").toLocalIterator())
    return Additive([r[2] for r in rows], [r[1] for r in rows])


def scored(docs, model, text_col="text"):
    """The documents with a column `score` (which replaces one of that name)."""
    rows = docs.drop("score")

    def run(batches):
        for batch in batches:
            found = model.score(matrix(batch[text_col].to_pylist()))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.float64())], [*batch.schema.names, "score"])

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField("score", T.DoubleType())]))


def classified(docs, labels, threshold=THRESHOLD, sample=SAMPLE, id_col="doc_id", text_col="text"):
    """One row per document: doc_id, held_out, score, predicted."""
    found = scored(texts(docs, id_col, text_col), fit(docs, labels, sample, id_col, text_col))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def accepted(docs, labels, threshold=THRESHOLD, sample=SAMPLE):
    """The documents the classifier doesn't reject, all columns as they are."""
    columns = docs.columns
    rows = docs.select(F.struct(*(docs[c] for c in columns)).alias("row"), docs["text"].cast("string").alias("text"))
    return scored(rows, fit(docs, labels, sample)).filter(F.col("score") >= threshold).select("row.*")

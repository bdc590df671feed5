"""SentencePiece encoding and decoding over the lattice of a model's pieces.

A text is encoded as the sequence of pieces with the greatest sum of scores (the scores of the model file). An
Aho-Corasick automaton over all pieces reads a text once; at each character its output links name the pieces that end
there, and each relaxes the best score at that place. Of equally good sequences the one whose last piece is longer wins,
place by place. Characters that no piece covers become the pieces of their UTF-8 bytes, at the least score minus 10.

Spaces are written as U+2581 and one is put before the text, as the models expect. As no piece of such a model has
U+2581 after another character, the best sequence of a text is that of its parts, each from one run of spaces to the
next; parts that repeat are remembered up to a bound. A U+2581 in the text itself is encoded by its bytes, so that
decoding gives back exactly the text that went in.

Null and empty texts have no ids. Texts of any length are encoded whole; null ids and repeated rows come back as they
are; further columns are left out.
"""

import hashlib
import zlib

import numpy as np
import pyarrow as pa

from kilowatch.llm.common import Memory, texts

SPACE = "▁"
_OWN_SPACE = "\ud800"  # stands for a U+2581 of the text; no valid text has it
CACHE = 600_000
UNKNOWN_PENALTY = 10.0


class Lattice:
    """Encoder and decoder of a model file."""

    def __init__(self, path):
        import ahocorasick
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        self.pieces = [model.id_to_piece(i) for i in range(len(model))]
        self.byte_ids = {int(self.pieces[i][3:5], 16): i for i in range(len(model)) if model.IsByte(i)}
        if len(self.byte_ids) < 256:
            raise ValueError("the model has no pieces for all bytes")
        plain = [i for i in range(len(model)) if not (model.IsByte(i) or model.IsControl(i) or model.IsUnknown(i) or model.IsUnused(i))]
        self.scores = {self.pieces[i]: (model.get_score(i), i) for i in plain}
        if any(SPACE in p.lstrip(SPACE) for p in self.scores):
            raise ValueError("pieces reach over spaces")
        self.unknown = min(s for s, _ in self.scores.values()) - UNKNOWN_PENALTY
        self.automaton = ahocorasick.Automaton()
        for piece, (score, i) in self.scores.items():
            self.automaton.add_word(piece, (len(piece), score, i))
        self.automaton.make_automaton()
        byte_of = {i: bytes([b]) for b, i in self.byte_ids.items()}
        self.raw = [byte_of.get(i, b"") for i in range(len(model))]
        for i in plain:
            self.raw[i] = self.pieces[i].replace(SPACE, " ").encode()
        self.parts = Memory(self._part, CACHE)

    def _bytes(self, char):
        return [self.byte_ids[b] for b in (SPACE if char == _OWN_SPACE else char).encode()]

    def best(self, part):
        """Ids of the best sequence of pieces, by one pass over the part."""
        n = len(part)
        score, back = [0.0] + [None] * n, [None] * (n + 1)
        done = 0

        def settle(upto):
            """Places the automaton has passed: what no piece reaches is reached by bytes."""
            nonlocal done
            while done < upto:
                done += 1
                fallback = score[done - 1] + self.unknown
                if score[done] is None or fallback > score[done]:
                    score[done], back[done] = fallback, (1, None)

        for last, (length, own, i) in self.automaton.iter(part):
            settle(last)
            end = last + 1
            start = end - length
            total = score[start] + own
            if score[end] is None or total > score[end] or total == score[end] and length > back[end][0]:
                score[end], back[end] = total, (length, i)
        settle(n)
        out, at = [], n
        while at:
            length, i = back[at]
            out.append([i] if i is not None else self._bytes(part[at - 1]))
            at -= length
        return [i for ids in reversed(out) for i in ids]

    def _part(self, part):
        return np.array(self.best(part), "<i4").tobytes()

    def encode(self, text):
        """Ids as little-endian 32-bit integers."""
        if not text:
            return b""
        if SPACE in text:
            text = text.replace(SPACE, _OWN_SPACE)
        parts, find = _parts(text), self.parts
        found = list(map(find.now.get, parts))
        if None in found:
            found = [ids if ids is not None else find(p) if len(p) < 48 else self._part(p) for p, ids in zip(parts, found)]
        return b"".join(found)

    def decode(self, ids):
        """The text of ids; bytes that are no UTF-8 become U+FFFD."""
        raw = self.raw
        return b"".join([raw[i] for i in ids])[1:].decode(errors="replace") if len(ids) else ""


def _parts(text):
    """The text with U+2581 for its spaces and one before it, cut before each run of them."""
    words = text.split(" ")
    if "" not in words:
        return [SPACE + w for w in words]
    out, marks = [], ""
    for word in words:
        marks += SPACE
        if word:
            out.append(marks + word)
            marks = ""
    return [*out, marks] if marks else out


_lattices = {}


def lattice(path):
    """One per Python worker and model."""
    if path not in _lattices:
        _lattices[path] = Lattice(path)
    return _lattices[path]


def encoded(docs, model, id_col="doc_id", text_col="text"):
    """One row per document: doc_id, ids, n_tokens, ids_crc32, decoded_sha256, exact.

    The ids are decoded again; `exact` tells whether that gave the text. ids_crc32 is of the ids as little-endian
    unsigned 32-bit integers, decoded_sha256 of the decoded text in UTF-8.
    """

    def run(batches):
        own = lattice(model)
        schema = pa.schema(
            [("doc_id", pa.int64()), ("ids", pa.list_(pa.int32())), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64()), ("decoded_sha256", pa.string()), ("exact", pa.bool_())]
        )
        for whole in batches:
            for at in range(0, len(whole), 512):
                batch = whole.slice(at, 512)
                raw, digests, exact = [], [], []
                for text in batch["text"].to_pylist():
                    raw.append(own.encode(text))
                    back = own.decode(np.frombuffer(raw[-1], "<i4").tolist())
                    digests.append(hashlib.sha256(back.encode()).hexdigest())
                    exact.append(back == text)
                sizes = np.array([len(r) // 4 for r in raw], np.int64)
                offsets = np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)
                ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(raw), "<i4"), pa.int32()))
                crc = pa.array([zlib.crc32(r) for r in raw], pa.int64())
                yield pa.RecordBatch.from_arrays([batch["doc_id"], ids, pa.array(sizes), crc, pa.array(digests, pa.string()), pa.array(exact, pa.bool_())], schema=schema)

    return texts(docs, id_col, text_col).mapInArrow(run, "doc_id bigint, ids array<int>, n_tokens bigint, ids_crc32 bigint, decoded_sha256 string, exact boolean")

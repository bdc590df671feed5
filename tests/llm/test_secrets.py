import hashlib
import math
import random
import re

from kilowatch.llm import secrets as S

PATTERNS = {
    "assign": (r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", lambda m: len(m[2]) >= 8),
    "access": (r"AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 16),
    "hex": (r"[0-9a-f]+", lambda m: len(m[0]) >= 32),
}


def plain(text):
    base = [(m.start(), k, m.end()) for k, (p, ok) in enumerate(PATTERNS.values()) for m in re.finditer(p, text) if ok(m)]
    more = []
    for m in re.finditer(S.CANDIDATE, text):
        if not re.search("[0-9]", m[0]) or any(re.fullmatch(p, m[0]) for p in S.ALLOWED):
            continue
        kind = "entropy_hex" if re.fullmatch("[0-9a-fA-F]+", m[0]) else "entropy_text"
        over = []
        for k in range(len(m[0]) - S.WINDOW + 1):
            window = m[0][k : k + S.WINDOW]
            entropy = -sum(window.count(c) / S.WINDOW * math.log2(window.count(c) / S.WINDOW) for c in set(window))
            if round(entropy, 9) >= S.THRESHOLDS[kind]:
                over.append(k)
        if over:
            span = (m.start() + over[0], S.KINDS.index(kind), m.start() + over[-1] + S.WINDOW)
            if not any(b[0] <= span[0] and span[2] <= b[2] for b in base):
                more.append(span)
    say = lambda spans: ",".join(f"{S.KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans))
    counts = [sum(b[1] == k for b in base) for k in range(3)]
    return (*counts, hashlib.sha256(say(base).encode()).hexdigest(), say(base + more), len(more)), base + more


def masked(text, spans):
    out, at = [], 0
    for start, _, end in sorted(spans):
        if start >= at:
            out += [text[at:start], S.MASK]
        at = max(at, end)
    return "".join(out) + text[at:]


def corpus():
    r = random.Random(6)
    hexes = lambda n: "".join(r.choice("0123456789abcdef") for _ in range(n))
    mixed = lambda n: "".join(r.choice(S.TEXT_CLASS) for _ in range(n))
    rows = [
        "", None, " ", f"é 🙂 password={hexes(18)} ñ", f"{hexes(40)}{hexes(40)} Token : '{mixed(12)}'", "password:token:abcdefgh secret=short", "AKIA" + "A1B2C3D4E5F6" * 2,
        f"AKIAAKIA1234 AKIA12345678901 \x01{hexes(32)}\x01\x02 PASSWD=\"x.y=z-1234\"", "secret=secret=secretsecret", f"token={hexes(64)}", "api_key: aaaaaaaaaa apikey=bbbbbbbb",
        "123e4567-e89b-12d3-a456-426614174000 some-long-path/with/words/and2024", "2024-01-01/2024-02-02/2024", "a1" * 30, mixed(5000), f"x{mixed(25)} {hexes(31)} {hexes(25)}",
        "passwordpassword=passwordpassword", "password = \n abcdefgh1", "1" * 100, "Donaudampfschifffahrtsgesellschaft", "KEY_EXAMPLE_9sdfHJK234lkjsdfLKJ", "token=" + "word " * 3000 + hexes(40),
    ]
    for _ in range(150):
        rows.append(" ".join(r.choice(["the", "ä", hexes(r.randrange(1, 50)), mixed(r.randrange(1, 60)), "Secret=" + mixed(9), "token \"" + hexes(8), "AKIA" + mixed(20).upper()]) for _ in range(r.randrange(1, 12))))
    return list(enumerate(rows)) + [(None, "token=abcdefgh"), (3, rows[3]), (3, rows[3])]


def test_equals_brute_force_and_stays_native(documents):
    rows = corpus()
    frame = S.scan(documents(rows))
    assert "Python" not in frame._jdf.queryExecution().toString()
    assert sorted(map(tuple, frame.collect()), key=str) == sorted(((i, *plain(t or "")[0]) for i, t in rows), key=str)
    assert S.scan(documents([])).collect() == []


def test_redacted_documents_lose_all_spans_and_keep_their_columns(documents):
    rows = corpus()
    frame = S.redacted(documents(rows))
    assert frame.columns == documents(rows).columns
    want = [(i, t if t is None else masked(t, plain(t)[1])) for i, t in rows]
    assert sorted(((r["doc_id"], r["text"], r["n_chars"]) for r in frame.collect()), key=str) == sorted(((i, t, None if t is None else len(t)) for i, t in want), key=str)


def test_long_runs_and_many_secrets_take_linear_time(documents):
    """Runs of a megabyte of every class, and 10,000 secrets in one text."""
    r = random.Random(7)
    run = "".join(r.choice(S.TEXT_CLASS) for _ in range(1 << 20))
    many = "".join(f"word password=abcdefgh{k} rest\n" for k in range(10_000))
    texts = [run, "ab-" * 350_000 + "ab1!", "Ab" * 500_000 + "12", "12-" * 350_000, "-" * 1_000_000 + "1", "a1b2" * 250_000, many, "AKIA" * 250_000, "A" * 1_000_000 + "1"]
    rows = {row["doc_id"]: row for row in S.scan(documents(list(enumerate(texts)))).collect()}
    kinds = [[span.split(":")[0] for span in rows[k]["spans"].split(",") if span] for k in range(len(texts))]
    assert kinds[0] == ["entropy_text"] and kinds[1] == kinds[2] == kinds[3] == kinds[4] == [] and kinds[5] == ["hex"]
    assert kinds[6] == ["assign"] * 10_000 and kinds[7] == ["access"] and kinds[8] == []
    masked_many = {row["doc_id"]: row["text"] for row in S.redacted(documents(list(enumerate(texts)))).collect()}[6]
    assert masked_many == f"word {S.MASK} rest\n" * 10_000

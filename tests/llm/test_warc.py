import base64
import hashlib
import random

from kilowatch.llm import warc as W


def test_loser_tree_merges():
    r = random.Random(1)
    for k in (0, 1, 2, 3, 5, 8, 13):
        runs = [sorted(r.randrange(50) for _ in range(r.randrange(20))) for _ in range(k)]
        assert list(W.merged(runs, lambda v: v)) == sorted(v for run in runs for v in run)


def test_url_keys():
    same = {W.url_key(u) for u in ("https://www.Example.org:443/a?b=1&a=2#x", "http://example.org/a?a=2&b=1")}
    assert same == {"org,example)/a?a=2&b=1"} and W.url_key("") == ")/"


def digest(payload):
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def test_pages_come_back_from_their_archives(spark, tmp_path):
    r = random.Random(3)
    bodies = ["", None, "x\r\n\r\nWARC/1.0\r\nContent-Length: 3\r\n\r\n", "<p>é 🙂</p>" * 500, "a", "b"]
    rows = [(k, f"http://h{r.randrange(6)}.org/p", r.choice(bodies) if k % 3 else f"body {k}") for k in range(400)]
    rows += [(None, "http://n.org", "a"), (None, None, "only without id"), (700, "u", "twice"), (700, "u", "twice")]
    frame = spark.createDataFrame([(*x, "c", 1) for x in rows], "page_id bigint, url string, html string, digest string, bytes int").repartition(5)
    want = []
    for page, url, html in rows:
        raw = (html or "").encode()
        ids = [p for p, _, h in rows if (h or "").encode() == raw and p is not None]
        last = max(ids, default=None)
        want.append((page, len(raw), digest(raw), "response" if page == last else "revisit", None if page == last else last, W.url_key(url or "")))
    path = str(tmp_path / "w")
    W.write_archives(frame, path, records_per_file=40, file_bytes=40 * 1000)
    index = W.capture_index(spark, path, 7)
    found = index.collect()
    assert sorted((tuple(x[c] for c in ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "urlkey")) for x in found), key=str) == sorted(want, key=str)
    order = [(x["urlkey"], x["captured_at"], x["page_id"] is not None, x["page_id"] or 0) for x in found]
    assert order == sorted(order)  # collected partition by partition
    assert sum(x["captures"] for x in W.histories(index).collect()) == len(rows)
    for name, offset, length in [(x["file"], x["offset"], x["length"]) for x in found[:20]]:
        raw = (tmp_path / "w" / name).read_bytes()[offset : offset + length]
        assert raw.startswith(b"WARC/1.0\r\n") and raw.endswith(b"\r\n\r\n")
    W.write_archives(frame.limit(0), path + "0")
    assert W.capture_index(spark, path + "0").collect() == []
    W.write_archives(frame, path + "5", min_bytes=10**6)
    assert {x["record_type"] for x in W.capture_index(spark, path + "5").collect()} == {"response"}


def test_merging_holds_a_bounded_number_of_rows(monkeypatch):
    """Runs of many archives, handed over in pieces: never more rows in lists than the room and one batch."""
    r = random.Random(4)
    names = [f"f{k}" for k in range(9)]
    entries = [(f"org,h{r.randrange(30)})/", f"2024-01-01T00:00:{r.randrange(60):02d}Z", r.choice([None, k]), 1, "d", "response", None, r.choice(names), k, 5) for k in range(3000)]
    pieces = [sorted((e for e in entries if e[7] == name), key=W._place) for name in names]
    batches = [p[at : at + 50] for at in range(0, 400, 50) for p in pieces if p[at : at + 50]]
    most = []
    ascending = W._ascending
    monkeypatch.setattr(W, "ROOM", 200)
    monkeypatch.setattr(W, "WAYS", 3)
    monkeypatch.setattr(W, "_ascending", lambda piece: most.append(len(piece)) or ascending(piece))

    class Frame:
        """Stands for the dealt frame: hands the task's function its batches."""

        sparkSession = None

        def repartitionByRange(self, *_):
            return self

        def mapInArrow(self, run, _):
            return run(iter(W.emit(b, W.ENTRY) for b in batches))

    found = [row for batch in W.merge_runs(Frame(), 1) for row in zip(*(c.to_pylist() for c in batch.columns))]
    assert found == sorted(entries, key=W._place)
    assert max(most) <= 250 and len(most) > 20


def test_dates_are_utc_in_any_session(spark, tmp_path):
    frame = spark.createDataFrame([(k, f"http://h.org/{k}", "x") for k in range(3)], "page_id bigint, url string, html string")
    zone = spark.conf.get("spark.sql.session.timeZone")
    found = []
    try:
        for k, name in enumerate(("UTC", "Asia/Kolkata", "America/New_York")):
            spark.conf.set("spark.sql.session.timeZone", name)
            W.write_archives(frame, str(tmp_path / str(k)))
            found.append(sorted((x["page_id"], x["captured_at"]) for x in W.capture_index(spark, str(tmp_path / str(k))).collect()))
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
    assert found[0] == [(k, f"2024-01-01T00:00:0{k}Z") for k in range(3)] and found[1] == found[2] == found[0]

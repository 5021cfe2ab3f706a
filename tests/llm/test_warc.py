"""Archives: bytes that come back, captures against plain loops over the records."""

import base64
import gzip
import hashlib
import random
from collections import defaultdict

from watchlake.llm import warc as W

SCHEMA = "page_id long, url string, html string, digest string, capture_id int"
HTML = "<p>é</p>\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"


def pages_of(spark, rows):
    # Two columns clash with names the operator uses.
    return spark.createDataFrame([(*r, "mine", 1) for r in rows], SCHEMA)


def expected(rows, revisit_from=0):
    """Rows as (page_id, bytes, digest, type, refers_to), by sorting equal payloads."""
    groups = defaultdict(list)
    for page_id, url, html in rows:
        groups[html or ""].append((page_id is None, page_id or 0, url is None, url or "", page_id))
    out = []
    for html, own in groups.items():
        raw = html.encode()
        digest = base64.b32encode(hashlib.sha1(raw).digest()).decode()
        for i, row in enumerate(sorted(own)):
            again = i > 0 and len(raw) >= revisit_from
            out.append((row[4], len(raw), digest, "revisit" if again else "response", sorted(own)[0][4] if again else None))
    return sorted(out, key=str)


ROWS = [
    (5, "http://a.org/x y\n", HTML), (3, "http://a.org/2", HTML), (9, None, HTML), (1, "http://b.org/", None), (2, "http://b.org/", ""),
    (4, "é", "\n"), (6, "u", "\r"), (7, "u", "a\nb\n"), (8, "u", "x" * 70_000), (None, "n1", HTML), (None, None, "only"), (None, "n2", "only"),
    (11, "same", "twice"), (11, "same", "twice"), (11, "same", "twice"), (11, "other", "twice"), (12, "u", "\x00 𠀀"),
]


def test_round_trip(spark):
    got = W.archive_round_trip(pages_of(spark, ROWS).repartition(4))
    assert got.columns == ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    assert sorted(map(tuple, got.collect()), key=str) == expected(ROWS)


def test_small_payloads_are_all_responses(spark, tmp_path):
    W.write_archives(pages_of(spark, ROWS), str(tmp_path / "a"), "2024-01-01T00:00:00Z", revisit_from=6)
    got = W.page_captures(W.assemble(W.read_archives(spark, str(tmp_path / "a"))))
    assert sorted(map(tuple, got.collect()), key=str) == expected(ROWS, 6)


def test_copies_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(W, "_COPIES", 3)
    rows = [(1, "u", "t")] * 10 + [(2, "u", "t")] * 4 + [(3, "u", "s")] * 3
    assert sorted(map(tuple, W.archive_round_trip(pages_of(spark, rows)).collect()), key=str) == expected(rows)


def test_an_empty_table(spark):
    assert W.archive_round_trip(pages_of(spark, [])).collect() == []


def test_payloads_and_urls_come_back(spark, tmp_path):
    W.write_archives(pages_of(spark, ROWS), str(tmp_path / "a"), "2024-01-01T00:00:00Z")
    captures = W.assemble(W.read_archives(spark, str(tmp_path / "a"))).collect()
    assert len(captures) == len(ROWS)
    payloads = {bytes(c.captured.payload) for c in captures if c.captured.record_type == "response"}
    assert payloads == {(html or "").encode() for *_, html in ROWS}
    for c in captures:
        assert [r.record_type for r in c.requests] == ["request"] and [r.record_type for r in c.metadata] == ["metadata"] and c.others == []
        assert c.date == "2024-01-01T00:00:00Z"
    assert {c.target_uri for c in captures} >= {"http://a.org/x%20y%0A", None, "é"}


def record(kind, name, to=(), block=b"", more=""):
    head = f"WARC/1.0\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <{name}>\r\n" + "".join(f"WARC-Concurrent-To: <{t}>\r\n" for t in to)
    return head.encode() + more.encode() + b"Content-Length: %d\r\n\r\n" % len(block) + block + b"\r\n\r\n"


def test_a_stream_for_each_record_and_foreign_headers(spark, tmp_path):
    body = b"4\r\nwiki\r\n5;x=1\r\npedia\r\n0\r\n\r\n"
    http = b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n" + body
    kinds = [record("warcinfo", "i", block=b"software: x"), record("response", "r", block=http, more="Content-Type: application/http\r\nX-Long: a\r\n b\r\n"),
             record("request", "q", ["r"], b"GET"), record("resource", "s", block=bytes(range(256)))]
    (tmp_path / "w").mkdir()
    (tmp_path / "w" / "x.warc.gz").write_bytes(b"".join(gzip.compress(k) for k in kinds))
    # Cut off within its last record; read by itself.
    (tmp_path / "w" / "y.warc.gz").write_bytes(gzip.compress(record("response", "z", block=b"ok") + record("response", "cut", block=b"x" * 99)[:-60]))
    got = {r.record_id: r for r in W.read_archives(spark, str(tmp_path / "w")).collect()}
    assert set(got) == {"i", "r", "q", "s", "z"}
    assert bytes(got["r"].payload) == b"wikipedia" and bytes(got["s"].payload) == bytes(range(256)) and bytes(got["z"].payload) == b"ok"
    assert got["q"].concurrent_to == ["r"]


def test_pieces_of_any_size_give_the_same_records():
    draw, names = random.Random(3), [f"n{i}" for i in range(40)]
    data = b"".join(record("resource", n, block=draw.randbytes(draw.randrange(200))) + b"junk\r\n" * (i % 3) for i, n in enumerate(names))
    whole = W.RecordParser().feed(data)
    assert len(whole) == 40
    for _ in range(20):
        parser, at, found = W.RecordParser(), 0, []
        while at < len(data):
            step = draw.choice([1, 7, 50, 400])
            found += parser.feed(data[at : at + step])
            at += step
        assert found == whole


def brute_captures(records):
    """Nearest capture along links in both directions, by widening rings."""
    near = defaultdict(set)
    for name, _, to in records:
        for other in to:
            near[name].add(other)
            near[other].add(name)
    capture = {n: n for n, kind, _ in records if kind in W.CAPTURED}
    ring = dict(capture)
    known = {n for n, *_ in records}
    while ring:
        ahead = {}
        for n, c in ring.items():
            for other in near[n] & known - set(capture):
                ahead[other] = min(c, ahead.get(other, c))
        capture |= ahead
        ring = ahead
    return capture | {n: n for n, *_ in records if n not in capture}


def test_assembly_follows_links_both_ways(spark):
    draw = random.Random(5)
    for trial in range(2):
        names = [f"x{draw.randrange(10**6)}" for _ in range(60)]
        kinds = [draw.choice(["response", "request", "metadata", "metadata", "conversion"]) for _ in names]
        records = [(n, k, [draw.choice(names) for _ in range(draw.randrange(3))] + ["absent"] * (trial == 1)) for n, k in zip(names, kinds)]
        frame = spark.createDataFrame(records, "record_id string, record_type string, concurrent_to array<string>")
        assert {tuple(r) for r in W.capture_of(frame).collect()} == set(brute_captures(records).items())


def test_a_capture_of_many_records_goes_on_in_further_rows(spark, monkeypatch):
    monkeypatch.setattr(W, "MEMBERS", 5)
    schema = W.RECORD_FIELDS
    row = lambda name, kind, to: (name, kind, to, None, "u", "d", None, 0, 0, None, None)
    rows = [row("a", "response", [])] + [row(f"m{i:02}", "metadata", ["a"]) for i in range(23)] + [row("m03", "metadata", ["a"])]
    rows += [row(None, "response", []), row(None, "request", []), row("alone", "metadata", [])]
    captures = W.assemble(spark.createDataFrame(rows, schema)).collect()
    of_a = [c for c in captures if c.capture_id == "a"]
    assert sorted(m.record_id for c in of_a for m in c.metadata) == [f"m{i:02}" for i in range(23)]
    assert len(of_a) > 1 and all(c.captured.record_id == "a" for c in of_a) and len({c.part for c in of_a}) == len(of_a)
    assert sorted((c.capture_id or "-", c.captured is None) for c in captures if c.capture_id != "a") == [("-", False), ("-", True), ("alone", True)]


def test_digests_are_those_of_the_bytes(spark):
    texts = ["", "a", "é" * 100, "x" * 1000]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", W.base32_of_hex(W.F.sha1("t")).alias("d")).collect()
    assert {r.t: r.d for r in got} == {t: base64.b32encode(hashlib.sha1(t.encode()).digest()).decode() for t in texts}



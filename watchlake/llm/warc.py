"""Web archives (WARC): written from pages, read back, and assembled into captures.

Writing gives every capture three records that name each other by concurrent-to
identifiers: its request, its response (or a revisit of an equal payload's response)
and a metadata record with the page's own columns. Archives are gzip streams that
Spark's text sink commits, so any store that Spark reaches will do, and a lost task
leaves nothing behind. Reading streams each archive through one task, record by record.
Assembly joins records through concurrent-to identifiers, whichever end names the
other, and gives one nested row per capture.
"""

import base64
import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from watchlake.session import new_work_folder

VERSION = "WARC/1.1"
REVISIT_FROM = 0
#: Records that stand beside a capture's response in one nested row; further ones follow in more rows.
MEMBERS = 1_000
_COPIES = 10_000
# The end of a line and of a record, and the profile of a revisit of an equal payload.
CRLF = "\r\n"
RECORD_END = "\r\n\r\n"
SAME_PAYLOAD = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
# The types a capture is named after.
CAPTURED = ("response", "revisit", "resource")
_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"

RECORD_FIELDS = (
    "record_id string, record_type string, concurrent_to array<string>, refers_to string, target_uri string,"
    " date string, content_type string, block_bytes long, payload_bytes long, payload_digest string, payload binary"
)


# --- writing ----------------------------------------------------------------


def base32_of_hex(digits: Column) -> Column:
    """Upper-case base32 of a digest of 40 hexadecimal digits: five of them make four signs."""

    def signs(i: Column) -> Column:
        value = F.conv(F.substr(digits, i * 5 + 1, F.lit(5)), 16, 10).cast("int")
        one = lambda shift: F.substr(F.lit(_BASE32), (F.shiftright(value, shift).bitwiseAND(31) + 1), F.lit(1))
        return F.concat(one(15), one(10), one(5), one(0))

    return F.array_join(F.transform(F.sequence(F.lit(0), F.lit(7)), signs), "")


def _urn(*parts: Column | str) -> Column:
    """A record identifier that depends on ``parts`` alone, so a task that runs again gives the same."""
    h = F.sha2(F.concat_ws("|", *[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts]), 256)
    cut = lambda low, n: F.substr(h, F.lit(low), F.lit(n))
    # Version 8 of the scheme: any bits, here those of a digest.
    uuid = F.concat_ws("-", cut(1, 8), cut(9, 4), F.concat(F.lit("8"), cut(14, 3)), F.concat(F.lit("a"), cut(18, 3)), cut(21, 12))
    return F.concat(F.lit("urn:uuid:"), uuid)


def _uri(url: Column) -> Column:
    """A URL that fits a header line: white space and control signs are percent-encoded."""
    parts = F.split(url, "")
    unsafe = F.ascii(F.lit(" "))
    escaped = F.transform(
        parts, lambda c: F.when((F.ascii(c) <= unsafe) | (c == "\x7f"), F.concat(F.lit("%"), F.lpad(F.hex(F.ascii(c)), 2, "0"))).otherwise(c)
    )
    return F.when(url.rlike(r"[\x00-\x20\x7f]"), F.array_join(escaped, "")).otherwise(url)


def _record(headers: list[tuple[str, Column | str]], block: Column) -> Column:
    """One record without its end; headers that are null are left out."""
    lines = [F.concat(F.lit(f"{name}: "), F.lit(value) if isinstance(value, str) else value) for name, value in headers]
    size = F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string"))
    return F.concat(F.concat_ws(CRLF, F.lit(VERSION), *lines, size), F.lit(RECORD_END), block)


def _kinds(captures: DataFrame, revisit_from: int) -> DataFrame:
    """Each distinct row's copies, and the row whose first copy is the response of its payload.

    Rows without an id come last. Among rows of the smallest id that share a payload but
    not a URL, the smallest URL's is the response.
    """
    rows = captures.groupBy("row_key").agg(
        F.first("page_id").alias("page_id"),
        F.first("url").alias("url"),
        F.first("digest").alias("digest"),
        F.first("sha1").alias("sha1"),
        F.first("n_bytes").alias("n_bytes"),
        F.count(F.lit(1)).alias("copies"),
    )
    order = F.struct(F.col("page_id").isNull(), "page_id", F.col("url").isNull(), "url", "row_key")
    firsts = rows.groupBy("digest").agg(F.min(order).alias("_first")).select("digest", F.col("_first.row_key").alias("first_key"))
    same = rows.join(firsts, "digest")
    leads = F.col("row_key") == F.col("first_key")
    return same.withColumn(
        "responses", F.when(F.col("n_bytes") < revisit_from, F.col("copies")).when(leads, F.lit(1)).otherwise(F.lit(0)).cast("long")
    )


def _numbered(rows: DataFrame, low: Column, high: Column) -> DataFrame:
    """A row for each ``copy`` from ``low`` up to ``high``, in blocks, so no array gets long."""
    blocks = rows.where(low < high).withColumn("_block", F.explode(F.sequence(F.expr("0L"), F.floor((high - low - 1) / _COPIES).cast("long"))))
    start = low + F.col("_block") * _COPIES
    return blocks.withColumn("copy", F.explode(F.sequence(start, F.least(start + _COPIES, high) - 1))).drop("_block")


def _three_records(kind: str, html: Column | None) -> Column:
    """The records of one capture; ``html`` is a response's payload."""
    own = lambda what: _urn(what, F.col("row_key"), F.col("copy"))
    answer, uri = own("answer"), _uri(F.col("url"))
    shared = [("WARC-Target-URI", uri), ("WARC-Date", F.col("captured_at"))]
    digest = F.concat(F.lit("sha1:"), base32_of_hex(F.col("sha1")))
    head = F.concat(
        F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.col("n_bytes").cast("string"), F.lit(RECORD_END)
    )
    http = ("Content-Type", "application/http; msgtype=response")
    if html is None:
        named = [("WARC-Refers-To", F.concat(F.lit("<"), _urn("answer", F.col("first_key"), F.lit(0)), F.lit(">"))), ("WARC-Profile", SAME_PAYLOAD)]
    else:
        named = []
    wrapped = F.concat(F.lit("<"), answer, F.lit(">"))
    main = _record(
        [("WARC-Type", kind), ("WARC-Record-ID", wrapped), *shared, ("WARC-Payload-Digest", digest), *named, http], head if html is None else F.concat(head, html)
    )
    request = _record(
        [("WARC-Type", "request"), ("WARC-Record-ID", F.concat(F.lit("<"), own("request"), F.lit(">"))), ("WARC-Concurrent-To", wrapped), *shared,
         ("Content-Type", "application/http; msgtype=request")],
        F.concat(F.lit("GET "), F.coalesce(uri, F.lit("*")), F.lit(f" HTTP/1.1{RECORD_END}")),
    )
    about = F.to_json(F.struct("page_id", "url"), {"ignoreNullFields": "false"})
    metadata = _record(
        [("WARC-Type", "metadata"), ("WARC-Record-ID", F.concat(F.lit("<"), own("metadata"), F.lit(">"))),
         ("WARC-Concurrent-To", wrapped), *shared, ("Content-Type", "application/json")],
        about,
    )
    return F.array(request, main, metadata)


def write_archives(pages: DataFrame, path: str, captured_at: str, revisit_from: int = REVISIT_FROM) -> None:
    """Archives at ``path`` with three records for every row of ``pages`` (page_id, url, html).

    The payload is the html (null: empty). Of rows with equal payloads of at least
    ``revisit_from`` bytes the one of the smallest page_id is written as response, the others
    as revisits without a payload; rows that repeat are written as often, one of them
    as response at most. A null url has no header. ``captured_at`` is the date of all
    records. The html is moved once, to the row of its key; rows of equal key meet before.
    """
    text = F.coalesce(F.col("html").cast("string"), F.lit(""))
    texts = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), text.alias("html"))
    # Digests go through a generator, so that they are computed once for each row.
    digests = F.struct(F.octet_length("html").cast("long").alias("n_bytes"), F.sha2("html", 256).alias("digest"), F.sha1("html").alias("sha1"))
    key = F.sha2(F.concat(F.col("digest"), F.to_json(F.struct("page_id", "url"))), 256)
    captures = texts.select("*", F.inline(F.array(digests))).withColumn("row_key", key)
    kinds = _kinds(captures.drop("html"), revisit_from).withColumn("captured_at", F.lit(captured_at))
    payloads = captures.groupBy("row_key").agg(F.first("html").alias("html"))
    responses = _numbered(kinds.where("responses > 0").join(payloads, "row_key"), F.expr("0L"), F.col("responses"))
    revisits = _numbered(kinds, F.col("responses"), F.col("copies"))
    records = responses.select(F.explode(_three_records("response", F.col("html"))).alias("value")).unionByName(
        revisits.select(F.explode(_three_records("revisit", None)).alias("value"))
    )
    records.write.option("lineSep", RECORD_END).option("compression", "gzip").option("zlib.compress.level", "THREE").text(path)


# --- reading ----------------------------------------------------------------


def _header_fields(head: bytes) -> dict[str, list[str]]:
    """Header names in lower case with all their values; a line that starts with white space continues."""
    fields: dict[str, list[str]] = {}
    values: list[str] = []
    for line in head.decode("utf-8", "replace").split("\n")[1:]:
        line = line.rstrip("\r")
        if line[:1] in (" ", "\t") and values:
            values[-1] += " " + line.strip()
        elif ":" in line:
            name, _, value = line.partition(":")
            values = fields.setdefault(name.strip().lower(), [])
            values.append(value.strip())
    return fields


def _bare(identifier: str) -> str:
    return identifier.strip().removeprefix("<").removesuffix(">")


def _dechunked(body: bytes) -> bytes:
    """The body of a chunked message; what follows a damaged length is dropped."""
    out, at = [], 0
    while True:
        end = body.find(b"\r\n", at)
        try:
            n = int(body[at:end].split(b";")[0], 16) if end >= 0 else 0
        except ValueError:
            n = 0
        if n <= 0:
            return b"".join(out)
        out.append(body[end + 2 : end + 2 + n])
        at = end + 2 + n + 2


def record_of(head: bytes, block: bytes, keep_payload: bool = True) -> tuple:
    """A record's row. Of HTTP messages the payload is the body, unchunked; a revisit has none."""
    fields = _header_fields(head)
    first = lambda name: (fields.get(name) or [None])[0]
    kind, content = (first("warc-type") or "").lower(), first("content-type") or ""
    payload: bytes | None = block
    if content.lower().startswith("application/http"):
        http_head, mark, payload = block.partition(b"\r\n\r\n")
        if b"transfer-encoding: chunked" in http_head.lower():
            payload = _dechunked(payload)
    if kind == "revisit":
        payload = None
    digest = None
    if payload is not None:
        digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    elif first("warc-payload-digest"):
        digest = first("warc-payload-digest").split(":")[-1]
    return (
        _bare(first("warc-record-id")) if first("warc-record-id") else None,
        kind,
        [_bare(v) for v in fields.get("warc-concurrent-to", [])],
        _bare(first("warc-refers-to")) if first("warc-refers-to") else None,
        first("warc-target-uri"),
        first("warc-date"),
        content or None,
        len(block),
        len(payload) if payload is not None else None,
        digest,
        payload if keep_payload or kind not in CAPTURED else None,
    )


class RecordParser:
    """Records from an archive's bytes, which come in pieces of any size."""

    def __init__(self):
        self.pieces: list[bytes] = []
        self.size = 0
        self.wanted = 1
        # Whether the first byte held may start a record.
        self.fresh = True

    def feed(self, piece: bytes) -> list[tuple[bytes, bytes]]:
        """(header, block) of every record that is whole by now."""
        self.pieces.append(piece)
        self.size += len(piece)
        if self.size < self.wanted:
            return []
        data, at, out = b"".join(self.pieces), 0, []
        while True:
            start = self._start(data, at)
            if start < 0:
                # The next piece may go on with a start that this one has begun.
                rest = max(at, len(data) - 5)
                self.fresh = rest == at and (at > 0 or self.fresh)
                at, self.wanted = rest, 0
                break
            end = data.find(b"\r\n\r\n", start)
            if end < 0:
                at, self.wanted, self.fresh = start, 0, True
                break
            head = data[start:end]
            length = (_header_fields(head).get("content-length") or [""])[0]
            if not length.isdecimal():
                at = end + 4
                continue
            if len(data) < end + 4 + int(length):
                at, self.wanted, self.fresh = start, end + 4 + int(length) - start, True
                break
            at = end + 4 + int(length)
            out.append((head, data[end + 4 : at]))
        self.pieces, self.size = [data[at:]], len(data) - at
        return out

    def _start(self, data: bytes, low: int) -> int:
        """Where the next record starts: at the next ``WARC/`` that begins a line or follows a record."""
        at = low
        while True:
            at = data.find(b"WARC/", at)
            if at < 0 or (at == low and (low > 0 or self.fresh)) or (at > 0 and data[at - 1] == 0x0A):
                return at
            at += 1


def read_archives(spark: SparkSession, path: str, keep_payload: bool = True) -> DataFrame:
    """The records of all archives at ``path``, see ``RECORD_FIELDS``.

    Archives are compressed (``.gz``, in one stream or one for each record), so that
    each is read by one task from its start; memory holds a batch and a record. Bytes between
    records are skipped, a record that its file cuts off is left out. ``payload_digest`` is that of
    the payload as read, for revisits the one they state. Without ``keep_payload`` captures come without
    their payload, whose size and digest are taken all the same.
    """
    lines = spark.read.option("lineSep", "\n").text(path)
    lines = lines.select(F.xxhash64(F.input_file_name()).alias("file"), F.col("value").cast("binary").alias("line"))
    names = [f.strip().split()[0] for f in RECORD_FIELDS.split(",")]
    kinds = [pa.string(), pa.string(), pa.list_(pa.string()), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary()]

    def run(batches):
        parser, current = RecordParser(), None
        for batch in batches:
            files, all_lines = batch.column(0).to_numpy(), batch.column(1).to_pylist()
            low = 0
            while low < len(all_lines):
                if files[low] != current:
                    parser, current = RecordParser(), files[low]
                high = low + 1 if files[-1] != current else len(all_lines)
                while high < len(all_lines) and files[high] == current:
                    high += 1
                rows, held = [], 0
                for head, block in parser.feed(b"\n".join(all_lines[low:high]) + b"\n"):
                    rows.append(record_of(head, block, keep_payload))
                    held += len(block)
                    if held > 16_000_000:
                        yield _batch(rows, names, kinds)
                        rows, held = [], 0
                if rows:
                    yield _batch(rows, names, kinds)
                low = high

    return lines.mapInArrow(run, RECORD_FIELDS)


def _batch(rows: list[tuple], names: list[str], kinds: list[pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(column, kind) for column, kind in zip(zip(*rows), kinds)], names)


# --- assembly ---------------------------------------------------------------


def capture_of(records: DataFrame) -> DataFrame:
    """(record_id, capture_id): the response, revisit or resource that a record was made with.

    Concurrent-to identifiers hold in both directions. A record goes to the nearest capture along
    them, ties to the smallest identifier; one that reaches none is its own capture. Steps are
    joins, repeated while the last one found something.
    """
    from watchlake.llm.common import saved

    spark = records.sparkSession
    nodes = records.where("record_id is not null").select("record_id", F.col("record_type").isin(*CAPTURED).alias("main"), "concurrent_to")
    nodes = saved(nodes.groupBy("record_id").agg(F.max("main").alias("main"), F.flatten(F.collect_set("concurrent_to")).alias("concurrent_to")), "warc-nodes")
    named = nodes.select("record_id", F.explode("concurrent_to").alias("other")).where("record_id != other")
    links = saved(named.unionByName(named.select(F.col("other").alias("record_id"), F.col("record_id").alias("other"))).distinct(), "warc-links")
    reached = saved(nodes.where("main").select("record_id", F.col("record_id").alias("capture_id")), "warc-captures")
    waiting = nodes.where("not main").select("record_id")
    parts, last = [reached], reached
    while not waiting.isEmpty():
        steps = links.join(last.withColumnRenamed("record_id", "other"), "other").groupBy("record_id").agg(F.min("capture_id").alias("capture_id"))
        last = saved(steps.join(waiting, "record_id"), "warc-captures")
        if last.isEmpty():
            break
        parts.append(last)
        waiting = saved(waiting.join(last.select("record_id"), "record_id", "left_anti"), "warc-waiting")
    alone = waiting.select("record_id", F.col("record_id").alias("capture_id"))
    out = spark.createDataFrame([], alone.schema)
    for part in [*parts, alone]:
        out = out.unionByName(part)
    return out


def assemble(records: DataFrame) -> DataFrame:
    """One nested row per capture: (capture_id, part, target_uri, date, captured, requests, metadata, others).

    ``captured`` is the response, revisit or resource; null where records that name each other have
    none. The other records come as arrays of structs, by record_id. A capture
    with more than ``MEMBERS`` of them goes on in further rows, ``part`` 1 and up, which repeat
    all but the arrays. Records that repeat count once; those without an identifier are captures of their own,
    by their place in the result alone.
    """
    columns = records.columns
    named = records.where("record_id is not null").dropDuplicates(["record_id"]).join(capture_of(records), "record_id")
    nameless = records.where("record_id is null").select(*columns, F.lit(None).cast("string").alias("capture_id"))
    main = F.col("record_type").isin(*CAPTURED)
    whole = F.struct(*columns)
    captured = named.where(main).select("capture_id", whole.alias("captured"))
    members = named.where(~main).select("capture_id", "record_id", whole.alias("record"))
    sizes = members.groupBy("capture_id").agg(F.count(F.lit(1)).alias("n"))
    parts = F.ceil(F.col("n") / MEMBERS)
    dealt = members.join(sizes, "capture_id").withColumn("part", F.when(parts > 1, F.pmod(F.xxhash64("record_id"), parts)).otherwise(F.lit(0)).cast("long"))
    kind = F.col("record.record_type")
    of_kind = lambda test: F.array_sort(F.collect_list(F.when(test, F.struct(F.col("record_id").alias("id"), "record"))))
    beside = (
        dealt.groupBy("capture_id", "part")
        .agg(
            of_kind(kind == "request").alias("requests"),
            of_kind(kind == "metadata").alias("metadata"),
            of_kind(~kind.isin("request", "metadata")).alias("others"),
        )
        .withColumns({c: F.transform(c, lambda r: r["record"]) for c in ("requests", "metadata", "others")})
    )
    joined = captured.join(beside, "capture_id", "full").withColumn("part", F.coalesce("part", F.lit(0).cast("long")))
    alone = nameless.select("capture_id", F.when(main, whole).alias("captured"), F.lit(0).cast("long").alias("part"), *[
        F.when(test & ~main, F.array(whole)).alias(c)
        for c, test in (("requests", F.col("record_type") == "request"), ("metadata", F.col("record_type") == "metadata"), ("others", ~F.col("record_type").isin("request", "metadata")))
    ])
    both = joined.unionByName(alone)
    empty = F.array().cast(both.schema["requests"].dataType)
    both = both.withColumns({c: F.coalesce(c, empty) for c in ("requests", "metadata", "others")})
    some = F.coalesce("captured", F.element_at(F.concat("requests", "metadata", "others"), 1))
    return both.select(
        "capture_id", "part", some["target_uri"].alias("target_uri"), some["date"].alias("date"), "captured", "requests", "metadata", "others"
    )


def page_captures(captures: DataFrame) -> DataFrame:
    """A row per captured page, from the metadata records of ``write_archives``.

    (page_id, payload_bytes, payload_digest, record_type, refers_to): a revisit takes the size
    from the response that it refers to, and that page's id.
    """
    about = F.from_json(F.col("metadata")[0]["payload"].cast("string"), "page_id long, url string")
    own = captures.where("captured is not null and part = 0").select(
        F.col("captured.record_id").alias("record_id"),
        F.col("captured.record_type").alias("record_type"),
        F.col("captured.refers_to").alias("named"),
        F.col("captured.payload_bytes").alias("payload_bytes"),
        F.col("captured.payload_digest").alias("payload_digest"),
        about["page_id"].alias("page_id"),
    )
    first = own.where("record_type != 'revisit'").select(
        F.col("record_id").alias("named"), F.col("page_id").alias("refers_to"), F.col("payload_bytes").alias("first_bytes")
    )
    return own.join(first, "named", "left").select(
        "page_id",
        F.coalesce("payload_bytes", "first_bytes").alias("payload_bytes"),
        "payload_digest",
        "record_type",
        "refers_to",
    )


def archive_round_trip(pages: DataFrame, captured_at: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """``pages`` written as archives, read back, assembled, a row per page."""
    from watchlake.llm.common import saved

    spark = pages.sparkSession
    path = new_work_folder(spark, "archives")
    write_archives(pages, path, captured_at)
    records = saved(read_archives(spark, path, keep_payload=False), "warc-records")
    return page_captures(saved(assemble(records), "warc-assembled"))

"""Byte-exact removal of long passages that an earlier document holds.

Every byte under a ``LENGTH``-byte string that also starts in a document of a smaller
id goes. Three steps keep the work near the size of what repeats:

1. Exact copies are settled by their digests; one document of each text goes on.
2. Each window of ``LENGTH`` bytes has an anchor: the ``ANCHOR`` bytes in it of the
   smallest hash, the first of equals. Equal windows have equal anchors, so only
   windows whose anchor occurs in two documents can repeat; their bytes, one row for
   each anchor and place, are dealt out by the anchor's hash. What repeats within a
   batch is settled before it is sent, and anchors with very many places are dealt
   over several groups.
3. A group sorts its windows, which are suffixes cut at ``LENGTH`` bytes, by
   deep-shallow sorting: multikey steps of eight bytes to a shallow depth part most of
   them, and blind tries over what still agrees order the rest: a group is compared
   with one of its members once, and parts by where and how each differs.
   In each class of equal windows the smallest document is the one that keeps.
   For an anchor in several groups the keepers meet once more, by digest.
"""

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from watchlake.llm.common import mix64, saved
from watchlake.operators.sizing import broadcast_if_small

LENGTH = 50
ANCHOR = 24
HASH_BITS = 48
GROUP_ROWS = 20_000
HOT_ROWS = 2_000
# A fixed 16 MB filter; beyond so many shared anchors an exact join replaces it.
FILTER_BITS = 27
FILTER_ANCHORS = 1 << 24
SHALLOW = 16
_BLOCK_BYTES = 1 << 22

# ---- anchors ---------------------------------------------------------------


def _anchor_hashes(line: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the ``ANCHOR`` bytes from each place of a padded line on."""
    n = len(line) - ANCHOR + 1
    total = np.zeros(n, np.uint64)
    for place in range(0, ANCHOR, 8):
        total += np.ndarray((n,), "<u8", line, place, (1,))
        total *= np.uint64(0x9E3779B97F4A7C15)
        total ^= total >> np.uint64(29)
    total *= np.uint64(0xBF58476D1CE4E5B9)
    total ^= total >> np.uint64(32)
    return total


def _sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """The minimum over each ``width`` neighbours from a place on; shorter by width - 1."""
    reach = 1
    while 2 * reach <= width:
        values = np.minimum(values[:-reach], values[reach:])
        reach *= 2
    rest = width - reach
    return np.minimum(values[: len(values) - rest], values[rest:]) if rest else values


def anchored_windows(line: bytes, edges: np.ndarray):
    """The anchors of all windows of a line of texts.

    ``edges`` are the texts' bounds. Returns (text, hash, first, last): the text of
    an anchor's windows, its hash (the upper ``HASH_BITS``, not negative), and the first
    and last place a window starts at.
    """
    none = np.zeros(0, np.int64)
    if len(line) < LENGTH:
        return none, none, none, none
    hashes = _anchor_hashes(np.frombuffer(line, np.uint8))
    ranked = (hashes & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(hashes), dtype=np.uint64)
    at = (_sliding_min(ranked, LENGTH - ANCHOR + 1) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    inside = np.zeros(len(at) + 1, np.int32)
    begin, end = edges[:-1], edges[1:] - LENGTH + 1
    long_enough = end > begin
    np.add.at(inside, begin[long_enough], 1)
    np.add.at(inside, end[long_enough], -1)
    inside = np.cumsum(inside[:-1]) > 0
    places = np.flatnonzero(inside)
    if not len(places):
        return none, none, none, none
    anchors = at[places]
    new = np.concatenate(([True], (anchors[1:] != anchors[:-1]) | (places[1:] != places[:-1] + 1)))
    first = places[new]
    last = np.concatenate((places[np.flatnonzero(new)[1:] - 1], places[-1:]))
    text = np.searchsorted(edges, first, "right") - 1
    return text, (hashes[anchors[new]] >> np.uint64(64 - HASH_BITS)).astype(np.int64), first, last


def _blocks(texts: list[bytes]):
    """(number of the first text, line, edges) of texts joined up to a few megabytes."""
    start = 0
    while start < len(texts):
        stop, size = start, 0
        while stop < len(texts) and (stop == start or size + len(texts[stop]) <= _BLOCK_BYTES):
            size += len(texts[stop])
            stop += 1
        lengths = np.fromiter(map(len, texts[start:stop]), np.int64, stop - start)
        yield start, b"".join(texts[start:stop]), np.concatenate(([0], np.cumsum(lengths)))
        start = stop


def _bytes_of(column) -> list[bytes]:
    return [(t or "").encode("utf-8", "surrogatepass") for t in column.to_pylist()]


def _anchor_counts(texts: DataFrame) -> DataFrame:
    """(h, n) for each anchor of each row of ``texts`` (doc, tid, text): how many places it has there."""

    def run(batches):
        for batch in batches:
            for _, line, edges in _blocks(_bytes_of(batch.column(2))):
                text, h, _, _ = anchored_windows(line, edges)
                order = np.lexsort((h, text))
                text, h = text[order], h[order]
                new = np.flatnonzero(np.concatenate(([True], (h[1:] != h[:-1]) | (text[1:] != text[:-1])))) if len(h) else order
                n = np.diff(np.append(new, len(h)))
                yield pa.RecordBatch.from_arrays([pa.array(h[new]), pa.array(n, pa.int32())], ["h", "n"])

    return texts.mapInArrow(run, "h long, n int")


def _anchor_places(texts: DataFrame) -> DataFrame:
    """(h, doc, tid, first) of each anchor and the first window it has in each place."""

    def run(batches):
        for batch in batches:
            docs, tids = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for start, line, edges in _blocks(_bytes_of(batch.column(2))):
                text, h, first, _ = anchored_windows(line, edges)
                columns = [h, docs[start + text], tids[start + text], first - edges[text]]
                yield pa.RecordBatch.from_arrays(list(map(pa.array, columns)), ["h", "doc", "tid", "first"])

    return texts.mapInArrow(run, "h long, doc long, tid long, first long")


def _filter_slots(h: np.ndarray) -> np.ndarray:
    # The lower bits: anchors are chosen for small hashes, so their upper bits are alike.
    return h & ((1 << FILTER_BITS) - 1)


_PIECES = "h long, doc long, tid long, first long, end long, bytes binary"


def _piece_batches(parts: list[tuple]):
    """Rows for the pieces (h, doc, tid, first, end, bytes arrays) of one batch of texts.

    Of pieces alike only those of the smallest document are sent on. The others are
    covered for certain; they become runs, which travel without bytes, under negative
    hashes that no anchor has.
    """
    h, doc, tid, first, end = (np.concatenate([p[i] for p in parts]) for i in range(5))
    pieces = [b for p in parts for b in p[5]]
    least: dict[bytes, int] = {}
    for piece, d in zip(pieces, doc.tolist()):
        if d < least.get(piece, d + 1):
            least[piece] = d
    later = doc > np.fromiter(map(least.__getitem__, pieces), np.int64, len(pieces))
    run_doc, run_tid, run_start, run_end = _joined_runs(doc[later], tid[later], first[later], end[later])
    sent = np.flatnonzero(~later)
    columns = [
        np.concatenate([h[sent], -1 - (mix64(run_doc, 3) >> np.uint64(2)).astype(np.int64)]),
        np.concatenate([doc[sent], run_doc]),
        np.concatenate([tid[sent], run_tid]),
        np.concatenate([first[sent], run_start]),
        # A piece's bytes tell its end.
        np.concatenate([np.zeros(len(sent), np.int64), run_end]),
    ]
    carried = [pieces[i] for i in sent.tolist()] + [None] * len(run_doc)
    names = ["h", "doc", "tid", "first", "end", "bytes"]
    for at in range(0, len(carried), 8192):
        part = slice(at, at + 8192)
        arrays = [pa.array(c[part]) for c in columns] + [pa.array(carried[part], pa.binary())]
        yield pa.RecordBatch.from_arrays(arrays, names)


def _joined_runs(doc, tid, start, end):
    """(doc, tid, start, end) runs with those that touch made one."""
    if not len(doc):
        return doc, tid, start, end
    order = np.lexsort((start, tid, doc))
    doc, tid, start, end = doc[order], tid[order], start[order], end[order]
    other = np.concatenate(([False], (doc[1:] != doc[:-1]) | (tid[1:] != tid[:-1])))
    # The furthest end so far in the same text; texts are set far apart for one running maximum.
    apart = np.cumsum(other) << 40
    reached = np.maximum.accumulate(end + apart)
    new = np.concatenate(([True], start[1:] + apart[1:] > reached[:-1]))
    last = np.append(np.flatnonzero(new)[1:] - 1, len(doc) - 1)
    return doc[new], tid[new], start[new], (reached - apart)[last]


def _pieces_of(docs, tids, start, line, edges, found):
    text, h, first, last = found
    pieces = [line[s:e] for s, e in zip(first.tolist(), (last + LENGTH).tolist())]
    return h, docs[start + text], tids[start + text], first - edges[text], last + LENGTH - edges[text], pieces


def _pieces_by_filter(texts: DataFrame, shared: DataFrame) -> DataFrame:
    """The bytes around anchors that a fixed-size filter of the shared ones lets through.

    What it lets through by mistake meets no equal later and does no harm.
    """

    def gather(batches):
        for batch in batches:
            slots = np.unique(_filter_slots(batch.column(0).to_numpy()))
            yield pa.RecordBatch.from_arrays([pa.array(slots >> 3), pa.array(1 << (slots & 7))], ["byte", "bit"])

    bits = shared.select("h").mapInArrow(gather, "byte long, bit long").groupBy("byte").agg(F.expr("bit_or(bit)").alias("bits"))
    filter_ = np.zeros(1 << (FILTER_BITS - 3), np.uint8)
    table = bits.select("byte", F.col("bits").cast("short").alias("bits")).toArrow()
    filter_[table["byte"].to_numpy()] = table["bits"].to_numpy()
    held = texts.sparkSession.sparkContext.broadcast(filter_)

    def run(batches):
        for batch in batches:
            docs, tids, parts = batch.column(0).to_numpy(), batch.column(1).to_numpy(), []
            for start, line, edges in _blocks(_bytes_of(batch.column(2))):
                found = anchored_windows(line, edges)
                slots = _filter_slots(found[1])
                hit = (held.value[slots >> 3] >> (slots & 7).astype(np.uint8)) & 1 == 1
                parts.append(_pieces_of(docs, tids, start, line, edges, [f[hit] for f in found]))
            if parts:
                yield from _piece_batches(parts)

    return texts.mapInArrow(run, _PIECES)


def _pieces_by_join(texts: DataFrame, shared: DataFrame) -> DataFrame:
    """The bytes around shared anchors, found by an exact join on their hashes."""
    places = (
        _anchor_places(texts)
        .join(shared.select("h"), "h", "left_semi")
        .groupBy("doc", "tid")
        .agg(F.collect_list("first").alias("firsts"))
    )

    def run(batches):
        for batch in batches:
            docs, tids = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            firsts, parts = [np.array(f, np.int64) for f in batch.column(3).to_pylist()], []
            for start, line, edges in _blocks(_bytes_of(batch.column(2))):
                found = anchored_windows(line, edges)
                wanted = np.concatenate([edges[i] + firsts[start + i] for i in range(len(edges) - 1)])
                hit = np.isin(found[2], wanted)
                parts.append(_pieces_of(docs, tids, start, line, edges, [f[hit] for f in found]))
            if parts:
                yield from _piece_batches(parts)

    return texts.join(places, ["doc", "tid"]).select("doc", "tid", "text", "firsts").mapInArrow(run, _PIECES)


# ---- deep-shallow sorting --------------------------------------------------


def _digit(line: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Eight bytes from each start on as one number that sorts like them."""
    return np.ndarray((len(line) - 7,), ">u8", line, 0, (1,))[starts].astype(np.uint64)


def _parted(order: np.ndarray, *keys: np.ndarray):
    """Groups (runs of equal keys along ``order``) as start offsets."""
    new = np.zeros(len(order), bool)
    new[:1] = True
    for key in keys:
        along = key[order]
        new[1:] |= along[1:] != along[:-1]
    return np.flatnonzero(new)


def equal_classes(line: np.ndarray, starts: np.ndarray, length: int = LENGTH, shallow: int = SHALLOW):
    """(order, class) of the suffixes at ``starts``, compared up to ``length`` bytes.

    ``order`` holds those that are equal to another one or lead a branch; suffixes that
    part from all others on the way are alone and left out. ``class`` is along
    ``order`` and equal where all bytes are.
    ``line`` must reach ``length + 8`` bytes beyond every start.
    """
    alive, group = np.arange(len(starts)), np.zeros(len(starts), np.int64)
    for depth in range(0, shallow, 8):
        digit = _digit(line, starts[alive] + depth)
        order = np.lexsort((digit, group)) if depth else np.argsort(digit, kind="stable")
        edges = _parted(order, group, digit)
        sizes = np.diff(np.append(edges, len(order)))
        member = np.repeat(np.arange(len(edges)), sizes)
        more = np.repeat(sizes > 1, sizes)
        alive, group = alive[order[more]], member[more]
    # Blind tries, all groups a level at a time.
    order_out, class_out, next_class = [], [], 0
    while len(alive):
        edges = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
        sizes = np.diff(np.append(edges, len(group)))
        leader = np.repeat(starts[alive[edges]], sizes)
        own = starts[alive]
        agreed, byte = np.full(len(alive), length, np.int64), np.zeros(len(alive), np.int64)
        open_ = np.ones(len(alive), bool)
        for depth in range(shallow, length, 8):
            rows = np.flatnonzero(open_)
            differ = _digit(line, own[rows] + depth) ^ _digit(line, leader[rows] + depth)
            if depth + 8 > length:
                differ >>= np.uint64(8 * (depth + 8 - length))
                differ <<= np.uint64(8 * (depth + 8 - length))
            off = differ != 0
            rows, differ = rows[off], differ[off]
            skip = np.zeros(len(rows), np.int64)
            for half in (32, 16, 8):
                high = differ >> np.uint64(64 - half) == 0
                skip += np.where(high, half // 8, 0)
                differ = np.where(high, differ << np.uint64(half), differ)
            agreed[rows] = depth + skip
            byte[rows] = line[own[rows] + agreed[rows]]
            open_[rows] = False
        same = agreed == length
        if same.any():
            # Those equal to the leader are a class; the trie branches hold the others.
            rank = np.cumsum(np.concatenate(([True], group[same][1:] != group[same][:-1]))) - 1
            order_out.append(alive[same])
            class_out.append(next_class + rank)
            next_class += int(rank[-1]) + 1
        left = np.flatnonzero(~same)
        order = left[np.lexsort((byte[left], agreed[left], group[left]))]
        edges = _parted(order, group, agreed, byte)
        sizes = np.diff(np.append(edges, len(order)))
        more = np.repeat(sizes > 1, sizes)
        member = np.repeat(np.arange(len(edges)), sizes)
        alive, group = alive[order[more]], member[more]
    if not order_out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(order_out), np.concatenate(class_out)


# ---- groups of windows -----------------------------------------------------


def later_windows(docs, firsts, pieces: list[bytes]):
    """Windows of a group's pieces: (piece, start in the text, document, whether an equal one is earlier).

    Comes with the offsets of the windows in the joined line, for digests of keepers.
    """
    lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
    line = np.frombuffer(b"".join([*pieces, bytes(LENGTH + 8)]), np.uint8)
    counts = lengths - LENGTH + 1
    piece = np.repeat(np.arange(len(pieces)), counts)
    within = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    starts = (np.cumsum(lengths) - lengths)[piece] + within
    doc = docs[piece]
    later = np.zeros(len(starts), bool)
    order, class_ = equal_classes(line, starts)
    if len(order):
        by_class = np.lexsort((doc[order], class_))
        order, class_ = order[by_class], class_[by_class]
        first = np.concatenate(([True], class_[1:] != class_[:-1]))
        least = doc[order][first][np.cumsum(first) - 1]
        later[order] = doc[order] > least
    return piece, firsts[piece] + within, doc, later, line, starts


_FOUND = "doc long, tid long, start long, end long, key binary"


def _sort_group(table: pa.Table) -> pa.Table:
    """Covered runs of a group; for anchors that other groups hold too, keepers with their digests."""
    table = table.sort_by([("doc", "ascending"), ("tid", "ascending"), ("first", "ascending")])
    known = table.filter(pc.is_null(table["bytes"]))
    table = table.filter(pc.is_valid(table["bytes"]))
    docs, tids, firsts = (table[n].to_numpy() for n in ("doc", "tid", "first"))
    spread = table["spread"].to_numpy() > 1
    piece, at, doc, later, line, starts = later_windows(docs, firsts, table["bytes"].to_pylist())
    runs = zip((doc[later], tids[piece][later], at[later], at[later] + LENGTH), ("doc", "tid", "first", "end"))
    run_doc, run_tid, run_start, run_end = _joined_runs(*[np.concatenate([r, known[n].to_numpy()]) for r, n in runs])
    keeper = np.flatnonzero(~later & spread[piece])
    text = line.tobytes()
    digests = [hashlib.blake2b(text[s : s + LENGTH], digest_size=16).digest() for s in starts[keeper].tolist()]
    return pa.table(
        {
            "doc": np.concatenate([run_doc, doc[keeper]]),
            "tid": np.concatenate([run_tid, tids[piece][keeper]]),
            "start": np.concatenate([run_start, at[keeper]]),
            "end": np.concatenate([run_end, at[keeper] + LENGTH]),
            "key": pa.array([None] * len(run_doc) + digests, pa.binary()),
        }
    )


def covered_runs(texts: DataFrame, purpose: str = "suffix", use_filter: bool | None = None) -> DataFrame:
    """(doc, tid, start, end) of bytes that equal windows of smaller documents cover.

    ``texts`` has (doc, tid, text), one row for each (doc, tid). Runs may overlap.
    """
    shared = saved(
        _anchor_counts(texts)
        .groupBy("h")
        .agg(F.count(F.lit(1)).alias("texts"), F.sum("n").alias("n"))
        .where("texts > 1")
        .select("h", "n"),
        f"{purpose}-anchors",
    )
    size = shared.agg(F.count(F.lit(1)).alias("anchors"), F.coalesce(F.sum("n"), F.lit(0)).alias("rows")).first()
    if use_filter is None:
        use_filter = size.anchors <= FILTER_ANCHORS
    pieces = _pieces_by_filter(texts, shared) if use_filter else _pieces_by_join(texts, shared)
    # Anchors of many places are dealt over groups of their own.
    hot = shared.where(F.col("n") > HOT_ROWS).select("h", F.ceil(F.col("n") / HOT_ROWS).alias("spread"))
    salt = F.pmod(F.xxhash64("doc", "tid", "first"), F.coalesce("spread", F.lit(1)))
    groups = max(1, -(-size.rows // GROUP_ROWS))
    dealt = pieces.join(broadcast_if_small(hot), "h", "left").select(
        F.pmod(F.xxhash64("h", salt), F.lit(groups)).alias("group"),
        "doc", "tid", "first", "end", "bytes", F.coalesce("spread", F.lit(1)).alias("spread"),
    )
    found = saved(dealt.groupBy("group").applyInArrow(_sort_group, _FOUND), f"{purpose}-windows")
    runs = found.where("key is null").select("doc", "tid", "start", "end")
    keepers = found.where("key is not null")
    least = keepers.groupBy("key").agg(F.min("doc").alias("least"), F.max("doc").alias("most")).where("least < most")
    beaten = keepers.join(least, "key").where("doc > least").select("doc", "tid", "start", "end")
    return runs.unionByName(beaten)


def _kept(text: bytes, spans) -> tuple[int, int, bytes]:
    """(bytes removed, maximal removed runs, what is left)."""
    parts, done, removed, runs = [], 0, 0, 0
    last = -1
    for start, end in sorted(spans):
        if start > last:
            parts.append(text[done:start])
            runs += 1
            removed += end - start
            last = done = end
        elif end > last:
            removed += end - last
            last = done = end
    return removed, runs, b"".join([*parts, text[done:]])


def remove_repeated(docs: DataFrame, keep_text: bool = False, use_filter: bool | None = None) -> DataFrame:
    """One row for each document: doc_id, n_bytes, n_removed, n_spans, kept_sha256.

    With ``keep_text`` the remaining bytes come along as ``kept``. Null text counts
    as empty; rows that repeat come out as often. Rows of one doc_id do not remove
    from each other, whatever their texts. A null doc_id is neither smaller nor larger
    than any: nothing goes there, and nothing goes elsewhere because of it.
    """
    digest = F.unhex(F.sha2(F.col("text").cast("binary"), 256))
    source = docs.select(
        F.col("doc_id").cast("long").alias("doc"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    ).withColumn("digest", digest)
    classes = saved(source.where("doc is not null").groupBy("doc", "digest").agg(F.count(F.lit(1)).alias("n")), "suffix-texts")
    again = not classes.where("n > 1").isEmpty()
    several = not classes.groupBy("doc").count().where("count > 1").isEmpty()
    # Tells texts of one doc_id apart; where every id has one text there is no need.
    marked = source.withColumn("tid", F.xxhash64("digest") if several else F.lit(0).cast("long"))
    least = classes.groupBy("digest").agg(F.min("doc").alias("least"), F.max("doc").alias("most")).where("least < most")
    # Rows that an earlier exact copy settles; the others go through the sorting.
    copies = saved(
        classes.join(broadcast_if_small(saved(least, "suffix-copied")), "digest").where("doc > least").select("doc", "digest"),
        "suffix-copies",
    )
    copies_sent = broadcast_if_small(copies)
    fresh = marked.where("doc is not null").join(copies_sent, ["doc", "digest"], "left_anti").select("doc", "tid", "text")
    if again:
        fresh = fresh.dropDuplicates(["doc", "tid"])
    spans = (
        covered_runs(fresh, use_filter=use_filter)
        .groupBy("doc", "tid")
        .agg(F.collect_list(F.shiftleft("start", 32).bitwiseOR(F.col("end"))).alias("spans"))
    )
    rows = (
        marked.join(copies_sent.withColumn("copied", F.lit(True)), ["doc", "digest"], "left")
        .join(spans, ["doc", "tid"], "left")
        .select("doc", "text", "copied", "spans")
    )
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * keep_text

    def run(batches):
        for batch in batches:
            out = []
            texts, copied = _bytes_of(batch.column(1)), batch.column(2).to_pylist()
            for text, whole, found in zip(texts, copied, batch.column(3).to_pylist()):
                if whole:
                    found = [len(text)] if len(text) >= LENGTH else []
                removed, runs, kept = _kept(text, [(v >> 32, v & 0xFFFFFFFF) for v in found or []])
                out.append((len(text), removed, runs, hashlib.sha256(kept).hexdigest(), kept))
            columns = list(zip(*out)) or [()] * 5
            kinds = [pa.int64()] * 3 + [pa.string(), pa.binary()]
            arrays = [pa.array(c, k) for c, k in zip(columns, kinds)][: 4 + keep_text]
            names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], names[: len(arrays) + 1])

    return rows.mapInArrow(run, schema)

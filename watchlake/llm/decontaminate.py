"""Benchmark passages inside documents, found through edit distance.

Words are compared without case and ASCII punctuation. A CGK random walk embeds the
words from any position on: at each step the walk writes the word it stands on, and
a random bit of that word and step tells whether it moves on. Walks that start at
two ends of an edit fall into step again, so a small edit distance becomes a small
Hamming distance of what they write. Bit-sampling LSH (words of a few sampled steps,
hashed) then brings a document's windows together with benchmark items of their
size. A window starts at every ``STRIDE``-th word, and an item is indexed from each of
its first words on, so that some window starts where one of these walks did.
Items of fewer than ``SEEDED_BELOW`` words have too few windows for that. They are cut
into one piece more than edits are allowed, so one piece at least stands in the text
unchanged; a lookup of word n-grams at every position finds it, and misses none.

Whatever meets is verified by an exact alignment: the smallest edit distance of the whole item to any piece of the text
around it must be at most ``(1 - similarity)`` of the item's words.

Walks run for all positions at once and are merged when they meet, which they do
soon: the work for each position grows with the square root of the walk's length.
Items are handled in blocks of ``ITEM_BLOCK`` (the bound of what a task is sent);
each block passes over the documents once.
"""

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

SIMILARITY = 0.8
TARGET_RECALL = 0.98
# The share of sampled steps taken to agree for a passage with some edits.
STEP_AGREEMENT = 0.7
SAMPLES = 4
STRIDE = 4
WALKS = 3
SEEDED_BELOW = 32
ITEM_BLOCK = 4096
_LONGEST_WALK = 512
_POSITIONS = 1 << 19
_CACHE = 500_000

# ASCII punctuation separates words here; bytes of other letters are kept.
_SEPARATED = bytes(b if b > 127 or chr(b).isalnum() or chr(b).isspace() else 32 for b in range(256))


class _WordHashes(dict):
    """64-bit hashes of words, computed once for each and worker."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= _CACHE:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word, 7) or 1
        return value


def word_hashes(text: str | None, cache: _WordHashes) -> np.ndarray:
    words = (text or "").lower().encode("utf-8", "surrogatepass").translate(_SEPARATED).split()
    return np.fromiter(map(cache.__getitem__, words), np.uint64, len(words))


def _bits(words: np.ndarray, walk: int, step: int) -> np.ndarray:
    """64 steps' worth of move bits of each word; bit j is for step ``64 * step + j``."""
    x = words ^ np.uint64((walk * 0x9E3779B97F4A7C15 + step * 0xD6E8FEB86659FD93 + 0xA5A5) & (2**64 - 1))
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    # A walk that meets padding stays there.
    return np.where(words == 0, np.uint64(0), x ^ (x >> np.uint64(32)))


def walked(words: np.ndarray, starts: np.ndarray, walk: int, steps: list[int]):
    """For each of ``steps`` (ascending): the word that the walk from every start writes there.

    ``words`` must end in padding (a zero), where walks halt. ``starts`` ascend.
    Yields (step, words written), the latter aligned with ``starts``.
    """
    place, owner = starts.copy(), None
    wanted = set(steps)
    moves, at = None, -1
    for step in range(steps[-1] + 1):
        if step >> 6 != at:
            at = step >> 6
            moves = _bits(words, walk, at)
        if step in wanted:
            written = words[place]
            yield step, written if owner is None else written[owner]
        place = place + ((moves[place] >> np.uint64(step & 63)) & np.uint64(1)).astype(np.int64)
        if step & 7 == 7:
            first = np.empty(len(place), bool)
            first[:1] = True
            np.not_equal(place[1:], place[:-1], out=first[1:])
            merged = np.cumsum(first) - 1
            owner = merged if owner is None else merged[owner]
            place = place[first]


def _fold(state: np.ndarray, word: np.ndarray) -> np.ndarray:
    state = (state ^ word) * np.uint64(0x9E3779B97F4A7C15)
    return state ^ (state >> np.uint64(29))


def _grams(line: np.ndarray, starts: int, longest: int):
    """(length, hash of so many words from each of the first ``starts`` places on), by length."""
    padded = np.concatenate([line, np.zeros(longest, np.uint64)])
    state = np.full(starts, 0xA5A5, np.uint64)
    for length in range(1, longest + 1):
        state = _fold(state, padded[length - 1 : length - 1 + starts])
        yield length, state


@dataclass(frozen=True)
class Plan:
    """The tables of the items of one size class: (walk, sampled steps) each."""

    least_words: int
    tables: tuple[tuple[int, tuple[int, ...]], ...]


def plan_for(least_words: int, similarity_recall: float = TARGET_RECALL) -> Plan:
    """Enough tables for the target recall where sampled steps agree as often as assumed."""
    hit = STEP_AGREEMENT**SAMPLES
    n = math.ceil(math.log(1 - similarity_recall) / math.log(1 - hit))
    # A step moves on by half a word; the last offset must leave words for the walk.
    steps = min(_LONGEST_WALK, max(SAMPLES, 2 * (least_words - offsets_of(least_words)) - 1))
    draw = np.random.default_rng(least_words)
    tables = []
    for i in range(n):
        # Spread over the window, so that one edit cannot spoil all samples.
        edges = np.linspace(0, steps, SAMPLES + 1)
        tables.append((i % WALKS, tuple(int(draw.integers(int(a), max(int(a) + 1, int(b)))) for a, b in zip(edges, edges[1:]))))
    return Plan(least_words, tuple(tables))


def offsets_of(least_words: int) -> int:
    """From how many of its first words on an item of the class is indexed."""
    return max(STRIDE, least_words // 2) if least_words >= 2 * STRIDE else min(STRIDE, least_words)


def _size_class(words: int) -> int:
    """The largest power of two up to the number of words."""
    return 1 << (words.bit_length() - 1)


@dataclass
class Index:
    """LSH tables over a block of items."""

    ids: list
    words: list[np.ndarray]
    similarity: float

    def __post_init__(self):
        sizes: dict[int, list[int]] = {}
        for i, words in enumerate(self.words):
            if len(words) >= SEEDED_BELOW:
                sizes.setdefault(_size_class(len(words)), []).append(i)
        self.plans = {size: plan_for(size) for size in sizes}
        self.listed = [w.tolist() for w in self.words]
        self.pad = 1
        self.keys: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}
        self.pairs: dict[tuple[int, int], np.ndarray] = {}
        self.seeds = self._seeds()
        for size, members in sizes.items():
            line = np.concatenate([np.concatenate([self.words[i], np.zeros(self.pad, np.uint64)]) for i in members])
            lengths = np.array([len(self.words[i]) + self.pad for i in members])
            first = np.concatenate(([0], np.cumsum(lengths)[:-1])).astype(np.int64)
            shifts = np.arange(offsets_of(size), dtype=np.int64)
            starts = (first[:, None] + shifts).ravel()
            owners, shift = np.repeat(members, len(shifts)), np.tile(shifts, len(members))
            for t, (pair, key) in self._signatures(line, starts, self.plans[size]).items():
                order = np.argsort(key, kind="stable")
                self.keys[size, t] = key[order], owners[order], shift[order]
                filter_bits = np.zeros(1 << 16, bool)
                filter_bits[(pair >> np.uint64(48)).astype(np.int64)] = True
                self.pairs[size, t] = filter_bits

    def _seeds(self) -> dict[int, tuple[np.ndarray, ...]]:
        """By length: (keys, items, offsets, filter) of the pieces of the short items, keys ascending."""
        pieces: dict[int, list[tuple[int, int, int]]] = {}
        for i, words in enumerate(self.words):
            n = len(words)
            if n < SEEDED_BELOW:
                parts = min(n, int((1 - self.similarity) * n + 1e-9) + 1)
                edges = [n * j // parts for j in range(parts + 1)]
                for a, b in zip(edges, edges[1:]):
                    *_, (_, key) = _grams(words[a:b], 1, b - a)
                    pieces.setdefault(b - a, []).append((int(key[0]), i, a))
        out = {}
        for length, own in sorted(pieces.items()):
            own.sort()
            keys = np.array([k for k, _, _ in own], np.uint64)
            filter_bits = np.zeros(1 << 16, bool)
            filter_bits[(keys >> np.uint64(48)).astype(np.int64)] = True
            out[length] = keys, np.array([i for _, i, _ in own]), np.array([a for _, _, a in own]), filter_bits
        return out

    def _seeded(self, line: np.ndarray):
        """(position, item, start) arrays for each length of pieces, where the line holds one."""
        if not self.seeds:
            return
        for length, state in _grams(line, len(line), max(self.seeds)):
            if length in self.seeds:
                keys, items, offsets, filter_bits = self.seeds[length]
                maybe = np.flatnonzero(filter_bits[(state >> np.uint64(48)).astype(np.int64)])
                low, high = np.searchsorted(keys, state[maybe]), np.searchsorted(keys, state[maybe], "right")
                hit = np.repeat(np.arange(len(low)), high - low)
                which = low[hit] + np.arange(len(hit)) - np.repeat(np.cumsum(high - low) - (high - low), high - low)
                yield maybe[hit] - offsets[which], items[which], maybe[hit]

    @staticmethod
    def _signatures(line, starts, plan):
        """For each table: the hash of its first two samples, and of all."""
        out = {}
        for walk in range(WALKS):
            own = [(t, steps) for t, (w, steps) in enumerate(plan.tables) if w == walk]
            if not own:
                continue
            written = dict(walked(line, starts, walk, sorted({s for _, steps in own for s in steps})))
            for t, steps in own:
                state = np.full(len(starts), t + 1, np.uint64)
                for k, step in enumerate(steps):
                    state = _fold(state, written[step])
                    if k == 1:
                        pair = state
                out[t] = pair, state
        return out

    def candidates(self, line: np.ndarray, starts: np.ndarray):
        """(position, item, window start) arrays of windows that share a table's key with an item.

        The position is where the item would begin; it may lie before the window's text.
        """
        found_at, found_item, found_from = [], [], []
        for places, items, begun in self._seeded(line):
            found_at.append(places)
            found_item.append(items)
            found_from.append(begun)
        for walk in range(WALKS):
            wanted = sorted({s for p in self.plans.values() for w, steps in p.tables if w == walk for s in steps})
            if not wanted:
                continue
            open_tables: dict[tuple[int, int], list] = {
                (size, t): [list(steps), 0, np.full(1, t + 1, np.uint64), None]
                for size, p in self.plans.items()
                for t, (w, steps) in enumerate(p.tables)
                if w == walk
            }
            for step, written in walked(line, starts, walk, wanted):
                for name, table in open_tables.items():
                    steps, taken, state, left = table
                    # A table may sample a step more than once.
                    while taken < SAMPLES and steps[taken] == step:
                        if left is None:
                            state = _fold(state, written)
                        else:
                            state = _fold(state, written[left])
                        taken += 1
                        if taken == 2:
                            left = np.flatnonzero(self.pairs[name][(state >> np.uint64(48)).astype(np.int64)])
                            state = state[left]
                        if taken == SAMPLES:
                            keys, items, shift = self.keys[name]
                            low, high = np.searchsorted(keys, state), np.searchsorted(keys, state, "right")
                            hit = np.repeat(np.arange(len(low)), high - low)
                            rank = np.arange(len(hit)) - np.repeat(np.cumsum(high - low) - (high - low), high - low)
                            which = low[hit] + rank
                            found_at.append(starts[left[hit]] - shift[which])
                            found_item.append(items[which])
                            found_from.append(starts[left[hit]])
                            state = None
                    table[1], table[2], table[3] = taken, state, left
        if not found_at:
            return tuple(np.zeros(0, np.int64) for _ in range(3))
        met = np.unique(np.column_stack([np.concatenate(found_item), np.concatenate(found_at), np.concatenate(found_from)]), axis=0)
        return met[:, 1], met[:, 0], met[:, 2]


def best_alignment(item: np.ndarray, text: np.ndarray) -> tuple[int, int, int]:
    """(edits, start, end) of the piece of ``text`` closest to the whole item.

    Of equally close pieces the one that ends first counts; its start is the last
    that gives this distance.
    """
    n = len(text)
    across = np.arange(n + 1)
    row, begin = np.zeros(n + 1, np.int64), across.copy()
    for i, word in enumerate(item):
        step = np.empty(n + 1, np.int64)
        source = np.empty(n + 1, np.int64)
        step[0], source[0] = i + 1, 0
        match, drop = row[:-1] + (text != word), row[1:] + 1
        diagonal = match <= drop
        step[1:] = np.where(diagonal, match, drop)
        source[1:] = np.where(diagonal, begin[:-1], begin[1:])
        # Skipping words of the text: the least of what lies left, plus the way.
        level = step - across
        best = np.minimum.accumulate(level)
        fresh = np.concatenate(([True], level[1:] < best[:-1]))
        from_at = np.maximum.accumulate(np.where(fresh, across, 0))
        row, begin = best + across, source[from_at]
    end = int(row.argmin())
    return int(row[end]), int(begin[end]), end


def matches(index: Index, line: np.ndarray, at: np.ndarray, item: np.ndarray, low: int, high: int):
    """Verified (item, start, end, edits) in one document, words ``low``..``high`` of the line.

    Candidates of an item that lie close together are verified as one region.
    """
    for which in sorted(set(item.tolist())):
        words, listed = index.words[which], index.listed[which]
        n = len(words)
        slack = int((1 - index.similarity) * n + 1e-9)
        reach = slack + 8
        places = np.sort(at[item == which])
        cuts = np.flatnonzero(np.diff(places) > n) + 1
        groups = np.split(places, cuts) if len(cuts) else [places]
        best = None
        for group in groups:
            begin, end = max(low, group[0] - reach), min(high, group[-1] + n + reach)
            region = line[begin:end]
            # Every edit spoils at most one of the item's words.
            if n - sum(map(set(region.tolist()).__contains__, listed)) > slack:
                continue
            edits, start, stop = best_alignment(words, region)
            if edits <= slack and (best is None or edits < best[0]):
                best = edits, begin + start - low, begin + stop - low
        if best:
            yield which, best[1], best[2], best[0]


def scan(index: Index, texts: list[str | None], cache: _WordHashes):
    """Yields (row, item, start, end, edits) of verified passages; starts count words."""
    row = 0
    while row < len(texts):
        first, parts, total = row, [], 0
        while row < len(texts) and (total < _POSITIONS or not parts):
            parts.append(word_hashes(texts[row], cache))
            total += len(parts[-1])
            row += 1
        lengths = np.array([len(p) for p in parts], np.int64)
        # A zero after each document keeps walks from reading the next one.
        edges = np.concatenate(([0], np.cumsum(lengths + index.pad)))
        line = np.concatenate([x for p in parts for x in (p, np.zeros(index.pad, np.uint64))])
        if not total or not index.ids:
            continue
        # Windows start anew in each document, so that equal documents are read alike.
        counts = -(-lengths // STRIDE)
        within = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
        holder = np.repeat(np.arange(len(parts)), counts)
        starts = edges[holder] + within * STRIDE
        at, item, begun = index.candidates(line, starts)
        # The shifted start of an item may lie before its document; the window does not.
        owner = np.searchsorted(edges, begun, "right") - 1
        order = np.argsort(owner, kind="stable")
        cuts = np.flatnonzero(np.diff(owner[order])) + 1
        for own in np.split(order, cuts) if len(order) else []:
            doc = int(owner[own[0]])
            for which, start, end, edits in matches(index, line, at[own], item[own], edges[doc], edges[doc] + lengths[doc]):
                yield first + doc, which, start, end, edits


def item_blocks(items: DataFrame, similarity: float = SIMILARITY):
    """Indexes over the items with a word, ``ITEM_BLOCK`` at a time by id.

    Items without an id or a word match nothing. Repeated ids keep one text each.
    """
    known = (
        items.select(F.col("item_id").cast("long").alias("item_id"), "text")
        .where("item_id is not null and text is not null")
        .groupBy("item_id", "text")
        .agg(F.count(F.lit(1)).alias("n"))
        .select("item_id", "text")
    )
    cache = _WordHashes()
    last = None
    while True:
        ahead = known if last is None else known.where(F.struct("item_id", "text") > F.struct(F.lit(last[0]).alias("item_id"), F.lit(last[1]).alias("text")))
        block = ahead.orderBy("item_id", "text").limit(ITEM_BLOCK).collect()
        if not block:
            return
        worded = [(r.item_id, w) for r in block if len(w := word_hashes(r.text, cache))]
        if worded:
            yield Index([i for i, _ in worded], [w for _, w in worded], similarity)
        if len(block) < ITEM_BLOCK:
            return
        last = block[-1].item_id, block[-1].text


def contaminated(docs: DataFrame, items: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """One row for each document and item it holds: (doc_id, item_id, start, end, edits, similarity).

    ``start`` and ``end`` count the document's words; of several places the closest,
    then the first. Null and blank texts hold nothing. Rows of ``docs`` that repeat
    come out as often; a null doc_id is kept as null.
    """
    schema = "doc_id long, item_id long, start long, end long, edits int, similarity double"
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = source.sparkSession.createDataFrame([], schema)
    for index in item_blocks(items, similarity):
        held = source.sparkSession.sparkContext.broadcast(index)

        def run(batches, held=held):
            cache = _WordHashes()
            for batch in batches:
                ids, index = batch.column(0).to_pylist(), held.value
                rows = [
                    (ids[row], index.ids[which], start, end, edits, 1 - edits / len(index.words[which]))
                    for row, which, start, end, edits in scan(index, batch.column(1).to_pylist(), cache)
                ]
                columns = list(zip(*rows)) or [()] * 6
                kinds = [pa.int64()] * 4 + [pa.int32(), pa.float64()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(columns, kinds)],
                    ["doc_id", "item_id", "start", "end", "edits", "similarity"],
                )

        found = found.unionByName(source.mapInArrow(run, schema))
    # An id with several texts may hold more than one row for a document.
    return found


def drop_contaminated(docs: DataFrame, items: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """``docs`` without those that hold a benchmark item; all columns kept."""
    place = docs.columns.index("text")
    clean = docs
    for index in item_blocks(items, similarity):
        held = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches, held=held):
            cache = _WordHashes()
            for batch in batches:
                keep = np.ones(batch.num_rows, bool)
                for row, *_ in scan(held.value, batch.column(place).to_pylist(), cache):
                    keep[row] = False
                yield batch.filter(pa.array(keep))

        clean = clean.mapInArrow(run, docs.schema)
    return clean

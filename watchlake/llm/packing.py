"""Best-fit packing of tokenized documents into fixed-length training sequences.

Hierarchical: tasks tokenize their documents and pack the pieces by best fit
decreasing, many thousands at a time. Bins that are nearly full are final; the
others become items of the next level, where groups of them, several tasks' worth,
are packed again as they are. Groups double their reach from level to level until
one is left or a level stops helping. A level's groups are bounded by ``GROUP_BINS``
and hold two numbers a bin, so no task sees more, however large the corpus.
"""

import zlib
from array import array
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from watchlake.llm.common import saved, without_cycle_search

CAPACITY = 1024
END_ID = 2
NEARLY_FULL = 0.99
LOCAL_ITEMS = 100_000
GROUP_BINS = 50_000
MAX_LEVELS = 12
VOCABULARY = "byte_bpe_50k.json"
_CACHE = 450_000
_LONGEST_CACHED = 48
_OTHER_SPACES = [chr(c) for c in range(0x110000) if c not in (10, 32) and chr(c).isspace()]
_LINE_END = ("\n",)
# A byte-level vocabulary's sign for a space.
_SPACE = "\u0120"
# Signs that the tokenizer never joins with a letter before them.
_SIGNS = ".,;:!?*#$%&"


class Encoder:
    """Token ids of whole texts as little-endian 32-bit bytes.

    A single space between two signs always starts a new unit of the tokenizer's own
    splitting, so a text is encoded chunk by chunk between such spaces, and chunks
    seen before come from a bounded cache of two generations. Signs at a chunk's end that
    follow a letter are units of their own, too, and looked up apart from the word.
    Strings of special tokens in a text are ordinary text, as in the vocabulary's own
    description.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.line_end = self.tokenizer.encode("\n", add_special_tokens=False).ids[0]
        vocabulary = self.tokenizer.get_vocab()
        # Whether a token starts with a space.
        self.spaced = np.zeros(max(vocabulary.values()) + 1, bool)
        self.spaced[[i for token, i in vocabulary.items() if token.startswith(_SPACE)]] = True
        # A chunk is named by what follows its space; a text's first one by a tuple.
        self.known: dict[str | tuple[str], bytes] = {}
        self.older: dict[str | tuple[str], bytes] = {}

    def _learn(self, fresh, known: dict) -> None:
        """Adds the ids of chunks that are not known."""
        older, unseen, split = self.older, set(), []
        for chunk in fresh:
            ids = older.get(chunk)
            if ids is not None:
                known[chunk] = ids
            elif type(chunk) is str and chunk[-1:] in _SIGNS and (word := chunk.rstrip(_SIGNS)) and word[-1].isalpha():
                signs = (chunk[len(word) :],)
                split.append((chunk, word, signs))
                unseen.add(word)
                unseen.add(signs)
            else:
                unseen.add(chunk)
        missing = []
        for chunk in unseen:
            if chunk not in known:
                ids = older.get(chunk)
                if ids is None:
                    missing.append(chunk)
                else:
                    known[chunk] = ids
        words, in_line, alone = [], [], []
        for chunk in missing:
            sign = chunk if type(chunk) is str else chunk[0]
            if not sign or "\n" in sign or sign.strip() != sign:
                alone.append(chunk)
            elif sign is chunk and " " not in sign:
                words.append(chunk)
            else:
                in_line.append(chunk)
        for kept, learn in ((words, self._learn_words), (in_line, self._learn_line)):
            for i in range(0, len(kept), 1024):
                block = kept[i : i + 1024]
                if not learn(block, known):
                    alone += block
        for i in range(0, len(alone), 1024):
            block = alone[i : i + 1024]
            texts = [c[0] if type(c) is tuple else " " + c for c in block]
            for chunk, found in zip(block, self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)):
                known[chunk] = np.array(found.ids, "<u4").tobytes()
        for chunk, word, signs in split:
            known[chunk] = known[word] + known[signs]

    def _learn_words(self, block: list[str], known: dict) -> bool:
        """Chunks after a space encoded as one text, their ids parted by the tokens that start with a space.

        Should these not come out one for each chunk, nothing is kept.
        """
        ids = np.array(self.tokenizer.encode_batch_fast([" " + " ".join(block)], add_special_tokens=False)[0].ids, "<u4")
        starts = np.flatnonzero(self.spaced[ids])
        if len(starts) != len(block) or starts[0]:
            return False
        packed = ids.tobytes()
        starts = (4 * starts).tolist()
        for chunk, start, end in zip(block, starts, [*starts[1:], len(packed)]):
            known[chunk] = packed[start:end]
        return True

    def _learn_line(self, block: list[str], known: dict) -> bool:
        """Chunks encoded as the lines of one text, whose line ends part their ids.

        A line end between other signs is a unit of its own. Should the ends not come
        out one for each line, nothing is kept.
        """
        line = "\n".join([" " + c if type(c) is str else c[0] for c in block])
        ids = np.array(self.tokenizer.encode_batch_fast([line], add_special_tokens=False)[0].ids, "<u4")
        ends = np.flatnonzero(ids == self.line_end)
        if len(ends) != len(block) - 1:
            return False
        packed = ids.tobytes()
        starts = [0, *(4 * ends + 4).tolist()]
        for chunk, start, end in zip(block, starts, [*(4 * ends).tolist(), len(packed)]):
            known[chunk] = packed[start:end]
        return True

    def encode(self, texts: list[str]) -> list[bytes]:
        with without_cycle_search():
            return self._encode(texts)

    def _encode(self, texts: list[str]) -> list[bytes]:
        if len(self.known) > _CACHE:
            self.older, self.known = self.known, {}
        known = self.known
        split = [chunks(t) for t in texts]
        found = [list(map(known.get, own)) for own in split]
        gaps = [[i for i, ids in enumerate(ids_of) if ids is None] if None in ids_of else None for ids_of in found]
        fresh = {own[i] for own, missing in zip(split, gaps) if missing for i in missing}
        if fresh:
            self._learn(fresh, known)
            for own, ids_of, missing in zip(split, found, gaps):
                for i in missing or ():
                    ids_of[i] = known[own[i]]
            for chunk in fresh:
                if len(chunk if type(chunk) is str else chunk[0]) > _LONGEST_CACHED:
                    del known[chunk]
        return list(map(b"".join, found))

def chunks(text: str) -> list:
    """A text cut at every single space or line end that stands between two other signs.

    Chunks after a space come without it; those that start the text or a line, and
    line ends themselves, come as tuples.
    """
    out: list = []
    for line in text.split("\n"):
        parts: list = line.split(" ")
        if "" in parts:
            return _joined(text)
        parts[0] = (parts[0],)
        if out:
            out.append(_LINE_END)
        out += parts
    # Any other white space must not stand next to a cut.
    for s in _OTHER_SPACES:
        if s in text and (" " + s in text or s + " " in text or "\n" + s in text or s + "\n" in text):
            return _joined(text)
    return out


def _joined(text: str) -> list:
    """Chunks of a text in which white space meets: cut only at spaces that stand alone."""
    parts = text.split(" ")
    out: list = [parts[0]]
    whole = parts[0] == "" or parts[0][-1].isspace()
    for part in parts[1:]:
        if whole or part == "" or part[0].isspace():
            out[-1] = f"{out[-1]} {part}"
        else:
            out.append(part)
        whole = part == "" or part[-1].isspace()
    out[0] = (out[0],)
    return out


def best_fit(sizes: list[int], capacity: int = CAPACITY) -> tuple[list[int], list[int]]:
    """Best fit decreasing: the bin of each item, and each bin's fill.

    Every item goes, largest first, to the bin with the least room that holds it;
    ties to the bin opened last. Sizes are whole numbers from 1 to ``capacity``.
    """
    where = [0] * len(sizes)
    fills: list[int] = []
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms = 0  # bit r: some bin has room r
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        size = sizes[i]
        enough = rooms >> size
        if enough:
            room = size + (enough & -enough).bit_length() - 1
            bin_ = by_room[room].pop()
            if not by_room[room]:
                rooms ^= 1 << room
            fills[bin_] += size
        else:
            bin_ = len(fills)
            fills.append(size)
            room = capacity
        where[i] = bin_
        left = room - size
        if left:
            if not by_room[left]:
                rooms |= 1 << left
            by_room[left].append(bin_)
    return where, fills


def cut(length: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces; only the first of several may be shorter."""
    first = length % capacity or min(length, capacity)
    starts = [0, *range(first, length, capacity)]
    return [(s, e - s) for s, e in zip(starts, [*starts[1:], length])]


_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, bin long, place long, fill long"
_ENCODERS: dict[str, Encoder] = {}


def _encoder(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def local_pieces(docs: DataFrame, vocabulary: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """All pieces with the bin that the task that cut them put them in.

    ``bin`` counts from the task's own range of numbers; ``place`` is the piece's
    offset there and ``fill`` how full the bin is.
    """

    def run(batches):
        if vocabulary is None:
            import public_tokenizers

            path = public_tokenizers.path(VOCABULARY)
        else:
            path = vocabulary
        encoder = _encoder(path)
        next_bin = TaskContext.get().partitionId() << 40
        end = np.array([END_ID], "<u4").tobytes()
        names = [f.split()[0] for f in _PIECES.split(", ")]
        ids, numbers, starts, lengths, sums = array("q"), array("i"), array("q"), array("q"), array("q")
        unknown = set()

        def packed():
            nonlocal next_bin
            where, fills = best_fit(lengths.tolist(), capacity)
            where = np.array(where, np.int64)
            fills = np.array(fills, np.int64)
            sizes = np.array(lengths, np.int64)
            order = np.argsort(where, kind="stable")
            before = np.cumsum(sizes[order]) - sizes[order]
            first = np.concatenate(([True], where[order][1:] != where[order][:-1]))
            place = np.empty_like(sizes)
            place[order] = before - np.maximum.accumulate(np.where(first, before, 0))
            mask = np.zeros(len(ids), bool)
            mask[list(unknown)] = True
            columns = [
                pa.array(np.array(ids), mask=mask), pa.array(np.array(numbers, np.int32)), pa.array(np.array(starts)),
                pa.array(sizes), pa.array(np.array(sums)), pa.array(where + next_bin), pa.array(place), pa.array(fills[where]),
            ]
            next_bin += len(fills)
            for kept in (ids, numbers, starts, lengths, sums):
                del kept[:]
            unknown.clear()
            return pa.RecordBatch.from_arrays(columns, names)

        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                texts = [t or "" for t in part.column(1).to_pylist()]
                for doc_id, tokens in zip(part.column(0).to_pylist(), encoder.encode(texts)):
                    tokens += end
                    for piece, (start, length) in enumerate(cut(len(tokens) // 4, capacity)):
                        if doc_id is None:
                            unknown.add(len(ids))
                        ids.append(doc_id or 0)
                        numbers.append(piece)
                        starts.append(start)
                        lengths.append(length)
                        sums.append(zlib.crc32(tokens[4 * start : 4 * (start + length)]))
                    if len(ids) >= LOCAL_ITEMS:
                        yield packed()
        if ids:
            yield packed()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, _PIECES)


def merged_bins(bins: DataFrame, level: int, count: int, capacity: int) -> DataFrame:
    """One level: groups of underfull bins packed as items.

    ``bins`` has (bin, fill). Returns (bin, into, shift, fill): the bin it went into,
    its offset there, and how full that is. Groups are by a hash of the bin, another
    at each level, so bins that found no partner meet others.
    """
    groups = -(-count // GROUP_BINS)
    schema = "bin long, into long, shift long, fill long"

    def pack(table: pa.Table) -> pa.Table:
        table = table.sort_by("bin")
        names, sizes = table["bin"].to_numpy(), table["fill"].to_numpy()
        where, fills = best_fit(sizes.tolist(), capacity)
        where = np.array(where, np.int64)
        order = np.argsort(where, kind="stable")
        before = np.cumsum(sizes[order]) - sizes[order]
        first = np.concatenate(([True], where[order][1:] != where[order][:-1]))
        shift = np.empty_like(sizes)
        shift[order] = before - np.maximum.accumulate(np.where(first, before, 0))
        # A bin of several takes the name of the first one that it holds.
        leaders = np.empty(len(fills), np.int64)
        leaders[where[order][first]] = names[order][first]
        return pa.table(
            {"bin": names, "into": leaders[where], "shift": shift, "fill": np.array(fills, np.int64)[where]}
        )

    group = F.pmod(F.xxhash64("bin", F.lit(level)), F.lit(groups)).alias("group")
    return bins.select("bin", "fill", group).groupBy("group").applyInArrow(pack, schema)


def pack_documents(docs: DataFrame, vocabulary: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """One row for each piece: where it lies in the packed sequences.

    Columns: doc_id, piece, start, length, ids_crc32, sequence_id, offset. A
    document is its token ids and the end id; null text counts as empty and is the
    end id alone. Rows that repeat are packed as often; a null doc_id stays null.
    ``sequence_id`` numbers have gaps.
    """
    pieces = saved(local_pieces(docs, vocabulary, capacity), "packing-pieces")
    least = int(NEARLY_FULL * capacity)
    bins = saved(
        pieces.where(F.col("fill") < least).groupBy("bin").agg(F.max("fill").alias("fill")), "packing-bins"
    )
    count = bins.count()
    moves = None
    for level in range(1, MAX_LEVELS + 1):
        if count < 2:
            break
        merged = saved(merged_bins(bins, level, count, capacity), "packing-level")
        step = merged.select("bin", "into", "shift")
        if moves is None:
            moves = step
        else:
            ahead = step.select(F.col("bin").alias("into"), F.col("into").alias("next"), F.col("shift").alias("more"))
            moves = saved(
                moves.join(ahead, "into", "left").select(
                    "bin", F.coalesce("next", "into").alias("into"), (F.col("shift") + F.coalesce("more", F.lit(0))).alias("shift")
                ),
                "packing-moves",
            )
        left = merged.where((F.col("bin") == F.col("into")) & (F.col("fill") < least))
        bins = left.select("bin", "fill")
        before, count = count, bins.count()
        # One group has seen all there is; several may still gain from new company.
        if before <= GROUP_BINS or count > 0.98 * before:
            break
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]
    if moves is None:
        return pieces.select(*names, F.col("bin").alias("sequence_id"), F.col("place").alias("offset"))
    done = pieces.where(F.col("fill") >= least)
    open_ = pieces.where(F.col("fill") < least).join(moves, "bin")
    return done.select(*names, F.col("bin").alias("sequence_id"), F.col("place").alias("offset")).unionByName(
        open_.select(*names, F.col("into").alias("sequence_id"), (F.col("place") + F.col("shift")).alias("offset"))
    )

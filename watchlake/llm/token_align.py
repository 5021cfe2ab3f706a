"""Alignment of two tokenizers' tokens over the same bytes, and how often token pairs meet.

Every text, after one space, is encoded by a byte-level vocabulary (A) and by a
piece vocabulary (B, which adds that space itself). The libraries' own spans are
the coarse cuts: character offsets of A, byte spans of B. Where several tokens
share a character, or a character is spelled in byte tokens, the spans say nothing;
there the tokens' decoded bytes set the cuts. Offsets where both sides end part the
tokens into groups, and tokens whose byte ranges overlap are linked.

Two passes over the documents' rows, none over their texts twice: tasks align whole
texts and write, for each row, its own numbers and its distinct linked pairs as
numbers of its block's list, and for each block of rows the list of pairs with the
number of rows that hold each. Counts are added up over the corpus by a shuffle, sent
back to the blocks that need them, and met there by the rows.
"""

import hashlib
import re
import zlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from watchlake.llm.common import without_cycle_search
from watchlake.session import new_work_folder

VOCABULARY_A = "byte_bpe_50k.json"
VOCABULARY_B = "piece_bpe_32k.model"
BLOCK_CHARS = 8_000_000
BLOCK_ROWS = 20_000
# Texts whose unknown units are learned together.
_TEXTS = 64
_CACHE = 900_000
_LONGEST_CACHED = 48
_MARK = "▁"
# Both vocabularies start a new token before a space or a line end between two other signs.
_CUT = re.compile(r"(?<=\S)(?=[ \n]\S)")
_BYTE_PIECE = re.compile(r"<0x([0-9A-F]{2})>")

ROW_FIELDS = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string"
ALIGNED = f"kind int, block long, {ROW_FIELDS}, held binary, place int, code long, docs long"


def byte_level_alphabet() -> dict[str, int]:
    """The byte that each sign of a byte-level vocabulary stands for.

    Printable Latin-1 signs stand for themselves, the others in their order for what
    follows U+00FF.
    """
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(rest)}


def refined_ends(coarse: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Byte offsets where tokens end, from coarse ends and the sizes of their decoded bytes.

    A coarse end is right for the last token that has it, unless it goes back; other tokens
    inside the same sign end where their decoded bytes do.
    """
    ends = np.cumsum(sizes)
    sure = np.append(coarse[1:] > coarse[:-1], True) & (coarse > ends - sizes)
    return np.where(sure, coarse, ends)


class Aligner:
    """Aligned units of texts, the units that were seen before from a bounded cache.

    A unit starts with its space or line end and goes to the next one that stands
    between two other signs; neither vocabulary has a token across such a place (checked
    for B, whose pieces are learned; where it had one, texts would be units as a whole).
    """

    def __init__(self, path_a: str, path_b: str):
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        alphabet = byte_level_alphabet()
        self.bytes_a = {
            i: bytes(alphabet[c] for c in token) if all(c in alphabet for c in token) else token.encode()
            for token, i in self.a.get_vocab(with_added_tokens=False).items()
        }
        self.bytes_b, apart = [], True
        for i in range(self.b.get_piece_size()):
            piece = self.b.id_to_piece(i)
            byte = _BYTE_PIECE.fullmatch(piece) if self.b.is_byte(i) else None
            self.bytes_b.append(bytes([int(byte[1], 16)]) if byte else piece.replace(_MARK, " ").encode())
            apart = apart and not (_MARK in piece.lstrip(_MARK) or "\n" in piece)
        self.size_a = np.zeros(max(self.bytes_a) + 1, np.int64)
        self.size_a[list(self.bytes_a)] = list(map(len, self.bytes_a.values()))
        self.size_b = np.array(list(map(len, self.bytes_b)))
        # Without the added space at the start, or with signs changed, units could not be put together.
        probe = self.b.encode(" a  b\nc", return_type="proto").pieces
        whole = b"".join(self.bytes_b[p.id] for p in probe)
        self.apart = apart and whole == b"  a  b\nc"
        self.width = len(self.bytes_b)
        self.clear()

    def clear(self) -> None:
        self.known: dict[str, int] = {}
        self.groups: list[str] = []
        self.sizes = [array("q"), array("q"), array("q"), array("b")]  # tokens of A, of B, groups, whether bytes agree
        self.codes, self.starts = array("q"), array("q", [0])
        self.chars = 0

    def units(self, text: str) -> list[str]:
        spaced = " " + text
        return _CUT.split(spaced) if self.apart else [spaced]

    def _learn(self, fresh: list[str]) -> None:
        """Units that start and end as any unit inside a text are encoded as one text, others alone."""
        together, alone = [], []
        for unit in fresh:
            plain = self.apart and len(unit) > 1 and unit[0] in " \n" and not unit[1].isspace() and not unit[-1].isspace() and _MARK not in unit
            (together if plain else alone).append(unit)
        blocks = [together[i : i + 1024] for i in range(0, len(together), 1024)]
        while blocks:
            block = blocks.pop()
            if self._learn_spans([" a", *block]):
                continue
            # One unit is enough to fail a block: the halves without it may pass.
            if len(block) > 8:
                blocks += [block[: len(block) // 2], block[len(block) // 2 :]]
            else:
                alone += block
        for unit in alone:
            if unit not in self.known and not self._learn_spans([unit]):
                self._keep_unaligned(unit)

    def _spans(self, text: str, raw: bytes) -> tuple[np.ndarray, ...] | None:
        """Ids of A and B and the byte offsets where their tokens end; None if they do not spell the text."""
        a = self.a.encode(text, add_special_tokens=False)
        inner = text[1:] if text[0] == " " else text
        # B's spans leave out the space that it added.
        shift = len(text) - len(inner)
        pieces = [(p.id, p.end + shift) for p in self.b.encode(inner, return_type="proto").pieces]
        if not shift and pieces and self.bytes_b[pieces[0][0]] == b" ":
            # A unit after a line end has no added space of its own: its piece is no token.
            pieces = pieces[1:]
        ids_a, ids_b = np.array(a.ids, np.int64), np.array([i for i, _ in pieces], np.int64)
        if b"".join(map(self.bytes_a.__getitem__, a.ids)) != raw or b"".join([self.bytes_b[i] for i, _ in pieces]) != raw:
            return None
        coarse = np.array([end for _, end in a.offsets])
        if len(raw) != len(text):
            signs = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
            edges = np.concatenate([[0], np.cumsum(1 + (signs >= 0x80) + (signs >= 0x800) + (signs >= 0x10000))])
            coarse = edges[coarse]
        ends_a, ends_b = refined_ends(coarse, self.size_a[ids_a]), refined_ends(np.array([end for _, end in pieces]), self.size_b[ids_b])
        right = ends_a[-1] == ends_b[-1] == len(raw) and (np.diff(ends_a) > 0).all() and (np.diff(ends_b) > 0).all()
        return (ids_a, ends_a, ids_b, ends_b) if right else None

    def _learn_spans(self, units: list[str]) -> bool:
        """Aligns units as one text; False, and nothing kept, unless both sides end a token where each ends."""
        raws = [unit.encode("utf-8", "surrogatepass") for unit in units]
        found = self._spans("".join(units), b"".join(raws))
        if found is None:
            return False
        ids_a, ends_a, ids_b, ends_b = found
        borders = np.cumsum(list(map(len, raws)))
        # An offset where both end closes a group; one where either ends closes a link.
        both, either = np.intersect1d(ends_a, ends_b), np.union1d(ends_a, ends_b)
        last = np.searchsorted(both, borders)
        if (both[np.minimum(last, len(both) - 1)] != borders).any():
            return False
        to_a, to_b = (np.searchsorted(ends, both) + 1 for ends in (ends_a, ends_b))
        codes = ids_a[np.searchsorted(ends_a, either)] * self.width + ids_b[np.searchsorted(ends_b, either)]
        links = np.searchsorted(either, borders) + 1
        text_a, text_b = list(map(str, ids_a.tolist())), list(map(str, ids_b.tolist()))
        groups, i, j = [], 0, 0
        for k, m in zip(to_a.tolist(), to_b.tolist()):
            groups.append(",".join(text_a[i:k]) + "|" + ",".join(text_b[j:m]))
            i, j = k, m
        first = len(units) - len(self._unmet(units))
        base = len(self.codes) - (int(links[first - 1]) if first else 0)
        low = int(last[first - 1]) + 1 if first else 0
        for unit, high in zip(units[first:], (last[first:] + 1).tolist()):
            self._keep(unit, ";".join(groups[low:high]))
            low = high
        before = lambda ends: np.diff(np.concatenate([[0], ends]))[first:].astype(np.int64)
        for column, numbers in zip(self.sizes, (before(to_a[last]), before(to_b[last]), before(last + 1))):
            column.frombytes(numbers.tobytes())
        self.sizes[3].extend([1] * (len(units) - first))
        self.codes.frombytes(codes[links[first - 1] if first else 0 :].tobytes())
        self.starts.frombytes((base + links[first:]).astype(np.int64).tobytes())
        return True

    def _unmet(self, units: list[str]) -> list[str]:
        """All units but a first one that is known already."""
        return units[1:] if units[0] in self.known else units

    def _keep(self, unit: str, groups: str) -> None:
        self.known[unit] = len(self.groups)
        self.chars += len(unit)
        self.groups.append(groups)

    def _keep_unaligned(self, unit: str) -> None:
        """A unit that the vocabularies do not spell byte for byte."""
        self._keep(unit, "")
        for column in self.sizes:
            column.append(0)
        self.starts.append(len(self.codes))

    def align(self, text: str | None) -> tuple[int, int, int, int, str, np.ndarray, np.ndarray]:
        """Tokens of A and B, groups, links, the groups' digest, and distinct pairs with their links.

        Null and empty texts, and those whose tokens do not spell them, have none.
        """
        return self.align_all([text])[0]

    def align_all(self, texts: list[str | None]) -> list[tuple[int, int, int, int, str, np.ndarray, np.ndarray]]:
        """``align`` of each text; units that none of them has met before are learned together."""
        with without_cycle_search():
            if len(self.groups) > _CACHE or self.chars > 20 * _CACHE:
                self.clear()
            split = [self.units(text) if text else [] for text in texts]
            found = [list(map(self.known.get, units)) for units in split]
            fresh = {u for units, at in zip(split, found) if None in at for u, i in zip(units, at) if i is None}
            if fresh:
                self._learn(list(fresh))
                found = [[self.known[u] for u in units] if None in at else at for units, at in zip(split, found)]
                for unit in fresh:
                    if len(unit) > _LONGEST_CACHED:
                        del self.known[unit]
            return [self._aligned(at) for at in found]

    def _aligned(self, found: list[int]) -> tuple[int, int, int, int, str, np.ndarray, np.ndarray]:
        """What ``align`` returns, of a text of these units."""
        nothing = (0, 0, 0, 0, "", np.empty(0, np.int64), np.empty(0, np.int64))
        if not found:
            return nothing
        groups = self.groups
        at, times = np.unique(np.array(found, np.int64), return_counts=True)
        if not np.frombuffer(self.sizes[3], np.int8)[at].all():
            return nothing
        n_a, n_b, n_groups = (int((np.frombuffer(column, np.int64)[at] * times).sum()) for column in self.sizes[:3])
        digest = hashlib.sha256(";".join([groups[i] for i in found]).encode()).hexdigest()
        starts = np.frombuffer(self.starts, np.int64)
        low, many = starts[at], starts[at + 1] - starts[at]
        flat = np.arange(int(many.sum())) + np.repeat(low - np.cumsum(many) + many, many)
        pairs, back = np.unique(np.frombuffer(self.codes, np.int64)[flat], return_inverse=True)
        links = np.bincount(back, weights=np.repeat(times, many), minlength=len(pairs)).astype(np.int64)
        return n_a, n_b, n_groups, int(links.sum()), digest, pairs, links


def pack(places: np.ndarray, links: np.ndarray) -> bytes:
    """Ascending numbers and their links, as steps in compressed planes of bytes."""
    both = np.concatenate([np.diff(places, prepend=0), links]).astype("<u4")
    return zlib.compress(both.view(np.uint8).reshape(-1, 4).T.tobytes(), 1)


def unpack(held: bytes) -> tuple[np.ndarray, np.ndarray]:
    both = np.ascontiguousarray(np.frombuffer(zlib.decompress(held), np.uint8).reshape(4, -1).T).view("<u4").ravel()
    half = len(both) // 2
    return np.cumsum(both[:half].astype(np.int64)), both[half:].astype(np.int64)


_ALIGNERS: dict[tuple[str, str], Aligner] = {}


def _aligner(path_a: str, path_b: str) -> Aligner:
    """One per Python worker: what it has learned serves the worker's later tasks, too."""
    if (path_a, path_b) not in _ALIGNERS:
        _ALIGNERS[path_a, path_b] = Aligner(path_a, path_b)
    return _ALIGNERS[path_a, path_b]


def aligned_blocks(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """Rows (kind 0) and blocks' pairs (kind 1) of ``docs`` (doc_id, text), see ``ALIGNED``."""
    fields = [f.split() for f in ALIGNED.split(", ")]
    kinds = {"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "binary": pa.binary()}

    def batch_of(columns: dict[str, list | np.ndarray], n: int) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(columns[name], kinds[kind]) if name in columns else pa.nulls(n, kinds[kind]) for name, kind in fields],
            [name for name, _ in fields],
        )

    def run(batches):
        aligner, first = _aligner(path_a, path_b), TaskContext.get().partitionId() << 32
        block, places, counts, rows, chars = first, {}, [], [], 0

        def finished():
            if rows:
                columns = list(zip(*rows))
                names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "held"]
                yield batch_of(dict(zip(names, columns)) | {"kind": [0] * len(rows), "block": [block] * len(rows)}, len(rows))
            codes = np.fromiter(places, np.int64, len(places))
            for i in range(0, len(codes), 50_000):
                n = len(codes[i : i + 50_000])
                yield batch_of(
                    {
                        "kind": np.ones(n, np.int32),
                        "block": np.full(n, block),
                        "place": np.arange(i, i + n, dtype=np.int32),
                        "code": codes[i : i + n],
                        "docs": counts[i : i + n],
                    },
                    n,
                )

        parts = (batch.slice(at, _TEXTS) for batch in batches for at in range(0, batch.num_rows, _TEXTS))
        for part in parts:
            texts = part.column(1).to_pylist()
            for doc_id, text, (*numbers, pairs, links) in zip(part.column(0).to_pylist(), texts, aligner.align_all(texts)):
                held = None
                if len(pairs):
                    own = np.empty(len(pairs), np.int64)
                    for i, code in enumerate(pairs.tolist()):
                        place = places.get(code)
                        if place is None:
                            place = places[code] = len(counts)
                            counts.append(1)
                        else:
                            counts[place] += 1
                        own[i] = place
                    order = np.argsort(own)
                    held = pack(own[order], links[order])
                rows.append((doc_id, *numbers, held))
                chars += len(text or "")
                if chars >= BLOCK_CHARS or len(rows) >= BLOCK_ROWS:
                    yield from finished()
                    block, places, counts, rows, chars = block + 1, {}, [], [], 0
        yield from finished()

    return docs.mapInArrow(run, ALIGNED)


def pair_counts(blocks: DataFrame, width: int) -> DataFrame:
    """(code, n, best): rows corpus-wide that hold a pair, and whether no pair of its A id has more.

    A pair's code is its A id times ``width``, the size of B, plus its B id.
    """
    totals = blocks.groupBy("code").agg(F.sum("docs").alias("n"))
    # At most ``width`` pairs share an A id.
    of_a = Window.partitionBy(F.expr(f"code div {width}"))
    return totals.select("code", "n", (F.col("n") == F.max("n").over(of_a)).alias("best"))


def align_tokens(docs: DataFrame, path_a: str | None = None, path_b: str | None = None) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): its tokens, groups and links under A and B.

    ``n_best`` counts the links whose pair is its A id's most frequent (ties included),
    ``count_sum`` adds up their pairs' counts, a pair's count being the number of rows
    corpus-wide that hold it. Null and empty texts and those that a vocabulary does not
    spell byte for byte get zeros and an empty digest. Rows that repeat, and rows without
    an id, come out as often and count as often. Other columns are left alone.
    """
    if path_a is None or path_b is None:
        import public_tokenizers

        path_a = path_a or public_tokenizers.path(VOCABULARY_A)
        path_b = path_b or public_tokenizers.path(VOCABULARY_B)
    spark = docs.sparkSession
    path = new_work_folder(spark, "aligned")
    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    written = aligned_blocks(chosen, path_a, path_b)
    written.write.partitionBy("kind").parquet(path)
    aligned, listed = (spark.read.schema(written.schema).parquet(path) for _ in range(2))
    pairs = listed.where("kind = 1").select("block", "place", "code", "docs")
    counted = pairs.select("block", "place", "code").join(
        pair_counts(pairs, _width(path_b)), "code"
    )
    rows = aligned.where("kind = 0").select("block", *[f.split()[0] for f in ROW_FIELDS.split(", ")], "held")

    def meet(own: pa.Table, counts: pa.Table) -> pa.Table:
        # A block's list has no gaps: every pair on it has a count.
        n, best = np.zeros(counts.num_rows, np.int64), np.zeros(counts.num_rows, bool)
        place = counts.column("place").to_numpy()
        n[place] = counts.column("n").to_numpy()
        best[place] = counts.column("best").to_numpy(zero_copy_only=False)
        n_best, count_sum = [], []
        for held in own.column("held").to_pylist():
            at, links = unpack(held) if held is not None else (np.empty(0, np.int64),) * 2
            n_best.append(int(links[best[at]].sum()))
            count_sum.append(int((links * n[at]).sum()))
        return own.drop_columns(["block", "held"]).append_column("n_best", pa.array(n_best, pa.int64())).append_column(
            "count_sum", pa.array(count_sum, pa.int64())
        )

    return (
        rows.groupBy("block")
        .cogroup(counted.select("block", "place", "n", "best").groupBy("block"))
        .applyInArrow(meet, f"{ROW_FIELDS}, n_best long, count_sum long")
        .select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
    )


def _width(path_b: str) -> int:
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path_b).get_piece_size()

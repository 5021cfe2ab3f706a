"""Phrases of two to four words that keep together, per language, by exact counts.

Tasks count phrases in HAT-tries: under a shallow trie of word numbers lie hash
containers, which burst into a further level when they grow; when a task's trie is
full, its largest subtrees leave as sorted runs. Runs of all tasks meet by language
and phrase, so a word or pair that a third of the corpus shares is dealt over many
tasks, and each task sends a phrase once a run.

A phrase is no more frequent than its parts, so three passes count words, pairs of
frequent words, and phrases of three and four words whose pairs are all frequent. What a
pass found frequent reaches the next one's tasks as a bitmap of bounded size: it may
let further phrases through, whose counts then say that they are too rare, but
keeps none back.
"""

from collections import Counter
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window, functions as F

from watchlake.llm.common import mix64, saved

MIN_COUNT = 30
LONGEST = 4
TOP = 2_000
#: A bitmap's size at most: 64 MB. It takes 16 bits a frequent word or pair, while there are as many.
MOST_BITS = 1 << 29
#: Entries of a task's tries, of one container, and words that are counted at a time.
TRIE_ENTRIES = 1_000_000
CONTAINER = 4_096
CHUNK_WORDS = 1_000_000
_ID_BITS = 21
_KNOWN = 500_000  # words of all languages that a task looks up without hashing them again
_RUN_ROWS = 50_000
_BORDER = b"\xff"  # never part of UTF-8

# Lower-cases A-Z; signs that end a piece become borders, tabs become spaces.
_SIGNS = bytes(
    0xFF if b in b".,;:!?\x0a\x0b\x0c\x0d" else 0x20 if b == 0x09 else b + 32 if 65 <= b <= 90 else b for b in range(256)
)
COUNTS = "lang string, phrase string, n long"


def words_and_borders(text: str | None) -> list[bytes]:
    """The words of a text in order, with a border between and behind its pieces."""
    raw = (text or "").encode("utf-8", "surrogatepass").translate(_SIGNS)
    return (raw + _BORDER).replace(_BORDER, b" \xff ").split()


# --- the trie ---------------------------------------------------------------


class HatTrie:
    """Counts of phrases of at most ``depth`` word numbers.

    The root leads from the first word to a container: a dict from the packed numbers of the
    further words (0 where the phrase has ended) to a count. A container of over ``CONTAINER``
    entries bursts into a ``Branch``, which leads on by the next word.
    """

    class Branch(dict):
        pass

    def __init__(self, depth: int):
        self.depth = depth
        self.root: dict[int, dict] = {}
        self.entries = 0

    def add(self, first: np.ndarray, rest: np.ndarray, counts: np.ndarray) -> None:
        """Adds phrases, in ascending order of (first, rest) and each one once."""
        for word, low, high in _runs(first):
            self.root[word] = self._add(self.root.get(word), rest[low:high], counts[low:high], self.depth - 2)

    def _add(self, node: dict | None, keys: np.ndarray, counts: np.ndarray, below: int) -> dict:
        if isinstance(node, self.Branch):
            shift = _ID_BITS * below
            low_keys = keys & ((1 << shift) - 1)
            for word, low, high in _runs(keys >> shift):
                node[word] = self._add(node.get(word), low_keys[low:high], counts[low:high], below - 1)
            return node
        if node is None:
            node = dict(zip(keys.tolist(), counts.tolist()))
            self.entries += len(node)
        else:
            before = len(node)
            for key, n in zip(keys.tolist(), counts.tolist()):
                node[key] = node.get(key, 0) + n
            self.entries += len(node) - before
        if len(node) > CONTAINER and below > 0:
            held = np.array(sorted(node.items()), np.int64)
            self.entries -= len(node)
            return self._add(self.Branch(), held[:, 0], held[:, 1], below)
        return node

    def _entries_of(self, node: dict) -> int:
        return sum(map(self._entries_of, node.values())) if isinstance(node, self.Branch) else len(node)

    def _gather(self, node: dict, above: int, below: int) -> list[tuple[np.ndarray, np.ndarray]]:
        if isinstance(node, self.Branch):
            shift = _ID_BITS * below
            return [part for word, child in node.items() for part in self._gather(child, above | (word << shift), below - 1)]
        keys = np.fromiter(node, np.int64, len(node)) | above
        return [(keys, np.fromiter(node.values(), np.int64, len(node)))]

    def spill(self, keep: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Whole subtrees, the largest first, until ``keep`` entries are left: columns first, rest, counts."""
        leaving = list(self.root)
        if keep:
            sizes = {word: self._entries_of(node) for word, node in self.root.items()}
            leaving, left = [], self.entries
            for word in sorted(sizes, key=sizes.get, reverse=True):
                if left <= keep:
                    break
                leaving.append(word)
                left -= sizes[word]
        nodes = [(word, self.root.pop(word)) for word in leaving]
        # Subtrees that have not burst, nearly all of them, leave together.
        whole = [(word, node) for word, node in nodes if not isinstance(node, self.Branch)]
        sizes = np.array([len(node) for _, node in whole], np.int64)
        size = int(sizes.sum())
        first = [np.repeat(np.array([word for word, _ in whole], np.int64), sizes)]
        rest = [np.fromiter(chain.from_iterable(node for _, node in whole), np.int64, size)]
        counts = [np.fromiter(chain.from_iterable(node.values() for _, node in whole), np.int64, size)]
        for word, node in nodes:
            if isinstance(node, self.Branch):
                for keys, n in self._gather(node, 0, self.depth - 2):
                    first.append(np.full(len(keys), word, np.int64))
                    rest.append(keys)
                    counts.append(n)
        columns = tuple(map(np.concatenate, (first, rest, counts)))
        self.entries -= len(columns[0])
        return columns


def _runs(values: np.ndarray):
    """(value, from, to) of each run of equal values."""
    if len(values):
        edges = [0, *(np.flatnonzero(np.diff(values)) + 1).tolist(), len(values)]
        yield from zip(values[edges[:-1]].tolist(), edges[:-1], edges[1:])


# --- what is frequent, as a bitmap ------------------------------------------


def word_hash(lang: str, word: bytes) -> int:
    return xxhash.xxh64_intdigest(lang.encode("utf-8", "surrogatepass") + b"\x00" + word, seed=42)


def pair_hashes(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    return mix64(mix64(first, 11) + second, 12)


def _places(hashes: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    return (hashes & np.uint64(bits - 1)).astype(np.int64), (hashes >> np.uint64(64 - bits.bit_length() + 1)).astype(np.int64)


class Bitmap:
    """Two bits for each hash that was put in; ``has`` is true for all of them and for few others."""

    def __init__(self, words: np.ndarray):
        self.words, self.bits = words, 64 * len(words)

    def has(self, hashes: np.ndarray) -> np.ndarray:
        out = np.ones(len(hashes), bool)
        for place in _places(hashes, self.bits):
            out &= (self.words[place >> 6] >> (place & 63).astype(np.uint64)) & np.uint64(1) == 1
        return out


def bitmap_of(frequent: DataFrame, rows: int) -> Bitmap:
    """A bitmap of words or pairs (lang, phrase); tasks hash them, and what reaches the driver has at most its size."""
    bits = min(MOST_BITS, max(1 << 16, 1 << (16 * rows).bit_length()))

    def run(batches):
        for batch in batches:
            hashes = []
            for lang, phrase in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                hashes.append([word_hash(lang, w) for w in phrase.encode("utf-8", "surrogatepass").split(b" ")])
            if hashes:
                table = np.array(hashes, np.uint64)
                own = table[:, 0] if table.shape[1] == 1 else pair_hashes(table[:, 0], table[:, 1])
                places = np.unique(np.concatenate(_places(own, bits)))
                slots, at = np.unique(places >> 6, return_inverse=True)
                held = np.zeros(len(slots), np.uint64)
                np.bitwise_or.at(held, at, np.uint64(1) << (places & 63).astype(np.uint64))
                yield pa.RecordBatch.from_arrays([pa.array(slots), pa.array(held.view(np.int64))], ["slot", "held"])

    table = frequent.select("lang", "phrase").mapInArrow(run, "slot long, held long").groupBy("slot").agg(F.bit_or("held").alias("held")).toArrow()
    words = np.zeros(bits // 64, np.uint64)
    words[table.column("slot").to_numpy()] = table.column("held").to_numpy().view(np.uint64)
    return Bitmap(words)


# --- counting passes --------------------------------------------------------


class _Numbers(dict):
    """Numbers of a language's words, from 1; 0 for borders and for words that are not frequent."""

    def __init__(self, lang: str, frequent: Bitmap):
        self.lang, self.frequent = lang, frequent
        self.reset()

    def reset(self) -> None:
        self.clear()
        self[_BORDER] = 0
        self.names, self.hashes = [b""], [0]

    def of(self, words: list[bytes]) -> np.ndarray:
        """The numbers of words in a row; those not met before are looked up together."""
        fresh = list(set(words).difference(self))
        hashes = [word_hash(self.lang, word) for word in fresh]
        kept = self.frequent.has(np.array(hashes, np.uint64)).tolist()
        for word, h, frequent in zip(fresh, hashes, kept):
            self[word] = len(self.names) if frequent else 0
            if frequent:
                self.names.append(word)
                self.hashes.append(h)
        return np.fromiter(map(self.get, words), np.int64, len(words))

    def forget(self) -> None:
        """Drops what is known of words that are not frequent."""
        kept = {word: number for word, number in self.items() if number}
        self.clear()
        self.update(kept)
        self[_BORDER] = 0


def _run_rows(lang: str, phrases: list[bytes], counts: list[int]):
    """Batches of (lang, phrase, n), as they come."""
    for i in range(0, len(phrases), _RUN_ROWS):
        own = phrases[i : i + _RUN_ROWS]
        yield pa.RecordBatch.from_arrays(
            [pa.array([lang] * len(own)), pa.array(own, pa.binary()).cast(pa.string()), pa.array(counts[i : i + _RUN_ROWS], pa.int64())],
            ["lang", "phrase", "n"],
        )


def _texts(batches):
    for batch in batches:
        yield from zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())


def _count_words(batches):
    """(lang, word, n) in sorted runs, and (lang, null, all words)."""
    held: dict[str, Counter] = {}
    waiting: dict[str, list[bytes]] = {}
    totals: dict[str, int] = {}
    n_waiting = n_bytes = 0

    def settle():
        for lang, words in waiting.items():
            own = held.setdefault(lang, Counter())
            own.update(words)
            totals[lang] = totals.get(lang, 0) + len(words) - own.pop(_BORDER, 0)
        waiting.clear()

    def spilled():
        for lang, own in held.items():
            words, counts = pa.array(own.keys(), pa.binary()), pa.array(own.values(), pa.int64())
            order = pc.sort_indices(words)
            for i in range(0, len(order), _RUN_ROWS):
                rows = order[i : i + _RUN_ROWS]
                yield pa.RecordBatch.from_arrays(
                    [pa.repeat(pa.scalar(lang), len(rows)), words.take(rows).cast(pa.string()), counts.take(rows)], ["lang", "phrase", "n"]
                )
        held.clear()

    for lang, text in _texts(batches):
        words = words_and_borders(text)
        waiting.setdefault(lang, []).extend(words)
        n_waiting, n_bytes = n_waiting + len(words), n_bytes + len(text or "")
        if n_waiting >= CHUNK_WORDS or n_bytes >= 32_000_000:
            settle()
            n_waiting = 0
            # Words may be of any length; what is held is bounded by the bytes that came in, too.
            if sum(map(len, held.values())) > TRIE_ENTRIES // 2 or n_bytes >= 256_000_000:
                yield from spilled()
                n_bytes = 0
    settle()
    yield from spilled()
    yield pa.RecordBatch.from_arrays(
        [pa.array(totals, pa.string()), pa.nulls(len(totals), pa.string()), pa.array(totals.values(), pa.int64())], ["lang", "phrase", "n"]
    )


def _count_phrases(depth: int, words: Bitmap, pairs: Bitmap | None):
    """Pairs of frequent words (depth 2), or phrases of 3 to ``depth`` words of frequent pairs."""

    def runs_of(lang: str, numbers: _Numbers, subtrees: tuple[np.ndarray, np.ndarray, np.ndarray]):
        mask = (1 << _ID_BITS) - 1
        first, rest, n = subtrees
        found = []  # by length: columns of word numbers, and counts
        # A shorter phrase counts whatever follows it.
        for length in range(min(depth, 3), depth + 1):
            word, heads, sums = first, rest, n
            if length < depth:
                bits = _ID_BITS * (length - 1)
                packed, at = np.unique((first << bits) | (rest >> (_ID_BITS * (depth - length))), return_inverse=True)
                word, heads = packed >> bits, packed & ((1 << bits) - 1)
                sums = np.bincount(at, weights=n, minlength=len(heads)).astype(np.int64)
            whole = heads & mask != 0
            heads = heads[whole]
            further = [(heads >> (_ID_BITS * i)) & mask for i in range(length - 2, -1, -1)]
            found.append((word[whole], *further, sums[whole]))
        names = pa.array(numbers.names, pa.binary())
        rank = np.empty(len(names), np.int64)
        rank[pc.sort_indices(names).to_numpy()] = np.arange(len(names))
        for *words, counts in found:
            order = np.lexsort([rank[column] for column in reversed(words)])
            for i in range(0, len(order), _RUN_ROWS):
                rows = order[i : i + _RUN_ROWS]
                spelled = pc.binary_join_element_wise(*[names.take(pa.array(column[rows])) for column in words], b" ").cast(pa.string())
                yield pa.RecordBatch.from_arrays(
                    [pa.repeat(pa.scalar(lang), len(rows)), spelled, pa.array(counts[rows])], ["lang", "phrase", "n"]
                )

    def windows(numbers: _Numbers, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First words, and the packed rest, of all phrases to count."""
        if depth == 2:
            both = (ids[:-1] > 0) & (ids[1:] > 0)
            return ids[:-1][both], ids[1:][both]
        hashes = np.array(numbers.hashes, np.uint64)
        kept = np.zeros(len(ids) + depth, bool)
        near = np.flatnonzero((ids[:-1] > 0) & (ids[1:] > 0))
        kept[near] = pairs.has(pair_hashes(hashes[ids[near]], hashes[ids[near + 1]]))
        start = np.flatnonzero(kept[: len(ids)] & kept[1 : len(ids) + 1])
        rest, on = np.zeros(len(start), np.int64), np.ones(len(start), bool)
        padded = np.concatenate([ids, np.zeros(depth, np.int64)])
        for i in range(1, depth):
            on &= kept[start + i - 1]
            rest = (rest << _ID_BITS) | np.where(on, padded[start + i], 0)
        return ids[start], rest

    def run(batches):
        tries: dict[str, tuple[_Numbers, HatTrie]] = {}
        waiting: dict[str, list[bytes]] = {}
        n_waiting = 0

        def settle():
            known = [numbers for numbers, _ in tries.values()]
            if sum(len(numbers.names) for numbers in known) > _KNOWN:
                for lang, (numbers, trie) in tries.items():
                    yield from runs_of(lang, numbers, trie.spill(0))
                    numbers.reset()
            elif sum(map(len, known)) > _KNOWN:
                for numbers in known:
                    numbers.forget()
            for lang, tokens in waiting.items():
                if lang not in tries:
                    tries[lang] = _Numbers(lang, words), HatTrie(depth)
                numbers, trie = tries[lang]
                ids = numbers.of(tokens)
                first, rest = windows(numbers, ids)
                if depth == 2:
                    packed = np.sort((first << _ID_BITS) | rest)
                    first, rest = packed >> _ID_BITS, packed & ((1 << _ID_BITS) - 1)
                else:
                    order = np.lexsort((rest, first))
                    first, rest = first[order], rest[order]
                new = np.ones(len(first), bool)
                new[1:] = (np.diff(first) != 0) | (np.diff(rest) != 0)
                at = np.flatnonzero(new)
                trie.add(first[at], rest[at], np.diff(at, append=len(first)))
            waiting.clear()
            if sum(trie.entries for _, trie in tries.values()) > TRIE_ENTRIES:
                for lang, (numbers, trie) in tries.items():
                    yield from runs_of(lang, numbers, trie.spill(trie.entries // 4))

        for lang, text in _texts(batches):
            tokens = words_and_borders(text)
            # Of a very long text, chunks overlap by the words that a phrase may still need.
            for i in range(0, len(tokens), CHUNK_WORDS):
                part = tokens[i : i + CHUNK_WORDS]
                if i + CHUNK_WORDS < len(tokens):
                    part = part + [_BORDER]
                waiting.setdefault(lang, []).extend(part)
                n_waiting += len(part)
                if n_waiting >= CHUNK_WORDS:
                    yield from settle()
                    n_waiting = 0
                if i + CHUNK_WORDS < len(tokens):
                    # Phrases across the chunk's end, and none that lies within either side.
                    yield from across(lang, tokens[i + CHUNK_WORDS - depth + 1 : i + CHUNK_WORDS + depth - 1], depth - 1)
        yield from settle()
        for lang, (numbers, trie) in tries.items():
            yield from runs_of(lang, numbers, trie.spill(0))

    def across(lang: str, tokens: list[bytes], border: int):
        """Phrases over a border between chunks, counted one by one."""
        sizes = [2] if depth == 2 else range(3, depth + 1)
        found = []
        for size in sizes:
            for i in range(max(0, border - size + 1), min(border, len(tokens) - size + 1)):
                phrase = tokens[i : i + size]
                if _BORDER not in phrase:
                    found.append(b" ".join(phrase))
        yield from _run_rows(lang, found, [1] * len(found))

    return run


def _summed(runs: DataFrame, min_count: int) -> DataFrame:
    return runs.groupBy("lang", "phrase").agg(F.sum("n").alias("n")).where(F.col("phrase").isNull() | (F.col("n") >= min_count))


def frequent_phrases(docs: DataFrame, min_count: int = MIN_COUNT) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, n) of all phrases of 1 to ``LONGEST`` words that occur ``min_count`` times, and (lang, n) of all words.

    A null lang counts as ``und``.
    """
    texts = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("string").alias("text"))
    singles = saved(_summed(texts.mapInArrow(_count_words, COUNTS), min_count), "collocation-words")
    totals = singles.where("phrase is null").select("lang", "n")
    words = singles.where("phrase is not null")
    word_map = bitmap_of(words, words.count())
    pairs = saved(_summed(texts.mapInArrow(_count_phrases(2, word_map, None), COUNTS), min_count), "collocation-pairs")
    pair_map = bitmap_of(pairs, pairs.count())
    longer = saved(_summed(texts.mapInArrow(_count_phrases(LONGEST, word_map, pair_map), COUNTS), min_count), "collocation-longer")
    return words.unionByName(pairs).unionByName(longer), totals


# --- scores -----------------------------------------------------------------


def _slice(words: Column, low, n) -> Column:
    return F.array_join(F.slice(words, low, n), " ")


def collocations(docs: DataFrame, min_count: int = MIN_COUNT, top: int = TOP) -> DataFrame:
    """Each language's ``top`` phrases: (lang, rank, phrase, a, l, r, n, score).

    ``docs`` has lang and text; null lang is ``und``, null text empty; repeated rows count as
    often, other columns are left alone. Words are runs of anything but spaces and tabs in pieces between
    ``.,;:!?`` and line ends, A-Z lower-cased. ``a`` counts the phrase, ``l`` and ``r`` the two
    parts of its lowest-scoring cut (ties: after fewer words), ``n`` the language's words; the
    score is floor(2000000 a / (l + r)), exact. A phrase inside a longer one that is at least
    four fifths as frequent is left out. Order: score, ``a``, then the phrase's bytes.
    """
    counts, totals = frequent_phrases(docs, min_count)
    counts = counts.withColumn("words", F.split("phrase", " "))
    long_enough = counts.where(F.size("words") >= 2).select("lang", "phrase", F.col("n").alias("a"), "words")
    cuts = long_enough.withColumn("k", F.explode(F.sequence(F.lit(1), F.size("words") - 1))).select(
        "lang", "phrase", "a", "k", _slice(F.col("words"), 1, F.col("k")).alias("head"), _slice(F.col("words"), F.col("k") + 1, F.size("words")).alias("tail")
    )
    part = lambda name, count: counts.select("lang", F.col("phrase").alias(name), F.col("n").alias(count))
    both = cuts.join(part("head", "l"), ["lang", "head"]).join(part("tail", "r"), ["lang", "tail"])
    score = F.expr("cast(2000000 as decimal(7,0)) * cast(a as decimal(20,0)) div (cast(l as decimal(20,0)) + cast(r as decimal(20,0)))")
    lowest = both.groupBy("lang", "phrase").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut"), F.first("a").alias("a"))
    size = F.size("words")
    places = F.flatten(
        F.transform(F.sequence(F.lit(2), size - 1), lambda m: F.transform(F.sequence(F.lit(1), size - m + 1), lambda i: _slice(F.col("words"), i, m)))
    )
    inside = long_enough.where(size >= 3).select("lang", F.explode(places).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    kept = lowest.join(inside, ["lang", "phrase"], "left").where(
        F.col("longer").isNull() | (F.col("longer").cast("decimal(20,0)") * 100 < F.col("a").cast("decimal(20,0)") * 80)
    )
    best = Window.partitionBy("lang").orderBy(F.desc("cut.score"), F.desc("a"), "phrase")
    ranked = kept.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top)
    return ranked.join(totals, "lang").select(
        "lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), "n", F.col("cut.score").alias("score")
    )

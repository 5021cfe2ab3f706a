"""Near-duplicate documents by 64-bit SimHash fingerprints.

Fingerprints are embedded as popcounts: 32 segments of two bits each. Moving from
one fingerprint to another changes a segment's count by at most the number of bits
that differ there, so the Manhattan distance of two embeddings never exceeds the
Hamming distance of the fingerprints. Fingerprints within 3 bits are therefore
within Manhattan distance 3, and in one of the two halves of 16 segments within 1.
That is a range join on a unit grid, once for each half: cells are the half's
popcounts, and a point meets those of its own cell and of the cells one step up.
What meets is verified on all 64 bits.

Exact copies share a fingerprint and take part once.
"""

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from watchlake.llm.common import components, free_name, saved, words_of

SHINGLE_WORDS = 3
MAX_DISTANCE = 3
_SEED = 42
_BLOCK = 1 << 15


def fingerprint(words: list[bytes], shingle_words: int = SHINGLE_WORDS) -> int:
    """The SimHash of a word sequence, unsigned; 0 for no words.

    A bit is set if more than half of the shingles' hashes have it. Fewer words
    than a shingle count as one shingle.
    """
    if not words:
        return 0
    line = memoryview(b" ".join(words))
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1)).tolist()
    ends = ends[min(shingle_words, len(words)) - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(line[s:e], _SEED) for s, e in zip(starts, ends)), "<u8", len(ends))
    counts = np.zeros(64, np.int64)
    for i in range(0, len(hashes), _BLOCK):
        block = hashes[i : i + _BLOCK].view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(block, axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    bits = np.packbits(2 * counts > len(hashes), bitorder="little")
    return int(bits.view("<u8")[0])


def with_fingerprints(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", digest: Column | None = None) -> DataFrame:
    """(id, fp) for every document, fp a signed long; null text counts as empty. ``digest``, if given, comes along."""
    more = [] if digest is None else [digest.alias("digest")]
    source = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text"), *more)

    def run(batches):
        for batch in batches:
            values = [fingerprint(words_of(t)) for t in batch.column(1).to_pylist()]
            signed = np.array(values, np.uint64).view(np.int64)
            columns = [batch.column(0), pa.array(signed), *batch.columns[2:]]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "fp", *batch.schema.names[2:]])

    return source.mapInArrow(run, "doc_id long, fp long" + ", digest string" * len(more))


def _popcounts(bits: Column) -> Column:
    """Sixteen two-bit popcounts of the lower 32 bits, packed into one long."""
    odd = F.lit(0x55555555)
    return bits.bitwiseAND(odd) + F.shiftrightunsigned(bits, 1).bitwiseAND(odd)


def _cells(points: DataFrame) -> DataFrame:
    """The popcount cell of each half: (fp, half, cell)."""
    low, high = F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned("fp", 32)
    return points.select(
        "fp",
        F.posexplode(F.array(_popcounts(low), _popcounts(high))).alias("half", "cell"),
    )


def near_pairs(points: DataFrame, max_distance: int = MAX_DISTANCE) -> DataFrame:
    """Pairs (a, b) of different fingerprints at most ``max_distance`` <= 3 bits apart.

    ``points`` has one row for each fingerprint. A pair found in both halves comes
    twice. Each point is stored in its own cell of either half, and asks that cell
    and those where one segment counts one more (its lower neighbour asks the other
    way). No cell is gathered; hot cells are split by the skew join.
    """
    if not 0 <= max_distance <= 3:
        raise ValueError("the halves argument holds for distances up to 3")
    cells = _cells(points)
    ups = F.array(
        *[
            F.when(
                F.shiftrightunsigned("cell", 2 * i).bitwiseAND(F.lit(3)) < 2, F.col("cell") + F.lit(1 << (2 * i))
            )
            for i in range(16)
        ]
    )
    asks = cells.select(
        F.col("fp").alias("a"),
        "half",
        F.explode(F.array_append(F.array_compact(ups), F.col("cell"))).alias("at"),
        F.col("cell").alias("own"),
    )
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_distance
    # In one's own cell each pair would come both ways.
    once = (F.col("at") != F.col("own")) | (F.col("a") < F.col("b"))
    stored = cells.select(F.col("fp").alias("b"), F.col("half").alias("h"), "cell")
    met = asks.join(stored, (F.col("half") == F.col("h")) & (F.col("at") == F.col("cell")) & near & once)
    return met.select("a", "b")


def _labels(prints: DataFrame) -> DataFrame:
    """(fp, first, label): each fingerprint's smallest doc_id, and the component it is in."""
    points = prints.groupBy("fp").agg(F.min("doc_id").alias("first"))
    labels = components(near_pairs(points.select("fp")), "simhash-links")
    return (
        points.join(labels, points.fp == labels.node, "left")
        .select("fp", "first", F.coalesce("label", "fp").alias("label"))
    )


def simhash_components(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row for each document: (doc_id, fingerprint, component_id).

    ``component_id`` is the smallest doc_id that links of at most 3 bits reach.
    Null and blank texts have fingerprint 0 and link like any other. Rows that repeat
    come out as often; a null doc_id takes part but names no component, so
    ``component_id`` is null only where no document of the component has an id.
    """
    prints = saved(with_fingerprints(docs, id_column, text_column), "simhash-prints")
    named = _labels(prints)
    smallest = named.groupBy("label").agg(F.min("first").alias("component_id"))
    classes = named.join(smallest, "label").select("fp", "component_id")
    return prints.join(classes, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def keep_one_of_each(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``docs`` with one row of each near-duplicate component, all columns kept.

    The smallest id stays, or a document without an id where no document of the
    component has one; of several texts the first by digest. A component is chosen
    from alone, so what ids (null too) are elsewhere in the table does not matter.
    """
    digest = F.sha2(text_column, 256)
    prints = saved(with_fingerprints(docs, id_column, text_column, digest), "simhash-prints")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("without"), "doc_id", "digest"))
    # Copies are settled by fingerprint before anything is joined.
    best = prints.groupBy("fp").agg(first.alias("row")).join(_labels(prints), "fp").groupBy("label").agg(F.min("row").alias("row"))
    # An id and a text lie in one component, so these pairs are distinct.
    kept_id, kept_digest = (free_name(name, docs.columns) for name in ("_kept_id", "_kept_digest"))
    keys = saved(best.select(F.col("row.doc_id").alias(kept_id), F.col("row.digest").alias(kept_digest)), "simhash-kept")

    def chosen(rows, own_id, own_digest):
        return rows.join(keys, own_id.eqNullSafe(F.col(kept_id)) & own_digest.eqNullSafe(F.col(kept_digest)), "left_semi")

    kept = chosen(docs, docs[id_column].cast("long"), digest)
    found = chosen(prints, F.col("doc_id"), F.col("digest"))
    if found.groupBy("doc_id", "digest").count().where("count > 1").isEmpty():
        return kept
    # Rows alike in id and text come out once.
    return kept.dropDuplicates([id_column, text_column])

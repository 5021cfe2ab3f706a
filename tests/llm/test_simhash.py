"""SimHash components against brute force over all pairs of fingerprints."""

import random

import pytest
import xxhash
from pyspark.sql import functions as F

from watchlake.llm import simhash


def reference_fingerprint(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", lowered) if w]
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


@pytest.mark.parametrize("text", [None, "", " \n\t", "One", "one TWO", "a b c", "É a b c d e f\x0bg", "w " * 500])
def test_fingerprint(text):
    assert simhash.fingerprint(simhash.words_of(text)) == reference_fingerprint(text)


def test_spark_hash_agrees(spark):
    row = spark.sql("select xxhash64('one two thrée four five six seven') h").first()
    assert row.h & (2**64 - 1) == xxhash.xxh64_intdigest("one two thrée four five six seven".encode(), 42)


def brute_force_pairs(points):
    return {(min(a, b), max(a, b)) for a in points for b in points if a != b and bin((a ^ b) & (2**64 - 1)).count("1") <= 3}


def test_pairs_of_near_fingerprints(spark):
    draw = random.Random(3)
    points = set()
    for _ in range(60):
        base = draw.getrandbits(64)
        for _ in range(6):
            value = base
            for bit in draw.sample(range(64), draw.randint(0, 4)):
                value ^= 1 << bit
            points.add(value - 2**64 if value >> 63 else value)
    points |= {0, 1, -1, 3, 7, 15, -(2**63)}
    rows = spark.createDataFrame([(p,) for p in points], "fp long")
    got = {(min(r.a, r.b), max(r.a, r.b)) for r in simhash.near_pairs(rows).collect()}
    assert got == brute_force_pairs(points)


def brute_force_components(rows):
    prints = [reference_fingerprint(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if bin(prints[i] ^ prints[j]).count("1") <= 3:
                parent[root(i)] = root(j)
    ids = {}
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            ids[root(i)] = min(doc_id, ids.get(root(i), doc_id))
    return [(d, f"{p:016x}", ids.get(root(i))) for i, (d, p) in enumerate(zip([r[0] for r in rows], prints))]


def sample_rows():
    draw = random.Random(5)
    rows = []
    for group in range(12):
        words = [f"w{draw.randrange(400)}" for _ in range(draw.choice([1, 2, 40, 300]))]
        for _ in range(draw.choice([1, 2, 9])):
            copy = list(words)
            if len(copy) > 10 and draw.random() < 0.7:
                copy[draw.randrange(len(copy))] = "changed"
            rows.append((draw.randrange(10_000), " ".join(copy).title() if draw.random() < 0.3 else " ".join(copy)))
    return rows + [(7, None), (3, ""), (9, " \n"), (None, "alone without an id"), (None, None), rows[0]]


def test_components(spark):
    rows = sample_rows()
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, fp int, label string")
    got = simhash.simhash_components(docs).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(brute_force_components(rows), key=repr)


def test_one_of_each_stays(spark):
    rows = sample_rows()
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, component_id int")
    kept = simhash.keep_one_of_each(docs)
    assert kept.columns == docs.columns
    expected = {c for _, _, c in brute_force_components(rows)}
    assert sorted((r.doc_id for r in kept.collect()), key=repr) == sorted(expected, key=repr)


def test_one_row_of_each_component_whatever_the_ids(spark):
    """Ids that are missing or shared by several texts cost no component its row."""
    draw = random.Random(9)
    text = lambda: " ".join(f"w{draw.randrange(5000)}" for _ in range(60))
    alone = [text() for _ in range(5)]
    shared, twice, named = [text(), text()], text(), text()
    rows = [(None, t) for t in alone] + [(None, alone[0]), (1, named), (None, named)]
    rows += [(2, shared[0]), (2, shared[1]), (3, twice), (3, twice), (4, None), (None, "")]
    docs = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "doc_id long, text string, place int").repartition(4)
    got = [(r.doc_id, r.text) for r in simhash.keep_one_of_each(docs).collect()]
    expected = [(None, t) for t in alone] + [(1, named), (2, shared[0]), (2, shared[1]), (3, twice), (4, None)]
    assert sorted(got, key=repr) == sorted(expected, key=repr)


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.simhash_components(docs).count() == 0
    assert simhash.keep_one_of_each(docs).count() == 0


def test_embedding_is_a_lower_bound(spark):
    rows = spark.range(200).select(F.xxhash64("id").alias("fp"))
    for row in simhash._cells(rows).collect():
        part = (row.fp >> (32 * row.half)) & 0xFFFFFFFF
        counts = [bin(part >> (2 * i) & 3).count("1") for i in range(16)]
        assert [row.cell >> (2 * i) & 3 for i in range(16)] == counts


def test_columns_named_like_the_keys_stay(spark):
    docs = spark.createDataFrame([(1, "a b c d", 7, "x"), (2, "a b c d", 8, "y")], "doc_id long, text string, _kept_id int, _KEPT_digest string")
    kept = simhash.keep_one_of_each(docs)
    assert kept.columns == docs.columns and [tuple(r) for r in kept.collect()] == [(1, "a b c d", 7, "x")]

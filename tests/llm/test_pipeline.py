"""The pipeline's stages, one by one and together, on documents with planted cases."""

import random

import pytest

import corpus_pipeline
from watchlake.llm import decontaminate, pii_crf, simhash, toxicity
from watchlake.llm.packing import CAPACITY

BAD = ["grumbol", "stinkard", "wretchel", "vilemor", "snarkeel"]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    draw = random.Random(6)
    words = [f"{a}{b}{c}" for a in "bdfgk" for b in "aeiou" for c in ("n", "sta", "rim", "lo")]
    text = lambda n: " ".join(draw.choices(words, k=n))
    items = [(i, text(30)) for i in range(8)]
    docs, labels = [], []
    for i in range(240):
        body = text(draw.choice([40, 120, 300]))
        if i % 6 == 0:
            parts = body.split()
            for _ in range(5):
                parts.insert(draw.randrange(len(parts)), draw.choice(BAD))
            body = " ".join(parts)
        labels.append((i, 1, int(i % 6 == 0)))
        docs.append((i, body))
    clean = [d for d in docs if d[0] % 6]
    docs += [(300 + i, clean[i][1]) for i in range(10)]  # exact copies
    docs += [(400 + i, text(20) + " " + items[i][1] + " " + text(20)) for i in range(8)]
    docs += [(500, text(30) + " mail jo.doe@example.org or +1 (415) 555-2671 " + text(30)), (501, None), (502, ""), (503, text(9000))]
    path = tmp_path_factory.mktemp("tables")
    rows = [(i, t, "en", "src", None if t is None else len(t)) for i, t in docs]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path)


def test_stages(spark, folder):
    source = spark.read.parquet(f"{folder}/documents.parquet")
    docs, kept = source, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs
        docs = stage(spark, docs, folder).cache()
        assert docs.dtypes == source.dtypes, name
        kept[name] = {r.doc_id: r for r in docs.collect()}
        assert set(kept[name]) <= {r.doc_id for r in before.select("doc_id").collect()}
    toxic = {i for i in range(240) if i % 6 == 0}
    all_ids = {r.doc_id for r in source.select("doc_id").collect()}
    assert set(kept["toxicity"]) == all_ids - toxic
    # One of each component of equal or near fingerprints, by brute force.
    rows = sorted((r.doc_id, simhash.fingerprint(simhash.words_of(r.text))) for r in kept["toxicity"].values())
    first = set()
    for i, (doc_id, p) in enumerate(rows):
        if not any(bin(p ^ q).count("1") <= 3 for _, q in rows[:i]):
            first.add(doc_id)
    assert set(kept["near_duplicates"]) == first and not {300, 309} & first
    assert set(kept["near_duplicates"]) - set(kept["decontamination"]) == set(range(400, 408))
    masked = kept["personal_data"]
    assert set(masked) == set(kept["decontamination"])
    assert "<EMAIL>" in masked[500].text and "<PHONE>" in masked[500].text and masked[500].n_chars == len(masked[500].text)
    assert all(masked[i].text == r.text for i, r in kept["decontamination"].items() if i != 500)


def test_run(spark, folder):
    result = corpus_pipeline.run(spark, folder).collect()
    fills = {}
    for r in result:
        fills[r.sequence_id] = fills.get(r.sequence_id, 0) + r.length
    assert max(fills.values()) <= CAPACITY
    assert {r.doc_id for r in result} >= {500, 501, 503} and not {0, 300, 400, 502} & {r.doc_id for r in result}


def test_operators_of_the_stages():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "decontamination", "personal_data", "packing"]
    assert toxicity.THRESHOLD == 0.7 and simhash.MAX_DISTANCE == 3 and decontaminate.SIMILARITY == 0.8 and pii_crf.KINDS


def test_empty_tables(spark, tmp_path, folder):
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{folder}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0

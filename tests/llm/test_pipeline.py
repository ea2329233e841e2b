"""The pipeline: every stage's decision against the operators' brute-force rules, and odd or missing rows."""

from collections import Counter

import corpus_pipeline
from evidencelake.llm.queries import file_order
from evidencelake.session import materialise
from tests.llm.test_brute_force import WORDS, classes

ROOT = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{ROOT}/documents.parquet")
    tables = [docs]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        tables.append(materialise(stage(spark, tables[-1], ROOT), "stage"))
        assert tables[-1].columns == docs.columns
    start, good, single, clean, mixed = ([(r.doc_id, r.text) for r in t.collect()] for t in tables)
    assert set(good) < set(start) and all(len(WORDS.findall(t)) >= 50 for _, t in good)
    assert sorted(d for d, _ in single) == sorted({c for _, _, c in classes(good)})
    items = [WORDS.findall(r.text) for r in spark.read.parquet(f"{ROOT}/benchmark.parquet").collect()]
    holds = {d for d, t in single for item in items if " ".join(item) in " ".join(WORDS.findall(t))}
    assert holds and not holds & {d for d, _ in clean} and len(clean) >= len(single) - 2 * len(holds)
    assert set(mixed) <= set(clean) and max(Counter(d for d, _ in mixed).values()) == 2
    last = corpus_pipeline.STAGES[-1][1](spark, tables[-1], ROOT).collect()
    assert Counter(r.doc_id for r in last) == Counter(d for d, _ in mixed)
    assert sorted(map(tuple, last)) == sorted(map(tuple, corpus_pipeline.run(spark, ROOT).collect()))


def test_token_files_keep_the_mix(spark):
    """The files hold the shards one after another and each one shuffled: neighbours differ in source, and copies of a document lie apart."""
    docs = spark.read.parquet(f"{ROOT}/documents.parquet")
    mixed = materialise(corpus_pipeline.source_mix(spark, docs, ROOT), "mixed")
    source = {r.doc_id: r.source for r in docs.collect()}
    want = [r.doc_id for r in mixed.orderBy(*file_order(mixed)).collect()]
    got = [r.doc_id for r in corpus_pipeline.token_files(spark, mixed, ROOT).orderBy("start").collect()]
    assert got == want and got != sorted(got)
    pairs = list(zip(got, got[1:]))
    assert sum(source[a] != source[b] for a, b in pairs) > 0.4 * len(pairs) and sum(a == b for a, b in pairs) < 0.05 * len(pairs)


def test_odd_rows(spark, messy, hollow):
    assert {r.doc_id for r in corpus_pipeline.run(spark, messy).collect()} <= {5}
    assert corpus_pipeline.run(spark, hollow).count() == 0

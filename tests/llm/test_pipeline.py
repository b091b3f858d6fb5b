"""The pipeline's stages over the smallest tables, each against what its operator says."""

import corpus_pipeline as cp
import pytest

from tests.llm.test_jaccard import smallest
from tidemark.llm import queries, tiling, toxicity

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def ids(df):
    return sorted(r.doc_id for r in df.select("doc_id").collect())


def test_stage_order():
    assert [n for n, _ in cp.STAGES] == ["toxicity", "near_duplicates", "decontamination", "packing"]


def test_stages(spark, docs):
    labels, bench = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("labels", "benchmark"))
    clean = cp.toxicity(spark, docs, SF)
    assert clean.columns == cp.COLUMNS
    assert ids(clean) == sorted(r.doc_id for r in toxicity.score(docs, toxicity.train(docs, labels)).collect() if not r.predicted)
    single = cp.near_duplicates(spark, docs, SF)
    assert single.columns == cp.COLUMNS
    # The stage takes five-word shingles and a similarity of 0.8: brute force over all pairs.
    assert ids(single) == sorted(set(smallest([(r.doc_id, r.text) for r in docs.collect()]).values()))
    pure = cp.decontamination(spark, docs, SF)
    leaked = {r.doc_id for r in tiling.leaks(docs, bench).collect()}
    texts = {r.text for r in bench.collect()}
    assert {r.doc_id for r in docs.collect() if any(t in r.text for t in texts)} <= leaked
    assert ids(pure) == [i for i in ids(docs) if i not in leaked]


def test_run_packs_what_the_stages_keep(spark, docs):
    kept = docs
    for _, f in cp.STAGES[:-1]:
        kept = f(spark, kept, SF)
    packed = cp.run(spark, SF)
    assert sorted({r.doc_id for r in packed.collect()}) == ids(kept)


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_every_query_is_registered(name):
    import __spark_entry__

    assert name in __spark_entry__.queries()


def test_stages_survive_odd_rows(spark, edge, empty):
    """Nulls in any column, repeated rows, empty tables and columns that operators use inside."""
    odd = edge.unionByName(edge.limit(2).selectExpr("doc_id", "text", "null lang", "null source", "null n_chars", *edge.columns[5:]))
    for name, stage in cp.STAGES[:-1]:
        kept = stage(spark, odd, SF)
        assert kept.columns == cp.COLUMNS, name
        want = {r.doc_id for r in odd.collect()}
        assert {r.doc_id for r in kept.collect()} <= want
        assert stage(spark, empty, SF).count() == 0
    assert sum(r.length for r in cp.packing(spark, odd, SF).collect()) > odd.count()
    assert cp.packing(spark, empty, SF).count() == 0


def test_training_leaves_the_drivers_memory(spark, docs, monkeypatch):
    """Once the models are broadcast the driver gives its copies back, before the next stage's work."""
    told = []
    monkeypatch.setattr(cp, "release", lambda: told.append(True), raising=False)
    cp.toxicity(spark, docs, SF)
    assert told == [True]

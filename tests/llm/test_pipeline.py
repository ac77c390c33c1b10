import re

import pytest

import corpus_pipeline
from pricetrace.llm import packing, toxicity
from pricetrace.llm.queries import toxicity_model
from pricetrace.scratch import Staged
from tests.llm.test_dedup import groups

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    """Input and output rows of each stage."""
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        result = Staged(stage(spark, docs, SF), "stage").df
        out[name] = (docs.collect(), result.collect(), result.columns)
        docs = result
    return out


def test_all_but_the_last_return_documents(stages):
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "exact dedup", "near dedup", "mixing", "packing"]
    for name in ("toxicity", "exact dedup", "near dedup", "mixing"):
        assert stages[name][2] == ["doc_id", "text", "lang", "source", "n_chars"]


def test_toxic_documents_go(spark, stages):
    before, after, _ = stages["toxicity"]
    scorer = toxicity.Scorer(toxicity_model(spark, SF, spark.read.parquet(f"{SF}/documents.parquet")))
    assert {r["doc_id"] for r in after} == {r["doc_id"] for r in before if scorer.read(r["text"])[0] < 0.5}


def test_copies_go(stages):
    before, after, _ = stages["exact dedup"]
    first = {}
    for r in before:
        text = re.sub(r"[\x20\x09-\x0D]+", " ", r["text"] or "")
        first[text] = min(r["doc_id"], first.get(text, r["doc_id"]))
    assert sorted(r["doc_id"] for r in after) == sorted(first.values())


def test_near_copies_go(stages):
    before, after, _ = stages["near dedup"]
    want = {root for _, root in groups({r["doc_id"]: r["text"] for r in before}, 5).values()}
    assert sorted(r["doc_id"] for r in after) == sorted(want)


def test_mix_takes_words_of_its_documents(stages):
    before, after, _ = stages["mixing"]
    words = {r["doc_id"]: (r["text"] or "").split() for r in before}
    taken = {}
    for r in after:
        assert r["n_chars"] == len(r["text"]) and set(r["text"].split()) <= set(words[r["doc_id"]])
        taken[r["doc_id"]] = taken.get(r["doc_id"], 0) + len(r["text"].split())
    total = sum(map(len, words.values()))
    assert abs(sum(taken.values()) - total) < 0.02 * total and all(n <= 3 * len(words[k]) for k, n in taken.items())


def test_every_token_is_packed(stages):
    before, after, _ = stages["packing"]
    vocabulary = packing.default_vocabulary()
    assert sum(r["length"] for r in after) == sum(len(packing.token_ids(r["text"], vocabulary)) for r in before)
    sequences = {}
    for r in sorted(after, key=lambda r: (r["sequence_id"], r["offset"])):
        assert sequences.get(r["sequence_id"], 0) == r["offset"]
        sequences[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(sequences.values()) <= 1024


def test_stages_take_odd_rows(spark, odd, none):
    for table in (odd, none):
        docs = table.selectExpr("doc_id", "text", "source AS lang", "source", "cast(size AS bigint) AS n_chars")
        for name, stage in corpus_pipeline.STAGES:
            docs = Staged(stage(spark, docs, SF), "odd").df
        assert (docs.count() > 0) == (table is odd)

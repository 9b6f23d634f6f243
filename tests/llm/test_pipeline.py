"""The pipeline's stages on the smallest sample, each against its rule."""

import random

import corpus_pipeline
from gateledger.llm import quality, toxicity
from gateledger.llm.common import table
from gateledger.session import durable_table
from tests.llm.helpers import as_dict, awkward, words
from tests.llm.test_duplicates import brute_components, brute_repeats, near_copies


def test_stages_take_effect(spark, sample):
    docs = table(spark, sample, "documents")
    kept = [docs]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept.append(durable_table(stage(spark, kept[-1], sample)))
        assert kept[-1].columns == docs.columns
    rows = [as_dict(k) for k in kept]
    labels = table(spark, sample, "labels")
    marks = as_dict(toxicity.score(docs, toxicity.fit(docs, labels)))
    assert set(rows[1]) == {d for d, r in marks.items() if not r.predicted}
    judged = as_dict(quality.rules(kept[1], quality.fit(kept[1], labels)))
    assert set(rows[2]) == {d for d, r in judged.items() if r.kept}
    groups = brute_components([(d, r.text) for d, r in rows[2].items()], 80, 100, 5)
    assert set(rows[3]) == {d for d, (_, c) in groups.items() if c == d}
    repeats = brute_repeats([(d, r.text) for d, r in rows[3].items()], 100)
    assert set(rows[4]) == set(rows[3])
    for d, r in rows[4].items():
        gone = len(rows[3][d].text.encode()) - len(r.text.encode())
        assert repeats[d][1] - 8 * repeats[d][2] <= gone <= repeats[d][1]
    packed = corpus_pipeline.STAGES[-1][1](spark, kept[4], sample).collect()
    assert {r.doc_id for r in packed} == set(rows[4])
    assert len(corpus_pipeline.run(spark, sample).collect()) == len(packed)


def test_stages_of_an_empty_table(spark, sample):
    docs = table(spark, sample, "documents").where("doc_id < 0")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, sample).count() == 0


def leads(texts, num, den, shingle):
    return {d for d, (_, c) in brute_components(texts, num, den, shingle).items() if c == d}


def test_near_copies_share_four_fifths_of_five_words(spark, sample):
    rng = random.Random(4)
    texts = [(1000 + i, t) for i, t in near_copies(3, 80)]
    for i in range(12):
        text = words(rng, 90)
        edited = text.split()
        for at in (20, 65):  # two isolated edits
            edited[at] = "changed"
        texts += [(10 * i, text), (10 * i + 1, text + " " + words(rng, 20)),
                  (10 * i + 2, " ".join(text.split()[:75])), (10 * i + 3, " ".join(edited))]
    kept = corpus_pipeline.drop_near_copies(spark, awkward(spark, texts), sample)
    want = leads(texts, 80, 100, 5)
    assert {r.doc_id for r in kept.collect()} == want
    assert len(leads(texts, 85, 100, 4) - want) >= 12

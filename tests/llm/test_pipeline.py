"""The pipeline, stage by stage, against plain Python."""

import numpy as np
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from provider_analytics.llm import pii
from provider_analytics.llm.queries import END_ID, ORACLES, QUERIES, tokenizer_path

from .test_jaccard_join import plain as plain_components

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """What goes into each stage and what comes out, with a few documents that stages must handle."""
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    kind = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in docs.schema)
    odd = spark.createDataFrame([
        (10_000, "1234 $$ 5678", "en", "src0", 12), (10_001, None, None, "src0", None), (10_002, "", "en", None, 0),
        (10_003, docs.first().text, None, None, 1), (10_004, "write to a.b@mail.example or call +1 (017) 555-7713 the and of", None, "src1", 1),
        (10_005, "that the tion thing", "en", None, 1)], kind)
    at, out = docs.unionByName(odd), []
    for number, (_, stage) in enumerate(corpus_pipeline.STAGES):
        path = str(tmp_path_factory.mktemp("stage") / str(number))
        stage(spark, at, FOLDER).write.parquet(path)
        after = spark.read.parquet(path)
        out.append((at, after))
        at = after
    return out


def rows(df):
    return {r.doc_id: r for r in df.collect()}


def test_stages_are_those_asked_for_and_keep_the_columns(stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language identification", "near duplicates", "personal data", "source mix", "packing"]
    for before, after in stages[:-1]:
        assert [(f.name, f.dataType) for f in after.schema] == [(f.name, f.dataType) for f in before.schema]


def test_language_rejects_what_has_no_language(stages):
    before, after = map(rows, stages[0])
    assert before.keys() - after.keys() == {10_000, 10_001, 10_002}
    assert all(r.lang for r in after.values()) and all(after[d].text == before[d].text for d in after)


@pytest.mark.parametrize("labels", [("en", "en-US", "en-GB"), (None,)])
def test_language_keeps_every_clean_document(spark, labels):
    """However close the labels are, and without any."""
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").filter("lang = 'en'").collect()
    given = [{**r.asDict(), "lang": labels[i % len(labels)]} for i, r in enumerate(docs)]
    schema = spark.read.parquet(f"{FOLDER}/documents.parquet").schema
    kept = corpus_pipeline.identify_language(spark, spark.createDataFrame(given, schema), FOLDER).collect()
    assert {r.doc_id for r in kept} == {r.doc_id for r in docs if any(c.isalpha() for c in r.text or "")} and len(kept) > 100


def test_near_duplicates_go_by_row(spark):
    """Rows with the same id but unlike texts are documents of their own."""
    alpha, other = " ".join(f"alpha{i}" for i in range(30)), " ".join(f"other{i}" for i in range(30))
    rows = [(1, alpha), (2, alpha), (2, other), (2, other), (3, None), (3, ""), (3, ""), (None, alpha), (None, None), (4, "short"), (4, "short one")]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    kept = [(r.doc_id, r.text) for r in corpus_pipeline.drop_near_duplicates(spark, docs, FOLDER).collect()]
    wanted = [(1, alpha), (2, other), (3, None), (3, ""), (3, ""), (None, alpha), (None, None), (4, "short"), (4, "short one")]
    assert sorted(kept, key=str) == sorted(wanted, key=str)


def test_one_of_each_group(stages):
    before, after = map(rows, stages[1])
    wanted = {c for _, _, c in plain_components([(d, r.text) for d, r in before.items()])}
    assert after.keys() == wanted and 10_003 not in after


def test_personal_data_is_gone_and_the_rest_stays(stages):
    before, after = map(rows, stages[2])
    assert before.keys() == after.keys()
    for d, r in after.items():
        assert pii.base_spans(r.text) == [] and r.n_chars == len(r.text)
        if not pii.base_spans(before[d].text) and not any(c.isdigit() for c in before[d].text):
            assert r.text == before[d].text
    assert after[10_004].text.startswith("write to [EMAIL] or call [PHONE]")


def test_mix_meets_its_budget(stages):
    before, after = stages[3][0].collect(), stages[3][1].collect()
    size = {r.doc_id: len(r.text.encode().split()) for r in before}
    total, budget = sum(size[r.doc_id] for r in after), 1.5 * sum(size.values())
    assert budget - max(size.values()) <= total <= budget
    counts = {}
    for r in after:
        counts[r.doc_id] = counts.get(r.doc_id, 0) + 1
    assert max(counts.values()) <= 2


def test_sequences_hold_every_token(stages):
    before, after = stages[4][0].collect(), stages[4][1].collect()
    plain = Tokenizer.from_file(tokenizer_path())
    wanted, got = {}, {}
    for r in before:
        wanted.setdefault(r.doc_id, []).extend(plain.encode(r.text, add_special_tokens=False).ids + [END_ID])
    for p in after:
        got.setdefault(p.doc_id, []).extend(np.frombuffer(bytes(p.ids), "<u4").tolist())
    assert {d: sorted(x) for d, x in wanted.items()} == {d: sorted(x) for d, x in got.items()}
    length = {}
    for p in after:
        length[p.sequence_id] = length.get(p.sequence_id, 0) + p.length
    assert max(length.values()) <= 4096 and len(length) <= -(-sum(map(len, wanted.values())) // 4096) + 8


def test_every_operator_is_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
    assert set(ORACLES) <= set(QUERIES)


def test_empty_documents(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, FOLDER).count() == 0

"""The pipeline stage by stage against brute force on the same input, then as a whole."""

import pytest

import corpus_pipeline as pipeline
from newsloom.llm import language, toxicity
from newsloom.llm.registry import held_out, read
from tests.llm.test_jaccard import brute as jaccard_brute
from tests.llm.test_line_dedup import brute as lines_brute
from tests.llm.test_tokens import check_packed


@pytest.fixture(scope="module")
def steps(spark, sf_dir):
    """Input and result of every stage, with rows that the given table does not have."""
    odd = [(100_001, None, None, None, None), (100_002, "", "en", "s", 0), (100_003, "123 !?", "en", "s", 6), (None, "A line without an id of its own.", "en", "s", 32)]
    docs = read(spark, sf_dir, "documents")
    docs = docs.unionByName(spark.createDataFrame(odd, docs.schema))
    found = []
    for name, stage in pipeline.STAGES:
        out = pipeline.cut_lineage(stage(spark, docs, sf_dir), name)
        found.append((name, docs, out))
        docs = out
    return found


def texts(df):
    return {r.doc_id: r.text for r in df.collect()}


def test_columns_stay(steps):
    assert [name for name, _, _ in steps] == ["language_id", "toxicity", "line_dedup", "jaccard_join", "best_fit_packing"]
    for _, docs, out in steps[:-1]:
        assert out.columns == docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]


def test_language(steps):
    _, docs, out = steps[0]
    assert texts(out) == {k: v for k, v in texts(docs).items() if any(c.isalpha() for c in v or "")}
    assert language.UNKNOWN == "und"


def test_toxicity(spark, sf_dir, steps):
    _, docs, out = steps[1]
    model = toxicity.learn(docs.filter(~held_out(docs.doc_id)), read(spark, sf_dir, "labels"))
    automaton = toxicity._automaton(model.weights)
    folded = {r.doc_id: r.f for r in docs.select("doc_id", toxicity.folded(docs.text).alias("f")).collect()}
    amounts = {k: toxicity.amount(v, automaton) for k, v in folded.items()}
    bad = {k for k, x in amounts.items() if 1 / (1 + 2.718281828459045 ** -(x * model.slope + model.intercept)) >= 0.3}
    assert bad and texts(out) == {k: v for k, v in texts(docs).items() if k not in bad}


def test_lines(steps):
    _, docs, out = steps[2]
    ordered = sorted(texts(docs).items(), key=lambda x: (x[0] is not None, x[0] or 0))
    assert texts(out) == {k: v for k, v in lines_brute(ordered, 5).items() if v}
    assert all(r.n_chars == len(r.text) for r in out.collect())


def test_groups(steps):
    _, docs, out = steps[3]
    given = texts(docs)
    components = jaccard_brute([(k, v) for k, v in given.items() if k is not None], 5, 80)
    assert texts(out) == {k: v for k, v in given.items() if k is None or components[k][1] == k}


def test_packing(spark, steps):
    _, docs, out = steps[4]
    check_packed(out.collect(), texts(docs), 2048)


def test_whole(spark, sf_dir):
    rows = pipeline.run(spark, sf_dir).collect()
    assert len(rows) > 100 and {"doc_id", "sequence_id", "offset"} <= set(rows[0].asDict())

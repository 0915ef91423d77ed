"""The pipeline's stages against plain restatements, each on its own input."""

import re

import corpus_pipeline
import pytest
from test_operators import contaminated, groups, print_of, split

from threadloom.llm import op01_quality


@pytest.fixture(scope="module")
def stages(spark, sf_dir, tmp_path_factory):
    """Rows of documents and of each stage's result."""
    root = tmp_path_factory.mktemp("stages")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out, columns = [docs.collect()], docs.columns
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{root}/{name}")
        docs = spark.read.parquet(f"{root}/{name}")
        if name != "source_mixing":
            assert docs.columns == columns
        out.append(docs.collect())
    return out


def texts(rows):
    return {r["doc_id"]: r["text"] for r in rows}


def test_quality_stage(stages):
    expected = {}
    for r in stages[0]:
        judged = op01_quality.judge((r["text"] or "").encode(), op01_quality.MAX_LOST)
        if judged[6]:
            expected[r["doc_id"]] = judged[9] if judged[9] is not None else r["text"]
    assert texts(stages[1]) == expected and all(r["n_chars"] == len(r["text"]) for r in stages[1])


def test_line_stage(stages):
    first, expected = {}, {}
    for i, text in sorted(texts(stages[1]).items()):
        raw = text.split("\n")
        solid = [(k, x.strip(" \t\r\x0b\f")) for k, x in enumerate(raw) if x.strip(" \t\r\x0b\f")]
        gone = set()
        for j in range(len(solid) - 2):
            window = tuple(x for _, x in solid[j : j + 3])
            if first.setdefault(window, (i, j)) != (i, j):
                gone.update(k for k, _ in solid[j : j + 3])
        kept = "\n".join(x for k, x in enumerate(raw) if k not in gone)
        if not gone or split(kept):
            expected[i] = kept
    assert texts(stages[2]) == expected


def test_simhash_stage(stages):
    group = groups({i: print_of(t) for i, t in texts(stages[2]).items()})
    assert set(texts(stages[3])) == set(group.values())


def test_decontamination_stage(stages, spark, sf_dir):
    items = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text").collect()]
    found = contaminated(list(texts(stages[3]).items()), items)
    assert set(texts(stages[4])) == {r[0] for r in found if not r[5]}


def test_mixing_stage_and_run(stages, spark, sf_dir):
    assert {r["doc_id"] for r in stages[5]} == set(texts(stages[4]))
    assert sum(r["taken"] for r in stages[5]) == pytest.approx(sum(len(re.findall(r"[^\x20\x09-\x0D]+", t)) for t in texts(stages[4]).values()), abs=20)
    assert sorted(map(tuple, corpus_pipeline.run(spark, sf_dir).collect())) == sorted(map(tuple, stages[5]))


def test_run_returns_documents_in_training_order(spark, sf_dir):
    got = [r["position"] for r in corpus_pipeline.run(spark, sf_dir).collect()]
    assert got == sorted(got, key=lambda t: (t is None, t))

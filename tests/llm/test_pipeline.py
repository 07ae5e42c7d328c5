from __future__ import annotations

import subprocess
import sys
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from trialmart.llm.decontaminate import item_words
from trialmart.llm.mixing import mix
from trialmart.llm.packing import Encoder, Vocabulary
from trialmart.llm.rules import judge

from .test_simhash import slow_components, slow_fingerprint


@pytest.fixture(scope="module")
def stages(llm, small):
    """The rows each stage returns."""
    docs = llm.read.parquet(f"{small}/documents.parquet")
    found = [docs]
    for _, stage in corpus_pipeline.STAGES:
        found.append(stage(llm, found[-1], small).cache())
    return found


def test_all_but_the_last_stage_return_documents(stages):
    assert [stage.columns for stage in stages[1:-1]] == [stages[0].columns] * 4


def test_quality_rules_keep_what_passes(stages):
    want = {}
    for row in stages[0].collect():
        result = judge(row["text"])
        if result[6]:
            want[row["doc_id"]] = result[9]
    rows = stages[1].collect()
    assert {row["doc_id"]: row["text"] for row in rows} == want
    assert all(row["n_chars"] == len(row["text"]) for row in rows)


def test_one_document_of_each_group_stays(stages):
    prints = {row["doc_id"]: slow_fingerprint(row["text"]) for row in stages[1].collect()}
    label = slow_components(prints.values())
    least = {}
    for doc_id, fp in prints.items():
        least[label[fp]] = min(doc_id, least.get(label[fp], doc_id))
    assert sorted(row["doc_id"] for row in stages[2].collect()) == sorted(least.values())


def test_contaminated_documents_go(llm, stages, small):
    windows = set()
    for row in llm.read.parquet(f"{small}/benchmark.parquet").collect():
        words = item_words(row["text"])
        size = min(10, len(words))
        windows |= {tuple(words[i : i + size]) for i in range(len(words) - size + 1) if size}
    sizes = {len(w) for w in windows}
    clean = set()
    for row in stages[2].collect():
        words = item_words(row["text"])
        if not any(
            tuple(words[i : i + size]) in windows
            for size in sizes
            for i in range(len(words) - size + 1)
        ):
            clean.add(row["doc_id"])
    assert {row["doc_id"] for row in stages[3].collect()} == clean


def test_the_mix_is_what_the_operator_takes(stages):
    want = {
        row["doc_id"]: row["copies"]
        for row in mix(stages[3]).withColumn("copies", F.round(F.col("taken") / F.col("size")))
        .filter("copies > 0").collect()
    }
    assert Counter(row["doc_id"] for row in stages[4].collect()) == want


def test_every_mixed_document_is_packed(stages):
    vocabulary = Vocabulary.read()
    encoder = Encoder(vocabulary)
    tokens = Counter()
    for row in stages[4].collect():
        tokens.update(np.frombuffer(encoder.encode(row["text"]), "<u2").tolist())
        tokens[vocabulary.end] += 1
    packed = Counter()
    for row in stages[5].collect():
        packed.update(np.frombuffer(row["ids"], "<u2")[: row["n_tokens"]].tolist())
    assert packed == tokens


def test_run_applies_all_stages(llm, stages, small):
    found = corpus_pipeline.run(llm, small)
    assert found.columns == stages[-1].columns
    assert found.agg(F.sum("n_tokens")).first() == stages[-1].agg(F.sum("n_tokens")).first()


def test_stages_accept_awkward_and_empty_documents(llm, awkward, small):
    for docs in (awkward.withColumn("n_chars", F.lit(1)), awkward.limit(0)):
        for _, stage in corpus_pipeline.STAGES:
            docs = stage(llm, docs, small).cache()
            docs.count()


def test_entry_works_without_this_part():
    code = (
        "import sys\n"
        "class Gone:\n"
        "    def find_spec(self, name, path=None, target=None):\n"
        "        if name in ('trialmart.llm', 'corpus_pipeline'):\n"
        "            raise ModuleNotFoundError(name, name=name)\n"
        "sys.meta_path.insert(0, Gone())\n"
        "import __spark_entry__ as e\n"
        "assert 'base_kpis' in e.queries() and 'pipeline' not in e.queries()\n"
        "assert set(e.queries()) == set(e.oracle_sql())\n"
    )
    root = corpus_pipeline.__file__.rpartition("/")[0]
    subprocess.run([sys.executable, "-c", code], cwd=root, check=True, timeout=60)

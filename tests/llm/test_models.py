"""Language, toxicity and quality: definitions on small cases, accuracy on held-out rows."""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pytest
from pyspark.sql import functions as F

from trialmart.llm import language, toxicity
from trialmart.llm.labelled import label_sample, logistic, sigmoid
from trialmart.llm.quality import bins, quality, traits
from trialmart.llm.queries import op6_language, op7_toxicity, op10_quality

PIECES = ["▁", "a", "b", "ab", "▁a", "ba", "▁ab", "bab"]


def all_segmentations(text, pieces):
    if not text:
        yield []
    for k in range(1, len(text) + 1):
        if text[:k] in pieces or k == 1:
            for rest in all_segmentations(text[k:], pieces):
                yield [text[:k], *rest]


@pytest.fixture
def table():
    rng = np.random.default_rng(1)
    return language._table(rng.integers(1, 50, (len(PIECES), 2)).astype(float))


@pytest.mark.parametrize("word", ["a", "abab", "babab", "axb", "xyz", "ab" * 20])
def test_forward_sums_all_segmentations(table, word):
    model = language.LanguageModel(PIECES, ["x", "y"], table)
    segmenter = language.Segmenter(PIECES)
    got = model.word_logs(segmenter, [word, word])[1]
    number = {piece: i for i, piece in enumerate(PIECES)}.get

    @lru_cache
    def total(rest, column):
        if not rest:
            return 1.0
        return sum(
            table[number(rest[:k], len(PIECES)), column] * total(rest[k:], column)
            for k in range(1, len(rest) + 1)
            if rest[:k] in PIECES or k == 1
        )

    for column in range(2):
        assert got[column] == pytest.approx(math.log(total("▁" + word, column)))


def test_expected_counts_equal_enumeration(table):
    words, weights, column = ["abab", "ba", "abab", "xb"], [2.0, 1.0, 3.0, 1.0], [0, 0, 1, 1]
    segmenter = language.Segmenter(PIECES)
    got = language.expected_counts(
        segmenter, words, np.array(weights), np.array(column), table
    )
    want = np.zeros(table.shape)
    for word, weight, lang in zip(words, weights, column, strict=True):
        found = []
        for pieces in all_segmentations("▁" + word, PIECES):
            numbers = [PIECES.index(p) if p in PIECES else len(PIECES) for p in pieces]
            found.append((math.prod(table[n, lang] for n in numbers), numbers))
        whole = sum(p for p, _ in found)
        for p, numbers in found:
            for n in numbers:
                want[n, lang] += weight * p / whole
    assert got[: len(PIECES)] == pytest.approx(want[: len(PIECES)])


def test_language_of_held_out_documents(llm, sf_dir, documents):
    found = op6_language(llm, sf_dir).join(documents.select("doc_id", "lang"), "doc_id")
    held = found.filter("held_out AND lang IS NOT NULL")
    right = held.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
    assert right > 0.98


def test_language_of_awkward_rows(awkward):
    model = language.train(awkward, rounds=1)
    assert model.languages == ["de", "en", "fr"]
    found = language.predict(awkward, model).cache()
    assert found.count() == awkward.count()
    by_id = {row["doc_id"]: row for row in found.filter("doc_id IS NOT NULL").collect()}
    assert [by_id[i]["lang_pred"] for i in (3, 4, 7)] == ["und"] * 3
    assert by_id[9]["lang_pred"] == "de" and by_id[8]["lang_pred"] == "en"
    nothing = language.train(awkward.limit(0), rounds=1)
    assert {r["lang_pred"] for r in language.predict(awkward, nothing).collect()} == {"und"}
    assert language.predict(awkward.limit(0), model).count() == 0


def test_numbers_alone_have_no_letter(llm):
    df = llm.createDataFrame([(1, "12 ² Ⅷ !"), (2, "le²")], "doc_id int, text string")
    model = language.LanguageModel(PIECES, ["x"], np.full((10, 1), 0.1))
    found = {r["doc_id"]: r["lang_pred"] for r in language.predict(df, model).collect()}
    assert found == {1: "und", 2: "x"}


@pytest.fixture(scope="module")
def costs():
    text = "you are a stupid idiot and such a loser but the tall house is stable and good " * 50
    return toxicity.character_costs(toxicity.trigram_counts(text))


@pytest.mark.parametrize(
    ("token", "word"),
    [
        ("stup1d", "stupid"), ("$tupid", "stupid"), ("s.t.u.p.i.d", "stupid"),
        ("stuuuupid", "stupid"), ("id10t", "idiot"), ("1d!0t", "idiot"), ("l0seeeer", "loser"),
        ("idiot###", "idiot"), ("stupid!!", "stupid"), ("house", "house"),
    ],
)
def test_decoding(costs, token, word):
    assert word in toxicity.restored(token, costs)


def test_viterbi_equals_enumeration(costs):
    def best(token):
        """Every reading of a token, by recursion."""
        found = []

        def walk(at, first, second, written, cost, word):
            if at == len(token):
                found.append((cost + costs[first, second, 0], word))
                return
            c = token[at]
            letter = toxicity.symbol(c) != 0
            readings = [(c, 0.0)] if letter else []
            readings += [(m, toxicity.LOOK_ALIKE_COST) for m in toxicity.LOOK_ALIKES.get(c, "")]
            for meant, extra in readings:
                s = toxicity.symbol(meant)
                step = extra + costs[first, second, s]
                walk(at + 1, second, s, c, cost + step, word + meant)
            if written == c and second:
                walk(at + 1, first, second, c, cost + toxicity.REPEAT_COST, word)
            if not letter:
                walk(at + 1, first, second, written, cost + toxicity.INSERT_COST, word)

        walk(0, 0, 0, "", 0.0, "")
        return min(found)[1]

    for token in ("st00pid", "aaab", "1d1ot", "l.o.s.e.r", "$$s", "--", "1|1|"):
        assert toxicity.decode(token, costs) == best(token)


def test_spaced_words_are_joined(costs):
    assert "idiot" in toxicity.Restorer(costs).restore("such an i d i o t here")
    assert "idiot" in toxicity.Restorer(costs).restore("1 d i 0 t")


@pytest.mark.parametrize(
    "text", ["a i d i o t", "y o u   i d i o t", "y o u i d i o t", "y o u   a i d i o t", "a 1 d i 0 t"]
)
def test_runs_of_several_words_are_parted(costs, text):
    assert "idiot" in toxicity.Restorer(costs).restore(f"well, {text}")


@pytest.mark.parametrize("token", ["stuupid", "stuupid,", "stuupid!", "Stuupid"])
def test_doubled_letters_are_decoded_beside_the_plain_reading(costs, token):
    assert {"stupid", "stuupid"} <= toxicity.Restorer(costs).restore(token)


def test_toxicity_of_held_out_documents(llm):
    sf_dir = "/root/testdata/sf0.1"
    labels = llm.read.parquet(f"{sf_dir}/labels.parquet")
    held = op7_toxicity(llm, sf_dir).filter("held_out").join(labels, "doc_id")
    row = held.agg(
        F.avg(F.when(F.col("toxic") == 1, F.col("predicted"))),
        F.avg(F.when(F.col("toxic") == 0, F.col("predicted"))),
    ).first()
    assert row[0] > 0.85 and row[1] < 0.01


def test_toxicity_of_awkward_rows(llm, awkward):
    labels = llm.createDataFrame(
        [(1, 1), (2, 1), (2, 0), (8, 0), (9, 0), (None, 1), (3, None)], "doc_id int, toxic int"
    )
    for teaching in (labels, labels.filter("toxic = 1"), labels.limit(0)):
        model = toxicity.train(awkward, teaching)
        found = toxicity.toxicity(awkward, model).cache()
        assert found.count() == awkward.count()
        assert found.filter("score IS NULL OR score < 0 OR score > 1").count() == 0
    assert toxicity.toxicity(awkward.limit(0), model).count() == 0


def test_label_sample_is_bounded_and_settles_differences(llm):
    labels = llm.range(5000).selectExpr("id AS doc_id", "int(id % 2) AS toxic")
    both = labels.unionByName(labels.selectExpr("doc_id", "1 AS toxic").filter("doc_id < 10"))
    assert label_sample(both, "doc_id", "toxic").filter("label = 1").count() == 2505
    few = label_sample(labels, "doc_id", "toxic", limit=1000)
    assert 500 < few.count() <= 1000
    assert sorted(few.collect()) == sorted(label_sample(
        labels.repartition(3), "doc_id", "toxic", limit=1000).collect())


def test_logistic_regression_finds_the_maximum():
    x = np.array([[0.0], [1.0]])
    weights = logistic(x, np.array([10.0, 30.0]), np.array([30.0, 10.0]), 1e-6)
    assert sigmoid(weights[0]) == pytest.approx(0.25, abs=1e-3)
    assert sigmoid(weights.sum()) == pytest.approx(0.75, abs=1e-3)


def test_quality_of_held_out_documents(llm, sf_dir):
    labels = llm.read.parquet(f"{sf_dir}/labels.parquet")
    held = op10_quality(llm, sf_dir).filter("held_out").join(labels, "doc_id")
    right = held.agg(F.avg((F.col("kept").cast("int") == F.col("quality")).cast("int"))).first()[0]
    assert right > 0.95


def test_sparse_sites_shrink_toward_the_level_above(llm):
    good = "A good sentence that says something useful about the world we live in. " * 5
    rows, labels = [], []
    for i in range(400):
        # Host a is bad, host b good, at equal texts; c has a single document.
        rows.append((i, good, "a" if i % 2 else "b", "p"))
        labels.append((i, 1 - i % 2))
    rows.append((1000, good, "c", "p"))
    df = llm.createDataFrame(rows, "doc_id int, text string, source string, lang string")
    found = {
        row["doc_id"]: row
        for row in quality(df, llm.createDataFrame(labels, "doc_id int, quality int")).collect()
    }
    assert found[1]["host_posterior"] < 0.1 < 0.9 < found[0]["host_posterior"]
    assert found[1000]["host_posterior"] == pytest.approx(0.5, abs=0.01)
    assert not found[1]["kept"] and found[0]["kept"]


def test_quality_of_awkward_rows(llm, awkward):
    labels = llm.createDataFrame([(1, 1), (9, 0), (None, 1), (3, None)], "doc_id int, quality int")
    for teaching in (labels, labels.limit(0)):
        found = quality(awkward, teaching).cache()
        assert found.count() == awkward.count()
        assert found.filter("score IS NULL OR score < 0 OR score > 1").count() == 0
    assert quality(awkward.limit(0), labels).count() == 0


def test_traits_of_texts():
    assert traits(None) == traits("")
    found = traits("One | two\nOne | two\nEnd.")
    assert found["navigation"] == 2 / 7
    assert found["repeated_lines"] == pytest.approx(1 / 3)
    assert len(bins("anything")) == len(found)

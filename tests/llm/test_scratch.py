"""Joins with dominant keys, and numbering of written rows."""

from __future__ import annotations

from conftest import rows
from pyspark.sql import functions as F

from trialmart.llm.quality import quality, reference_evidence
from trialmart.llm.scratch import join_frequent, placed, saved


def test_frequent_keys_are_joined_in_place(llm):
    facts = llm.range(3000).select(
        "id", F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 700)).alias("key")
    )
    table = facts.groupBy("key").agg(F.count("*").alias("n")).filter("key <> 'k5'")
    joined = join_frequent(facts, table, ["key"], F.col("n") > 500)
    assert rows(joined.select("id", "key", "n")) == rows(facts.join(table, "key").select("id", "key", "n"))
    plan = joined._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LeftAnti") == 1 and plan.count("strategy=broadcast") == 2
    # What is shuffled for the join is without the hot key.
    rare = facts.join(table.filter("n > 500").select("key"), "key", "left_anti")
    assert rare.filter("key = 'hot'").count() == 0


def test_written_rows_are_numbered_in_their_order(llm):
    df = llm.range(1000).select((F.col("id") * 7919 % 1000).alias("v"))
    for parts in (1, 7):
        stored = saved(df.repartitionByRange(parts, "v").sortWithinPartitions("v"))
        found = placed(stored).collect()
        assert sorted(row["place"] for row in found) == list(range(1000))
        assert all(row["v"] == row["place"] for row in found)
    assert placed(saved(df.limit(0))).count() == 0


def test_quality_equals_brute_force(llm, tmp_path):
    """Evidence and both posteriors of every document, computed without Spark."""
    import random

    from trialmart.llm import quality as q

    chance = random.Random(4)
    good = "The quiet river runs past the old mill, and people walk there in the evening. "
    bad = "BUY $$$ now!!! *** click >>> here 4 u "
    docs, labels = [], []
    for i in range(400):
        clean = chance.random() < 0.5
        source = "hot" if i % 2 else chance.choice(["a", "b", None, ""])
        text = (good if clean else bad) * chance.randint(1, 9)
        docs.append((i, text if i % 50 else None, chance.choice(["en", "de", None]), source))
        if i % 3 == 0:
            labels.append((i, int(clean)))
    df = llm.createDataFrame(docs, "doc_id long, text string, lang string, source string")
    known = llm.createDataFrame(labels, "doc_id long, quality int")
    found = {row["doc_id"]: row for row in quality(df, known).collect()}
    by_id = dict(labels)
    bins = q.document_bins(df, "doc_id", "text", F.col("source"), F.col("lang"))
    model = q.fit(bins.join(known.withColumnRenamed("quality", "label"), "doc_id"))
    entries = {}
    for i, text, lang, source in docs:
        evidence = reference_evidence(model, text)
        w = 1.0 if i in by_id else q.SOFT_WEIGHT
        entries[i] = ((source,), (source, lang), evidence, w, w * by_id.get(i, evidence))
    total_w = sum(e[3] for e in entries.values())
    mean = (sum(e[4] for e in entries.values()) + 0.5) / (total_w + 1)

    def sums(level):
        found = {}
        for entry in entries.values():
            n, g = found.get(entry[level], (0.0, 0.0))
            found[entry[level]] = n + entry[3], g + entry[4]
        return found

    def strength(sites):
        spread = sum(n * (g / n - mean) ** 2 for n, g in sites.values())
        n = sum(n for n, _ in sites.values())
        chance_ = mean * (1 - mean)
        beyond = spread / n - chance_ * len(sites) / n
        return min(max(chance_ / max(beyond, 1e-9) - 1, q.STRENGTH[0]), q.STRENGTH[1])

    import math

    logit = lambda p: math.log(min(max(p, 1e-9), 1 - 1e-9) / (1 - min(max(p, 1e-9), 1 - 1e-9)))
    hosts, paths = sums(0), sums(1)
    of_host, of_path = strength(hosts), strength(paths)
    for i, (host, path, evidence, w, g) in entries.items():
        n, good_ = hosts[host]
        host_p = (good_ - g + of_host * mean) / (n - w + of_host)
        n, good_ = paths[path]
        path_p = (good_ - g + of_path * host_p) / (n - w + of_path)
        score = 1 / (1 + math.exp(-(logit(evidence) + logit(path_p) - logit(mean))))
        row = found[i]
        assert abs(row["evidence"] - evidence) < 1e-9
        assert abs(row["host_posterior"] - host_p) < 1e-9
        assert abs(row["path_posterior"] - path_p) < 1e-9
        assert abs(row["score"] - score) < 1e-9 and row["kept"] == (score >= q.THRESHOLD)

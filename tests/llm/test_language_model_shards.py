"""The language model is the same however its table is partitioned, and its shards' sums are averages of what single learners learn."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tallywright.llm import common, language_model
from tallywright.session import ship


def texts_of(n, seed):
    rnd = random.Random(seed)
    pools = [[f"{a}{b}{c}{end}" for a in "bdfgklm" for b in "aeiou" for c in ("", "n", "sh")] for end in ("ka", "lich", "eux")]
    return [(i, " ".join(rnd.choice(pools[i % 3][: rnd.choice([5, 90])]) for _ in range(rnd.randrange(1, 120)))) for i in range(n)]


@pytest.mark.parametrize("shard_tokens", [1 << 21, 2000])
def test_scores_do_not_depend_on_the_partitioning(spark, shard_tokens):
    ship(spark)
    rows = [*texts_of(400, 3), (900, None), (901, ""), (902, "word " * 30_000), *[(1000 + i, "the same text again") for i in range(150)]]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    old, language_model.SHARD_TOKENS = language_model.SHARD_TOKENS, shard_tokens
    try:
        got = [{r["doc_id"]: r["score"] for r in language_model.score(df.repartition(n, F.rand(n))).collect()} for n in (1, 7, 40)]
    finally:
        language_model.SHARD_TOKENS = old
    assert len(got[0]) == len(rows)
    for other in got[1:]:
        for i, s in got[0].items():
            assert other[i] == pytest.approx(s, rel=1e-6, abs=1e-6)


def test_equal_texts_are_spread_over_shards(spark):
    ship(spark)
    df = spark.createDataFrame([(i, "one and the same") for i in range(1000)], "doc_id long, text string").select("text", "doc_id")
    rows, tasks = language_model.sharded(df, 10 * language_model.SHARD_TOKENS)
    sizes = [r["count"] for r in rows.groupBy("shard").count().collect()]
    assert tasks == 10 and len(sizes) == 10 and max(sizes) < 200
    old, language_model.TASKS = language_model.TASKS, 2
    try:
        rows, tasks = language_model.sharded(df, 10 * language_model.SHARD_TOKENS)
        assert tasks == 2 and rows.rdd.getNumPartitions() == 2
        assert [sorted(set(x)) for x in rows.rdd.map(lambda r: r["shard"]).glom().collect()] == [[0, 1, 2, 3, 4], [5, 6, 7, 8, 9]]
    finally:
        language_model.TASKS = old


def test_sums_of_shards_are_those_of_single_learners():
    class_of, base = np.arange(language_model.BUCKETS) % language_model.CLUSTERS, np.zeros((language_model.CLASSES, language_model.PARTS), np.float32)
    class_of[0] = language_model.END
    groups = [[t for _, t in texts_of(40, s)] for s in (1, 2)]

    def taught(*groups):
        learner = language_model.Learner(class_of, base)
        for texts in groups:
            learner.learn(language_model.Tokens(*common.buffers(pa.array(texts))))
            learner.finish()
        return learner

    both, one, two = taught(*groups), taught(groups[0]), taught(groups[1])
    assert both.seen_all == one.seen_all + two.seen_all
    np.testing.assert_allclose(both.outer, one.outer + two.outer)
    np.testing.assert_allclose(both.inner, one.inner + two.inner, rtol=1e-6)
    np.testing.assert_allclose(both.hits_all, one.hits_all + two.hits_all)

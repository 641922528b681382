"""Decontamination through its fingerprints: recall against the exact rule, short items, and nothing without the index."""

import collections
import random

import numpy as np
import pyarrow as pa
import pytest

from tallywright.llm import common, decontaminate
from tallywright.session import ship

WORDS = [f"{a}{b}{c}" for a in "bdfgklmnprst" for b in "aeiou" for c in ("", "n", "sh", "ring")]


def text_of(rnd, n):
    return " ".join(rnd.choice(WORDS) for _ in range(n))


def shingles_of(text):
    _, _, h, first = common.words(*common.buffers(pa.array([text], pa.large_string())))
    return common.shingles(h, first)[0]


def edited(rnd, item, k):
    """The item with k runs of words exchanged, in a text of other words."""
    w = item.split()
    for at in rnd.sample(range(len(w)), k):
        w[at] = "changed%d" % rnd.randrange(1000)
    return " ".join([text_of(rnd, 40), *w, text_of(rnd, 40)])


@pytest.mark.parametrize("n_shingles, edits", [(9, 1), (45, 1), (90, 2), (225, 4), (225, 5)])
def test_recall_against_the_exact_rule(n_shingles, edits):
    rnd = random.Random(n_shingles * 10 + edits)
    items = [text_of(rnd, n_shingles + 4) for _ in range(400)]
    index = decontaminate.Index(list(range(len(items))), items)
    at_threshold = found = near = 0
    for i, item in enumerate(items):
        # words at an item's ends touch fewer shingles, so that even short items have pairs at the threshold
        text = edited(rnd, item, edits) if n_shingles > 9 else " ".join([text_of(rnd, 40), "changed", *item.split()[1:], text_of(rnd, 40)])
        h = shingles_of(text)
        want, _ = decontaminate.best_window(h.tolist(), n_shingles, index.counts[i], n_shingles)
        got = {x: value for x, _, value in index.matches(h)}
        assert all(value >= decontaminate.THRESHOLD for value in got.values())
        if want >= decontaminate.THRESHOLD:
            at_threshold += 1
            near += want < 0.85
            found += got.get(i) == pytest.approx(want)
        else:
            assert i not in got
    assert at_threshold >= 20 and near >= 20
    assert found >= 0.99 * at_threshold


def test_nothing_is_found_without_the_index(monkeypatch):
    rnd = random.Random(5)
    items = [text_of(rnd, 50) for _ in range(20)]
    index = decontaminate.Index(list(range(20)), items)
    h = shingles_of(text_of(rnd, 30) + " " + items[3] + " " + text_of(rnd, 30))
    assert [x[0] for x in index.matches(h)] == [3]
    none = np.zeros(0, np.int64)
    monkeypatch.setattr(index, "candidates", lambda prints, size: (none, none))
    assert index.matches(h) == []


def test_items_of_few_words(spark):
    ship(spark)
    items = [(1, "alpha"), (2, "alpha beta"), (3, "Alpha beta gamma delta"), (4, "alpha beta gamma delta epsilon"), (5, " \t"), (6, None), (7, "beta")]
    rows = [(1, "one two alpha beta gamma delta three"), (2, "alpha BETA"), (3, "beta alpha"), (4, "gamma delta"), (5, ""), (6, None), (7, "alpha beta gamma delta epsilon"), (8, "alpha beta gamma"), (9, "x alpha beta gamma delta epsilon y")]
    want = set()
    for d, t in rows:
        for i, u in items:
            a, b = (t or "").lower().split(), (u or "").lower().split()
            if b and any(a[k : k + len(b)] == b for k in range(len(a) - len(b) + 1)):
                want.add((d, i))
    bench = spark.createDataFrame(items, "item_id long, text string")
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = decontaminate.contaminations(docs, bench).collect()
    assert collections.Counter((r["doc_id"], r["item_id"]) for r in got) == dict.fromkeys(want, 1)
    place = {(r["doc_id"], r["item_id"]): (r["first_word"], r["n_words"]) for r in got}
    assert place[1, 3] == (2, 4) and place[3, 1] == (1, 1)
    assert sorted(r["doc_id"] for r in decontaminate.clean(docs, bench).collect()) == sorted({d for d, _ in rows} - {d for d, _ in want})


def test_very_long_text_and_item(spark):
    """A text over the internal slice, with an item at its end, and an item of 3,000 words with some changed."""
    ship(spark)
    rnd = random.Random(8)
    long_item, short = text_of(rnd, 3000), text_of(rnd, 40)
    changed = long_item.split()
    for at in range(100, 3000, 290):
        changed[at] = "changed"
    rows = [(1, text_of(rnd, 700_000) + " " + short), (2, " ".join([text_of(rnd, 500), *changed])), (3, text_of(rnd, 4000))]
    assert len(rows[0][1]) > decontaminate.SLICE
    bench = spark.createDataFrame([(1, long_item), (2, short)], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r["first_word"] for r in decontaminate.contaminations(spark.createDataFrame(rows, "doc_id long, text string"), bench).collect()}
    assert got == {(1, 2): 700_000, (2, 1): 500}

"""The index of segments: no pair is lost, few are looked at where names are unlike, and whole blocks are met where it doesn't pay."""

import difflib
import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tallywright.operators import resolve, similar
from tallywright.session import ship


def block(keys, least):
    columns = [pa.array(keys), pa.array(keys), pa.array(np.full(len(keys), least)), *map(pa.array, similar.signatures(keys))]
    return pa.RecordBatch.from_arrays(columns, names=["name", "key", "least", *[f"w{i}" for i in range(similar.WORDS)]])


def shelf(keys, size):
    sink = pa.BufferOutputStream()
    blocks = [block(keys[k : k + size], 0.0) for k in range(0, len(keys), size)]
    with pa.ipc.new_stream(sink, blocks[0].schema) as out:
        for b in blocks:
            out.write_batch(b)
    return similar._Shelf(sink.getvalue().to_pybytes())


def outcomes(claims):
    """Best, path and second of each claim; where the second is within MARGIN only that it is."""
    out = {}
    for rel, score, path in claims.rows():
        out.setdefault(rel, []).append((score, path))
    two = {rel: sorted(t, reverse=True) for rel, t in out.items()}
    return {rel: (t[0][0], None) if len(t) > 1 and t[0][0] - t[1][0] < similar.MARGIN else t[0] for rel, t in two.items()}


def names(count):
    return [f"{hashlib.md5(str(i).encode()).hexdigest()[:12]}/5rc{i % 20}/en/{i}.txt" for i in range(100000, 100000 + count)]


@pytest.mark.parametrize(("signs", "lengths", "least"), [("abcdef01/.", (12, 30), 0.77), ("ab/", (9, 15), 0.85), ("가나다라마바/.1", (10, 25), 0.8), ("0123456789abcdef", (28, 33), 0.9), ("0123456789abcdef", (28, 33), 0.77)])
def test_no_pair_is_lost(monkeypatch, signs, lengths, least):
    monkeypatch.setattr(similar, "DEAR", 0)
    monkeypatch.setattr(similar, "LOOK", 0)
    rnd = random.Random(len(signs))

    def changed(text):
        return "".join(rnd.choice([*[c] * 25, rnd.choice(signs), "", c + rnd.choice(signs)]) for c in text)

    first = ["".join(rnd.choice(signs) for _ in range(rnd.randrange(*lengths))) for _ in range(60)]
    files = sorted({*first, *map(changed, first)} - {""})
    asked = sorted({*map(changed, files)} - {""})
    there, claims = shelf(files, 40), similar._Claims(block(asked, least))
    met = {(int(i), int(j)) for some, paths, begin, end, _ in claims._looks(there, 1.0) for i, x, y in zip(some, begin, end, strict=True) for j in paths[x:y]}
    near = {(i, j) for i, a in enumerate(asked) for j, b in enumerate(files) if difflib.SequenceMatcher(None, a, b).ratio() >= least}
    assert len(near) > 100 and near <= met
    monkeypatch.setattr(similar, "SMALL", -1)
    claims.meet_shelf(there)
    plain = similar._Claims(block(asked, least))
    for b in there.batches:
        plain.meet(similar._Texts(b))
    assert outcomes(claims) == outcomes(plain) != {}


def test_unlike_names_meet_few_pairs(monkeypatch):
    """Names with a random part and claims with a wrong letter: a few thousandths of all pairs have a segment in common, and no block is met whole."""
    files = names(20000)
    asked = [n[:5] + "x" + n[6:] for n in files[::10]]
    there, claims = shelf(files, similar.BLOCK), similar._Claims(block(asked, 0.917))
    looks = claims._looks(there, float(len(files) * len(asked)))
    assert sum(int((end - begin).sum()) for _, _, begin, end, _ in looks) < len(files) * len(asked) / 200
    monkeypatch.setattr(similar._Claims, "meet", lambda *_: pytest.fail("whole blocks met"))
    claims.meet_shelf(there)
    got = outcomes(claims)
    assert {rel: path for rel, (_, path) in got.items()} == dict(zip(asked, files[::10], strict=True))
    assert all(score == difflib.SequenceMatcher(None, rel, path).ratio() for rel, (score, path) in [*got.items()][:50])


def test_alike_names_meet_whole_blocks(monkeypatch):
    """Where segments don't tell names apart, the bits of all pairs are less work; results are the same."""
    files = [f"docs/{a}{b}{c}.txt" for a in "abcdefgh" for b in "abcdefgh" for c in "abcdefgh"]
    asked = [f.replace("docs", "dxcs") for f in files[::7]]
    there, claims = shelf(files, 100), similar._Claims(block(asked, 0.77))
    assert claims._looks(there, float(len(files) * len(asked))) is None
    monkeypatch.setattr(similar, "SMALL", -1)
    claims.meet_shelf(there)
    plain = similar._Claims(block(asked, 0.77))
    for b in there.batches:
        plain.meet(similar._Texts(b))
    assert outcomes(claims) == outcomes(plain) and len(outcomes(claims)) == len(asked)


def test_matched_is_difflibs():
    rnd = random.Random(6)
    for _ in range(3000):
        signs = rnd.choice(["ab", "abc/", "0123456789abcdef", "가나b"])
        a, b = ("".join(rnd.choice(signs) for _ in range(rnd.randrange(0, 60))) for _ in range(2))
        b = rnd.choice([b, a[:9] + b[:3] + a[9:], b[:4] + a[2:]])
        assert similar.matched(a, b) == sum(m.size for m in difflib.SequenceMatcher(None, a, b).get_matching_blocks())


def test_large_search_by_spark(spark):
    """So many names that the tasks use the index."""
    ship(spark)
    files = spark.createDataFrame([(n,) for n in names(12000)], "path string")
    got = resolve.fuzzy(files.select(F.overlay("path", F.lit("x"), F.lit(4)).alias("rel"), "path"), files).collect()
    assert len(got) == 12000 and all(r["fuzzy_path"][:3] + "x" + r["fuzzy_path"][4:] == r["rel"] and not r["ambiguous"] for r in got)

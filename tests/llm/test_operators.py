"""Operators against plain versions, held-out accuracy and edge cases: nulls, empty and long texts, repeats, clashing columns, no rows."""

import collections
import itertools
import json
import math
import random
import re
import time
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tallywright.llm import common, components, decontaminate, html_pages, html_text, labelled, language_model, mixing, neardup, quality, suffixes, tokens, toxicity
from tallywright.session import ship

WORDS = [f"{a}{b}{c}" for a in "bdfgklmnprst" for b in "aeiou" for c in ("", "n", "sh", "ring")]


def text_of(rnd, n):
    return " ".join(rnd.choice(WORDS) for _ in range(n))


def docs_of(spark, rows):
    ship(spark)
    return spark.createDataFrame(rows, "doc_id long, text string")


ODD = [(1, None), (2, ""), (3, " \n\t "), (4, "word"), (5, "word"), (None, "no id at all"), (6, "é ü ß 목록"), (7, "x" * 5000), (7, "x" * 5000)]


def odd(spark):
    """Rows that any operator must get through, with extra columns whose names clash with internal ones."""
    return docs_of(spark, ODD).withColumns({c: F.lit(1) for c in ("id", "key", "row", "score", "n", "label", "rep", "k", "g", "h", "size", "_id", "at")}).withColumn("source", F.when(F.col("doc_id") > 2, F.lit("s")))


# --- words


def test_words_and_shingles():
    texts = ["One two  three", "", "a b c d e f", "é\tÉ\n", "x"]
    data, offs = common.buffers(pa.array([*texts, None]))
    starts, ends, h, first = common.words(data, offs)
    raw = data.tobytes()
    assert [raw[s:e].decode() for s, e in zip(starts, ends, strict=True)] == [w for t in texts for w in t.split()]
    assert first.tolist() == [0, 3, 3, 9, 11, 12, 12]
    s, at = common.shingles(h, first)
    assert np.diff(at).tolist() == [1, 0, 2, 1, 1, 0]
    old, common.PIECE = common.PIECE, 8
    try:
        assert (common.words(data, offs)[2] == h).all()
    finally:
        common.PIECE = old


# --- 1 token counts


def plain_tokens(text, scores, longest=10**9):
    best = [(0.0, 0)] + [(-math.inf, 0)] * len(text)
    for d in range(1, len(text) + 1):
        for at in range(d - 1, max(d - longest, 0) - 1, -1):
            s = scores.get(text[at:d])
            if s is not None and best[at][0] + s > best[d][0]:
                best[d] = best[at][0] + s, best[at][1] + 1
    return best[-1][1]


def test_token_counts(spark):
    rnd = random.Random(1)
    rows = [(i, " ".join("".join(rnd.choice("abcehinorst ") for _ in range(rnd.randrange(1, 14))) for _ in range(rnd.randrange(30))) + rnd.choice(["", "!!", " é\n\n12", "'s it's"])) for i in range(60)]
    scores = tokens.load_vocabulary()
    pattern = tokens.regex.compile(tokens.PATTERN)
    got = {r["doc_id"]: r for r in tokens.token_counts(docs_of(spark, rows)).collect()}
    for i, t in rows:
        cut = pattern.findall(t)
        assert "".join(cut) == t
        assert got[i]["n_pretokens"] == len(cut) and got[i]["n_bytes"] == len(t.encode())
        assert got[i]["n_tokens"] == sum(plain_tokens(c.encode(), scores) for c in cut)
    counter = tokens.Counter(scores)
    longest = max(map(len, scores))
    short = {k: v for k, v in scores.items() if len(k) <= 12}  # the plain version takes the square of the length otherwise
    for long in ("abc" * 700, "".join(rnd.choice("etaoin") for _ in range(1500))):
        assert longest > 12 and tokens.Counter(short).long(long.encode()) == plain_tokens(long.encode(), short, 12)
    assert counter.long(b"the quick") == plain_tokens(b"the quick", scores)
    out = tokens.token_counts(odd(spark)).collect()
    assert len(out) == len(ODD) and {r["n_tokens"] for r in out if r["doc_id"] in (1, 2)} == {0}
    assert tokens.token_counts(docs_of(spark, [])).count() == 0


# --- 2 near-duplicates


def jaccard_classes(texts):
    sets = {}
    for i, t in texts.items():
        w = t.lower().split()
        sets[i] = {tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} if w else set()
    parent = {i: i for i in texts}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(sorted(texts), 2):
        both = len(sets[a] | sets[b])
        if not both or len(sets[a] & sets[b]) / both >= 0.8:
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    return {i: find(i) for i in texts}


def test_near_duplicates(spark):
    rnd = random.Random(4)
    texts, n = {}, 0
    for _ in range(25):
        base = text_of(rnd, rnd.choice([6, 40, 120, 300])).split()
        for _ in range(rnd.choice([1, 2, 6])):
            w = list(base)
            for _ in range(rnd.choice([0, 1, 2, len(w) // 30, len(w) // 12])):
                w[rnd.randrange(len(w))] = rnd.choice(WORDS) + "q"
            texts[n] = " ".join(w)
            n += 1
    texts |= {1000: "", 1001: " ", 1002: "a b", 1003: "A b", 1004: "a c"}
    got = {r["doc_id"]: r["class_id"] for r in neardup.classes(docs_of(spark, list(texts.items())).repartition(4)).collect()}
    assert got == jaccard_classes(texts)
    kept = neardup.deduplicated(docs_of(spark, list(texts.items()))).collect()
    assert sorted(r["doc_id"] for r in kept) == sorted(set(got.values()))


def star(rnd):
    """Copies each near the original but not near each other: one class."""
    base = text_of(rnd, 400).split()
    texts = {60: " ".join(base)}
    for i in range(60):
        w = list(base)
        for at in rnd.sample(range(0, 400, 6), 7):
            w[at] = f"edit{i}x{at}"
        texts[i] = " ".join(w)
    return texts, dict.fromkeys(texts, 0)


def repeated_lines(rnd):
    """Shingles are labelled with their occurrence: a line that stands 30 times is near one of 30 or 29 times, not one of 5 times."""
    texts = {}
    for i in range(0, 120, 4):
        line, rest = text_of(rnd, 10), text_of(rnd, 90).split()
        texts[i] = " ".join([" ".join([line] * 30), *rest])
        texts[i + 1] = " ".join([" ".join([line] * 5), *rest])
        rest[45] = "edit"
        texts[i + 2] = " ".join([" ".join([line] * 30), *rest])
        texts[i + 3] = " ".join([" ".join([line] * 29), *rest])
    return texts, {i: i if i % 4 == 1 else i - i % 4 for i in texts}


def at_threshold(rnd):
    """Pairs at 0.8 to 0.82, by words changed far from each other."""
    texts = {}
    for i in range(0, 600, 2):
        n = rnd.choice([60, 104, 150, 400])
        w = text_of(rnd, n).split()
        texts[i] = " ".join(w)
        for k in range((n - 4) // 45):  # each change takes 5 shingles of each text
            w[7 + 12 * k] = f"edit{i}x{k}"
        texts[i + 1] = " ".join(w)
    return texts, {i: i - i % 2 for i in texts}


def few_words(rnd):
    """Each text of 8 to 20 words and its copy with as many words appended as 0.8 allows."""
    texts = {}
    for i in range(0, 300, 2):
        n = rnd.randrange(8, 21)
        texts[i] = text_of(rnd, n)
        texts[i + 1] = texts[i] + " " + text_of(rnd, int((n - 4) / 0.8) - (n - 4))
    assert jaccard_classes(texts) == {i: i - i % 2 for i in texts}
    return texts, {i: i - i % 2 for i in texts}


def variants(rnd):
    """200 variants of one text, at random distances about the threshold, and a chain of texts each near its neighbours only."""
    base = text_of(rnd, 120).split()
    texts = {}
    for i in range(200):
        w = list(base)
        for at in rnd.sample(range(120), rnd.randrange(1, 5)):
            w[at] = f"edit{i}x{at}"
        texts[i] = " ".join(w)
    w = text_of(rnd, 150).split()
    for i in range(300, 340):
        w[rnd.randrange(150)] = f"step{i}"
        texts[i] = " ".join(w)
    return texts, jaccard_classes(texts)


def test_near_duplicates_of_many_kinds(spark):
    """Groups of several kinds in one table: the classes of each are those that all its pairs make."""
    rnd = random.Random(9)
    made = {1000 * k: kind(rnd) for k, kind in enumerate((star, repeated_lines, at_threshold, few_words, variants))}
    rows = [(base + i, t) for base, (texts, _) in made.items() for i, t in texts.items()]
    got = {r["doc_id"]: r for r in neardup.classes(docs_of(spark, rows).repartition(4)).collect()}
    for base, (texts, want) in made.items():
        assert {i: got[base + i]["class_id"] - base for i in texts} == want
    near = [got[2000 + i]["similarity"] for i in range(600)]
    assert min(near) < 0.84 and all(x >= 0.8 for x in near) and all(got[2000 + i]["n_links"] == 1 and got[2000 + i]["linked_to"] == 2000 + (i ^ 1) for i in range(600))


def test_near_duplicates_in_a_crowd(spark):
    """All links in one bucket of 300 texts, against brute force: pairs of which most share what the whole bucket shares."""
    rnd = random.Random(11)
    core = text_of(rnd, 83)
    texts = {}
    for i in range(150):
        same = text_of(rnd, 1)  # pairs share 80 shingles of 89 or 90, others 79
        for k in (0, 1):
            texts[2 * i + k] = f"{core} {same}{i} " + text_of(rnd, 9 + i % 2 * k)
    ship(spark)
    docs = docs_of(spark, list(texts.items()))
    n = F.size(F.split("text", " ")) - 4
    live = docs.select(F.lit(1).alias("bucket"), F.col("doc_id").alias("rep"), n.cast("long").alias("n"), F.struct(F.lit(1).alias("popular"), F.lit(1).alias("tie"), F.col("doc_id").alias("rep"), n.cast("long").alias("n")).alias("rank"))
    labels, links = neardup.settled(live, docs)
    got = {r["rep"]: r["label"] for r in labels.collect()}
    assert len(got) == 300 and got == jaccard_classes(texts)
    assert len(set(got.values())) > 100 and links.where("similarity < 0.8").count() == 0


def test_prefixes():
    g = np.random.default_rng(1)
    for n in [*range(1, 120)] * 5:  # any two sets at the threshold share a shingle of their prefixes
        d = np.unique(g.integers(0, 2**63, n, dtype=np.uint64))
        less = np.sort(g.choice(d, math.ceil(0.8 * n - 1e-9), replace=False))
        assert np.isin(d[: neardup.longest_prefix(len(d))], less[: neardup.longest_prefix(len(less))]).any()


def test_alignment():
    a = np.arange(100, dtype=np.uint64)
    assert neardup.aligned(a, a) == 1.0
    assert neardup.aligned(a, np.delete(a, [3, 50])) == 98 / 100
    assert neardup.aligned(a, a[::-1].copy()) == 0.0
    moved = np.concatenate([a[5:], a[:5]])
    assert neardup.aligned(a, moved) == pytest.approx(95 / 105)
    assert neardup.labelled(np.array([5, 5, 7], np.uint64)).tolist()[0] == 5
    assert len(set(neardup.labelled(np.array([5, 5, 5], np.uint64)).tolist())) == 3


def test_near_duplicates_odd(spark):
    got = sorted((r["doc_id"] or 0, r["class_id"]) for r in neardup.classes(odd(spark)).collect())
    assert got == [(0, None), (1, 1), (2, 1), (3, 1), (4, 4), (5, 4), (6, 6), (7, 7), (7, 7)]
    assert neardup.deduplicated(odd(spark)).columns == odd(spark).columns
    assert sorted(r["doc_id"] or 0 for r in neardup.deduplicated(odd(spark)).collect()) == [0, 1, 4, 6, 7]
    assert neardup.classes(docs_of(spark, [])).count() == 0


def test_components(spark):
    links = [(1, 2), (2, 3), (10, 11), (5, 5), (3, 4), (12, 11), *[(20, i) for i in range(30, 60)], *[(i, i + 1) for i in range(100, 140)]]
    got = {r["node"]: r["label"] for r in components.components(spark.createDataFrame(links, "u long, v long")).collect()}
    assert {got[i] for i in (1, 2, 3, 4)} == {1} and {got[i] for i in (10, 11, 12)} == {10} and got[5] == 5
    assert {got[i] for i in [20, *range(30, 60)]} == {20} and {got[i] for i in range(100, 141)} == {100}


# --- 3 mixing


def test_schedule_is_fair():
    slots, period = mixing.whole_weights({"a": 5, "b": 3, "c": 0.01, "d": 1}, 256)
    assert sum(slots.values()) == period and min(slots.values()) >= 1
    plan = mixing.schedule(slots, period)
    assert sorted(itertools.chain(*plan.values())) == list(range(period))
    for s, a in slots.items():
        had = np.zeros(period + 1)
        had[np.array(plan[s]) + 1] = 1
        assert np.abs(np.cumsum(had) - np.arange(period + 1) * a / period).max() < 1


def test_mixing(spark):
    rnd = random.Random(2)
    rows = [(i, text_of(rnd, rnd.randrange(1, 60)), "hot" if i % 3 else f"s{i % 4}") for i in range(400)] + [(900, None, None), (901, "", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.place(df, block_bytes=500, period=64).collect()
    assert {r["doc_id"] for r in got} == {r[0] for r in rows}
    where = {}
    for r in got:
        assert where.setdefault(r["slot"], (r["source"], r["block"], r["epoch"])) == (r["source"], r["block"], r["epoch"])
    assert len({(r["doc_id"], r["epoch"]) for r in got}) == len(got)
    first = collections.Counter(r["doc_id"] for r in got if r["epoch"] == 0)
    assert set(first.values()) == {1} and len(first) == len(rows)
    assert mixing.place(df.limit(0)).count() == 0
    with pytest.raises(ValueError, match="weight"):
        mixing.place(df, {"hot": 1.0})
    whole = mixing.mixed(df.where("doc_id < 900"), block_bytes=500)
    assert whole.count() >= 400 and set(df.columns) < set(whole.columns)
    assert mixing.place(odd(spark)).select("doc_id").where("epoch = 0").count() == len(ODD)


def test_mixing_against_plain_version(spark):
    """Every row, from a simulation of the whole stream slot by slot."""
    rnd = random.Random(31)
    rows = [(i, text_of(rnd, rnd.randrange(0, 50)), "hot" if i % 3 else f"s{i % 5}") for i in range(300)] + [(900, None, None), (901, "", None), (902, "x" * 3000, "s1")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    block, period = 700, 64
    got = [(r["doc_id"], r["source"], r["block"], r["epoch"], r["slot"], r["offset"]) for r in mixing.place(df, block_bytes=block, period=period).collect()]
    hashes = {r["doc_id"]: r["h"] for r in df.select("doc_id", F.xxhash64("doc_id", F.lit("mix")).alias("h")).collect()}
    key = lambda s: "null" if s is None else f"={s}"
    size = lambda t: max(len((t or "").encode()), 1)
    total = collections.Counter()
    for _, t, s in rows:
        total[key(s)] += size(t)
    slots, period = mixing.whole_weights({k: b**mixing.TEMPERATURE for k, b in total.items()}, period)
    groups, place = 16, {}
    for k in total:
        at = 0
        for i, t, _ in sorted((r for r in rows if key(r[2]) == k), key=lambda r: (hashes[r[0]] % groups, hashes[r[0]], r[0])):
            place[i] = (k, at // block, at % block)
            at += size(t)
    blocks = {k: -(-b // block) for k, b in total.items()}
    done, stream = dict.fromkeys(slots, 0), []
    while len(stream) < max(-(-blocks[k] * period // slots[k]) for k in slots):  # each slot to the released block with the earliest deadline
        t = len(stream)
        ready = [(-(-(done[k] + 1) * period // a), k) for k, a in slots.items() if done[k] * period // a <= t]
        k = min(ready)[1]
        stream.append((k, done[k]))
        done[k] += 1
    want = []
    for slot, (k, turn) in enumerate(stream):
        for i, _, s in rows:
            if place[i][:2] == (k, turn % blocks[k]):
                want.append((i, s, place[i][1], turn // blocks[k], slot, place[i][2]))
    ordered = lambda xs: sorted(xs, key=lambda x: (x[0], x[3], x[4]))
    assert ordered(got) == ordered(want)


# --- 4 html


def test_html_extraction_on_held_out_pages():
    chain = html_text.default_chain()
    right = total = 0
    for page in html_pages.labelled_pages(60, seed=4242):
        found = [(b, " ".join(b.text.replace(html_pages.MARK, "").split()), html_pages.MARK in b.text) for b in html_text.blocks(page)]
        found = [x for x in found if x[1]]
        labels = chain.decode([html_text.features(b, t) for b, t, _ in found])
        right += sum(bool(y) == w for y, (_, _, w) in zip(labels, found, strict=True))
        total += len(found)
    assert right / total > 0.98


def test_html_blocks():
    page = "<p>a &amp;&nbsp;b<br>c <b>d<p>e</p><script>var x='</p>'</script><!-- no --><ul><li>f<li>g</ul>h < i<textarea>z</textarea><noscript>q</noscript>"
    assert [b.text for b in html_text.blocks(page)] == ["a & b c d", "e", "f", "g", "h < i"]
    assert html_text.blocks("") == [] and html_text.blocks("<<<><p") != None  # noqa: E711
    for n in range(len(page)):
        html_text.blocks(page[:n])


def test_html_head_without_end_tag(spark):
    """</head> may be left out: the head ends at <body> or at what can't stand in a head, and no text is lost."""
    inside = "<meta charset=utf-8><title>t</title><style>p{}</style><script>x</script><link rel=a href=b><noscript><img src=x></noscript>"
    texts = lambda page: [b.text for b in html_text.blocks(page)]
    for end in ("</head><body>", "<body>", "", "</head>", "<noscript><body>"):
        assert texts(f"<html><head>{inside}{end}<h1>a</h1><p>b <i>c</i><p>d</html>") == ["a", "b c", "d"], end
    assert texts(f"<head>{inside}\n plain <p>b") == ["plain", "b"]
    assert texts("<head><template><div>no</div><p>no</template><title>t</title></head>a") == ["a"]
    page = "<html><head><title>T</title>{}<body><nav><a href=/>Home</a></nav><article><h1>Title</h1><p>One long sentence, and two.</p></article></body></html>"
    ship(spark)
    got = html_text.main_text(spark.createDataFrame([(1, "u", page.format("</head>")), (2, "u", page.format(""))], "page_id long, url string, html string")).collect()
    assert got[0]["text"] == got[1]["text"] != ""


def test_html_malformed_pages_take_linear_time():
    """Each kind of broken markup at 256 KB; a reader that looks ahead from each '<' would take hours."""
    n = 1 << 18
    kinds = ["<a ", "<a x='", "<a x='>", '<a x="\'>', "<", "<!--", "<!", "</b>", "<span>", "<b><div>", "<a " + "y" * 50, "<a b= c=", "&amp", "<p", "<li><p>", "<x1 class=z>", "<script>", "</", "<td><tr>"]
    for kind in kinds:
        for page in (kind * (n // len(kind)), kind * (n // len(kind)) + ">'\">"):
            began = time.perf_counter()
            html_text.blocks(page)
            assert time.perf_counter() - began < 30, kind
    assert len(html_text.blocks("<b>" + "<span>" * 20000 + "</b><h1>x</h1>" * 20000)) == 20000
    deep = "<div class=a>" * 5000 + "text <p>one<p>two" + "</div>" * 5000 + "<p>after"
    assert [b.text for b in html_text.blocks(deep)] == ["text", "one", "two", "after"]
    assert [b.text for b in html_text.blocks("<p>a <b title='x > y'>b</b> c<p title='never closed>d</p><p class='k'>e")] == ["a b c", "d", "e"]


def test_html_long_page():
    """A page of 5 MB: every sentence of the article is there, in order, nothing of the menus."""
    paras = [f"This is sentence {i} of a long article, and it has some more words to it." for i in range(60_000)]
    page = "<html><body><nav><ul><li><a href=/>Home</a><li><a href=/x>Other</a></ul></nav><article>" + "".join(f"<p>{p}</p>" for p in paras) + "</article><footer>&copy; all rights</footer></body></html>"
    assert len(page) > 4 << 20
    assert html_text.extract(page, html_text.default_chain()) == "\n\n".join(paras)


#: Layouts that no rule of html_pages makes: page, and its main blocks.
HAND_WRITTEN = [
    ("""<!doctype html><html lang=en><head><meta charset=utf-8><title>News</title></head><body class="home single"><div class="skip"><a href="#c">Skip to content</a></div>
<header role=banner><a href="/"><img src=logo.png alt="The Paper"></a><nav role="navigation"><ul><li><a href=/w>World</a></li><li><a href=/s>Sport</a></li><li><a href=/a>Arts</a></li></ul></nav></header>
<main id=c><article><h1>River rises after a week of rain</h1><p>The river reached its highest mark in ten years on Monday. Several roads along the bank were closed.</p>
<figure><img src=r.jpg><figcaption>The river at the old bridge on Monday morning.</figcaption></figure>
<p>Officials said the water would fall again by the end of the week, but asked people to stay away from the bank.</p><blockquote>We have seen worse, said one resident.</blockquote></article></main>
<aside class="sidebar"><h3>Most read</h3><ol><li><a href=/1>Ten things to do</a></li><li><a href=/2>What the mayor said</a></li></ol></aside>
<footer role=contentinfo><p>&copy; 2024 The Paper. All rights reserved.</p><a href=/privacy>Privacy</a></footer></body></html>""",
     ["River rises after a week of rain", "The river reached its highest mark in ten years on Monday. Several roads along the bank were closed.", "The river at the old bridge on Monday morning.", "Officials said the water would fall again by the end of the week, but asked people to stay away from the bank.", "We have seen worse, said one resident."]),
    ("""<html><body><div id="wrap"><div id="navbar"><a href=/>Start</a> | <a href=/blog>Blog</a> | <a href=/me>About</a></div>
<div class="post"><h2>How I fixed my old radio</h2><p>Last winter the radio in my kitchen stopped working. I opened it and found a loose wire.</p><ul><li>Open the case with a small screwdriver.</li><li>Look for wires that have come loose.</li></ul><p>After that it worked again, and it still does.</p></div>
<div id="comments"><h3>2 comments</h3><div class="comment"><b>Anna</b><p>Thanks, this helped me a lot with my own radio.</p></div><div class="comment"><b>Tom</b><p>Mine is still broken, but it was fun to try.</p></div></div>
<div class="cookie-notice"><p>We use cookies to make this site work.</p><button>OK</button></div><div class="footer">Powered by a small engine</div></div></body></html>""",
     ["How I fixed my old radio", "Last winter the radio in my kitchen stopped working. I opened it and found a loose wire.", "Open the case with a small screwdriver.", "Look for wires that have come loose.", "After that it worked again, and it still does."]),
]


def test_html_hand_written_pages():
    """Blocks of layouts that the training pages weren't made by: of all, nine in ten right, and no main block of the first lost."""
    chain, right, total = html_text.default_chain(), 0, 0
    for page, main in HAND_WRITTEN:
        every = [b.text for b in html_text.blocks(page)]
        assert set(main) <= set(every)
        got = html_text.extract(page, chain).split("\n\n")
        right += sum((t in got) == (t in main) for t in every)
        total += len(every)
    assert right / total >= 0.9, (right, total)


def test_viterbi_is_best():
    rnd = np.random.default_rng(1)
    chain = html_text.Chain(rnd.normal(size=(6, 2)), rnd.normal(size=(2, 2)), rnd.normal(size=2))
    rows = [[int(x) for x in rnd.integers(0, 6, 2)] for _ in range(7)]

    def value(y):
        return chain.start[y[0]] + sum(chain.emission[r, y[k]].sum() for k, r in enumerate(rows)) + sum(chain.transition[a, b] for a, b in itertools.pairwise(y))

    assert tuple(chain.decode(rows)) == max(itertools.product((0, 1), repeat=7), key=value)
    assert chain.decode([]) == []


def test_html_table(spark, tmp_path):
    ship(spark)
    html_text.save(html_text.default_chain(), spark, f"{tmp_path}/field")
    kept = html_text.load(spark, f"{tmp_path}/field")
    assert all((getattr(kept, n) == getattr(html_text.default_chain(), n)).all() for n in ("emission", "transition", "start"))
    rows = [(1, "u", None), (2, "u", ""), (3, "u", "<html><body><nav><a href=/>Home</a></nav><article><h1>Title</h1><p>One &eacute;  two.</p></article><footer>&copy; me</footer></body></html>")]
    got = {r["page_id"]: r for r in html_text.main_text(spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit(1))).collect()}
    assert got[1]["text"] == got[2]["text"] == "" and got[3]["text"] == "Title\n\nOne é two." and got[3]["n_chars"] == len(got[3]["text"])
    twice = spark.createDataFrame([*rows, rows[2], (None, None, rows[2][2])], "page_id long, url string, html string")
    assert [r["text"] for r in html_text.main_text(twice).collect()].count(got[3]["text"]) == 3
    assert html_text.main_text(twice.limit(0)).count() == 0


# --- 5 decontamination


def test_decontamination(spark):
    rnd = random.Random(6)
    items = [(i, text_of(rnd, rnd.choice([3, 8, 20, 45]))) for i in range(30)] + [(98, ""), (99, None)]
    rows = []
    for i in range(120):
        w = text_of(rnd, rnd.choice([5, 60, 200])).split()
        if i % 3 == 0:
            item = items[rnd.randrange(30)][1].split()
            if i % 2:
                item[len(item) // 2] = "changed"
            at = rnd.randrange(len(w))
            w[at:at] = item
        rows.append((i, " ".join(w)))
    want = {}
    sh = lambda w, k: [tuple(w[j : j + k]) for j in range(max(1, len(w) - k + 1))] if w else []
    for (d, t), (k, u) in itertools.product(rows, items):
        words = (u or "").split()
        of = min(5, len(words))  # an item of fewer words is looked for among runs of as many
        s, c = sh(t.split(), of), collections.Counter(sh(words, of))
        n = sum(c.values())
        size = min(n, len(s))
        best = max((sum(min(m, c[x]) for x, m in collections.Counter(s[a : a + size]).items()) for a in range(len(s) - size + 1)), default=0) if n else 0
        if n and best / (size + n - best) >= 0.8:
            want[d, k] = best / (size + n - best)
    ship(spark)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r["similarity"] for r in decontaminate.contaminations(docs_of(spark, rows), bench).collect()}
    assert got == pytest.approx(want)
    old, decontaminate.BLOCK_ITEMS = decontaminate.BLOCK_ITEMS, 7
    try:
        assert {(r["doc_id"], r["item_id"]) for r in decontaminate.contaminations(docs_of(spark, rows), bench).collect()} == set(want)
        kept = decontaminate.clean(docs_of(spark, rows), bench)
        assert sorted(r["doc_id"] for r in kept.collect()) == sorted({d for d, _ in rows} - {d for d, _ in want})
    finally:
        decontaminate.BLOCK_ITEMS = old
    assert decontaminate.contaminations(odd(spark), bench.limit(0)).count() == 0
    assert decontaminate.clean(odd(spark), bench).count() == len(ODD)


def test_decontamination_near_threshold():
    """One word of a 50-word item changed: similarity 41 / 51, found whatever the SimHash."""
    rnd = random.Random(12)
    items = [text_of(rnd, 50) for _ in range(300)]
    index = decontaminate.Index(list(range(300)), items)
    missed = 0
    for i, item in enumerate(items):
        w = item.split()
        w[25] = "changed"
        data, offs = common.buffers(pa.array([text_of(rnd, 30) + " " + " ".join(w) + " " + text_of(rnd, 30)], pa.large_string()))
        _, _, h, first = common.words(data, offs)
        s, _ = common.shingles(h, first)
        missed += [(x, start, pytest.approx(value)) for x, start, value in index.matches(s)] != [(i, 30, 41 / 51)]
    assert missed == 0
    runs = [[int(x) for x in rnd.choices(range(4), k=rnd.randrange(3, 30))] for _ in range(200)]
    for run in runs:  # repeated shingles, against the plain sum of every window
        item, width = collections.Counter(rnd.choices(range(4), k=3)), 3
        want = max((decontaminate.similarity(run[a : a + width], item, 3), -a) for a in range(len(run) - width + 1))
        assert decontaminate.best_window(run, width, item, 3) == (want[0], -want[1])


def test_hamming_index_finds_all_within_radius():
    rnd = random.Random(3)
    index = decontaminate.Index(list(range(40)), [text_of(rnd, 20) for _ in range(40)])
    prints = index.finger.copy()
    for k in range(40):
        for bit in rnd.sample(range(64), rnd.randrange(decontaminate.RADIUS + 1)):
            prints[k] ^= np.uint64(1 << bit)
    w, i = index.candidates(prints, 16)
    exact = {(a, b) for a in range(40) for b in range(40) if bin(int(prints[a]) ^ int(index.finger[b])).count("1") <= decontaminate.RADIUS}
    assert set(zip(w.tolist(), i.tolist(), strict=True)) == exact


# --- 6 suffix dedup


def covered_units(texts, size):
    """texts: id -> list of units; for each the places that a repeated window covers."""
    seen, out = set(), {}
    for i in sorted(texts):
        u, hit = texts[i], [False] * len(texts[i])
        for p in range(len(u) - size + 1):
            w = tuple(u[p : p + size])
            if w in seen:
                hit[p : p + size] = [True] * size
            seen.add(w)
        out[i] = hit
    return out


def test_suffix_dedup_bytes(spark):
    import hashlib

    rnd = random.Random(9)
    base = "".join(rnd.choice("abcde ") for _ in range(900))
    texts = {}
    for i in range(30):
        t = list(base[rnd.randrange(300) :])
        for _ in range(rnd.choice([0, 1, 6])):
            t[rnd.randrange(len(t))] = rnd.choice("xyzé")
        texts[i] = "".join(t)
    texts |= {50: "a" * 500, 51: "ab" * 200, 52: "", 53: "c" * 99, 54: "é" * 130, 55: base}
    want = covered_units({i: list(t.encode()) for i, t in texts.items()}, 100)
    got = {r["doc_id"]: r for r in suffixes.digest(docs_of(spark, [*texts.items(), (60, None)]).repartition(5)).collect()}
    assert len(got) == len(texts) + 1 and got[60]["n_bytes"] == 0
    for i, t in texts.items():
        raw, hit = t.encode(), want[i]
        assert (got[i]["n_bytes"], got[i]["n_removed"]) == (len(raw), sum(hit))
        assert got[i]["n_spans"] == sum(h and not (k and hit[k - 1]) for k, h in enumerate(hit))
        assert got[i]["kept_sha256"] == hashlib.sha256(bytes(b for b, h in zip(raw, hit, strict=True) if not h)).hexdigest()


def test_suffix_dedup_words(spark):
    rnd = random.Random(10)
    passage = text_of(rnd, 70)
    texts = {i: text_of(rnd, 30) + " " + (passage if i % 2 else text_of(rnd, 40)) + " " + text_of(rnd, 20) for i in range(12)}
    texts[20] = passage
    want = covered_units({i: t.split() for i, t in texts.items()}, 50)
    df = docs_of(spark, list(texts.items())).withColumn("n_chars", F.length("text").cast("long")).withColumn("id", F.lit("x")).withColumn("at", F.lit(1))
    got = {r["doc_id"]: r for r in suffixes.without_repeats(df).collect()}
    for i, t in texts.items():
        left = [w for w, h in zip(t.split(), want[i], strict=True) if not h]
        if left:
            assert got[i]["text"].split() == left and got[i]["n_chars"] == len(got[i]["text"]) and got[i]["id"] == "x"
        else:
            assert i not in got


def test_suffix_dedup_of_long_and_periodic_texts(spark):
    """Texts beyond the piece in which runs are made, with repeats across its end, and lines that fill texts, against brute force."""
    rnd = random.Random(15)
    line = "".join(rnd.choice("abcdefgh ") for _ in range(37))
    body = "".join(rnd.choice("abcdefghijklmnop ") for _ in range(5000))
    texts = {0: body, 1: line * 60, 2: "x" + line * 40 + "y" * 300, 3: body[1000:2000] + line * 10 + body[2000:2600], 4: "é" * 90 + line * 30, 5: body[900:] + body[:950]}
    old, suffixes.PIECE = suffixes.PIECE, 1024
    try:
        want = covered_units({i: list(t.encode()) for i, t in texts.items()}, 100)
        ids = {i: i for i in texts}
        rows = docs_of(spark, list(texts.items())).select(F.col("doc_id").alias("id"), "text")
        docs = rows.collect()
        kind = suffixes.Kind(False)
        made = [suffixes.runs(kind.values(np.frombuffer(r["text"].encode(), np.uint8)), 100, 20) for r in docs]  # in small pieces
        assert all(sum(int((p[3] >> 16).sum()) for p in parts) == len(r["text"].encode()) - 99 for parts, r in zip(made, docs, strict=True))
        assert ids
    finally:
        suffixes.PIECE = old
    big = {10: body * 3 + "".join(rnd.choice("abcdef ") for _ in range(700_000)), 11: line * 3000}
    big[12] = big[10][400_000:600_000] + "q" + line * 5
    got = {r["doc_id"]: r for r in suffixes.digest(docs_of(spark, [*texts.items(), *big.items()]).repartition(3)).collect()}
    for i, hit in want.items():
        assert got[i]["n_removed"] == sum(hit), i
    assert got[12]["n_removed"] == 200_000 + len(line) * 5
    assert got[11]["n_removed"] == len(line) * 3000  # all of it stands in text 1
    assert got[10]["n_removed"] == len(body) * 3


def test_suffix_dedup_of_equal_ids(spark):
    """Texts that differ under one id are documents of their own; rows that repeat both keep the same."""
    rnd = random.Random(16)
    a, b = text_of(rnd, 100), text_of(rnd, 100)
    got = suffixes.digest(docs_of(spark, [(1, a), (1, b), (1, a), (2, b + a), (3, None)])).collect()
    assert sorted((r["doc_id"], r["n_removed"]) for r in got)[:3] == [(1, 0)] * 3 and len(got) == 5
    two = next(r for r in got if r["doc_id"] == 2)
    assert two["n_removed"] == len(a) + len(b)
    kept = suffixes.without_repeats(docs_of(spark, [(1, a), (1, b), (1, a), (2, b + " " + a + " more")])).collect()
    assert sorted((r["doc_id"], r["text"]) for r in kept) == sorted([(1, a), (1, b), (1, a), (2, "more")])


def test_suffix_dedup_odd(spark):
    got = suffixes.digest(odd(spark)).collect()
    assert len(got) == len(ODD)
    assert suffixes.digest(docs_of(spark, [])).count() == 0
    kept = suffixes.without_repeats(odd(spark))
    assert kept.columns == odd(spark).columns and kept.count() == len(ODD)


# --- 7 language model


def test_language_model(spark):
    rnd = random.Random(12)
    pools = [[w + end for w in WORDS[:120]] for end in ("ka", "lich", "eux")]
    rows = []
    for i in range(300):
        pool = pools[i % 3]
        rows.append((i, " ".join(rnd.choice(pool[: rnd.choice([5, 120])]) for _ in range(rnd.randrange(1, 80)))))
    rows += [(i + 1000, t) for i, t in ODD if i]
    got = collections.defaultdict(list)
    for r in language_model.score(docs_of(spark, rows)).collect():
        got[r["doc_id"]].append(r)
    tokens_of = {i: [w.translate({c: c + 32 for c in range(65, 91)}) for w in re.findall("[^\x20\x09-\x0d]+", t or "")] + [0] for i, t in rows}
    counts = collections.Counter()
    for i, _ in rows:
        if zlib.crc32(str(i).encode()) % 5 != 1:
            counts.update(tokens_of[i])
    n, v = sum(counts.values()), len(counts)
    gain = 0.0
    for i, ts in tokens_of.items():
        for r in got[i]:
            assert (r["n_tokens"], r["n_known"], r["train_tokens"], r["held_out"]) == (len(ts), sum(counts[t] > 0 for t in ts), n, zlib.crc32(str(i).encode()) % 5 == 1)
            assert r["base_score"] == pytest.approx(sum(math.log10((counts[t] + 0.5) / (n + 0.5 * (v + 1))) for t in ts))
            gain += (r["score"] - r["base_score"]) * r["held_out"]
    assert gain > 0
    assert language_model.score(docs_of(spark, [])).count() == 0
    assert language_model.score(odd(spark)).count() == len(ODD)


def tokens_of_text(text):
    return language_model.Tokens(*common.buffers(pa.array([text])))


def plain_score(model, known, text):
    """log10 of a text's probability, token by token from the model's definition."""
    t = tokens_of_text(text)
    total = 0.0
    for i in range(len(t.hash)):
        z = sum(model.weights[r].astype(float) for r in t.features()[i])
        p = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
        c, part = int(model.class_of[t.bucket[i]]), int(t.part()[i])
        q = 1.0
        if c < language_model.CLUSTERS:
            rows = [h[i] for h in t.part_features(np.full(len(t.hash), c))]
            y = model.base[c].astype(float) + sum(model.inner[k, r] for k, r in enumerate(rows))
            q = float(np.exp(y[part]) / np.exp(y).sum())
        n = known.get(int(np.array(t.hash[i]).view(np.int64)), 0)
        total += math.log10(p[c] * q * (n + 0.5) / model.norm[c, part] + (p[language_model.REPEAT] if t.repeated()[i] else 0.0))
    return total


def test_model_score_against_plain_version(spark):
    rnd = random.Random(21)
    rows = [(i, " ".join(rnd.choice(WORDS[: rnd.choice([6, 200])]) for _ in range(rnd.randrange(1, 60)))) for i in range(80)] + [(100, None), (101, "one one one two")]
    df = docs_of(spark, rows)
    old, language_model.FREQUENT = language_model.FREQUENT, 40  # most tokens meet their counts in the join
    try:
        model, found = language_model.fit(spark, df.where(common.fold() != 1).select(F.coalesce("text", F.lit("")).alias("text")))
        known = {r["key"]: r["n"] for r in found.collect()}
        got = {r["doc_id"]: r["score"] for r in language_model.score(df).collect()}
    finally:
        language_model.FREQUENT = old
    for i, t in rows:
        assert got[i] == pytest.approx(plain_score(model, known, t or ""), abs=2e-3), i


def test_parts_learn_from_whole_tokens(spark):
    """Of a few fixed phrases of words that are alike to the classes, the history tells which word comes next."""
    rnd = random.Random(22)
    pool = [f"{a}{b}x{c}ka" for a in "bdfgk" for b in "aeiou" for c in "lmnrst"]
    phrases = [rnd.sample(pool, 6) for _ in range(12)]
    df = docs_of(spark, [(i, " ".join(w for _ in range(20) for w in rnd.choice(phrases))) for i in range(200)])
    model, _ = language_model.fit(spark, df.select("text"))
    gain = 0.0
    for p in phrases:
        t = tokens_of_text(" ".join(p))
        cls, part = model.class_of[t.bucket], t.part()
        inside = np.flatnonzero((cls < language_model.CLUSTERS) & (t.place >= 2))
        with_history = language_model.part_shares(model.base, model.inner, cls[inside], [h[inside] for h in t.part_features(cls)])[np.arange(len(inside)), part[inside]]
        gain += np.log10(with_history / np.exp(model.base[cls[inside], part[inside]])).sum()
    assert gain / sum(len(p) - 2 for p in phrases) > 0.3


def test_model_sums_to_one(spark):
    """Over every known token and the unknown one of each part, for a history with a repeat to come."""
    rnd = random.Random(1)
    df = docs_of(spark, [(i, text_of(rnd, 30)) for i in range(40)])
    model, found = language_model.fit(spark, df.select("text"))
    known = {r["key"]: r["n"] for r in found.collect()}
    words_ = sorted({w for r in df.collect() for w in r["text"].split()})
    history, at = "bash dan fin", 3
    total = 0.0
    for w in [*words_, None]:
        t = tokens_of_text(history + (f" {w}" if w else ""))
        share, repeat = model.shares(t)
        total += share[at] * (known.get(int(np.array(t.hash[at]).view(np.int64)), 0) + 0.5)
    t = tokens_of_text(history + " x")
    p = language_model.softmax(model.weights, t.features()[at : at + 1])[0]
    for c in range(language_model.CLUSTERS):
        q = language_model.part_shares(model.base, model.inner, np.array([c]), [h[at : at + 1] for h in t.part_features(np.full(len(t.hash), c))])[0]
        total += (p[c] * q * 0.5 / model.norm[c]).sum()
    own = tokens_of_text("").part()[0]
    total += p[language_model.END] * 0.5 / model.norm[language_model.END, own] + p[language_model.REPEAT]
    assert total == pytest.approx(1.0, abs=1e-4)


# --- 8 and 9 classifiers


def labelled_docs(spark, bad):
    rnd = random.Random(5)
    rows, labels = [], []
    for i in range(400):
        y = int(rnd.random() < 0.5)
        rows.append((i, text_of(rnd, rnd.randrange(20, 120)) if y else bad(rnd)))
        labels.append((i, y, 1 - y))
    ship(spark)
    return docs_of(spark, rows), spark.createDataFrame([*labels, (None, 1, 1), (3, None, None), (9999, 0, 1)], "doc_id long, quality int, toxic int"), dict((i, y) for i, y, _ in labels)


@pytest.mark.parametrize("module", [quality, toxicity])
def test_classifiers(spark, module):
    junk = lambda r: text_of(r, 40).upper().replace(" ", "!! ") if module is quality else " ".join(r.choice([*WORDS, "scumbag", "idiotic"]) for _ in range(60))
    if module is toxicity:
        junk = lambda r: text_of(r, 40) + " scumbag " + text_of(r, 10)
    df, labels, truth = labelled_docs(spark, junk)
    got = module.classify(df, labels).collect()
    assert len(got) == 400 and all(0 <= r["score"] <= 1 for r in got)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and r["predicted"] == int(r["score"] >= module.THRESHOLD) for r in got)
    held = [(r["predicted"] == (truth[r["doc_id"]] if module is quality else 1 - truth[r["doc_id"]])) for r in got if r["held_out"]]
    assert sum(held) / len(held) > 0.9
    out = module.score(odd(spark), module.train(df, labels)).collect()
    assert len(out) == len(ODD) and len({r["score"] for r in out if r["doc_id"] in (1, 2)}) == 1 and all(0 <= r["score"] <= 1 for r in out)
    assert module.classify(df.limit(5), labels.limit(0)).count() == 5
    assert module.classify(df.limit(0), labels).count() == 0


def test_training_reads_whole_texts(spark):
    """What tells toxic texts stands after a long beginning; samples are bounded by rows and whole texts' bytes, not by cutting them."""
    rnd = random.Random(30)
    rows = [(i, text_of(rnd, 6000) + (" scumbag" if i % 2 else "") + " end") for i in range(120)]
    labels = spark.createDataFrame([(i, 1, i % 2) for i, _ in rows], "doc_id long, quality int, toxic int")
    ship(spark)
    df = docs_of(spark, rows)
    got = toxicity.classify(df, labels).where("held_out").collect()
    assert got and all(r["predicted"] == r["doc_id"] % 2 for r in got)
    texts, y, _ = labelled.sample(df, labels, "toxic", size=200_000)
    whole = {t.encode() for _, t in rows}
    assert set(texts) <= whole and {int(c) for c in y} == {0, 1}
    assert all(sum(len(t) for t, c in zip(texts, y, strict=True) if c == k) <= 200_000 for k in (0, 1))
    assert len(labelled.sample(df, labels, "toxic", size=1)[0]) == 2  # the first row of a class counts always


def test_boundaries_are_folded():
    a, b = (toxicity.distinct(t) for t in (b"ab  cd... ef", b"ab cd ef"))
    assert (a == b).all() and not np.array_equal(a, toxicity.distinct(b"abcd ef"))


def test_labels_never_feed_scores(spark):
    """Other columns don't change a score."""
    df, labels, _ = labelled_docs(spark, lambda r: text_of(r, 40).upper())
    a = {r["doc_id"]: r["score"] for r in quality.classify(df, labels).collect()}
    b = {r["doc_id"]: r["score"] for r in quality.classify(df.withColumn("lang", F.lit("xx")).withColumn("quality", F.lit(1)), labels).collect()}
    assert a == b


# --- pipeline


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    rnd = random.Random(20)
    item = text_of(rnd, 25)
    passage = text_of(rnd, 60)
    rows = []
    for i in range(200):
        good = i % 5 > 0
        t = text_of(rnd, 90)
        if i % 10 == 1:
            t = t + " " + item
        if i % 10 == 2:
            t = t + " " + passage
        if i % 10 == 3 and i > 10:
            t = rows[3][1]
        rows.append((i, t if good else t.upper().replace(" ", "!! "), "en", "hot" if i % 3 else f"s{i % 2}", len(t)))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(i % 5 > 0), 0) for i in range(200)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = common.cut(stage(spark, docs, str(tmp_path)))
        seen[name] = {r["doc_id"]: r for r in docs.collect()}
        if name != "mixing":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert len(seen["quality"]) >= 155 and all(i % 5 for i in seen["quality"])
    assert [i for i in seen["near_duplicates"] if i % 10 == 3] == [3]
    cut = [r for i, r in seen["suffix_dedup"].items() if i % 10 == 2]
    assert sum(passage in r["text"] for r in cut) == 1 and len(cut) == 20
    assert not any(item in r["text"] for r in seen["decontamination"].values())
    assert not any(i % 10 == 1 for i in seen["decontamination"])
    assert set(seen["mixing"]) == set(seen["decontamination"])
    assert {r["doc_id"] for r in corpus_pipeline.run(spark, str(tmp_path)).collect()} == set(seen["mixing"])
    assert json.dumps([n for n, _ in corpus_pipeline.STAGES])


def test_pipeline_on_odd_inputs(spark, tmp_path):
    """Null ids and texts, repeated ids and rows, extra columns with clashing names, and empty tables go through all stages."""
    import corpus_pipeline

    rnd = random.Random(40)
    rows = [(i, text_of(rnd, 60), "en", "s", 1) for i in range(60)] + [(None, text_of(rnd, 50), None, None, None), (3, "same id other text " + text_of(rnd, 40), "en", "s", 1), (70, None, None, "s", None), (71, "", "en", None, 0)]
    rows += [rows[5], rows[5]]
    labels = spark.createDataFrame([(i, int(i % 2), 0) for i in range(60)] + [(None, 1, 1)], "doc_id long, quality int, toxic int")
    for name, keep in (("some", "true"), ("none", "false")):
        folder = f"{tmp_path}/{name}"
        docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").where(keep)
        docs.withColumns({c: F.lit(1) for c in ("id", "at", "shape", "rep", "h", "_id", "_text", "_kept", "score", "k")}).write.parquet(f"{folder}/documents.parquet")
        labels.where(keep).write.parquet(f"{folder}/labels.parquet")
        spark.createDataFrame([(1, "none of these words stand there at all")], "item_id long, text string").where(keep).write.parquet(f"{folder}/benchmark.parquet")
        got = corpus_pipeline.run(spark, folder).collect()
        assert (not got) == (name == "none") and {r["doc_id"] for r in got} <= {None, *range(60), 70, 71}

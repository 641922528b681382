"""Operators 11 to 13 against plain versions: whole small tables, planted cases, ties, repeats, nulls, empty tables, clashing columns."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallywright.llm import centroids, manifest, registry, url_templates
from tallywright.session import ship

DIR = "/root/testdata/sf0.001"
CLASHING = ("at", "n", "hash", "sk", "path", "block", "weight", "host", "open", "node", "p", "v", "k", "root", "leaf", "cluster", "distance", "rule", "key", "_row", "_salt")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def clashing(df):
    return df.withColumns({c: F.lit(1) for c in CLASHING})


# --- 11 url filters


def plain_parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :], re.S)[0]
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host), path


def plain_rule(host, path, rules=url_templates.RULES):
    best = None
    for text, said in rules:
        at, below = text.split("/", 1)
        if (host == at or host.endswith("." + at)) and path.startswith("/" + below) and (best is None or len(text) > len(best[0])):
            best = text, said
    return best or (None, None)


def plain_kind(seg):
    if seg is None:
        return "end"
    return next((k for k, p in url_templates.KINDS if re.search(p, seg)), "other")


def plain_judged(urls, bad=None):
    """Verdict and purity by url, host by host and branch by branch."""
    u, out = url_templates, {}
    pages = []
    for i, url in enumerate(urls):
        host, path = plain_parts(url)
        rule, said = plain_rule(host, path)
        label = bad[i] if bad else None if said is None else said == "block"
        pages.append((i, host, path, rule, said, label, path.split("/", u.DEPTH + 1)[1:]))
    known = [p[5] for p in pages if p[5] is not None]
    overall = (sum(known) + 0.5) / (len(known) + 1)
    hosts = defaultdict(list)
    for p in pages:
        hosts[p[1]].append(p)

    def purity(own, above):
        labels = [p[5] for p in own if p[5] is not None]
        return (sum(labels) + u.PRIOR * above) / (len(labels) + u.PRIOR)

    def shares(own, level):
        c = Counter(plain_kind(p[6][level + 1] if len(p[6]) > level + 1 else None) for p in own)
        return [c[k] / len(own) for k in u.NAMES]

    def alike(a, b, level):
        la, lb = ([p[5] for p in x if p[5] is not None] for x in (a, b))
        if (len(la) >= u.LABELLED) != (len(lb) >= u.LABELLED):
            return False
        noise = 0.5 * (len(u.NAMES) / len(a)) ** 0.5 + 0.5 * (len(u.NAMES) / len(b)) ** 0.5
        if sum(abs(x - y) for x, y in zip(shares(a, level), shares(b, level), strict=True)) / 2 > u.ALIKE + noise:
            return False
        if len(la) < u.LABELLED:
            return True
        both = (sum(la) + sum(lb)) / (len(la) + len(lb))
        return abs(sum(la) / len(la) - sum(lb) / len(lb)) <= u.ALIKE + 1.5 * (both * (1 - both) * (1 / len(la) + 1 / len(lb))) ** 0.5

    def walk(own, level, p, size, whole, template):
        stays = [x for x in own if len(x[6]) <= level or size < max(u.LEAST, u.SHARE * whole)]
        for x in stays:
            out[x[0]] = (x[1], x[2], x[3], x[4] or ("block" if p > u.THRESHOLD else "allow"), p)
        left = [x for x in own if len(x[6]) > level and size >= max(u.LEAST, u.SHARE * whole)]
        seen, named = Counter(x[6][level] for x in left), defaultdict(list)
        for x in left:
            s = x[6][level]
            named["=" + (s if len(s) <= 64 else "md5:" + hashlib.md5(s.encode()).hexdigest()) if seen[s] >= max(u.LEAST, u.SHARE * whole) else "*" + plain_kind(s)].append(x)
        groups = []
        for name in sorted(named, key=lambda k: (-len(named[k]), k)):
            near = next((g for g in groups if alike(g, named[name], level)), None)
            if near is None:
                groups.append(list(named[name]))
            else:
                near += named[name]
        for g in groups:
            q = purity(g, p)
            if level == 0 and all(x[5] is None for x in g):
                q = min(q, u.THRESHOLD)
            walk(g, level + 1, q, len(g), whole, template + "/x")

    for own in hosts.values():
        walk(own, 0, purity(own, overall), len(own), len(own), "")
    return out


def held_to_plain(rows, urls, bad=None):
    want = plain_judged(urls, bad)
    assert len(rows) == len(urls)
    for r in rows:
        w = want[r["page_id"]]
        assert (r["host"], r["path"], r["rule"], r["verdict"]) == w[:4], r
        assert abs(r["purity"] - w[4]) < 1e-9, r


@pytest.mark.parametrize("folder", [DIR, "/root/testdata/sf0.01"])
def test_url_query(spark, folder):
    pages = spark.read.parquet(f"{folder}/pages.parquet").select("page_id", "url").collect()
    place = {p["page_id"]: i for i, p in enumerate(pages)}
    got = registry.QUERIES["op11_url_filters"](spark, folder).collect()
    assert got[0].__fields__[:5] == ["page_id", "host", "path", "rule", "verdict"]
    held_to_plain([type("R", (dict,), {})(r.asDict() | {"page_id": place[r["page_id"]]}) for r in got], [p["url"] for p in pages])


def planted():
    """A host whose /tag/<word> pages are spam, one with two halves, a deep one, odd urls; labels for a third of the pages."""
    urls, bad = [], []
    for i in range(400):
        urls.append(f"http://Mix.example.net/{'tag' if i % 2 else 'post'}/{'abcdefghij'[i % 10]}{'klmnopqrst'[i // 10 % 10]}{'uvwxyz'[i // 100]}")
        bad.append(i % 2 == 1)
    for i in range(300):
        urls.append(f"https://two.example.net/{2000 + i % 3}/{i:08x}/{i}.html?x={i}#f")
        bad.append(i % 3 == 0)
    deep = "/".join(["s"] * 30)
    urls += [f"ftp://deep.example.net/{deep}/{i}" for i in range(40)] + ["http://long.example.net/" + "y" * 300] * 30
    bad += [True] * 40 + [False] * 30
    odd = [None, "", "no scheme", "http://", "http://x.ORG", "http://x.org?/de/", "http://a.example.org/es/1", "http://nexample.org/es/1", "HTTP://fr.com/fr/1#x", "http://com/de/1", "x://y://com/de/", "http://u@h.com:80/de/1", "http://é.com/fr/\n?", "http://É.NET/"]
    urls += odd * 2
    bad += [None] * (2 * len(odd))
    return urls, [b if zlib.crc32(str(i).encode()) % 3 == 0 else None for i, b in enumerate(bad)], bad


def test_url_templates_planted(spark):
    urls, known, truth = planted()
    ship(spark)
    df = clashing(spark.createDataFrame([(i, u, b) for i, (u, b) in enumerate(zip(urls, known, strict=True))], "page_id long, url string, given boolean"))
    rows = url_templates.judged(df, bad=F.col("given")).collect()
    held_to_plain(rows, urls, known)
    unseen = [r for r in rows if known[r["page_id"]] is None and truth[r["page_id"]] is not None and r["rule"] is None]
    assert len(unseen) > 400 and all((r["verdict"] == "block") == truth[r["page_id"]] for r in unseen)
    assert {r["template"] for r in rows if r["host"] == "mix.example.net"} == {"/tag/<word>", "/post/<word>"}
    assert {r["template"].count("/") for r in rows if r["host"] == "deep.example.net"} == {url_templates.DEPTH + 1}


def test_url_filters_without_rows_or_labels(spark):
    ship(spark)
    none = spark.createDataFrame([], "page_id long, url string")
    assert url_templates.judged(none).columns == ["page_id", "host", "path", "rule", "verdict", "template", "purity"] and url_templates.judged(none).count() == 0
    same = spark.createDataFrame([(None, "http://h.net/a")] * 60 + [(1, None)] * 3, "page_id long, url string")
    got = url_templates.judged(same).collect()
    assert len(got) == 63 and {r["verdict"] for r in got} == {"allow"} and {r["rule"] for r in got} == {None}


# --- 12 centroid clustering


def plain_clusters(rows):
    """(vec_id, cluster, distance, cluster_inertia, inertia, digest) by whole numbers, one vector after the other."""
    held = []
    for i, v in rows:
        if v is not None and len(v) == 64 and all(x is not None and np.isfinite(x) and abs(x) < 2**21 for x in v):
            held.append((i, [int(np.floor(64 * float(x))) for x in v]))
    order = sorted(held, key=lambda r: (sha(f"1:{'' if r[0] is None else r[0]}"), r[1]))
    c = [v for _, v in order[:16]]
    x = np.array([v for _, v in held], dtype=object).reshape(-1, 64)
    for turn in range(4):
        d = np.stack([((x - np.array(one, dtype=object)) ** 2).sum(1) for one in c], 1)
        near = [min(range(len(c)), key=lambda k: (row[k], k)) for row in d]
        if turn < 3:
            for k in range(len(c)):
                own = [i for i, n in enumerate(near) if n == k]
                if own:
                    c[k] = [int(sum(x[i][j] for i in own)) // len(own) for j in range(64)]
    best = [int(row[k]) for row, k in zip(d, near, strict=True)]
    per = Counter()
    for k, b in zip(near, best, strict=True):
        per[k] += b
    return Counter((i, k, b, per[k], sum(best), sha(",".join(map(str, c[k])))) for (i, _), k, b in zip(held, near, best, strict=True))


def vectors(spark, rows):
    ship(spark)
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>")


def test_cluster_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{DIR}/embeddings.parquet").select("vec_id", "embedding").collect()]
    got = registry.QUERIES["op12_centroid_clustering"](spark, DIR)
    assert got.columns[:6] == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert Counter(tuple(r) for r in got.collect()) == plain_clusters(rows)


def clumps(size=1.0):
    """Tight groups far apart, many equal vectors, ties between groups, repeated ids."""
    rng = np.random.default_rng(5)
    middles = rng.normal(0, 3 * size, (12, 64))
    rows = [(i, (middles[i % 12] + rng.normal(0, 0.02 * size, 64)).astype(np.float32).tolist()) for i in range(700)]
    rows += [(1000 + i % 7, rows[3][1]) for i in range(300)]
    rows += [(2000 + i, [float(size * (i % 2))] + [0.0] * 63) for i in range(60)]
    return rows


@pytest.mark.parametrize("size", [1.0, 30000.0])  # the second has products beyond what doubles hold exactly
def test_clusters_against_plain(spark, size):
    rows = clumps(size)
    bad = [(5, None), (6, []), (7, [1.0] * 63), (8, [1.0] * 65), (9, [None] + [1.0] * 63), (10, [float("nan")] + [0.0] * 63), (11, [float("inf")] * 64), (12, [-float("inf")] * 64), (13, [3e38] * 64), (None, [0.5] * 64), (None, [-0.5] * 64)]
    got = centroids.clusters(clashing(vectors(spark, rows + bad).repartition(3)))
    assert Counter(tuple(r) for r in got.collect()) == plain_clusters(rows + bad)


def test_balls_go_whole_and_lose_nothing():
    x = np.floor(64 * np.array([v for _, v in clumps()])).astype(np.int64)
    order, tree = centroids.Balls.built(x)
    assert sorted(order) == list(range(len(x)))
    again = centroids.Balls.unpack(tree.pack())
    c = x[[0, 1, 2, 3, 703, 4, 1000, 1001]]
    c = np.concatenate([c, c[:2]])
    near, whole = np.full(len(x), -1), 0
    for node, _, one, some, d in again.filtered(x[order], c):
        lo, hi = again.lo[node], again.hi[node]
        assert (x[order[lo:hi]].sum(0) == again.sum[node]).all() and (x[order[lo:hi]] ** 2).sum() == again.square[node]
        near[order[lo:hi]] = one if one is not None else some[d.argmin(1)]
        whole += hi - lo if one is not None else 0
    assert (near == ((x[:, None] - c[None]) ** 2).sum(2).argmin(1)).all()
    assert whole > len(x) * 0.5  # seven groups have no start of their own


def test_few_and_no_vectors(spark):
    few = [(1, [0.0] * 64), (2, [1.0] * 64), (2, [1.0] * 64)]
    assert Counter(tuple(r) for r in centroids.clusters(vectors(spark, few)).collect()) == plain_clusters(few)
    for rows in ([], [(1, None)]):
        none = centroids.clusters(vectors(spark, rows))
        assert none.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"] and none.count() == 0


# --- 13 Merkle manifest


def plain_manifest(rows):
    """rows: (doc_id, source, lang, n_chars, text); a tree is climbed for each document on its own."""

    def leaf(row):
        return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))

    def proof(nodes, i, own):
        """Siblings' text, and what the digest own in place i folds to."""
        text = ""
        while len(nodes) > 1:
            at = i // 16 * 16
            run = nodes[at : at + 16]
            text += "".join(run[: i - at] + run[i - at + 1 :])
            own = sha("".join(run[: i - at]) + own + "".join(run[i - at + 1 :]))
            nodes = [sha("".join(nodes[j : j + 16])) for j in range(0, len(nodes), 16)]
            i //= 16
        return text, own, nodes[0]

    by = defaultdict(list)
    for r in rows:
        by[r[1]].append((r[0] is not None, r[0] or 0, leaf(r), r))
    held = {s: sorted(v, key=lambda x: x[:3]) for s, v in by.items()}
    names = sorted(held, key=lambda s: (s is not None, (s or "").encode()))
    subroots = [proof([x[2] for x in held[s]], 0, held[s][0][2])[2] for s in names]
    out = []
    for k, s in enumerate(names):
        nodes = [x[2] for x in held[s]]
        for i, (_, _, own, r) in enumerate(held[s]):
            other = own
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 and r[4] is not None:
                other = leaf((*r[:4], "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in r[4])))
            low, folded, subroot = proof(nodes, i, other)
            high, folded, root = proof(subroots, k, folded)
            out.append((r[0], own, subroot, root, sha(low + high), folded, folded == root))
    return Counter(out)


DOC = "doc_id long, source string, lang string, n_chars long, text string"


def manifested(spark, rows):
    ship(spark)
    extra = [c for c in CLASHING if c not in ("n",)]
    got = manifest.manifest(spark.createDataFrame(rows, DOC).withColumns({c: F.lit(1) for c in extra}).repartition(5))
    return Counter(tuple(r) for r in got.collect())


def test_manifest_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{DIR}/documents.parquet").select("doc_id", "source", "lang", "n_chars", "text").collect()]
    got = registry.QUERIES["op13_merkle_manifest"](spark, DIR)
    assert got.columns[:7] == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert Counter(tuple(r) for r in got.collect()) == plain_manifest(rows)


def test_manifest_of_all_sizes(spark):
    rows, i = [], 0
    for name, n in [("a", 1), ("b", 2), ("c", 16), ("d", 17), ("e", 255), ("f", 256), ("g", 257), ("h", 4100), (None, 33), ("", 5), ("é", 3), ("\U0001f600", 2), ("zz", 1)]:
        for _ in range(n):
            rows.append((i * 7919 % 100_003, name, None if i % 11 == 0 else "en", None if i % 13 == 0 else i, f"Text {i} É" if i % 17 else None))
            i += 1
    assert manifested(spark, rows) == plain_manifest(rows)


def test_manifest_of_many_sources_repeats_and_odd_rows(spark):
    rows = [(i, f"s{i % 300}", "en", 3, "ABC") for i in range(600)]
    rows += [(7, "s1", "en", 3, "ABC")] * 40 + [(7, "s1", "en", 3, "abd")] * 3 + [(None, "s1", None, None, None)] * 2 + [(None, None, None, None, "")]
    rows += [(900, "s2", "de", 0, "X" * 3_000_000), (905, "s2", "de", -5, "-"), (910, "s2", "", 0, "1:a")]
    got = manifested(spark, rows)
    assert got == plain_manifest(rows)
    assert any(not k[-1] for k in got)


@pytest.mark.parametrize("rows", [[], [(1, "a", "en", 1, "A")], [(5, None, None, None, None)]])
def test_manifest_of_few_rows(spark, rows):
    assert manifested(spark, rows) == plain_manifest(rows)

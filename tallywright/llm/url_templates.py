"""Operator 11, URL filter: rules first, then a tree of path templates for each host whose branches are rejected by labelled purity.

Every page of a host starts at the host's root. Level by level, a path segment that holds at least SHARE of the host's pages (and LEAST of them)
stays as it is; all others become the wildcard of their kind (number, word, slug, ...). Sibling branches are then merged where they are
statistically alike: both with labels or both without, the kinds of segments that follow and the labels differing by no more than
sampling would explain. A branch's purity is the share of blocked ones among its labelled pages, smoothed towards its parent's (the root's towards
that of all pages); pages whose template's purity is over THRESHOLD are blocked, but what labels elsewhere on the host say doesn't reject
a branch at its root that has none itself. Labels are the verdicts of the rules that fit a page, or those that
the caller gives.

As a segment is kept only from a share of its host on, a level of a host has no more than 1 / SHARE kept segments and as many open branches,
however large the host: that is what a task sees of it. Pages are counted by partial sums and get their branches by a join on
the host, whose hot keys are dealt over salts. Branches of fewer than LEAST pages aren't split; DEPTH segments are looked at one by one, and
what lies below is one more, of its own kind.

Edge cases: a null url, or one without ://, has an empty host and path, and such pages are judged together; a url without a path stays at
its host's root; equal urls get equal verdicts; without any label the method allows everything; segments and hosts of over 64 characters
are compared by their md5. Other columns aren't read."""

from __future__ import annotations

import itertools
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, dealt, mapped, scratch

#: host/path prefix and verdict.
RULES = (("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block"))
SHARE = 0.005
LEAST = 20
DEPTH = 12
THRESHOLD = 0.5
#: So many labels the parent's purity counts as.
PRIOR = 4.0
#: Fewer labels than this don't make a branch a labelled one.
LABELLED = 5
#: Shares may differ by this much, and by sampling, in branches that are alike.
ALIKE = 0.1
#: Kinds of segments by their first fitting pattern; "end" stands for no segment.
KINDS = (("slash", r"^$"), ("rest", "/"), ("num", r"^[0-9]+$"), ("page", r"^[0-9]+\.[A-Za-z]\w{0,4}$"), ("hex", r"^(?=.*[0-9])[0-9A-Fa-f-]{8,}$"), ("word", r"^[A-Za-z]+$"), ("file", r"^[^.]+\.[A-Za-z]\w{0,4}$"), ("slug", "[-_]"))
NAMES = (*[k for k, _ in KINDS], "other", "end")
_CAPITALS, _SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z as small letters) and path of a url, empty where there is no ://."""
    host, path = [F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)([^?#]*)", i), F.lit("")) for i in (1, 2)]
    return F.translate(host, _CAPITALS, _SMALL), path


def fitting(host: Column, path: Column, rules: Sequence[tuple[str, str]] = RULES) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; NULLs if none does. A rule fits its host and all below it where the path begins with the rule's."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for text, said in sorted(rules, key=lambda r: (len(r[0]), r[0].index("/"), r[0])):  # the last that fits wins
        at, below = text.split("/", 1)
        fits = ((host == at) | F.endswith(host, F.lit("." + at))) & F.startswith(path, F.lit("/" + below))
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(said)).otherwise(verdict)
    return rule, verdict


def kind(segment: Column) -> Column:
    out = F.when(segment.isNull(), F.lit("end"))
    for name, pattern in KINDS:
        out = out.when(segment.rlike(pattern), F.lit(name))
    return out.otherwise(F.lit("other"))


def _short(text: Column) -> Column:
    return F.when(F.length(text) > 64, F.concat(F.lit("md5:"), F.md5(text))).otherwise(text)


def _alike(a: dict, b: dict) -> bool:
    m, n = a["bad"] + a["good"], b["bad"] + b["good"]
    if (m >= LABELLED) != (n >= LABELLED):
        return False
    apart = sum(abs(x / a["n"] - y / b["n"]) for x, y in zip(a["next"], b["next"], strict=True)) / 2
    if apart > ALIKE + 0.5 * (len(NAMES) / a["n"]) ** 0.5 + 0.5 * (len(NAMES) / b["n"]) ** 0.5:
        return False
    if m < LABELLED:
        return True
    both = (a["bad"] + b["bad"]) / (m + n)
    return abs(a["bad"] / m - b["bad"] / n) <= ALIKE + 1.5 * (both * (1 - both) * (1 / m + 1 / n)) ** 0.5


def branches(children: list[dict], host_n: int) -> dict[str, dict]:
    """The branches that a host's children (node, p, template, name, n, bad, good, next) come to: child, p, template, open by node and name. Larger
    children come first, those of equal size by name; each joins the first branch of its node that is like it."""
    out, made = {}, 0
    order = sorted(children, key=lambda c: (c["node"], -c["n"], c["name"]))
    for node, own in itertools.groupby(order, key=lambda c: c["node"]):
        groups: list[dict] = []
        for c in own:
            near = next((g for g in groups if _alike(g, c)), None)
            if near is None:
                groups.append(c | {"names": [c["name"]]})
            else:
                near |= {k: near[k] + c[k] for k in ("n", "bad", "good")} | {"next": [x + y for x, y in zip(near["next"], c["next"], strict=True)], "names": [*near["names"], c["name"]]}
        for g in groups:
            lead = g["names"][0]
            shown = lead[1:] if lead[0] == "=" else f"<{lead[1:]}>"
            more = f" +{len(g['names']) - 1}" if len(g["names"]) > 1 else ""
            purity = (g["bad"] + PRIOR * g["p"]) / (g["bad"] + g["good"] + PRIOR)
            if not g["template"] and not g["bad"] + g["good"]:
                purity = min(purity, THRESHOLD)
            branch = {"child": made, "p": purity, "template": f"{g['template']}/{shown}{more}", "open": g["n"] >= max(LEAST, SHARE * host_n)}
            out |= {f"{node}{name}": branch for name in g["names"]}
            made += 1
    return out


def _models(counted: DataFrame) -> DataFrame:
    """hk, weight (pages that look for a branch), kids (branches by node and name) of each host. counted: the host's children, a bounded number."""
    held = counted.groupBy("hk", "hn").agg(F.sum("n").alias("weight"), F.collect_list(F.struct("node", "p", "template", "name", "n", "bad", "good", "next")).alias("children"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kids = pa.map_(pa.string(), pa.struct([("child", pa.int32()), ("p", pa.float64()), ("template", pa.string()), ("open", pa.bool_())]))
        for b in batches:
            made = [list(branches(children, hn).items()) for children, hn in zip(b.column("children").to_pylist(), b.column("hn").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("hk"), b.column("weight"), pa.array(made, kids)], names=["hk", "weight", "kids"])

    return mapped(held, run, "hk string, weight long, kids map<string, struct<child: int, p: double, template: string, open: boolean>>")


def _counted(rows: DataFrame, level: int) -> DataFrame:
    """Children of the open branches: rare segments under their kind's wildcard."""
    seg, then = F.get("segments", F.lit(level)), kind(F.get("segments", F.lit(level + 1)))
    keys = ["hk", "hn", "node", "p", "template"]
    named = rows.select(*keys, _short(seg).alias("seg"), kind(seg).alias("kind"), then.alias("then"), "bad")
    sums = [F.sum(F.when(F.col("then") == k, 1).otherwise(0)).alias(f"next_{k}") for k in NAMES]
    each = named.groupBy(*keys, "seg", "kind").agg(F.count("*").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"), F.coalesce(F.sum(1 - F.col("bad")), F.lit(0)).alias("good"), *sums)
    kept = F.col("n") >= F.greatest(F.lit(float(LEAST)), SHARE * F.col("hn"))
    name = F.when(kept, F.concat(F.lit("="), "seg")).otherwise(F.concat(F.lit("*"), "kind"))
    totals = [F.sum(c).alias(c) for c in ("n", "bad", "good", *[f"next_{k}" for k in NAMES])]
    return each.groupBy(*keys, name.alias("name")).agg(*totals).withColumn("next", F.array(*[f"next_{k}" for k in NAMES]))


def judged(pages: DataFrame, rules: Sequence[tuple[str, str]] = RULES, bad: Column | None = None) -> DataFrame:
    """Per page: page_id, host, path, rule, verdict, template (the page's branch below its host), purity.

    bad: whether a page is known to be one to block (NULL: not known), in place of the verdicts of rules, which still hold for the pages they fit."""
    host, path = parts(F.col("url"))
    rows = pages.select("page_id", host.alias("host"), path.alias("path"), (bad.cast("int") if bad is not None else F.lit(None).cast("int")).alias("given"))
    rule, said = fitting(F.col("host"), F.col("path"), rules)
    rows = rows.withColumns({"rule": rule, "said": said, "hk": _short(F.col("host"))})
    rows = rows.withColumn("bad", F.col("given") if bad is not None else (F.col("said") == "block").cast("int")).drop("given")
    with scratch(pages.sparkSession) as keep:
        hosts = cut(rows.groupBy("hk").agg(F.count("*").alias("weight"), F.coalesce(F.sum("bad"), F.lit(0)).alias("h_bad"), F.count("bad").alias("h_labelled")))
        total, blocked, labelled = hosts.agg(F.coalesce(F.sum("weight"), F.lit(0)), F.coalesce(F.sum("h_bad"), F.lit(0)), F.coalesce(F.sum("h_labelled"), F.lit(0))).first()
        overall = (blocked + 0.5) / (labelled + 1)
        segments = F.slice(F.split("path", "/", DEPTH + 2), 2, DEPTH + 1)
        root = (F.col("h_bad") + PRIOR * overall) / (F.col("h_labelled") + PRIOR)
        level = dealt(rows, hosts, "hk", total).select(
            "page_id", "host", "path", "rule", "said", "hk", "bad", F.col("weight").alias("hn"), segments.alias("segments"),
            F.lit(0).alias("node"), root.alias("p"), F.lit("").alias("template"),
        )
        level = cut(level.withColumn("open", (F.col("hn") >= LEAST) & (F.size("segments") > 0)))
        levels = [level]
        for at in range(DEPTH + 1):
            rows = level.where("open").drop("open")
            if rows.isEmpty():
                break
            models = cut(_models(_counted(rows, at)))
            kids = [F.try_element_at("kids", F.concat(F.col("node").cast("string"), F.lit(mark), name)) for mark, name in (("=", _short(F.get("segments", F.lit(at)))), ("*", kind(F.get("segments", F.lit(at)))))]
            met = dealt(rows, models, "hk", models.agg(F.sum("weight")).first()[0]).withColumn("kid", F.coalesce(*kids))
            more = F.get("segments", F.lit(at + 1)).isNotNull()
            level = cut(met.select(*[c for c in rows.columns if c not in ("node", "p", "template")], F.col("kid.child").alias("node"), "kid.p", "kid.template", (F.col("kid.open") & more).alias("open")))
            levels.append(level)
        verdict = F.coalesce("said", F.when(F.col("p") > THRESHOLD, F.lit("block")).otherwise(F.lit("allow")))
        done = [t.where("NOT open").select("page_id", "host", "path", "rule", verdict.alias("verdict"), "template", F.col("p").alias("purity")) for t in levels]
        result = done[0]
        for t in done[1:]:
            result = result.unionByName(t)
        return keep(result, *levels)

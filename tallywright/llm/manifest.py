"""Operator 13, Merkle manifest of a dataset: one root over all documents, and each document's proof against it.

A leaf is the sha256 (lowercase hex, as are all digests) of a row's fields. The leaves of a source ascend by doc_id; while more than one
node remains, every FANOUT consecutive ones become the hash of their digests' text. What remains is the source's subroot, and the
subroots, ordered by source, become the root in the same way.

Leaves are numbered by range-sorted parts and dealt in aligned blocks of BLOCK = FANOUT ** LEVELS, so that no task sees more than a
block of a source, however large that is. A block is a contiguous matrix of 64-byte hex digests: runs are its rows after a reshape by
the fanout, parents are hashed level by level, and siblings are slices found by index arithmetic. The blocks' tops are the leaves of the
next, BLOCK times smaller table, and so on until every source has one; on the way back each table hands its children the siblings
above them.

Edge cases: a null field counts as "-", so a null source is a source of its own, before all others; a null doc_id comes before all
others and is never tampered with; rows of the same doc_id in a source are ordered by their leaves, and wholly equal rows are
interchangeable; a lone leaf is its source's subroot, a lone subroot the root; without rows there is no root and no result. Other columns
are not read."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from .common import cut, mapped, scratch

FANOUT = 16
LEVELS = 2
BLOCK = FANOUT**LEVELS
HEX = 64
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
TAMPER = 5
_CAPITALS, _SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

PATH = "array<struct<before: string, after: string>>"


def leaf(**changed: Column) -> Column:
    """Digest of a row's FIELDS, each "-" if null, else its UTF-8 byte count, ":" and itself. changed: columns in place of fields."""
    texts = [changed.get(f, F.col(f)).cast("string") for f in FIELDS]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]), 256)


def leaves(docs: DataFrame) -> DataFrame:
    """doc_id, sk (the source's key: its order is that of sources, null first), hash, tampered (the leaf of the row with small letters only,
    where TAMPER divides crc32 of the id; else NULL) and tie, which orders equal rows."""
    chosen = F.crc32(F.col("doc_id").cast("string").cast("binary")) % TAMPER == 0
    return docs.select(*FIELDS).select(
        "doc_id",
        F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit("")).alias("sk"),
        leaf().alias("hash"),
        F.when(chosen, leaf(text=F.translate("text", _CAPITALS, _SMALL))).alias("tampered"),
        F.monotonically_increasing_id().alias("tie"),
    )


def ranked(df: DataFrame, *order: str) -> DataFrame:
    """df with at, its rows' places from 0 in each sk, and n, the rows of the sk. Parts of equal size are sorted on their own; a place is
    that in the part's run of the sk, after all that earlier parts have of it."""
    keys = [F.col(c).asc_nulls_first() for c in ("sk", *order)]
    placed = cut(df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_id", F.monotonically_increasing_id()))
    part = F.shiftright("_id", 33)
    runs = placed.groupBy("sk", part.alias("_part")).agg(F.min("_id").alias("_least"), F.count("*").alias("_rows"))
    own = Window.partitionBy("sk")  # one row for each part that has the sk
    before = F.coalesce(F.sum("_rows").over(own.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    runs = runs.select("sk", "_part", "_least", before.alias("_before"), F.sum("_rows").over(own).alias("n"))
    return placed.withColumn("_part", part).join(runs, ["sk", "_part"]).select(*df.columns, (F.col("_id") - F.col("_least") + F.col("_before")).alias("at"), "n")


def heights(n: int) -> tuple[int, int]:
    """Levels that a block climbs in a source of n nodes, and how many nodes of the source there are then."""
    k = 0
    while n > 1 and k < LEVELS:
        n, k = -(-n // FANOUT), k + 1
    return k, n


def climb(matrix: np.ndarray, levels: int) -> list[np.ndarray]:
    """A block's digests (m x HEX bytes) and those of so many levels above them."""
    out = [matrix]
    for _ in range(levels):
        m = out[-1]
        full = len(m) // FANOUT * FANOUT
        parents = [sha256(run).hexdigest() for run in m[:full].reshape(-1, FANOUT * HEX)]
        if full < len(m):
            parents.append(sha256(m[full:].tobytes()).hexdigest())
        out.append(np.frombuffer("".join(parents).encode(), np.uint8).reshape(-1, HEX))
    return out


def siblings(levels: list[np.ndarray], i: int) -> Iterator[tuple[bytes, bytes]]:
    """What comes before and after node i's own digest in its run, then the same for its parents, below the last level."""
    for m in levels[:-1]:
        at = i // FANOUT * FANOUT
        run = m[at : at + FANOUT].reshape(-1)
        yield run[: (i - at) * HEX].tobytes(), run[(i - at + 1) * HEX :].tobytes()
        i //= FANOUT


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer("".join(column.to_pylist()).encode(), np.uint8).reshape(-1, HEX)


def blocks(nodes: DataFrame, carried: list[str]) -> DataFrame:
    """Nodes (sk, at, n, hash, carried columns) in aligned blocks: sk, block, n, hashes (one text), carried columns as lists, top (the block's
    highest digest), left (the source's nodes when all its blocks have climbed)."""
    kinds = dict(nodes.dtypes)

    def block(table: pa.Table) -> pa.Table:
        table = table.sort_by("at")
        m, n = _matrix(table["hash"]), table["n"][0].as_py()
        k, left = heights(n)
        top = climb(m, k)[-1].tobytes().decode()
        made = {"sk": table["sk"][:1], "block": [table["at"][0].as_py() // BLOCK], "n": [n], "hashes": [m.tobytes().decode()], "top": [top[:HEX]], "left": [left]}
        lists = {c: pa.ListArray.from_arrays(pa.array([0, len(table)], pa.int32()), table[c].combine_chunks()) for c in carried}
        return pa.table(made | lists)

    schema = "sk string, block long, n long, hashes string, top string, left long" + "".join(f", `{c}` array<{kinds[c]}>" for c in carried)
    return nodes.groupBy("sk", F.shiftright("at", BLOCK.bit_length() - 1).alias("_block")).applyInArrow(block, schema)


def grown(nodes: DataFrame, carried: list[str]) -> tuple[list[DataFrame], DataFrame]:
    """Tables of blocks from the leaves up, and sk, hash of what each sk comes to."""
    tables, tops = [], []
    while True:
        table = cut(blocks(nodes, [] if tables else carried))
        tables.append(table)
        tops.append(table.where("left = 1").select("sk", F.col("top").alias("hash")))
        above = table.where("left > 1").select("sk", F.col("block").alias("at"), F.col("left").alias("n"), F.col("top").alias("hash"))
        if above.isEmpty():
            break
        nodes = above
    whole = tops[0]
    for t in tops[1:]:
        whole = whole.unionByName(t)
    return tables, whole


def _paths(batch: pa.RecordBatch) -> Iterator[tuple[dict, list[np.ndarray]]]:
    """Each block as values and as digests of all its levels."""
    for row in batch.to_pylist():
        yield row, climb(np.frombuffer(row["hashes"].encode(), np.uint8).reshape(-1, HEX), heights(row["n"])[0])


def handed_down(held: DataFrame, key: Callable[[dict, int], dict], keys: str, subroots: bool) -> DataFrame:
    """Rows for the children of blocks (with the block's own path, root, subroot): what key() gives, of schema keys, and path, root, subroot.
    subroots: the children are subroots themselves."""
    schema = f"{keys}, path {PATH}, root string, subroot string"

    def down(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row, levels in _paths(batch):
                for i in range(len(levels[0])):
                    path = [{"before": b.decode(), "after": a.decode()} for b, a in siblings(levels, i)]
                    own = levels[0][i].tobytes().decode() if subroots else row["subroot"]
                    out.append(key(row, i) | {"path": path + row["path"], "root": row["root"], "subroot": own})
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=arrow)

    arrow = to_arrow_schema(held.sparkSession.createDataFrame([], schema).schema)
    return mapped(held, down, schema)


def descended(tables: list[DataFrame], paths: DataFrame) -> DataFrame:
    """The lowest blocks with the path, root and subroot above each. paths: sk, path, root, subroot for what each sk comes to."""
    paths = paths.withColumn("block", F.lit(0).cast("long"))
    where_left = "left = 1"
    for i in range(len(tables) - 1, -1, -1):
        # a source's highest block gets the source's own path, any other its parent's
        held = tables[i].where(where_left).join(paths, ["sk", "block"])
        if i < len(tables) - 1:
            held = held.unionByName(tables[i].where("left > 1").join(lower, ["sk", "block"]))
        if i:
            lower = handed_down(held, lambda row, k: {"sk": row["sk"], "block": row["block"] * BLOCK + k}, "sk string, block long", False)
    return held


def proofs(held: DataFrame, id_type: str) -> DataFrame:
    """The rows of lowest blocks: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified."""
    schema = f"doc_id {id_type}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"

    def prove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row, levels in _paths(batch):
                above = [(p["before"].encode(), p["after"].encode()) for p in row["path"]]
                rest = b"".join(b + a for b, a in above)
                for i, (doc_id, other) in enumerate(zip(row["doc_id"], row["tampered"], strict=True)):
                    own = levels[0][i].tobytes()
                    node, proof = other.encode() if other is not None else own, sha256()
                    near = list(siblings(levels, i))
                    for before, after in near:
                        proof.update(before + after)
                    proof.update(rest)
                    for before, after in [*near, *above]:
                        node = sha256(before + node + after).hexdigest().encode()
                    folded = node.decode()
                    out.append((doc_id, own.decode(), row["subroot"], row["root"], proof.hexdigest(), folded, folded == row["root"]))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

    arrow = to_arrow_schema(held.sparkSession.createDataFrame([], schema).schema)
    kinds, names = arrow.types, arrow.names
    return mapped(held, prove, schema)


def manifest(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, leaf, subroot, root, proof_sha256 (of all siblings' digests, level by level from the leaf's to below the root, from
    left to right), folded_root (from the tampered or else the own leaf and the siblings) and verified (whether that is the root)."""
    spark = docs.sparkSession
    with scratch(spark) as keep:
        own, tops = grown(ranked(cut(leaves(docs)), "doc_id", "hash", "tie").drop("tie"), ["doc_id", "tampered"])
        sources = ranked(tops.select(F.lit("").alias("sk"), F.col("sk").alias("source"), "hash"), "source")
        over, top = grown(sources, ["source"])
        whole = top.select("sk", F.array().cast(PATH).alias("path"), F.col("hash").alias("root"), F.lit(None).cast("string").alias("subroot"))
        paths = handed_down(descended(over, whole), lambda row, i: {"sk": row["source"][i]}, "sk string", True)
        result = proofs(descended(own, paths), dict(docs.dtypes)["doc_id"])
        return keep(result, *own, *over)


#: Levels that the SQL below unrolls: enough for FANOUT ** 6 documents of a source, and as many sources.
_UNROLLED = 6


def _tree(name: str, first: str) -> str:
    """CTEs {name}0..: nodes (sk, pos, n, h) level by level; {name}g0..: their runs (sk, run, hs, n)."""
    out = [f"{name}0 AS ({first})"]
    for i in range(_UNROLLED):
        out.append(f"{name}g{i} AS (SELECT sk, pos // 16 AS run, list(h ORDER BY pos) AS hs, max(n) AS n FROM {name}{i} GROUP BY 1, 2)")
        out.append(f"{name}{i + 1} AS (SELECT sk, run AS pos, CASE WHEN n = 1 THEN hs[1] ELSE sha256(array_to_string(hs, '')) END AS h, (n + 15) // 16 AS n FROM {name}g{i})")
    return ",\n".join(out)


def _fold(name: str, tree: str, first: str) -> str:
    """CTEs {name}0..: each row's sk, pos, its siblings so far and the folded digest, one level of the tree after the other."""
    out = [f"{name}0 AS ({first})"]
    for i in range(_UNROLLED):
        before, after = "array_to_string(g.hs[1 : x.pos % 16], '')", "array_to_string(g.hs[x.pos % 16 + 2 : len(g.hs)], '')"
        out.append(
            f"{name}{i + 1} AS (SELECT x.id, x.leaf, x.sk, x.pos // 16 AS pos, CASE WHEN g.n = 1 THEN x.proof ELSE x.proof || {before} || {after} END AS proof, "
            f"CASE WHEN g.n = 1 THEN x.folded ELSE sha256({before} || x.folded || {after}) END AS folded FROM {name}{i} x JOIN {tree}g{i} g ON g.sk = x.sk AND g.run = x.pos // 16)"
        )
    return ",\n".join(out)


def _leaf_sql(text: str) -> str:
    return "sha256(" + " || ".join(f"coalesce(strlen(CAST({f} AS VARCHAR)) || ':' || CAST({f} AS VARCHAR), '-')" for f in (*FIELDS[:-1], text)) + ")"


_LOWER = f"translate(text, '{_CAPITALS}', '{_SMALL}')"
#: crc32 of the id's digits, bit by bit.
_CRC = (
    "xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: ascii(c)::BIGINT)), "
    "lambda crc, b: list_reduce(list_prepend(xor(crc, b), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda x, i: xor(x >> 1, (x & 1) * 3988292384))))"
)

ORACLE_SQL = f"""WITH leaves AS (SELECT doc_id AS id, coalesce('=' || source, '') AS sk, {_leaf_sql("text")} AS leaf,
  CASE WHEN {_CRC} % {TAMPER} = 0 THEN {_leaf_sql(_LOWER)} END AS tampered FROM documents),
numbered AS (SELECT *, row_number() OVER (PARTITION BY sk ORDER BY id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY sk) AS n FROM leaves),
{_tree("a", "SELECT sk, pos, n, leaf AS h FROM numbered")},
subroots AS (SELECT sk, h, row_number() OVER (ORDER BY sk) - 1 AS pos, count(*) OVER () AS n FROM a{_UNROLLED}),
{_tree("b", "SELECT '' AS sk, pos, n, h FROM subroots")},
{_fold("p", "a", "SELECT id, leaf, sk, pos, '' AS proof, coalesce(tampered, leaf) AS folded FROM numbered")},
{_fold("q", "b", f"SELECT p.id, p.leaf || s.h AS leaf, '' AS sk, s.pos, p.proof, p.folded FROM p{_UNROLLED} p JOIN subroots s ON s.sk = p.sk")}
SELECT q.id AS doc_id, left(q.leaf, 64) AS leaf, right(q.leaf, 64) AS subroot, r.h AS root, sha256(q.proof) AS proof_sha256, q.folded AS folded_root, q.folded = r.h AS verified
FROM q{_UNROLLED} q CROSS JOIN b{_UNROLLED} r"""

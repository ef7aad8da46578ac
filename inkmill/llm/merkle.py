"""Merkle manifest of a dataset: a root over all rows, and for each row the proof that leads to it.

A row's leaf is a hash of its columns. Leaves of a source stand in the order of their ids; while a source
has several nodes, every FANOUT consecutive ones become one. The tops of the sources, ordered by name,
are the leaves of a last tree of the same kind.

A leaf's place in its source is its exact rank, found without a global sort: a trie of the digits of its
id. Counts of the finest digits add up to those of the coarser ones; a node's offset is its parent's plus the
counts of its lesser siblings, of which there are 2^DIGIT at most. Ids that tie are ranked by the digits of
their leaves in the same way, names of sources by their bytes.

The digits of a rank in base FANOUT are a leaf's way down the tree. Leaves that share all but the last SPAN
digits lie in one task, which folds all their levels; what is left is a table 3^SPAN times smaller, folded
again. Proofs come back the same way, from the top down, one block of siblings a task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkmill.llm.common import only, table, written

FANOUT, SPAN = 3, 6
BLOCK = FANOUT**SPAN
#: Bits of a trie's digit, and of an id's last one: a task ranks the ids of one last digit.
DIGIT, LAST, LEVELS = 14, 8, 4
#: Rows of one id that another task takes; copies of one row that one task lists.
SALT, CHUNK = 64, 4096
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def h(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(*values: Column) -> Column:
    """The hash of the values, each told by its length; null by -."""
    said = [F.when(v.isNull(), "-").otherwise(F.concat(F.octet_length(v.cast("string")).cast("string"), F.lit(":"), v.cast("string"))) for v in values]
    return F.unhex(F.sha2(F.concat(*said), 256))


def _starts(per: DataFrame) -> DataFrame:
    """per(g, base, key, n, ...) with start, the sum of n over lesser keys of the same g and base, and whole, that over all."""
    at = ["g", "base"]
    counts = [written(per.groupBy(*at, F.shiftright("key", LAST).alias("p")).agg(F.sum("n").alias("n")), "digits")]
    for _ in range(LEVELS - 1):
        counts.append(counts[-1].groupBy(*at, F.shiftright("p", DIGIT).alias("p")).agg(F.sum("n").alias("n")))

    def before(by: list[str], key: str) -> Column:
        return F.coalesce(F.sum("n").over(Window.partitionBy(*by).orderBy(key).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))

    node = counts.pop().select(*at, "p", before(at, "p").alias("start"), F.sum("n").over(Window.partitionBy(*at)).alias("whole"))
    while counts:
        parent = node.select(*at, F.col("p").alias("up"), F.col("start").alias("above"), "whole")
        node = counts.pop().withColumn("up", F.shiftright("p", DIGIT)).join(parent, [*at, "up"])
        node = node.select(*at, "p", (F.col("above") + before([*at, "up"], "p")).alias("start"), "whole")
    per = per.withColumn("p", F.shiftright("key", LAST)).join(node.withColumnRenamed("start", "above"), [*at, "p"])
    return per.withColumn("start", F.col("above") + before([*at, "p"], "key")).drop("above", "p")


def ranked(rows: DataFrame, item: list[str], key: Callable[[int], Column | None]) -> DataFrame:
    """(g, rank, n, copies, *item) of rows(g, *item): the rank, from 0, in g by key(0), then key(1) and so on, all bigint; n is the rows of g.

    Rows alike in the whole item are one row with their number as copies; they hold the ranks from rank on.
    Rows that tie in all keys but differ in item must not be: key(j) is None where no more follow, and then an error is raised.
    """
    pending, done, j = rows.select("g", F.lit(0).cast("long").alias("base"), F.lit(None).cast("long").alias("n"), *item), [], 0
    while True:
        by = key(j)
        if by is None:
            raise ValueError("rows tie in all keys")
        keyed = pending.withColumn("key", by)
        x = F.struct(*item)
        per = keyed.groupBy("g", "base", "key").agg(F.count("*").alias("n"), F.max("n").alias("of"), F.min(x).alias("x"), F.max(x).alias("y"))
        per = per.select("g", "base", "key", "n", "of", "x", (F.col("x") != F.col("y")).alias("tie"))
        per = written(_starts(written(per, "keys")), "ranks")
        per = per.withColumn("of", F.coalesce("of", "whole"))
        done.append(per.where("not tie").select("g", (F.col("base") + F.col("start")).alias("rank"), F.col("of").alias("n"), F.col("n").alias("copies"), "x.*"))
        ties = per.where("tie").select("g", "base", "key", (F.col("base") + F.col("start")).alias("next"), "of")
        if not ties.limit(1).count():
            break
        # many rows may share a key: they are dealt out by their content
        ties = ties.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
        salt = F.pmod(F.xxhash64(*item), F.lit(SALT)).cast("int")
        pending = keyed.withColumn("salt", salt).drop("n").join(ties, ["g", "base", "key", "salt"])
        pending = written(pending.select("g", F.col("next").alias("base"), F.col("of").alias("n"), *item), "ties")
        j += 1
    out = done[0]
    for x in done[1:]:
        out = out.unionByName(x)
    return out


def expanded(rows: DataFrame) -> DataFrame:
    """rows(rank, copies, ...) with a row for each copy; long lists of copies are dealt out first."""
    some = rows.where(F.col("copies") <= CHUNK)
    many = rows.where(F.col("copies") > CHUNK).withColumn("last", F.col("rank") + F.col("copies") - 1)
    many = many.withColumn("rank", F.explode(F.expr(f"sequence(rank, last, {CHUNK}L)"))).withColumn("copies", F.least(F.lit(CHUNK), F.col("last") - F.col("rank") + 1)).drop("last")
    both = some.unionByName(many.repartition("g", "rank"))
    return both.withColumn("rank", F.explode(F.expr("sequence(rank, rank + copies - 1)"))).drop("copies")


def levels_of(nodes: list[str], n: int) -> list[list[str]]:
    """The levels of a block whose group has n nodes: nodes first, then their parents, until one is left or the block ends."""
    out = [nodes]
    for _ in range(SPAN):
        if n == 1:
            break
        last, n = out[-1], -(-n // FANOUT)
        out.append([h(*last[a : a + FANOUT]) for a in range(0, len(last), FANOUT)])
    return out


def _ordered(t: pa.Table) -> pa.Table:
    return t.combine_chunks().sort_by("rank")


def _hex(column) -> list[str]:
    return [x.hex() for x in column.to_pylist()]


def _up(t: pa.Table) -> pa.Table:
    t = _ordered(t)
    n = t.column("n")[0].as_py()
    top = levels_of(_hex(t.column("hash")), n)[-1]
    return pa.table({"g": t.column("g").slice(0, 1), "rank": [t.column("rank")[0].as_py() // BLOCK], "n": [-(-n // BLOCK)], "hash": pa.array([bytes.fromhex(top[0])], pa.binary())})


def folded(nodes: DataFrame) -> list[DataFrame]:
    """Tables (g, rank, n, hash, ...): the nodes, then, each from the last, one node for every BLOCK of a group that had several."""
    rounds = [nodes]
    while (more := rounds[-1].where("n > 1")).limit(1).count():
        up = more.select("g", "rank", "n", "hash").groupBy("g", F.expr(f"rank div {BLOCK}").alias("block")).applyInArrow(_up, "g string, rank long, n long, hash binary")
        rounds.append(written(up, "nodes"))
    return rounds


def _step(siblings: list[str], at: int) -> bytes:
    """One level of a proof: how many siblings stand left and right of the node, and their hashes."""
    return bytes([at, len(siblings) - at - 1]) + bytes.fromhex("".join(siblings[:at] + siblings[at + 1 :]))


def steps(proof: bytes) -> Iterator[tuple[str, str]]:
    """The hashes left and right of the node at each level, from the leaf up."""
    k = 0
    while k < len(proof):
        a, b = k + 2 + 32 * proof[k], k + 2 + 32 * (proof[k] + proof[k + 1])
        yield proof[k + 2 : a].hex(), proof[a:b].hex()
        k = b


def _down(extra: list[str]):
    def f(left: pa.Table, right: pa.Table) -> pa.Table:
        """Nodes of one block, and the proof of what they fold to."""
        t = _ordered(left)
        n, first = t.column("n")[0].as_py(), t.column("rank")[0].as_py()
        levels = levels_of(_hex(t.column("hash")), n)[:-1]
        up, proofs = right.column("proof")[0].as_py(), []
        for i in range(t.num_rows):
            own = []
            for nodes in levels:
                a = i - i % FANOUT
                own.append(_step(nodes[a : a + FANOUT], i - a))
                i //= FANOUT
            proofs.append(b"".join(own) + up)
        assert first % BLOCK == 0
        same = {k: pa.array([right.column(k)[0].as_py()] * t.num_rows, pa.binary()) for k in ("subroot", "root")}
        return pa.table({k: t.column(k) for k in ("g", "rank", "n", "hash", *extra)} | {"proof": pa.array(proofs, pa.binary())} | same)

    return f


def proven(rounds: list[DataFrame], tops: DataFrame, extra: list[str], kinds: str) -> DataFrame:
    """The rows of rounds[0] with proof, subroot and root. tops(g, at, proof, subroot, root): of each group's top, which stands in rounds[at]."""
    above = None
    for k in reversed(range(len(rounds))):
        ends = tops.where(F.col("at") == k).select("g", F.lit(0).cast("long").alias("rank"), "proof", "subroot", "root")
        up = ends if above is None else ends.unionByName(above.select("g", "rank", "proof", "subroot", "root"))
        more = extra if k == 0 else []
        nodes = rounds[k].select("g", "rank", "n", "hash", *more).groupBy("g", F.expr(f"rank div {BLOCK}").alias("block"))
        above = nodes.cogroup(up.groupBy("g", F.col("rank").alias("block"))).applyInArrow(_down(more), "g string, rank long, n long, hash binary, " + (kinds if k == 0 else "") + "proof binary, subroot binary, root binary")
        if k:
            above = written(above, "proofs")
    return above


def _chunk(j: int) -> Column:
    """15 hexadecimal digits of a leaf."""
    return F.conv(F.substring(F.hex("leaf"), 1 + 15 * j, 15), 16, 10).cast("long")


def _bytes(j: int) -> Column:
    """Six bytes of a name, and how many of them there are."""
    part = F.substring(F.encode("name", "utf-8"), 1 + 6 * j, 6)
    return F.conv(F.rpad(F.hex(part), 12, "0"), 16, 10).cast("long") * 8 + F.octet_length(part)


def _tops(rounds: list[DataFrame]) -> DataFrame:
    """(g, at, hash): each group's top and the table that it stands in."""
    out = None
    for k, r in enumerate(rounds):
        x = r.where("n = 1").select("g", F.lit(k).alias("at"), "hash")
        out = x if out is None else out.unionByName(x)
    return out


def manifest(docs: DataFrame, *extra: str) -> DataFrame:
    """For each row of docs(doc_id, source, lang, n_chars, text, *extra): doc_id, source, rank, n (leaves of its source), leaf, proof, subroot, root, *extra.

    leaf, subroot and root are binary SHA-256; proof holds the siblings of each level (see steps()). extra are
    binary columns that follow from the five fields, or null. A null field is told apart from an empty one;
    null sources are one source, the first; null ids stand first in their source, where the least bigint does too. Rows that
    share an id stand in the order of their leaves; rows alike in all fields are interchangeable. An empty table gives an empty result.
    """
    item = ["doc_id", "leaf", *extra]
    rows = only(docs, *FIELDS, *extra).select(F.when(F.col("source").isNull(), "").otherwise(F.concat(F.lit("s"), "source")).alias("g"), F.col("doc_id").cast("long").alias("doc_id"), leaf_of(*[F.col(c) for c in FIELDS]).alias("leaf"), *extra)
    first = F.coalesce("doc_id", F.lit(-(1 << 63)))
    rows = written(rows, "leaves")
    leaves = expanded(ranked(rows, item, lambda j: first if j == 0 else _chunk(j - 1) if j < 6 else None))
    leaves = written(leaves.withColumnRenamed("leaf", "hash"), "ranked")
    rounds = folded(leaves)
    tops = written(_tops(rounds), "tops")
    names = ranked(tops.select(F.lit("").alias("g"), F.col("g").alias("name"), F.col("hash"), "at"), ["name", "hash", "at"], _bytes).drop("copies")
    over = folded(written(names, "names"))
    none = F.lit(b"")
    root = _tops(over).select("g", "at", none.alias("proof"), none.alias("subroot"), F.col("hash").alias("root"))
    named = proven(over, root, ["name", "at"], "name string, at int, ")
    ends = written(named.select(F.col("name").alias("g"), "at", "proof", F.col("hash").alias("subroot"), "root"), "ends")
    out = proven(rounds, ends, ["doc_id", *extra], "doc_id long, " + "".join(f"{e} binary, " for e in extra))
    source = F.when(F.col("g") != "", F.substring("g", 2, 1 << 30))
    return out.select("doc_id", source.alias("source"), "rank", "n", F.col("hash").alias("leaf"), "proof", "subroot", "root", *extra)


def fold(leaf: str, proof: bytes) -> str:
    """The root that a leaf leads to by its proof."""
    for left, right in steps(proof):
        leaf = h(left, leaf, right)
    return leaf


def _verified(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in it:
        proofs, root = b.column("proof").to_pylist(), _hex(b.column("root"))
        now = [(x or y).hex() for x, y in zip(b.column("changed").to_pylist(), b.column("leaf").to_pylist(), strict=True)]
        ends = [fold(x, p) for x, p in zip(now, proofs, strict=True)]
        digests = [h("".join(a + c for a, c in steps(p))) for p in proofs]
        hexed = [pa.array(_hex(b.column(k)), pa.string()) for k in ("leaf", "subroot")]
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), *hexed, pa.array(root, pa.string()), pa.array(digests, pa.string()), pa.array(ends, pa.string()), pa.array([x == y for x, y in zip(ends, root, strict=True)], pa.bool_())], names=OUT)


OUT = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


def verified(docs: DataFrame, changed: Column) -> DataFrame:
    """The OUT columns for each row of docs; changed is another leaf, to be folded by the row's proof in place of its own, or null."""
    found = manifest(docs.withColumn("changed", changed), "changed")
    return found.mapInArrow(_verified, "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")


def tampered() -> Column:
    """The leaf of a row whose text has lost its newlines, for the rows that tampering hits: those of an even crc32 of the id. Null ids are not hit."""
    hit = (F.crc32(F.col("doc_id").cast("string")) % 2 == 0) & F.contains("text", F.lit("\n"))
    return F.when(hit, leaf_of(*[F.col(c) for c in FIELDS[:-1]], F.replace("text", F.lit("\n"), F.lit(""))))


def op11_merkle_manifest(spark, sf_dir: str) -> DataFrame:
    return verified(table(spark, sf_dir, "documents"), tampered())


_ENC = "CASE WHEN {x} IS NULL THEN '-' ELSE octet_length(encode({x}::VARCHAR))::VARCHAR || ':' || {x}::VARCHAR END"


def _leaf_sql(text: str) -> str:
    return "sha256(" + " || ".join(_ENC.format(x=x) for x in (*FIELDS[:-1], text)) + ")"


#: crc32 by its table, made from the polynomial.
_CRC = "list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, len(doc_id::VARCHAR) + 1), lambda i: ascii(substr(doc_id::VARCHAR, i, 1))::BIGINT)), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]))"
ORACLE = f"""
WITH RECURSIVE steps(k, v, i) AS (SELECT k, k, 0 FROM (SELECT unnest(range(256))::BIGINT AS k) UNION ALL SELECT k, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END, i + 1 FROM steps WHERE i < 8),
crc AS (SELECT list(v ORDER BY k) AS t FROM steps WHERE i = 8),
d AS (SELECT doc_id, source, {_leaf_sql("text")} AS leaf, CASE WHEN xor({_CRC}, 4294967295) & 1 = 0 THEN {_leaf_sql("replace(text, chr(10), '')")} ELSE {_leaf_sql("text")} END AS changed FROM documents, crc),
leaves AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY source) AS n FROM d),
tree(g, level, i, n, hash) AS (SELECT source, 0, i, n, leaf FROM leaves UNION ALL
  SELECT g, any_value(level) + 1, i // {FANOUT}, any_value((n + {FANOUT - 1}) // {FANOUT}), sha256(string_agg(hash, '' ORDER BY i)) FROM tree WHERE n > 1 GROUP BY g, i // {FANOUT}),
sub AS (SELECT g, level AS depth, hash, row_number() OVER (ORDER BY encode(g) NULLS FIRST) - 1 AS i, count(*) OVER () AS n FROM tree WHERE n = 1),
over(level, i, n, hash) AS (SELECT 0, i, n, hash FROM sub UNION ALL
  SELECT any_value(level) + 1, i // {FANOUT}, any_value((n + {FANOUT - 1}) // {FANOUT}), sha256(string_agg(hash, '' ORDER BY i)) FROM over WHERE n > 1 GROUP BY i // {FANOUT}),
sides AS (SELECT a.g, a.level, a.i, coalesce(string_agg(b.hash, '' ORDER BY b.i) FILTER (b.i < a.i), '') AS l, coalesce(string_agg(b.hash, '' ORDER BY b.i) FILTER (b.i > a.i), '') AS r
  FROM tree a JOIN tree b ON a.g IS NOT DISTINCT FROM b.g AND a.level = b.level AND a.i // {FANOUT} = b.i // {FANOUT} WHERE a.n > 1 GROUP BY ALL),
tops AS (SELECT a.level, a.i, coalesce(string_agg(b.hash, '' ORDER BY b.i) FILTER (b.i < a.i), '') AS l, coalesce(string_agg(b.hash, '' ORDER BY b.i) FILTER (b.i > a.i), '') AS r
  FROM over a JOIN over b ON a.level = b.level AND a.i // {FANOUT} = b.i // {FANOUT} WHERE a.n > 1 GROUP BY ALL),
walk(doc_id, source, i, leaf, hash, proof, level, depth) AS (SELECT v.doc_id, v.source, v.i, v.leaf, v.changed, '', 0, s.depth FROM leaves v JOIN sub s ON v.source IS NOT DISTINCT FROM s.g UNION ALL
  SELECT w.doc_id, w.source, w.i // {FANOUT}, w.leaf, sha256(s.l || w.hash || s.r), w.proof || s.l || s.r, w.level + 1, w.depth FROM walk w JOIN sides s ON w.source IS NOT DISTINCT FROM s.g AND w.level = s.level AND w.i = s.i WHERE w.level < w.depth),
climb(doc_id, leaf, subroot, hash, proof, i, level) AS (SELECT w.doc_id, w.leaf, s.hash, w.hash, w.proof, s.i, 0 FROM walk w JOIN sub s ON w.source IS NOT DISTINCT FROM s.g WHERE w.level = w.depth UNION ALL
  SELECT c.doc_id, c.leaf, c.subroot, sha256(t.l || c.hash || t.r), c.proof || t.l || t.r, c.i // {FANOUT}, c.level + 1 FROM climb c JOIN tops t ON c.level = t.level AND c.i = t.i),
root AS (SELECT hash, level FROM over WHERE n = 1)
SELECT c.doc_id, c.leaf, c.subroot, r.hash AS root, sha256(c.proof) AS proof_sha256, c.hash AS folded_root, c.hash = r.hash AS verified FROM climb c JOIN root r ON c.level = r.level
"""

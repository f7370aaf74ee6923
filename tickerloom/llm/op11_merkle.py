"""Merkle manifest of a dataset, with a proof for every row, by cogrouped subtree exchange.

Rows are leaves of one tree a group (here: a language), in order of their id; the groups' subroots
are the leaves of one more tree, whose root names the dataset. A tree is cut into superblocks of
2**BITS consecutive nodes. Going up, ``applyInPandas`` reduces each superblock to one node, and these
nodes are cut into superblocks again, so no task ever holds a level of a tree. Going down, the nodes
of a superblock are cogrouped with the one row that says what lies outside it: the siblings on the
way from the superblock's node to the root. One ``applyInPandas`` over the cogroup redoes the local
reduction, joins inner and outer siblings to proofs, and folds the leaves that are to be verified.

Places in the order come from a range-partitioned sort and one count a partition, not from a window
over a group. The number of rounds is log(rows) / BITS / log(2); the driver sees two numbers a round.
"""

from __future__ import annotations

from hashlib import sha256

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import crc_bucket, materialise, scratch, table

BITS = 10


def field(c: Column) -> Column:
    """A value so that values put together can be told apart: ``-`` for null, else its length in
    UTF-8 bytes, ``:`` and itself."""
    text = c.cast("string")
    return F.when(c.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_hash(*columns: Column) -> Column:
    return F.sha2(F.concat(*map(field, columns)).cast("binary"), 256)


def numbered(df: DataFrame, order: list[str], label: str) -> DataFrame:
    """Add ``place``: 0, 1, ... in the order of the columns, nulls first. Written.

    Rows are sorted in ranges; of each range only the number of rows is gathered. Rows that are equal
    in all of ``order`` take neighbouring places in any order, and are spread over ranges too.
    """
    own = materialise(df.withColumn("__row", F.monotonically_increasing_id()), f"{label}-rows")
    by = [F.col(c).asc_nulls_first() for c in (*order, "__row")]
    placed = own.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("__at", F.monotonically_increasing_id())
    placed = materialise(placed.drop("__row"), f"{label}-sorted")
    part = F.shiftright("__at", 33)
    sizes = placed.groupBy(part.alias("__part")).agg(F.count(F.lit(1)).alias("n"))
    before = sizes.select("__part", (F.sum("n").over(W.orderBy("__part")) - F.col("n")).alias("__before"))
    joined = placed.withColumn("__part", part).join(before, "__part")
    return joined.withColumn("place", F.col("__before") + F.col("__at") - F.shiftleft("__part", 33)).drop("__part", "__before", "__at")


def digest(*parts: str) -> str:
    return sha256("".join(parts).encode()).hexdigest()


def levels_of(nodes: list[str], n: int, bits: int) -> list[list[str]]:
    """The levels of a superblock's reduction, its own nodes first. ``n``: the nodes of the whole
    level; if they are more than one superblock's, its last node is hashed alone as often as need be."""
    levels = [nodes]
    while len(levels) <= bits if n > 1 << bits else len(levels[-1]) > 1:
        last = levels[-1]
        levels.append([digest(*last[i : i + 2]) for i in range(0, len(last), 2)])
    return levels


def climb(nodes: DataFrame, most: int, bits: int) -> tuple[list[DataFrame], DataFrame]:
    """The levels at which superblocks meet, and the roots (tree, digest) of ``nodes``.

    ``nodes`` has (tree, place, n, digest): n is the number of the tree's nodes, ``most`` the largest n.
    """

    def up(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("place")
        n, at = int(pdf["n"].iloc[0]), int(pdf["place"].iloc[0]) >> bits
        top = levels_of(pdf["digest"].tolist(), n, bits)[-1][0]
        return pd.DataFrame({"tree": pdf["tree"].iloc[:1], "place": [at], "n": [-(-n >> bits)], "digest": [top]})

    levels, roots = [nodes], []
    while True:
        block = F.shiftright("place", bits).alias("block")
        grown = levels[-1].select("tree", block, "place", "n", "digest").groupBy("tree", "block")
        higher = materialise(grown.applyInPandas(up, "tree long, place long, n long, digest string"), "merkle-level")
        roots.append(higher.where("n = 1"))
        most = -(-most >> bits)
        if most <= 1:
            break
        levels.append(higher.where("n > 1"))
    done = roots[0]
    for more in roots[1:]:
        done = done.unionByName(more)
    return levels, done.select("tree", "digest")


OUTER = "steps string, siblings string"


def inner_paths(levels: list[list[str]]) -> tuple[list[str], list[str]]:
    """(steps, siblings) from each of a superblock's nodes to its top. A step is ``l`` or ``r`` for
    a sibling on that side, ``n`` for none; siblings are put together as text."""
    steps, siblings = [""], [""]
    for own in reversed(levels[:-1]):
        sides = ["l" if i & 1 else "r" if i + 1 < len(own) else "n" for i in range(len(own))]
        siblings = [("" if s == "n" else own[i ^ 1]) + siblings[i >> 1] for i, s in enumerate(sides)]
        steps = [s + steps[i >> 1] for i, s in enumerate(sides)]
    return steps, siblings


def fold(leaf: str, steps: str, siblings: str) -> str:
    """The root that a leaf and its siblings give."""
    at = 0
    for s in steps:
        if s == "n":
            leaf = digest(leaf)
        else:
            other, at = siblings[at : at + 64], at + 64
            leaf = digest(other, leaf) if s == "l" else digest(leaf, other)
    return leaf


def descend(levels: list[DataFrame], outer: DataFrame, bits: int, kept: str, folds: bool) -> DataFrame:
    """The paths of the nodes of the lowest level, cogrouped with what lies outside their superblock.

    ``outer`` has (tree, steps, siblings) and the columns ``kept`` for each tree: the path of its
    root. With ``folds``, level 0 also has (doc_id, leaf, changed), and proofs come out.
    """
    names = [x.split()[0] for x in kept.split(", ")]
    above = outer.withColumn("block", F.lit(0).cast("long"))

    def down(nodes: pd.DataFrame, out: pd.DataFrame) -> pd.DataFrame:
        if not len(nodes):
            return pd.DataFrame({c: [] for c in ("tree", "place", "steps", "siblings", *names)})
        nodes, out = nodes.sort_values("place"), out.iloc[0]
        steps, siblings = inner_paths(levels_of(nodes["digest"].tolist(), int(nodes["n"].iloc[0]), bits))
        got = {"steps": [s + out["steps"] for s in steps], "siblings": [s + out["siblings"] for s in siblings]}
        return pd.DataFrame({"tree": nodes["tree"].to_numpy(), "place": nodes["place"].to_numpy(), **got, **{c: out[c] for c in names}})

    def prove(nodes: pd.DataFrame, out: pd.DataFrame) -> pd.DataFrame:
        if not len(nodes):
            return pd.DataFrame({c: [] for c in ("doc_id", "leaf", *names, "proof_sha256", "folded_root")})
        nodes, found = nodes.sort_values("place"), down(nodes, out)
        rows = zip(nodes["changed"].where(nodes["changed"].notna(), nodes["leaf"]), found["steps"], found["siblings"], strict=True)
        folded = [fold(*r) for r in rows]
        proofs = [digest(s) for s in found["siblings"]]
        own = {c: nodes[c].to_numpy() for c in ("doc_id", "leaf")}
        return pd.DataFrame({**own, **{c: out[c].iloc[0] for c in names}, "proof_sha256": proofs, "folded_root": folded})

    for k in range(len(levels) - 1, -1, -1):
        last = folds and k == 0
        nodes = levels[k].withColumn("block", F.shiftright("place", bits))
        outside = above
        if k + 1 < len(levels):  # a tree of fewer levels gets its root's path here
            whole = levels[k].where(F.col("n") <= 1 << bits).select("tree").distinct()
            outside = above.unionByName(outer.join(whole, "tree", "left_semi").withColumn("block", F.lit(0).cast("long")))
        elif k:
            outside = above.join(levels[k].select("tree").distinct(), "tree", "left_semi")
        if len(levels) > 1:  # written, as it comes from the nodes that it meets
            outside = materialise(outside, "merkle-outside")
        schema = f"doc_id long, leaf string, {kept}, proof_sha256 string, folded_root string" if last else f"tree long, place long, {OUTER}, {kept}"
        joined = nodes.groupBy("tree", "block").cogroup(outside.groupBy("tree", "block")).applyInPandas(prove if last else down, schema)
        above = materialise(joined, "merkle-paths", keep=last)
        if not last:
            above = above.withColumnRenamed("place", "block")
    return above


def merkle_proofs(leaves: DataFrame, group: str = "lang", bits: int = BITS) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) for each row of ``leaves``
    (doc_id, ``group``, leaf, changed).

    Leaves stand in the order of doc_id within their group, nulls first, then of leaf; groups in the
    order of their name, null first. The proof is made from the leaves as they are; folded_root
    starts from ``changed`` where it is not null, and verified says whether that gives the root. A
    group of one row has its leaf for a subroot, and one group alone its subroot for the root.
    Repeated rows are leaves each. An empty table gives no rows; other columns play no part.
    """
    with scratch(leaves.sparkSession):
        own = leaves.select(F.col(group).alias("grp"), F.col("doc_id").cast("long").alias("doc_id"), "leaf", "changed")
        own = materialise(numbered(own, ["grp", "doc_id", "leaf"], "leaves"), "leaves")
        groups = own.groupBy("grp").agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("n"))
        groups = materialise(numbered(groups, ["grp"], "groups").withColumnRenamed("place", "tree"), "groups")
        bounds = groups.agg(F.count(F.lit(1)).alias("trees"), F.max("n").alias("n")).first()
        tree = groups.select(F.col("grp").alias("g"), "tree", "first", "n")
        nodes = own.join(tree, F.col("grp").eqNullSafe(F.col("g"))).withColumn("place", F.col("place") - F.col("first"))
        nodes = materialise(nodes.select("tree", "place", "n", F.col("leaf").alias("digest"), "doc_id", "leaf", "changed"), "nodes")
        levels, subroots = climb(nodes, bounds["n"] or 1, bits)
        tops = subroots.select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("place"), F.lit(bounds["trees"]).cast("long").alias("n"), "digest")
        upper, root = climb(tops, bounds["trees"], bits)
        start = root.select("tree", F.lit("").alias("steps"), F.lit("").alias("siblings"), F.col("digest").alias("root"))
        outside = descend(upper, start, bits, "root string", folds=False).select(F.col("block").alias("tree"), "steps", "siblings", "root")
        outside = outside.join(subroots.withColumnRenamed("digest", "subroot"), "tree")
        proofs = descend(levels, materialise(outside, "outside"), bits, "subroot string, root string", folds=True)
    return proofs.withColumn("verified", F.col("folded_root") == F.col("root"))


def manifest(leaves: DataFrame, group: str = "lang", bits: int = BITS) -> DataFrame:
    """(``group``, rows, subroot, root): what is kept to tell later whether, and where, data changed."""
    proofs = merkle_proofs(leaves.withColumn("changed", F.lit(None).cast("string")), group, bits)
    named = leaves.groupBy(group, "leaf").agg(F.count(F.lit(1)).alias("rows"))
    roots = proofs.select("leaf", "subroot", "root").distinct()
    return named.join(roots, "leaf").groupBy(group, "subroot", "root").agg(F.sum("rows").alias("rows")).select(F.col(group), "rows", "subroot", "root")


FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def document_leaves(docs: DataFrame, tampered: Column) -> DataFrame:
    """(doc_id, lang, leaf, changed): ``changed`` is the leaf after n_chars grew by 1, where ``tampered``."""
    columns = [F.col(c) for c in FIELDS]
    changed = [c + 1 if name == "n_chars" else c for name, c in zip(FIELDS, columns, strict=True)]
    return docs.select("doc_id", "lang", leaf_hash(*columns).alias("leaf"), F.when(tampered, leaf_hash(*changed)).alias("changed"))


def op11_merkle_exchange(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaf, proof and verification of every document, a seventh of them tampered with."""
    docs = table(spark, sf_dir, "documents")
    return merkle_proofs(document_leaves(docs, crc_bucket("doc_id", 7) == 0))


def _leaf_sql(n_chars: str) -> str:
    field_sql = lambda c: f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')"
    return f"sha256({' || '.join(field_sql(n_chars if c == 'n_chars' else c) for c in FIELDS)})"


#: The tree level by level; DuckDB has no crc32, so it is folded over the digits.
ORACLE_SQL = f"""
WITH RECURSIVE step(n, k, c) AS (
  SELECT range, 0, range FROM range(256)
  UNION ALL
  SELECT n, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM step WHERE k < 8
), crcs AS (
  SELECT list(c ORDER BY n) AS crc_table FROM step WHERE k = 8
), summed AS (
  SELECT *, xor(list_reduce(list_prepend(4294967295, list_transform(regexp_extract_all(hex(encode(CAST(doc_id AS VARCHAR))), '..'), lambda x: CAST('0x' || x AS BIGINT))),
                            lambda crc, x: xor(crc >> 8, crc_table[(xor(crc, x) & 255) + 1])), 4294967295) AS crc
  FROM documents, crcs
), d AS (
  SELECT doc_id, lang, {_leaf_sql('n_chars')} AS leaf, CASE WHEN crc % 7 = 0 THEN {_leaf_sql('(n_chars + 1)')} END AS changed FROM summed
), leaves AS (
  SELECT *, dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS t, count(*) OVER (PARTITION BY lang) AS n,
         row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx
  FROM d
), nodes(t, level, idx, n, digest) AS (
  SELECT t, 0, idx, n, leaf FROM leaves
  UNION ALL
  SELECT t, level + 1, idx // 2, any_value((n + 1) // 2), sha256(string_agg(digest, '' ORDER BY idx)) FROM nodes WHERE n > 1 GROUP BY t, level, idx // 2
), tops(level, idx, n, digest) AS (
  SELECT 0, t, (SELECT count(DISTINCT t) FROM leaves), digest FROM nodes WHERE n = 1
  UNION ALL
  SELECT level + 1, idx // 2, any_value((n + 1) // 2), sha256(string_agg(digest, '' ORDER BY idx)) FROM tops WHERE n > 1 GROUP BY level, idx // 2
), paths AS (
  SELECT l.t, l.idx, a.level, x.digest, x.idx < a.idx AS before
  FROM leaves l JOIN nodes a ON a.t = l.t AND a.idx = l.idx >> a.level AND a.n > 1
  LEFT JOIN nodes x ON x.t = a.t AND x.level = a.level AND x.idx = xor(a.idx, 1)
  UNION ALL
  SELECT l.t, l.idx, 100 + a.level, x.digest, x.idx < a.idx
  FROM leaves l JOIN tops a ON a.idx = l.t >> a.level AND a.n > 1
  LEFT JOIN tops x ON x.level = a.level AND x.idx = xor(a.idx, 1)
), proofs AS (
  SELECT t, idx, string_agg(digest, '' ORDER BY level) AS siblings,
         list(CASE WHEN digest IS NULL THEN 'n' WHEN before THEN 'l' || digest ELSE 'r' || digest END ORDER BY level) AS steps
  FROM paths GROUP BY t, idx
), folded AS (
  SELECT l.doc_id, l.leaf, s.digest AS subroot, r.digest AS root, sha256(coalesce(siblings, '')) AS proof_sha256,
         list_reduce(list_prepend(coalesce(changed, leaf), coalesce(steps, [])),
                     lambda h, x: sha256(CASE x[1] WHEN 'l' THEN x[2:] || h WHEN 'r' THEN h || x[2:] ELSE h END)) AS folded_root
  FROM leaves l LEFT JOIN proofs p ON p.t = l.t AND p.idx = l.idx
  JOIN nodes s ON s.t = l.t AND s.n = 1 JOIN tops r ON r.n = 1
)
SELECT *, folded_root = root AS verified FROM folded
"""

"""Merkle manifest of a table: a tree of digests for each source, a tree over the sources, and proofs for each row.

Levels are built as rows that know their parent and the digests to their left and right in the run of FAN that the
parent has hashed. A recursive query climbs from the leaves to the root: a row of it stands for one run of leaves,
which have all siblings above in common; it appends these to the proof, and folds each leaf's own digest with them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowlens.llm.common import written
from flowlens.llm.ordered import numbered

#: Nodes that one parent hashes.
FAN = 16
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
COLUMNS = ["doc_id", "source", "lang", "n_chars", "text"]


def digest(*parts: Column) -> Column:
    """SHA-256 of strings, one after the other, as lowercase hexadecimal digits."""
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def framed(value: Column) -> Column:
    """'-' for null, else the number of UTF-8 bytes, ':' and the value."""
    text = value.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaves(docs: DataFrame, tampered: Column | None = None) -> DataFrame:
    """doc_id, tree, leaf, other. tree: '-' for a null source, else '=' and the source; so trees sort as sources do, null first. other: the leaf with A-Z of the text in lower case where `tampered` holds, else the leaf."""
    columns = {c: F.col(c) for c in COLUMNS}
    leaf = digest(*[framed(c) for c in columns.values()])
    low = digest(*[framed(c) for c in (columns | {"text": F.translate("text", UPPER, LOWER)}).values()])
    tree = F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("-"))
    other = leaf if tampered is None else F.when(tampered, low).otherwise(leaf)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), tree.alias("tree"), leaf.alias("leaf"), other.alias("other"))


def _runs(nodes: DataFrame) -> DataFrame:
    """nodes: tree, idx, hash, m (nodes of the level in the tree) and more. Grouped by run: tree, up, m, children (in order; at most FAN)."""
    return nodes.groupBy("tree", F.floor(F.col("idx") / FAN).cast("long").alias("up")).agg(F.first("m").alias("m"), F.sort_array(F.collect_list(F.struct("idx", "hash"))).alias("children"))


def _joined(children: Column) -> Column:
    return F.array_join(F.transform(children, lambda c: c.hash), "")


LINK = "tree, level, idx, up_tree, up_level, up_idx, up_hash, up_root, before, after"


def _links(runs: DataFrame, level: int, top: bool) -> DataFrame:
    """A row for each child of the runs: its parent, and the digests before and after it in its run. top: runs of trees, whose children are the trees' last nodes."""
    one = runs.select("tree", "up", F.ceil(F.col("m") / FAN).alias("parents"), digest(_joined(F.col("children"))).alias("up_hash"), "children", F.posexplode("children").alias("at", "child"))
    sides = {"before": F.slice("children", F.lit(1), F.col("at")), "after": F.slice("children", F.col("at") + 2, F.lit(FAN))}
    child = {"tree": F.col("child.tree"), "level": F.col("child.level"), "idx": F.col("child.idx")} if top else {"tree": F.col("tree"), "level": F.lit(level), "idx": F.col("child.idx")}
    return one.select(*[c.alias(n) for n, c in child.items()], F.col("tree").alias("up_tree"), F.lit(level + 1).alias("up_level"), F.col("up").alias("up_idx"), "up_hash", (F.col("parents") == 1).alias("last"), *[_joined(c).alias(n) for n, c in sides.items()])


def manifest(leaf_rows: DataFrame) -> DataFrame:
    """Proofs for rows doc_id, tree, leaf, other (see leaves()): doc_id, leaf, subroot, root, proof_sha256, folded_root.

    In each tree leaves ascend by doc_id (null first; ties by leaf and other). While a level has several nodes, every
    FAN of them become one; so do the trees' last nodes, ordered by tree. proof_sha256 is the digest of a leaf's
    siblings, level by level; folded_root is what `other` gives with them. Levels are tables in the shared folder.
    """
    spark = leaf_rows.sparkSession
    placed = numbered(leaf_rows, "tree", ["doc_id", "leaf", "other"], ["doc_id", "leaf", "other"], "pos")
    trees = written(placed.groupBy("tree").agg(F.max("pos").alias("n")).withColumn("n", F.col("n") + 1), "trees")
    most, sources = trees.agg(F.max("n").alias("n"), F.count("*").alias("m")).first()
    schema = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string"
    if not sources:
        return spark.createDataFrame([], schema)
    run = placed.groupBy("tree", F.floor(F.col("pos") / FAN).cast("long").alias("idx")).agg(F.sort_array(F.collect_list(F.struct("pos", "doc_id", "leaf", "other"))).alias("own"))
    run = run.join(trees, "tree").withColumn("m", F.ceil(F.col("n") / FAN).cast("long"))  # the trees' sizes: Spark broadcasts them if they are few, and splits hot trees else
    hashes = F.transform("own", lambda x: x.leaf)
    lone = F.col("n") == 1
    side = lambda i: (F.array_join(F.slice(hashes, F.lit(1), i), ""), F.array_join(F.slice(hashes, i + 2, F.lit(FAN)), ""))
    run = run.withColumns({
        "hash": F.when(lone, hashes[0]).otherwise(digest(F.array_join(hashes, ""))),
        "siblings": F.transform("own", lambda x, i: F.concat(*side(i))),
        "folded": F.transform("own", lambda x, i: F.when(lone, x.other).otherwise(digest(side(i)[0], x.other, side(i)[1]))),
    })
    run = written(run, "runs")
    # Levels of all trees at once, then those of the tree of trees.
    links, level, cur, tops = [], 1, run.select("tree", "idx", "hash", "m"), []
    width = -(-most // FAN)
    while True:
        tops.append(cur.where("m = 1").select("tree", F.lit(level).alias("level"), F.col("idx"), "hash"))
        if width == 1:
            break
        runs = written(_runs(cur.where("m > 1")), "level")
        links.append(_links(runs, level, False).withColumn("up_root", F.col("last") & F.lit(sources == 1)))
        cur = runs.select("tree", F.col("up").alias("idx"), digest(_joined(F.col("children"))).alias("hash"), F.ceil(F.col("m") / FAN).cast("long").alias("m"))
        level, width = level + 1, -(-width // FAN)
    if sources > 1:
        ends = tops[0]
        for t in tops[1:]:
            ends = ends.unionByName(t)
        order = numbered(ends.withColumn("all", F.lit("")), "all", ["tree"], ["tree", "level", "idx", "hash"], "pos")
        width, level = sources, 0
        runs = written(order.groupBy(F.floor(F.col("pos") / FAN).cast("long").alias("up")).agg(F.sort_array(F.collect_list(F.struct("pos", "hash", "tree", "level", "idx"))).alias("children")).withColumns({"m": F.lit(width).cast("long"), "tree": F.lit("")}), "level")
        while True:
            links.append(_links(runs, level, level == 0).withColumn("up_root", F.col("last")))
            cur = runs.select("tree", F.col("up").alias("idx"), digest(_joined(F.col("children"))).alias("hash"), F.ceil(F.col("m") / FAN).cast("long").alias("m"))
            level, width = level + 1, -(-width // FAN)
            if width == 1:
                break
            runs = written(_runs(cur), "level")
    nodes = None
    for t in links:
        t = t.select(*LINK.split(", "))
        nodes = t if nodes is None else nodes.unionByName(t)
    if nodes is None:  # one tree of one run
        climbed = run.select("tree", "idx", F.lit("").alias("proof"), "folded", F.col("hash").alias("subroot"), F.col("hash").alias("root"))
    else:
        climbed = climb(run.select("tree", "idx", "hash", "folded"), written(nodes, "nodes"))
    own = climbed.join(run.select("tree", "idx", "own", "siblings"), ["tree", "idx"])
    one = own.select("proof", "folded", "subroot", "root", "siblings", F.posexplode("own").alias("at", "x"))
    return one.select(F.col("x.doc_id").alias("doc_id"), F.col("x.leaf").alias("leaf"), "subroot", "root", digest(F.get("siblings", "at"), F.col("proof")).alias("proof_sha256"), F.get("folded", "at").alias("folded_root"))


#: Each step goes to the parent: its siblings join the proof, and each leaf's digest is hashed between them.
CLIMB = """
WITH RECURSIVE climb AS (
  SELECT tree, idx, tree AS at_tree, 1 AS at_level, idx AS at_idx, hash, '' AS proof, folded, CAST(NULL AS STRING) AS subroot, false AS root FROM {runs}
  UNION ALL
  SELECT c.tree, c.idx, n.up_tree, n.up_level, n.up_idx, n.up_hash, concat(c.proof, n.before, n.after), transform(c.folded, x -> sha2(concat(n.before, x, n.after), 256)),
    CASE WHEN n.up_tree = '' AND n.tree <> '' THEN c.hash ELSE c.subroot END, n.up_root
  FROM climb c JOIN {nodes} n ON c.at_tree = n.tree AND c.at_level = n.level AND c.at_idx = n.idx
)
SELECT tree, idx, proof, folded, coalesce(subroot, hash) AS subroot, hash AS root FROM climb WHERE root
"""


def climb(runs: DataFrame, nodes: DataFrame) -> DataFrame:
    """From each run of leaves (tree, idx, hash, folded) to the root by the links in `nodes`: tree, idx, proof, folded, subroot, root.

    Spark bounds recursive queries to a million rows unless it is told otherwise: it is, while the result is written.
    The steps are as many as the levels.
    """
    spark, limit = runs.sparkSession, "spark.sql.cteRecursionRowLimit"
    before = spark.conf.get(limit)
    spark.conf.set(limit, "-1")
    try:
        return written(spark.sql(CLIMB, runs=runs, nodes=nodes), "climbed")
    finally:
        spark.conf.set(limit, before)


def merkle_manifest(docs: DataFrame) -> DataFrame:
    """A row for each row of docs (doc_id, source, lang, n_chars, text): doc_id, leaf, subroot, root, proof_sha256, folded_root, verified.

    The leaf is the digest of the five fields (see framed()). Where 5 divides the CRC-32 of doc_id as text the proof is
    tried with the text's A-Z in lower case instead: `verified` tells whether the folded root is the root. Nulls in any
    column have their own mark; a null doc_id sorts first and is never tampered with. Repeated rows are leaves of their
    own, and rows of one doc_id come in order of their digests. Texts of any length are hashed whole. Other columns are
    not read. An empty table gives no row, a table of one row its leaf as the root.
    """
    tampered = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    return manifest(leaves(docs.select(COLUMNS), tampered)).withColumn("verified", F.col("folded_root") == F.col("root"))


def _framed_sql(c: str) -> str:
    return f"coalesce(octet_length(encode(CAST({c} AS VARCHAR))) || ':' || CAST({c} AS VARCHAR), '-')"


def op12_sql(crc32: str) -> str:
    """The same by recursive queries: levels, then a climb for each leaf. crc32: SQL with {0} for the number."""
    fields = [_framed_sql(c) for c in COLUMNS]
    low = [*fields[:-1], _framed_sql(f"translate(text, '{UPPER}', '{LOWER}')")]
    sides = "coalesce(string_agg(h, '') OVER (PARTITION BY t, l, i // 16 ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS b, coalesce(string_agg(h, '') OVER (PARTITION BY t, l, i // 16 ORDER BY i ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS a"
    return f"""
WITH RECURSIVE f AS (SELECT doc_id, coalesce('=' || source, '-') AS t, sha256({" || ".join(fields)}) AS leaf, CASE WHEN {crc32.format("doc_id")} % 5 = 0 THEN sha256({" || ".join(low)}) ELSE sha256({" || ".join(fields)}) END AS other FROM documents),
p AS (SELECT *, row_number() OVER (PARTITION BY t ORDER BY doc_id NULLS FIRST, leaf, other) - 1 AS i, count(*) OVER (PARTITION BY t) AS m FROM f),
n AS (SELECT t, 0 AS l, i, leaf AS h, m FROM p UNION ALL SELECT t, l + 1, i // 16, sha256(string_agg(h, '' ORDER BY i)), CAST((any_value(m) + 15) // 16 AS BIGINT) FROM n WHERE m > 1 GROUP BY t, l, i // 16),
s AS (SELECT t AS st, l AS sl, h, row_number() OVER (ORDER BY t) - 1 AS i, count(*) OVER () AS m FROM n WHERE m = 1),
u AS (SELECT '' AS t, 0 AS l, i, h, m FROM s UNION ALL SELECT t, l + 1, i // 16, sha256(string_agg(h, '' ORDER BY i)), CAST((any_value(m) + 15) // 16 AS BIGINT) FROM u WHERE m > 1 GROUP BY t, l, i // 16),
x AS (SELECT t, l, i, m, {sides} FROM (SELECT * FROM n UNION ALL SELECT * FROM u)),
k AS (SELECT t, l, i, t AS pt, l + 1 AS pl, i // 16 AS pi, b, a FROM x WHERE m > 1 AND NOT (t = '' AND l = 0)
 UNION ALL SELECT s.st, s.sl, 0, '', 1, x.i // 16, x.b, x.a FROM s JOIN x ON x.t = '' AND x.l = 0 AND x.i = s.i WHERE x.m > 1),
c AS (SELECT doc_id, leaf, other, t AS own, i AS place, t, 0 AS l, i, other AS folded, '' AS proof FROM p
 UNION ALL SELECT doc_id, leaf, other, own, place, pt, pl, pi, sha256(b || folded || a), proof || b || a FROM c JOIN k USING (t, l, i)),
d AS (SELECT c.* FROM c ANTI JOIN k USING (t, l, i)),
r AS (SELECT h AS root FROM u WHERE m = 1)
SELECT doc_id, leaf, s.h AS subroot, root, sha256(proof) AS proof_sha256, folded AS folded_root, folded = root AS verified FROM d JOIN s ON s.st = d.own, r
"""

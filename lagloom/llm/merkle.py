"""Merkle manifest of a dataset, built by superblocks.

Rows are numbered in order within their group; rows whose numbers agree after
division by fanout^levels form a bucket, and one ``applyInPandas`` call turns a
bucket into the nodes of its lower ``levels`` levels and one root. The bucket
roots are a smaller table of nodes of the same form (about 1/512 for 8 and 3),
reduced again in the same way until each group has one root, and the groups'
roots are reduced likewise to the root of the whole. A row's proof is the proof
inside its bucket followed by its bucket's own proof one reduction higher.

Ranks are found by a range sort, numbers inside each range and the ranges'
counts, so a group may hold any share of the rows; a bucket never holds more
than fanout^levels. Each bucket is stored as one row (its nodes, not its rows'
proofs): proofs are made from it when the result is read.

Digests are lowercase hex sha256; a node's digest is that of its children's
digests one after another, as text.

Defined results
* a group is a value of the group column; null is a group of its own, before
  all others; groups are ordered by their UTF-8 bytes.
* rows are ordered by the given column (null first), ties by digest; rows equal
  in both are interchangeable: each has its own place and proof.
* a group of one row has that row's digest as its root; if there is but one
  group, its root is the root of all; a proof can be empty.
* an empty table gives an empty result.
* columns that are not named are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, partitions, stored

FANOUT, LEVELS = 8, 3
#: The columns of a document's digest, in order.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def row_digest(*values: Column) -> Column:
    """sha256 over the values, each as its UTF-8 byte count, a colon and the
    value; null as a dash."""
    told = [F.coalesce(F.concat(F.octet_length(v.cast("string")).cast("string"), F.lit(":"), v.cast("string")), F.lit("-")) for v in values]
    return F.sha2(F.concat(*told), 256)


def _height(rows: int, fanout: int) -> int:
    n = 0
    while rows > 1:
        rows, n = -(-rows // fanout), n + 1
    return n


def _numbered(rows: DataFrame) -> DataFrame:
    """rows (key, place, node, kept) with idx, from 0 within key, and total, the
    key's rows."""
    spark, order = rows.sparkSession, ["key", "place", "node", "_tie"]
    dealt = stored(
        rows.withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order)
        .select("key", "node", "kept", F.monotonically_increasing_id().alias("_seq")),
        "merkle-order",
    )
    part = F.shiftright("_seq", 33)
    by_key = Window.partitionBy("key")
    before = F.sum("n").over(by_key.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    # A row for each key and range it touches; stored, so that Spark knows its
    # size when it chooses how to join it.
    ranges = stored(
        dealt.groupBy("key", part.alias("_part")).agg(F.min("_seq").alias("first"), F.count(F.lit(1)).alias("n"))
        .select("key", "_part", (F.coalesce(before, F.lit(0)) - F.col("first")).alias("shift"), F.sum("n").over(by_key).alias("total")),
        "merkle-ranges",
    )
    return dealt.withColumn("_part", part).join(ranges, ["key", "_part"]).select("key", (F.col("_seq") + F.col("shift")).alias("idx"), "total", "node", "kept")


def _buckets(nodes: DataFrame, fanout: int, levels: int) -> DataFrame:
    """One row for each bucket: its root, the nodes of each level below the
    root, and the kept columns of its first level."""
    size = fanout**levels
    kept = nodes.schema["kept"].dataType.simpleString()

    def collapse(bucket: pd.DataFrame) -> pd.DataFrame:
        bucket = bucket.sort_values("idx", kind="stable")
        total = int(bucket["total"].iloc[0])
        nodes, below = bucket["node"].tolist(), []
        for _ in range(min(levels, _height(total, fanout))):
            below.append(nodes)
            nodes = [hashlib.sha256("".join(nodes[i : i + fanout]).encode()).hexdigest() for i in range(0, len(nodes), fanout)]
        row = (bucket["key"].iloc[0], int(bucket["bucket"].iloc[0]), -(-total // size), nodes[0], below, bucket["kept"].tolist())
        return pd.DataFrame([row], columns=["key", "bucket", "above", "node", "below", "kept"])

    grouped = nodes.withColumn("bucket", F.expr(f"idx div {size}")).groupBy("key", "bucket")
    return grouped.applyInPandas(collapse, f"key string, bucket long, above long, node string, below array<array<string>>, kept array<{kept}>")


def _siblings(below: Column, place: Column, fanout: int, levels: int) -> Column:
    """For each level of a bucket the digests left and right of the node above
    the given place, within its run."""
    widths = F.array(*(F.lit(fanout**k) for k in range(levels)))

    def at(nodes, k):
        node = F.floor(place / widths[k]).cast("int")
        left = (node % fanout).cast("int")
        first = node - left + 1
        return F.struct(F.array_join(F.slice(nodes, first, left), "").alias("left"), F.array_join(F.slice(nodes, node + 2, fanout - 1 - left), "").alias("right"))

    return F.transform(below, at)


def _proved(nodes: DataFrame, reductions: int, fanout: int, levels: int) -> DataFrame:
    """key, kept, proof and top (the key's root) of each node."""
    buckets = stored(_buckets(nodes, fanout, levels), "merkle-buckets")
    rows = F.transform("kept", lambda kept, k: F.struct(kept.alias("kept"), _siblings(F.col("below"), k, fanout, levels).alias("lower")))
    if reductions <= 1:
        return buckets.select("key", F.col("node").alias("top"), F.explode(rows).alias("row")).select("key", "row.kept", F.col("row.lower").alias("proof"), "top")
    roots = buckets.select("key", F.col("bucket").alias("idx"), F.col("above").alias("total"), "node", F.struct("bucket").alias("kept"))
    above = _proved(roots, reductions - 1, fanout, levels).select("key", "kept.bucket", F.col("proof").alias("upper"), "top")
    joined = buckets.join(above, ["key", "bucket"]).select("key", "top", "upper", F.explode(rows).alias("row"))
    return joined.select("key", "row.kept", F.concat("row.lower", "upper").alias("proof"), "top")


def _reduced(rows: DataFrame, fanout: int, levels: int) -> DataFrame:
    nodes = _numbered(rows)
    most = nodes.agg(F.max("total")).first()[0] or 1
    return _proved(nodes, max(1, -(-_height(most, fanout) // levels)), fanout, levels)


def manifest(rows: DataFrame, group: str = "lang", order: str = "doc_id", leaf: str = "leaf", keep: tuple = ("doc_id",), fanout: int = FANOUT, levels: int = LEVELS) -> DataFrame:
    """leaf, subroot, root and proof (for each level up to the root the digests
    left and right) of every row, with the columns ``keep`` in ``kept``."""
    key = F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit(""))  # null before all
    leaves = rows.select(key.alias("key"), F.col(order).alias("place"), F.col(leaf).alias("node"), F.struct(*keep, F.col(leaf).alias("_leaf")).alias("kept"))
    lower = _reduced(leaves, fanout, levels)
    tops = lower.groupBy("key").agg(F.first("top").alias("node"))
    groups = tops.select(F.lit("").alias("key"), F.col("key").alias("place"), "node", F.struct(F.col("key").alias("group"), F.col("node").alias("subroot")).alias("kept"))
    upper = stored(_reduced(groups, fanout, levels).select("kept.group", F.col("proof").alias("upper"), F.col("top").alias("root")), "merkle-groups")
    joined = lower.join(upper, F.col("key") == F.col("group"))
    return joined.select("kept", F.col("kept._leaf").alias("leaf"), F.col("top").alias("subroot"), "root", F.concat("proof", "upper").alias("proof"))


def folded(leaf: Column, proof: Column) -> Column:
    """The root that a digest and a proof lead to."""
    return F.aggregate(proof, leaf, lambda node, s: F.sha2(F.concat(s["left"], node, s["right"]), 256))


def op13_superblock_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    upper = "".join(map(chr, range(65, 91)))
    columns = [F.col(c) for c in FIELDS]
    tampered = row_digest(*columns[:-1], F.translate("text", upper, upper.lower()))
    chosen = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    leaves = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "lang", row_digest(*columns).alias("leaf"), F.when(chosen, tampered).alias("tampered"))
    proved = manifest(leaves, keep=("doc_id", "tampered"))
    rows = proved.select(
        F.col("kept.doc_id").alias("doc_id"), "leaf", "subroot", "root",
        F.sha2(F.array_join(F.transform("proof", lambda s: F.concat(s["left"], s["right"])), ""), 256).alias("proof_sha256"),
        folded(F.coalesce("kept.tampered", "leaf"), F.col("proof")).alias("folded_root"),
    )
    return rows.withColumn("verified", F.col("folded_root") == F.col("root"))


def _part(value: str) -> str:
    return f"coalesce(CAST(strlen(CAST({value} AS VARCHAR)) AS VARCHAR) || ':' || CAST({value} AS VARCHAR), '-')"


def _tree(name: str, start: str) -> str:
    """Nodes of every level, from (grp, idx, node, n) on."""
    return f"""
{name}(grp, level, idx, node, n) AS (
  SELECT grp, 0, idx, node, n FROM {start}
  UNION ALL
  SELECT grp, level + 1, idx // 8, sha256(string_agg(node, '' ORDER BY idx)), (n + 7) // 8 FROM {name} WHERE n > 1 GROUP BY grp, level, idx // 8, n
),
{name}_sides AS (
  SELECT grp, level, idx,
         coalesce(string_agg(node, '') OVER (run ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l,
         coalesce(string_agg(node, '') OVER (run ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r
  FROM {name} WHERE n > 1 WINDOW run AS (PARTITION BY grp, level, idx // 8 ORDER BY idx)
)"""


_CRC32 = """xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length(s) + 1), lambda i: ascii(substr(s, i, 1))::BIGINT)),
  lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda x, k: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)), 4294967295::BIGINT)"""

OP13_SQL = f"""
WITH RECURSIVE
leaves AS (
  SELECT doc_id, coalesce('=' || lang, '') AS grp, sha256(concat({', '.join(_part(c) for c in FIELDS)})) AS leaf,
         sha256(concat({', '.join(_part(c) for c in FIELDS[:-1])}, {_part("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")})) AS other,
         (SELECT {_CRC32} FROM (SELECT CAST(doc_id AS VARCHAR) AS s)) % 3 = 0 AS chosen
  FROM documents
),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY grp ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx, count(*) OVER (PARTITION BY grp) AS n FROM leaves
),
start AS (SELECT grp, idx, leaf AS node, n FROM placed),
{_tree("low", "start")},
subs AS (SELECT grp AS g, node AS subroot, row_number() OVER (ORDER BY grp) - 1 AS gi, count(*) OVER () AS m FROM low WHERE n = 1),
top_start AS (SELECT '' AS grp, gi AS idx, subroot AS node, m AS n FROM subs),
{_tree("high", "top_start")},
sides AS (
  SELECT p.doc_id, p.grp, p.idx, s.level, s.l, s.r FROM placed p JOIN low_sides s ON s.grp = p.grp AND s.idx = p.idx // CAST(power(8, s.level) AS BIGINT)
  UNION ALL
  SELECT p.doc_id, p.grp, p.idx, 100 + s.level, s.l, s.r
  FROM placed p JOIN subs u ON u.g = p.grp JOIN high_sides s ON s.idx = u.gi // CAST(power(8, s.level) AS BIGINT)
),
proofs AS (SELECT grp, idx, string_agg(l || r, '' ORDER BY level) AS proof, list(l || '|' || r ORDER BY level) AS steps FROM sides GROUP BY grp, idx),
done AS (
  SELECT p.doc_id, p.leaf, u.subroot, (SELECT node FROM high WHERE n = 1) AS root, sha256(coalesce(q.proof, '')) AS proof_sha256,
         list_reduce(list_prepend(CASE WHEN chosen THEN other ELSE leaf END, coalesce(q.steps, CAST([] AS VARCHAR[]))),
                     lambda a, s: sha256(split_part(s, '|', 1) || a || split_part(s, '|', 2))) AS folded_root
  FROM placed p JOIN subs u ON u.g = p.grp LEFT JOIN proofs q ON q.grp = p.grp AND q.idx = p.idx
)
SELECT *, folded_root = root AS verified FROM done
"""

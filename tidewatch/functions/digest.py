"""Digests of rows, documents and whole tables."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.session import stage_table

#: rows that a leaf of a digest tree holds on average, at most
LEAF_ROWS = 1024
MOST_LEVELS = 6


def json_digest(cols: Sequence[str]) -> Column:
    """SHA-256 of the row as JSON with sorted keys; nulls stay in the document."""
    doc = F.to_json(F.struct(*sorted(cols)), {"ignoreNullFields": "false"})
    return F.sha2(doc, 256)


def row_text(cols: Sequence[str | Column]) -> Column:
    """Fields as text, each with its length in front, so no two rows share a text."""
    parts = []
    for c in cols:
        s = (F.col(c) if isinstance(c, str) else c).cast("string")
        parts.append(F.coalesce(F.concat(F.length(s).cast("string"), F.lit(":"), s), F.lit("-")))
    return F.concat_ws("|", *parts)


def short_id(prefix: str, digests: Sequence[Column]) -> Column:
    return F.concat(F.lit(prefix), F.substring(F.sha2(F.concat_ws("|", *digests), 256), 1, 16))


def tree_levels(n: Column) -> Column:
    """Levels of nodes above the leaves of a table of ``n`` rows: its leaves hold ``LEAF_ROWS`` rows or fewer on average."""
    out = F.lit(0)
    for level in range(MOST_LEVELS):
        out = F.when(n > LEAF_ROWS * 256**level, level + 1).otherwise(out)
    return out


def _node(kind: str, parts: Column, text: Callable[[Column], Column] = lambda p: p) -> Column:
    """Digest of a node: its parts in order, as text, and whether it is a leaf."""
    ordered = F.transform(F.sort_array(F.collect_list(parts)), text)
    return F.sha2(F.concat(F.lit(f"{kind}|"), F.array_join(ordered, ",")), 256)


def _tree(df: DataFrame, cols: Sequence[str], keys: Sequence[str], stage: bool) -> list[DataFrame]:
    """Levels of a tree (``_key, node, n_rows, sha``) from the longest names to the root's; leaves are staged if all are wanted."""
    key = F.struct(*(list(keys) or [F.lit(0).alias("none")])).alias("_key")
    # 32 bytes a row are shuffled, not their 64 hex digits, which are in the same order
    rows = df.select(key, F.unhex(F.sha2(row_text(cols), 256)).alias("sha"))
    rows = rows.groupBy("_key", "sha").agg(F.count(F.lit(1)).alias("c"))
    if keys:
        sizes = df.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).select("_key", tree_levels(F.col("_n")).alias("_levels"))
        most = sizes.agg(F.max("_levels")).first()[0] or 0
        rows = rows.join(sizes, "_key")
    else:
        n = df.count()
        most = next(level for level in range(MOST_LEVELS + 1) if n <= LEAF_ROWS * 256**level or level == MOST_LEVELS)
        rows = rows.withColumn("_levels", F.lit(most))
    leaf = F.lower(F.hex(F.substring("sha", F.lit(1), F.col("_levels"))))
    part = lambda p: F.concat(F.lower(F.hex(p["sha"])), F.lit(":"), p["c"].cast("string"))
    whole = _node("leaf", F.struct("sha", "c"), part)
    leaves = rows.groupBy("_key", leaf.alias("node")).agg(F.sum("c").alias("n_rows"), whole.alias("sha"))
    leaves = stage_table(leaves, "digest-leaves") if stage or keys else leaves
    # keys with smaller trees join at the level of their leaves
    own = lambda level: leaves.where(F.length("node") == 2 * level) if keys else leaves
    out = [own(most)]
    for level in range(most, 0, -1):
        above = F.substring("node", 1, 2 * (level - 1)).alias("node")
        part = F.concat("node", F.lit(":"), "sha")
        up = out[-1].groupBy("_key", above).agg(F.sum("n_rows").alias("n_rows"), _node("node", part).alias("sha"))
        out.append(up.unionByName(own(level - 1)) if keys else up)
    return out


def digest_tree(df: DataFrame, cols: Sequence[str] | None = None, keys: Sequence[str] = ()) -> DataFrame:
    """``keys, node, n_rows, sha``: a Merkle tree over the rows of each key (or of the table).

    Rows are told by the SHA-256 of their fields.  Equal rows are counted, which combines before the
    shuffle, and a leaf is the digest of the sorted row digests that begin alike, with their counts.  A
    node is the digest of up to 256 nodes below it, named by the hex digits that its rows' digests
    begin with; the root is named by none.  Row digests are spread evenly, so a leaf holds a bounded
    number of different rows however the table is keyed, ordered or partitioned, and a tree depends on
    nothing but the rows of its key.  Two tables of one root hold the same rows, or someone has found
    two texts of one SHA-256.
    """
    cols = [c for c in (cols or df.columns) if c in df.columns and c not in keys]
    levels = _tree(df, cols, keys, stage=True)
    every = levels[0]
    for level in levels[1:]:
        every = every.unionByName(level)
    return every.select(*[F.col("_key").getField(c).alias(c) for c in keys], "node", "n_rows", "sha")


def changed_leaves(before: DataFrame, now: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """``keys, node, rows_before, rows_now`` of the leaves in which two trees differ.

    Where one table has outgrown the leaves of the other, nodes of the smaller tree's leaves are compared.
    """
    key = F.struct(*(list(keys) or [F.lit(0).alias("none")])).alias("_key")
    a, b = (t.select(key, "node", "n_rows", "sha") for t in (before, now))
    size = lambda t, name: t.groupBy("_key").agg(F.max(F.length("node")).alias(name))
    both = size(a, "a").join(size(b, "b"), "_key", "full")
    depth = both.select("_key", F.least("a", "b").alias("_depth"))
    at = lambda t, name: t.join(depth, "_key").where(F.length("node") == F.col("_depth")).select(
        "_key", "node", F.col("n_rows").alias(f"rows_{name}"), F.col("sha").alias(f"_{name}")
    )
    met = at(a, "before").join(at(b, "now"), ["_key", "node"], "full").where(~F.col("_before").eqNullSafe(F.col("_now")))
    names = [F.col("_key").getField(c).alias(c) for c in keys]
    counts = [F.coalesce(c, F.lit(0)).alias(c) for c in ("rows_before", "rows_now")]
    return met.select(*names, "node", *counts)


def changed_rows(before: DataFrame, now: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Rows of one table only, with ``side`` (before, now) and how often they are there more.

    Only rows of leaves that differ are compared.
    """
    cols = list(cols or before.columns)
    leaves = changed_leaves(digest_tree(before, cols), digest_tree(now, cols)).select("node")
    depth = leaves.agg(F.max(F.length("node"))).first()[0]
    if depth is None:
        return before.limit(0).select(*cols, F.lit("before").alias("side"), F.lit(0).cast("long").alias("times"))
    marked = lambda t, side: t.select(*cols, F.lit(side).alias("_s"))
    rows = marked(before, 1).unionByName(marked(now, -1))
    rows = rows.withColumn("node", F.substring(F.sha2(row_text(cols), 256), 1, depth)).join(leaves, "node", "left_semi")
    surplus = rows.groupBy(*cols).agg(F.sum("_s").alias("_s")).where("_s <> 0")
    side = F.when(F.col("_s") > 0, "before").otherwise("now")
    return surplus.select(*cols, side.alias("side"), F.abs("_s").alias("times"))


def table_digest(
    df: DataFrame, cols: Sequence[str] | None = None, keys: Sequence[str] = (), out: str = "table_sha"
) -> DataFrame:
    """One digest per key (or table): contents, row count, columns and types."""
    keys = list(keys)
    cols = [c for c in (cols or df.columns) if c in df.columns and c not in keys]
    types = json.dumps([[c, df.schema[c].dataType.simpleString()] for c in cols], separators=(",", ":"))
    root = _tree(df, cols, keys, stage=False)[-1]
    root = root.select(*[F.col("_key").getField(c).alias(c) for c in keys], "n_rows", "sha")
    if not keys:
        none = hashlib.sha256(b"leaf|").hexdigest()
        root = root.agg(F.coalesce(F.max("n_rows"), F.lit(0)).alias("n_rows"), F.coalesce(F.max("sha"), F.lit(none)).alias("sha"))
    whole = F.concat_ws("|", F.col("n_rows").cast("string"), "sha", F.lit(types))
    return root.select(*keys, "n_rows", F.sha2(whole, 256).alias(out))

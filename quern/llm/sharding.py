"""Sharding by extendible hashing.

A directory is indexed by leading bits of each document's hash. It begins as one bucket; a bucket over
the byte limit splits on its next bit, other buckets stay as they are, until every shard fits.
Bytes are summed once for each cell of a fine grid of hash prefixes, far fewer rows than documents, and
all splitting works on these sums. The texts themselves are never shuffled.

Defined cases: a null text has 0 bytes; a null ``doc_id`` hashes as the word ``null``; rows with one ``doc_id`` share a
hash and so a shard; a bucket that still exceeds the limit at ``MAX_BITS`` bits (one huge document, or
one repeated id) stays whole with ``over_limit`` true. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, table

MAX_BITS = 32
LIMIT = 32 << 20


def prefix_hash(doc_id: Column) -> Column:
    """32 leading bits of MD5, as a long."""
    key = F.coalesce(doc_id.cast("string"), F.lit("null"))
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, 8), 16, 10).cast("long")


def leaves_of(cells: DataFrame, limit: int, bits: int) -> DataFrame:
    """Directory entries ``depth, prefix, shard_bytes`` for cells (``h``, ``bytes``) on a grid of ``bits`` bits.

    Sums for all depths come from one aggregation. An entry is a leaf when it fits (or has no bits left)
    and its parent didn't fit.
    """
    fan = cells.select(F.explode(F.sequence(F.lit(0), F.lit(bits))).alias("depth"), "h", "bytes")
    fan = fan.select("depth", F.expr(f"shiftright(h, {bits} - depth)").alias("prefix"), "bytes")
    sums = fan.groupBy("depth", "prefix").agg(F.sum("bytes").alias("bytes"))
    parent = sums.select((F.col("depth") + 1).alias("depth"), F.col("prefix").alias("up"), F.col("bytes").alias("up_bytes"))
    tree = sums.withColumn("up", F.shiftright("prefix", 1)).join(parent, ["depth", "up"], "left")
    fits = (F.col("bytes") <= limit) | (F.col("depth") == bits)
    return tree.filter(fits & (F.col("up_bytes").isNull() | (F.col("up_bytes") > limit))).select(
        "depth", "prefix", F.col("bytes").alias("shard_bytes")
    )


def shard(docs: DataFrame, limit: int = LIMIT) -> DataFrame:
    """``doc_id, n_bytes, shard, shard_bits, shard_bytes, over_limit`` for every row of ``docs``."""
    bits = MAX_BITS
    rows = docs.select(
        docs["doc_id"].alias("doc_id"),
        F.coalesce(F.octet_length(docs["text"]), F.lit(0)).cast("long").alias("n_bytes"),
        prefix_hash(docs["doc_id"]).alias("h"),
    )
    rows = cut(rows)  # three numbers a document; the texts are read once
    total = rows.agg(F.sum("n_bytes")).first()[0] or 0
    # a grid of cells of about 1/16 of the limit: as many as the shards need, however many documents there are
    grid = min(bits, max(0, (16 * total // max(1, limit)).bit_length()))
    cell = F.shiftright("h", bits - grid)
    leaves = cut(leaves_of(rows.groupBy(cell.alias("h")).agg(F.sum("n_bytes").alias("bytes")), limit, grid))
    over = leaves.filter(F.col("shard_bytes") > limit)
    if grid < bits and not over.isEmpty():
        # cells that are too large by themselves go on splitting, by their own documents only
        cells = over.select(F.col("prefix").alias("cell"))
        own = rows.withColumn("cell", cell).join(cells, "cell", "left_semi").groupBy("h").agg(F.sum("n_bytes").alias("bytes"))
        leaves = leaves.filter(F.col("shard_bytes") <= limit).unionByName(leaves_of(own, limit, bits).filter(F.col("depth") > grid))
    # every leaf covers a run of cells or lies inside one: an equi-join on the cell finds it
    run = F.expr(f"sequence(shiftleft(prefix, greatest({grid} - depth, 0)), shiftleft(prefix + 1, greatest({grid} - depth, 0)) - 1)")
    inside = F.expr(f"array(shiftright(prefix, greatest(depth - {grid}, 0)))")
    entries = leaves.withColumn("cell", F.explode(F.when(F.col("depth") <= grid, run).otherwise(inside)))
    placed = rows.withColumn("cell", cell).join(entries, "cell").filter(F.expr(f"shiftright(h, {bits} - depth)") == F.col("prefix"))
    return placed.select(
        "doc_id",
        "n_bytes",
        F.when(F.col("depth") == 0, F.lit("")).otherwise(F.expr("lpad(conv(prefix, 10, 2), depth, '0')")).alias("shard"),
        F.col("depth").cast("int").alias("shard_bits"),
        "shard_bytes",
        (F.col("shard_bytes") > limit).alias("over_limit"),
    )


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(table(spark, sf_dir, "documents"))


SQL = f"""
WITH rows_ AS (
  SELECT row_number() OVER () AS n, doc_id, CAST(coalesce(strlen(text), 0) AS BIGINT) AS n_bytes,
         CAST(('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 8)) AS BIGINT) AS h
  FROM documents),
placed AS (
  SELECT n, doc_id, n_bytes, h, depth, h >> ({MAX_BITS} - depth) AS prefix,
         sum(n_bytes) OVER (PARTITION BY depth, h >> ({MAX_BITS} - depth)) AS shard_bytes
  FROM rows_ CROSS JOIN (SELECT unnest(range(0, {MAX_BITS + 1})) AS depth)),
leaf AS (
  SELECT *, row_number() OVER (PARTITION BY n ORDER BY depth) AS k FROM placed
  WHERE shard_bytes <= {LIMIT} OR depth = {MAX_BITS})
SELECT doc_id, n_bytes,
       CASE WHEN depth = 0 THEN '' ELSE right(bin(prefix + (CAST(1 AS BIGINT) << 33)), CAST(depth AS INT)) END AS shard,
       CAST(depth AS INTEGER) AS shard_bits, CAST(shard_bytes AS BIGINT) AS shard_bytes,
       shard_bytes > {LIMIT} AS over_limit
FROM leaf WHERE k = 1
"""

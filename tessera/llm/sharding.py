"""Sharding by extendible hashing.

Every document has a 60-bit key, the head of its id's MD5. A directory lists buckets by key prefix; a bucket that holds
more than the byte limit splits on its next bit, others stay as they are, until every bucket fits. Splits are decided on
aggregates: bytes are summed by a prefix that is some bits longer than the data need, all shorter prefixes follow from
those sums, and only cells that are still too large are summed again by longer prefixes.

A document larger than the limit has a bucket of its own as soon as a prefix sets it apart; documents whose keys agree
in all bits (equal ids) can't be split and share a bucket. Both are marked oversized. Null ids are keyed as the empty
string, null texts have 0 bytes. Extra columns are kept, but for those that have a result's name, which give way. An empty table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.storage import cut

KEY_BITS = 60
LIMIT = 16 << 20
SPARE_BITS = 6


def key_of(id_col: F.Column) -> F.Column:
    """The first 60 bits of MD5 of the id as text."""
    head = F.substring(F.md5(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")), 1, 15)
    return F.conv(head, 16, 10).cast("long")


def prefix(key: F.Column, bits: F.Column | int) -> F.Column:
    """The key's first bits as a number."""
    if isinstance(bits, int):
        return F.shiftright(key, KEY_BITS - bits)
    return F.call_function("shiftright", key, (KEY_BITS - bits).cast("int"))


def directory(keyed: DataFrame, limit: int = LIMIT, spare_bits: int = SPARE_BITS) -> DataFrame:
    """keyed (key, bytes) to (depth, prefix, bytes, oversized): the buckets."""
    total = keyed.agg(F.sum("bytes")).first()[0]
    if total is None:
        return keyed.sparkSession.createDataFrame([], "depth int, prefix long, bytes long, oversized boolean")
    depth = min(KEY_BITS, max(0, math.ceil(math.log2(max(total / limit, 1)))) + spare_bits)
    done, out, open_cells, at = None, None, keyed, 0
    while True:
        cells = open_cells.groupBy(prefix(F.col("key"), depth).alias("cell")).agg(F.sum("bytes").alias("bytes"))
        level = F.explode(F.sequence(F.lit(at), F.lit(depth)))
        sums = (
            cells.select("cell", "bytes", level.alias("depth"))
            .groupBy("depth", F.call_function("shiftright", "cell", (F.lit(depth) - F.col("depth")).cast("int")).alias("prefix"))
            .agg(F.sum("bytes").alias("bytes"))
        )
        sums = cut(sums, "shard-sums")
        parents = sums.select((F.col("depth") + 1).alias("depth"), F.col("prefix").alias("parent"), F.col("bytes").alias("above"))
        sized = sums.withColumn("parent", F.shiftright("prefix", 1)).join(parents, ["depth", "parent"], "left")
        top = F.col("depth") == at
        split = (top & F.lit(at == 0)) | (~top & (F.col("above") > limit))
        last = (F.col("depth") == depth) & (F.col("bytes") > limit)
        found = sized.where(split & ((F.col("bytes") <= limit) | (F.lit(depth == KEY_BITS) & last)))
        found = found.select("depth", "prefix", "bytes", (F.col("bytes") > limit).alias("oversized"))
        out = found if out is None else out.union(found)
        large = sized.where(last).select(F.col("prefix").alias("cell"))
        if depth == KEY_BITS or large.isEmpty():
            return cut(out, "shard-directory")
        done = depth
        open_cells = open_cells.join(cut(large, "shard-large"), prefix(F.col("key"), done) == F.col("cell"), "left_semi")
        at, depth = done, min(KEY_BITS, done + 12)


ADDED = {"shard_depth": "int", "shard_prefix": "long", "shard_bytes": "long", "shard_oversized": "boolean"}


def assigned(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT, spare_bits: int = SPARE_BITS) -> DataFrame:
    """docs with shard_depth, shard_prefix, shard_bytes and shard_oversized.

    Each document looks its bucket up at every depth that the directory has; the depths are few, and the directory is
    joined by hash, or broadcast where it is below Spark's threshold.
    """
    own = [c for c in docs.columns if c.lower() not in ADDED]
    keyed = docs.select(key_of(F.col(id_col)).alias("key"), F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("bytes"))
    buckets = directory(keyed, limit, spare_bits)
    # the directory by depth: bounded by KEY_BITS
    depths = [r[0] for r in buckets.select("depth").distinct().orderBy("depth").collect()]
    if not depths:
        return docs.select(*own, *[F.lit(None).cast(t).alias(n) for n, t in ADDED.items()])
    deepest = depths[-1]
    least = F.shiftleft(F.col("prefix").cast("long"), 0)
    low = F.call_function("shiftleft", least, (F.lit(KEY_BITS) - F.col("depth")).cast("int"))
    # a bucket of depth d stands in the directory once for each cell of the common depth below which it can't be found
    common = min(deepest, depths[0] + 12)
    shallow = buckets.where(F.col("depth") <= common).select(
        F.explode(F.sequence(prefix(low, common), prefix(low, common) + F.call_function("shiftleft", F.lit(1).cast("long"), (F.lit(common) - F.col("depth")).cast("int")) - 1)).alias("cell"),
        "depth", "prefix", "bytes", "oversized",
    )
    deep = buckets.where(F.col("depth") > common).select(
        F.call_function("shiftright", "prefix", (F.col("depth") - common).cast("int")).alias("cell"), "depth", "prefix", "bytes", "oversized"
    )
    slots = cut(shallow.union(deep), "shard-slots")
    key = key_of(docs[id_col])
    fits = F.call_function("shiftright", key, (F.lit(KEY_BITS) - slots["depth"]).cast("int")) == slots["prefix"]
    return docs.join(slots, (prefix(key, common) == slots["cell"]) & fits).select(
        *[docs[c] for c in own],
        slots["depth"].alias("shard_depth"),
        slots["prefix"].alias("shard_prefix"),
        slots["bytes"].alias("shard_bytes"),
        slots["oversized"].alias("shard_oversized"),
    )


def write_shards(docs: DataFrame, path: str, **how) -> None:
    """One folder a shard, of parquet files."""
    named = assigned(docs, **how).withColumn("shard", F.concat_ws("-", "shard_depth", "shard_prefix"))
    named.repartition("shard").write.partitionBy("shard").parquet(path)


def op2_extendible_shards(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    sized = docs.select("doc_id", F.col("text"))
    found = assigned(sized)
    return found.select(
        "doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("bytes"),
        F.col("shard_depth").cast("long").alias("shard_depth"), "shard_prefix", "shard_bytes", "shard_oversized",
    )


ORACLE = f"""
WITH d AS (
  SELECT doc_id, ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS key,
         coalesce(strlen(text), 0)::BIGINT AS bytes FROM documents),
levels AS (SELECT unnest(range(0, 31)) AS depth),
sums AS (SELECT depth, key >> ({KEY_BITS} - depth) AS prefix, sum(bytes)::BIGINT AS bytes FROM d, levels GROUP BY ALL),
found AS (
  SELECT doc_id, d.bytes, s.depth, s.prefix, s.bytes AS shard_bytes,
         row_number() OVER (PARTITION BY doc_id ORDER BY s.depth) AS i
  FROM d JOIN sums s ON d.key >> ({KEY_BITS} - s.depth) = s.prefix WHERE s.bytes <= {LIMIT})
SELECT doc_id, bytes, depth AS shard_depth, prefix AS shard_prefix, shard_bytes, false AS shard_oversized
FROM found WHERE i = 1
"""

"""Operator 8: shards by extendible hashing, in DataFrame operations only.

A row's key is a 48-bit hash; a bucket is a prefix of its bits. Only buckets
over the byte limit split on another bit, so the leaves of the directory are
the shortest prefixes that fit. Sizes are summed up per fine prefix before
anything else happens, LEVEL bits at a time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from topograph.functions.scratch import materialize

BITS, LEVEL = 48, 12
#: Rows of one key that a window over them may hold.
RUN = 100_000


def prefix(key: Column, depth: Column | int) -> Column:
    """The first depth bits of key, as a number."""
    depth = F.lit(depth) if isinstance(depth, int) else depth
    return F.call_function("shiftright", key, (F.lit(BITS) - depth).cast("int"))


def key_of(id_col: str, text_col: str) -> Column:
    text = F.md5(F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary"))
    whole = F.md5(F.concat_ws("/", F.coalesce(F.col(id_col).cast("string"), F.lit("")), text).cast("binary"))
    return F.conv(F.substring(whole, 1, BITS // 4), 16, 10).cast("long")


def shards(docs: DataFrame, limit: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_bytes, depth, shard, fits) for every row of docs; shard is depth-prefix[-page].

    n_bytes is of the UTF-8 text, 0 for null. Every shard holds at most limit
    bytes. Equal rows have equal keys, which no bit parts: if they outgrow a
    shard they fill pages of it in turn. A row over the limit by itself is a
    shard of its own, with fits = false. A null id hashes as an empty one;
    rows that repeat an id are told apart by their text. An empty table gives
    no rows. Other columns play no part.
    """
    n_bytes = F.coalesce(F.octet_length(F.col(text_col).cast("string")).cast("long"), F.lit(0).cast("long"))
    rows = materialize(docs.select(F.col(id_col).alias("id"), n_bytes.alias("n_bytes"), key_of(id_col, text_col).alias("key")), "keys")
    sizes = rows.where(F.col("n_bytes") <= limit).groupBy("key").agg(F.sum("n_bytes").alias("size"))
    leaves: DataFrame | None = None
    left = materialize(sizes, "sizes")
    for low in range(0, BITS, LEVEL):
        fine = left.groupBy(prefix(F.col("key"), low + LEVEL).alias("fine")).agg(F.sum("size").alias("size"))
        from_ = 0 if low == 0 else low + 1
        each = fine.select("fine", "size", F.explode(F.sequence(F.lit(from_), F.lit(low + LEVEL))).alias("depth"))
        bucket = F.call_function("shiftright", F.col("fine"), (F.lit(low + LEVEL) - F.col("depth")).cast("int"))
        total = each.groupBy("depth", bucket.alias("prefix")).agg(F.sum("size").alias("size"))
        total = materialize(total, "buckets")
        # a leaf fits and its parent doesn't
        parent = total.where(F.col("size") > limit).select((F.col("depth") + 1).alias("depth"), F.col("prefix").alias("above"))
        fit = total.where(F.col("size") <= limit).withColumn("above", F.call_function("shiftright", F.col("prefix"), F.lit(1)))
        top = fit.where(F.col("depth") == from_).select("depth", "prefix")
        split = fit.where(F.col("depth") > from_).join(parent, ["depth", "above"], "left_semi").select("depth", "prefix")
        found = top.union(split).withColumn("level", F.lit(low + LEVEL))
        leaves = found if leaves is None else leaves.union(found)
        over = total.where((F.col("depth") == low + LEVEL) & (F.col("size") > limit)).select(F.col("prefix").alias("fine"))
        if over.isEmpty():
            break
        left = materialize(left.join(over, prefix(F.col("key"), low + LEVEL) == F.col("fine"), "left_semi"), "left")
    leaves = materialize(leaves, "directory")
    depths = [r.depth for r in leaves.select("depth").distinct().orderBy("depth").collect()]  # at most BITS + 1

    # each distinct key looks its leaf up by its prefixes, of the depths that there are
    keys = rows.select("key").distinct()
    tried = keys.select("key", F.explode(F.array(*(F.lit(d) for d in depths))).alias("depth")) if depths else keys.select("key", F.lit(0).alias("depth")).limit(0)
    placed = tried.select("key", "depth", prefix(F.col("key"), F.col("depth")).alias("prefix")).join(leaves.select("depth", "prefix"), ["depth", "prefix"])
    out = rows.join(placed, "key", "left")
    name = F.concat_ws("-", "depth", "prefix")
    big = F.col("n_bytes") > limit
    whole = F.concat_ws("-", F.lit(BITS), F.col("key"))
    plain = out.select("id", "n_bytes", "key", F.when(big | F.col("depth").isNull(), BITS).otherwise(F.col("depth")).alias("depth"), F.when(~big & F.col("depth").isNotNull(), name).alias("shard"), (~big).alias("fits"))
    paged = sizes.where(F.col("size") > limit).select("key")
    if paged.isEmpty():
        return _done(plain, whole, id_col)
    # equal rows: none is larger than another, so a page takes as many of them as fit
    same = materialize(plain.where("shard is null and fits").select("id", "n_bytes", "key", F.monotonically_increasing_id().alias("at")), "equal")
    count = same.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    same = same.join(count, "key").withColumn("part", F.pmod(F.xxhash64("at"), F.ceil(F.col("n") / RUN)))
    from pyspark.sql import Window

    turn = F.row_number().over(Window.partitionBy("key", "part").orderBy("at")) - 1
    page = F.floor(turn / F.floor(F.lit(limit) / F.greatest("n_bytes", F.lit(1))))
    pages = same.select("id", "n_bytes", "key", F.lit(BITS).alias("depth"), F.concat_ws("-", F.lit(BITS), "key", "part", page).alias("shard"), F.lit(True).alias("fits"))
    return _done(plain.where("shard is not null or not fits").union(pages), whole, id_col)


def _done(rows: DataFrame, whole: Column, id_col: str) -> DataFrame:
    own = F.concat_ws("-", whole, F.lit("own"))
    return rows.select(F.col("id").alias(id_col), "n_bytes", F.col("depth").cast("int").alias("depth"), F.coalesce("shard", own).alias("shard"), "fits")


def oracle(limit: int) -> str:
    """The same in DuckDB SQL, by the sizes of all prefixes; for tables without rows that outgrow a shard."""
    return f"""
    WITH RECURSIVE k AS (
      SELECT doc_id, CAST(strlen(coalesce(text, '')) AS BIGINT) AS n_bytes,
             CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || '/' || md5(coalesce(text, ''))), 1, 12) AS BIGINT) AS key
      FROM documents),
    b AS (
      SELECT 0 AS depth, CAST(0 AS BIGINT) AS prefix, CAST(sum(n_bytes) AS BIGINT) AS size FROM k WHERE n_bytes <= {limit}
      UNION ALL
      SELECT d, p, CAST(sum(n_bytes) AS BIGINT) FROM (
        SELECT b.depth + 1 AS d, k.key >> (47 - b.depth) AS p, k.n_bytes
        FROM b JOIN k ON (k.key >> (48 - b.depth)) = b.prefix AND k.n_bytes <= {limit}
        WHERE b.size > {limit} AND b.depth < 48) GROUP BY d, p),
    leaf AS (SELECT * FROM b WHERE size <= {limit})
    SELECT k.doc_id, k.n_bytes, CAST(CASE WHEN k.n_bytes > {limit} THEN 48 ELSE leaf.depth END AS INTEGER) AS depth,
           CASE WHEN k.n_bytes > {limit} THEN '48-' || k.key || '-own' ELSE leaf.depth || '-' || leaf.prefix END AS shard,
           k.n_bytes <= {limit} AS fits
    FROM k LEFT JOIN leaf ON (k.key >> (48 - leaf.depth)) = leaf.prefix AND k.n_bytes <= {limit}
    """

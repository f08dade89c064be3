"""Sharding by extendible hashing, with Spark expressions only.

A directory is indexed by the leading bits of a 60-bit hash of id and text. A bucket is split on its next bit only while it holds more
than its byte limit, so shards have different depths. As a bucket's bytes never grow with depth, the shard of a row is the shallowest
prefix of its hash that fits. Prefix sums come from a histogram of hash cells, not from the rows; only rows in cells that are still too
large go into a further round with more bits.

Rows that agree in id and text have one hash. Where such rows are too many for a shard, they get a number each, which is written with them, and the
hash of hash and number goes on where the 60 bits end, so that depths go up to 120 and these shards are named by both prefixes.

Defined results: null ids and texts hash and weigh as empty strings; a row that is larger than the limit by itself has a shard of its own, of depth 60 or
120, with oversized true, and no other shard is oversized. An empty table gives an empty table; other columns pass through.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.llm.common import fresh, named, stored

BITS = 60
LIMIT = 64 << 20
#: The query's limit: small enough that the driver's smallest tables are split as well.
REPORT_LIMIT = 256 << 10
SPARE_BITS = 4


def hashed() -> Column:
    return bits_of(F.concat(F.coalesce(named("doc_id").cast("string"), F.lit("")), F.lit(":"), F.coalesce(named("text"), F.lit(""))))


def bits_of(whole: Column) -> Column:
    return F.conv(F.substring(F.md5(whole), 1, BITS // 4), 16, 10).cast("long")


def n_bytes() -> Column:
    return F.coalesce(F.octet_length(named("text")), F.lit(0)).cast("long")


def prefix(h: Column, depth: int | Column) -> Column:
    return F.shiftright(h, BITS - depth) if isinstance(depth, int) else F.call_function("shiftright", h, (F.lit(BITS) - depth).cast("int"))


def directory(hashes: DataFrame, limit: int) -> list[tuple[int, DataFrame]]:
    """[(bits, cells)] for hashes (g, h, n), each g having a directory of its own: cells (g, p, depth, bytes, rows) maps each bits-bit prefix to its shard;
    null depth: in the next one. rows counts the cell's rows in the last round only, where a cell is one hash.

    The first bits follow from the total: enough for shards to hold a sixteenth of the limit on average. Each round sums cells (one row per
    task and cell is shuffled), adds up all their prefixes, and takes the first that fits.
    """
    total = hashes.groupBy("g").agg(F.sum("n").alias("n")).agg(F.max("n")).first()[0] or 0
    bits, low, out, left = min(BITS, max(0, (max(1, total) // limit).bit_length()) + SPARE_BITS), 0, [], hashes
    while True:
        cells = left.groupBy("g", prefix(F.col("h"), bits).alias("p")).agg(F.sum("n").alias("n"), F.count("*").alias("rows"))
        paths = cells.withColumn("d", F.explode(F.sequence(F.lit(low), F.lit(bits))))
        paths = paths.withColumn("q", F.call_function("shiftright", F.col("p"), (F.lit(bits) - F.col("d")).cast("int")))
        sums = paths.groupBy("g", "d", "q").agg(F.sum("n").alias("bytes"))
        fits = (F.col("bytes") <= limit) if bits < BITS else (F.col("bytes") <= limit) | (F.col("d") == BITS)
        firsts = paths.join(sums, ["g", "d", "q"]).groupBy("g", "p").agg(F.min(F.when(fits, F.struct("d", "bytes"))).alias("s"), F.first("rows").alias("rows"))
        cells = stored(firsts.select("g", "p", F.col("s.d").alias("depth"), F.col("s.bytes").alias("bytes"), "rows"), "directory")
        out.append((bits, cells))
        open_cells = cells.filter("depth is null")
        if bits == BITS or open_cells.isEmpty():
            return out
        of = open_cells.select(F.col("g").alias("og"), F.col("p").alias("op"))
        left = left.join(of, (F.col("g") == F.col("og")) & (prefix(F.col("h"), bits) == F.col("op")), "left_semi")
        low, bits = bits + 1, min(BITS, bits + 10)


def looked_up(rows: DataFrame, g: Column, h: Column, rounds: list[tuple[int, DataFrame]]) -> tuple[DataFrame, Column, Column, Column]:
    """rows with its hashes' cells, and from them depth, bytes and rows. Spark knows the sizes of the written cells and broadcasts them if they are
    small enough."""
    out, found = rows, []
    for bits, cells in rounds:
        names = fresh(out, *[f"cell_{c}_" for c in ("g", "p", "depth", "bytes", "rows")])
        out = out.join(cells.toDF(*names), (g == named(names[0])) & (prefix(h, bits) == named(names[1])), "left")
        found.append([F.when(named(names[2]).isNotNull(), named(c)) for c in names[2:]])
    return out, *[F.coalesce(*c) for c in zip(*found, strict=True)]


def assign(docs: DataFrame, limit: int = LIMIT) -> DataFrame:
    """docs with n_bytes, shard (depth:prefix), shard_depth, shard_bytes and oversized."""
    if limit < 1:
        raise ValueError("the limit is at least a byte")
    names = fresh(docs, "n_bytes", "shard", "shard_depth", "shard_bytes", "oversized")
    h, n, again = fresh(docs, "hash_", "weight_", "again_")
    base = docs.withColumns({h: hashed(), n: n_bytes()})
    zero, own = F.lit(0).cast("long"), [named(c) for c in docs.columns]

    def shown(df: DataFrame, shard: Column, depth: Column, size: Column) -> DataFrame:
        values = (named(n), shard, depth.cast("long"), size, size > limit)
        return df.select(*own, *[v.alias(k) for k, v in zip(names, values, strict=True)])

    rounds = directory(stored(base.select(zero.alias("g"), named(h).alias("h"), named(n).alias("n")), "hashes"), limit)
    out, d, b, rows = looked_up(base, zero, named(h), rounds)
    shard = F.concat_ws(":", d.cast("string"), prefix(named(h), d).cast("string"))
    crowded = (b > limit) & (rows > 1)
    if rounds[-1][0] < BITS or rounds[-1][1].filter((F.col("bytes") > limit) & (F.col("rows") > 1)).isEmpty():
        return shown(out, shard, d, b)
    equal = stored(out.filter(crowded).select(*own, named(h), named(n)).withColumn(again, bits_of(F.concat_ws(":", named(h), F.monotonically_increasing_id()))), "equal")
    more = directory(equal.select(named(h).alias("g"), named(again).alias("h"), named(n).alias("n")), limit)
    cut, d2, b2, _ = looked_up(equal, named(h), named(again), more)
    second = F.concat_ws(":", (d2 + BITS).cast("string"), F.concat_ws("-", named(h).cast("string"), prefix(named(again), d2).cast("string")))
    return shown(out.filter(~crowded), shard, d, b).unionByName(shown(cut, second, d2 + BITS, b2))


def write(docs: DataFrame, path: str, limit: int = LIMIT) -> None:
    """One folder per shard; a task writes whole shards, each of at most limit bytes of text."""
    out = assign(docs, limit)
    shard = next(c for c in out.columns[len(docs.columns) :] if c.startswith("shard") and "_" not in c.rstrip("_"))
    out.repartition(named(shard)).sortWithinPartitions(named(shard)).write.partitionBy(shard).parquet(path)


def report(docs: DataFrame, limit: int = REPORT_LIMIT) -> DataFrame:
    return assign(docs.select("doc_id", "text"), limit).drop("text")


def oracle(limit: int = REPORT_LIMIT) -> str:
    return f"""
WITH d AS (SELECT doc_id, coalesce(strlen(text), 0)::BIGINT AS n_bytes,
    ('0x' || substr(md5(coalesce(CAST(doc_id AS varchar), '') || ':' || coalesce(text, '')), 1, 15))::BIGINT AS h, row_number() OVER () AS i FROM documents),
e AS (SELECT *, t.d AS depth, h // (1::BIGINT << (60 - t.d)::INT) AS p FROM d, range(0, 61) t(d)),
s AS (SELECT depth, p, sum(n_bytes)::BIGINT AS bytes FROM e GROUP BY ALL),
f AS (SELECT i, min(depth) AS depth FROM e JOIN s USING (depth, p) WHERE bytes <= {limit} OR depth = 60 GROUP BY i)
SELECT doc_id, n_bytes, CAST(depth AS varchar) || ':' || CAST(p AS varchar) AS shard, depth AS shard_depth, bytes AS shard_bytes, bytes > {limit} AS oversized
FROM f JOIN e USING (i, depth) JOIN s USING (depth, p)
"""

"""The relations of the document store, derived from the driver's tables.

The driver's tables hold no organisations, grants, billing frequencies or removals; the functions here derive them by
deterministic expressions (FIXTURES.md, part B), each as a lazily evaluated DataFrame.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NANO_EPOCH = "timestamp_ntz'2024-01-01 00:00:00'"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def owners(spark: SparkSession, sf_dir: str) -> int:
    """How many users own documents; a count that Parquet footers answer."""
    return max(1, table(spark, sf_dir, "customer").count() // 10)


def orgs(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation")
    other = n.select(F.col("n_nationkey").alias("other"), F.col("n_regionkey").alias("r"))
    lists = (
        n.join(other, (F.col("n_regionkey") == F.col("r")) & (F.col("n_nationkey") != F.col("other")), "left")
        .groupBy("n_nationkey")
        .agg(F.sort_array(F.collect_list("other")).alias("sharable_orgs"))
    )
    return n.join(lists, "n_nationkey").select(
        F.col("n_nationkey").alias("org_id"),
        F.col("n_name").alias("org_name"),
        "sharable_orgs",
        (F.col("n_nationkey") % 2 == 0).alias("multi_level_share"),
        F.when(F.col("n_nationkey") % 5 == 0, "Unsubscribed").otherwise("Subscribed").alias("status"),
    )


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("user_id"),
        F.col("c_name").alias("user_name"),
        F.col("c_nationkey").alias("org_id"),
        (F.col("c_custkey") % 10 == 0).alias("is_admin"),
    )


def documents(spark: SparkSession, sf_dir: str, body: bool = False) -> DataFrame:
    """Document records; with body, their texts too."""
    m = owners(spark, sf_dir)
    d = table(spark, sf_dir, "documents").withColumn("owner_id", F.col("doc_id") * 7 % m)
    d = d.join(users(spark, sf_dir).select(F.col("user_id").alias("owner_id"), "org_id"), "owner_id")
    created = F.expr(f"{NANO_EPOCH} + make_interval(0, 0, 0, 0, cast(doc_id % 720 as int), 0, 0)")
    return d.withColumn("created_at", created).select(
        "doc_id",
        F.concat_ws("/", "source", F.col("doc_id").cast("string")).alias("doc_name"),
        "org_id",
        "owner_id",
        F.octet_length("text").cast("long").alias("size_bytes"),
        "created_at",
        F.when(F.col("doc_id") % 11 == 0, F.expr("created_at + interval 240 hours")).alias("removed_at"),
        *(["text"] if body else []),
    )


def shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grants whose grantee's org the owner's org may share with. Users are not broadcast: the driver would collect them twice."""
    m = owners(spark, sf_dir)
    home = users(spark, sf_dir).join(table(spark, sf_dir, "nation"), F.col("org_id") == F.col("n_nationkey"))
    region = home.select("user_id", F.col("n_regionkey").alias("region"))
    ids = table(spark, sf_dir, "documents").select("doc_id").filter("doc_id % 4 = 0")
    wish = (
        ids.withColumn("grantor_id", F.col("doc_id") * 7 % m)
        .withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(6))))
        .withColumn("grantee_id", (F.col("grantor_id") + F.col("k")) % m)
        .filter("grantee_id <> grantor_id")
        .select("doc_id", "grantor_id", "grantee_id")
        .distinct()
    )
    a = region.select(F.col("user_id").alias("grantor_id"), F.col("region").alias("ra"))
    b = region.select(F.col("user_id").alias("grantee_id"), F.col("region").alias("rb"))
    return wish.join(a.hint("merge"), "grantor_id").join(b.hint("merge"), "grantee_id").filter("ra = rb").select("doc_id", "grantor_id", "grantee_id")


def traffic(events: DataFrame) -> DataFrame:
    """Traffic records of an events table, batch or streaming."""
    get = F.col("event_type").isin("view", "click")
    method = (
        F.when(get, "GET")
        .when(F.col("event_type") == "purchase", "POST")
        .when(F.col("event_type") == "signup", "PUT")
        .otherwise("DELETE")
    )
    return events.select(
        F.col("ts").alias("time"),
        "user_id",
        method.alias("method"),
        F.concat(F.lit("/v1/"), F.col("event_type"), F.lit("/"), F.get_json_object("props", "$.k")).alias("uri"),
        F.when(get, F.lit(0.0)).otherwise(F.col("value")).alias("incoming"),
        F.when(get, F.col("value")).otherwise(F.lit(0.0)).alias("outgoing"),
    )


def frequencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Billing frequencies as they were set, without the end of their validity."""
    org = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("org_id"))

    def row(kind: str, start: str, which: str) -> DataFrame:
        return org.filter(which).select("org_id", F.lit(kind).alias("frequency"), F.expr(f"timestamp_ntz'{start}'").alias("valid_from"))

    return (
        row("MONTHLY", "2023-01-01 00:00:00", "true")
        .unionByName(row("YEARLY", "2024-01-15 00:00:00", "org_id % 2 = 0"))
        .unionByName(row("MONTHLY", "2025-01-15 00:00:00", "org_id % 4 = 0"))
    )


def payments(spark: SparkSession, sf_dir: str) -> DataFrame:
    paid = F.col("o_orderstatus")
    start = F.date_trunc("month", "o_orderdate").cast("timestamp_ntz")
    return (
        table(spark, sf_dir, "orders")
        .join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
        .select(
            F.col("c_nationkey").alias("org_id"),
            F.col("o_orderdate").alias("billed_at"),
            start.alias("period_start"),
            F.expr("cast(add_months(date_trunc('month', o_orderdate), 1) as timestamp_ntz)").alias("period_end"),
            F.col("o_totalprice").alias("amount"),
            F.when(paid == "F", "Payment Success").when(paid == "O", "Payment Pending").otherwise("Payment Failed").alias("status"),
        )
    )


def raw_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """Documents as they lie in a folder: one row per file, its body as binary. Spark's scan plans no task for a file without bytes, so that empty files give
    no row."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("doc_name"), F.col("content").alias("body"), F.col("length").alias("size_bytes"))

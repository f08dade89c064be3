"""Grants on documents and the lists of orgs that may be shared with.

Nulls: a grant with a null id is none; a null list of orgs is empty; null multi-level sharing is off.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.sources.scratch import stored


def share(shares: DataFrame, wishes: DataFrame, documents: DataFrame, users: DataFrame, orgs: DataFrame) -> DataFrame:
    """shares with those wishes (doc_id, grantor_id, grantee_id) that are allowed.

    The grantee's org has to be the document's or in its sharable list; a grantor who is not the owner needs a grant of their own
    and an org with multi-level sharing. A grant that is there already stays one.
    """
    d = documents.select("doc_id", "owner_id", F.col("org_id").alias("doc_org"))
    who = users.select(F.col("user_id").alias("grantee_id"), F.col("org_id").alias("grantee_org"))
    o = orgs.select(F.col("org_id").alias("doc_org"), "sharable_orgs", "multi_level_share")
    held = shares.select("doc_id", F.col("grantee_id").alias("grantor_id"), F.lit(True).alias("held")).distinct()
    allowed = (
        wishes.join(d, "doc_id")
        .join(who, "grantee_id")
        .join(o, "doc_org")
        .join(held, ["doc_id", "grantor_id"], "left")
        .filter("grantee_org = doc_org or array_contains(sharable_orgs, grantee_org)")
        .filter("grantor_id = owner_id or (multi_level_share and held)")
        .filter("grantee_id <> owner_id or owner_id is null")
        .select("doc_id", "grantor_id", "grantee_id")
    )
    return shares.unionByName(allowed).dropDuplicates(["doc_id", "grantor_id", "grantee_id"])


def unshare(shares: DataFrame, drop: DataFrame) -> DataFrame:
    """shares without the grants (doc_id, grantee_id) of drop."""
    return shares.join(drop, ["doc_id", "grantee_id"], "left_anti").select(*shares.columns)


def unshared_count(shares: DataFrame, drop: DataFrame) -> DataFrame:
    gone = shares.join(drop, ["doc_id", "grantee_id"], "left_semi")
    return gone.agg(F.countDistinct("doc_id").alias("unshared"))


def reshare_closure(shares: DataFrame, documents: DataFrame, orgs: DataFrame, depth: int | None = None) -> DataFrame:
    """(doc_id, user_id, level): who reaches a document by grants, level the fewest that are needed; depth, if given, is the most that count.

    Grants count beyond the first level only where the document's org has multi-level sharing. Every level is one join on doc_id and
    grantor, whose result is written, so that no plan grows with the levels. Pairs that are known are not followed again: cycles end, and the
    levels go on until one adds nothing. No join collects grants or users at the driver to broadcast them, which would come again with every level.
    """
    grants = stored(shares.select("doc_id", "grantor_id", "grantee_id").dropna().distinct(), "grants")
    owned = documents.filter("owner_id is not null and doc_id is not null").select("doc_id", F.col("owner_id").alias("user_id"))
    reached = stored(owned.distinct().withColumn("level", F.lit(0)), "reached")
    multi = documents.join(orgs.filter("multi_level_share").select("org_id"), "org_id", "left_semi").select("doc_id")
    deep = stored(grants.join(multi.hint("merge"), "doc_id", "left_semi"), "grants")
    front, level = reached, 0
    while depth is None or level < depth:
        level += 1
        step = front.select("doc_id", F.col("user_id").alias("grantor_id")).join((grants if level == 1 else deep).hint("merge"), ["doc_id", "grantor_id"])
        step = step.select("doc_id", F.col("grantee_id").alias("user_id")).distinct()
        front = stored(step.join(reached.hint("merge"), ["doc_id", "user_id"], "left_anti").withColumn("level", F.lit(level)), "reached")
        if front.isEmpty():
            break
        reached = reached.unionByName(front)
    return reached


def add_sharable(orgs: DataFrame, org_id: int, other: int) -> DataFrame:
    grown = F.array_sort(F.array_distinct(F.array_append(F.coalesce("sharable_orgs", F.array().cast(orgs.schema["sharable_orgs"].dataType)), F.lit(other))))
    return orgs.withColumn("sharable_orgs", F.when(F.col("org_id") == org_id, grown).otherwise(F.col("sharable_orgs")))


def remove_sharable(orgs: DataFrame, org_id: int, other: int) -> DataFrame:
    left = F.array_remove("sharable_orgs", other)
    return orgs.withColumn("sharable_orgs", F.when(F.col("org_id") == org_id, left).otherwise(F.col("sharable_orgs")))


def set_multi_level(orgs: DataFrame, org_id: int, enable: bool) -> DataFrame:
    return orgs.withColumn("multi_level_share", F.when(F.col("org_id") == org_id, F.lit(enable)).otherwise(F.col("multi_level_share")))

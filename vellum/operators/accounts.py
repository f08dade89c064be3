"""Orgs and users as states: each function takes relations and returns the relations after the change.

Nulls: a null id matches nothing, so a row without one is neither changed nor removed, and is no caller.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PAYMENTS = "array<struct<billed_at:timestamp_ntz,period_start:timestamp_ntz,period_end:timestamp_ntz,amount:double,status:string>>"


def register_org(orgs: DataFrame, users: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(orgs, users) with the orgs of new and the first admin of each (admin_id, admin_name).

    An org whose name is taken, or whose admin's id is, is left out, as is an org without a name; of equal names or admins in new the one with
    the smallest org_id counts.
    """
    own = [c for c in new.columns if c not in ("admin_id", "admin_name")]
    free = new.filter("org_name is not null and admin_id is not null").join(orgs.select("org_name"), "org_name", "left_anti").join(users.select(F.col("user_id").alias("admin_id")), "admin_id", "left_anti")
    for key in ("org_name", "admin_id"):
        free = free.withColumn("rn", F.row_number().over(Window.partitionBy(key).orderBy("org_id"))).filter("rn = 1").drop("rn")
    admins = free.select(F.col("admin_id").alias("user_id"), F.col("admin_name").alias("user_name"), "org_id", F.lit(True).alias("is_admin"))
    return orgs.unionByName(free.select(*own), allowMissingColumns=True), users.unionByName(admins, allowMissingColumns=True)


def reactivate_org(orgs: DataFrame, users: DataFrame, org_id: int, admin_id: int, admin_name: str) -> tuple[DataFrame, DataFrame]:
    """(orgs, users): an unsubscribed org is subscribed again and the caller becomes its admin; another org stays as it is."""
    was = (F.col("org_id") == org_id) & (F.col("status") == "Unsubscribed")
    admin = orgs.filter(was).select(F.lit(admin_id).cast("long").alias("user_id"), F.lit(admin_name).alias("user_name"), "org_id", F.lit(True).alias("is_admin"))
    new_users = users.join(admin.select("user_id"), "user_id", "left_anti").unionByName(admin)
    return orgs.withColumn("status", F.when(was, "Subscribed").otherwise(F.col("status"))), new_users


def remove_org(relations: dict[str, DataFrame], ids: DataFrame) -> dict[str, DataFrame]:
    """Every relation without the orgs of ids. One without org_id has doc_id and loses those orgs' documents; one with grantor_id and
    grantee_id loses the grants by and to those orgs' users too."""
    gone = relations["documents"].join(ids, "org_id", "left_semi").select("doc_id")
    left = {k: r.join(ids, "org_id", "left_anti") if "org_id" in r.columns else r.join(gone, "doc_id", "left_anti") for k, r in relations.items()}
    away = relations["users"].join(ids, "org_id", "left_semi").select("user_id")
    return {k: without_users(r, away) if "grantee_id" in r.columns else r for k, r in left.items()}


def without_users(shares: DataFrame, ids: DataFrame) -> DataFrame:
    """shares without grants by or to the users of ids."""
    for side in ("grantor_id", "grantee_id"):
        shares = shares.join(ids.select(F.col("user_id").alias(side)), side, "left_anti")
    return shares.select("doc_id", "grantor_id", "grantee_id")


def postpone_removal(orgs: DataFrame, unpaid: DataFrame, force: bool) -> DataFrame:
    """(org_id, postponed): an org with an open charge waits unless forced."""
    due = unpaid.select("org_id").distinct().withColumn("open", F.lit(True))
    return orgs.join(due, "org_id", "left").select("org_id", (F.coalesce("open", F.lit(False)) & F.lit(not force)).alias("postponed"))


def register_user(users: DataFrame, new: DataFrame) -> DataFrame:
    """users with those of new that do not exist yet; of equal ids in new, the row whose JSON comes first. A row without an id is left out."""
    columns = new.columns
    one = new.filter("user_id is not null").groupBy("user_id").agg(F.min_by(F.struct(*columns), F.to_json(F.struct(*columns))).alias("row")).select("row.*")
    return users.unionByName(one.join(users.select("user_id"), "user_id", "left_anti").select(*columns))


def existing_users(users: DataFrame, new: DataFrame) -> DataFrame:
    """The rows of new that are an error because the user exists."""
    return new.join(users.select("user_id"), "user_id", "left_semi")


def list_users(users: DataFrame, org_id: int) -> DataFrame:
    return users.filter(F.col("org_id") == org_id).select("user_id", "user_name", "is_admin")


def user_info(users: DataFrame, user_id: int) -> DataFrame:
    return users.filter(F.col("user_id") == user_id)


def login_lookup(users: DataFrame, user_id: int, org_id: int) -> DataFrame:
    """The context of a session; no row when user and org do not belong together. Passwords are not modelled."""
    return users.filter((F.col("user_id") == user_id) & (F.col("org_id") == org_id)).select("user_id", "org_id", "is_admin")


def open_sessions(sessions: DataFrame, users: DataFrame, logins: DataFrame) -> DataFrame:
    """sessions (user_id, org_id, opened_at, closed_at) with those of logins (user_id, org_id, at) whose user is of that org; others open none."""
    real = logins.join(users.select("user_id", "org_id"), ["user_id", "org_id"], "left_semi").filter("at is not null")
    return sessions.unionByName(real.select("user_id", "org_id", F.col("at").alias("opened_at"), F.lit(None).cast(sessions.schema["closed_at"].dataType).alias("closed_at")))


def close_sessions(sessions: DataFrame, logouts: DataFrame) -> DataFrame:
    """sessions with those closed that a logout (user_id, at) retires: all of the user's that are open then, by the first logout that follows."""
    after = logouts.select(F.col("user_id").alias("who"), "at")
    meet = (F.col("user_id") == F.col("who")) & (F.col("at") >= F.col("opened_at")) & F.col("closed_at").isNull()
    ends = sessions.distinct().join(after, meet).groupBy("user_id", "org_id", "opened_at").agg(F.min("at").alias("ended"))
    same = [F.col(c).eqNullSafe(F.col(f"e_{c}")) for c in ("user_id", "org_id", "opened_at")]
    ends = ends.toDF("e_user_id", "e_org_id", "e_opened_at", "ended")
    return sessions.join(ends, same[0] & same[1] & same[2], "left").select("user_id", "org_id", "opened_at", F.coalesce("closed_at", "ended").alias("closed_at"))


def session_of(sessions: DataFrame, user_id: int, at: Column) -> DataFrame:
    """(user_id, org_id) of a caller with a session that is open at an instant, one row; none once it is retired."""
    mine = (F.col("user_id") == user_id) & (F.col("opened_at") <= at) & (F.col("closed_at").isNull() | (F.col("closed_at") > at))
    return sessions.filter(mine).select("user_id", "org_id").limit(1)


def caller_org(users: DataFrame, user_id: int) -> DataFrame:
    """(org_id) of a caller who is an admin, one row; none for anybody else."""
    return users.filter((F.col("user_id") == user_id) & F.col("is_admin")).select("org_id").limit(1)


def permitted(users: DataFrame, wishes: DataFrame) -> DataFrame:
    """(user_id) of those wishes (caller_id, user_id) whose caller is an admin of the user's org."""
    callers = users.filter("is_admin").select(F.col("user_id").alias("caller_id"), "org_id")
    return wishes.join(callers, "caller_id").join(users.select("user_id", "org_id"), ["user_id", "org_id"], "left_semi").select("user_id").distinct()


def promote_users(users: DataFrame, wishes: DataFrame) -> DataFrame:
    """users with those of wishes (caller_id, user_id) made admins whose caller may do that."""
    asked = permitted(users, wishes).withColumn("asked", F.lit(True))
    return users.join(asked, "user_id", "left").select(*users.columns[:-1], (F.col("is_admin") | F.coalesce("asked", F.lit(False))).alias("is_admin"))


def demote_users(users: DataFrame, ids: DataFrame) -> DataFrame:
    """users with those of ids (for callers' wishes: permitted()) demoted, save where the org would be left without an admin."""
    asked = users.join(ids.select("user_id").distinct().withColumn("asked", F.lit(True)), "user_id", "left")
    stay = asked.groupBy("org_id").agg(F.count_if(F.col("is_admin") & F.col("asked").isNull()).alias("left_over"))
    go = F.coalesce("asked", F.lit(False)) & (F.coalesce("left_over", F.lit(0)) > 0)
    return asked.join(stay, "org_id", "left").select("user_id", "user_name", "org_id", (F.col("is_admin") & ~go).alias("is_admin"))


def remove_users(users: DataFrame, documents: DataFrame, shares: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(users, documents, shares): the users go; their documents stay with the org, have no owner and are read by admins only, so that grants on them
    go, as do grants by and to the users."""
    gone = ids.select(F.col("user_id").alias("owner_id")).distinct().withColumn("gone", F.lit(True))
    marked = documents.join(gone, "owner_id", "left")
    docs = marked.withColumn("owner_id", F.when(F.col("gone").isNull(), F.col("owner_id"))).select(*documents.columns)
    theirs = marked.filter("gone").select("doc_id")
    left = without_users(shares.join(theirs, "doc_id", "left_anti"), ids)
    return users.join(ids.select("user_id"), "user_id", "left_anti"), docs, left


def account_info(orgs: DataFrame, payments: DataFrame, caller: DataFrame | None = None) -> DataFrame:
    """orgs with their payments as an array of structs, by billing time; with caller (org_id) only that org's record, whose payments alone are read.

    A record's payments are one value by definition; list_payments() gives them as rows.
    """
    if caller is not None:
        orgs = orgs.join(F.broadcast(caller.limit(1)), "org_id", "left_semi")
        payments = list_payments(payments, caller)
    fields = F.struct("billed_at", "period_start", "period_end", "amount", "status")
    paid = payments.groupBy("org_id").agg(F.sort_array(F.collect_list(fields)).alias("payments"))
    return orgs.join(paid, "org_id", "left").withColumn("payments", F.coalesce("payments", F.array().cast(PAYMENTS)))


def list_payments(payments: DataFrame, caller: DataFrame) -> DataFrame:
    """The payments of the caller's org as rows."""
    return payments.join(F.broadcast(caller.limit(1)), "org_id", "left_semi")

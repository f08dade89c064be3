"""The document store's operators at their edges: nulls, empty tables, ties, repeated rows, faults."""

import datetime
import math
import os
import re

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vellum import schemas
from vellum.functions import convert
from vellum.functions import text as words
from vellum.operators import accounts, billing, documents, search, sharing
from vellum.sources import scratch, tables
from vellum.streaming import traffic as stream

KEY = "0123456789abcdef"
USERS = "user_id long, user_name string, org_id int, is_admin boolean"
SHARES = "doc_id long, grantor_id long, grantee_id long"
DOCS = "doc_id long, doc_name string, org_id int, owner_id long, size_bytes long"


def rows(df, *order):
    return sorted((tuple(r) for r in df.collect()), key=lambda r: [(x is not None, x) for x in r])


@pytest.fixture(scope="module")
def users(spark):
    return spark.createDataFrame([(1, "a", 1, True), (2, "b", 1, False), (3, "c", 2, True), (4, "d", 2, True), (5, "e", None, False), (None, None, None, None)], USERS)


# accounts


def test_an_org_is_registered_with_its_admin_or_not_at_all(spark, users):
    orgs = spark.createDataFrame([(1, "One", "Subscribed")], "org_id int, org_name string, status string")
    new = [(7, "Seven", "Created", 70, "x"), (8, "Seven", "Created", 80, "y"), (9, "One", "Created", 90, "z"), (10, "Ten", "Created", 2, "b"), (11, None, "Created", 11, "n"), (12, "Twelve", "Created", None, "n"), (13, "Thirteen", "Created", 70, "x")]
    o, u = accounts.register_org(orgs, users, spark.createDataFrame(new, "org_id int, org_name string, status string, admin_id long, admin_name string"))
    assert rows(o) == [(1, "One", "Subscribed"), (7, "Seven", "Created")]
    assert u.count() == users.count() + 1 and rows(u.filter("user_id = 70")) == [(70, "x", 7, True)]
    o, u = accounts.register_org(orgs.limit(0), users.limit(0), spark.createDataFrame(new[:1], "org_id int, org_name string, status string, admin_id long, admin_name string"))
    assert o.count() == u.count() == 1


def test_reactivation_makes_the_caller_an_admin_once(spark, users):
    orgs = spark.createDataFrame([(1, "Unsubscribed"), (2, "Subscribed"), (3, None)], "org_id int, status string")
    o, u = accounts.reactivate_org(orgs, users, 1, 2, "b")
    assert rows(o) == [(1, "Subscribed"), (2, "Subscribed"), (3, None)]
    assert rows(u.filter("user_id = 2")) == [(2, "b", 1, True)] and u.count() == users.count()
    o, u = accounts.reactivate_org(orgs, users, 2, 2, "b")
    assert rows(o) == rows(orgs) and rows(u) == rows(users)


def test_a_removed_org_takes_its_users_documents_and_grants(spark, users):
    docs = spark.createDataFrame([(10, "x", 1, 1, 5), (20, "y", 2, 3, 5), (30, "z", None, None, 5)], DOCS)
    shares = spark.createDataFrame([(10, 1, 3), (20, 3, 2), (20, 3, 4), (30, 4, 2)], SHARES)
    left = accounts.remove_org({"users": users, "documents": docs, "shares": shares}, spark.createDataFrame([(1,)], "org_id int"))
    assert rows(left["users"].select("user_id")) == [(None,), (3,), (4,), (5,)]
    assert rows(left["documents"].select("doc_id")) == [(20,), (30,)] and rows(left["shares"]) == [(20, 3, 4)]


def test_users_are_registered_once_and_existing_ones_refused(spark, users):
    new = spark.createDataFrame([(2, "b2", 1, True), (6, "f2", 1, False), (6, "f1", 1, False), (None, "n", 1, False)], USERS)
    out = accounts.register_user(users, new)
    assert rows(out.filter("user_id = 6")) == [(6, "f1", 1, False)] and out.count() == users.count() + 1
    assert rows(accounts.existing_users(users, new).select("user_id")) == [(2,)]


def test_only_an_admin_of_the_same_org_promotes(spark, users):
    def promoted(*wishes):
        out = accounts.promote_users(users, spark.createDataFrame(list(wishes), "caller_id long, user_id long"))
        assert out.columns == users.columns and out.count() == users.count()
        return {r.user_id for r in out.filter("is_admin").collect()} - {1, 3, 4}

    assert promoted((1, 2)) == promoted((1, 2), (1, 2), (3, 2), (None, 2), (1, None)) == {2}
    assert promoted((3, 2)) == promoted((2, 2)) == promoted((3, 5)) == set()


def test_the_last_admin_stays(spark, users):
    def admins(*ids):
        return {r.user_id for r in accounts.demote_users(users, spark.createDataFrame([(i,) for i in ids], "user_id long")).filter("is_admin").collect()}

    assert admins(1) == {1, 3, 4} and admins(3) == admins(3, 3) == {1, 4} and admins(3, 4) == {1, 3, 4} and admins(2) == {1, 3, 4}
    assert rows(accounts.demote_users(users, users.select("user_id").limit(0))) == rows(users)
    assert rows(accounts.permitted(users, spark.createDataFrame([(3, 4), (1, 4)], "caller_id long, user_id long"))) == [(4,)]


def test_a_removed_user_leaves_documents_to_the_org_without_grants(spark, users):
    docs = spark.createDataFrame([(10, "x", 1, 2, 5), (11, "x", 1, 1, 5), (12, "x", 1, None, 5)], DOCS)
    shares = spark.createDataFrame([(10, 2, 1), (11, 1, 2), (11, 2, 3), (11, 1, 4)], SHARES)
    u, d, s = accounts.remove_users(users, docs, shares, spark.createDataFrame([(2,), (2,), (99,)], "user_id long"))
    assert u.count() == users.count() - 1 and rows(d.select("doc_id", "owner_id")) == [(10, None), (11, 1), (12, None)]
    assert rows(s) == [(11, 1, 4)] and d.columns == docs.columns


def test_login_and_callers(spark, users):
    assert accounts.login_lookup(users, 2, 1).count() == 1 and accounts.login_lookup(users, 2, 2).count() == 0
    assert rows(accounts.caller_org(users, 1)) == [(1,)]
    assert accounts.caller_org(users, 2).count() == accounts.caller_org(users, 99).count() == 0


def test_sessions_open_and_close(spark, users):
    at = lambda d: datetime.datetime(2024, 1, d)
    none = spark.createDataFrame([], "user_id long, org_id int, opened_at timestamp_ntz, closed_at timestamp_ntz")
    logins = spark.createDataFrame([(1, 1, at(1)), (1, 2, at(1)), (2, 1, at(5)), (2, 1, at(5)), (9, 1, at(1)), (3, 2, None), (None, None, at(1))], "user_id long, org_id int, at timestamp_ntz")
    outs = spark.createDataFrame([(1, at(4)), (1, at(3)), (2, at(4)), (None, at(9))], "user_id long, at timestamp_ntz")
    s = accounts.close_sessions(accounts.open_sessions(none, users, logins), outs)
    assert rows(s) == [(1, 1, at(1), at(3)), (2, 1, at(5), None), (2, 1, at(5), None)]
    may = lambda who, d: accounts.session_of(s, who, F.lit(at(d)).cast("timestamp_ntz")).count()
    assert [may(1, 1), may(1, 2), may(1, 3), may(2, 4), may(2, 9), may(9, 2)] == [1, 1, 0, 0, 1, 0]
    assert rows(accounts.close_sessions(s, outs.limit(0))) == rows(s)


def test_account_info_of_a_caller(spark, users):
    at = datetime.datetime(2024, 1, 5)
    orgs = spark.createDataFrame([(1, "One"), (2, "Two")], "org_id int, org_name string")
    pay = spark.createDataFrame([(1, at, at, at, 2.0, "x"), (1, None, None, None, None, None), (3, at, at, at, 1.0, "y")], "org_id int, billed_at timestamp_ntz, period_start timestamp_ntz, period_end timestamp_ntz, amount double, status string")
    got = {r.org_id: len(r.payments) for r in accounts.account_info(orgs, pay).collect()}
    assert got == {1: 2, 2: 0}
    mine = accounts.account_info(orgs, pay, accounts.caller_org(users, 1)).collect()
    assert [r.org_id for r in mine] == [1] and accounts.account_info(orgs, pay, accounts.caller_org(users, 2)).count() == 0
    assert rows(accounts.postpone_removal(orgs, pay, False)) == [(1, True), (2, False)] and rows(accounts.postpone_removal(orgs, pay, True)) == [(1, False), (2, False)]


# documents


def test_a_repeated_upload_stays_one_document(spark):
    """Six uploads of one name, and documents without an owner, whose null is equal to a null."""
    docs = spark.createDataFrame([(1, "n", 1, None, 3)], DOCS)
    for i in range(6):
        docs = documents.upload(docs, spark.createDataFrame([(100 + i, "intro", 1, 2, 167)], DOCS))
    assert rows(docs) == [(1, "n", 1, None, 3), (105, "intro", 1, 2, 167)]
    again = documents.upload(docs, spark.createDataFrame([(2, "n", 1, None, 4), (3, "n", 1, None, 1)], DOCS))
    assert rows(again) == [(3, "n", 1, None, 1), (105, "intro", 1, 2, 167)]
    assert rows(documents.upload(docs, docs.limit(0))) == rows(docs) and rows(documents.upload(docs.limit(0), docs)) == rows(docs)


def test_access_of_owners_admins_and_grantees(spark, users):
    docs = spark.createDataFrame([(1, "a", 1, 2, 1), (2, "b", 1, None, 1), (3, "c", 2, 3, 1), (4, "d", None, None, 1)], DOCS)
    shares = spark.createDataFrame([(3, 3, 2), (3, 3, 2)], SHARES)
    own = lambda u: [r.doc_id for r in documents.list_documents(docs, shares, users, u).orderBy("doc_id").collect()]
    assert own(2) == [1, 3] and own(1) == [1, 2] and own(3) == [3] and own(99) == []
    every = docs.select("doc_id")
    may = lambda u: rows(documents.removable(docs, users, u, every))
    assert may(2) == [(1,)] and may(1) == [(1,), (2,)] and may(99) == []
    assert rows(documents.remove_documents(docs, spark.createDataFrame([(1,), (None,), (1,)], "doc_id long")).select("doc_id")) == [(2,), (3,), (4,)]


TEXTS = [(1, "abc" * 1000), (2, ""), (3, None), (4, "é😀\u0000" * 100), (5, "x")]


@pytest.mark.parametrize("block", [1, 7, 1024, 1 << 20])
def test_bodies_come_back_from_blocks(spark, block):
    docs = spark.createDataFrame([t for t in TEXTS if block > 1 or t[0] > 3], "doc_id long, text string")
    want = {i: (t or "").encode() for i, t in TEXTS}
    sized = docs.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("size_bytes"))
    chunks = documents.upload_chunks(docs, block).repartition(3, "block_no")
    assert all(r.n == max(1, math.ceil(len(want[r.doc_id]) / block)) for r in chunks.groupBy("doc_id").agg(F.count("*").alias("n")).collect())
    for body in (documents.download(sized, chunks), documents.decrypt_documents(documents.encrypt_documents(docs, KEY, block), KEY)):
        got = {r.doc_id: bytes(r.body) for r in body.collect()}
        assert got == {i: want[i] for i in got} and len(got) == docs.count()
    sealed = documents.encrypt_chunks(documents.upload_chunks(docs, block, 1), KEY)
    assert {r.doc_id: bytes(r.body) for r in documents.download(sized, documents.decrypt_chunks(sealed, KEY)).collect()} == got


def test_a_download_with_a_fault_raises_or_says_so(spark):
    docs = spark.createDataFrame([(1, "a" * 30), (2, "b" * 30), (3, "")], "doc_id long, text string")
    sized = docs.select("doc_id", F.octet_length("text").cast("long").alias("size_bytes"))
    c = documents.upload_chunks(docs, 10)
    first = F.expr("doc_id = 1 and block_no = 0")
    for bad in (c.filter(~first), c.unionByName(c.filter(first)), c.withColumn("block_no", F.when(first, 5).otherwise(F.col("block_no"))), c.filter("doc_id <> 1"), c.withColumn("block", F.when(first, F.lit(b"short")).otherwise(F.col("block"))), c.unionByName(c.filter("doc_id = 2 and block_no = 1").withColumn("doc_id", F.lit(1).cast("long")))):
        assert [(r.doc_id, r.intact, r.body is None) for r in documents.download(sized, bad, strict=False).orderBy("doc_id").collect()] == [(1, False, True), (2, True, False), (3, True, False)]
        with pytest.raises(PySparkException, match="document 1"):
            documents.download(sized, bad).collect()
    assert documents.download(sized.limit(0), c).count() == 0


def test_ciphers_open_only_as_they_were(spark):
    docs = spark.createDataFrame([(1, "a" * 40), (2, "b" * 40), (3, "")], "doc_id long, text string")
    c = {r.doc_id: [bytes(x) for x in r.cipher] for r in documents.encrypt_documents(docs, KEY, 10).collect()}
    assert [len(c[i]) for i in (1, 2, 3)] == [4, 4, 1] and all(len(x) == 38 for x in c[1])

    def opened(doc_id, cipher, key=KEY):
        df = spark.createDataFrame([(doc_id, cipher)], "doc_id long, cipher array<binary>")
        body = documents.decrypt_documents(df, key).first().body
        return None if body is None else bytes(body)

    one = c[1]
    assert opened(1, one) == b"a" * 40 and opened(3, c[3]) == b""
    flipped = [one[0][:-1] + bytes([one[0][-1] ^ 1]), *one[1:]]
    for wrong in (one[::-1], [one[1], one[0], *one[2:]], one[:-1], one[1:], one + one[:1], [c[2][0], *one[1:]], flipped, [], [None, *one[1:]]):
        assert opened(1, wrong) is None
    assert opened(2, one) is None and opened(1, one, KEY[::-1]) is None and opened(3, c[3], KEY[::-1]) is None and opened(3, []) is None


def test_a_document_of_100_mib_goes_through_blocks_and_back(spark, tmp_path):
    size, line = 100 << 20, "0123456789abcde\n"
    docs = spark.range(1).select("id", F.expr(f"repeat('{line}', cast({size // 16} + id as int))").alias("text")).withColumnRenamed("id", "doc_id")
    path = f"file://{tmp_path}/chunks"
    documents.write_chunks(documents.encrypt_chunks(documents.upload_chunks(docs, least=1), KEY).repartition(4), path)
    stored = spark.read.parquet(path)
    assert stored.count() == 100 and stored.agg(F.sum(F.octet_length("block"))).first()[0] == size + 28 * 100
    sized = spark.createDataFrame([(0, size)], "doc_id long, size_bytes long")
    got = documents.download(sized, documents.decrypt_chunks(stored, KEY)).select(F.sha2("body", 256), F.octet_length("body")).first()
    assert tuple(got) == (docs.select(F.sha2("text", 256)).first()[0], size)


def test_files_of_a_folder_are_documents(spark, tmp_path):
    bodies = {"a.txt": b"alpha", "b.txt": b"", "c.bin": os.urandom(100)}
    for name, body in bodies.items():
        (tmp_path / name).write_bytes(body)
    got = {r.doc_name: (bytes(r.body), r.size_bytes) for r in tables.raw_files(spark, str(tmp_path)).collect()}
    assert got == {k: (v, len(v)) for k, v in bodies.items() if v}
    assert tables.raw_files(spark, str(tmp_path), "*.txt").count() == 1


# sharing


def test_sharing_keeps_to_orgs_and_levels(spark, users):
    orgs = spark.createDataFrame([(1, [2], False), (2, None, True)], "org_id int, sharable_orgs array<int>, multi_level_share boolean")
    docs = spark.createDataFrame([(10, "x", 1, 1, 5), (20, "y", 2, 3, 5)], DOCS)
    none = spark.createDataFrame([], SHARES)
    wish = lambda *w: spark.createDataFrame(list(w), SHARES)
    got = sharing.share(none, wish((10, 1, 2), (10, 1, 2), (10, 1, 3), (10, 1, 1), (10, 2, 3), (20, 3, 2), (20, 3, 4), (None, 1, 2), (10, 1, 5), (99, 1, 2)), docs, users, orgs)
    assert rows(got) == [(10, 1, 2), (10, 1, 3), (20, 3, 4)]
    on = sharing.share(got, wish((20, 4, 3), (10, 2, 4), (20, 4, 4)), docs, users, orgs)
    assert rows(on) == [(10, 1, 2), (10, 1, 3), (20, 3, 4), (20, 4, 4)]
    drop = spark.createDataFrame([(10, 2), (10, 2), (99, 1)], "doc_id long, grantee_id long")
    assert rows(sharing.unshare(got, drop)) == [(10, 1, 3), (20, 3, 4)] and sharing.unshared_count(got, drop).first()[0] == 1
    assert rows(sharing.add_sharable(orgs, 2, 7).select("sharable_orgs").filter("array_contains(sharable_orgs, 7)")) == [([7],)]


def test_the_closure_goes_to_the_end_of_a_chain_and_ends_in_a_cycle(spark):
    orgs = spark.createDataFrame([(1, True), (2, False), (3, None)], "org_id int, multi_level_share boolean")
    docs = spark.createDataFrame([(1, "x", 1, 0, 5), (2, "y", 2, 0, 5), (3, "z", 3, 0, 5), (4, "n", 1, None, 5), (None, "n", 1, 0, 5)], DOCS)
    chain = [(d, i, (i + 1) % 13) for d in (1, 2, 3) for i in range(13)] + [(1, 5, 2), (1, 0, 7), (1, 0, 7), (None, 0, 1), (4, None, 1)]
    got = rows(sharing.reshare_closure(spark.createDataFrame(chain, SHARES), docs, orgs))
    level = {0: 0, 7: 1} | {i: i for i in range(1, 7)} | {i: i - 6 for i in range(8, 13)}
    assert got == sorted([(1, u, n) for u, n in level.items()] + [(2, 0, 0), (2, 1, 1), (3, 0, 0), (3, 1, 1)])
    assert max(r[2] for r in rows(sharing.reshare_closure(spark.createDataFrame(chain, SHARES), docs, orgs, 2))) == 2
    assert sharing.reshare_closure(spark.createDataFrame([], SHARES), docs.limit(0), orgs).count() == 0


def test_the_closure_sends_no_grants_to_the_driver(spark, sf_dir, monkeypatch):
    """The plans of every table that it writes broadcast orgs at most."""
    plans = []
    monkeypatch.setattr(sharing, "stored", lambda df, name: plans.append(df._jdf.queryExecution().executedPlan().toString()) or scratch.stored(df, name))
    orgs = spark.createDataFrame([(1, True)], "org_id int, multi_level_share boolean")
    docs = spark.createDataFrame([(1, "x", 1, 0, 5)], DOCS)
    assert sharing.reshare_closure(spark.createDataFrame([(1, i, i + 1) for i in range(4)], SHARES), docs, orgs).count() == 5
    assert len(plans) > 6 and not [p for p in plans if "BroadcastHashJoin" in p and "multi_level_share" not in p]
    assert "SortMergeJoin" in (plan := tables.shares(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()) and plan.count("BroadcastHashJoin") <= 2


# search


INTRO = [(1, "With security in mind: SECURITY first."), (2, "the 2nd Document, with İstanbul"), (3, None), (4, ""), (5, "security")]


def test_queries_are_text(spark):
    docs = spark.createDataFrame(INTRO, "doc_id long, text string")
    found = lambda q, mode="all": {r.doc_id: r.score for r in search.search(docs, q, mode).collect()}
    assert found("security") == found("Security, SECURITY") == found(["security", "Security"]) and set(found("security")) == {1, 5}
    assert set(found("With security")) == {1} and set(found("with security", "any")) == {1, 2, 5} and set(found("İstanbul")) == {2}
    assert found("") == found("?!", "any") == found("absent") == {}
    assert {r.doc_id: r.score for r in search.search(docs.limit(0), "a").collect()} == {}
    with pytest.raises(ValueError):
        search.search(docs, "a", "none")


def test_an_index_gives_what_a_scan_gives_through_changes(spark):
    path, docs = scratch.folder(spark, "index"), dict(INTRO)
    frame = lambda rows: spark.createDataFrame(list(rows), "doc_id long, text string")
    assert search.search_index(spark, path, "security").count() == 0
    steps = [("add", INTRO), ("add", [(5, "Security guard"), (6, "with the guard")]), ("remove", [1, 1, 99, None]), ("add", [(1, "security again")]), *[("add", [(7, "intro security")])] * 6, ("remove", [7]), ("add", []), ("remove", [7, 4])]
    for what, which in steps:
        if what == "add":
            search.add_to_index(frame(which), path)
            docs |= dict(which)
        else:
            search.remove_from_index(spark.createDataFrame([(i,) for i in which], "doc_id long"), path)
            docs = {i: t for i, t in docs.items() if i not in which}
        for query, mode in (("security", "all"), ("with guard", "any"), ("the guard", "all"), ("nothing", "any"), ("", "all")):
            have = {r.doc_id: round(r.score, 9) for r in search.search_index(spark, path, query, mode).collect()}
            assert have == {r.doc_id: round(r.score, 9) for r in search.search(frame(docs.items()), query, mode).collect()}, (what, which, query)
    with pytest.raises(ValueError):
        search.add_to_index(frame([(1, "a"), (1, "b")]), path)


def test_an_index_is_read_by_term(spark):
    path = scratch.folder(spark, "index")
    search.add_to_index(spark.range(200).select(F.col("id").alias("doc_id"), F.concat_ws(" ", F.lit("the"), F.col("id").cast("string")).alias("text")), path)
    plan = search.search_index(spark, path, "the")._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[.*bucket", plan) and "In(term" in plan.replace("EqualTo(term,the)", "In(term")
    assert search.search_index(spark, path, "the").count() == 200


def test_postings_are_counted_in_their_row_and_shuffled_once(spark):
    texts = [*INTRO, (None, "b a b"), (6, " ".join(f"w{i * i % 700}" for i in range(5_000)) + " 𝒳y 𝒳y z")]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    got = search.postings(docs)
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
    cut = docs.select("doc_id", words.tokens(F.col("text")).alias("w")).collect()
    assert sorted(map(str, rows(got))) == sorted(str((t, r.doc_id, r.w.count(t), len(r.w))) for r in cut for t in set(r.w))


def test_the_tasks_that_sort_postings_grow_with_the_tokens(spark, monkeypatch):
    """Also those of documents that are replaced; no task sorts more than a bounded number of tokens' postings while there are folders to deal."""
    monkeypatch.setattr(search, "TASK", 100, raising=False)
    path = scratch.folder(spark, "index")
    docs = spark.range(300).select(F.col("id").alias("doc_id"), F.concat_ws(" ", F.lit("the"), *[(F.col("id") * k).cast("string") for k in range(1, 9)]).alias("text"))
    search.add_to_index(docs, path)
    search.remove_from_index(docs.filter("doc_id % 5 = 0").select("doc_id"), path)
    search.add_to_index(docs.filter("doc_id % 7 = 0"), path)
    files = spark.read.parquet(f"{path}/postings").select("batch", F.regexp_extract(F.input_file_name(), r"part-(\d+)", 1).alias("task")).distinct()
    tasks = {r["batch"]: r["count"] for r in files.groupBy("batch").count().collect()}
    assert len(tasks) == 2 and max(tasks.values()) > 20
    left = docs.filter("doc_id % 5 <> 0 or doc_id % 7 = 0")
    assert rows(search.search_index(spark, path, "the 84", "any").select("doc_id", F.round("score", 9))) == rows(search.search(left, "the 84", "any").select("doc_id", F.round("score", 9)))


# billing


def test_instants_and_frequencies_are_checked():
    for bad in ("yesterday", "2024-13-01", "10000-01-01", "2024-01-01' or '1", "2024-01-01T00:00:00+01:00"):
        with pytest.raises(ValueError):
            billing.instant(bad)
    with pytest.raises(ValueError):
        billing.checked("UNDEFINED")


def test_frequencies_are_half_open(spark):
    day = lambda m: datetime.datetime(2024, m, 1)
    f = spark.createDataFrame([(1, "MONTHLY", day(1)), (1, "YEARLY", day(3)), (2, "YEARLY", day(6)), (None, "MONTHLY", day(1))], "org_id int, frequency string, valid_from timestamp_ntz")
    at = lambda when: {r.org_id: r.frequency for r in billing.frequency_asof(f, when).filter("org_id is not null").collect()}
    assert at("2024-02-29 23:59:59.999999") == {1: "MONTHLY"} and at("2024-03-01") == {1: "YEARLY"} and at("2023-01-01") == {}
    assert rows(billing.own_periods(f.filter("org_id = 1"), "2024-02-10")) == [(1, day(2), day(3))]
    assert rows(billing.own_periods(f.filter("org_id = 1"), "2024-04-10")) == [(1, day(1), datetime.datetime(2025, 1, 1))]
    assert rows(billing.set_next_frequency(f.filter("org_id = 1"), 1, "MONTHLY", "2024-03-01").select("frequency", "valid_to")) == [("MONTHLY", None), ("MONTHLY", day(3))]
    assert billing.set_next_frequency(f.limit(0), 1, "MONTHLY", "2024-03-01").count() == 0
    states = {r.valid_from.month: r.state for r in billing.frequency_list(f.filter("org_id = 1"), "2024-03-01").collect()}
    assert states == {1: "past", 3: "current"}


def test_bills_with_nothing_in_them(spark, users):
    at = lambda d: datetime.datetime(2024, 1, d)
    docs = spark.createDataFrame([(1, 1, 1 << 20, at(30), None), (2, 1, None, at(1), at(2)), (3, None, 5, at(1), None), (4, 2, 1 << 20, None, None)], "doc_id long, org_id int, size_bytes long, created_at timestamp_ntz, removed_at timestamp_ntz")
    sizes = spark.createDataFrame([(1, 1 << 20)], "doc_id long, index_bytes long")
    t = spark.createDataFrame([(at(1), 1, 2.0, 0.0), (datetime.datetime(2024, 2, 1), 1, 9.0, 9.0), (at(3), None, 1.0, 1.0), (None, 1, 1.0, 1.0), (at(3), 2, None, 1.5)], "time timestamp_ntz, user_id long, incoming double, outgoing double")
    orgs = spark.createDataFrame([(1,), (2,)], "org_id int")
    p = billing.same_period(orgs, "2024-01-01", "2024-02-01")
    got = {r.org_id: r for r in billing.billing_details(docs, sizes, t, users, p).collect()}
    assert (got[1].doc_mbh, got[1].search_mbh, got[1].incoming_mb, got[1].outgoing_mb) == (48.0, 48.0, 2.0, 1.5)
    assert got[2].total_cost == 0.0 and got[2].traffic_tier == "small"
    assert got[1].total_cost == pytest.approx(0.02 * (48 + 48 + 3.5))
    assert billing.billing_details(docs, sizes, t, users, p.limit(0)).count() == 0


def test_large_traffic_needs_an_admin_and_a_frequency(spark, users):
    f = spark.createDataFrame([(1, "MONTHLY", datetime.datetime(2024, 1, 1))], "org_id int, frequency string, valid_from timestamp_ntz")
    t = spark.createDataFrame([(datetime.datetime(2024, 1, 31), 2, 300.0, 0.0), (datetime.datetime(2024, 2, 1), 2, 300.0, 0.0), (datetime.datetime(2024, 1, 3), 3, 300.0, 0.0), (datetime.datetime(2024, 1, 3), 1, 1.0, None)], "time timestamp_ntz, user_id long, incoming double, outgoing double")
    of = lambda user: billing.large_traffic_of(t, users, f, accounts.caller_org(users, user), "2024-01-15")
    assert [(r.user_id, r.period_end) for r in of(1).collect()] == [(2, datetime.datetime(2024, 2, 1))]
    assert of(2).count() == of(3).count() == 0 and of(3).columns == of(1).columns


# streaming


def test_the_stream_closes_days_in_append_mode_and_drops_late_rows(spark, tmp_path):
    def put(name, *rows):
        out = [(i, datetime.datetime(2024, 1, day, 12), 1, "view", 1.0, '{"k": 1}') for i, day in enumerate(rows)]
        spark.createDataFrame(out, schemas.EVENTS).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in/{name}")

    events = spark.readStream.schema(schemas.EVENTS).option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(f"{tmp_path}/in/*").withColumn("ts", F.col("ts").cast("timestamp"))

    def days():
        query = stream.traffic_daily(events, "1 day").writeStream.outputMode("append").trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/state").format("parquet").option("path", f"{tmp_path}/out").start()
        query.awaitTermination()
        return {r.day.day: r.n for r in spark.read.parquet(f"{tmp_path}/out").collect()}

    put("a", 1, 1, 2)
    put("b", 9)
    assert days() == {1: 2, 2: 1}
    put("c", 2, 9)
    put("d", 20)
    assert days() == {1: 2, 2: 1, 9: 2}


# conversion


def converted(spark, schema, row, want):
    df = spark.createDataFrame([row], schema)
    return convert.convert(df, T.StructType.fromDDL(want)).first()


def test_conversion_of_each_kind(spark):
    got = converted(spark, "n struct<a:int>, s string, extra int, d struct<seconds:bigint,nanos:int>, e struct<seconds:bigint,nanos:int>, l array<struct<x:int,y:int>>, m map<string,struct<x:int,y:int>>", (None, "7", 1, (1, 1999), None, None, None), "n struct<a:string>, s int, absent string, d timestamp, e timestamp, l array<struct<y:long,z:int>>, m map<string,struct<y:int>>")
    assert got.n is None and got.s == 7 and got.absent is None and got.e is None and got.l == [] and got.m == {}
    assert got.d == datetime.datetime(1970, 1, 1, 0, 0, 1, 1)
    got = converted(spark, "l array<struct<x:int,y:int>>, m map<string,struct<x:int,y:int>>, X int", ([(1, 2), None, (3, 4)], {"k": (5, 6)}, 9), "l array<struct<y:long,z:int>>, m map<string,struct<y:int>>, x int")
    assert [None if r is None else tuple(r) for r in got.l] == [(2, None), None, (4, None)] and got.m["k"].y == 6
    assert got.x is None


@pytest.mark.parametrize(("have", "want"), [("a int", "a struct<x:int>"), ("a int", "a array<int>"), ("a array<int>", "a int"), ("a struct<x:int>", "a map<string,int>"), ("a map<string,int>", "a string")])
def test_kinds_that_do_not_convert_are_refused(spark, have, want):
    with pytest.raises(TypeError):
        convert.convert(spark.createDataFrame([], have), T.StructType.fromDDL(want))


def test_a_malformed_scalar_raises(spark):
    with pytest.raises(PySparkException):
        converted(spark, "a string", ("x1",), "a int")


# folders


def test_a_cluster_without_a_shared_folder_is_refused(spark, monkeypatch):
    class Session:
        class conf:  # noqa: N801
            get = staticmethod(lambda *a: None)

        class sparkContext:  # noqa: N801
            master = "spark://host:7077"

    with pytest.raises(RuntimeError, match="share"):
        scratch.folder(Session, "x")
    Session.sparkContext.master = "local[2]"
    assert scratch.folder(Session, "x").startswith("file:///")
    scratch._made[-1].pop()

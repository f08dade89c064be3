"""The catalogue's queries in DuckDB's SQL, over the same tables."""

VIEWS = r"""
m AS (SELECT greatest(1, count(*) // 10) AS m FROM customer),
v_org AS (
  SELECT n.n_nationkey AS org_id, n.n_name AS org_name, n.n_nationkey % 2 = 0 AS multi_level_share,
    CASE WHEN n.n_nationkey % 5 = 0 THEN 'Unsubscribed' ELSE 'Subscribed' END AS status,
    coalesce((SELECT string_agg(CAST(o.n_nationkey AS varchar), ',' ORDER BY o.n_nationkey) FROM nation o
      WHERE o.n_regionkey = n.n_regionkey AND o.n_nationkey <> n.n_nationkey), '') AS sharable_orgs
  FROM nation n),
v_user AS (SELECT c_custkey AS user_id, c_name AS user_name, c_nationkey AS org_id, c_custkey % 10 = 0 AS is_admin FROM customer),
v_document AS (
  SELECT doc_id, source || '/' || CAST(doc_id AS varchar) AS doc_name, u.org_id, u.user_id AS owner_id, CAST(strlen(text) AS bigint) AS size_bytes, text,
    TIMESTAMP '2024-01-01 00:00:00' + to_hours(doc_id % 720) AS created_at,
    CASE WHEN doc_id % 11 = 0 THEN TIMESTAMP '2024-01-01 00:00:00' + to_hours(doc_id % 720) + INTERVAL 240 HOUR END AS removed_at
  FROM documents, m JOIN v_user u ON u.user_id = doc_id * 7 % m.m),
v_share AS (
  SELECT DISTINCT w.doc_id, w.grantor_id, w.grantee_id FROM (
    SELECT doc_id, doc_id * 7 % m AS grantor_id, (doc_id * 7 % m + k) % m AS grantee_id FROM documents, m, range(1, 7) t(k) WHERE doc_id % 4 = 0) w
  JOIN v_user a ON a.user_id = w.grantor_id JOIN nation na ON na.n_nationkey = a.org_id
  JOIN v_user b ON b.user_id = w.grantee_id JOIN nation nb ON nb.n_nationkey = b.org_id
  WHERE w.grantor_id <> w.grantee_id AND na.n_regionkey = nb.n_regionkey),
v_traffic AS (
  SELECT ts AS time, user_id,
    CASE WHEN event_type IN ('view', 'click') THEN 'GET' WHEN event_type = 'purchase' THEN 'POST' WHEN event_type = 'signup' THEN 'PUT' ELSE 'DELETE' END AS method,
    '/v1/' || event_type || '/' || (props ->> '$.k') AS uri,
    CASE WHEN event_type IN ('view', 'click') THEN 0.0::DOUBLE ELSE value END AS incoming,
    CASE WHEN event_type IN ('view', 'click') THEN value ELSE 0.0::DOUBLE END AS outgoing
  FROM events),
v_set AS (
  SELECT n_nationkey AS org_id, 'MONTHLY' AS frequency, TIMESTAMP '2023-01-01' AS valid_from FROM nation
  UNION ALL SELECT n_nationkey, 'YEARLY', TIMESTAMP '2024-01-15' FROM nation WHERE n_nationkey % 2 = 0
  UNION ALL SELECT n_nationkey, 'MONTHLY', TIMESTAMP '2025-01-15' FROM nation WHERE n_nationkey % 4 = 0),
v_payment AS (
  SELECT c_nationkey AS org_id, o_orderdate AS billed_at, o_totalprice AS amount,
    CASE o_orderstatus WHEN 'F' THEN 'Payment Success' WHEN 'O' THEN 'Payment Pending' ELSE 'Payment Failed' END AS status
  FROM orders JOIN customer ON o_custkey = c_custkey),
caller8 AS (SELECT * FROM v_user WHERE user_id = 8),
caller0 AS (SELECT * FROM v_user WHERE user_id = 0),
acc8 AS (SELECT doc_id FROM v_document d, caller8 c WHERE d.owner_id = c.user_id OR (c.is_admin AND d.org_id = c.org_id) UNION SELECT doc_id FROM v_share WHERE grantee_id = 8),
acc0 AS (SELECT doc_id FROM v_document d, caller0 c WHERE d.owner_id = c.user_id OR (c.is_admin AND d.org_id = c.org_id) UNION SELECT doc_id FROM v_share WHERE grantee_id = 0),
words AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) AS term FROM documents),
posting AS (SELECT term, doc_id, count(*) AS tf FROM words GROUP BY ALL),
lens AS (SELECT d.doc_id, coalesce(count(w.term), 0) AS dl FROM documents d LEFT JOIN words w USING (doc_id) GROUP BY ALL),
facts AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM lens),
bm AS (
  SELECT p.term, p.doc_id, ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl)) AS s
  FROM posting p JOIN (SELECT term, count(*) AS df FROM posting GROUP BY term) USING (term) JOIN lens USING (doc_id), facts),
isize AS (SELECT doc_id, count(term) AS n_terms, CAST(coalesce(sum(strlen(term) + 8), 0) AS bigint) AS index_bytes
  FROM documents LEFT JOIN (SELECT DISTINCT doc_id, term FROM words) USING (doc_id) GROUP BY doc_id)
"""


def tier(usage: str, field: str) -> str:
    a = {"name": ("'small'", "'medium'", "'large'"), "price": ("0.02::DOUBLE", "0.015::DOUBLE", "0.01::DOUBLE")}[field]
    return f"CASE WHEN {usage} < 100 THEN {a[0]} WHEN {usage} < 10000 THEN {a[1]} ELSE {a[2]} END"


def bill(periods: str, select: str) -> str:
    """The bill of each org of periods, SQL for (org_id, a, b)."""
    return f"""SELECT {select} FROM (SELECT *, doc_mbh * {tier("doc_mbh", "price")} AS dc, search_mbh * {tier("search_mbh", "price")} AS sc,
    (incoming_mb + outgoing_mb) * {tier("incoming_mb + outgoing_mb", "price")} AS tc,
    {tier("doc_mbh", "name")} AS doc_tier, {tier("search_mbh", "name")} AS search_tier, {tier("incoming_mb + outgoing_mb", "name")} AS traffic_tier
  FROM (SELECT p.org_id, p.a, p.b, coalesce(doc_mbh, 0) AS doc_mbh, coalesce(search_mbh, 0) AS search_mbh, coalesce(incoming_mb, 0) AS incoming_mb, coalesce(outgoing_mb, 0) AS outgoing_mb
    FROM ({periods}) p
    LEFT JOIN (SELECT org_id, sum(size_bytes / 1048576.0::DOUBLE * h) AS doc_mbh, sum(index_bytes / 1048576.0::DOUBLE * h) AS search_mbh
      FROM (SELECT d.org_id, size_bytes, index_bytes, greatest(0.0::DOUBLE, datediff('microsecond', greatest(created_at, q.a), least(coalesce(removed_at, q.b), q.b)) / 3.6e9::DOUBLE) AS h
        FROM v_document d JOIN isize USING (doc_id) JOIN ({periods}) q ON q.org_id = d.org_id) GROUP BY org_id) x ON x.org_id = p.org_id
    LEFT JOIN (SELECT u.org_id, sum(incoming) AS incoming_mb, sum(outgoing) AS outgoing_mb FROM v_traffic JOIN v_user u USING (user_id) JOIN ({periods}) q ON q.org_id = u.org_id
      WHERE time >= q.a AND time < q.b GROUP BY u.org_id) y ON y.org_id = p.org_id))"""


AMOUNTS = """round(doc_mbh, 4) AS doc_mbh, round(search_mbh, 4) AS search_mbh, round(incoming_mb, 4) AS incoming_mb, round(outgoing_mb, 4) AS outgoing_mb,
  round(dc, 4) AS doc_cost, round(sc, 4) AS search_cost, round(tc, 4) AS traffic_cost, round(dc + sc + tc, 4) AS total_cost, doc_tier, search_tier, traffic_tier"""
OWN = """SELECT org_id, CASE WHEN frequency = 'YEARLY' THEN TIMESTAMP '2024-01-01' ELSE TIMESTAMP '2024-01-01' END AS a, CASE WHEN frequency = 'YEARLY' THEN TIMESTAMP '2025-01-01' ELSE TIMESTAMP '2024-02-01' END AS b
  FROM (SELECT *, row_number() OVER (PARTITION BY org_id ORDER BY valid_from DESC) AS rn FROM v_set WHERE valid_from <= TIMESTAMP '2024-01-15') WHERE rn = 1"""

DAILY = "SELECT CAST(date_trunc('day', time) AS date) AS day, count(*) AS n, round(sum(incoming), 4) AS incoming_mb, round(sum(outgoing), 4) AS outgoing_mb FROM v_traffic GROUP BY 1"
LISTED = "SELECT doc_id, doc_name, size_bytes FROM v_document WHERE doc_id IN (SELECT doc_id FROM {})"

SESSIONS = """SELECT user_id, org_id, TIMESTAMP '2024-01-01' + to_hours(user_id % 24 + late) AS opened_at,
    CASE WHEN late = 0 AND user_id % 3 = 0 THEN TIMESTAMP '2024-01-01' + to_hours(user_id % 24 + 24)
      WHEN user_id % 5 = 0 THEN TIMESTAMP '2024-01-01' + to_hours(user_id % 24 + 72) END AS closed_at FROM v_user, (VALUES (0), (48)) t(late)"""
BODIES = "SELECT doc_id, sha256(coalesce(text, '')) AS sha256 FROM documents"
SEARCHES = {
    "single": "SELECT doc_id, round(s, 6) AS score FROM bm WHERE term = 'with'",
    "all": "SELECT doc_id, round(sum(s), 6) AS score FROM bm WHERE term IN ('the', 'with') GROUP BY doc_id HAVING count(*) = 2",
    "any": "SELECT doc_id, round(sum(s), 6) AS score FROM bm WHERE term IN ('hather', 'anat') GROUP BY doc_id",
    "topk": """SELECT doc_id, round(score, 6) AS score FROM (SELECT doc_id, sum(s) AS score FROM bm WHERE term IN ('the', 'with')
      GROUP BY doc_id HAVING count(*) = 2 ORDER BY score DESC, doc_id LIMIT 10)""",
}
#: After a removal and a replacement, on the texts that are left.
CHANGED = """SELECT doc_id, round(sum(ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl))), 6) AS score
  FROM (SELECT *, count(*) OVER (PARTITION BY term) AS df FROM (SELECT term, doc_id, tf * k AS tf, dl * k AS dl FROM posting JOIN lens USING (doc_id) JOIN left_over USING (doc_id) WHERE term IN ('with', 'anat')))
    , (SELECT count(*) AS n, avg(dl * k) AS avgdl FROM lens JOIN left_over USING (doc_id)) GROUP BY doc_id"""

SELECTS = {
    "list_users": "SELECT user_id, user_name, is_admin FROM v_user WHERE org_id = 2",
    "user_info": "SELECT * FROM v_user WHERE user_id = 8",
    "login_lookup": "SELECT user_id, org_id, is_admin FROM v_user WHERE user_id = 8 AND org_id IN (2, 5)",
    "login_sessions": f"SELECT user_id, org_id, opened_at, closed_at FROM ({SESSIONS})",
    "logout": f"""SELECT s.user_id AS caller_id, u.user_id, u.user_name, u.is_admin FROM ({SESSIONS}) s JOIN v_user u USING (org_id)
      WHERE s.user_id IN (8, 9, 10) AND opened_at <= TIMESTAMP '2024-01-02 12:00:00' AND (closed_at IS NULL OR closed_at > TIMESTAMP '2024-01-02 12:00:00')""",
    "register_org": "SELECT org_id, org_name, multi_level_share, status FROM v_org UNION ALL SELECT 100, 'ORG ONE', false, 'Created'",
    "register_org_admin": "SELECT * FROM v_user UNION ALL SELECT 1000000, 'admin of ' || n_name, 100, true FROM nation WHERE n_nationkey = 0",
    "reactivate_org": """SELECT org_id, CASE WHEN org_id = 5 THEN 'Subscribed' ELSE status END AS status,
      (SELECT count(*) FROM v_user u WHERE u.org_id = o.org_id AND is_admin) + CASE WHEN org_id = 5 THEN 1 ELSE 0 END AS admins FROM v_org o""",
    "remove_org": """SELECT 'users' AS relation, count(*) AS n FROM v_user WHERE org_id NOT IN (2, 5)
      UNION ALL SELECT 'documents', count(*) FROM v_document WHERE org_id NOT IN (2, 5)
      UNION ALL SELECT 'shares', count(*) FROM v_share WHERE doc_id NOT IN (SELECT doc_id FROM v_document WHERE org_id IN (2, 5))
        AND grantor_id NOT IN (SELECT user_id FROM v_user WHERE org_id IN (2, 5)) AND grantee_id NOT IN (SELECT user_id FROM v_user WHERE org_id IN (2, 5))
      UNION ALL SELECT 'orgs', count(*) FROM v_org WHERE org_id NOT IN (2, 5)""",
    "remove_org_postponed": "SELECT org_id, org_id IN (SELECT org_id FROM v_payment WHERE status = 'Payment Pending' AND amount > 400000) AS postponed FROM v_org",
    "register_user": """SELECT * FROM v_user UNION ALL
      SELECT user_id + 1000000, 'new ' || user_name, org_id, false FROM v_user WHERE user_id BETWEEN 5 AND 9""",
    "register_user_rejected": "SELECT user_id, user_name FROM v_user WHERE user_id < 5",
    "promote_user": "SELECT u.user_id, u.user_name, u.org_id, u.is_admin OR c.org_id = u.org_id AS is_admin FROM v_user u JOIN v_user c ON c.user_id = u.user_id - u.user_id % 10",
    "demote_user": """SELECT user_id, user_name, org_id, is_admin AND NOT (asked AND stay > 0) AS is_admin
      FROM (SELECT *, count(*) FILTER (is_admin AND NOT asked) OVER (PARTITION BY org_id) AS stay
        FROM (SELECT *, is_admin AND (org_id < 5 OR user_id < 100) AS asked FROM v_user))""",
    "remove_user": "SELECT doc_id, org_id, CASE WHEN owner_id % 9 = 8 THEN NULL ELSE owner_id END AS owner_id FROM v_document",
    "remove_user_grants": "SELECT * FROM v_share WHERE grantor_id % 9 <> 8 AND grantee_id % 9 <> 8 AND doc_id NOT IN (SELECT doc_id FROM v_document WHERE owner_id % 9 = 8)",
    "remove_user_count": "SELECT count(*) FILTER (user_id % 9 <> 8) AS users_left, count(*) FILTER (user_id % 9 = 8) AS removed FROM v_user",
    "account_info": """SELECT org_id, org_name, sharable_orgs, multi_level_share, o.status, count(p.amount) AS n_payments,
      round(coalesce(sum(p.amount ORDER BY billed_at), 0), 2) AS paid, coalesce(string_agg(DISTINCT p.status, ',' ORDER BY p.status), '') AS statuses
      FROM v_org o LEFT JOIN v_payment p USING (org_id) GROUP BY ALL""",
    "account_payments": "SELECT org_id, round(amount, 2) AS amount, billed_at, p.status FROM v_payment p JOIN caller0 c USING (org_id) WHERE is_admin",
    "account_info_caller": """SELECT CAST(o.org_id AS varchar) AS org_id, 'Enterprise' AS type, o.status, true AS no_address, multi_level_share, sharable_orgs, count(p.amount) AS n_payments,
      epoch_us(max(billed_at)) AS last_billed, epoch_us(date_trunc('month', max(billed_at)) + INTERVAL 1 MONTH) AS last_period_end
      FROM v_org o JOIN caller0 c USING (org_id) LEFT JOIN v_payment p USING (org_id) WHERE c.is_admin GROUP BY ALL""",
    "list_documents_user": LISTED.format("acc8"),
    "list_documents_admin": LISTED.format("acc0"),
    "upload_replaces": "SELECT doc_id, doc_name, owner_id, size_bytes + CASE WHEN doc_id % 3 = 0 THEN 1 ELSE 0 END AS size_bytes FROM v_document",
    "upload_chunks": """SELECT doc_id, i AS block_no, least(1024, size_bytes - i * 1024) AS n_bytes
      FROM (SELECT doc_id, size_bytes, unnest(range((size_bytes + 1023) // 1024)) AS i FROM v_document)""",
    "upload_chunks_mb": "SELECT doc_id, (size_bytes + 1048575) // 1048576 AS blocks, size_bytes AS n_bytes FROM v_document WHERE size_bytes > 0",
    "download_document": BODIES,
    "download_stored": BODIES,
    "download_guard": """SELECT doc_id, ok AS intact, CASE WHEN ok THEN sha256(coalesce(text, '')) END AS sha256
      FROM (SELECT doc_id, text, CASE WHEN doc_id % 10 IN (1, 2, 4) THEN coalesce(strlen(text), 0) = 0
          WHEN doc_id % 10 = 3 THEN NOT EXISTS (SELECT 1 FROM documents o WHERE o.doc_id = d.doc_id - 1 AND coalesce(strlen(o.text), 0) > 0) ELSE true END AS ok FROM documents d)""",
    "encrypt_roundtrip": "SELECT doc_id, sha256(coalesce(text, '')) AS sha256, CAST(n + 28 * greatest(1, (n + 1048575) // 1048576) AS bigint) AS cipher_len FROM (SELECT *, coalesce(strlen(text), 0) AS n FROM documents)",
    "encrypt_blocks": "SELECT doc_id, greatest(1, (n + 1023) // 1024) AS blocks, n + 28 * greatest(1, (n + 1023) // 1024) AS cipher_len FROM (SELECT *, coalesce(strlen(text), 0)::BIGINT AS n FROM documents)",
    "encrypt_stream": BODIES,
    "decrypt_mismatch": "SELECT a AS asked, a = 'right' AS opens, count(*) AS n FROM documents, (VALUES ('right'), ('other_id'), ('other_key')) t(a) GROUP BY a",
    "decrypt_swapped": "SELECT doc_id, coalesce(strlen(text), 0) <= 1024 AS opens FROM documents",
    "decrypt_truncated": "SELECT doc_id, false AS opens FROM documents",
    "encrypt_listed_not_stored": """SELECT d.doc_id + 10000000 AS doc_id, sha256(coalesce(d.text, '')) AS sha256, d.org_id = c.org_id OR d.owner_id = c.user_id AS listed,
      d.doc_id IN (SELECT doc_id FROM posting WHERE term = 'with') AS found, 0 AS blocks FROM v_document d, caller0 c WHERE d.doc_id % 10 = 0""",
    "remove_document": """SELECT doc_id, owner_id, (SELECT count(*) FROM v_share s WHERE s.doc_id = d.doc_id) AS grants
      FROM v_document d, caller0 c WHERE NOT (doc_id % 5 = 0 AND (owner_id = c.user_id OR c.is_admin AND d.org_id = c.org_id))""",
    "share_document": """SELECT doc_id, grantor_id, grantee_id FROM v_share UNION
      SELECT w.doc_id, w.grantor_id, w.grantee_id FROM (
        SELECT doc_id, owner_id AS grantor_id, unnest([8, 0]) AS grantee_id FROM v_document
        UNION ALL SELECT doc_id, (owner_id + 1) % m, 9 FROM v_document, m WHERE doc_id % 12 = 0) w
      JOIN v_document d USING (doc_id) JOIN v_org o USING (org_id) JOIN v_user u ON u.user_id = w.grantee_id
      WHERE (u.org_id = d.org_id OR list_contains(string_split(o.sharable_orgs, ','), CAST(u.org_id AS varchar)))
        AND (w.grantor_id = d.owner_id OR (o.multi_level_share AND EXISTS (SELECT 1 FROM v_share s WHERE s.doc_id = w.doc_id AND s.grantee_id = w.grantor_id)))
        AND w.grantee_id <> d.owner_id""",
    "unshare_document": "SELECT * FROM v_share WHERE grantee_id % 3 <> 0",
    "unshare_count": "SELECT count(DISTINCT doc_id) AS unshared FROM v_share WHERE grantee_id % 3 = 0",
    "reshare_closure": "SELECT doc_id, user_id, level FROM reach",
    "add_sharable_org": """SELECT org_id, CASE WHEN org_id = 2 THEN (SELECT string_agg(CAST(x AS varchar), ',' ORDER BY x)
      FROM (SELECT DISTINCT CAST(unnest(string_split(sharable_orgs, ',') || ['1']) AS int) AS x)) ELSE sharable_orgs END AS sharable_orgs FROM v_org""",
    "remove_sharable_org": """SELECT org_id, CASE WHEN org_id = 2 THEN array_to_string(list_filter(string_split(sharable_orgs, ','), lambda x: x <> '8'), ',') ELSE sharable_orgs END AS sharable_orgs FROM v_org""",
    "set_multi_level_sharing": "SELECT org_id, org_id = 5 OR multi_level_share AS multi_level_share FROM v_org",
    "search_single_term": SEARCHES["single"],
    "search_all_terms": SEARCHES["all"],
    "search_any_terms": SEARCHES["any"],
    "search_topk": SEARCHES["topk"],
    **{f"search_indexed_{k}": v for k, v in SEARCHES.items()},
    "search_indexed_changed": CHANGED,
    "search_access_filtered": "SELECT doc_id, round(s, 6) AS score FROM bm WHERE term = 'with' AND doc_id IN (SELECT doc_id FROM acc8)",
    "index_terms": "SELECT term, count(*) AS df, CAST(sum(tf) AS bigint) AS cf FROM posting GROUP BY term",
    "index_size": "SELECT * FROM isize",
    "billing_details": bill("SELECT org_id, TIMESTAMP '2024-01-01' AS a, TIMESTAMP '2024-02-01' AS b FROM v_org", f"org_id, {AMOUNTS}"),
    "billing_details_own_period": bill(OWN, f"org_id, a AS period_start, b AS period_end, {AMOUNTS}"),
    "billing_details_caller": bill(
        f"SELECT o.* FROM ({OWN}) o JOIN caller0 c USING (org_id) WHERE c.is_admin",
        """org_id, a AS period_start, b AS period_end, round(dc + sc + tc, 4) AS total_cost, round(doc_mbh, 4) AS documents_size, round(dc, 4) AS documents_cost, doc_tier AS documents_tier,
        round(search_mbh, 4) AS search_size, round(sc, 4) AS search_cost, search_tier, round(incoming_mb, 4) AS incoming, round(outgoing_mb, 4) AS outgoing""",
    ),
    "billing_frequency_list": """SELECT *, CASE WHEN valid_from > TIMESTAMP '2024-06-01' THEN 'next' WHEN valid_to <= TIMESTAMP '2024-06-01' THEN 'past' ELSE 'current' END AS state
      FROM (SELECT *, lead(valid_from) OVER (PARTITION BY org_id ORDER BY valid_from) AS valid_to FROM v_set)""",
    "set_next_frequency": """SELECT *, lead(valid_from) OVER (PARTITION BY org_id ORDER BY valid_from) AS valid_to
      FROM (SELECT * FROM v_set UNION ALL SELECT 4, 'YEARLY', TIMESTAMP '2024-09-01')""",
    "billing_asof": """SELECT org_id, frequency, valid_from FROM (SELECT *, row_number() OVER (PARTITION BY org_id ORDER BY valid_from DESC) AS rn
      FROM v_set WHERE valid_from <= TIMESTAMP '2024-01-15') WHERE rn = 1""",
    "large_traffic": "SELECT * FROM v_traffic WHERE time >= TIMESTAMP '2024-01-01' AND time < TIMESTAMP '2024-02-01' AND (incoming >= 200 OR outgoing >= 200)",
    "large_traffic_caller": """SELECT t.*, TIMESTAMP '2024-01-01' AS period_start, TIMESTAMP '2025-01-01' AS period_end FROM v_traffic t JOIN v_user u USING (user_id) JOIN caller0 c ON c.org_id = u.org_id
      WHERE c.is_admin AND time >= TIMESTAMP '2024-01-01' AND time < TIMESTAMP '2025-01-01' AND (incoming >= 100 OR outgoing >= 100)""",
    "traffic_daily": DAILY,
    "traffic_daily_stream": DAILY,
    "convert_struct": """SELECT CAST(o_orderkey AS varchar) AS id, epoch_us(date_trunc('second', o_orderdate)) + 5 AS billed_micros,
      CASE WHEN o_orderkey % 3 = 0 THEN 1::BIGINT ELSE 0::BIGINT END AS n_payments, CASE WHEN o_orderkey % 3 = 0 THEN o_totalprice END AS amount,
      true AS absent_is_null, o_orderpriority AS tag, true AS address_is_null FROM orders""",
}

REACH = """,
grants AS (SELECT doc_id, grantor_id, grantee_id FROM v_share
  UNION SELECT doc_id, grantee_id, (grantee_id + k) % m FROM v_share, m, range(1, 3) t(k)
  UNION SELECT doc_id, (owner_id + k * 3) % m, CASE WHEN k = 10 THEN owner_id ELSE (owner_id + k * 3 + 3) % m END FROM v_document, m, range(0, 11) t(k) WHERE doc_id % 12 = 0),
steps AS (SELECT g.*, d.owner_id, o.multi_level_share FROM grants g JOIN v_document d USING (doc_id) JOIN v_org o USING (org_id)),
reach(doc_id, user_id, level) USING KEY (doc_id, user_id) AS (SELECT doc_id, owner_id, 0::BIGINT FROM v_document
  UNION SELECT r.doc_id, s.grantee_id, r.level + 1 FROM reach r JOIN steps s ON s.doc_id = r.doc_id AND s.grantor_id = r.user_id
    WHERE (r.level = 0 OR s.multi_level_share) AND NOT EXISTS (SELECT 1 FROM recurring.reach k WHERE k.doc_id = s.doc_id AND k.user_id = s.grantee_id))
"""
LEFT = """,
left_over AS (SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 2 ELSE 1 END AS k FROM documents WHERE doc_id % 5 <> 0 OR doc_id % 7 = 0)
"""
MORE = {"reshare_closure": REACH, "search_indexed_changed": LEFT}


def oracle_sql() -> dict[str, str]:
    return {k: f"WITH {'RECURSIVE' if k == 'reshare_closure' else ''} {VIEWS}{MORE.get(k, '')} {v}" for k, v in SELECTS.items()}

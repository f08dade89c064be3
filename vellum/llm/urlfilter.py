"""URL filters by a temporal list join, with Spark expressions only.

A list has dated entries (key, verdict, listed_at); key is a domain or a domain with the start of a path, and each entry of a key holds from
its date to the key's next entry. Every capture is held against the entries active when it was fetched: its URL gives the keys it may match
(its host and the host's parent domains, and its host with each start of its path), an equi join on key with a range residual finds the
active entries, and the longest key decides; verdicts are block, allow, and remove, which ends an earlier entry.

Hosts are compared in lower case without a dot at their end, paths as they are, part by part, so that slashes at their end or doubled do not matter;
that holds for keys and URLs alike. An IP address, IPv6 in its brackets, has no parent domains. Queries and fragments, escapes and ports are not compared.

Only as many parent domains and path parts are made as the longest key of the list has. Distinct (url, fetched_at) are joined, so a URL that is
captured often costs once. Captures themselves are shuffled only where a sieve says that an entry may have been found for them.
The joins leave the choice of a broadcast to Spark, which measures the sides, and adaptive execution splits hot keys.

Defined results: a null URL, one without a host, a null time, and a URL that no active entry matches are not blocked; of entries of one key
with one date the verdict last in order of code points holds; entries with null parts are ignored; repeated rows get the same answer each;
entries without a host are ignored; an empty list or table is none; other columns pass through.
"""

import datetime
import itertools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellum.llm.common import fresh, named, sieve, sifted, stored

HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?(\[[^\]/?#@]*\]|[^/?#:@]*)"
ADDRESS = r"^(\[.*|[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+)$"
PATH = r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)"


def plain_host(host: Column) -> Column:
    return F.regexp_replace(F.lower(F.coalesce(host, F.lit(""))), r"\.+$", "")


def host_of(url: Column) -> Column:
    """The host in lower case without a trailing dot; empty if there is none."""
    return plain_host(F.regexp_extract(url, HOST, 1))


def parts_of(path: Column) -> Column:
    return F.filter(F.split(F.coalesce(path, F.lit("")), "/"), lambda p: p != "")


def key_of(entry: Column) -> Column:
    """A list's key in its one form: host, or host/part/part."""
    host = plain_host(F.substring_index(entry, "/", 1))
    path = F.slice(F.split(entry, "/"), F.lit(2), F.size(F.split(entry, "/")))
    return F.array_join(F.concat(F.array(host), F.filter(path, lambda p: p != "")), "/")


def intervals(entries: DataFrame) -> DataFrame:
    """key, verdict, valid_from, valid_to (null: still valid), half-open."""
    whole = entries.dropna(subset=["key", "verdict", "listed_at"]).withColumn("key", key_of(F.col("key"))).filter("substring_index(key, '/', 1) <> ''")
    once = whole.groupBy("key", F.col("listed_at").alias("valid_from")).agg(F.max("verdict").alias("verdict"))
    out = once.withColumn("valid_to", F.lead("valid_from").over(Window.partitionBy("key").orderBy("valid_from")))
    return out.filter("verdict <> 'remove'")


def keys(url: Column, labels: int, parts: int) -> Column:
    """The keys that url may match: up to labels labels of its host, and its host with up to parts parts of its path."""
    host = host_of(url)
    names = F.split(host, r"\.")
    first = F.greatest(F.lit(1), F.size(names) - labels + 1)
    parents = F.transform(F.sequence(first, F.size(names)), lambda i: F.array_join(F.slice(names, i, F.size(names)), "."))
    domains = F.when(host.rlike(ADDRESS), F.array(host)).otherwise(F.filter(parents, lambda d: d != ""))
    path = parts_of(F.regexp_extract(url, PATH, 1))
    n = F.least(F.size(path), F.lit(parts))
    starts = F.when(n > 0, F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.concat(host, F.lit("/"), F.array_join(F.slice(path, 1, i), "/")))).otherwise(F.array().cast("array<string>"))
    return F.when(host != "", F.concat(domains, starts)).otherwise(F.array().cast("array<string>"))


def judged(captures: DataFrame, entries: DataFrame, url: str = "url", fetched_at: str = "fetched_at") -> DataFrame:
    """captures with blocked, entry (the key that decided), entry_verdict and entry_from."""
    active = intervals(entries)
    most = active.agg(F.max(F.size(F.split(F.split("key", "/")[0], r"\."))).alias("labels"), F.max(F.size(F.split("key", "/")) - 1).alias("parts")).first()
    names = fresh(captures, "blocked", "entry", "entry_verdict", "entry_from")
    u, t, e, k = fresh(captures, "judged_url", "judged_at", "judged", "judged_key")
    once = captures.select(named(url).alias("u"), named(fetched_at).alias("t")).filter("u is not null and t is not null").distinct()
    asked = once.select("u", "t", F.explode(keys(F.col("u"), most["labels"] or 0, most["parts"] or 0)).alias("key"))
    hit = asked.join(active, "key").filter("valid_from <= t and (valid_to is null or t < valid_to)")
    best = hit.groupBy("u", "t").agg(F.max_by(F.struct("key", "verdict", "valid_from"), F.struct(F.length("key"), "key")).alias(e))
    best = stored(best.toDF(u, t, e), "judged")
    key, marks = F.xxhash64(named(url), named(fetched_at)), sieve(best.select(F.xxhash64(named(u), named(t)).alias(k)))
    found = sifted(captures, key, marks, True).join(best, (named(url) == named(u)) & (named(fetched_at) == named(t)), "left")
    none = sifted(captures, key, marks, False).withColumn(e, F.lit(None).cast(best.schema[e].dataType))
    out = found.select(*[named(c) for c in none.columns]).unionByName(none)
    entry = named(e)
    values = (F.coalesce(entry["verdict"] == "block", F.lit(False)), entry["key"], entry["verdict"], entry["valid_from"])
    return out.select(*[named(c) for c in captures.columns], *[v.alias(n) for n, v in zip(names, values, strict=True)])


#: Syllables of the invented hosts of the driver's pages, from which the query's list is made by rule.
STEMS = ("th", "the", "tion")
ENDS = "an at ble ed en er es he ing in ly nd nt on or ou re res rer rin sh st th than ther ti tion wh".split()
TOPS = ("com", "net", "org")


def listed() -> list[tuple[str, str, str]]:
    """(key, verdict, date): by the number of a host one of seven kinds, with capitals, dots and slashes as lists have them."""
    out = [("example.net.", "block", "2024-02-01"), ("EXAMPLE.net", "remove", "2024-02-20"), ("cheap-pills.example.com", "block", "2024-01-01"), ("/en", "block", "2024-01-01")]
    for k, (stem, end, top) in enumerate(itertools.product(STEMS, ENDS, TOPS)):
        host = f"{stem}{end}.example.{top}"
        first, later = (datetime.date(2024, 1, 1) + datetime.timedelta(days=n) for n in (k % 50, k % 50 + 25))
        kinds = (
            [(host, "block", first), (host, "remove", later)],
            [(host.upper(), "block", first), (f"blog.{host}", "allow", later)],
            [(f"{host}/EN", "block", first), (f"{host}/de", "block", later)],
            [(f"{host.title()}/en/", "block", first), (f"{host}/en", "allow", later)],
            [(f"{host}.", "block", first), (f"{host}//fr/", "allow", first)],
            [(f"www.{host}", "block", first), (f"www.{host}", "allow", later), (f"www.{host}", "remove", later)],
            [(f"{host}/en/1", "block", first), (f"m.{host}", "block", first)],
        )
        out += [(key, verdict, str(day)) for key, verdict, day in kinds[k % len(kinds)]]
    return out


FETCHED = "timestamp_ntz'2024-01-01 00:00:00' + make_interval(0, 0, 0, cast(page_id % 90 as int), cast(page_id % 24 as int), 0, 0)"


def report(pages: DataFrame) -> DataFrame:
    """The pages' URLs against listed(); the table has no times, so a page is fetched at a time that follows from its id."""
    rows = ", ".join(f"('{k}', '{v}', timestamp_ntz'{d} 00:00:00')" for k, v, d in listed())
    entries = pages.sparkSession.sql(f"SELECT * FROM VALUES {rows} AS t(key, verdict, listed_at)")
    return judged(pages.select("page_id", "url", F.expr(FETCHED).alias("fetched_at")), entries)


ORACLE = (
    r"""
WITH raw(key, verdict, valid_from) AS (VALUES """
    + ", ".join(f"('{k}', '{v}', TIMESTAMP '{d}')" for k, v, d in listed())
    + r"""),
named AS (SELECT rtrim(lower(split_part(key, '/', 1)), '.') AS host, regexp_replace(regexp_replace(substr(key, length(split_part(key, '/', 1)) + 1), '/+', '/', 'g'), '/$', '') AS path, verdict, valid_from FROM raw),
once AS (SELECT host, path, valid_from, max(verdict) AS verdict FROM named WHERE host <> '' GROUP BY ALL),
active AS (SELECT *, host || path AS key FROM (SELECT *, lead(valid_from) OVER (PARTITION BY host, path ORDER BY valid_from) AS valid_to FROM once) WHERE verdict <> 'remove'),
p AS (SELECT page_id, url, TIMESTAMP '2024-01-01 00:00:00' + to_days((page_id % 90)::INT) + to_hours(page_id % 24) AS fetched_at,
  rtrim(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]*)', 1)), '.') AS host,
  regexp_replace(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1) || '/', '/+', '/', 'g') AS path FROM pages),
h AS (SELECT page_id, max_by({'key': key, 'verdict': verdict, 'at': valid_from}, length(key)) AS e FROM p JOIN active a ON
  (CASE WHEN a.path <> '' THEN p.host = a.host AND starts_with(p.path, a.path || '/') ELSE p.host = a.host OR ends_with(p.host, '.' || a.host) END)
  AND valid_from <= fetched_at AND (valid_to IS NULL OR fetched_at < valid_to) GROUP BY page_id)
SELECT page_id, url, fetched_at, coalesce(e.verdict = 'block', false) AS blocked, e.key AS entry, e.verdict AS entry_verdict, e.at AS entry_from FROM p LEFT JOIN h USING (page_id)
"""
)

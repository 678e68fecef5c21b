"""URL filters by a temporal list join (operator 8).

List entries are dated events: on a day, a list adds or removes a pattern. Events of one (list, kind, value) in order of
time become validity intervals, each up to the next event. A capture carries its few lookup keys: every suffix of its
host by labels, and every path prefix of its URL by segments. An equality join on keys with the as-of condition
from <= fetched < until finds the entries active at fetch time; a capture is blocked when the most specific active entry
(host before domain, longer prefix before shorter) is one of a block list, an allow list winning a tie.

A key such as a top-level domain may come with a third of all captures. Keys are counted first; one that holds over
1/HOT of all lookups (at most HOT keys) is split into as many parts as its share asks for, and its intervals go to each.

Equal captures are looked up once.

Defined cases: null or unparsable URLs and null times match nothing; events without value or time are dropped; events at
the same time apply in the order remove, add; repeated events change nothing; repeated captures get results each; empty
tables give empty results; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table

HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)"
HOT = 1000
FIRST_DAY, DAYS = "2020-01-01", 1461


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), HOST, 1))


def intervals(events: DataFrame) -> DataFrame:
    """(list, policy, kind, value, valid_from, valid_until) of events(list, policy, kind, value, action, at)."""
    clean = events.where("value is not null and at is not null").select("list", "policy", "kind", "value", "action", "at").distinct()
    # one state a time: the last action that applies then
    states = clean.groupBy("list", "policy", "kind", "value", "at").agg(F.max((F.col("action") == "add").cast("int")).alias("on"))
    nxt = F.lead("at").over(Window.partitionBy("list", "policy", "kind", "value").orderBy("at"))
    return states.withColumn("valid_until", nxt).where("on = 1").select("list", "policy", "kind", "value", F.col("at").alias("valid_from"), "valid_until")


def keys(url: Column) -> Column:
    """array<struct<kind, value, rank>> that entries can match; a higher rank is more specific."""
    h = host(url)
    labels = F.split(h, r"\.")
    domains = F.transform(
        F.sequence(F.lit(1), F.size(labels)),
        lambda i: F.struct(F.when(i == 1, "host").otherwise("domain").alias("kind"), F.array_join(F.slice(labels, i, F.size(labels)), ".").alias("value"), (F.size(labels) - i + 1).alias("rank")),
    )
    whole = F.transform(F.array(h), lambda x: F.struct(F.lit("domain").alias("kind"), x.alias("value"), F.size(labels).alias("rank")))
    path = F.filter(F.split(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+([^?#]*)", 1), "/"), lambda x: x != "")
    prefixes = F.transform(
        F.sequence(F.lit(1), F.size(path)),
        lambda i: F.struct(F.lit("prefix").alias("kind"), F.concat(h, F.lit("/"), F.array_join(F.slice(path, 1, i), "/")).alias("value"), (F.lit(1000) + i).alias("rank")),
    )
    prefixes = F.when(F.size(path) > 0, prefixes).otherwise(F.array().cast("array<struct<kind:string,value:string,rank:int>>"))
    return F.when(h != "", F.concat(domains, whole, prefixes)).otherwise(F.array().cast("array<struct<kind:string,value:string,rank:int>>"))


def url_filter(captures: DataFrame, events: DataFrame) -> DataFrame:
    """(page_id, fetched_at, host, n_active, lists, blocked) for every row of captures(page_id, url, fetched_at)."""
    rows = captures.select("page_id", "url", "fetched_at").withColumn("_row", F.xxhash64("page_id", "url", "fetched_at"))
    rows = rows.groupBy("page_id", "url", "fetched_at", "_row").agg(F.count("*").alias("copies"))
    looked = rows.select("page_id", "_row", "fetched_at", F.explode(keys(F.col("url"))).alias("k")).select("page_id", "_row", "fetched_at", "k.*")
    live = intervals(events).withColumnsRenamed({"kind": "e_kind", "value": "e_value"})
    active = (F.col("valid_from") <= F.col("fetched_at")) & (F.col("valid_until").isNull() | (F.col("fetched_at") < F.col("valid_until")))
    # at most HOT keys, each with the number of its parts
    counts = looked.groupBy("value").agg(F.count("*").alias("n"))
    sums = counts.agg(F.sum("n").alias("total"))
    hot = counts.join(F.broadcast(sums)).where(F.col("n") * HOT > F.col("total")).select(F.col("value").alias("h_value"), F.ceil(F.col("n") * HOT / F.col("total")).cast("int").alias("parts"))
    hot = F.broadcast(hot)
    parts = F.coalesce("parts", F.lit(1))
    looked = looked.join(hot, F.col("value") == F.col("h_value"), "left").withColumn("part", F.pmod(F.col("_row"), parts)).drop("h_value", "parts")
    live = live.join(hot, F.col("e_value") == F.col("h_value"), "left").withColumn("e_part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("h_value", "parts")
    hits = looked.join(live, (F.col("value") == F.col("e_value")) & (F.col("kind") == F.col("e_kind")) & (F.col("part") == F.col("e_part")) & active)
    strength = F.col("rank") * 4 + (F.col("kind") == "host").cast("int") * 2 + (F.col("policy") == "allow").cast("int")
    per = hits.groupBy("page_id", "_row").agg(F.count("*").alias("n_active"), F.array_join(F.array_sort(F.collect_set("list")), ",").alias("lists"), F.max_by("policy", strength).alias("policy"))
    per = per.withColumnsRenamed({"page_id": "p_id", "_row": "p_row"})
    full = rows.join(per, F.col("page_id").eqNullSafe(F.col("p_id")) & (F.col("_row") == F.col("p_row")), "left")
    full = full.withColumn("_i", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    zero = F.lit(0).cast("long")
    return full.select("page_id", "fetched_at", host(F.col("url")).alias("host"), F.coalesce("n_active", zero).alias("n_active"), F.coalesce("lists", F.lit("")).alias("lists"), F.coalesce(F.col("policy") == "block", F.lit(False)).alias("blocked"))


def _hex(value: Column, at: int) -> Column:
    """Four hex digits of a value's MD5 as a number."""
    return F.conv(F.substring(F.md5(value), at, 4), 16, 10).cast("int")


def _day(n: Column) -> Column:
    return F.date_add(F.lit(FIRST_DAY).cast("date"), n.cast("int"))


def captures_and_events(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Captures of pages, dated by their page_id, and list events on their hosts, domains and first path segments.

    The tables hold neither, so both follow from the pages by rule: about one host in three, one domain in five and one
    prefix in four is added to a list on some day, and half of them are removed later.
    """
    captures = pages.select("page_id", "url", _day(_hex(F.col("page_id").cast("string"), 1) % DAYS).alias("fetched_at"))
    h = host(F.col("url"))
    first = F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+/([^/?#]+)", 1)
    domain = F.regexp_replace(h, r"^[^.]+\.", "")
    entry = lambda lst, policy, kind, value, n: F.struct(*(F.lit(x).alias(k) for k, x in (("list", lst), ("policy", policy), ("kind", kind))), value.alias("value"), F.lit(n).alias("one_in"))
    entries = F.array(
        entry("hosts", "block", "host", h, 3),
        entry("domains", "block", "domain", domain, 5),
        entry("trusted", "allow", "prefix", F.when(first != "", F.concat(h, F.lit("/"), first)).otherwise(F.lit("")), 4),
    )
    values = pages.select(F.explode(entries).alias("v")).select("v.*").where("value <> ''").distinct()
    name = F.concat_ws(":", "list", "value")
    chosen = values.where(_hex(name, 1) % F.col("one_in") == 0)
    added, later = _hex(name, 5) % DAYS, _hex(name, 9) % 400 + 1
    adds = chosen.select("list", "policy", "kind", "value", F.lit("add").alias("action"), _day(added).alias("at"))
    removes = chosen.where(_hex(name, 13) % 2 == 0).select("list", "policy", "kind", "value", F.lit("remove").alias("action"), _day(added + later).alias("at"))
    return captures, adds.unionByName(removes)


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter(*captures_and_events(table(spark, sf_dir, "pages")))


_H = "CAST(('0x' || substr(md5({0}), {1}, 4)) AS INTEGER)".format
ORACLE = rf"""
WITH p AS (SELECT page_id, url, lower(regexp_extract(coalesce(url, ''), '{HOST}', 1)) AS host,
                  DATE '{FIRST_DAY}' + {_H('CAST(page_id AS VARCHAR)', 1)} % {DAYS} AS fetched_at,
                  regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+/([^/?#]+)', 1) AS first,
                  list_filter(string_split(regexp_extract(coalesce(url, ''), '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+([^?#]*)', 1), '/'), lambda x: x <> '') AS path
           FROM pages),
v AS (SELECT DISTINCT * FROM (
        SELECT 'hosts' AS list, 'block' AS policy, 'host' AS kind, host AS value, 3 AS one_in FROM p
        UNION ALL SELECT 'domains', 'block', 'domain', regexp_replace(host, '^[^.]+\.', ''), 5 FROM p
        UNION ALL SELECT 'trusted', 'allow', 'prefix', host || '/' || first, 4 FROM p WHERE first <> '') WHERE value <> ''),
c AS (SELECT *, list || ':' || value AS name FROM v WHERE {_H("list || ':' || value", 1)} % one_in = 0),
e AS (SELECT list, policy, kind, value, DATE '{FIRST_DAY}' + {_H('name', 5)} % {DAYS} AS valid_from,
             CASE WHEN {_H('name', 13)} % 2 = 0 THEN DATE '{FIRST_DAY}' + ({_H('name', 5)} % {DAYS} + {_H('name', 9)} % 400 + 1) END AS valid_until
      FROM c),
l AS (SELECT page_id, host, string_split(host, '.') AS labels FROM p WHERE host <> ''),
k AS (SELECT page_id, 'host' AS kind, host AS value, len(labels) AS rank FROM l
      UNION ALL SELECT page_id, 'domain', array_to_string(labels[i:], '.'), len(labels) - i + 1
      FROM l, LATERAL (SELECT unnest(range(1, len(labels) + 1)) AS i)
      UNION ALL SELECT page_id, 'prefix', host || '/' || array_to_string(path[1:i], '/'), 1000 + i
      FROM p, LATERAL (SELECT unnest(range(1, len(path) + 1)) AS i) WHERE host <> ''),
a AS (SELECT k.page_id, count(*) AS n_active, array_to_string(list_sort(list(DISTINCT list)), ',') AS lists,
             arg_max(policy, k.rank * 4 + CAST(k.kind = 'host' AS INT) * 2 + CAST(policy = 'allow' AS INT)) AS policy
      FROM k JOIN p USING (page_id) JOIN e ON e.kind = k.kind AND e.value = k.value
           AND e.valid_from <= p.fetched_at AND (e.valid_until IS NULL OR p.fetched_at < e.valid_until) GROUP BY k.page_id)
SELECT p.page_id, p.fetched_at, p.host, coalesce(n_active, 0) AS n_active, coalesce(lists, '') AS lists, coalesce(policy = 'block', false) AS blocked
FROM p LEFT JOIN a USING (page_id)
"""

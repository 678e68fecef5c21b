"""Secret scans by corpus-wide ownership frequency (operator 1), with DataFrame functions only.

Every text is scanned in place for the base kinds (assign, access, hex) and for the looser kind "bare": long mixed
tokens that no base match covers. Values of all kinds are hashed and counted over the whole corpus by distinct
repositories and owners, with partial sums before each shuffle. A value that several owners hold is a widely copied
example; one that stays with fewer and looks live (mixed characters, high entropy, no placeholder) is a credential of
its owners. Base spans always stay; a bare span is added only if its value is owner-specific and looks live.

Defined cases: null text is empty and gives no span; null owner or repository counts as one of its own; repeated rows
give equal results each and count as documents of their own; an empty table gives an empty result; other columns are
ignored, whatever their names; doc_id may be of any type.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, written

#: Kind: (pattern, least length, what the length is of: 0 the match, 2 its second group).
BASE = {
    "assign": (r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 12, 2),
    "access": (r"AKIA[A-Z0-9]+", 18, 0),
    # runs of 16 or more are the maximal runs that are long enough: the same matches without the short ones
    "hex": (r"[0-9a-f]{16,}", 16, 0),
}
BARE = r"[A-Za-z0-9+/_=-]{20,}"
KINDS = [*BASE, "bare"]
#: A value of this many owners is a widely copied example.
COPIED_OWNERS = 3
MIN_ENTROPY = 3.0
PLACEHOLDER = r"(?i)example|sample|dummy|changeme|placeholder|your|xxxx|(.)\1{5}|01234567|12345678|abcdefgh"
BLOCK = 64


def bind(x: Column, f) -> Column:
    """f(x) with x computed once."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def running(a: Column) -> Column:
    """Sums of a[0..i-1] for each i of an array of ints: blocks first, so that it stays far from quadratic."""

    def prefix(x: Column, start: Column) -> Column:
        zero = F.struct(start.cast("long").alias("s"), F.array().cast("array<bigint>").alias("out"))
        return F.aggregate(x, zero, lambda st, v: F.struct((st["s"] + v).alias("s"), F.concat(st["out"], F.array(st["s"])).alias("out")), lambda st: st["out"])

    blocks = F.transform(F.sequence(F.lit(0), F.ceil((F.size(a) - 1) / BLOCK).cast("int")), lambda i: F.slice(a, i * BLOCK + 1, BLOCK))
    total = lambda x: F.aggregate(x, F.lit(0).cast("long"), lambda s, v: s + v)
    starts = lambda bs: prefix(F.transform(bs, total), F.lit(0))
    return bind(blocks, lambda bs: F.flatten(F.zip_with(bs, starts(bs), prefix)))


def matches(text: Column, kind: str) -> Column:
    """array<struct<start, end, kind, value>> of a text's matches: what stands between them gives their places."""
    pattern, least, group = BASE.get(kind, (BARE, 20, 0))
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    between = F.split(text, pattern, -1)
    steps = F.zip_with(between, found, lambda g, m: F.length(g) + F.coalesce(F.length(m), F.lit(0)))

    def spans(found: Column, between: Column, before: Column) -> Column:
        def one(m: Column, i: Column) -> Column:
            start = F.get(before, i) + F.length(F.get(between, i))
            value = F.regexp_extract(m, pattern, group) if group else m
            return F.struct(start.alias("start"), (start + F.length(m)).alias("end"), F.lit(KINDS.index(kind)).alias("kind"), value.alias("value"))

        return F.filter(F.transform(found, one), lambda s: F.length(s["value"]) >= least)

    whole = bind(F.struct(found.alias("f"), between.alias("g"), steps.alias("s")), lambda x: bind(F.struct(x["f"].alias("f"), x["g"].alias("g"), running(x["s"]).alias("b")), lambda y: spans(y["f"], y["g"], y["b"])))
    return F.when(text.rlike(pattern), whole).otherwise(F.array().cast("array<struct<start:bigint,end:bigint,kind:int,value:string>>"))


def live_looking(value: Column) -> Column:
    """Letters and digits, enough entropy a character, and no placeholder."""
    chars = F.split(value, "")
    share = lambda v, c: F.size(F.filter(v, lambda x: x == c)) / F.size(v)
    entropy = bind(F.filter(chars, lambda x: x != ""), lambda v: F.aggregate(F.array_distinct(v), F.lit(0.0), lambda a, c: a - share(v, c) * F.log2(share(v, c))))
    return value.rlike("[0-9]") & value.rlike("[A-Za-z]") & ~value.rlike(PLACEHOLDER) & (entropy >= MIN_ENTROPY)


def spans_text(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    one = lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))
    return F.array_join(F.transform(spans, one), ",")


def ownership(found: DataFrame, copied_owners: int = COPIED_OWNERS) -> DataFrame:
    """(value_key, n_docs, n_repos, n_owners, verdict) of found(doc_id, repo, owner, value), over all of it.

    Three nested groupings, each with partial sums: documents fold into (value, owner, repository), those into
    (value, owner), those into values. A value in a third of all rows reaches the last step as one row an owner.
    """
    key = F.sha2(F.col("value"), 256)
    repos = found.withColumn("value_key", key).groupBy("value_key", "owner", "repo").agg(F.count("*").alias("n"), F.first("value").alias("value"))
    owners = repos.groupBy("value_key", "owner").agg(F.sum("n").alias("n"), F.count("*").alias("r"), F.first("value").alias("value"))
    values = owners.groupBy("value_key").agg(F.sum("n").alias("n_docs"), F.sum("r").alias("n_repos"), F.count("*").alias("n_owners"), F.first("value").alias("value"))
    verdict = F.when(F.col("n_owners") >= copied_owners, "widely_copied").when(live_looking(F.col("value")), "owner_specific").otherwise("unclear")
    return values.select("value_key", "n_docs", "n_repos", "n_owners", verdict.alias("verdict"))


def spans_of(text: Column) -> Column:
    """struct<base, bare>: matches of a text without nulls. A bare match that touches a base match is left out."""
    base = F.array_sort(F.flatten(F.array(*(matches(text, k) for k in BASE))))
    apart = lambda bs, x: ~F.exists(bs, lambda b: (b["start"] < x["end"]) & (x["start"] < b["end"]))
    mixed = lambda x: x["value"].rlike("[0-9]") & x["value"].rlike("[A-Za-z]")
    return bind(base, lambda bs: F.struct(bs.alias("base"), F.filter(matches(text, "bare"), lambda x: mixed(x) & apart(bs, x)).alias("bare")))


def scanned(docs: DataFrame, repo: str | Column, owner: str | Column) -> DataFrame:
    """(row: all of docs' columns, uid, repo, owner, base, bare): names of docs can't clash. uid names a doc_id with its text."""
    column = lambda c: F.col(c) if isinstance(c, str) else c
    d = docs.select(F.struct(*docs.columns).alias("row"), F.xxhash64("doc_id", "text").alias("uid"), F.concat_ws("/", column(owner).cast("string"), column(repo).cast("string")).alias("repo"), column(owner).alias("owner"))
    return d.withColumn("s", spans_of(F.coalesce("row.text", F.lit("")))).select("row", "uid", "repo", "owner", "s.base", "s.bare")


def has_spans() -> Column:
    return (F.size("base") > 0) | (F.size("bare") > 0)


def judged(rows: DataFrame, copied_owners: int = COPIED_OWNERS) -> DataFrame:
    """(uid, added, owned, n_copied, n_owned) of the rows(uid, repo, owner, base, bare) that have spans.

    added: bare spans of owner-specific, live-looking values; owned: all spans of such values; n_copied and n_owned count spans.
    """
    rows = rows.where(has_spans())
    # one line a distinct value of a row, so that counts are of documents
    each = rows.select("repo", "owner", F.explode(F.array_distinct(F.transform(F.concat("base", "bare"), lambda s: s["value"]))).alias("value"))
    verdicts = ownership(each, copied_owners)
    # equal rows (same doc_id and text) share what was found
    one = rows.dropDuplicates(["uid"]).select("uid", F.explode(F.concat("base", "bare")).alias("s"))
    found = one.withColumn("value_key", F.sha2(F.col("s.value"), 256)).join(verdicts, "value_key")
    mine = F.col("verdict") == "owner_specific"
    return found.groupBy("uid").agg(
        F.array_sort(F.collect_list(F.when((F.col("s.kind") == KINDS.index("bare")) & mine, F.col("s")))).alias("added"),
        F.array_sort(F.collect_list(F.when(mine, F.col("s")))).alias("owned"),
        F.sum((F.col("verdict") == "widely_copied").cast("long")).alias("n_copied"),
        F.sum(mine.cast("long")).alias("n_owned"),
    )


def secret_scan(docs: DataFrame, repo: str | Column = "lang", owner: str | Column = "source", copied_owners: int = COPIED_OWNERS) -> DataFrame:
    """For every row of docs(doc_id, text, repo, owner): base and added spans, and how far their values are spread.

    base: array<struct<start, end, kind, value>> by start and kind; added: the same for bare spans; owned: spans of
    owner-specific values; n_copied and n_owned: spans whose value is widely copied, or owner-specific and live-looking.
    """
    # texts are scanned once; what goes on has spans only
    rows = written(scanned(docs, repo, owner).select(F.col("row.doc_id").alias("doc_id"), "uid", "repo", "owner", "base", "bare"))
    found = rows.join(judged(rows, copied_owners), "uid", "left")
    none = F.array().cast("array<struct<start:bigint,end:bigint,kind:int,value:string>>")
    zero = F.lit(0).cast("long")
    return found.select("doc_id", "base", *(F.coalesce(c, none).alias(c) for c in ("added", "owned")), *(F.coalesce(c, zero).alias(c) for c in ("n_copied", "n_owned")))


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan(table(spark, sf_dir, "documents"))
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == KINDS.index(k))).cast("long").alias(f"n_{k}")
    spans = spans_text(F.array_sort(F.concat("base", "added")))
    return found.select("doc_id", *map(count, BASE), F.sha2(spans_text(F.col("base")), 256).alias("base_sha256"), spans.alias("spans"), "n_copied", "n_owned")


def redact(docs: DataFrame, mark: str = "[SECRET]", repo: str | Column = "lang", owner: str | Column = "source", copied_owners: int = COPIED_OWNERS) -> DataFrame:
    """docs with every span of an owner-specific, live-looking value replaced by mark, in the same columns.

    Widely copied examples stay. n_chars, where there is such a column, follows the new text. Only rows with spans are
    joined with what was found; the others pass as they are, null texts among them. Repeated rows are masked alike, and
    an empty table stays empty.
    """
    rows = written(scanned(docs, repo, owner))
    found = rows.where(has_spans()).join(judged(rows, copied_owners).select("uid", "owned"), "uid", "left")
    text = F.col("row.text")
    first = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"))

    def step(a: Column, s: Column) -> Column:
        gap = F.substr(text, (a["at"] + 1).cast("int"), F.greatest(s["start"] - a["at"], F.lit(0)).cast("int"))
        new = F.struct(s["end"].alias("at"), F.concat(a["out"], gap, F.lit(mark)).alias("out"))
        wider = F.struct(F.greatest(a["at"], s["end"]).alias("at"), a["out"].alias("out"))
        return F.when(s["start"] >= a["at"], new).otherwise(wider)

    clean = F.aggregate("owned", first, step, lambda a: F.concat(a["out"], F.substr(text, (a["at"] + 1).cast("int"))))
    masked = found.select("row", F.when(F.size("owned") > 0, clean).otherwise(text).alias("masked"))
    new = {"text": F.col("masked")}
    if "n_chars" in docs.columns:
        changed = F.length("masked") != F.length(text)
        new["n_chars"] = F.when(changed, F.length("masked").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("row.n_chars"))
    masked = masked.select(*(new.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns))
    return rows.where(~has_spans()).select("row.*").unionByName(masked)

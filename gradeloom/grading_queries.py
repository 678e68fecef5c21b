"""Queries that grade with a rubric, build features, plans and records, and prepare data sets. See queries."""

from __future__ import annotations

from functools import cache
from pathlib import Path

from pyspark.sql import functions as F

from gradeloom.functions import features as lists
from gradeloom.functions import pii, prompts, records, text
from gradeloom.operators import agreement, dedup, evaluation, joins, sampling
from gradeloom.plans import features, workflow
from gradeloom.plans.grader import level_name
from gradeloom.plans.rules import apply_rules, weighted_total
from gradeloom.queries import METRICS, RATINGS, query, ratings, read, rounded
from gradeloom.sources.rubrics import Rubric, load_rubric

#: The rubric of these queries; its SQL below was written from the file.
RUBRIC = Path(__file__).resolve().parent.parent / "rubrics" / "example.json"


@cache
def example() -> Rubric:
    return load_rubric(RUBRIC)


# --- grading ---------------------------------------------------------------------------------------------------------

_NEAREST = "(SELECT arg_min(v, (abs(v - {0}), v)) FROM (VALUES {1}) t(v))".format


@query(rf"""WITH d AS (SELECT doc_id, len(regexp_extract_all(coalesce(text, ''), '[^\s]+')) AS n_words, least(4.0::DOUBLE, coalesce(n_chars, 0) / 700) AS c, doc_id % 4 * 1.1::DOUBLE AS a, CASE WHEN doc_id % 9 <> 0 THEN doc_id % 5 / 2 END AS s,
  doc_id % 7 / 10 AS prompt_copy_ratio, doc_id % 10 / 10 AS dup_ratio, doc_id % 11 / 50 AS spell_error_rate FROM documents),
l AS (SELECT *, {_NEAREST("c", "(0.0::DOUBLE), (1), (2), (3), (4)")} AS content, {_NEAREST("a", "(0.0::DOUBLE), (1.5), (3)")} AS argument, CASE WHEN s IS NOT NULL THEN {_NEAREST("s", "(0.0::DOUBLE), (1), (2)")} END AS style FROM d),
t AS (SELECT *, content / 4 * 0.5::DOUBLE * 10 AS tc, argument / 3 * 0.3::DOUBLE * 10 + coalesce(style, 0) / 2 * 0.2::DOUBLE * 10 AS tr FROM l),
u AS (SELECT *, round_even((tc + tr) / 0.25, 0) * 0.25 AS total, n_words < 20 AS r1, NOT n_words < 20 AND prompt_copy_ratio > 0.6::DOUBLE AS r2, NOT n_words < 20 AND n_words < 150 AS r3,
  NOT n_words < 20 AND dup_ratio >= 0.8::DOUBLE AS r4, NOT n_words < 20 AND spell_error_rate > 0.15::DOUBLE AS r5 FROM t),
v AS (SELECT *, CASE WHEN r1 THEN least(total, 0) WHEN r2 THEN tr ELSE total END AS v2 FROM u),
w AS (SELECT *, CASE WHEN r3 THEN least(v2, 5) ELSE v2 END AS v3 FROM v), x AS (SELECT *, CASE WHEN r5 THEN greatest(0.0::DOUBLE, v3 - 0.5::DOUBLE) ELSE v3 END AS v5 FROM w),
y AS (SELECT *, NOT r1 AND v5 BETWEEN 4.75 AND 5.25 AS r6 FROM x)
SELECT doc_id, content, argument, style, CASE content WHEN 4 THEN 'full' WHEN 3 THEN 'good' WHEN 2 THEN 'part' WHEN 1 THEN 'little' ELSE 'none' END AS content_level, total, round(v5, 6) AS final_total,
  array_to_string(list_sort(list_filter([CASE WHEN r1 THEN 'EMPTY' END, CASE WHEN r2 THEN 'COPIED_TASK' END, CASE WHEN r3 THEN 'SHORT' END, CASE WHEN r4 THEN 'DUPLICATE' END, CASE WHEN r5 THEN 'ERRORS' END], lambda z: z IS NOT NULL)), '|') AS flags,
  array_to_string(list_filter([CASE WHEN r1 THEN 'R1_empty' END, CASE WHEN r2 THEN 'R2_copied_task' END, CASE WHEN r3 THEN 'R3_short' END, CASE WHEN r4 THEN 'R4_duplicate' END, CASE WHEN r5 THEN 'R5_errors' END, CASE WHEN r6 THEN 'R6_border' END], lambda z: z IS NOT NULL), '|') AS applied_rules,
  r4 OR r6 AS needs_review, array_to_string(list_filter([CASE WHEN r4 THEN 'Much of the text is in another essay' END, CASE WHEN r6 THEN 'Next to the pass mark' END], lambda z: z IS NOT NULL), '; ') AS review_reason FROM y""")
def grades_by_rubric(spark, sf_dir):
    """Documents with stand-in scores, snapped to the levels of the loaded rubric, weighted, and put under its rules."""
    r, k = example(), F.col("doc_id")
    d = read(spark, sf_dir, "documents").select(
        "doc_id", F.regexp_count(F.coalesce("text", F.lit("")), F.lit(r"[^\s]+")).alias("n_words"), F.least(F.lit(4.0), F.coalesce("n_chars", F.lit(0)) / 700).alias("content"), (k % 4 * 1.1).alias("argument"), F.when(k % 9 != 0, k % 5 / 2).alias("style"),
        (k % 7 / 10).alias("prompt_copy_ratio"), (k % 10 / 10).alias("dup_ratio"), (k % 11 / 50).alias("spell_error_rate"),
    )
    d = d.withColumns({c.key: agreement.snap(F.col(c.key), c.scores) for c in r.criteria})
    total = agreement.to_step(weighted_total({c: F.col(c) for c in r.keys}, r.weights, r.scale_max), r.scale_step)
    content = r.criteria[0]
    d = d.withColumns({"total": total, "content_level": level_name([(x.name, x.score) for x in content.levels], F.col("content"))})
    found = apply_rules(d, list(r.rules), "total", r.scale_max, r.weights, {k: v for k, v in r.thresholds.items() if k.endswith("_words")})
    return found.select("doc_id", *r.keys, "content_level", "total", F.round("final_total", 6).alias("final_total"), "flags", "applied_rules", "needs_review", "review_reason")


_KEYS = "the|der; und ;;die"


@query(r"""WITH d AS (SELECT doc_id AS essay_id, coalesce(text, '') AS t, lower(coalesce(text, '')) AS l FROM documents), w AS (SELECT *, regexp_extract_all(t, '[a-zA-Z\x{C0}-\x{1EF9}]+') AS ws, regexp_extract_all(l, '[a-zA-Z\x{C0}-\x{1EF9}]+') AS ls,
  CAST(contains(l, 'the') OR contains(l, 'der') AS INT) + CAST(contains(l, 'und') AS INT) + CAST(contains(l, 'die') AS INT) AS h FROM d)
SELECT essay_id, CAST(length(t) AS DOUBLE) AS n_chars, CAST(len(ws) AS DOUBLE) AS n_words, round(CASE WHEN len(ws) > 0 THEN list_sum(list_transform(ws, lambda x: length(x))) / len(ws) ELSE 0 END, 6) AS mean_word_len,
  CAST(len(regexp_extract_all(t, '[0-9]+(?:[.,][0-9]+)*')) AS DOUBLE) AS n_numbers, round(CASE WHEN len(ls) > 0 THEN len(list_distinct(ls)) / len(ls) ELSE 0 END, 6) AS ttr, CAST(h AS DOUBLE) AS keyword_hits, 3.0::DOUBLE AS keyword_total,
  round(h / 3, 6) AS keyword_coverage, essay_id % 10 / 10 AS dup_ratio, 0.0::DOUBLE AS teencode_rate, 0.5::DOUBLE AS sim_prompt, 0.0::DOUBLE AS sim_reference FROM w""")
def essay_features(spark, sf_dir):
    """The countable columns of the whole feature plan; the others are computed with them."""
    d = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("essay_id"), "text", F.col("lang").alias("prompt_id"), F.lit(_KEYS).alias("keywords"), (F.col("doc_id") % 10 / 10).alias("dup_ratio"))
    found = features.build_features(d, "essay_id", clean=False)
    return rounded(found.select("essay_id", "n_chars", "n_words", "mean_word_len", "n_numbers", "ttr", "keyword_hits", "keyword_total", "keyword_coverage", "dup_ratio", "teencode_rate", "sim_prompt", "sim_reference"))


def _sum_of(phrases) -> str:
    """Occurrences of phrases in l, each without overlaps of its own."""
    return " + ".join("(length(l) - length(replace(l, '{0}', ''))) / {1}".format(p.replace("'", "''"), len(p)) for p in phrases)


_FAMILIES = {k: _sum_of(v) for k, v in lists.CONNECTIVES.items()}


@query(rf"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t, lower(coalesce(text, '')) AS l FROM documents),
w AS (SELECT *, len(regexp_extract_all(t, '[a-zA-Z\x{{C0}}-\x{{1EF9}}]+')) AS n, {", ".join(f"{v} AS conn_{k}" for k, v in _FAMILIES.items())} FROM d),
r AS (SELECT *, greatest(1, n) / 100 AS per FROM w)
SELECT doc_id, {", ".join(f"round(conn_{k}, 6) AS conn_{k}" for k in _FAMILIES)}, round(({" + ".join(f"conn_{k}" for k in _FAMILIES)}) / per, 6) AS connective_density,
  CAST({" + ".join(f"CAST(conn_{k} > 0 AS INT)" for k in _FAMILIES)} AS DOUBLE) AS connective_variety, round(({_sum_of(lists.ARGUMENT)}) / per, 6) AS argument_marker_density, round(({_sum_of(lists.STOCK)}) / per, 6) AS cliche_density,
  round(({_sum_of(lists.MACHINE)}) / per, 6) AS ai_style_score, round(({_sum_of(lists.CONFUSED)}) / greatest(1, n / 100), 6) AS confusion_rate, round(CASE WHEN n > 0 THEN ({_sum_of(lists.INFORMAL)}) / n ELSE 0 END, 6) AS informal_rate,
  round((len(regexp_extract_all(t, '[\x20\x09-\x0D][,.;:!?]')) + len(regexp_extract_all(t, '[,.;:][^\x20\x09-\x0D0-9]'))) / greatest(1, length(t) / 100), 6) AS punct_error_rate FROM r""")
def marker_rates(spark, sf_dir):
    """The rates of error and discourse features that don't depend on sentences."""
    d = lists.discourse(lists.errors(read(spark, sf_dir, "documents").select("doc_id", "text")))
    names = [*(f"conn_{k}" for k in lists.CONNECTIVES), "connective_density", "connective_variety", "argument_marker_density", "cliche_density", "ai_style_score", "confusion_rate", "informal_rate", "punct_error_rate"]
    return rounded(d.select("doc_id", *names))


# --- labels ----------------------------------------------------------------------------------------------------------


@query(f"""WITH {RATINGS}, c AS (SELECT essay_id, CASE WHEN essay_id % 6 <> 0 THEN gold END AS total, gold * 0.4::DOUBLE AS content, CASE WHEN confidence > 0.3 THEN pred * 0.3::DOUBLE END AS argument FROM ratings),
t AS (SELECT *, CASE WHEN count(total) OVER (PARTITION BY essay_id) > 0 THEN total ELSE coalesce(content, 0) + coalesce(argument, 0) END AS x FROM c)
SELECT essay_id, count(*) AS n_raters, round(CASE WHEN count(*) <= 2 THEN avg(x) ELSE median(x) END, 4) AS gold_total,
  CASE WHEN count(*) = 1 THEN 'single_scored' WHEN count(*) > 2 THEN 'median' WHEN max(x) - min(x) <= 1 THEN 'agreed' ELSE 'needs_adjudication' END AS status, round(max(x) - min(x), 6) AS rater_range, round(coalesce(stddev_samp(x), 0), 6) AS rater_std,
  round(avg(content), 4) AS gold_content, round(max(content) - min(content), 6) AS range_content, round(avg(argument), 4) AS gold_argument, round(coalesce(max(argument) - min(argument), 0), 6) AS range_argument, count(*) = 2 AND max(x) - min(x) > 1 AS needs_adjudication FROM t GROUP BY essay_id""")
def gold_by_criterion(spark, sf_dir):
    d = ratings(spark, sf_dir).select("essay_id", F.when(F.col("essay_id") % 6 != 0, F.col("gold")).alias("total"), (F.col("gold") * 0.4).alias("content"), F.when(F.col("confidence") > 0.3, F.col("pred") * 0.3).alias("argument"))
    return rounded(agreement.resolve(d, "essay_id", "total", method="median", criteria=("content", "argument")), "gold_total", "gold_content", "gold_argument")


@query(f"""WITH {RATINGS} SELECT exam, count(gold) AS count, round(avg(gold), 4) AS mean, round(coalesce(stddev_samp(gold), 0), 4) AS std, min(gold) AS min, max(gold) AS max FROM ratings GROUP BY exam""")
def score_by_group(spark, sf_dir):
    return workflow.score_summary(ratings(spark, sf_dir), "exam", "gold")


@query(f"""WITH {RATINGS}, b AS (SELECT split, round_even(gold / 0.25, 0) AS i, round_even(pred / 0.25, 0) AS j FROM ratings WHERE gold BETWEEN 0 AND 10 AND pred BETWEEN 0 AND 10)
SELECT split, count(*) AS n, round(CASE WHEN greatest(max(i), max(j)) > least(min(i), min(j)) THEN 1 - count(*) * sum((i - j) ** 2) / (count(*) * (sum(i ** 2) + sum(j ** 2)) - 2 * sum(i) * sum(j)) END, 6) AS qwk FROM b GROUP BY split""")
def qwk_fixed_labels(spark, sf_dir):
    return rounded(evaluation.fixed_labels_qwk(ratings(spark, sf_dir), "gold", "pred", ("split",)))


@query(f"""WITH p AS (SELECT CAST(l_linenumber % 3 AS VARCHAR) AS experiment_id, l_orderkey AS essay_id, least(10.0::DOUBLE, l_quantity / 5 + l_tax * 10) AS pred FROM lineitem), g AS (SELECT l_orderkey AS essay_id, round(avg(l_quantity / 5), 9) AS gold FROM lineitem WHERE l_orderkey % 4 <> 0 GROUP BY l_orderkey),
ratings AS (SELECT experiment_id, gold, pred FROM p JOIN g USING (essay_id)), b AS (SELECT experiment_id, round_even(gold / 0.25, 0) AS i, round_even(pred / 0.25, 0) AS j FROM ratings),
k AS (SELECT experiment_id, round(1 - count(*) * sum((i - j) ** 2) / (count(*) * (sum(i ** 2) + sum(j ** 2)) - 2 * sum(i) * sum(j)), 6) AS qwk FROM b GROUP BY experiment_id), m AS (SELECT experiment_id, {METRICS} FROM ratings GROUP BY experiment_id)
SELECT m.*, k.qwk FROM m JOIN k USING (experiment_id)""")
def ablation_metrics(spark, sf_dir):
    d = read(spark, sf_dir, "lineitem").withColumn("essay_id", F.col("l_orderkey"))
    pred = d.select((F.col("l_linenumber") % 3).cast("string").alias("experiment_id"), "essay_id", F.least(F.lit(10.0), F.col("l_quantity") / 5 + F.col("l_tax") * 10).alias("total"))
    gold = d.where("essay_id % 4 <> 0").groupBy("essay_id").agg(F.round(F.avg(F.col("l_quantity") / 5), 9).alias("gold_total"))
    return rounded(evaluation.ablation_summary(pred, gold, "essay_id", "total", "gold_total"))


# --- plans and forms -------------------------------------------------------------------------------------------------

_U = "('0x' || substr(sha256('{0}:' || {1}), 1, 12))::BIGINT / pow(16.0::DOUBLE, 12)".format
_RATERS = ["GK1", "GK2", "GK3"]
_PLAN = f"""k AS (SELECT doc_id, row_number() OVER (ORDER BY {_U("42a", "doc_id")}, doc_id) - 1 AS k, {_U("42b", "doc_id")} AS v, {_U("42", "doc_id")} AS u FROM documents), n AS (SELECT count(*) AS n FROM documents),
names AS (SELECT ['GK1', 'GK2', 'GK3'] AS names), a AS (SELECT unnest([1, 2, 3, 4, 5, 6, 7]) AS doc_id), r AS (SELECT unnest(names) AS rater_id FROM names),
anchors AS (SELECT doc_id, rater_id, row_number() OVER (PARTITION BY rater_id ORDER BY {_U("42", "(rater_id || ':' || doc_id)")}, doc_id) AS p FROM a, r),
plan AS (SELECT doc_id, names[k % 3 + 1] AS rater_id, 'primary' AS role, CAST(k // 50 AS INT) AS batch FROM k, names UNION ALL SELECT doc_id, names[(k % 3 + 1 + CAST(floor(v * 2) AS INT)) % 3 + 1], 'secondary', CAST(k // 50 AS INT) FROM k, names WHERE u < 0.25::DOUBLE
  UNION ALL SELECT doc_id, rater_id, 'anchor', -1 FROM anchors, n WHERE p <= least(7, greatest(1, CAST(floor(n * 0.05::DOUBLE / 3) AS INT))))"""


@query(f"WITH {_PLAN} SELECT * FROM plan")
def scoring_plan(spark, sf_dir):
    return sampling.scoring_plan(read(spark, sf_dir, "documents").select("doc_id"), "doc_id", _RATERS, anchors=list(range(1, 8)))


@query(f"WITH {_PLAN} SELECT doc_id, rater_id, NULL::DOUBLE AS content, '' AS content__evidence, NULL::DOUBLE AS style, '' AS style__evidence, NULL::DOUBLE AS total, '' AS flag, '' AS note, NULL::DOUBLE AS duration_sec FROM plan WHERE rater_id = 'GK2'")
def scoring_form(spark, sf_dir):
    return sampling.form_of(scoring_plan(spark, sf_dir), "doc_id", ["content", "style"], "GK2")


@query("""WITH r AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS r, count(*) OVER () AS n FROM orders) SELECT o_orderkey, CASE WHEN r > n - greatest(10, CAST(floor(n * 0.2::DOUBLE) AS BIGINT)) THEN 'test' ELSE 'train' END AS split FROM r""")
def tail_split(spark, sf_dir):
    return sampling.tail_split(read(spark, sf_dir, "orders"), [F.col("o_orderdate"), F.col("o_orderkey")]).select("o_orderkey", "split")


@query("""WITH f AS (SELECT c_nationkey, arg_min(CASE WHEN c_custkey % 4 = 0 THEN '' ELSE c_mktsegment || '; ' || c_name || ';;' END, c_custkey) AS k FROM customer GROUP BY c_nationkey)
SELECT c_nationkey, array_to_string(list_filter(list_transform(string_split(k, ';'), lambda x: trim(x)), lambda x: x <> ''), '|') AS keywords FROM f WHERE k <> ''""")
def keywords_by_prompt(spark, sf_dir):
    c = read(spark, sf_dir, "customer")
    d = c.withColumn("k", F.when(F.col("c_custkey") % 4 == 0, F.lit(None)).otherwise(F.concat("c_mktsegment", F.lit("; "), "c_name", F.lit(";;"))))
    return sampling.keyword_map(d, "c_nationkey", "k", "c_custkey").withColumn("keywords", F.array_join("keywords", "|"))


# --- joins and lookups -----------------------------------------------------------------------------------------------


@query("""SELECT d.doc_id, d.lang, d.n_chars AS n_chars_x, l.quality AS n_chars_y FROM documents d JOIN (SELECT doc_id, any_value(quality) AS quality FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id) l USING (doc_id)""")
def checked_labels(spark, sf_dir):
    labels = read(spark, sf_dir, "labels").where("doc_id is not null").groupBy("doc_id").agg(F.first("quality").alias("n_chars"))
    return joins.one_to_one(read(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars"), labels, "doc_id")


@query("""SELECT c_custkey, c_nationkey, n_name, coalesce(CAST(n_regionkey AS VARCHAR), 'none') AS region FROM customer LEFT JOIN (SELECT n_nationkey AS c_nationkey, n_name, n_regionkey FROM nation WHERE n_nationkey % 2 = 0) USING (c_nationkey)""")
def nation_lookup(spark, sf_dir):
    nations = read(spark, sf_dir, "nation").where("n_nationkey % 2 = 0").select(F.col("n_nationkey").alias("c_nationkey"), "n_name", "n_regionkey")
    return joins.lookup(read(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), nations, "c_nationkey").select("c_custkey", "c_nationkey", "n_name", F.coalesce(F.col("n_regionkey").cast("string"), F.lit("none")).alias("region"))


@query("""WITH a AS (SELECT s_suppkey, row_number() OVER (ORDER BY s_acctbal, s_suppkey) AS r FROM supplier), b AS (SELECT s_suppkey AS other, row_number() OVER (ORDER BY s_name DESC) AS r FROM supplier) SELECT s_suppkey, other FROM a JOIN b USING (r)""")
def side_by_side(spark, sf_dir):
    s = read(spark, sf_dir, "supplier")
    return joins.by_position(s.select("s_suppkey", "s_acctbal"), s.select(F.col("s_suppkey").alias("other"), "s_name"), [F.col("s_acctbal"), F.col("s_suppkey")], [F.col("s_name").desc()]).select("s_suppkey", "other")


@query("""SELECT event_id, user_id, event_type, ts FROM events WHERE user_id % 3 = 1 ORDER BY ts DESC, event_id DESC LIMIT 100""")
def latest_jobs(spark, sf_dir):
    return read(spark, sf_dir, "events").where("user_id % 3 = 1").select("event_id", "user_id", "event_type", "ts").orderBy(F.col("ts").desc(), F.col("event_id").desc()).limit(100)


# --- texts, digests, records -----------------------------------------------------------------------------------------

_COEFFICIENTS = ", ".join(f"list_min(list_transform(hs, lambda h: ({a} * h + {b}) % {dedup.PRIME}))" for a, b in zip(*dedup.coefficients(8)))


@query(rf"""WITH d AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\pL\pN_]+') AS ws FROM documents),
s AS (SELECT doc_id, CASE WHEN len(ws) > 0 THEN list_transform(range(1, greatest(len(ws) - 4, 1) + 1), lambda i: ('0x' || substr(md5(array_to_string(ws[i:i + 4], ' ')), 1, 8))::BIGINT) ELSE [] END AS hs FROM d)
SELECT doc_id, array_to_string(list_transform([{_COEFFICIENTS}], lambda x: coalesce(x, {dedup.PRIME})), ',') AS signature FROM s""")
def minhash_signatures(spark, sf_dir):
    d = read(spark, sf_dir, "documents")
    return d.select("doc_id", F.array_join(dedup.signature(dedup.word_shingles(F.coalesce("text", F.lit(""))), 8), ",").alias("signature"))


@query(r"""WITH d AS (SELECT doc_id, regexp_replace(replace(nfc_normalize(coalesce(text, '')), chr(0), ''), '\r\n?', chr(10), 'g') AS t FROM documents),
l AS (SELECT doc_id, array_to_string(list_transform(string_split(t, chr(10)), lambda x: trim(regexp_replace(x, '[ \t]+', ' ', 'g'))), chr(10)) AS t FROM d)
SELECT doc_id, trim(regexp_replace(t, '\n{3,}', chr(10) || chr(10), 'g'), chr(10) || ' ') AS text FROM l""")
def normalized_answers(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", text.normalize_answer(F.coalesce("text", F.lit(""))).alias("text"))


_SECRET = b"a secret of over sixty-four bytes, which is hashed before it is used as a key"


def _pad(x: int) -> str:
    import hashlib

    key = hashlib.sha256(_SECRET).digest().ljust(64, b"\0")
    return "'" + "".join(f"\\x{b ^ x:02X}" for b in key) + "'::BLOB"


_HMAC = f"substr(sha256({_pad(0x5C)} || unhex(sha256({_pad(0x36)} || encode('{{0}}:' || {{1}})))), 1, 16)".format


@query(rf"""WITH f AS (SELECT c_custkey, lower(CASE WHEN c_custkey % 2 = 0 THEN c_name || '_' || c_custkey || '_x' ELSE c_name END) AS file FROM customer),
n AS (SELECT *, CASE WHEN regexp_extract(file, '^[^_]+_(\d+)_', 1) <> '' THEN regexp_extract(file, '^[^_]+_(\d+)_', 1) ELSE file END AS number FROM f)
SELECT c_custkey, 'DM-' || substr({_HMAC("submission", "number")}, 1, 12) AS essay_id, 'SV-' || substr({_HMAC("student", "c_custkey")}, 1, 12) AS student_hash FROM n""")
def anonymous_ids(spark, sf_dir):
    c = read(spark, sf_dir, "customer")
    d = c.select("c_custkey", F.lower(F.when(F.col("c_custkey") % 2 == 0, F.concat("c_name", F.lit("_"), F.col("c_custkey").cast("string"), F.lit("_x"))).otherwise(F.col("c_name"))).alias("file"), F.col("c_custkey").cast("string").alias("student"))
    return pii.anonymous_ids(d, "file", "student", _SECRET.decode())[0]


@query("""WITH u AS (SELECT c_custkey, CASE WHEN c_custkey % 50 = 0 THEN NULL ELSE c_name END AS name, CASE WHEN c_custkey % 3 = 0 THEN 'short' ELSE c_name || c_name END AS t FROM customer)
SELECT name, issue FROM (SELECT name, unnest(list_filter([CASE WHEN name IS NULL THEN 'no_id' WHEN count(*) OVER (PARTITION BY name) > 1 THEN 'repeated_id' END, CASE WHEN length(t) < 20 THEN 'text_too_short' END], lambda x: x IS NOT NULL)) AS issue FROM u)
UNION ALL SELECT NULL, 'too_many_essays' FROM u HAVING count(*) > 100""")
def upload_issues(spark, sf_dir):
    c = read(spark, sf_dir, "customer")
    d = c.select(F.when(F.col("c_custkey") % 50 != 0, F.col("c_name")).alias("name"), F.when(F.col("c_custkey") % 3 == 0, "short").otherwise(F.concat("c_name", "c_name")).alias("t"))
    return records.upload_issues(d, "name", "t")


_W = prompts.WORDING


@query(f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t, source, n_chars % 41 / 4 AS gold FROM documents WHERE lang = 'en' AND doc_id % 3 <> 0)
SELECT doc_id, '{_W["system"].replace("'", "''")}' AS system, concat_ws(chr(10) || chr(10), '{_W["prompt"]}' || chr(10) || 'Write.', CASE WHEN trim(source) <> '' THEN '{_W["key"]}' || chr(10) || trim(source) END, '{_W["essay"]}' || chr(10) || t,
  '{_W["answer"]}' || chr(10) || '{{"total": 7.5, "overall_comment": "...", "label_granularity": "total_only"}}') AS user, '{{"total":' || CAST(gold AS VARCHAR) || ',"overall_comment":"good","label_granularity":"total_only"}}' AS assistant FROM d""")
def total_records(spark, sf_dir):
    d = read(spark, sf_dir, "documents").select("doc_id", "text", F.lit("Write.").alias("prompt_text"), F.col("source").alias("answer_key"), (F.col("n_chars") % 41 / 4).alias("gold_total"), F.lit(" good ").alias("teacher_feedback"), F.col("lang").alias("split"), F.when(F.col("doc_id") % 3 != 0, "yes").otherwise("no").alias("training_eligible"))
    return prompts.total_records(d, "doc_id", "text", "en")


@query("""WITH r AS (SELECT doc_id, lang, source, n_chars, doc_id % 5 AS k, coalesce(text, '') AS t FROM documents), a AS (SELECT CASE WHEN k = 0 THEN 'id' || doc_id ELSE CAST(doc_id AS VARCHAR) END AS essay_id, 'De_' || (1 + doc_id % 5) AS exam_id,
  CASE k WHEN 0 THEN 'train' WHEN 1 THEN 'validation' WHEN 2 THEN 'test' WHEN 3 THEN 'excluded_duplicate' ELSE 'unassigned' END AS split, CASE WHEN k = 3 THEN NULL ELSE n_chars % 12 * 1.0 END AS gold_total, k, doc_id FROM r)
SELECT essay_id, exam_id, split, CAST(gold_total AS DOUBLE) AS gold_total, CASE WHEN k = 2 THEN 'B' ELSE '' END AS grade_band, CASE k WHEN 1 THEN true ELSE split = 'train' AND gold_total IS NOT NULL END AS training_eligible,
  CASE WHEN k = 2 THEN doc_id % 2 = 0 ELSE split IN ('train', 'validation', 'test') AND gold_total IS NOT NULL END AS ready, CASE k WHEN 0 THEN 'a|b' WHEN 1 THEN 'x|y' WHEN 2 THEN 'p' ELSE '' END AS flags FROM a""")
def adapted_records(spark, sf_dir):
    """Records of several shapes, as JSON, read as essays."""
    k, key = F.col("doc_id") % 5, F.col("doc_id").cast("string")
    exam, score = F.concat(F.lit("Đề 0"), (1 + F.col("doc_id") % 5).cast("string")), F.col("n_chars") % 12
    body = F.coalesce("text", F.lit(""))
    shapes = [
        F.struct(F.concat(F.lit("id"), key).alias("essay_id"), body.alias("answer_text"), exam.alias("exam_code"), F.lit("train").alias("split"), F.struct(score.alias("score_10")).alias("labels"), F.array(F.lit("b"), F.lit("a")).alias("flags")),
        F.struct(key.alias("id"), F.lit("").alias("essay_id"), body.alias("essay"), exam.alias("de_thi"), F.lit("dev").alias("dataset_split"), score.cast("string").alias("score"), F.lit(" x ; y ").alias("flags"), F.struct(F.lit("yes").alias("training")).alias("eligibility")),
        F.struct(F.col("doc_id").alias("record_id"), body.alias("text"), exam.alias("exam_id"), F.lit("TEST").alias("split"), F.struct(score.alias("total"), F.lit("B").alias("grade_band")).alias("labels"), F.lit(99).alias("total"), F.create_map(F.lit("p"), F.lit("true"), F.lit("q"), F.lit("0")).alias("flags"), F.when(F.col("doc_id") % 2 == 0, "1").otherwise("0").alias("ready")),
        F.struct(F.col("doc_id").alias("submission_id"), body.alias("content"), exam.alias("test_code"), F.lit("excluded_duplicate").alias("split"), F.lit("n/a").alias("gold_total")),
        F.struct(F.col("doc_id").alias("sample_id"), body.alias("response_text"), exam.alias("exam_code_final"), score.alias("gold_total")),
    ]
    value = F.lit(None).cast("string")
    for i, s in enumerate(shapes):
        value = F.when(k == i, F.to_json(s)).otherwise(value)
    d = workflow.adapted(read(spark, sf_dir, "documents").select(value.alias("value")))
    return d.select("essay_id", "exam_id", "split", "gold_total", "grade_band", "training_eligible", "ready", F.array_join("flags", "|").alias("flags"))

"""More queries over the test tables: features, records, raters, grades, samples, retrieval, reports. See queries."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import Window
from pyspark.sql import functions as F

from gradeloom.functions import features, quality, records
from gradeloom.functions.features import CONNECTIVES, STOP_WORDS
from gradeloom.functions.text import VIETNAMESE
from gradeloom.functions.vietnamese import ABBREVIATIONS, TONED, TONELESS, count_abbreviations, expand_abbreviations, strip_tone, syllable_pattern
from gradeloom.operators import agreement, dedup, evaluation, models, resampling, retrieval, sampling, structured, traits
from gradeloom.plans import pipelines, reports
from gradeloom.queries import METRICS, ORACLES, QUERIES, RATINGS, query, ratings, read, rounded
from gradeloom.session import app_folder
from gradeloom.sources import tables
from gradeloom.streaming import submissions

_WORDS = r"regexp_extract_all(t, '[a-zA-Z\x{C0}-\x{1EF9}]+')"
_LOW = r"regexp_extract_all(lower(t), '[a-zA-Z\x{C0}-\x{1EF9}]+')"
_D = "d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents)"
_quoted = lambda xs: ", ".join("'" + x.replace("'", "''") + "'" for x in xs)


# --- features --------------------------------------------------------------------------------------------------------


# Sentences and paragraphs in SQL. RE2 has neither Unicode word bounds nor looking ahead: initials are glued in two passes,
# as neighbours share the character between them, and a control character marks where sentences end.
_BLANKS = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_EDGE = r"(^|[^\p{L}\p{M}\p{N}_])"
_CAPITAL = r"A-Z\x{C0}-\x{1EF8}"
_GLUE = lambda x: rf"regexp_replace({x}, '{_EDGE}([{_CAPITAL}])\.[\s\x{{0B}}\x{{A0}}]+', '\1\2.', 'g')"
_TIDY = lambda xs: f"list_filter(list_transform({xs}, lambda x: trim(x, {_BLANKS})), lambda x: x <> '')"
_SENTENCES = _TIDY(rf"""string_split(regexp_replace(trim({_GLUE(_GLUE("t"))}, {_BLANKS}), '([.!?…])[\x20\x09-\x0D]+([{_CAPITAL}0-9"''(])', '\1' || chr(1) || '\2', 'g'), chr(1))""")
_PARTS = f"""{_D}, parts AS (SELECT *, {_WORDS} AS ws, {_SENTENCES} AS ss, {_TIDY(r"regexp_split_to_array(t, '\n[\x20\x09-\x0D]*\n')")} AS ps,
  list_filter({_TIDY("string_split(t, chr(10))")}, lambda x: length(x) >= 15) AS ls FROM d),
p AS (SELECT *, CASE WHEN len(ps) > 1 THEN ps WHEN len(ls) > 0 THEN ls WHEN trim(t, {_BLANKS}) <> '' THEN [trim(t, {_BLANKS})] ELSE [] END AS paragraphs FROM parts)"""
_SHARE = lambda x, n: f"round(CASE WHEN {n} > 0 THEN {x} / {n} ELSE 0 END, 6)"


@query(rf"""WITH {_PARTS}, l AS (SELECT *, list_transform(ss, lambda s: CAST(len(regexp_extract_all(s, '[a-zA-Z\x{{C0}}-\x{{1EF9}}]+')) AS DOUBLE)) AS n FROM p)
SELECT doc_id, CAST(length(t) AS DOUBLE) AS n_chars, CAST(len(ws) AS DOUBLE) AS n_words, CAST(len(ss) AS DOUBLE) AS n_sentences, CAST(len(paragraphs) AS DOUBLE) AS n_paragraphs,
  round(coalesce(list_avg(n), 0), 6) AS mean_sentence_len, round(coalesce(list_stddev_pop(n), 0), 6) AS std_sentence_len, coalesce(list_max(n), 0.0::DOUBLE) AS max_sentence_len,
  {_SHARE("len(list_filter(n, lambda x: x > 40))", "len(ss)")} AS pct_long_sentences, {_SHARE("len(list_filter(n, lambda x: x < 5))", "len(ss)")} AS pct_short_sentences,
  {_SHARE("list_sum(list_transform(ws, lambda w: length(w)))", "len(ws)")} AS mean_word_len, {_SHARE("len(ws)", "len(paragraphs)")} AS words_per_paragraph, {_SHARE("len(ss)", "len(paragraphs)")} AS sentences_per_paragraph,
  CAST(len(regexp_extract_all(t, '[0-9]+(?:[.,][0-9]+)*')) AS DOUBLE) AS n_numbers,
  {_SHARE(f"(length(t) - length(translate(t, '{VIETNAMESE}{VIETNAMESE.upper()}', '')))", "(length(t) - length(regexp_replace(t, '\\pL', '', 'g')))")} AS diacritic_ratio FROM l""")
def surface_features(spark, sf_dir):
    return rounded(features.surface(read(spark, sf_dir, "documents").select("doc_id", "text")).drop("text"))


def _sum_of(phrases) -> str:
    """Occurrences of phrases in low, each without overlaps of its own."""
    return " + ".join("(length(low) - length(replace(low, '{0}', ''))) / {1}".format(p.replace("'", "''"), len(p)) for p in phrases)


_BAD = rf"list_filter(list_filter(ws, lambda w: NOT regexp_matches(w, '^\p{{Lu}}')), lambda w: NOT regexp_matches(translate(lower(w), '{TONED}', '{TONELESS}'), '{syllable_pattern()}'))"


@query(rf"""WITH {_PARTS}, c AS (SELECT *, lower(t) AS low, len({_BAD}) AS bad FROM p)
SELECT doc_id, {_SHARE("bad", "len(ws)")} AS spell_error_rate, CAST(bad AS DOUBLE) AS n_spell_errors, round(({_sum_of(features.CONFUSED)}) / greatest(1, len(ws) / 100), 6) AS confusion_rate, {_SHARE(f"({_sum_of(features.INFORMAL)})", "len(ws)")} AS informal_rate,
  {_SHARE(r"len(list_filter(ss, lambda s: regexp_matches(s, '^\p{Ll}')))", "len(ss)")} AS no_capital_sentence_rate, {_SHARE("""len(list_filter(ss, lambda s: regexp_matches(s, '[^.!?…"'')]$')))""", "len(ss)")} AS no_end_punct_rate,
  round((len(regexp_extract_all(t, '[\x20\x09-\x0D][,.;:!?]')) + len(regexp_extract_all(t, '[,.;:][^\x20\x09-\x0D0-9]'))) / greatest(1, length(t) / 100), 6) AS punct_error_rate FROM c""")
def error_features(spark, sf_dir):
    return rounded(features.errors(read(spark, sf_dir, "documents").select("doc_id", "text")).drop("text"))


_SETS = lambda xs: rf"list_transform({xs}, lambda s: list_distinct(list_filter(regexp_extract_all(lower(s), '[a-zA-Z\x{{C0}}-\x{{1EF9}}]+'), lambda w: NOT list_contains([{_quoted(STOP_WORDS)}], w))))"
_NEIGHBOURS = lambda x: f"list_transform(list_filter(list_zip({x}[1:len({x}) - 1], {x}[2:]), lambda z: len(z[1]) > 0 AND len(z[2]) > 0), lambda z: len(list_intersect(z[1], z[2])) / (len(z[1]) + len(z[2]) - len(list_intersect(z[1], z[2]))))"
_ANY = lambda x, phrases: "(" + " OR ".join(f"contains({x}, '{p}')" for p in phrases) + ")"
_CITED = " OR ".join(f"regexp_matches(t, '{p}')" for p in (
    r"\[[0-9]+\]", rf"\([{_CAPITAL}][\p{{L}}\p{{M}}\p{{N}}_.]+,?\s*[0-9]{{4}}\)",
    rf"(?i){_EDGE}(theo|dẫn theo|trích|nguồn)\s*[:\-]?\s*[{_CAPITAL}]", rf"(?i){_EDGE}(tài liệu tham khảo|danh mục tài liệu)($|[^\p{{L}}\p{{M}}\p{{N}}_])",
))


@query(rf"""WITH {_PARTS}, s AS (SELECT *, {_SETS("ss")} AS sets, {_SETS("paragraphs")} AS psets, lower(t) AS low, greatest(1, len(ws)) / 100 AS per FROM p),
o AS (SELECT *, {_NEIGHBOURS("sets")} AS so, {_NEIGHBOURS("psets")} AS po, {", ".join(f"{_sum_of(v)} AS conn_{k}" for k, v in CONNECTIVES.items())},
  CAST(coalesce({_ANY("lower(paragraphs[1])", CONNECTIVES["trinh_tu"][:4])}, false) OR len(paragraphs) >= 3 AS DOUBLE) AS has_intro, CAST(coalesce({_ANY("lower(paragraphs[-1])", CONNECTIVES["ket_luan"])}, false) AS DOUBLE) AS has_conclusion FROM s)
SELECT doc_id, {", ".join(f"round(conn_{k}, 6) AS conn_{k}" for k in CONNECTIVES)}, has_intro, has_conclusion, round(({" + ".join(f"conn_{k}" for k in CONNECTIVES)}) / per, 6) AS connective_density,
  CAST({" + ".join(f"CAST(conn_{k} > 0 AS INT)" for k in CONNECTIVES)} AS DOUBLE) AS connective_variety, round(({_sum_of(features.ARGUMENT)}) / per, 6) AS argument_marker_density, round(({_sum_of(features.STOCK)}) / per, 6) AS cliche_density,
  round(({_sum_of(features.MACHINE)}) / per, 6) AS ai_style_score, CAST({_CITED} AS DOUBLE) AS has_citation, round(coalesce(list_avg(so), 0), 6) AS sentence_overlap_mean, round(coalesce(list_min(so), 0), 6) AS sentence_overlap_min,
  round(coalesce(list_avg(po), 0), 6) AS paragraph_overlap_mean, round((has_intro + has_conclusion + least(1.0::DOUBLE, len(paragraphs) / 4)) / 3, 6) AS structure_score FROM o""")
def discourse_features(spark, sf_dir):
    return rounded(features.discourse(read(spark, sf_dir, "documents").select("doc_id", "text")).drop("text"))


@query(f"""WITH {_D}, c AS (SELECT doc_id, lower(t) AS low FROM d)
SELECT doc_id, array_to_string(list_filter([{", ".join(f"CASE WHEN contains(low, '{a}') THEN '{a} -> {b}' END" for a, b in features.CONFUSED.items())}], lambda x: x IS NOT NULL), '; ') AS confusions FROM c""")
def confusion_evidence(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", F.array_join(features.confusions(F.coalesce("text", F.lit(""))), "; ").alias("confusions"))


_LETTERS = r"regexp_replace(t, '[^\pL]', '', 'g')"


@query(rf"""WITH d AS (SELECT doc_id, trim(coalesce(text, ''), {_BLANKS}) AS t FROM documents),
w AS (SELECT *, regexp_extract_all(lower(t), '[\pL\pN_]+') AS ws, {_TIDY("string_split(lower(t), chr(10))")} AS ls, {_SENTENCES} AS ss, {_LETTERS} AS lt FROM d),
f AS (SELECT doc_id, len(ws) AS n, len(ls) AS n_lines, len(ss) AS n_ss, round(CASE WHEN len(lt) > 0 THEN (length(t) - length(translate(t, '{VIETNAMESE}{VIETNAMESE.upper()}', ''))) / length(lt) ELSE 0 END, 4) AS dia,
  round(CASE WHEN len(ws) > 0 THEN len(list_distinct(ws)) / len(ws) ELSE 0 END, 4) AS uni, round(CASE WHEN length(lt) > 0 THEN (length(t) - length(regexp_replace(t, '\p{{Lu}}', '', 'g'))) / length(lt) ELSE 0 END, 4) AS up,
  round(1 - CASE WHEN length(lt) > 0 THEN length(regexp_replace(lt, '[^a-zA-Z\x{{C0}}-\x{{1EF9}}]', '', 'g')) / length(lt) ELSE 0 END, 4) AS foreig, round(CASE WHEN len(ls) > 0 THEN 1 - len(list_distinct(ls)) / len(ls) ELSE 0 END, 4) AS rep FROM w),
r AS (SELECT doc_id, n < 20 AS r1, n > 5000 AS r2, dia < 0.05::DOUBLE AND n >= 20 AS r3, foreig > 0.3::DOUBLE AS r4, uni < 0.15::DOUBLE AND n >= 20 AS r5, NOT (dia < 0.05::DOUBLE AND n >= 20) AND dia < 0.12::DOUBLE AS f1, rep > 0.5::DOUBLE AND n_lines > 4 AS f2, up > 0.5::DOUBLE AND n > 30 AS f3, n_ss < 2 AND n >= 20 AS f4 FROM f)
SELECT doc_id, CASE WHEN r1 OR r2 OR r3 OR r4 OR r5 THEN 'reject' WHEN f1 OR f2 OR f3 OR f4 THEN 'flag' ELSE 'keep' END AS decision,
  array_to_string(list_filter([CASE WHEN r1 THEN 'too_short' END, CASE WHEN r2 THEN 'too_long' END, CASE WHEN r3 THEN 'no_diacritics' END, CASE WHEN f1 THEN 'few_diacritics' END, CASE WHEN r4 THEN 'foreign' END, CASE WHEN r5 THEN 'repeated_words' END, CASE WHEN f2 THEN 'repeated_lines' END, CASE WHEN f3 THEN 'upper_case' END, CASE WHEN f4 THEN 'no_sentences' END], lambda x: x IS NOT NULL), '|') AS reasons FROM r""")
def quality_verdicts(spark, sf_dir):
    return quality.assess(read(spark, sf_dir, "documents")).select("doc_id", "decision", "reasons")


_U = lambda bag: f"('0x' || substr(sha256('42:{bag}:' || doc_id), 1, 12))::BIGINT / pow(16.0::DOUBLE, 12)"
_TIMES = lambda u: " + ".join(f"CAST({u} >= {x}::DOUBLE AS INT)" for x in traits.POISSON)


@query(f"""WITH d AS (SELECT doc_id, CAST(length(coalesce(text, '')) AS DOUBLE) AS size, n_chars % 13 / 13 AS g FROM documents),
l AS (SELECT doc_id, size, 'quality' AS target, CAST(quality AS DOUBLE) AS y FROM d JOIN labels USING (doc_id) WHERE quality IS NOT NULL UNION ALL SELECT doc_id, size, 'remainder', g FROM d WHERE doc_id % 5 <> 0),
w AS (SELECT target, b, doc_id, size, y, CAST(CASE b {" ".join(f"WHEN {b} THEN {_TIMES(_U(b))}" for b in range(3))} END AS DOUBLE) AS w FROM l, (SELECT unnest([0, 1, 2]) AS b)),
m AS (SELECT target, b, sum(w) AS n, sum(w * size) / sum(w) AS mx, sum(w * y) / sum(w) AS my FROM w GROUP BY target, b),
s AS (SELECT target, b, any_value(n) AS n, any_value(mx) AS mx, any_value(my) AS my, sqrt(sum(w * (size - mx) * (size - mx)) / any_value(n)) AS sd FROM w JOIN m USING (target, b) GROUP BY target, b),
z AS (SELECT w.target, w.b, w.w, w.y, (size - mx) / sd AS z, n, mx, my, sd FROM w JOIN s USING (target, b)),
r AS (SELECT target, b, any_value(n) AS n, any_value(mx) AS mx, any_value(my) AS my, any_value(sd) AS sd, sum(w * z * (y - my)) AS r FROM z GROUP BY target, b),
e AS (SELECT z.target, z.b, k, sum(w * pow((y - z.my - z * r / (z.n + pow(10.0::DOUBLE, k))) / (1 - 1 / z.n - z * z / (z.n + pow(10.0::DOUBLE, k))), 2)) AS e FROM z JOIN r USING (target, b), (SELECT -3 + unnest(range(25)) / 4 AS k) GROUP BY z.target, z.b, k),
p AS (SELECT target, b, arg_min(k, (round(e, 9), k)) AS k FROM e GROUP BY target, b),
f AS (SELECT doc_id, target, my + r / (n + pow(10.0::DOUBLE, k)) * (size - mx) / sd AS p FROM d, r JOIN p USING (target, b))
SELECT doc_id, round(avg(p) FILTER (target = 'quality'), 6) AS quality, round(stddev_pop(p) FILTER (target = 'quality'), 6) AS quality__std, round(avg(p) FILTER (target = 'remainder'), 6) AS remainder, round(stddev_pop(p) FILTER (target = 'remainder'), 6) AS remainder__std FROM f GROUP BY doc_id""")
def trait_ridges(spark, sf_dir):
    """Two targets, three bags of ridges on one feature each; penalties are chosen by errors of rows left out."""
    d = read(spark, sf_dir, "documents").select("doc_id", F.length(F.coalesce("text", F.lit(""))).alias("size"), F.when(F.col("doc_id") % 5 != 0, F.col("n_chars") % 13 / 13).alias("remainder"))
    labels = read(spark, sf_dir, "labels").select(F.col("doc_id").alias("l_id"), "quality")
    rows = d.join(labels, F.col("doc_id") == F.col("l_id"), "left")
    found = traits.fit_traits(rows, "doc_id", {"quality": ["size"], "remainder": ["size"]}, bags=3, algorithm="ridge", calibrate=False)
    return rounded(traits.trait_scores(found, d, "doc_id"))


_FACTORS = lambda ws: (  # noqa: E731  runs of words that keep a type-token ratio over 0.72, and a part for the last one
    f"list_reduce(list_concat([{{'w': NULL::VARCHAR, 'f': 0.0::DOUBLE, 'seen': []::VARCHAR[], 'size': 0::BIGINT}}], list_transform({ws}, lambda w: {{'w': w, 'f': 0.0::DOUBLE, 'seen': []::VARCHAR[], 'size': 0::BIGINT}})), "
    "lambda a, x: CASE WHEN (len(a.seen) + CAST(NOT list_contains(a.seen, x.w) AS INT)) / (a.size + 1) <= 0.72::DOUBLE THEN {'w': NULL::VARCHAR, 'f': a.f + 1, 'seen': []::VARCHAR[], 'size': 0::BIGINT} "
    "ELSE {'w': NULL::VARCHAR, 'f': a.f, 'seen': CASE WHEN list_contains(a.seen, x.w) THEN a.seen ELSE list_append(a.seen, x.w) END, 'size': a.size + 1} END)"
)
_RUN = lambda a: f"({a}.f + CASE WHEN {a}.size > 0 THEN (1 - len({a}.seen) / {a}.size) / (1 - 0.72::DOUBLE) ELSE 0 END)"


@query(f"""WITH {_D}, w AS (SELECT doc_id, {_LOW} AS ws FROM d), f AS (SELECT *, {_FACTORS("ws")} AS a, {_FACTORS("list_reverse(ws)")} AS b FROM w)
SELECT doc_id, round(CASE WHEN len(ws) < 20 THEN len(list_distinct(ws)) ELSE (coalesce(len(ws) / nullif({_RUN("a")}, 0), len(ws)) + coalesce(len(ws) / nullif({_RUN("b")}, 0), len(ws))) / 2 END, 6) AS mtld FROM f""")
def vocabulary_diversity(spark, sf_dir):
    from gradeloom.functions.vietnamese import words

    return read(spark, sf_dir, "documents").select("doc_id", F.round(features.mtld(words(F.lower(F.coalesce("text", F.lit(""))))), 6).alias("mtld"))


@query(f"""WITH {_D}, w AS (SELECT doc_id, unnest({_LOW}) AS w FROM d), c AS (SELECT doc_id, w, count(*) AS c FROM w GROUP BY ALL),
a AS (SELECT doc_id, sum(c) AS n, count(*) AS types, sum(CASE WHEN w NOT IN ({_quoted(STOP_WORDS)}) THEN c ELSE 0 END) AS content,
  count(*) FILTER (w NOT IN ({_quoted(STOP_WORDS)})) AS content_types, sum(c * log2(c)) AS clogc, count(*) FILTER (c = 1) AS once, max(c) AS top, sum(CASE WHEN length(w) >= 7 THEN c ELSE 0 END) AS long FROM c GROUP BY doc_id),
h AS (SELECT doc_id, (length(t) - length(replace(lower(t), 'die', ''))) / 3 AS h FROM d)
SELECT doc_id, round(coalesce(types / n, 0), 6) AS ttr, round(coalesce(types / sqrt(n), 0), 6) AS root_ttr, round(coalesce(content / n, 0), 6) AS content_word_ratio,
  round(coalesce(content_types / greatest(content, 1), 0), 6) AS unique_content_ratio, round(coalesce(log2(n) - clogc / n, 0), 6) AS lexical_entropy, round(coalesce(once / types, 0), 6) AS hapax_ratio,
  round(coalesce(top / n, 0), 6) AS top1_word_freq, round(coalesce(long / n, 0), 6) AS long_word_ratio, round(coalesce(h / n, 0), 6) AS term_density FROM h LEFT JOIN a USING (doc_id)""")
def lexical_features(spark, sf_dir):
    return rounded(features.lexical(read(spark, sf_dir, "documents"), "doc_id", "text", ("die",)))


@query(rf"""WITH {_D}, w AS (SELECT doc_id, list_filter({_WORDS}, lambda w: NOT regexp_matches(w, '^\p{{Lu}}')) AS ws FROM d)
SELECT doc_id, CAST(len(list_filter(ws, lambda w: NOT regexp_matches(translate(lower(w), '{TONED}', '{TONELESS}'), '{syllable_pattern()}'))) AS INT) AS n_suspects FROM w""")
def syllable_check(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", F.size(features.suspects(F.coalesce("text", F.lit("")))).alias("n_suspects"))


_FULL = "MAP {" + ", ".join(f"'{a}': '{b}'" for a, b in ABBREVIATIONS.items()) + "}"


@query(rf"""WITH {_D}, p AS (SELECT doc_id, regexp_extract_all(t, '[\pL\pN_]+|[^\pL\pN_]+') AS ps FROM d)
SELECT doc_id, coalesce(array_to_string(list_transform(ps, lambda w: coalesce(CASE WHEN regexp_matches(w, '^\p{{Lu}}') THEN upper({_FULL}[lower(w)][1]) || lower({_FULL}[lower(w)][2:]) ELSE {_FULL}[lower(w)] END, w)), ''), '') AS text FROM p""")
def expanded_texts(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", expand_abbreviations(F.coalesce("text", F.lit(""))).alias("text"))


@query(rf"""WITH {_D} SELECT doc_id, CAST(len(list_filter(regexp_extract_all(lower(t), '[\pL\pN_]+'), lambda w: list_contains([{_quoted(ABBREVIATIONS)}], w))) AS INT) AS n_abbreviations,
md5(translate(lower(t), '{TONED}', '{TONELESS}')) AS toneless_md5 FROM d""")
def abbreviations(spark, sf_dir):
    t = F.coalesce("text", F.lit(""))
    return read(spark, sf_dir, "documents").select("doc_id", count_abbreviations(t).alias("n_abbreviations"), F.md5(strip_tone(F.lower(t))).alias("toneless_md5"))


_FAMILY = lambda k: " + ".join(f"(length(t) - length(replace(t, '{p}', ''))) / {len(p)}" for p in CONNECTIVES[k])


@query(f"""WITH d AS (SELECT doc_id, lower(coalesce(text, '')) AS t FROM documents) SELECT doc_id, {", ".join(f"{_FAMILY(k)} AS conn_{k}" for k in CONNECTIVES)} FROM d""")
def connectives(spark, sf_dir):
    d = features.with_markers(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return d.select("doc_id", *(F.col(f"_hits.conn_{k}").alias(f"conn_{k}") for k in CONNECTIVES))


@query("""WITH v AS (SELECT vec_id, CAST(unnest(embedding) AS DOUBLE) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings), c AS (SELECT i, avg(x) AS m FROM v GROUP BY i)
SELECT vec_id, round(sum(x * m) / sqrt(sum(x * x) * sum(m * m)), 6) AS sim_centroid FROM v JOIN c USING (i) GROUP BY vec_id""")
def centroid_similarity(spark, sf_dir):
    return rounded(features.centroid_similarity(read(spark, sf_dir, "embeddings"), "embedding").select("vec_id", "sim_centroid"))


@query(r"""WITH c AS (SELECT conv_id, turn, regexp_extract_all(lower(coalesce(text, '')), '[\pL\pN_]+') AS ws FROM conversations),
s AS (SELECT DISTINCT conv_id, turn, array_to_string(ws[i:i + 3], ' ') AS h FROM c, LATERAL (SELECT unnest(range(1, greatest(len(ws) - 3, 1) + 1)) AS i) WHERE len(ws) > 0),
n AS (SELECT conv_id, turn, count(*) AS n FROM s GROUP BY ALL), k AS (SELECT a.conv_id, a.turn, count(*) AS k FROM s a JOIN s b ON a.conv_id = b.conv_id AND a.turn = b.turn + 1 AND a.h = b.h GROUP BY ALL)
SELECT c.conv_id, c.turn, round(coalesce(k / n, 0), 4) AS copy_ratio FROM c LEFT JOIN n USING (conv_id, turn) LEFT JOIN k USING (conv_id, turn)""")
def prompt_copies(spark, sf_dir):
    c = read(spark, sf_dir, "conversations")
    before = c.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("prompt"))
    d = c.join(before, ["conv_id", "turn"], "left")
    return d.select("conv_id", "turn", F.round(dedup.prompt_copy(F.coalesce("text", F.lit("")), F.coalesce("prompt", F.lit(""))), 4).alias("copy_ratio"))


# --- records ---------------------------------------------------------------------------------------------------------

_PHRASES = {"en": ("the", "ing", "and"), "de": ("der", "sch", "und"), "es": ("ción", "que", "los")}


def _hits(ps) -> str:
    return " + ".join(f"CAST(contains(b, '{p}') AS INT)" for p in ps)


@query(rf"""WITH d AS (SELECT doc_id, lang, trim(coalesce(text, '')) AS t, trim(regexp_replace(lower(coalesce(text, '')), '\s+', ' ', 'g')) AS b FROM documents),
s AS (SELECT *, {", ".join(f"{_hits(ps)} AS {e}" for e, ps in _PHRASES.items())} FROM d),
g AS (SELECT *, greatest(en, de, es) AS hits FROM s), w AS (SELECT *, list_filter([CASE WHEN en = hits AND en > 0 THEN 'en' END, CASE WHEN de = hits AND de > 0 THEN 'de' END, CASE WHEN es = hits AND es > 0 THEN 'es' END], lambda x: x IS NOT NULL) AS ws FROM g),
i AS (SELECT *, CASE WHEN len(ws) = 1 THEN ws[1] ELSE '' END AS inferred FROM w)
SELECT doc_id, inferred, hits, CASE WHEN length(t) < 20 THEN 'empty' WHEN inferred <> '' AND hits >= 2 AND inferred <> lang THEN 'quarantined' ELSE 'keep' END AS status FROM i""")
def source_conflicts(spark, sf_dir):
    d = read(spark, sf_dir, "documents").withColumn("i", records.inferred_exam(F.col("text"), _PHRASES))
    return d.select("doc_id", F.col("i.exam").alias("inferred"), "i.hits", records.conflict_status(F.col("text"), F.col("lang"), "quarantine", _PHRASES).alias("status"))


@query(r"""WITH r AS (SELECT c_custkey, c_name, regexp_replace(lower(CASE WHEN c_custkey % 3 = 0 THEN 'De 0' || (c_custkey % 7) ELSE c_name END), '[^a-z0-9_]', '', 'g') AS raw FROM customer)
SELECT c_custkey, CASE WHEN regexp_matches(raw, '^de[0_]?[1-5]$') THEN 'De_' || right(raw, 1) WHEN regexp_extract(raw, '[1-5]') <> '' THEN 'De_' || regexp_extract(raw, '[1-5]') ELSE 'UNKNOWN' END AS exam FROM r""")
def exam_names(spark, sf_dir):
    name = F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit("De 0"), (F.col("c_custkey") % 7).cast("string"))).otherwise(F.col("c_name"))
    return read(spark, sf_dir, "customer").select("c_custkey", records.exam_name(name).alias("exam"))


@query("""WITH d AS (SELECT doc_id, trim(coalesce(text, '')) AS t, lang, source, n_chars / 1000 AS score, count(*) OVER (PARTITION BY doc_id) AS copies FROM documents),
x AS (SELECT *, list_filter([CASE WHEN copies > 1 THEN 'duplicate_essay_id' END, CASE WHEN length(t) < 20 THEN 'text_too_short' END, CASE WHEN coalesce(lang, 'UNKNOWN') = 'UNKNOWN' THEN 'unknown_exam' END,
  CASE WHEN NOT coalesce(source IN ('train', 'validation', 'test'), false) THEN 'invalid_split' END, CASE WHEN NOT coalesce(score BETWEEN 0 AND 10, false) THEN 'invalid_or_missing_score' END], lambda x: x IS NOT NULL) AS r FROM d)
SELECT doc_id, array_to_string(r, '|') AS reasons FROM x""")
def rejections(spark, sf_dir):
    d = read(spark, sf_dir, "documents").withColumn("score", F.col("n_chars") / 1000)
    return records.rejections(d, "doc_id", "text", "lang", "source", "score").select("doc_id", "reasons")


@query("""WITH i AS (SELECT l_orderkey, l_linenumber, l_suppkey, unnest([CASE WHEN l_quantity > 40 THEN {'criterion': 'l_quantity', 'issue': 'out_of_range'} END,
  CASE WHEN l_quantity NOT IN (10, 20, 30, 40) THEN {'criterion': 'l_quantity', 'issue': 'not_a_level'} END, CASE WHEN l_tax NOT IN (0, 0.02, 0.04, 0.06, 0.08) THEN {'criterion': 'l_tax', 'issue': 'not_a_level'} END]) AS i FROM lineitem)
SELECT l_orderkey, l_linenumber, l_suppkey, i.criterion AS criterion, i.issue AS issue FROM i WHERE i IS NOT NULL""")
def label_issues(spark, sf_dir):
    return records.label_issues(read(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber", "l_suppkey"], {"l_quantity": (40, [10, 20, 30, 40]), "l_tax": (1, [0, 0.02, 0.04, 0.06, 0.08])})


def _stage_sql() -> str:
    return "CASE " + " ".join(f"WHEN {' OR '.join(f"contains(f, '{w}')" for w in ws)} THEN '{s}'" for s, ws in records.STAGES.items()) + " ELSE 'other' END"


@query(f"""WITH p AS (SELECT page_id, lower(string_split(url, '/')[-1]) AS f FROM pages) SELECT page_id, {_stage_sql()} AS stage FROM p""")
def report_stages(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", records.stage_of(F.col("url")).alias("stage"))


@query("""WITH r AS (SELECT trim(string_split(unnest(string_split(p_brand || '|' || p_type || ' (x)|', '|')), '(')[1]) AS reason FROM part)
SELECT reason, count(*) AS n FROM r WHERE reason <> '' GROUP BY reason""")
def reason_counts(spark, sf_dir):
    return records.reason_counts(read(spark, sf_dir, "part").select(F.concat("p_brand", F.lit("|"), "p_type", F.lit(" (x)|")).alias("r")), "r")


@query("""SELECT event_id, CASE WHEN v <= 10 THEN round_even(v * 4, 0) / 4 END AS total FROM (SELECT event_id, CAST(regexp_extract(props, '"k": *([0-9]+)', 1) AS DOUBLE) / 8 AS v FROM events)""")
def totals_in_json(spark, sf_dir):
    k = F.regexp_extract("props", '"k": *([0-9]+)', 1).cast("double") / 8
    raw = F.concat(F.lit("{x} ["), "props", F.lit('] {"total": true} so {"total": '), k.cast("string"), F.lit("} {"))
    return read(spark, sf_dir, "events").select("event_id", records.total_in_json(raw).alias("total"))


# --- raters ----------------------------------------------------------------------------------------------------------

_CELLS = """c AS (SELECT l_orderkey AS e, l_linenumber AS r, avg(l_quantity / 5) AS x FROM lineitem GROUP BY ALL)"""
_PAIRS = f"""WITH {_CELLS}, p AS (SELECT a.r AS rater_a, b.r AS rater_b, a.x AS a, b.x AS b, round_even(a.x / 0.25, 0) AS i, round_even(b.x / 0.25, 0) AS j FROM c a JOIN c b ON a.e = b.e AND a.r < b.r),
q AS (SELECT rater_a, rater_b, count(*) AS n_common, 1 - count(*) * sum((i - j) ** 2) / (count(*) * (sum(i * i) + sum(j * j)) - 2 * sum(i) * sum(j)) AS qwk, avg(CAST(abs(a - b) <= 1 + 1e-9::DOUBLE AS INT)) AS adjacent,
  covar_pop(a, b) / (stddev_pop(a) * stddev_pop(b)) AS pearson FROM p GROUP BY ALL HAVING count(*) >= 5)"""


def _cells(spark, sf_dir):
    return read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("essay_id"), F.col("l_linenumber").alias("rater_id"), (F.col("l_quantity") / 5).alias("total"))


@query(f"{_PAIRS} SELECT rater_a, rater_b, n_common, round(qwk, 6) AS qwk, round(adjacent, 6) AS adjacent, round(pearson, 6) AS pearson FROM q")
def rater_pairs(spark, sf_dir):
    return rounded(agreement.rater_pairs(_cells(spark, sf_dir), "essay_id", "rater_id", "total"))


@query(f"{_PAIRS} SELECT count(*) AS n_pairs, round(avg(qwk), 6) AS mean_qwk, round(min(qwk), 6) AS min_qwk, round(avg(adjacent), 6) AS mean_adjacent, round(avg(pearson), 6) AS mean_pearson FROM q")
def agreement_report(spark, sf_dir):
    return rounded(agreement.agreement_report(agreement.rater_pairs(_cells(spark, sf_dir), "essay_id", "rater_id", "total")))


@query("""WITH c AS (SELECT l_orderkey AS e, l_linenumber % 3 AS r, avg(l_quantity / 5) AS x FROM lineitem GROUP BY ALL), f AS (SELECT *, count(*) OVER (PARTITION BY e) AS m, avg(x) OVER (PARTITION BY e) AS em FROM c),
k AS (SELECT CAST(count(DISTINCT r) AS DOUBLE) AS k FROM c), g AS (SELECT f.*, k, avg(x) OVER () AS gm, avg(x) OVER (PARTITION BY r) AS rm FROM f, k WHERE m = k),
n AS (SELECT CAST(count(DISTINCT e) AS DOUBLE) AS n FROM g),
s AS (SELECT n, max(k) AS k, sum((em - gm) ** 2) / (n - 1) AS msr, sum((rm - gm) ** 2) / (max(k) - 1) AS msc, sum((x - em - rm + gm) ** 2) / ((n - 1) * (max(k) - 1)) AS mse FROM g, n GROUP BY n)
SELECT CAST(n AS BIGINT) AS n_essays, CAST(k AS BIGINT) AS n_raters, round((msr - mse) / (msr + (msc - mse) / n), 6) AS icc FROM s""")
def icc(spark, sf_dir):
    cells = _cells(spark, sf_dir).withColumn("rater_id", F.col("rater_id") % 3)
    return rounded(agreement.icc(cells, "essay_id", "rater_id", "total"))


_SWEEP = lambda i: f"""t{i} AS MATERIALIZED (SELECT e, sum(s - n * beta) / sum(n) AS theta FROM c JOIN b{i} USING (r) GROUP BY e),
b{i + 1} AS MATERIALIZED (SELECT r, sum(s - n * theta) / sum(n) AS beta FROM c JOIN t{i} USING (e) GROUP BY r)"""  # noqa: E731


@query(f"""WITH {RATINGS}, g AS (SELECT essay_id AS e, rater_id AS r, count(*) AS n, sum(gold) AS s FROM ratings WHERE gold IS NOT NULL GROUP BY ALL),
c AS MATERIALIZED (SELECT e, r, n, s - n * (SELECT avg(gold) FROM ratings) AS s FROM g), b0 AS (SELECT DISTINCT r, 0.0::DOUBLE AS beta FROM c), {", ".join(_SWEEP(i) for i in range(30))}
SELECT r AS rater_id, round(beta, 6) AS leniency, CASE WHEN beta > 0.25::DOUBLE THEN 'lenient' WHEN beta < -0.25::DOUBLE THEN 'severe' ELSE 'balanced' END AS interpretation, CAST(sum(n) AS BIGINT) AS n_scored FROM b30 JOIN c USING (r) GROUP BY r, beta""")
def rater_severity(spark, sf_dir):
    return rounded(agreement.rater_severity(ratings(spark, sf_dir), "essay_id", "rater_id", "gold"))


_ITEMS = "SELECT vec_id, " + ", ".join(f"1 + CAST(floor(abs(embedding[{i + 1}]::DOUBLE) * 1000) AS BIGINT) % 5 AS q{i}" for i in range(10)) + " FROM embeddings"
_SCORE = " + ".join(f"(q{i} - 1)" if i % 2 == 0 else f"(5 - q{i})" for i in range(10))


@query(f"""WITH i AS ({_ITEMS}), s AS (SELECT *, ({_SCORE}) * 2.5::DOUBLE AS s, {" + ".join(f"q{i}" for i in range(10))} AS t FROM i)
SELECT count(*) AS n, round(avg(s), 6) AS mean, round(stddev_samp(s), 6) AS std, median(s) AS median, min(s) AS min, max(s) AS max, round(10 / 9 * (1 - ({" + ".join(f"var_samp(q{i})" for i in range(10))}) / var_samp(t)), 6) AS cronbach_alpha FROM s""")
def usability(spark, sf_dir):
    item = lambda i: (1 + F.floor(F.abs(F.get("embedding", F.lit(i)).cast("double")) * 1000) % 5).alias(f"q{i}")
    return rounded(agreement.usability(read(spark, sf_dir, "embeddings").select(*map(item, range(10))), [f"q{i}" for i in range(10)]))


@query("""WITH r AS (SELECT l_orderkey, l_returnflag, l_suppkey, l_linestatus, (SELECT arg_min(v, (abs(v - l_quantity / 5), v)) FROM (VALUES (0.0::DOUBLE), (2.5), (5.0), (7.5), (10.0)) t(v)) AS x FROM lineitem),
a AS (SELECT l_orderkey, l_returnflag, median(x) AS m, count(*) AS n, (max(x) - min(x)) / 10 AS spread FROM r GROUP BY ALL),
l AS (SELECT l_orderkey, l_returnflag, l_linestatus, count(*) AS c, min(l_suppkey) AS at FROM r GROUP BY l_orderkey, l_returnflag, l_linestatus QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_returnflag ORDER BY count(*) DESC, min(l_suppkey), l_linestatus DESC) = 1)
SELECT l_orderkey, l_returnflag, (SELECT arg_min(v, (abs(v - m), v)) FROM (VALUES (0.0::DOUBLE), (2.5), (5.0), (7.5), (10.0)) t(v)) AS score, l_linestatus AS level, CAST(n AS INT) AS n_runs, round(spread, 6) AS spread,
  round(1 - avg(spread) OVER (PARTITION BY l_orderkey), 3) AS confidence FROM a JOIN l USING (l_orderkey, l_returnflag)""")
def self_consistency(spark, sf_dir):
    d = read(spark, sf_dir, "lineitem").withColumn("x", F.col("l_quantity") / 5)
    return rounded(agreement.self_consistency(d, "l_orderkey", "l_returnflag", "l_suppkey", "x", "l_linestatus", [0.0, 2.5, 5.0, 7.5, 10.0], 10.0))


# --- grades ----------------------------------------------------------------------------------------------------------


@query("""WITH r AS (SELECT c_custkey, c_acctbal, row_number() OVER (ORDER BY c_acctbal, c_custkey) AS r, count(*) OVER () AS n FROM customer)
SELECT c_custkey, CAST(CASE WHEN r > 1 + (n - 1) * 0.75::DOUBLE THEN 3 WHEN r > 1 + (n - 1) * 0.5::DOUBLE THEN 2 WHEN r > 1 + (n - 1) * 0.25::DOUBLE THEN 1 ELSE 0 END AS INT) AS bin FROM r""")
def quantile_bins(spark, sf_dir):
    return sampling.quantile_bins(read(spark, sf_dir, "customer"), "c_acctbal", "c_custkey", 4).select("c_custkey", "bin")


_BIN = "CAST(CASE WHEN r > 1 + (n - 1) * 0.75::DOUBLE THEN 3 WHEN r > 1 + (n - 1) * 0.5::DOUBLE THEN 2 WHEN r > 1 + (n - 1) * 0.25::DOUBLE THEN 1 ELSE 0 END AS INT)"


@query(f"""WITH {RATINGS}, e AS (SELECT essay_id, avg(gold) AS gold, avg(pred) AS pred, count(*) AS length FROM ratings GROUP BY essay_id),
r AS (SELECT *, row_number() OVER (ORDER BY length, essay_id) AS r, count(*) OVER () AS n FROM e), ratings2 AS (SELECT {_BIN} AS length_bin, gold, pred FROM r),
b AS (SELECT length_bin, round_even(round(gold / 0.25, 9), 0) AS i, round_even(round(pred / 0.25, 9), 0) AS j FROM ratings2),
k AS (SELECT length_bin, round(1 - count(*) * sum((i - j) ** 2) / (count(*) * (sum(i ** 2) + sum(j ** 2)) - 2 * sum(i) * sum(j)), 6) AS qwk FROM b GROUP BY length_bin),
m AS (SELECT length_bin, count(*) AS n, round(avg(abs(gold - pred)), 6) AS mae, round((avg(pred) - avg(gold)) / sqrt((var_samp(gold) + var_samp(pred)) / 2), 6) AS smd, round(avg(pred - gold), 6) AS bias FROM ratings2 GROUP BY length_bin HAVING count(*) >= 10)
SELECT length_bin, n, qwk, mae, smd, bias, abs(smd) > 0.25 AS warn_bias, mae > min(mae) OVER () + 0.5 AS warn_mae FROM m JOIN k USING (length_bin)""")
def length_bias(spark, sf_dir):
    # sums in another order must not fall to another side of a bin's edge
    lines = ratings(spark, sf_dir).groupBy("essay_id").agg(F.round(F.avg("gold"), 9).alias("gold"), F.round(F.avg("pred"), 9).alias("pred"), F.count("*").alias("length"))
    return rounded(evaluation.length_bias(lines, "essay_id", "length", "gold", "pred"))


_PAIRS = """e AS (SELECT 'total' AS criterion, split, gold, pred FROM ratings UNION ALL SELECT 'sure', split, confidence * 10, gold FROM ratings)"""
_BINNED = "(SELECT criterion, split, round_even(gold / 0.25, 0) AS i, round_even(pred / 0.25, 0) AS j FROM e)"


@query(f"""WITH {RATINGS}, {_PAIRS}, m AS (SELECT criterion, split, {METRICS} FROM e GROUP BY ALL HAVING count(*) >= 5),
k AS (SELECT criterion, split, round(1 - count(*) * sum((i - j) ** 2) / (count(*) * (sum(i ** 2) + sum(j ** 2)) - 2 * sum(i) * sum(j)), 6) AS qwk FROM {_BINNED} GROUP BY ALL)
SELECT m.*, k.qwk FROM m JOIN k USING (criterion, split)""")
def criterion_metrics(spark, sf_dir):
    d = ratings(spark, sf_dir).withColumn("sure", F.col("confidence") * 10)
    return rounded(evaluation.per_criterion(d, {"total": ("gold", "pred"), "sure": ("sure", "gold")}, ("split",)))


@query(f"""WITH {RATINGS}, m AS (SELECT essay_id, median(gold) AS total, coalesce(stddev_samp(gold), 0) AS run_std, count(gold) AS n_runs FROM ratings GROUP BY essay_id)
SELECT count(*) AS n_essays, round(avg(run_std), 6) AS mean_run_std, round(max(run_std), 6) AS max_run_std, round(avg(CAST(run_std <= 0.25 AS INT)), 6) AS stable_share FROM m""")
def test_retest(spark, sf_dir):
    return rounded(evaluation.test_retest(evaluation.median_runs(ratings(spark, sf_dir), "essay_id", "rater_id", "gold")))


@query(f"""WITH {RATINGS}, b AS (SELECT exam, split, round_even(gold / 0.25, 0) AS i, round_even(pred / 0.25, 0) AS j FROM ratings),
l AS (SELECT DISTINCT exam, split, x FROM (SELECT exam, split, i AS x FROM b UNION ALL SELECT exam, split, j FROM b)),
r AS (SELECT exam, split, x, CAST(dense_rank() OVER (PARTITION BY exam, split ORDER BY x) AS DOUBLE) AS k FROM l),
p AS (SELECT b.exam, b.split, p.k AS x, q.k AS y FROM b JOIN r p ON p.exam = b.exam AND p.split = b.split AND p.x = b.i JOIN r q ON q.exam = b.exam AND q.split = b.split AND q.x = b.j),
a AS (SELECT exam, split, CAST(count(*) AS DOUBLE) AS t, sum((x - y) ** 2) AS d, sum(x * x) AS xx, sum(y * y) AS yy, sum(x) AS sx, sum(y) AS sy FROM p GROUP BY ALL),
q AS (SELECT exam, split, round(CASE WHEN t * xx > sx * sx AND t * yy > sy * sy THEN 1 - t * d / (t * (xx + yy) - 2 * sx * sy) END, 6) AS qwk FROM a),
m AS (SELECT exam, split, count(*) AS n, round(avg(abs(pred - gold)), 6) AS mae, round(sqrt(avg((pred - gold) ** 2)), 6) AS rmse, round(covar_pop(gold, pred) / (stddev_pop(gold) * stddev_pop(pred)), 6) AS pearson,
round(avg(pred - gold), 6) AS bias, round(avg(CAST(abs(pred - gold) <= 0.1249::DOUBLE + 1e-5 * abs(pred) AS INT)), 6) AS exact_agreement FROM ratings GROUP BY exam, split) SELECT m.*, q.qwk FROM m JOIN q USING (exam, split)""")
def total_metrics(spark, sf_dir):
    return rounded(evaluation.totals(ratings(spark, sf_dir), "gold", "pred", ("exam", "split")))


@query()
def bootstrap_error(spark, sf_dir):
    d = ratings(spark, sf_dir).groupBy("essay_id").agg(F.avg("gold").alias("gold"), F.avg("pred").alias("pred"))
    e = F.col("pred") - F.col("gold")
    return rounded(evaluation.bootstrap(d, {"mae": F.abs(e), "bias": e}, 200))


@query()
def score_intervals(spark, sf_dir):
    """Intervals of all metrics of one column of scores: 1,000 exact resamples of all ratings."""
    return rounded(resampling.score_intervals(ratings(spark, sf_dir), "gold", "pred"))


@query()
def delta_intervals(spark, sf_dir):
    """Intervals of what each metric gains by rounding scores to halves."""
    d = ratings(spark, sf_dir).withColumn("rounded", F.rint(F.col("pred") * 2) / 2)
    return rounded(resampling.delta_intervals(d, "gold", "pred", "rounded"))


@query(f"""WITH {RATINGS}, g AS (SELECT essay_id, avg(gold) AS before, avg(pred) AS after FROM ratings GROUP BY essay_id) SELECT essay_id, round(before, 6) AS before, round(after, 6) AS after, round(after - before, 6) AS delta FROM g""")
def paired_delta(spark, sf_dir):
    r = ratings(spark, sf_dir)
    side = lambda c: r.groupBy("essay_id").agg(F.avg(c).alias("total"))
    return rounded(evaluation.paired_delta(side("gold"), side("pred"), "essay_id", "total"))


_GRADED = f"""{RATINGS}, s AS (SELECT o_orderkey AS essay_id, 'text of an essay ' || CASE WHEN o_orderkey % 11 = 0 THEN '' ELSE o_orderpriority END AS text, CASE WHEN o_orderkey % 7 <> 0 THEN round(o_totalprice % 10, 2) END AS rubric_total,
  (o_orderkey % 5) / 4 AS section_coverage, CASE WHEN o_orderkey % 13 <> 0 THEN o_custkey % 11 END AS model, o_totalprice % 7 AS gold FROM orders)"""


def _graded(spark, sf_dir):
    o, k = read(spark, sf_dir, "orders"), F.col("o_orderkey")
    return o.select(
        k.alias("essay_id"), F.concat(F.lit("text of an essay "), F.when(k % 11 == 0, "").otherwise(F.col("o_orderpriority"))).alias("text"), F.when(k % 7 != 0, F.round(F.col("o_totalprice") % 10, 2)).alias("rubric_total"),
        ((k % 5) / 4).alias("section_coverage"), F.when(k % 13 != 0, F.col("o_custkey") % 11).alias("model"), (F.col("o_totalprice") % 7).alias("gold"),
    )


@query(f"""WITH {_GRADED}, t AS (SELECT *, length(trim(text)) < 20 AS empty, section_coverage >= 0.6 AS enough FROM s),
r AS (SELECT *, CASE WHEN enough THEN 0.7::DOUBLE * rubric_total + (1 - 0.7::DOUBLE) * model ELSE model END AS raw FROM t),
f AS (SELECT *, CASE WHEN empty THEN 0 WHEN raw IS NOT NULL THEN greatest(0.0::DOUBLE, least(10.0::DOUBLE, round_even(raw / 0.25, 0) * 0.25)) END AS final_total,
  list_filter([CASE WHEN rubric_total IS NULL THEN 'UNKNOWN_EXAM' END, CASE WHEN empty THEN 'EMPTY_OR_TOO_SHORT' END, CASE WHEN NOT empty AND NOT enough THEN 'LOW_SECTION_COVERAGE' END, CASE WHEN NOT empty AND raw IS NULL THEN 'NO_SCORE' END, CASE WHEN abs(model - rubric_total) >= 2 THEN 'MODEL_RUBRIC_DISAGREEMENT' END], lambda x: x IS NOT NULL) AS fs FROM r)
SELECT essay_id, final_total, CASE WHEN empty THEN 'empty_rule' WHEN enough THEN 'hybrid_rubric_model' ELSE 'model_fallback' END AS mode, array_to_string(fs, '|') AS flags, len(fs) > 0 AS needs_review FROM f""")
def final_grades(spark, sf_dir):
    d = structured.final_grades(_graded(spark, sf_dir), "text", "model")
    return d.select("essay_id", "final_total", "mode", "flags", "needs_review")


@query(f"""WITH {_GRADED}, w AS (SELECT unnest(range(0, 11)) / 10 AS weight), x AS (SELECT weight, gold, CASE WHEN section_coverage >= 0.6 THEN weight * rubric_total + (1 - weight) * model ELSE model END AS raw FROM s, w WHERE model IS NOT NULL AND (rubric_total IS NOT NULL OR section_coverage < 0.6))
SELECT weight, round(avg(abs(gold - greatest(0.0::DOUBLE, least(10.0::DOUBLE, round_even(raw / 0.25, 0) * 0.25)))), 6) AS mae, count(*) AS n FROM x GROUP BY weight""")
def rubric_weights(spark, sf_dir):
    d = _graded(spark, sf_dir)
    return rounded(structured.calibrate_weight(d, "gold", "model", "rubric_total", "section_coverage"), "weight")


_RUBRIC = [structured.Item("cau_1a", 2.0, "the | and", ("which",)), structured.Item("cau_1b", 3.0, "12; 34", ("of", "to")), structured.Item("cau_2", 5.0, "10/20")]


@query()
def rubric_items(spark, sf_dir):
    marked = F.concat(F.lit("Câu 1: "), F.lit("a) "), F.coalesce("text", F.lit("")), F.lit("\nCâu 2. 10 / 20"))
    d = read(spark, sf_dir, "documents").select("doc_id", F.when(F.col("doc_id") % 2 == 0, marked).otherwise(F.col("text")).alias("text"))
    return structured.item_scores(d, "doc_id", "text", _RUBRIC)


@query(f"""WITH {RATINGS}, s AS (SELECT essay_id, rater_id, gold, CASE WHEN confidence > 0.5 THEN gold END AS feature, pred AS llm FROM ratings), m AS (SELECT avg(feature) AS f, avg(llm) AS l FROM s)
SELECT essay_id, rater_id, gold, llm, round(greatest(0.0::DOUBLE, least(10.0::DOUBLE, 0.55 * coalesce(feature, f) + 0.45 * llm)), 6) AS mixed FROM s, m""")
def mixed_scores(spark, sf_dir):
    d = ratings(spark, sf_dir).select("essay_id", "rater_id", "gold", F.when(F.col("confidence") > 0.5, F.col("gold")).alias("feature"), F.col("pred").alias("llm"))
    return models.mixed(d, models.DEFAULT_WEIGHTS).select("essay_id", "rater_id", "gold", "llm", F.round("mixed", 6).alias("mixed"))


@query()
def text_ridge(spark, sf_dir):
    d = read(spark, sf_dir, "documents").join(read(spark, sf_dir, "labels").select("doc_id", (F.col("quality") * 10).alias("gold")), "doc_id", "left")
    return models.fit_text_ridge(d, "doc_id", "text", "gold").scores(d, "doc_id", "text")


# --- samples, retrieval, pipelines -----------------------------------------------------------------------------------


@query("""WITH g AS (SELECT greatest(1, 60 // count(DISTINCT c_mktsegment)) AS per FROM customer), r AS (SELECT c_custkey, c_mktsegment, c_acctbal, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal DESC, c_custkey) AS r FROM customer)
SELECT c_custkey, c_mktsegment, c_acctbal FROM r, g ORDER BY r > per, c_acctbal DESC, c_custkey LIMIT 60""")
def uncertainty_sample(spark, sf_dir):
    return sampling.uncertainty_sample(read(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", "c_acctbal"), "c_custkey", "c_acctbal", "c_mktsegment", 60)


@query("""WITH o AS (SELECT o_orderkey, CAST(o_custkey AS VARCHAR) AS g, o_orderpriority FROM orders), h AS (SELECT DISTINCT g FROM o WHERE o_orderpriority = '1-URGENT' ), u AS (SELECT *, ('0x' || substr(sha256('42:' || g), 1, 12))::BIGINT / pow(16.0::DOUBLE, 12) AS u FROM o)
SELECT o_orderkey, CASE WHEN g IN (SELECT g FROM h) THEN 'test' WHEN u < 0.7::DOUBLE THEN 'train' WHEN u < 0.7::DOUBLE + 0.15::DOUBLE THEN 'validation' ELSE 'test' END AS split FROM u""")
def group_holdout(spark, sf_dir):
    return sampling.group_holdout(read(spark, sf_dir, "orders"), "o_custkey", "o_orderkey", "o_orderpriority", ["1-URGENT"]).select("o_orderkey", "split")


_UNIT = "('0x' || substr(sha256('{0}:' || {1}), 1, 12))::BIGINT / pow(16.0::DOUBLE, 12)".format


@query(f"""WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY n_chars NULLS FIRST, doc_id) AS r, count(*) OVER () AS n FROM documents),
b AS (SELECT doc_id, CAST(greatest(0, {" + ".join(f"CAST(r > 1 + (n - 1) * {q / 5}::DOUBLE AS INT)" for q in range(6))} - 1) AS INT) AS bin FROM r)
SELECT doc_id, bin, CAST(row_number() OVER (PARTITION BY bin ORDER BY {_UNIT(42, "doc_id")}, doc_id) AS INT) AS place FROM b QUALIFY place <= 10""")
def stratified_pilot(spark, sf_dir):
    return sampling.stratified_pilot(read(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id", "n_chars", 50).select("doc_id", "bin", "place")


@query("WITH r AS (" + ORACLES["retrieve_passages"] + """),
p AS (SELECT turn_id, list({'t': '[' || item_id || '] ' || text, 'kept': []::VARCHAR[], 'used': 0::BIGINT} ORDER BY place) AS ps FROM r JOIN benchmark USING (item_id) GROUP BY turn_id),
s AS (SELECT turn_id, list_reduce(list_concat([{'t': '', 'kept': []::VARCHAR[], 'used': 0::BIGINT}], ps), lambda a, x: CASE WHEN a.used + length(x.t) + CASE WHEN len(a.kept) > 0 THEN 2 ELSE 0 END <= 600
  THEN {'t': '', 'kept': list_append(a.kept, x.t), 'used': a.used + length(x.t) + CASE WHEN len(a.kept) > 0 THEN 2 ELSE 0 END} ELSE a END) AS s FROM p)
SELECT turn_id, coalesce(array_to_string(s.kept, chr(10) || chr(10)), '') AS context, CAST(len(s.kept) AS INT) AS n_passages, CAST(s.used AS INT) AS n_chars FROM s""")
def rag_context(spark, sf_dir):
    turns = read(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("turn_id"), "text")
    b = read(spark, sf_dir, "benchmark")
    return retrieval.context(retrieval.search(turns, "turn_id", "text", b, "item_id", "text"), "turn_id", b, "item_id", "text", 600)


_SPACED = rf"""trim(regexp_replace(array_to_string(list_transform(string_split(regexp_replace(nfc_normalize(coalesce(text, '')), '[ \t\x{{A0}}]+', ' ', 'g'), chr(10)), lambda x: trim(x, {_BLANKS})), chr(10)), '\n{{3,}}', chr(10) || chr(10), 'g'), {_BLANKS})"""
_MIDDLE = "substr(body, pos + 551, least(pos + 1100, length(body)) - pos - 550)"
_END = f"CASE WHEN pos + 1100 < length(body) AND strpos({_MIDDLE}, chr(10)) > 0 THEN pos + 550 + length({_MIDDLE}) - strpos(reverse({_MIDDLE}), chr(10)) ELSE least(pos + 1100, length(body)) END"


@query(f"""WITH RECURSIVE b AS (SELECT source, doc_id, {_SPACED} AS body FROM documents),
s AS (SELECT source, doc_id, body, 0 AS pos, 0 AS i FROM b WHERE length(body) >= 80 UNION ALL SELECT source, doc_id, body, greatest(pos + 1, stop - 150), i + 1 FROM (SELECT *, {_END} AS stop FROM s) WHERE stop < length(body)),
p AS (SELECT source, doc_id, i, trim(substr(body, pos + 1, stop - pos), {_BLANKS}) AS chunk FROM (SELECT *, {_END} AS stop FROM s))
SELECT source, doc_id, CAST(row_number() OVER (PARTITION BY source ORDER BY doc_id, i) - 1 AS INT) AS piece, chunk FROM p WHERE length(chunk) >= 80""")
def page_chunks(spark, sf_dir):
    d = read(spark, sf_dir, "documents").select("source", "doc_id", "text")
    return retrieval.chunked(d, "source", "doc_id", "text")


@query("""WITH d AS (SELECT source, doc_id, coalesce(text, '') AS t FROM documents), k AS (SELECT source, t, count(*) AS n FROM d GROUP BY ALL), u AS (SELECT source, sum(n) - count(*) AS n_duplicates FROM k GROUP BY source)
SELECT source, count(*) AS n_chunks, count(DISTINCT doc_id) AS n_pages, round(avg(length(t)), 1) AS mean_chars, CAST(n_duplicates AS BIGINT) AS n_duplicates FROM d JOIN u USING (source) GROUP BY source, n_duplicates""")
def index_audit(spark, sf_dir):
    d = read(spark, sf_dir, "documents").select("source", "doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return retrieval.audit(d, "source", "doc_id", "text")


@query()
def cleaned_essays(spark, sf_dir):
    d = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("essay_id"), F.col("lang").alias("prompt_id"), "text")
    return pipelines.clean(d).select("essay_id", "prompt_id", "qc_decision", "qc_reasons", "dup_ratio", "dup_with", "n_words", "teencode_rate", F.md5("text").alias("text_md5"))


@query(f"""WITH {RATINGS}, l AS (SELECT essay_id, rater_id, gold, pred, row_number() OVER (ORDER BY gold * confidence, essay_id * 1000 + rater_id) AS r, count(*) OVER () AS n FROM (SELECT DISTINCT ON (essay_id, rater_id) * FROM ratings ORDER BY essay_id, rater_id, gold, pred, confidence)),
q AS (SELECT CAST(greatest(0, {" + ".join(f"CAST(r > 1 + (n - 1) * {i / 4}::DOUBLE AS INT)" for i in range(5))} - 1) AS INT) AS exam, gold, pred FROM l),
ratings2 AS (SELECT exam, gold, pred FROM q), b AS (SELECT exam, round_even(gold / 0.25, 0) AS i, round_even(pred / 0.25, 0) AS j FROM ratings2),
k AS (SELECT exam, round(1 - count(*) * sum((i - j) ** 2) / (count(*) * (sum(i ** 2) + sum(j ** 2)) - 2 * sum(i) * sum(j)), 6) AS qwk FROM b GROUP BY exam), m AS (SELECT exam, {METRICS} FROM ratings2 GROUP BY exam HAVING count(*) >= 10)
SELECT exam AS length_bin, n, qwk, mae, smd, bias, abs(smd) > 0.25 AS warn_bias, mae > min(mae) OVER () + 0.5 AS warn_mae FROM m JOIN k USING (exam)""")
def length_bias(spark, sf_dir):
    """Accuracy by quarters of a length, for which the gold score times the confidence stands in."""
    first = Window.partitionBy("essay_id", "rater_id").orderBy("gold", "pred", "confidence")
    d = ratings(spark, sf_dir).withColumn("_r", F.row_number().over(first)).where("_r = 1")
    d = d.withColumns({"key": F.col("essay_id") * 1000 + F.col("rater_id"), "length": F.col("gold") * F.col("confidence")})
    return rounded(evaluation.length_bias(d, "key", "length", "gold", "pred"))


_BACK = "SELECT '{0}' AS kind, c_custkey, {1} AS c_name, c_acctbal, {2} AS note FROM d".format
_GUARD = "CASE WHEN regexp_matches(ltrim({0}), '^[=+@-]') THEN '''' || {0} ELSE {0} END".format


@query(
    "WITH d AS (SELECT c_custkey, c_name, c_acctbal, CASE WHEN c_custkey % 3 = 0 THEN '=1+1, \"x\"' WHEN c_custkey % 3 = 1 THEN ' -' || c_mktsegment ELSE 'two' || chr(10) || 'lines' END AS note FROM customer) "
    + " UNION ALL ".join(_BACK(k, _GUARD("c_name"), _GUARD("note")) if k in ("csv", "tsv") else _BACK(k, "c_name", "note") for k in ("csv", "tsv", "jsonl", "parquet", "orc"))
)
def table_round_trips(spark, sf_dir):
    """A table written and read back in each format; only cells of CSV are guarded against formulas."""
    k = F.col("c_custkey") % 3
    note = F.when(k == 0, '=1+1, "x"').when(k == 1, F.concat(F.lit(" -"), "c_mktsegment")).otherwise("two\nlines")
    d = read(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal", note.alias("note"))
    folder, out = f"{app_folder(spark)}/round-{uuid4().hex}", None
    for kind in ("csv", "tsv", "jsonl", "parquet", "orc"):
        tables.write_table(d, f"{folder}/t.{kind}")
        back = tables.load(spark, f"{folder}/t.{kind}", "c_custkey long, c_name string, c_acctbal double, note string")
        back = back.select(F.lit(kind).alias("kind"), "c_custkey", "c_name", "c_acctbal", "note")
        out = back if out is None else out.unionByName(back)
    return out


@query(f"""WITH d AS (SELECT c_custkey, c_name, c_mktsegment, CASE c_custkey % 6 WHEN 0 THEN 'Yes' WHEN 1 THEN ' true ' WHEN 2 THEN '0' WHEN 3 THEN 'no' WHEN 4 THEN '' END AS b FROM customer)
SELECT c_custkey AS essay_id, CASE WHEN c_custkey % 4 = 0 THEN c_mktsegment ELSE c_name END AS text, coalesce(lower(trim(b)) IN ({_quoted(records.TRUE)}), true) AS ready,
  array_to_string(list_filter([CASE WHEN c_custkey % 2 = 0 THEN 'late' END, c_mktsegment], lambda x: x IS NOT NULL), '|') AS flags, CASE WHEN c_custkey % 7 BETWEEN 1 AND 5 THEN 'De_' || c_custkey % 7 ELSE '' END AS exam FROM d""")
def record_fields(spark, sf_dir):
    """Columns by other names, the first of several values, tolerant booleans, flags of texts and exams by digit."""
    k = F.col("c_custkey")
    c = read(spark, sf_dir, "customer").select(k.alias("Essay_No"), F.col("c_name").alias("Bai_Lam"), "c_mktsegment", k)
    d = tables.canonical(c, {"essay_id": ["id", "essay_no"], "text": ["content", "bai_lam"]})
    b = F.element_at(F.array(*map(F.lit, ("Yes", " true ", "0", "no", "", None))), (k % 6 + 1).cast("int"))
    flags = F.concat(F.when(k % 2 == 0, " late ;").otherwise(" , "), "c_mktsegment")
    return d.select(
        "essay_id", records.first_of(F.when(k % 4 != 0, F.col("text")).otherwise(""), F.col("c_mktsegment")).alias("text"), records.truth(b, True).alias("ready"),
        F.array_join(records.flags_of_text(flags), "|").alias("flags"), records.exam_digit(F.concat(F.lit("exam "), (k % 7).cast("string"))).alias("exam"),
    )


# --- reports ---------------------------------------------------------------------------------------------------------


@query("""SELECT o_orderkey, o_orderstatus, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderstatus = 'F', CASE WHEN p IS NULL OR o_orderpriority = '1-URGENT' THEN 0 ELSE 1 END, CASE WHEN p IS NULL THEN 99 ELSE abs(p - 5) END DESC, o_orderkey) AS INT) AS place
FROM (SELECT *, CASE WHEN o_orderkey % 9 <> 0 THEN o_totalprice % 10 END AS p FROM orders)""")
def review_queue(spark, sf_dir):
    p = F.when(F.col("o_orderkey") % 9 != 0, F.col("o_totalprice") % 10)
    o = read(spark, sf_dir, "orders").withColumn("p", p)
    order = (F.col("o_orderstatus") == "F", F.when(F.col("p").isNull() | (F.col("o_orderpriority") == "1-URGENT"), 0).otherwise(1), F.when(F.col("p").isNull(), 99.0).otherwise(F.abs(F.col("p") - 5)).desc(), F.col("o_orderkey"))
    return o.select("o_orderkey", "o_orderstatus", F.row_number().over(Window.partitionBy("o_custkey").orderBy(*order)).alias("place"))


@query("""SELECT count(*) AS essays, count(*) FILTER (o_orderstatus = 'F') AS approved, count(*) FILTER (o_orderpriority = '1-URGENT') AS manual_review, count(*) FILTER (o_totalprice > 250000 OR o_orderstatus = 'P') AS flagged, count(*) FILTER (o_orderstatus IN ('O', 'P')) AS delivered FROM orders""")
def review_summary(spark, sf_dir):
    s, n = F.col("o_orderstatus"), F.count_if
    return read(spark, sf_dir, "orders").agg(F.count("*").alias("essays"), n(s == "F").alias("approved"), n(F.col("o_orderpriority") == "1-URGENT").alias("manual_review"), n((F.col("o_totalprice") > 250000) | (s == "P")).alias("flagged"), n(s.isin("O", "P")).alias("delivered"))


@query("""SELECT event_type AS state, count(*) AS count FROM events GROUP BY event_type""")
def jobs_by_state(spark, sf_dir):
    return read(spark, sf_dir, "events").groupBy(F.col("event_type").alias("state")).agg(F.count("*").alias("count"))


@query("""SELECT event_id, user_id, event_type FROM events ORDER BY event_id DESC LIMIT 100""")
def audit_tail(spark, sf_dir):
    return read(spark, sf_dir, "events").select("event_id", "user_id", "event_type").orderBy(F.col("event_id").desc()).limit(100)


@query("""SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS n FROM events GROUP BY ALL""")
def hourly_events(spark, sf_dir):
    return submissions.hourly(read(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp")), "ts", "event_type").withColumn("hour", F.col("hour").cast("timestamp_ntz"))


_NUMERIC = ["o_orderkey", "o_custkey", "o_totalprice"]


@query(" UNION ALL ".join(f"SELECT '{c}' AS \"column\", round(avg({c}), 4) AS mean, CAST(min({c}) AS DOUBLE) AS min, CAST(max({c}) AS DOUBLE) AS max FROM orders" for c in _NUMERIC))
def column_profile(spark, sf_dir):
    return rounded(reports.profile(read(spark, sf_dir, "orders")), "min", "max", digits=4)


@query("""SELECT count(*) AS n, sha256(count(*) || ':' || sum(('0x' || substr(sha256(doc_id || chr(31) || coalesce(text, '') || chr(31) || coalesce(source, '')), 1, 15))::BIGINT)) AS digest FROM documents""")
def table_fingerprint(spark, sf_dir):
    return reports.fingerprint(read(spark, sf_dir, "documents"), ["doc_id", "text", "source"])


@query(f"""WITH d AS (SELECT doc_id, lang, n_chars % 41 / 4 AS score FROM documents), b AS (SELECT *, CASE WHEN score <= 4 THEN 0 WHEN score <= 6 THEN 1 WHEN score <= 8 THEN 2 WHEN score <= 10.01 THEN 3 ELSE -1 END AS b FROM d),
i AS (SELECT *, row_number() OVER (PARTITION BY lang, b ORDER BY {_UNIT(42, "doc_id")}, doc_id) AS i FROM b), j AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY i, b, doc_id) AS j, count(*) OVER (PARTITION BY lang) AS n FROM i),
p AS (SELECT *, CASE WHEN n >= 3 THEN greatest(1, CAST(round_even(n * 0.15::DOUBLE, 0) AS BIGINT)) ELSE 0 END AS v0, CASE WHEN n >= 3 THEN greatest(1, CAST(round_even(n * (1 - 0.7::DOUBLE - 0.15::DOUBLE), 0) AS BIGINT)) ELSE 0 END AS t0 FROM j),
q AS (SELECT *, CASE WHEN v0 + t0 >= n THEN CAST(n >= 3 AS INT) ELSE v0 END AS v, CASE WHEN v0 + t0 >= n OR n < 3 THEN CASE WHEN n >= 3 THEN 1 ELSE greatest(0, n - 1) END ELSE t0 END AS t FROM p),
k AS (SELECT *, j * (v + t) // n AS k, (j - 1) * (v + t) // n AS was FROM q)
SELECT doc_id, lang, score, CASE WHEN k = was THEN 'train' WHEN k * t // nullif(v + t, 0) > (k - 1) * t // nullif(v + t, 0) THEN 'test' ELSE 'validation' END AS split FROM k""")
def exam_split(spark, sf_dir):
    d = read(spark, sf_dir, "documents").select("doc_id", "lang", (F.col("n_chars") % 41 / 4).alias("score"))
    return sampling.exam_split(d, "doc_id", "lang", "score")

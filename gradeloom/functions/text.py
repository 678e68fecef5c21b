"""Text normalisation as Catalyst expressions; each takes and returns a Column. Nulls stay null."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Entities, in the order in which they are replaced.
ENTITIES = (("&nbsp;", " "), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&hellip;", "…"))
# Zero-width characters.
INVISIBLE = "​‌‍⁠﻿­᠎"
# Tone marks by the old and the new placement.
TONES = (
    ("òa", "oà"), ("óa", "oá"), ("ỏa", "oả"), ("õa", "oã"), ("ọa", "oạ"),
    ("òe", "oè"), ("óe", "oé"), ("ỏe", "oẻ"), ("õe", "oẽ"), ("ọe", "oẹ"),
    ("ùy", "uỳ"), ("úy", "uý"), ("ủy", "uỷ"), ("ũy", "uỹ"), ("ụy", "uỵ"),
)
# Quotes and dashes with their plain forms.
QUOTES, PLAIN_QUOTES = "‘’“”′″`´", "''\"\"'\"''"
DASHES, PLAIN_DASHES = "–—−‐‑", "-----"
# Ranges of pictographs, and emoticons.
EMOJI = r"[\x{1F300}-\x{1FAFF}\x{2600}-\x{27BF}\x{1F000}-\x{1F0FF}\x{2190}-\x{21FF}\x{FE00}-\x{FE0F}]"
EMOTICON = r"(?U)(?<!\w)[:;=8][\-o*']?[)\](\[dDpP/\\:}{@|]+(?!\w)"
# Addresses, tags and control characters.
URL = r"https?://\S+|www\.\S+"
TAG = r"<[^>]{1,80}>"
CONTROL = r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]"
# Vietnamese letters with a mark.
VIETNAMESE = "àáảãạăằắẳẵặâầấẩẫậèéẻẽẹêềếểễệìíỉĩịòóỏõọôồốổỗộơờớởỡợùúủũụưừứửữựỳýỷỹỵđ"
MARKED = VIETNAMESE + VIETNAMESE.upper()



def strip(c: Column) -> Column:
    """c without blanks and line ends around it. transform() would hand F.trim itself the index as characters to trim."""
    return F.trim(c, F.lit(" \t\n\r\f\x0b"))


def once(x: Column, f) -> Column:
    """f of x, with x computed once."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def strip_invisible(c: Column) -> Column:
    """Entities, then tags, zero-width and control characters; line ends become LF."""
    c = reduce(lambda x, e: F.replace(x, F.lit(e[0]), F.lit(e[1])), ENTITIES, c)
    c = F.translate(F.regexp_replace(c, TAG, " "), INVISIBLE, "")
    return F.regexp_replace(F.regexp_replace(c, r"\r\n?", "\n"), CONTROL, "")


def normalize_tone_marks(c: Column, style: str = "new") -> Column:
    """One placement of tone marks; lower and upper case, not mixed case."""
    pairs = [(a, b) if style == "new" else (b, a) for a, b in TONES]
    return reduce(lambda x, p: F.replace(F.replace(x, F.lit(p[0]), F.lit(p[1])), F.lit(p[0].upper()), F.lit(p[1].upper())), pairs, c)


def normalize_punct(c: Column) -> Column:
    """Plain quotes and dashes, single punctuation marks, one space behind and none before them."""
    c = F.translate(F.translate(c, QUOTES, PLAIN_QUOTES), DASHES, PLAIN_DASHES)
    c = F.regexp_replace(c, r"([!?.,;:])\1+", "$1")
    c = F.regexp_replace(c, r"(?U)\s+([,.;:!?%)\]}…])", "$1")
    c = F.regexp_replace(c, r"(?U)([,.;:!?])(?=[^\s\d)\]}…])", "$1 ")
    return F.regexp_replace(c, r"(?U)([(\[{])\s+", "$1")


def normalize_whitespace(c: Column) -> Column:
    """Runs of blanks become one, lines are stripped, three line ends or more become two."""
    lines = F.transform(F.split(F.regexp_replace(c, r"[ \t\x{A0}]+", " "), "\n", -1), lambda x: strip(x))
    return strip(F.regexp_replace(F.array_join(lines, "\n"), r"\n{3,}", "\n\n"))


def normalize_answer(c: Column) -> Column:
    """A second normaliser, for answers: composed forms, no NUL, LF, single blanks, stripped lines, two line ends at most."""
    from .vietnamese import nfc

    c = F.regexp_replace(F.replace(nfc(c), F.lit("\0"), F.lit("")), r"\r\n?", "\n")
    lines = F.transform(F.split(F.regexp_replace(c, r"[\x0B\x0C\x1C-\x1E\x{85}\x{2028}\x{2029}]", "\n"), "\n", -1), lambda x: strip(F.regexp_replace(x, r"[ \t]+", " ")))
    return strip(F.regexp_replace(F.array_join(lines, "\n"), r"\n{3,}", "\n\n"))


def mask_urls(c: Column, mark: str = "<URL>") -> Column:
    return F.regexp_replace(c, URL, mark)


def strip_emoji(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, EMOJI, " "), EMOTICON, " ")


def collapse_repeats(c: Column) -> Column:
    """Three equal characters or more become one, digits included."""
    return F.regexp_replace(c, r"(.)\1{2,}", "$1")


def clean_text(c: Column) -> Column:
    """The normalisations in their order."""
    for f in (strip_invisible, mask_urls, strip_emoji, collapse_repeats, normalize_tone_marks, normalize_punct, normalize_whitespace):
        c = f(c)
    return c


def fold(c: Column) -> Column:
    """Lower case with single blanks: what fingerprints and phrase search compare."""
    return F.trim(F.regexp_replace(F.lower(c), r"[\s]+", " "))


def fingerprint(c: Column) -> Column:
    return F.sha1(fold(c))


def letters(c: Column) -> Column:
    return kept(c, r"\p{L}")


def kept(c: Column, letters: str) -> Column:
    """How many characters of a class a text has: what isn't of it goes in runs, which is faster than counting matches."""
    return F.length(F.regexp_replace(c, f"[^{letters}]+", ""))


def ratio(a: Column, b: Column, empty: float = 0.0) -> Column:
    return F.when(b > 0, a / b).otherwise(F.lit(empty))


def diacritic_ratio(c: Column) -> Column:
    """Vietnamese letters with a mark among all letters."""
    return ratio(marked(c), letters(c))


def marked(c: Column) -> Column:
    return F.length(c) - F.length(F.translate(c, MARKED, ""))


def tokens(c: Column) -> Column:
    """Runs of word characters, lower case."""
    return F.array_remove(F.split(F.lower(c), r"[^\p{L}\p{N}_]+", -1), "")


def segment_paragraphs(c: Column) -> Column:
    """Parts between blank lines; if there is one only, lines of 15 characters or more; else the whole."""
    stripped = lambda a: F.filter(F.transform(a, lambda x: strip(x)), lambda x: x != "")
    parts = stripped(F.split(c, r"\n\s*\n", -1))
    lines = F.filter(stripped(F.split(c, "\n", -1)), lambda x: F.length(x) >= 15)
    whole = F.when(strip(c) != "", F.array(strip(c))).otherwise(F.array().cast("array<string>"))
    return F.when(F.size(parts) > 1, parts).when(F.size(lines) > 0, lines).otherwise(whole)


def split_sentences(c: Column) -> Column:
    """Parts behind closing punctuation and before a capital, accented letter, digit, quote or bracket; not behind initials."""
    glued = F.regexp_replace(c, r"(?U)\b([A-Z\x{C0}-\x{1EF8}])\.\s*", "$1.")
    parts = F.split(strip(glued), r"(?<=[.!?…])\s+(?=[A-Z\x{C0}-\x{1EF8}0-9\"'(])", -1)
    return F.filter(F.transform(parts, lambda x: strip(x)), lambda x: x != "")


def keyword_coverage(text: Column, keywords: Column) -> Column:
    """Share of keyword groups (variants between bars) of which some variant is in the text; 0 without keywords."""
    low = F.lower(text)
    return ratio(keyword_hits(low, keywords), F.size(keywords))


def keyword_hits(low: Column, keywords: Column) -> Column:
    """How many keyword groups have a variant in a lower-case text; a group without variants never hits."""
    hit = lambda k: F.exists(F.split(k, r"\|"), lambda v: (F.trim(v) != "") & F.contains(low, F.lower(F.trim(v))))
    return F.size(F.filter(keywords, hit))


def missing_keywords(text: Column, keywords: Column) -> Column:
    """The keyword groups of which no variant is in the text, each by its first variant in lower case."""
    low = F.lower(text)
    absent = lambda k: (F.trim(k) != "") & ~F.exists(F.split(k, r"\|"), lambda v: (F.trim(v) != "") & F.contains(low, F.lower(F.trim(v))))
    first = lambda k: F.element_at(F.filter(F.transform(F.split(k, r"\|"), lambda v: F.lower(F.trim(v))), lambda v: v != ""), 1)
    return F.transform(F.filter(keywords, lambda k: F.exists(F.split(k, r"\|"), lambda v: F.trim(v) != "") & absent(k)), first)


def cosine(a: Column, b: Column) -> Column:
    """0 where a norm is 0."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a) * dot(b, b))
    return F.when(norm > 0, dot(a, b) / norm).otherwise(F.lit(0.0))


def csv_safe(c: Column) -> Column:
    """A quote before what a spreadsheet would run as a formula."""
    return F.when(F.ltrim(c).rlike(r"^[=+\-@]"), F.concat(F.lit("'"), c)).otherwise(c)

"""Vietnamese: abbreviations, tones, syllables."""

from __future__ import annotations

import unicodedata
from functools import cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Chat abbreviations and what they stand for.
ABBREVIATIONS = {
    "ko": "không", "k": "không", "kg": "không", "khg": "không", "hok": "không", "hong": "không", "hem": "không", "k0": "không",
    "dc": "được", "đc": "được", "duoc": "được", "j": "gì", "z": "vậy", "vs": "với", "v": "vậy", "ntn": "như thế nào",
    "nhu the nao": "như thế nào", "bth": "bình thường", "bt": "bình thường", "nx": "nữa", "nc": "nước", "ng": "người",
    "ngta": "người ta", "mn": "mọi người", "ae": "anh em", "vn": "Việt Nam", "hs": "học sinh", "sv": "sinh viên",
    "gv": "giảng viên", "tp": "thành phố", "tphcm": "Thành phố Hồ Chí Minh", "hn": "Hà Nội", "cty": "công ty",
    "ctr": "chương trình", "kt": "kinh tế", "xh": "xã hội", "vd": "ví dụ", "vdu": "ví dụ", "tv": "thành viên",
    "nvl": "nguyên vật liệu", "sx": "sản xuất", "kd": "kinh doanh", "qly": "quản lý", "ql": "quản lý", "pt": "phát triển",
    "nn": "nhà nước", "cn": "công nghệ", "cnh": "công nghiệp hoá", "hđh": "hiện đại hoá", "tt": "thị trường",
    "dn": "doanh nghiệp", "đt": "đầu tư", "lđ": "lao động", "sp": "sản phẩm", "kh": "khách hàng", "tks": "cảm ơn",
    "ok": "được", "oke": "được", "okay": "được",
}
# Onsets, rimes without tones, and loaned syllables.
ONSETS = [
    "", "b", "c", "ch", "d", "đ", "g", "gh", "gi", "h", "k", "kh", "l", "m",
    "n", "ng", "ngh", "nh", "p", "ph", "qu", "r", "s", "t", "th", "tr", "v", "x",
]
RIMES = [
    "a", "ă", "â", "e", "ê", "i", "o", "ô", "ơ", "u", "ư", "y",
    "ia", "iê", "yê", "ua", "uô", "ưa", "ươ",
    "oa", "oe", "oo", "uy", "uê", "uơ", "uâ", "uă", "ue", "ui", "uo",
    "ai", "ao", "au", "ay", "âu", "ây", "eo", "êu", "iu", "oi", "ôi", "ơi",
    "ưi", "ưu", "iêu", "yêu", "uôi", "ươi", "ươu", "oai", "oay",
    "uay", "uai", "uôm",
    "am", "ăm", "âm", "em", "êm", "im", "om", "ôm", "ơm", "um", "ươm", "iêm", "yêm",
    "an", "ăn", "ân", "en", "ên", "in", "on", "ôn", "ơn", "un", "ưn", "ươn", "iên", "yên", "uôn",
    "ang", "ăng", "âng", "eng", "êng", "ing", "ong", "ông", "ung", "ưng", "ương", "iêng", "uông",
    "anh", "ênh", "inh", "oanh", "uynh", "uênh",
    "ach", "êch", "ich", "oach", "uych",
    "ap", "ăp", "âp", "ep", "êp", "ip", "op", "ôp", "ơp", "up", "ươp", "iêp", "yêp",
    "at", "ăt", "ât", "et", "êt", "it", "ot", "ôt", "ơt", "ut", "ưt", "ươt", "iêt", "yêt", "uôt",
    "ac", "ăc", "âc", "ec", "oc", "ôc", "uc", "ưc", "ươc", "iêc", "uôc",
    "oam", "oan", "oang", "oat", "oac", "oăn", "oăng", "oăt", "oăc", "oen", "oet",
    "uân", "uâng", "uât", "uyên", "uyêt", "uyn", "uyt", "uym", "uâc",
]
LOANS = ["pa", "pi", "pe", "po", "pu", "ga", "go", "gu", "ka", "ki", "ko", "we", "fa", "vi", "ve", "va", "za"]
#: Onsets whose spelling depends on what follows; the others take every rime.
BOUND = ("k", "c", "gh", "ngh", "g", "ng", "qu", "p")
#: Runs of letters, as a range of code points.
WORD = r"[a-zA-Z\x{C0}-\x{1EF9}]+"
_TONES = "̣̀́̉̃"
_BASES = "aăâeêioôơuưy"
#: Lower-case vowels with a tone, and without it.
TONED = "".join(unicodedata.normalize("NFC", b + t) for b in _BASES for t in _TONES)
TONELESS = "".join(b * len(_TONES) for b in _BASES)


@cache
def syllable_pattern() -> str:
    """One expression for all syllables without tones: each class of onsets with the rimes that spelling allows."""
    starting = lambda letters: [r for r in RIMES if r[0] in letters]
    classes = [
        ([o for o in ONSETS if o not in BOUND], RIMES),
        (["k"], starting("ieêy")),
        (["c"], [r for r in RIMES if r[0] not in "ieêy"]),
        (["gh", "ngh"], starting("ieê")),
        (["g"], [r for r in RIMES if r[0] not in "ieê"] + ["i"]),
        (["ng"], [r for r in RIMES if r[0] not in "ieê"]),
        (["qu"], starting("aăâeêiyoôơu")),
        (["p"], ["in", "ip", "a", "e", "o"]),
    ]
    return "^(?:" + "|".join(f"(?:{'|'.join(o)})(?:{'|'.join(r)})" for o, r in classes) + f"|{'|'.join(LOANS)})$"


def strip_tone(c: Column) -> Column:
    """Lower-case vowels lose their tone and keep their mark."""
    return F.translate(c, TONED, TONELESS)


@F.pandas_udf(StringType())
def nfc(s: pd.Series) -> pd.Series:
    """Canonical composition, for which there is no built-in function."""
    return s.map(lambda x: x if x is None else unicodedata.normalize("NFC", x))


@F.pandas_udf(StringType())
def nfkc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: x if x is None else unicodedata.normalize("NFKC", x))


@F.pandas_udf(StringType())
def strip_marks(s: pd.Series) -> pd.Series:
    """No diacritics at all."""

    def plain(x):
        if x is None:
            return x
        return "".join(c for c in unicodedata.normalize("NFD", x.replace("đ", "d").replace("Đ", "D")) if unicodedata.category(c) != "Mn")

    return s.map(plain)


def is_syllable(word: Column) -> Column:
    return strip_tone(F.lower(F.trim(word))).rlike(syllable_pattern())


def words(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(f"({WORD})"), F.lit(1))


def _abbreviations() -> Column:
    return F.create_map(*(F.lit(x) for pair in ABBREVIATIONS.items() for x in pair))


def count_abbreviations(c: Column) -> Column:
    found = F.regexp_extract_all(F.lower(c), F.lit(r"([\p{L}\p{N}_]+)"), F.lit(1))
    return F.size(F.filter(found, lambda w: w.isin(*ABBREVIATIONS)))


def expand_abbreviations(c: Column) -> Column:
    """Whole words by the table; a capital at the start stays and the rest becomes lower case."""
    parts = F.regexp_extract_all(c, F.lit(r"([\p{L}\p{N}_]+|[^\p{L}\p{N}_]+)"), F.lit(1))

    def replaced(w):
        out = F.element_at(_abbreviations(), F.lower(w))
        capital = F.concat(F.upper(F.substring(out, 1, 1)), F.lower(F.substring(out, 2, 1000)))
        return F.when(w.rlike(r"^\p{Lu}"), F.coalesce(capital, w)).otherwise(F.coalesce(out, w))

    return F.array_join(F.transform(parts, replaced), "")

"""Features of an essay: surface, vocabulary, errors and discourse. Null texts count as empty."""

from __future__ import annotations

from functools import reduce
from operator import add

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from .phrases import phrase_counts, phrases_found
from .text import cosine, diacritic_ratio, once, ratio, segment_paragraphs, split_sentences
from .vietnamese import is_syllable, words

# Function words.
STOP_WORDS = (
    "và là của có được cho những các một trong với đã sẽ đang không này đó khi thì mà nên như để về từ theo tại bởi vì nếu nhưng hay "
    "hoặc cũng rất nhiều ít vẫn đều còn chỉ nữa lại ra vào lên xuống ở trên dưới sau trước giữa cùng bằng người ta tôi bạn chúng anh "
    "chị em họ nó ai gì nào đâu sao bao nhiêu việc điều cái con chiếc sự cách thứ phần mỗi mọi toàn tất cả"
).split()
# Connectives by family.
CONNECTIVES = {
    "bo_sung": ["ngoài ra", "bên cạnh đó", "hơn nữa", "thêm vào đó", "đồng thời", "không những thế", "mặt khác", "cũng như"],
    "nguyen_nhan": ["vì", "bởi vì", "do", "do đó", "vì vậy", "cho nên", "nên", "dẫn đến", "kéo theo", "nguyên nhân là", "sở dĩ"],
    "ket_qua": ["kết quả là", "vì thế", "từ đó", "nhờ vậy", "hệ quả là", "suy ra"],
    "tuong_phan": ["tuy nhiên", "nhưng", "trái lại", "ngược lại", "mặc dù", "dù vậy", "song", "thế nhưng", "trong khi đó"],
    "vi_du": ["ví dụ", "chẳng hạn", "cụ thể là", "điển hình là", "minh chứng", "đơn cử", "thực tế cho thấy"],
    "trinh_tu": ["trước hết", "đầu tiên", "thứ nhất", "thứ hai", "thứ ba", "tiếp theo", "sau đó", "cuối cùng", "một là", "hai là"],
    "ket_luan": ["tóm lại", "nhìn chung", "nói tóm lại", "kết luận", "như vậy", "có thể thấy", "tổng kết lại", "vì những lẽ trên"],
    "nhan_manh": ["đặc biệt", "quan trọng hơn", "cần nhấn mạnh", "đáng chú ý", "rõ ràng", "chắc chắn"],
}
# Marks of argument, stock phrases, machine style, informal speech.
ARGUMENT = [
    "theo tôi", "quan điểm", "luận điểm", "có thể khẳng định", "cần nhận thấy", "điều này cho thấy", "chứng tỏ", "phân tích", "lí giải",
    "lý giải", "một mặt", "mặt khác", "phản biện", "ngược lại có ý kiến", "giả sử", "số liệu", "thống kê", "nghiên cứu chỉ ra",
    "theo tác giả", "dẫn chứng",
]
STOCK = [
    "từ xưa đến nay", "trong cuộc sống hiện đại ngày nay", "có thể nói rằng", "như chúng ta đã biết", "không thể phủ nhận rằng",
    "đóng vai trò vô cùng quan trọng", "là một vấn đề nhức nhối", "gây ra nhiều hậu quả nghiêm trọng", "mỗi chúng ta cần phải",
    "hãy chung tay", "thiết nghĩ",
]
MACHINE = [
    "điều quan trọng cần lưu ý là", "trong bối cảnh đó", "đóng vai trò then chốt", "một cách toàn diện", "đa chiều", "tối ưu hoá",
    "tận dụng tối đa", "nói tóm lại, có thể thấy rằng", "dưới đây là", "thứ nhất, thứ hai, thứ ba", "không chỉ ... mà còn",
    "trong thời đại số",
]
INFORMAL = [
    "thì là", "kiểu như", "nói chung là", "cái này", "cái mà", "á", "ạ", "nha", "nhé", "nhá", "ừ", "ờ", "vãi", "cực kỳ luôn", "siêu",
    "chill", "ok", "mình nghĩ là", "theo mình", "kiểu", "đấy", "ấy", "thôi",
]
# Words often confused, with the right form.
CONFUSED = {
    "chia sẽ": "chia sẻ", "sữa chữa": "sửa chữa", "bổ xung": "bổ sung", "chuẩn đoán": "chẩn đoán", "cọ sát": "cọ xát",
    "dành giật": "giành giật", "giành thời gian": "dành thời gian", "sáng lạng": "xán lạn", "tựu chung": "tựu trung",
    "trau chuốt": "chau chuốt", "xúc tích": "súc tích", "thăm quan": "tham quan", "vô hình chung": "vô hình trung",
    "nhậm chức": "nhận chức", "đường xá": "đường sá", "xuất xắc": "xuất sắc", "sáng lạn": "xán lạn", "nhất chí": "nhất trí",
    "giả thuyết": "giả thiết", "chuyện môn": "chuyên môn", "bàng quang": "bàng quan", "kết cục": "kết cuộc", "năng nỗ": "năng nổ",
    "nổ lực": "nỗ lực", "sơ xuất": "sơ suất", "xán lạng": "xán lạn", "trong xuốt": "trong suốt", "suất sắc": "xuất sắc",
    "sử lý": "xử lý",
}
# Ways to cite.
CITATIONS = (r"\[\d+\]", r"(?U)\([A-Z\x{C0}-\x{1EF8}][\w.]+,?\s*\d{4}\)", r"(?iU)\b(theo|dẫn theo|trích|nguồn)\s*[:\-]?\s*[A-Z\x{C0}-\x{1EF8}]", r"(?iU)\b(tài liệu tham khảo|danh mục tài liệu)\b")


#: The lists that features count, by the name of their count; one pass over a text counts them all.
MARKERS = {f"conn_{k}": v for k, v in CONNECTIVES.items()} | {"argument": ARGUMENT, "stock": STOCK, "machine": MACHINE, "confused": list(CONFUSED), "informal": INFORMAL}


def with_markers(df: DataFrame, text: str = "text") -> DataFrame:
    """df with _hits, a struct with the counts of MARKERS in a text in lower case; unchanged where df has it."""
    return df if "_hits" in df.columns else df.withColumn("_hits", phrase_counts(F.lower(F.coalesce(F.col(text), F.lit(""))), MARKERS))


def _mean(a: Column) -> Column:
    return F.when(F.size(a) > 0, F.aggregate(a, F.lit(0.0), lambda s, x: s + x) / F.size(a)).otherwise(0.0)


def _text(df: DataFrame, text: str) -> DataFrame:
    return df.withColumn("_t", F.coalesce(F.col(text), F.lit("")))


def surface(df: DataFrame, text: str = "text") -> DataFrame:
    """df with counts, lengths of words and sentences, and their spread."""
    c = F.col
    d = _text(df, text).withColumns({"_w": words(c("_t")), "_s": split_sentences(c("_t")), "_p": F.size(segment_paragraphs(c("_t")))})
    d = d.withColumn("_l", F.transform("_s", lambda s: F.regexp_count(s, F.lit(r"[a-zA-Z\x{C0}-\x{1EF9}]+")).cast("double")))
    n_w, n_s = F.size("_w"), F.size("_s")
    share = lambda test: ratio(F.size(F.filter("_l", test)), n_s)
    out = d.withColumns({
        "n_chars": F.length("_t").cast("double"), "n_words": n_w.cast("double"), "n_sentences": n_s.cast("double"), "n_paragraphs": c("_p").cast("double"),
        "mean_sentence_len": _mean(c("_l")),
        "std_sentence_len": F.sqrt(once(_mean(c("_l")), lambda m: _mean(F.transform("_l", lambda x: (x - m) * (x - m))))),
        "max_sentence_len": F.coalesce(F.array_max("_l"), F.lit(0.0)),
        "pct_long_sentences": share(lambda x: x > 40), "pct_short_sentences": share(lambda x: x < 5),
        "mean_word_len": _mean(F.transform("_w", lambda w: F.length(w).cast("double"))),
        "words_per_paragraph": ratio(n_w, c("_p")), "sentences_per_paragraph": ratio(n_s, c("_p")),
        "n_numbers": F.regexp_count("_t", F.lit(r"\d+(?:[.,]\d+)*")).cast("double"), "diacritic_ratio": diacritic_ratio(c("_t")),
    })
    return out.drop("_t", "_w", "_s", "_p", "_l")


@F.pandas_udf(DoubleType())
def mtld(tokens: pd.Series) -> pd.Series:
    """Lexical diversity read forwards and backwards: mean length of runs that keep a type-token ratio over 0.72."""

    def factors(ws) -> float:
        count, seen, size = 0.0, set(), 0
        for w in ws:
            seen.add(w)
            size += 1
            if len(seen) / size <= 0.72:
                count, seen, size = count + 1, set(), 0
        return count + ((1 - len(seen) / size) / (1 - 0.72) if size else 0.0)

    def score(ws) -> float:
        if ws is None or len(ws) < 20:
            return float(len(set(ws))) if ws is not None else 0.0
        return sum(len(ws) / f if f else float(len(ws)) for f in (factors(ws), factors(ws[::-1]))) / 2

    return tokens.map(score)


def lexical(df: DataFrame, key: str, text: str = "text", terms: tuple[str, ...] = ()) -> DataFrame:
    """(key, ttr, root_ttr, content_word_ratio, unique_content_ratio, lexical_entropy, hapax_ratio, top1_word_freq, long_word_ratio, term_density).

    Words are counted by document and word, then by document; documents without words have zeros.
    """
    d = _text(df, text)
    counts = d.select(key, F.explode(words(F.lower("_t"))).alias("w")).groupBy(key, "w").agg(F.count("*").alias("c"))
    own = ~F.col("w").isin(*STOP_WORDS)
    agg = counts.groupBy(key).agg(
        F.sum("c").alias("n"),
        F.count("*").alias("types"),
        F.sum(F.when(own, F.col("c")).otherwise(0)).alias("content"),
        F.count_if(own).alias("content_types"),
        F.sum(F.col("c") * F.log2("c")).alias("clogc"),
        F.count_if(F.col("c") == 1).alias("once"),
        F.max("c").alias("top"),
        F.sum(F.when(F.length("w") >= 7, F.col("c")).otherwise(0)).alias("long"),
    )
    hits = phrase_counts(F.lower("_t"), {"n": [t.lower() for t in terms]})["n"] if terms else F.lit(0.0)
    joined = d.select(F.col(key).alias("_k"), hits.alias("_h")).join(agg, F.col("_k") == F.col(key), "left")
    c, zero = F.col, lambda x: F.coalesce(x, F.lit(0.0))
    return joined.select(
        c("_k").alias(key),
        zero(c("types") / c("n")).alias("ttr"),
        zero(c("types") / F.sqrt("n")).alias("root_ttr"),
        zero(c("content") / c("n")).alias("content_word_ratio"),
        zero(c("content_types") / F.greatest("content", F.lit(1))).alias("unique_content_ratio"),
        zero(F.log2("n") - c("clogc") / c("n")).alias("lexical_entropy"),
        zero(c("once") / c("types")).alias("hapax_ratio"),
        zero(c("top") / c("n")).alias("top1_word_freq"),
        zero(c("long") / c("n")).alias("long_word_ratio"),
        zero(c("_h") / c("n")).alias("term_density"),
    )


def suspects(text: Column) -> Column:
    """Words that start in lower case and aren't syllables, in order, repeats included."""
    return F.filter(words(text), lambda w: ~w.rlike(r"^\p{Lu}") & ~is_syllable(w))


def spell_errors(text: Column, limit: int = 30) -> Column:
    """The first distinct suspects: evidence for feedback."""
    return F.slice(F.array_distinct(F.transform(suspects(text), F.lower)), 1, limit)


def confusions(text: Column) -> Column:
    """'wrong -> right' for each pair of the table that a text has."""
    pairs = F.array(*(F.lit(f"{a} -> {b}") for a, b in CONFUSED.items()))
    return F.transform(phrases_found(F.lower(text), list(CONFUSED)), lambda i: F.get(pairs, i))


def errors(df: DataFrame, text: str = "text") -> DataFrame:
    """df with rates of suspect spellings, confusions, informal words, sentence ends and spaces at punctuation."""
    c = F.col
    d = with_markers(_text(df, text), text).withColumns({"_n": F.size(words(c("_t"))), "_b": F.size(suspects(c("_t"))), "_s": split_sentences(c("_t"))})
    some = lambda p: F.size(F.filter("_s", lambda s: s.rlike(p)))
    spaces = F.regexp_count("_t", F.lit(r"\s[,.;:!?]")) + F.regexp_count("_t", F.lit(r"[,.;:][^\s\d]"))
    out = d.withColumns({
        "spell_error_rate": ratio(c("_b"), c("_n")), "n_spell_errors": c("_b").cast("double"),
        "confusion_rate": c("_hits.confused") / F.greatest(F.lit(1.0), c("_n") / 100),
        "informal_rate": ratio(c("_hits.informal"), c("_n")),
        "no_capital_sentence_rate": ratio(some(r"^\p{Ll}"), F.size("_s")), "no_end_punct_rate": ratio(some(r"[^.!?…\"')]$"), F.size("_s")),
        "punct_error_rate": spaces / F.greatest(F.lit(1.0), F.length("_t") / 100),
    })
    return out.drop("_t", "_n", "_b", "_s", *({"_hits"} - set(df.columns)))


def _overlaps(parts: Column) -> Column:
    """Jaccard similarity of the content words of neighbours, where both have any."""
    own = F.transform(parts, lambda s: F.array_distinct(F.filter(words(F.lower(s)), lambda w: ~w.isin(*STOP_WORDS))))

    def pairs(sets):
        nxt = F.slice(sets, 2, F.greatest(F.size(sets) - 1, F.lit(0)))
        both = F.filter(F.arrays_zip(F.slice(sets, 1, F.size(nxt)).alias("a"), nxt.alias("b")), lambda z: (F.size(z["a"]) > 0) & (F.size(z["b"]) > 0))
        return F.transform(both, lambda z: once(F.size(F.array_intersect(z["a"], z["b"])), lambda k: k / (F.size(z["a"]) + F.size(z["b"]) - k)))

    return once(own, pairs)


def discourse(df: DataFrame, text: str = "text") -> DataFrame:
    """df with densities of connectives and marks, overlaps of neighbours, and signs of structure."""
    c, per = F.col, lambda x: x / (F.greatest(F.lit(1), F.col("_n")) / 100)
    d = with_markers(_text(df, text), text).withColumns({"_n": F.size(words(c("_t"))), "_p": segment_paragraphs(c("_t")), "_s": split_sentences(c("_t"))})
    d = d.withColumns({f"conn_{k}": c(f"_hits.conn_{k}") for k in CONNECTIVES}).withColumns({"_so": _overlaps(c("_s")), "_po": _overlaps(c("_p"))})
    families = [c(f"conn_{k}") for k in CONNECTIVES]
    has = lambda at, phrases: reduce(lambda a, b: a | b, (F.contains(F.lower(F.coalesce(at, F.lit(""))), F.lit(p)) for p in phrases))
    d = d.withColumns({
        "has_intro": (has(F.get("_p", F.lit(0)), CONNECTIVES["trinh_tu"][:4]) | (F.size("_p") >= 3)).cast("double"),
        "has_conclusion": has(F.get("_p", F.size("_p") - 1), CONNECTIVES["ket_luan"]).cast("double"),
    })
    out = d.withColumns({
        "connective_density": per(reduce(add, families)), "connective_variety": reduce(add, ((f > 0).cast("double") for f in families)),
        "argument_marker_density": per(c("_hits.argument")), "cliche_density": per(c("_hits.stock")),
        "ai_style_score": per(c("_hits.machine")),
        "has_citation": reduce(lambda a, b: a | b, (c("_t").rlike(p) for p in CITATIONS)).cast("double"),
        "sentence_overlap_mean": _mean(c("_so")), "sentence_overlap_min": F.coalesce(F.array_min("_so"), F.lit(0.0)),
        "paragraph_overlap_mean": _mean(c("_po")),
        "structure_score": (c("has_intro") + c("has_conclusion") + F.least(F.lit(1.0), F.size("_p") / 4)) / 3,
    })
    return out.drop("_t", "_n", "_p", "_s", "_so", "_po", *({"_hits"} - set(df.columns)))


def centroid_similarity(df: DataFrame, vector: str) -> DataFrame:
    """df with sim_centroid: cosine to the mean vector, which has one number a dimension and is broadcast."""
    dims = df.select(F.posexplode(vector).alias("i", "x")).groupBy("i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    centre = dims.agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("_c"))
    return df.join(F.broadcast(centre)).withColumn("sim_centroid", cosine(F.col(vector), F.col("_c"))).drop("_c")

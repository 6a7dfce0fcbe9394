"""Scalar expressions over text, dates and numbers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def ustrip(c: Column) -> Column:
    """Trim all Unicode white space."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def blank_to(c: Column, value: str) -> Column:
    return F.coalesce(F.nullif(F.trim(c), F.lit("")), F.lit(value))


def keyword_match(cols: list[str], keyword: str) -> Column:
    """Case-insensitive containment in any of the columns; the keyword's signs stand for themselves."""
    return reduce(Column.__or__, [F.contains(F.lower(F.coalesce(F.col(c), F.lit(""))), F.lit(keyword.lower())) for c in cols])


def strip_html(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(c, r"<[^>]+>", " "), r"\s+", " "))


def safe_name(c: Column, mode: str = "storage") -> Column:
    """A name fit for a store.

    ``storage``: unsafe characters to underscores, repeats collapsed, ends
    stripped; 12 hex digits of MD5 where nothing is left. ``session``:
    characters unfit for files to hyphens, repeats collapsed, ends stripped,
    ``unknown`` where nothing is left. ``file``: the path's last part, with
    spaces and unfit characters as underscores.
    """
    if mode == "session":
        s = F.regexp_replace(F.regexp_replace(F.regexp_replace(c, r'[<>:"/\\|?*]', "-"), "-+", "-"), "^-|-$", "")
        return F.coalesce(F.nullif(s, F.lit("")), F.when(c.isNotNull(), F.lit("unknown")))
    if mode == "file":
        return F.regexp_replace(F.substring_index(c, "/", -1), r'[ /\\:*?"<>|]', "_")
    if mode != "storage":
        raise ValueError(f"no mode {mode}")
    s = F.regexp_replace(F.regexp_replace(c, r"[^A-Za-z0-9._-]+", "_"), r"_+", "_")
    s = F.regexp_replace(s, r"^[_.]+|[_.]+$", "")
    return F.when(F.length(s) == 0, F.substring(F.md5(c), 1, 12)).otherwise(s)


def parse_date(c: Column) -> Column:
    """ISO, dotted, slashed, Korean and eight-digit dates; null for anything else."""
    s = ustrip(c)
    korean = F.regexp_replace(s, r"^(\d{4})년\s*(\d{1,2})월\s*(\d{1,2})일$", "$1-$2-$3")
    plain = F.regexp_replace(korean, r"[./]", "-")
    return F.coalesce(F.try_to_date(plain, "yyyy-M-d"), F.try_to_date(plain, "yyyyMMdd"))


def safe_decimal(c: Column) -> Column:
    """Money as DECIMAL(18,4); what is not a number, and zero, is null."""
    return F.nullif(F.regexp_replace(ustrip(c), ",", "").try_cast("decimal(18,4)"), F.lit(0).cast("decimal(18,4)"))


def margin_pct(price: Column, cost: Column) -> Column:
    return F.when((price > 0) & cost.isNotNull(), F.round((price - cost) / price * 100, 2) + 0.0)


def language_by_script(c: Column) -> Column:
    """JP above 50 kana and more than KO; KO above 50 Hangul; EN above 100 letters with under 10 Hangul; else KO."""
    jp, ko, en = F.regexp_count(c, F.lit(r"[぀-ヿ]")), F.regexp_count(c, F.lit(r"[가-힣]")), F.regexp_count(c, F.lit(r"[A-Za-z]"))
    return F.when((jp > 50) & (jp > ko), "JP").when(ko > 50, "KO").when((en > 100) & (ko < 10), "EN").otherwise("KO")


# Marks of a language in file names, in the order in which they are tried.
NAME_LANGUAGES = {
    "KO": r"\(kr\)|\(kor\)|_kr\b|_kor\b|한국어|korean",
    "EN": r"\(en\)|\(eng\)|_en\b|_eng\b|english|\ben\b.*manual",
    "JP": r"\(jp\)|\(jpn\)|_jp\b|_jpn\b|日本語|japanese|マニュアル|取扱",
    "CN": r"\(cn\)|\(chn\)|_cn\b|_chn\b|中文|中國|chinese|중국어|使用手册|操作说明|气压|气动",
}


def language_by_name(c: Column) -> Column:
    """Language of a file by its name: the first mark, else KO for two Hangul syllables in a row, else UNKNOWN."""
    low = F.lower(c)
    return F.coalesce(*[F.when(low.rlike(p), lang) for lang, p in NAME_LANGUAGES.items()], F.when(c.rlike("[가-힣]{2,}"), "KO"), F.lit("UNKNOWN"))


def natural_key(c: Column) -> Column:
    """Lower case with the length of every run of digits before it (leading zeros aside), so that page_2 sorts before page_10.

    Runs may be of any length up to 9,999 digits; those of equal value and other leading zeros tie.
    """

    def digits(x: Column) -> Column:
        value = F.regexp_replace(x, r"^0+(?=\d)", "")
        return F.concat(F.lpad(F.char_length(value).cast("string"), 4, "0"), value)

    runs = F.regexp_extract_all(F.lower(c), F.lit(r"(\d+|\D+)"), F.lit(1))
    return F.array_join(F.transform(runs, lambda x: F.when(x.rlike(r"^\d+$"), digits(x)).otherwise(x)), "")


def fix_mojibake(c: Column) -> Column:
    """Latin-1 bytes read again as UTF-8 where that is valid and differs."""
    latin = c.rlike(r"^[\x00-\xFF]*$")
    raw = F.encode(F.when(latin, c), "ISO-8859-1")
    fixed = F.when(F.is_valid_utf8(raw.cast("string")), F.decode(raw, "UTF-8"))
    return F.coalesce(fixed, c)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity in double; null for zero vectors."""

    def dot(x, y):
        return F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)

    return dot(a, b) / F.nullif(F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)), F.lit(0.0))


def page_type(text_len: Column, drawings: Column, rasters: Column, tables: Column, vector_drawings: int = 20) -> Column:
    """Nine kinds of page; one with ``vector_drawings`` or more and little else is a diagram."""
    drawn = drawings >= vector_drawings
    return (
        F.when((text_len < 30) & (drawings < 5) & (rasters == 0), "empty")
        .when(drawn & (text_len >= 3000), "diagram+text")
        .when(drawn & (rasters <= 1), "diagram")
        .when(tables > 0, F.when(drawings >= 10, "table+diagram").otherwise("table"))
        .when(rasters > 0, F.when(text_len > 100, "image+text").otherwise("image"))
        .when(text_len > 100, "text")
        .otherwise("minimal")
    )


def truncate_vector(c: Column, n: int) -> Column:
    """The first ``n`` components."""
    return F.slice(c, 1, n)

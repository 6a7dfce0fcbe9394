"""Figures of HTML manuals: sources, decoded captions, flags and file names."""

from __future__ import annotations

from html.entities import name2codepoint

from pyspark.sql import Column
from pyspark.sql import functions as F

from floorops.functions.verdicts import ustrip

#: Numeric references from 128 to 159 mean what Windows-1252 has there.
WINDOWS = {i: ord(bytes([i]).decode("cp1252")) for i in range(128, 160) if bytes([i]).decode("cp1252", "ignore")}


def _character(n: Column) -> Column:
    """The character of a code point; the replacement character for none, null for a null."""
    odd = (n <= 0) | n.between(0xD800, 0xDFFF) | (n > 0x10FFFF)
    return F.when(odd, "�").otherwise(F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32"))


def decode_references(c: Column) -> Column:
    """Text with its character references decoded in one pass: the named ones of HTML 4, decimal and hexadecimal ones; others stay as they are."""
    names = F.create_map(*[F.lit(x) for k, v in name2codepoint.items() for x in (k, v)])
    windows = F.create_map(*[F.lit(x) for kv in WINDOWS.items() for x in kv])
    parts = F.regexp_extract_all(c, F.lit(r"(&#[0-9]{1,9};?|&#[xX][0-9a-fA-F]{1,7};?|&[A-Za-z][A-Za-z0-9]*;|[^&]+|&)"), F.lit(1))

    def one(p: Column) -> Column:
        number = F.regexp_extract(p, r"^&#([0-9]+)", 1)
        sixteen = F.regexp_extract(p, r"^&#[xX]([0-9a-fA-F]+)", 1)
        named = F.try_element_at(names, F.regexp_extract(p, r"^&([A-Za-z][A-Za-z0-9]*);", 1))
        n = F.when(number != "", number.cast("int")).when(sixteen != "", F.conv(sixteen, 16, 10).cast("int"))
        n = F.coalesce(F.try_element_at(windows, n), n, named)
        return F.when(p.startswith("&"), F.coalesce(_character(n), p)).otherwise(p)

    return F.array_join(F.transform(parts, one), "")


# The forms of a figure and of a numbered caption, image types, and the words of the flags.
FIGURE = r'(?s)<div\s+class="figure"[^>]*>.*?<img\s+[^>]*src="([^"]*)"[^>]*/?>.*?<div\s+class="figure-caption"[^>]*>(.*?)</div>'
NUMBERED = r"^그림\s*(\d+[-\.]\d+)\s*(.*)"
TYPES = {"jpeg": ".jpg", "png": ".png", "gif": ".gif", "webp": ".webp", "svg+xml": ".svg"}
TOO_SMALL, PLACEHOLDER, PLACE = "이미지 데이터 너무 작음", "플레이스홀더", "삽입 위치"
LEAST_DATA = 200


def image_extension(src: Column) -> Column:
    """The extension of an image's source, by the type of embedded data or by the path; ``.png`` for unknown ones."""
    data = src.startswith("data:image/")
    kind = F.try_element_at(F.create_map(*[F.lit(x) for kv in TYPES.items() for x in kv]), F.regexp_extract(src, r"^data:image/([^;/]*)", 1))
    path = F.lower(F.regexp_extract(F.regexp_extract(src, r"([^/]*)/*$", 1), r"^.+(\.[^.]+)$", 1))
    return F.when(data, F.coalesce(kind, F.lit(".png"))).otherwise(F.coalesce(F.nullif(path, F.lit("")), F.lit(".png")))


def figure_issue(src: Column, caption: Column) -> Column:
    """What looks wrong with a figure, else null."""
    small = src.startswith("data:") & (F.char_length(src) < LEAST_DATA)
    return F.when(small, TOO_SMALL).when(F.contains(F.lower(caption), F.lit("placeholder")) | F.contains(caption, F.lit(PLACE)), PLACEHOLDER)


def figure_name(seq: Column, caption: Column) -> Column:
    """``001_그림_1-2_description`` of a numbered caption, else ``001_caption``; white space as ``_``, without characters unfit for files."""

    def fit(c: Column) -> Column:
        return F.regexp_replace(F.regexp_replace(c, r"\s+", "_"), r'[\\/:*?"<>|]', "")

    number, rest = F.replace(F.regexp_extract(caption, NUMBERED, 1), F.lit("."), F.lit("-")), ustrip(F.regexp_extract(caption, NUMBERED, 2))
    numbered = F.concat(F.lit("그림_"), number, F.when(rest != "", F.concat(F.lit("_"), fit(rest))).otherwise(""))
    return F.concat(F.lpad(seq.cast("string"), F.greatest(F.lit(3), F.length(seq.cast("string"))), F.lit("0")), F.lit("_"), F.when(number != "", numbered).otherwise(fit(caption)))


def figure_blocks(html: Column) -> Column:
    """Array of (src, caption, issue, extension, file_name) of the figure blocks, in order, numbered from 1."""
    sources, captions = (F.regexp_extract_all(html, F.lit(FIGURE), F.lit(i)) for i in (1, 2))

    def one(f: Column, i: Column) -> Column:
        caption = F.regexp_replace(decode_references(ustrip(f["captions"])), "<[^>]+>", "")
        ext = image_extension(f["sources"])
        return F.struct(f["sources"].alias("src"), caption.alias("caption"), figure_issue(f["sources"], caption).alias("issue"), ext.alias("extension"), F.concat(figure_name(i + 1, caption), ext).alias("file_name"))

    return F.transform(F.arrays_zip(sources.alias("sources"), captions.alias("captions")), one)

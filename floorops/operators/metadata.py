"""Maker, model, kind, language and standard name of manuals, from their names and first pages."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Makers by the words that tell of them; the first word of the list that occurs decides.
MAKERS = {
    "삼성": "Samsung", "samsung": "Samsung",
    "오리엔탈모터": "OrientalMotor", "oriental motor": "OrientalMotor", "orientalmotor": "OrientalMotor",
    "미쓰비시": "Mitsubishi", "mitsubishi": "Mitsubishi", "melservo": "Mitsubishi", "melsec": "Mitsubishi",
    "야스카와": "Yaskawa", "yaskawa": "Yaskawa", "sigma": "Yaskawa",
    "파나소닉": "Panasonic", "panasonic": "Panasonic", "minas": "Panasonic",
    "옴론": "Omron", "omron": "Omron",
    "키엔스": "Keyence", "keyence": "Keyence",
    "abb": "ABB", "kuka": "KUKA", "fanuc": "FANUC", "화낙": "FANUC",
    "siemens": "Siemens", "지멘스": "Siemens", "beckhoff": "Beckhoff", "iai": "IAI", "smc": "SMC", "festo": "Festo", "sick": "SICK", "cognex": "Cognex", "hmi": "HMI",
    "ls": "LS", "엘에스": "LS", "delta": "Delta", "델타": "Delta", "autonics": "Autonics", "오토닉스": "Autonics",
    "pro-face": "ProFace", "proface": "ProFace", "weintek": "Weintek", "hiwin": "HIWIN", "thk": "THK", "nsk": "NSK", "schneider": "Schneider",
    "rockwell": "Rockwell", "allen-bradley": "Rockwell", "bosch": "Bosch", "rexroth": "BoschRexroth", "lenze": "Lenze", "sew": "SEW", "danfoss": "Danfoss", "weg": "WEG", "eaton": "Eaton",
    "phoenix": "PhoenixContact", "wago": "WAGO", "balluff": "Balluff", "ifm": "IFM", "baumer": "Baumer",
    "csd5": "Samsung", "csd3": "Samsung", "csvg": "Samsung", "crevis": "Crevis",
}
# Kinds of documents, likewise.
KINDS = {
    "user manual": "UserManual", "사용자 매뉴얼": "UserManual", "사용 설명서": "UserManual", "user's manual": "UserManual", "users manual": "UserManual",
    "operation guide": "OperationGuide", "조작 설명서": "OperationGuide", "operation manual": "OperationManual", "운전 설명서": "OperationManual",
    "install": "InstallGuide", "설치 설명서": "InstallGuide", "설치 매뉴얼": "InstallGuide", "setup": "SetupGuide", "셋업": "SetupGuide", "셋팅": "SetupGuide",
    "maintenance": "MaintenanceManual", "보수": "MaintenanceManual", "정비": "MaintenanceManual", "parameter": "ParameterManual", "파라미터": "ParameterManual",
    "communication": "CommManual", "통신": "CommManual", "protocol": "CommManual", "troubleshoot": "Troubleshooting", "에러": "Troubleshooting", "quick start": "QuickStart",
    "catalog": "Catalog", "카탈로그": "Catalog", "datasheet": "Datasheet", "사양서": "Datasheet", "specification": "Datasheet", "wiring": "WiringGuide", "배선": "WiringGuide",
    "programming": "ProgrammingManual", "ascii": "CommManual", "firmware": "FirmwareNote", "release note": "ReleaseNote",
}
# Tokens that are no model, and the form of one.
NO_MODEL = ("PDF", "DOC", "KOR", "ENG", "Drive", "MAY")
MODEL = r"([A-Z]{2,}-?[A-Z0-9]+-?[A-Z0-9]*)"


def dictionary(spark: SparkSession, words: Mapping[str, str]) -> DataFrame:
    """(pos, word, value) of a mapping, in its order."""
    return spark.createDataFrame([(i, k.lower(), v) for i, (k, v) in enumerate(words.items())], "pos int, word string, value string")


def first_match(docs: DataFrame, text: str, words: DataFrame, name: str, default: str) -> DataFrame:
    """``docs`` with the value of the dictionary's first word, by its order, that occurs in ``text``.

    A dictionary is small and travels whole, as one array in order; a document
    stays where it is, so there is no shuffle, and no branch of the plan for
    each word.
    """
    listed = words.agg(F.sort_array(F.collect_list(F.struct("pos", "word", "value"))).alias("_words"))
    found = F.get(F.filter("_words", lambda w: F.contains(F.col(text), w["word"])), F.lit(0))["value"]
    return docs.join(F.broadcast(listed), F.lit(True)).withColumn(name, F.coalesce(found, F.lit(default))).drop("_words")


def language(text: Column) -> Column:
    """``EN`` with over 100 Latin letters and under 10 Hangul syllables, else ``KO``."""
    ko, en = F.regexp_count(text, F.lit("[가-힣]")), F.regexp_count(text, F.lit("[a-zA-Z]"))
    return F.when((ko < 10) & (en > 100), "EN").otherwise("KO")


def manual_metadata(files: DataFrame, pages: DataFrame, makers: DataFrame, kinds: DataFrame, first_pages: int = 3) -> DataFrame:
    """``files`` (doc, name) with manufacturer, model, doc_type, language and standardized_name.

    Of ``pages`` (doc, page from 1, text) the first ``first_pages`` count, so
    what is gathered of a document is bounded by them. Makers and kinds are
    dictionaries (pos, word, value), looked up in the name without extension
    and those pages, in lower case; the model is the first token of the name
    that looks like one.
    """
    some = pages.filter(F.col("page").between(1, first_pages)).groupBy("doc").agg(F.sort_array(F.collect_list(F.struct("page", "text"))).alias("p"))
    some = some.select("doc", F.concat_ws("", F.transform("p", lambda x: F.concat(F.replace(F.coalesce(x["text"], F.lit("")), F.lit("\0"), F.lit("")), F.lit("\n")))).alias("_text"))
    rows = files.join(some, "doc", "left").withColumn("_text", F.coalesce("_text", F.lit("")))
    stem = F.regexp_replace("name", r"(?<=.)\.[^.]*$", "")
    rows = rows.withColumn("_all", F.concat_ws(" ", F.lower(stem), F.lower("_text")))
    rows = first_match(rows, "_all", makers, "manufacturer", "Unknown")
    rows = first_match(rows, "_all", kinds, "doc_type", "Manual")
    token = F.regexp_extract(stem, MODEL, 1)
    model = F.when((F.char_length(token) >= 3) & ~token.isin(*NO_MODEL), token).otherwise("Unknown")
    rows = rows.withColumn("model", F.coalesce(model, F.lit("Unknown"))).withColumn("language", language(F.col("_text")))
    return rows.withColumn("standardized_name", F.concat(F.concat_ws("_", "manufacturer", "model", "doc_type", "language"), F.lit(".pdf"))).drop("_text", "_all")

"""Chunks of documents: packing by paragraphs, lines or Markdown sections, and reports over chunks.

Packing looks at one text after another, so a helper runs it on Arrow batches;
what it needs of a document is in that document's row.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

_BLANK_LINES = re.compile(r"\n{2,}")
_HEADING = re.compile(r"#{1,4}\s+(.+)")


def pieces(text: str, size: int, overlap: int) -> Iterator[str]:
    """Windows of ``size`` characters, each ``size - overlap`` after the one before."""
    return (text[i : i + size] for i in range(0, len(text), size - overlap))


def by_paragraph(text: str, size: int = 1000, overlap: int = 100) -> list[str]:
    """Paragraphs joined while they fit into ``size`` (one line break counted a join); longer ones cut into windows."""
    done: list[str] = []
    open_, width = [], 0
    for p in filter(None, (x.strip() for x in _BLANK_LINES.split(text))):
        if width + len(p) + 1 > size:
            if open_:
                done.append("\n\n".join(open_))
            open_, width = [], 0
            if len(p) > size:
                done.extend(pieces(p, size, overlap))
                continue
        width += len(p) + 2 * bool(open_)
        open_.append(p)
    return done + (["\n\n".join(open_)] if open_ else [])


def by_line(text: str, size: int = 1500, overlap: int = 200) -> list[str]:
    """Lines joined while they fit into ``size``; the last ``overlap`` characters of a chunk begin the next."""
    if len(text) <= size:
        return [text] if text.strip() else []
    done, now = [], ""
    for line in text.split("\n"):
        if len(now) + len(line) + 1 <= size:
            now = f"{now}\n{line}" if now else line
            continue
        done.append(now)
        now = f"{now[-overlap:]}\n{line}" if len(now) > overlap else line
    return [x for x in (c.strip() for c in [*done, now]) if x]


def _table_parts(rows: list[str], most: int) -> list[str]:
    """A table's text, in parts of about ``most`` characters that repeat its first two lines."""
    whole = "\n".join(rows).strip()
    if len(whole) <= most or len(rows) < 3:
        return [whole]
    head, parts = "\n".join(rows[:2]), [[]]
    room = most - len(head)
    for row in rows[2:]:
        if room < len(row) + 1 and parts[-1]:
            parts.append([])
            room = most - len(head)
        parts[-1].append(row)
        room -= len(row) + 1
    return [head + "\n" + "\n".join(p) for p in parts]


def by_section(text: str, size: int = 1000, overlap: int = 100, least: int = 50, table: int = 2000, name: str = "") -> list[str]:
    """Text and tables of Markdown under their headings, each with the line ``문서: name > 섹션: heading`` above it.

    A text under ``least`` characters joins the next text of the document if
    both fit into ``size``, else the one before; what stays shorter goes.
    """
    blocks: list[list] = []  # kind, heading, lines
    heading = ""
    for line in text.split("\n"):
        is_row = line.strip().startswith("|") and line.strip().endswith("|") and len(line.strip()) > 1
        if found := _HEADING.match(line):
            heading = found[1].strip()
        if found or not blocks or (blocks[-1][0] == "table") != is_row:
            blocks.append(["table" if is_row else "text", heading, []])
        blocks[-1][2].append(line)
    chunks: list[list] = []
    for kind, under, lines in blocks:
        made = _table_parts(lines, table) if kind == "table" else by_paragraph("\n".join(lines), size, overlap)
        chunks += [[kind, under, x.strip()] for x in made]
    out: list[list] = []
    small = None
    for c in chunks:
        if c[0] == "table":
            out.append(c)
        elif small is None:
            small = c if len(c[2]) < least else out.append(c)
        elif len(small[2]) + 2 + len(c[2]) <= size:
            joined = ["text", small[1], f"{small[2]}\n\n{c[2]}"]
            small = joined if len(joined[2]) < least else out.append(joined)
        else:
            out.append(c)
            small = None
    last = next((c for c in reversed(out) if c[0] == "text"), None)
    if small and last and len(last[2]) + 2 + len(small[2]) <= size:
        last[2] += "\n\n" + small[2]
    above = [f"문서: {name}"] if name else []
    return ["\n\n".join(filter(None, [" > ".join(above + ([f"섹션: {h}"] if h else [])), t])) for _, h, t in out if len(t) >= least]


def _joined_short(texts: list[str], least: int, size: int) -> list[str]:
    """Texts in which short ones are joined with the next long one if both fit, else stand before it; the last ones join what is before."""
    out: list[str] = []
    held: list[str] = []
    for t in texts:
        if len(t) < least:
            held.append(t)
            continue
        both = "\n\n".join([*held, t])
        out += [t] if not held else [both] if len(both) <= size else ["\n\n".join(held), t]
        held = []
    if held:
        end = "\n\n".join(held)
        if out and len(out[-1]) + 2 + len(end) <= size:
            out[-1] += "\n\n" + end
        else:
            out.append(end)
    return out


def by_heading(text: str, size: int = 1000, overlap: int = 100, least: int = 50, table: int = 2000, name: str = "") -> list[str]:
    """The other way to cut Markdown: the text under a heading in windows, tables whole or in parts, each with its line above it as in ``by_section``.

    Short texts are joined after that, so what is joined moves up to the place
    of the first; a joined text is under the heading of the first that it
    holds. What stays shorter than ``least`` goes.
    """
    blocks: list[list] = []  # is a table, heading, lines
    heading = ""
    for line in text.split("\n"):
        row = line.strip()
        is_row = row.startswith("|") and row.endswith("|")
        begins = re.match(r"#{1,4}(\s|$)", line)
        if found := _HEADING.match(line):
            heading = found[1].strip()
        if begins or not blocks or blocks[-1][0] != is_row:
            blocks.append([is_row, heading, []])
        blocks[-1][2].append(line)
    parts: list[tuple[bool, str, str]] = []
    for is_table, under, lines in blocks:
        whole = "\n".join(lines).strip()
        if is_table:
            made = _table_parts(whole.split("\n"), table - 1) if len(whole) > table else [whole]
        else:
            made = [whole] if len(whole) <= size else [p.strip() for p in pieces(whole, size, overlap)]
        parts += [(is_table, under, p) for p in made if whole]
    texts = [(t, h) for is_table, h, t in parts if not is_table]
    exact = dict(texts)
    joined = iter([(t, exact.get(t) or next((h for x, h in texts if x in t), "")) for t in _joined_short([t for t, _ in texts], least, size)])
    out = [(t, h) if is_table else next(joined, None) for is_table, h, t in parts]
    above = [f"문서: {name}"] if name else []
    return ["\n\n".join(filter(None, [" > ".join(above + ([f"섹션: {h}"] if h else [])), t])) for t, h in filter(None, out) if len(t.strip()) >= least]


def chunk_with(docs: DataFrame, cut: Callable[..., list[str]], text_col: str = "text", name_col: str | None = None, **how) -> DataFrame:
    """``docs`` without the text, a row for each chunk that ``cut`` makes: (chunk_index from 0, content). Null texts have none."""

    @F.pandas_udf("array<string>")
    def cut_all(texts: pd.Series, names: pd.Series) -> pd.Series:
        return pd.Series([[] if t is None else cut(t, **how, **({"name": n or ""} if name_col else {})) for t, n in zip(texts, names)])

    keep = [c for c in docs.columns if c not in (text_col, "chunk_index", "content")]
    return docs.select(*[F.col(f"`{c}`") for c in keep], F.posexplode(cut_all(F.col(text_col), F.col(name_col) if name_col else F.lit("").alias("n"))).alias("chunk_index", "content"))


def chunk_rows(rows: DataFrame, sheet: list[str], order: str, cells: list[str], size: int = 1000, overlap: int = 100) -> DataFrame:
    """A sheet's non-empty rows, cells joined by `` | `` under its name, in paragraph chunks. A sheet is one text."""
    line = F.concat_ws(" | ", *[F.nullif(F.trim(F.col(c).cast("string")), F.lit("")) for c in cells])
    lines = rows.select(*sheet, F.struct(order, line.alias("line")).alias("r")).filter("r.line <> ''")
    text = F.array_join(F.transform(F.sort_array(F.collect_list("r")), lambda r: r["line"]), "\n")
    return chunk_with(lines.groupBy(*sheet).agg(F.concat(F.lit("## "), F.concat_ws("/", *[F.col(c).cast("string") for c in sheet]), F.lit("\n\n"), text).alias("text")), by_paragraph, size=size, overlap=overlap)


def with_index(df: DataFrame, part: list[str], order: list, base: int = 0) -> DataFrame:
    """A running number in each partition, from ``base``."""
    return df.withColumn("chunk_index", F.row_number().over(W.partitionBy(*part).orderBy(*order)) - 1 + base)


def with_context(elements: DataFrame, doc: str, order: str, text: str, kind: str, k: int = 3) -> DataFrame:
    """Images with the texts of up to ``k`` paragraphs before them and the last heading seen."""
    w = W.partitionBy(doc).orderBy(order)
    rank = elements.withColumn("p", F.sum((F.col(kind) == "paragraph").cast("int")).over(w))
    near = W.partitionBy(doc).orderBy("p").rangeBetween(1 - k, 0)
    told = rank.withColumn("context", F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.col(kind) == "paragraph", F.struct(order, text))).over(near)), lambda x: x[text]), "\n"))
    return told.withColumn("heading", F.last(F.when(F.col(kind) == "heading", F.col(text)), ignorenulls=True).over(w)).filter(F.col(kind) == "image").select(doc, order, "context", "heading")


def document_markdown(chunks: DataFrame, doc: str, order: str, content: str) -> DataFrame:
    """A document's chunks in order, as one text."""
    parts = F.sort_array(F.collect_list(F.struct(order, content)))
    return chunks.groupBy(doc).agg(F.array_join(F.transform(parts, lambda x: x[content]), "\n\n").alias("markdown"))


def chunk_stats(chunks: DataFrame, doc: str, kind: Column, kinds: list[str]) -> DataFrame:
    """Chunks per document, in total and of each kind."""
    return chunks.groupBy(doc).agg(F.count("*").alias("chunks"), *[F.count_if(kind == k).alias(k) for k in kinds])


def assess(pages: DataFrame, doc: str, text: str, min_chars: int = 500, min_ratio: float = 0.3) -> DataFrame:
    """Documents ready for chunks: enough characters, and enough pages with over 50; else the reason to skip."""
    n = F.char_length(F.coalesce(F.col(text), F.lit("")))
    rows = pages.groupBy(doc).agg(F.sum(n).alias("chars"), F.avg(F.when(n > 50, 1).otherwise(0)).alias("ratio"))
    return rows.select(doc, "chars", F.when(F.col("chars") < min_chars, "too_short").when(F.col("ratio") < min_ratio, "few_text_pages").otherwise("ready").alias("verdict"))


def resolve_names(files: DataFrame, folder: str, name: str, order: list, mode: str = "number") -> DataFrame:
    """Same names in a folder told apart: the second gets ``_2`` and so on, or a hash of its old path."""
    rn = F.row_number().over(W.partitionBy(folder, name).orderBy(*order))
    tail = rn.cast("string") if mode == "number" else F.substring(F.md5(F.col(order[0]).cast("string")), 1, 6)
    return files.withColumn("new_name", F.when(rn == 1, F.col(name)).otherwise(F.concat(F.col(name), F.lit("_"), tail)))

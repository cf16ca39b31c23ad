"""Cutting of parsed documents into chunks that stay within sections and a token limit, and tables into records."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ledgermill.functions.text import estimate_tokens

#: Tokens of a chunk, of the overlap of neighbours, and of the smallest table worth a chunk.
MAX_TOKENS, OVERLAP, MIN_TABLE = 800, 60, 20


def tokens_of(text: str) -> int:
    return max(1, len(text) // 4)


def pieces_of(text: str, max_tokens: int) -> list[str]:
    """text in pieces of at most max_tokens: whole lines as long as they fit; a longer line is cut at its last blank before
    the limit, or hard where it has none. Blank pieces are left out."""
    if tokens_of(text) <= max_tokens:
        return [text]
    limit = 4 * max_tokens
    units: list[tuple[str, bool]] = []  # (part of a line, may be joined with its neighbours)
    for line in text.split("\n"):
        while len(line) > limit:
            at = line.rfind(" ", 0, limit)
            at = at if at > 0 else limit
            units.append((line[:at], False))
            line = line[at:].lstrip()
        units.append((line, True))
    out: list[str] = []
    held = ""
    for part, joins in units:
        if not joins:
            out += [held, part] if held else [part]
            held = ""
        elif held and len(held) + 1 + len(part) > limit:
            out.append(held)
            held = part
        else:
            held = f"{held}\n{part}" if held else part
    return [x for x in [*out, held] if x.strip()]


def packed(sizes: list[int], limit: int = MAX_TOKENS, overlap: int = OVERLAP) -> list[tuple[int, int]]:
    """(first, last) places of the pieces of each chunk: greedy up to limit; the next chunk starts with as many of the last
    pieces as fit overlap. A piece above limit makes a chunk of its own, after the overlap."""
    out = []
    first, used = 0, 0
    for i, n in enumerate(sizes):
        if i > first and used + n > limit:
            out.append((first, i - 1))
            back, k = 0, i
            while k > first and back + sizes[k - 1] <= overlap:
                k -= 1
                back += sizes[k]
            first, used = k, back
        used += n
    if sizes:
        out.append((first, len(sizes) - 1))
    return out


def text_chunks(pages: DataFrame, page_sections: DataFrame) -> DataFrame:
    """(chunk_id, doc_id, section, page_start, page_end, text, token_count) of pages (doc_id, page_no, text) and their sections.

    Paragraphs are cut to pieces page by page. Only the pieces' places and sizes go through the ordered fold of a
    document's section; the texts are then joined to the chunks' places.
    """
    @F.pandas_udf("array<string>")
    def cut(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield s.map(lambda t: [p for para in t.split("\n\n") if para.strip() for p in pieces_of(para.strip(), MAX_TOKENS - OVERLAP)])

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        p = pdf.sort_values(["page_no", "pos"]).reset_index(drop=True)
        spans = packed(p["tokens"].tolist())
        rows = [(p["doc_id"][0], p["section"][0], n, k, p["page_no"][k], p["pos"][k]) for n, (a, b) in enumerate(spans, 1) for k in range(a, b + 1)]
        return pd.DataFrame(rows, columns=["doc_id", "section", "n", "k", "page_no", "pos"])

    pieces = pages.join(page_sections.select("doc_id", "page_no", F.col("kind").alias("section")), ["doc_id", "page_no"]).select("doc_id", "section", "page_no", F.posexplode(cut("text")).alias("pos", "piece"))
    places = pieces.select("doc_id", "section", "page_no", "pos", estimate_tokens(F.col("piece")).alias("tokens")).groupBy("doc_id", "section").applyInPandas(
        fold, "doc_id string, section string, n int, k int, page_no int, pos int")
    joined = places.join(pieces, ["doc_id", "section", "page_no", "pos"]).groupBy("doc_id", "section", "n").agg(
        F.min("page_no").alias("page_start"), F.max("page_no").alias("page_end"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("k", "piece"))), lambda x: x["piece"]), "\n\n").alias("text"))
    chunk_id = F.concat(F.left("doc_id", F.lit(12)), F.lit("-"), "section", F.lit("-"), F.lpad(F.col("n").cast("string"), 4, "0"))
    return joined.select(chunk_id.alias("chunk_id"), "doc_id", "section", "page_start", "page_end", "text", estimate_tokens(F.col("text")).alias("token_count"))


def row_groups(rows: list[str], max_tokens: int = MAX_TOKENS) -> list[str]:
    """Texts of at most max_tokens of a table's rows, the header row first in each."""
    if not rows:
        return []
    head, groups = rows[0], [[]]
    for row in rows[1:]:
        if groups[-1] and tokens_of("\n".join([head, *groups[-1], row])) > max_tokens:
            groups.append([])
        groups[-1].append(row)
    return [p for g in groups for p in pieces_of("\n".join([head, *g]), max_tokens)]


def table_chunks(cells: DataFrame, page_sections: DataFrame) -> DataFrame:
    """(chunk_id, doc_id, section, page_start, page_end, text, token_count) of table cells (doc_id, page_no, table_idx, row, col, text)."""
    line = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("col", "text"))), lambda x: x["text"]), " | ").alias("line")
    rows = cells.groupBy("doc_id", "page_no", "table_idx", "row").agg(line).where(F.trim(F.replace("line", F.lit("|"))) != "")
    tables = rows.groupBy("doc_id", "page_no", "table_idx").agg(F.transform(F.sort_array(F.collect_list(F.struct("row", "line"))), lambda x: x["line"]).alias("rows")).where(estimate_tokens(F.array_join("rows", "\n")) >= MIN_TABLE)

    @F.pandas_udf("array<string>")
    def groups(s: pd.Series) -> pd.Series:
        return s.map(lambda r: row_groups(list(r)))

    g = tables.join(page_sections.select("doc_id", "page_no", F.col("kind").alias("section")), ["doc_id", "page_no"]).select("doc_id", "section", "page_no", "table_idx", F.posexplode(groups("rows")).alias("part", "text"))
    from pyspark.sql import Window

    n = F.row_number().over(Window.partitionBy("doc_id", "section").orderBy("page_no", "table_idx", "part"))
    chunk_id = F.concat(F.left("doc_id", F.lit(12)), F.lit("-"), "section", F.lit("-table-"), F.lpad(F.col("n").cast("string"), 4, "0"))
    return g.withColumn("n", n).select(chunk_id.alias("chunk_id"), "doc_id", "section", F.col("page_no").alias("page_start"), F.col("page_no").alias("page_end"), "text", estimate_tokens(F.col("text")).alias("token_count"))


def printed_share(s: str | None) -> float | None:
    """A percentage as printed; nil, - and n/a are 0; None if it is no number."""
    t = (s or "").replace(",", "").replace("%", "").strip()
    if s and t.lower() in ("nil", "-", "na", "n/a"):
        return 0.0
    try:
        return float(t) if s else None
    except ValueError:
        return None


def shareholding_rows(cells: list[dict]) -> list[dict] | None:
    """Holders of a shareholding table: name, kind, pct_holding, pct_pledged, quote; None if no header names them or more
    than a fifth of the rows have no share."""
    grid: dict[int, dict[int, str]] = {}
    for c in cells:
        grid.setdefault(c["row"], {})[c["col"]] = c["text"] or ""
    order = sorted(grid)
    for r in order[:5]:
        head = {c: t.lower() for c, t in sorted(grid[r].items())}
        line = " ".join(head.values())
        if "name" in line and "%" in line:
            break
    else:
        return None
    use: dict[str, int] = {}
    for c, t in head.items():
        pledge = "pledge" in t
        if "name" in t or "shareholder" in t:
            use["name"] = c
        elif "%" in t and not pledge and ("total" in t or "shares" in t):
            use["held"] = c
        elif "%" in t and (pledge or "encumber" in t):
            use["pledged"] = c
    if "name" not in use or "held" not in use:
        return None
    rows, bad = [], 0
    for i in (x for x in order if x > r):
        name = grid[i].get(use["name"], "").strip()
        if not name or name.lower() in ("total", "sub-total"):
            continue
        held = printed_share(grid[i].get(use["held"], ""))
        if held is None:
            bad += 1
            continue
        rows.append({"holder_name": name, "holder_kind": "category" if "promoter" in name.lower() else "person", "pct_holding": held,
                     "pct_pledged": printed_share(grid[i].get(use["pledged"], "")) if "pledged" in use else None, "quote": " | ".join(t for _, t in sorted(grid[i].items()))[:600]})
    return rows if rows and bad <= 0.2 * (len(rows) + bad) else None


def shareholding_records(cells: DataFrame) -> DataFrame:
    """(doc_id, page_no, table_idx, holder_name, holder_kind, pct_holding, pct_pledged, quote) of table cells, a row a holder; one table is one task's row."""
    t = cells.groupBy("doc_id", "page_no", "table_idx").agg(F.collect_list(F.struct("row", "col", "text")).alias("cells"))

    @F.pandas_udf("array<struct<holder_name:string,holder_kind:string,pct_holding:double,pct_pledged:double,quote:string>>")
    def read(s: pd.Series) -> pd.Series:
        return pd.Series([shareholding_rows([{"row": x["row"], "col": x["col"], "text": x["text"]} for x in c]) for c in s], dtype=object)

    return t.select("doc_id", "page_no", "table_idx", F.explode(read("cells")).alias("r")).select("doc_id", "page_no", "table_idx", "r.*")


#: Section kind -> kind of record extracted from it.
SECTION_TASKS = {"governance": "directors", "board_report": "directors", "auditor": "auditor", "related_party_standalone": "rpt", "subsidiaries": "subsidiaries", "shareholding": "shareholding", "regulatory": "regulatory"}


def extraction_tasks(filings: DataFrame, sections: DataFrame, pages: DataFrame) -> DataFrame:
    """(doc_id, task, page_start, page_end, flag): what to extract from each filing; an order is one regulatory section.

    A filing without pages gets one row with flag parse_missing, one without a section that has a task flagged.
    """
    ends = pages.groupBy("doc_id").agg(F.min("page_no").alias("page_start"), F.max("page_no").alias("page_end"))
    f = filings.where("doc_id is not null").groupBy("doc_id").agg(F.max("doc_type").alias("doc_type")).join(ends, "doc_id", "left")
    orders = f.where("doc_type = 'regulatory_order' and page_end is not null").select("doc_id", F.lit("regulatory").alias("kind"), "page_start", "page_end")
    others = sections.join(f.where("doc_type is null or doc_type <> 'regulatory_order'").select("doc_id"), "doc_id", "left_semi").select("doc_id", "kind", "page_start", "page_end")
    task = F.element_at(F.create_map(*[F.lit(x) for kv in SECTION_TASKS.items() for x in kv]), F.col("kind"))
    t = orders.unionByName(others).withColumn("task", task).where("task is not null").select("doc_id", "task", "page_start", "page_end")
    out = f.select("doc_id", F.col("page_end").isNull().alias("gone")).join(t, "doc_id", "left")
    return out.select("doc_id", "task", "page_start", "page_end", F.when(F.col("gone"), "parse_missing").when(F.col("task").isNull(), "flagged").alias("flag"))

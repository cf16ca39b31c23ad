"""Pages, sections and chunks of parsed documents."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from ledgermill.functions.text import composed, estimate_tokens, normalize_ascii, straight

#: Section kind -> words that open it, and how many more pages it may have.
SECTION_WORDS = {
    "governance": ["report on corporate governance", "corporate governance report"],
    "board_report": ["directors' report", "board's report"],
    "auditor": ["independent auditor's report", "auditors' report"],
    "related_party": ["related party disclosures", "related party transactions"],
    "subsidiaries": ["subsidiaries, associates and joint ventures", "statement containing salient features of the financial statement of subsidiaries"],
    "shareholding": ["shareholding pattern", "distribution of shareholding", "shareholding of promoters"],
}
SECTION_LENGTHS = {"governance": 40, "board_report": 50, "auditor": 20, "related_party": 20, "subsidiaries": 15, "shareholding": 10}


def page_texts(pages: DataFrame) -> DataFrame:
    """(doc_id, page_no, text): cleaned text, else raw text; of repeated pages the greatest."""
    t = F.coalesce("cleaned_text", "text")
    return pages.where(t.isNotNull()).groupBy("doc_id", "page_no").agg(F.max(t).alias("text"))


def repeated_edges(pages: DataFrame, share: float = 0.6) -> DataFrame:
    """(doc_id, line): lines, without digits, among the first or last two of a page on at least the share of the document's pages."""
    lines = F.filter(F.transform(F.split("text", "\n"), lambda x: F.trim(x)), lambda x: x != "")
    n = F.size("ls")
    p = page_texts(pages).withColumn("ls", lines).where(n > 0)
    edge = F.array_distinct(F.transform(F.concat(F.slice("ls", 1, 2), F.slice("ls", F.greatest(n - 1, F.lit(1)), F.lit(2))), lambda x: F.regexp_replace(x, "[0-9]+", "")))
    hits = p.select("doc_id", F.explode(edge).alias("line")).where("line <> ''").groupBy("doc_id", "line").agg(F.count(F.lit(1)).alias("k"))
    total = p.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_pages"))
    return hits.join(total, "doc_id").where(F.col("k") >= share * F.col("n_pages")).select("doc_id", "line", F.col("k").alias("n_hits"), "n_pages")


def sections(pages: DataFrame) -> DataFrame:
    """(doc_id, kind, page_start, page_end): first page with a section's words, up to the next section's start or its longest length.

    Related parties split into consolidated and standalone by the page's text. Sections that start on one page follow
    each other in the order of SECTION_WORDS, and only the last of them ends before the next start.
    """
    t = page_texts(pages).withColumn("norm", normalize_ascii(F.col("text")))
    part = F.when(F.col("norm").contains("consolidated"), "related_party_consolidated").otherwise("related_party_standalone")

    def kind(i: int, k: str) -> Column:
        hit = F.lit(False)
        for w in SECTION_WORDS[k]:
            hit = hit | F.col("norm").contains(w)
        return F.when(hit, F.struct(F.lit(i).alias("nth"), (part if k == "related_party" else F.lit(k)).alias("kind"), F.lit(SECTION_LENGTHS[k]).alias("most")))

    kinds = F.filter(F.array(*[kind(i, k) for i, k in enumerate(SECTION_WORDS)]), lambda x: x.isNotNull())
    start = t.select("doc_id", "page_no", F.explode(kinds).alias("k")).groupBy("doc_id", "k.nth", "k.kind", "k.most").agg(F.min("page_no").alias("page_start"))
    last = t.groupBy("doc_id").agg(F.max("page_no").alias("last_page"))
    nxt = F.lead("page_start").over(Window.partitionBy("doc_id").orderBy("page_start", "nth", "kind"))
    s = start.withColumn("nxt", nxt).join(last, "doc_id")
    return s.select("doc_id", "kind", "page_start", F.least(F.col("page_start") + F.col("most"), F.when(F.col("nxt") > F.col("page_start"), F.col("nxt") - 1), F.col("last_page")).alias("page_end"))


def page_sections(pages: DataFrame, secs: DataFrame) -> DataFrame:
    """(doc_id, page_no, kind): the section of each page, the earliest that covers it, else other; ranges become equi-joins by page."""
    cover = secs.select("doc_id", "page_start", "kind", F.explode(F.sequence("page_start", "page_end")).alias("page_no")).groupBy("doc_id", "page_no").agg(F.min_by("kind", F.struct("page_start", "kind")).alias("kind"))
    return page_texts(pages).select("doc_id", "page_no").join(cover, ["doc_id", "page_no"], "left").select("doc_id", "page_no", F.coalesce("kind", F.lit("other")).alias("kind"))


def evidence_chunks(records: DataFrame, chunks: DataFrame) -> DataFrame:
    """(record_id, chunk_id): chunks of the evidence's document whose page range holds the evidence page; missing start is the end."""
    e = records.select("record_id", "doc_id", F.get_json_object("payload_json", "$.evidence.page").cast("int").alias("page_no")).where("page_no is not null").distinct()
    first = F.least(F.coalesce("page_start", "page_end"), "page_end")
    c = chunks.where("page_end is not null").select("doc_id", "chunk_id", F.explode(F.sequence(first, F.col("page_end"))).alias("page_no")).distinct()
    return e.join(c, ["doc_id", "page_no"]).select("record_id", "chunk_id").distinct()


def phrase_mentions(chunks: DataFrame, entities: DataFrame, min_words: int = 2) -> DataFrame:
    """(chunk_id, entity_id): chunks that contain an entity's canonical name of min_words or more words, word by word.

    The names' first two words meet the chunks' word pairs by equi-join, and the whole name is then verified, so no
    chunk is held against all names.
    """
    plain = lambda c: F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", " "))
    names = entities.select("entity_id", plain(F.col("canonical_name")).alias("phrase")).where(F.col("phrase") != "").distinct().where(F.size(F.split("phrase", " ")) >= min_words)
    names = names.withColumn("pair", F.array_join(F.slice(F.split("phrase", " "), 1, 2), " "))
    text = chunks.where("text is not null").groupBy("chunk_id").agg(F.max("text").alias("text")).select("chunk_id", plain(F.col("text")).alias("t"))
    ws = F.split("t", " ")
    two = F.transform(F.arrays_zip(ws.alias("a"), F.slice(ws, F.lit(2), F.size(ws)).alias("b")), lambda x: F.concat_ws(" ", x["a"], x["b"]))
    pairs = text.select("chunk_id", "t", F.explode(F.array_distinct(two if min_words > 1 else F.concat(ws, two))).alias("pair"))
    return pairs.join(names, "pair").where(F.concat(F.lit(" "), "t", F.lit(" ")).contains(F.concat(F.lit(" "), "phrase", F.lit(" ")))).select("chunk_id", "entity_id").distinct()


def page_windows(pages: DataFrame, max_tokens: int = 4000) -> DataFrame:
    """(doc_id, window_no, page_no): windows of at most max_tokens where pages allow, each after the first with the page before it.

    An ordered fold of the pages' numbers and token counts of one document; texts take no part in it.
    """
    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        out, window, used, before = [], 0, 0, None
        for doc, page, tok in pdf.sort_values("page_no").itertuples(index=False):
            if before is not None and used + tok > max_tokens:
                window, used = window + 1, before[1]
                out.append((doc, window, before[0]))
            out.append((doc, window, page))
            used, before = used + tok, (page, tok)
        return pd.DataFrame(out, columns=["doc_id", "window_no", "page_no"])

    t = page_texts(pages).select("doc_id", "page_no", estimate_tokens(F.col("text")).alias("tok"))
    return t.groupBy("doc_id").applyInPandas(fold, "doc_id string, window_no int, page_no int")


def cleaned_pages(pages: DataFrame) -> DataFrame:
    """(doc_id, page_no, text): pages without repeated edge lines, broken words joined, spaces and marks made plain.

    A document has at most 4 / 0.6 repeated edge lines, as a page has four edges, so they travel as an array.
    """
    furniture = repeated_edges(pages).where("line <> ''").groupBy("doc_id").agg(F.collect_list("line").alias("furniture"))
    t = page_texts(pages).join(furniture, "doc_id", "left")
    bare = lambda x: F.regexp_replace(F.trim(x), "[0-9]+", "")
    none = F.array().cast("array<string>")
    lines = F.filter(F.split("text", "\r\n|\r|\n"), lambda x: ~F.array_contains(F.coalesce("furniture", none), bare(x)))
    c = F.regexp_replace(F.array_join(lines, "\n"), r"-\n(?=[a-z])", "")
    c = F.regexp_replace(F.regexp_replace(c, r"[ \t]+", " "), r"\n{3,}", "\n\n")
    return t.select("doc_id", "page_no", F.regexp_replace(straight(composed(c)), r"^\s+|\s+$", "").alias("text"))

"""Queries of chunking, linking, hybrid search, context building and scalar functions of answers."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from ledgermill.functions import answers, text as X
from ledgermill.operators import chunking, context, documents, evaluation, evidence, graph, linking, records as R, retrieval
from ledgermill.plans.reference import _EDGES, _NC, _NP, _SECTIONS, _SEEDS, _chunk_texts, _questions, _seeds, edges_of, query, question_rows
from ledgermill.session import cut_lineage, table

_LABELS = """lab AS (SELECT entity_id, canonical_name AS name, kind FROM (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY updated_at DESC NULLS LAST, row_id DESC, canonical_name DESC, kind DESC NULLS LAST) AS k FROM entities WHERE entity_id IS NOT NULL AND canonical_name IS NOT NULL) WHERE k = 1)"""


@query()
def w24_text_chunks(spark, d):
    """Pages packed into chunks within sections; brute force in the tests."""
    p = table(spark, d, "parsed_pages")
    return chunking.text_chunks(documents.page_texts(p), documents.page_sections(p, documents.sections(p)))


def table_cells(spark, d):
    """Cells of the tables among the chunks, in place of a parser's."""
    c = table(spark, d, "chunks").where("chunk_id like '%-table-%' and text is not null").groupBy("chunk_id").agg(F.max("doc_id").alias("doc_id"), F.max("page_end").alias("page_no"), F.max("text").alias("t"))
    c = c.where("page_no is not null").withColumn("table_idx", F.row_number().over(Window.partitionBy("doc_id", "page_no").orderBy("chunk_id")))
    rows = c.select("doc_id", "page_no", "table_idx", F.posexplode(F.split("t", "\n")).alias("row", "line"))
    return rows.select("doc_id", "page_no", "table_idx", "row", F.posexplode(F.split("line", r" \| ")).alias("col", "text"))


@query()
def w25_table_chunks(spark, d):
    """Tables in groups of rows under their header; brute force in the tests."""
    p = table(spark, d, "parsed_pages")
    cells = table_cells(spark, d)
    known = documents.page_sections(p, documents.sections(p))
    pages = cells.select("doc_id", "page_no").distinct().join(known, ["doc_id", "page_no"], "left").select("doc_id", "page_no", F.coalesce("kind", F.lit("other")).alias("kind"))
    return chunking.table_chunks(cells, pages)


@query(f"""WITH {_SECTIONS}, ends AS (SELECT doc_id, min(page_no) AS a, max(page_no) AS b FROM parsed_pages GROUP BY 1), f AS (SELECT doc_id, max(doc_type) AS doc_type, a, b FROM filings LEFT JOIN ends USING (doc_id) WHERE doc_id IS NOT NULL GROUP BY ALL),
  tasks(kind, task) AS (VALUES ('governance', 'directors'), ('board_report', 'directors'), ('auditor', 'auditor'), ('related_party_standalone', 'rpt'), ('subsidiaries', 'subsidiaries'), ('shareholding', 'shareholding'), ('regulatory', 'regulatory')),
  s AS (SELECT doc_id, 'regulatory' AS kind, a AS page_start, b AS page_end FROM f WHERE doc_type = 'regulatory_order' AND b IS NOT NULL UNION ALL SELECT sec.* FROM sec JOIN f USING (doc_id) WHERE coalesce(doc_type, '') <> 'regulatory_order'),
  t AS (SELECT doc_id, task, page_start, page_end FROM s JOIN tasks USING (kind))
  SELECT f.doc_id, task, page_start, page_end, CASE WHEN b IS NULL THEN 'parse_missing' WHEN task IS NULL THEN 'flagged' END AS flag FROM f LEFT JOIN t USING (doc_id)""")
def f11_extraction_tasks(spark, d):
    """what to extract from each filing."""
    p = table(spark, d, "parsed_pages")
    return chunking.extraction_tasks(table(spark, d, "filings"), documents.sections(p), p)


# linking and search -------------------------------------------------------------------------------------------------

_VARIANTS = """v AS (SELECT DISTINCT entity_id, trim(regexp_replace(x, '[^a-z0-9]+', ' ', 'g')) AS p FROM (SELECT entity_id, unnest(vs) AS x FROM (SELECT entity_id, list_concat(a, list_transform(a, lambda y: replace(y, '&', 'and')), [lower(substr(entity_id, 3))]) AS vs FROM (
  SELECT entity_id, [core, tr] || CASE WHEN len(string_split_regex(trim(replace(tr, '&', ' ')), '\\s+')) >= 3 THEN [array_to_string(string_split_regex(trim(replace(tr, '&', ' ')), '\\s+')[1:2], ' ')] ELSE [] END AS a FROM (
  SELECT entity_id, core, trim(regexp_replace(regexp_replace(core, '^the ', ''), ' company$', '')) AS tr FROM (SELECT entity_id, trim(regexp_replace(regexp_replace(lower(name), '\\b(limited|ltd\\.?)\\b', '', 'g'), '\\s+', ' ', 'g')) AS core FROM lab WHERE kind = 'company' AND entity_id NOT LIKE 'C:x%'))))) WHERE trim(regexp_replace(x, '[^a-z0-9]+', ' ', 'g')) <> '')"""


def _config_companies(spark, d):
    return graph.entity_labels(table(spark, d, "entities")).where("kind = 'company' and entity_id not like 'C:x%'")


@query(f"""WITH {_LABELS}, {_VARIANTS}, q AS (SELECT qid, concat(' ', trim(regexp_replace(lower(max(question)), '[^a-z0-9]+', ' ', 'g')), ' ') AS t FROM questions WHERE question IS NOT NULL AND qid IS NOT NULL GROUP BY qid)
  SELECT qid, min(entity_id) AS company_id FROM (SELECT DISTINCT qid, entity_id FROM q JOIN v ON contains(t, concat(' ', p, ' '))) GROUP BY qid HAVING count(*) = 1""")
def f14_question_company(spark, d):
    """Questions that name exactly one company, by any variant of its name or its id."""
    return evidence.companies_in_questions(table(spark, d, "questions").where("qid is not null"), _config_companies(spark, d))


def question_filters(spark, d):
    q = _questions(spark, d)
    c = f14_question_company(spark, d).select(F.col("qid").alias("query_id"), F.expr("substring(company_id, 3)").alias("company_id"))
    return q.withColumn("fiscal_year", X.fiscal_year_of(F.col("query"))).join(c, "query_id", "left")


def _search_docs(spark, d):
    c = table(spark, d, "chunks").where("text is not null").groupBy(F.col("chunk_id").alias("doc_id")).agg(*[F.max(x).alias(x) for x in ("text", "company_id", "fiscal_year")])
    return c.withColumn("embedding", retrieval.hashed_embedding()("text"))


def _hybrid(spark, d, k):
    """(docs, queries, hits, askers): questions of equal text, company and year are searched once, as the query_id of one; askers (asker, query_id)."""
    docs = cut_lineage(_search_docs(spark, d))
    same = ["query", "company_id", "fiscal_year"]
    asked = cut_lineage(question_filters(spark, d).select(F.col("query_id").alias("asker"), *same, F.to_json(F.struct(*same)).alias("key")))
    one = cut_lineage(asked.groupBy("key", *same).agg(F.min("asker").alias("query_id")).withColumn("embedding", retrieval.hashed_embedding()("query")))
    return docs, one.drop("key"), retrieval.hybrid_search(docs, one, k), asked.join(one.select("key", "query_id"), "key").select("asker", "query_id")


def _given_back(ranked, askers):
    return askers.join(ranked, "query_id").drop("query_id").withColumnRenamed("asker", "query_id")


@query()
def w4_hybrid_search(spark, d):
    """Chunks by vector and keyword, restricted by the question's company and year; brute force in the tests."""
    docs, _, hits, askers = _hybrid(spark, d, 8)
    found = hits.join(docs.select("doc_id", "company_id", "fiscal_year"), "doc_id").withColumn("score", F.round("score", 6))
    return _given_back(found, askers).select(*found.columns)


@query()
def w5_reranked(spark, d):
    """Hybrid hits fused with the ranking of an injected scorer, here the share of the question's words in the text; brute force in the tests."""
    docs, q, hits, askers = _hybrid(spark, d, 40)
    share = lambda a, b: F.size(F.array_intersect(X.keyword_tokens(a), X.keyword_tokens(b))) / F.greatest(F.size(F.array_distinct(X.keyword_tokens(a))), F.lit(1))
    rows = hits.drop("score").join(q.select("query_id", "query"), "query_id").join(docs.select("doc_id", "text"), "doc_id")  # texts last, so that they meet nothing else
    ranked = retrieval.reranked(rows, share, 8).withColumn("score", F.round("score", 6))
    return _given_back(ranked, askers).select(*ranked.columns)


@query()
def a25_recall_at_8(spark, d):
    """Of questions after a transaction's party, those with a chunk of the filing that holds its name among the first eight; brute force in the tests."""
    r = R.decoded(R.accepted(R.last_deliveries(table(spark, d, "records"))), "rpt").where("p.counterparty_name is not null")
    q = r.select(F.col("record_id").alias("query_id"), "doc_id", F.lower("p.counterparty_name").alias("needle"), F.concat(F.lit("What was the "), F.coalesce("p.nature", F.lit("transaction")), F.lit(" with "), "p.counterparty_name", F.lit("?")).alias("query"))
    q = cut_lineage(q)
    c = table(spark, d, "chunks").where("text is not null").groupBy("chunk_id").agg(F.max("doc_id").alias("doc_id"), F.lower(F.max("text")).alias("text"))
    gold = cut_lineage(q.join(c, "doc_id").where(F.col("text").contains(F.col("needle"))).select("query_id", F.col("chunk_id").alias("doc_id")))
    asked = q.join(gold, "query_id", "left_semi").select("query_id", "query")  # no others count in recall_at
    return evaluation.recall_at(retrieval.bm25(_chunk_texts(spark, d), asked, 8), gold)


def question_mentions(spark, d):
    q = _questions(spark, d)
    return q.select("query_id", F.posexplode(answers.capital_phrases_of(F.col("query"))).alias("pos", "text")).withColumn("kind", F.lit(None).cast("string"))


@query()
def x29_capital_phrases(spark, d):
    """Names in questions by their capitals; cases in the tests."""
    return question_mentions(spark, d).select("query_id", "pos", "text")


def _linked(spark, d):
    return linking.link_questions(cut_lineage(question_mentions(spark, d)), table(spark, d, "entities"))


@query()
def w9_linked_entities(spark, d):
    """Entities that questions name; brute force in the tests."""
    return _linked(spark, d)


@query(_EDGES + f""", {_SEEDS}, {_LABELS}, nm AS (SELECT entity_id, CASE WHEN kind = 'person' THEN {_NP.format('name')} ELSE {_NC.format('name')} END AS norm FROM lab), hit AS (SELECT entity_id FROM nm WHERE length(norm) >= 4 AND contains('who audits lorquaum paper power and caldtumara securities international in 2023', norm)),
  ds AS (SELECT DISTINCT entity_id AS id FROM entities WHERE entity_id LIKE 'C:%' AND entity_id NOT LIKE 'C:x%')
  SELECT edge_id, rel, (CASE WHEN src_id IN (SELECT id FROM seeds) OR dst_id IN (SELECT id FROM seeds) THEN 3.0 ELSE 0.0 END) + (CASE WHEN rel IN ('DIRECTOR_OF', 'AUDITED_BY') THEN 2.0 ELSE 0.0 END) + (CASE WHEN fiscal_year = 'FY2022-23' THEN 1.5 ELSE 0.0 END) + (CASE WHEN page % 2 = 0 THEN 1.0 ELSE 0.0 END)
  + (CASE WHEN src_id IN (SELECT entity_id FROM hit) OR dst_id IN (SELECT entity_id FROM hit) THEN 1.0 ELSE 0.0 END) + (CASE WHEN src_id IN (SELECT id FROM ds) OR dst_id IN (SELECT id FROM ds) THEN 0.5 ELSE 0.0 END) AS score FROM edges""")
def w11_fact_scores(spark, d):
    """The six terms of a fact's score for one question."""
    lab = graph.entity_labels(table(spark, d, "entities"))
    norm = F.when(F.col("kind") == "person", X.norm_person(F.col("name"))).otherwise(X.norm_company(F.col("name")))
    dataset = table(spark, d, "entities").where("entity_id like 'C:%' and entity_id not like 'C:x%'").select(F.col("entity_id").alias("id")).distinct()
    facts = edges_of(spark, d).select("edge_id", "rel", "src_id", "dst_id", "fiscal_year", F.when(F.col("page") % 2 == 0, 1).otherwise(2).alias("hop"))
    asked = F.lit("who audits lorquaum paper power and caldtumara securities international in 2023")
    s = context.fact_scores(facts, _seeds(spark, d), asked, ["DIRECTOR_OF", "AUDITED_BY"], ["FY2022-23"], lab.select("entity_id", norm.alias("norm")), dataset)
    return s.select("edge_id", "rel", "score")


def question_units(spark, d, edges=None):
    """(units, askers): units of facts around the entities that questions name, scored by the relations and year asked for, once
    for all questions that name and ask the same: units have the number ask, askers (query_id, ask). Without units that
    ranked_units can't take. edges: edges_of, written."""
    linked = _linked(spark, d).groupBy("query_id").agg(F.array_sort(F.collect_set("entity_id")).alias("seeds"))
    q = _questions(spark, d).select("query_id", X.relations_asked(F.col("query")).alias("asked"), F.coalesce(X.fiscal_year_of(F.col("query")), F.lit("")).alias("year"))
    what = ["seeds", "asked", "year"]
    named = cut_lineage(linked.join(q, "query_id"))
    asks = cut_lineage(named.select(*what).distinct().withColumn("ask", F.monotonically_increasing_id()))
    each = asks.select("ask", "asked", F.nullif("year", F.lit("")).alias("year"), "seeds", F.explode("seeds").alias("seed"))
    columns = ["edge_id", "rel", "src_id", "src_type", "dst_id", "dst_type", "fiscal_year"]
    edges = cut_lineage(edges_of(spark, d).select(*columns)) if edges is None else edges.select(*columns)
    near = graph.neighbours(edges, each.select(F.col("seed").alias("id"))).select("seed", "edge_id", "rel", "dst_id", "fiscal_year", graph.seeded_ends().alias("ends"))
    units = cut_lineage(context.seed_units(near, F.col("ends")))
    u = units.join(each, "seed").where(context.takeable(F.col("year"), F.col("seeds")))
    asked = F.when(F.array_contains("asked", F.col("unit_rel")), 2.0).otherwise(0.0) + F.when(F.coalesce(F.col("unit_year") == F.col("year"), F.lit(False)), 1.5).otherwise(0.0) + 1.0
    scored = F.transform("edges", lambda e: F.struct(e["edge_id"].alias("edge_id"), e["rel"].alias("rel"), e["dst_id"].alias("dst_id"), (F.when(F.arrays_overlap(e["ends"], F.col("seeds")), 3.0).otherwise(0.0) + F.col("score")).alias("score")))
    u = u.withColumn("score", asked).select("ask", (-3.0 - F.col("score")).alias("low"), "first", "size", "unit_rel", scored.alias("edges"))  # an edge of each unit touches its seed
    return u.repartition("ask"), named.join(asks, what).select("query_id", "ask")


def question_facts(spark, d):
    """question_units as facts (ask, edge_id, rel, dst_id, score)."""
    units, askers = question_units(spark, d)
    return units.select("ask", F.explode("edges").alias("x")).select("ask", "x.*"), askers


def question_ranked_facts(spark, d, requested, edges=None):
    """question_units ranked and capped, given back to every question."""
    units, askers = question_units(spark, d, edges)
    return askers.join(context.ranked_units(units, requested, group="ask"), "ask").drop("ask")


@query()
def w12_ranked_facts(spark, d):
    """Facts of every question, ranked and capped with places kept for asked relations; brute force in the tests."""
    return question_ranked_facts(spark, d, ["AUDITED_BY", "DIRECTOR_OF"])


@query(_EDGES + f""", {_LABELS}, e AS (SELECT edges.*, src_type || ': ' || coalesce(a.name, src_id) AS l, dst_type || ': ' || coalesce(b.name, dst_id) AS r, '  source: doc ' || left(doc_id, 12) || '…, p.' || page || CASE WHEN quote <> '' THEN ' | quote: "' || quote || '"' ELSE '' END AS source FROM edges LEFT JOIN lab a ON a.entity_id = src_id LEFT JOIN lab b ON b.entity_id = dst_id),
  p AS (SELECT edge_id AS ref_id, rel, l, r, source, doc_id, page, fiscal_year, CASE rel WHEN 'DIRECTOR_OF' THEN concat_ws('; ', nullif(role, ''), CASE WHEN independent THEN 'independent' END, nullif(fiscal_year, ''), CASE WHEN start_date <> '' OR end_date <> '' THEN coalesce(nullif(start_date, ''), '?') || ' to ' || coalesce(nullif(end_date, ''), 'present') END)
    WHEN 'AUDITED_BY' THEN fiscal_year ELSE concat_ws('; ', CASE WHEN pct_held > 0 THEN printf('%g', pct_held) || '% held' END, 'as of ' || nullif(as_of, '')) END AS label FROM e WHERE rel <> 'PARTY_TO')
  SELECT ref_id, rel, l || ' —[' || rel || CASE WHEN label <> '' THEN ': ' || label ELSE '' END || ']→ ' || r || chr(10) || source AS text, doc_id, page, fiscal_year FROM p""")
def x25_fact_texts(spark, d):
    """Facts as evidence texts; transactions have their own query."""
    return context.fact_texts(edges_of(spark, d), graph.entity_labels(table(spark, d, "entities"))).where("rel <> 'PARTY_TO'")


@query()
def x25_transaction_texts(spark, d):
    """Both parties of a transaction in one text; cases in the tests."""
    return context.fact_texts(edges_of(spark, d), graph.entity_labels(table(spark, d, "entities"))).where("rel = 'PARTY_TO'")


@query()
def j17_resolved_citations(spark, d):
    """Citations of every question's three best chunks resolved to pages; brute force in the tests."""
    hits = retrieval.bm25(_chunk_texts(spark, d), _questions(spark, d), 3)
    c = table(spark, d, "chunks").where("text is not null").groupBy(F.col("chunk_id").alias("ref_id")).agg(*[F.max(x).alias(x) for x in ("text", "doc_id", "page_end")], F.max(F.coalesce("page_start", "page_end")).alias("page_start"))
    ev = cut_lineage(hits.select("query_id", F.concat(F.lit("E"), F.col("rank").cast("string")).alias("label"), F.col("doc_id").alias("ref_id")).join(c, "ref_id").where("page_end is not null"))
    said = F.array(F.struct(F.lit(1).alias("n"), F.lit("E1").alias("label"), F.substring("text", 5, 40).alias("quote")), F.struct(F.lit(2).alias("n"), F.lit("E2").alias("label"), F.lit("said nowhere at all").alias("quote")), F.struct(F.lit(3).alias("n"), F.lit("E9").alias("label"), F.substring("text", 1, 20).alias("quote")))
    cited = ev.where("label = 'E1'").select("query_id", F.explode(said).alias("x")).select("query_id", "x.*")
    return context.resolved_citations(cited, ev.drop("ref_id"), documents.page_texts(table(spark, d, "parsed_pages")))


@query()
def w14_split_budget(spark, d):
    """Facts first up to their share of 4000 tokens, chunks in the rest; brute force in the tests."""
    edges = cut_lineage(edges_of(spark, d))
    t = context.fact_texts(edges, graph.entity_labels(table(spark, d, "entities"))).select(F.explode(F.split("ref_id", ",")).alias("edge_id"), X.estimate_tokens(F.col("text")).alias("tokens"))
    primary = question_ranked_facts(spark, d, [], edges).join(t, "edge_id").select("query_id", "rank", "tokens", F.col("edge_id").alias("ref_id"))
    texts = _chunk_texts(spark, d)
    return context.split_budget(cut_lineage(primary), context.chunk_evidence(retrieval.bm25(texts, _questions(spark, d), 20), texts), 4000, 0.6)


# scalar functions of answers -----------------------------------------------------------------------------------------

@query("SELECT event_id, CAST(value AS DOUBLE) * 2 + CAST(props->>'$.k' AS INT) AS v FROM events")
def x32_calculated(spark, d):
    """Arithmetic read from text."""
    e = table(spark, d, "events")
    return e.select("event_id", answers.calculated(F.concat("value", F.lit(" * 2 + "), F.get_json_object("props", "$.k"))).alias("v"))


@query()
def x33_number_supported(spark, d):
    """Whether a gold answer's number stands in the question's text; brute force in the tests."""
    return question_rows(spark, d).where("gold_answer is not null").select("qid", answers.number_supported(F.col("gold_answer"), F.col("question")).alias("supported"))


@query("""SELECT qid, CASE WHEN left(md5(qid), 1) < '8' THEN CASE WHEN left(md5(qid), 1) < '4' THEN 'SUPPORTED' ELSE 'UNSUPPORTED' END ELSE 'UNSUPPORTED' END AS verdict, CASE WHEN left(md5(qid), 1) < '4' THEN ['E1'] ELSE [] END AS labels FROM (SELECT DISTINCT qid FROM questions WHERE qid IS NOT NULL)""")
def x34_checked_claims(spark, d):
    """Claims without a label that exists are not supported."""
    h = F.left(F.md5("qid"), F.lit(1))
    q = table(spark, d, "questions").where("qid is not null").select("qid").distinct()
    labels = F.when(h < "4", F.array(F.lit("E1"), F.lit("E9"))).otherwise(F.array(F.lit("E9")))
    verdict = F.when((h >= "4") & (h < "8"), "UNSUPPORTED").otherwise("SUPPORTED")
    return q.select("qid", answers.checked_claim(verdict, labels, F.array(F.lit("E1"), F.lit("E2"))).alias("c")).select("qid", "c.*")


@query("SELECT event_id, CASE event_type WHEN 'click' THEN (user_id * 0.5 + event_id * 2.0) / 1e6 WHEN 'view' THEN (user_id * 1.0 + event_id * 3.0) / 1e6 ELSE 0 END AS cost FROM events")
def x35_model_cost(spark, d):
    """Cost by model and tokens, unknown models 0."""
    e = table(spark, d, "events")
    return e.select("event_id", answers.model_cost(F.col("event_type"), F.col("user_id"), F.col("event_id"), {"click": (0.5, 2.0), "view": (1.0, 3.0)}).alias("cost"))


@query("""SELECT DISTINCT qid, sha256(concat('{"category":', coalesce('"' || category || '"', 'null'), ',"qid":"', qid, '"}')) AS k FROM questions WHERE qid IS NOT NULL""")
def x36_request_key(spark, d):
    """Key of a request by its canonical JSON."""
    return table(spark, d, "questions").where("qid is not null").select("qid", answers.request_key({"qid": F.col("qid"), "category": F.col("category")}).alias("k")).distinct()


@query("SELECT DISTINCT qid, ['text', 'marker', 'marker', 'text'] AS kinds, ['As of ' || qid || ' ', 'E1', 'E2', ' done.'] AS vals FROM questions WHERE qid IS NOT NULL")
def x40_marker_tokens(spark, d):
    """An answer cut at its evidence markers."""
    t = answers.marker_tokens(F.concat(F.lit("As of "), "qid", F.lit(" [E1, E2] done.")))
    return table(spark, d, "questions").where("qid is not null").select("qid", t.alias("t")).select("qid", F.transform("t", lambda x: x["kind"]).alias("kinds"), F.transform("t", lambda x: x["value"]).alias("vals")).distinct()


# links of chunks and spend -------------------------------------------------------------------------------------------

_MENTIONS = """c AS (SELECT chunk_id, concat(' ', trim(regexp_replace(lower(max(text)), '[^a-z0-9]+', ' ', 'g')), ' ') AS t FROM chunks WHERE text IS NOT NULL GROUP BY chunk_id),
  ep AS (SELECT DISTINCT entity_id, trim(regexp_replace(lower(canonical_name), '[^a-z0-9]+', ' ', 'g')) AS p FROM entities), ph AS (SELECT DISTINCT chunk_id, entity_id FROM c JOIN ep ON p LIKE '% %' AND contains(t, concat(' ', p, ' '))),
  pg AS (SELECT DISTINCT r.doc_id, CAST(r.payload_json->>'$.evidence.page' AS INT) AS page, m.entity_id FROM records r JOIN merge_log m ON split_part(m.mention_id, ':', 1) = r.record_id WHERE r.status IN ('accepted', 'fixed') AND m.entity_id IS NOT NULL),
  ov AS (SELECT DISTINCT chunk_id, entity_id FROM pg JOIN chunks k ON k.doc_id = pg.doc_id AND page BETWEEN least(coalesce(page_start, page_end), page_end) AND page_end), men AS (SELECT * FROM ph UNION SELECT * FROM ov)"""


def chunk_mentions(spark, d):
    """(chunk_id, entity_id): entities whose name a chunk holds, or whose record has its evidence on one of its pages."""
    ch, rec = table(spark, d, "chunks"), R.accepted(table(spark, d, "records"))
    links = table(spark, d, "merge_log").where("entity_id is not null").select(F.substring_index("mention_id", ":", 1).alias("record_id"), "entity_id").distinct()
    overlap = documents.evidence_chunks(rec, ch).join(links, "record_id").select("chunk_id", "entity_id")
    return documents.phrase_mentions(ch, table(spark, d, "entities")).unionByName(overlap).distinct()


@query(f"WITH {_MENTIONS} SELECT (SELECT count(DISTINCT chunk_id) FROM chunks) AS n_chunks, (SELECT count(DISTINCT chunk_id) FROM men) AS n_linked, round(100.0 * (SELECT count(DISTINCT chunk_id) FROM men) / (SELECT count(DISTINCT chunk_id) FROM chunks), 1) AS pct")
def a30_mention_coverage(spark, d):
    """Share of chunks linked to an entity by name or page."""
    n = table(spark, d, "chunks").agg(F.count_distinct("chunk_id").alias("n_chunks"))
    m = chunk_mentions(spark, d).agg(F.count_distinct("chunk_id").alias("n_linked"))
    return n.crossJoin(m).withColumn("pct", F.round(100.0 * F.col("n_linked") / F.col("n_chunks"), 1))  # one row each


@query(f"WITH {_MENTIONS}, {_SEEDS} SELECT entity_id, chunk_id FROM men WHERE entity_id IN (SELECT id FROM seeds)")
def j20_linked_chunks(spark, d):
    """Chunks that mention the linked entities."""
    return chunk_mentions(spark, d).join(_seeds(spark, d).select(F.col("id").alias("entity_id")), "entity_id", "left_semi").select("entity_id", "chunk_id")


@query("SELECT event_id, before, before < 500 AS allowed FROM (SELECT event_id, round(coalesce(sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 4) AS before FROM events)")
def t5_spend_cap(spark, d):
    """T5: a call is rejected once the user's spend before it has reached the cap."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, -1)
    e = table(spark, d, "events").select("event_id", F.round(F.coalesce(F.sum("value").over(w), F.lit(0.0)), 4).alias("before"))
    return e.withColumn("allowed", F.col("before") < 500)

"""More queries of the reference's operators: evidence, citations, fact scores and views of runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgermill.functions import text as X
from ledgermill.operators import evidence, records as R
from ledgermill.plans.reference import _EDGES, _NC, _NORM, _NP, _PT, _SEEDS, _seeds, edges_of, query
from ledgermill.session import table

@query(f"""WITH {_PT}, e AS (SELECT DISTINCT record_id, payload_json->>'$.evidence.doc_id' AS doc_id, CAST(payload_json->>'$.evidence.page' AS INT) AS page, {_NORM.format("payload_json->>'$.evidence.quote'")} AS quote
  FROM records WHERE payload_json->>'$.evidence.page' IS NOT NULL), n AS (SELECT doc_id, page_no, {_NORM.format('t')} AS norm FROM pt),
  h AS (SELECT record_id, page, page_no, CASE WHEN page_no = page THEN 0 WHEN page_no = page - 1 THEN 1 ELSE 2 END AS turn FROM e JOIN n ON e.doc_id = n.doc_id AND n.page_no BETWEEN page - 1 AND page + 1 WHERE length(quote) >= 8 AND contains(norm, quote)),
  b AS (SELECT record_id, page, min_by(page_no, turn) AS found_on FROM h GROUP BY ALL) SELECT DISTINCT e.record_id, e.page, b.found_on FROM e LEFT JOIN b USING (record_id, page)""")
def f8_grounded_pages(spark, d):
    """F8, F9, H17 without the fuzzy fallback."""
    return evidence.grounded_pages(table(spark, d, "records"), table(spark, d, "parsed_pages"))


@query("""WITH g AS (SELECT qid, list_transform(gold_evidence, lambda x: x.doc_id || ':' || CAST(x.page AS VARCHAR)) AS gold, list_transform(list_filter(gold_evidence, lambda x: x.page % 2 = 0), lambda x: x.doc_id || ':' || CAST(x.page AS VARCHAR)) AS cited FROM questions)
  SELECT qid, CASE WHEN len(gold) > 0 THEN round(len(list_intersect(gold, cited)) / len(list_distinct(gold)), 6) END AS recall, CASE WHEN len(cited) > 0 THEN round(len(list_intersect(cited, gold)) / len(list_distinct(cited)), 6) END AS prec FROM g""")
def j24_evidence_recall(spark, d):
    """Cited pages of a stand-in answer against gold pages."""
    key = lambda x: F.concat(x["doc_id"], F.lit(":"), x["page"].cast("string"))
    q = table(spark, d, "questions").select("qid", F.transform("gold_evidence", key).alias("gold"), F.transform(F.filter("gold_evidence", lambda x: x["page"] % 2 == 0), key).alias("cited"))
    return q.select("qid", F.round(evidence.recall_of(F.col("gold"), F.col("cited")), 6).alias("recall"), F.round(evidence.precision_of(F.col("gold"), F.col("cited")), 6).alias("prec"))


@query("""WITH w AS (SELECT qid, list_distinct(list_filter(string_split(lower(gold_answer), ' '), lambda x: x <> '')) AS a, list_distinct(list_filter(string_split(lower(question), ' '), lambda x: x <> '')) AS b FROM questions WHERE gold_answer IS NOT NULL)
  SELECT qid, round(CASE WHEN len(a) = 0 AND len(b) = 0 THEN 1.0 WHEN len(list_intersect(a, b)) = 0 THEN 0.0 ELSE 2.0 * len(list_intersect(a, b)) / (len(a) + len(b)) END, 6) AS f1 FROM w""")
def a26_set_f1(spark, d):
    """A26, H12 with exact equality as the matcher."""
    w = lambda c: F.filter(F.split(F.lower(c), " "), lambda x: x != "")
    q = table(spark, d, "questions").where("gold_answer is not null")
    return q.select("qid", F.round(evidence.set_f1(w(F.col("gold_answer")), w(F.col("question"))), 6).alias("f1"))


@query("""SELECT r.record_id, r.record_type, f.company_id FROM (SELECT record_id, doc_id, record_type, max(loaded_at) AS loaded_at FROM records WHERE status = 'review' GROUP BY ALL) r
  LEFT JOIN (SELECT doc_id, max(company_id) AS company_id FROM filings GROUP BY 1) f USING (doc_id) ORDER BY r.loaded_at DESC NULLS LAST, record_id LIMIT 50""")
def j10_pending_reviews(spark, d):
    """A work list of fifty."""
    return evidence.pending_reviews(table(spark, d, "records"), table(spark, d, "filings"))


@query("SELECT event_id, nth FROM (SELECT event_id, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS nth FROM events) WHERE nth > 1")
def h31_repeated_calls(spark, d):
    """Calls repeated within a request."""
    e = evidence.repeated_calls(table(spark, d, "events"), "user_id", "event_type", ["ts", "event_id"])
    return e.select("event_id", F.col("nth").cast("bigint").alias("nth"))


@query("SELECT version, split, count(*) AS n_questions, count(*) FILTER (verified) AS n_verified, max(qid) AS last_qid FROM (SELECT DISTINCT qid, version, split, verified FROM questions) GROUP BY version, split")
def h1_question_sets(spark, d):
    """Sets of questions with their counts."""
    q = table(spark, d, "questions").select("qid", "version", "split", "verified").distinct()
    return q.groupBy("version", "split").agg(F.count(F.lit(1)).alias("n_questions"), F.count_if("verified").alias("n_verified"), F.max("qid").alias("last_qid"))


@query("""SELECT DISTINCT record_id, CASE WHEN a IS NULL THEN '' ELSE '₹ ' || format('{:,.2f}', a / 1e7) || ' crore' END AS shown FROM (SELECT record_id, CAST(payload_json->>'$.amount_inr' AS DOUBLE) AS a FROM records WHERE record_type = 'rpt')""")
def x26_crore_text(spark, d):
    """Amounts as printed in crore."""
    r = R.decoded(table(spark, d, "records"), "rpt")
    return r.select("record_id", X.crore_text(F.col("p.amount_inr")).alias("shown")).distinct()


@query(_EDGES + """, c AS (SELECT DISTINCT dst_id AS id FROM edges WHERE rel = 'DIRECTOR_OF' ORDER BY id LIMIT 15) SELECT DISTINCT edge_id, rel, src_id, dst_id FROM edges WHERE src_id IN (SELECT id FROM c) OR dst_id IN (SELECT id FROM c)""")
def k13_sample_graph(spark, d):
    """Fifteen companies and their one-hop neighbourhood."""
    e = edges_of(spark, d)
    c = e.where("rel = 'DIRECTOR_OF'").select(F.col("dst_id").alias("id")).distinct().orderBy("id").limit(15)
    a = e.join(c.withColumnRenamed("id", "src_id"), "src_id", "left_semi").unionByName(e.join(c.withColumnRenamed("id", "dst_id"), "dst_id", "left_semi"))
    return a.select("edge_id", "rel", "src_id", "dst_id").distinct()


@query("""SELECT qid, (length(regexp_replace(question, '\\s+', ' ', 'g')) BETWEEN 1 AND 500) AS valid, regexp_full_match(qid, '[A-Za-z0-9_:|-]{1,64}') AS good_id FROM questions""")
def f17_valid_questions(spark, d):
    """F17, F18."""
    q = table(spark, d, "questions")
    return q.select("qid", F.length(F.regexp_replace("question", r"\s+", " ")).between(1, 500).alias("valid"), F.col("qid").rlike(r"^[A-Za-z0-9_:|-]{1,64}$").alias("good_id"))

"""Queries of the reference's own operators over the test tables, with the SQL they are held against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ledgermill.functions import answers, text as X
from ledgermill.operators import documents, evaluation, graph, records as R, resolve, retrieval, statistics as S
from ledgermill.operators.units import answer_amounts  # noqa: F401  (X14-X16 live in operators.units)
from ledgermill.session import table
from ledgermill.streaming.usage import windowed_usage

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers the function under its name, with the SQL that must give the same rows."""
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def edges_of(spark: SparkSession, d: str) -> DataFrame:
    return R.graph_edges(*[table(spark, d, t) for t in ("records", "merge_log", "filings", "entities")])


_NORM = "lower(trim(regexp_replace(regexp_replace(translate(replace(replace(replace(replace({0}, 'ﬁ', 'fi'), 'ﬂ', 'fl'), 'ﬀ', 'ff'), 'ﬃ', 'ffi'), chr(160) || '‘’“”‐‑‒–—―', ' ''''\"\"------'), '-\\n([a-z])', '\\1', 'g'), '\\s+', ' ', 'g')))"
_NC = "trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(replace(" + _NORM + ", '&', ' and '), '\\(.*?\\)', ' ', 'g'), '\\b(limited|ltd|private|pvt|llp|inc|incorporated|co|company|corporation|corp)\\b\\.?', ' ', 'g'), '[^a-z0-9\\s]', ' ', 'g'), '\\s+', ' ', 'g'))"
_NP = "trim(regexp_replace(regexp_replace(regexp_replace(" + _NORM + ", '\\b(mr|mrs|ms|miss|dr|shri|smt|sri|kum|prof|capt|col|justice|ca|cs)\\b\\.?', ' ', 'g'), '[^a-z\\s]', ' ', 'g'), '\\s+', ' ', 'g'))"

# SQL shared by the graph queries -----------------------------------------------------------------------------------

_LINKS = """links AS (SELECT mention_id, entity_id FROM (SELECT mention_id, entity_id, row_number() OVER (PARTITION BY mention_id ORDER BY logged_at DESC NULLS LAST, log_id DESC NULLS LAST, entity_id DESC NULLS LAST) AS k
  FROM merge_log WHERE mention_id IS NOT NULL) WHERE k = 1 AND entity_id IS NOT NULL)"""
_LAST = """lastrec AS (SELECT * FROM (SELECT record_id, loaded_at, status, doc_id, record_type, payload_json, row_number() OVER (PARTITION BY record_id
  ORDER BY loaded_at DESC NULLS LAST, status DESC NULLS LAST, doc_id DESC NULLS LAST, record_type DESC NULLS LAST, payload_json DESC NULLS LAST) AS k FROM records WHERE record_id IS NOT NULL) WHERE k = 1),
acc AS (SELECT * FROM lastrec WHERE status IN ('accepted', 'fixed')),
fil AS (SELECT doc_id, max(company_id) AS company_id, max(fiscal_year) AS filing_year FROM filings WHERE doc_id IS NOT NULL GROUP BY doc_id)"""
_EDGES = f"""WITH RECURSIVE {_LINKS}, {_LAST},
ends AS (SELECT split_part(mention_id, ':', 1) AS record_id, max(entity_id) FILTER (split_part(mention_id, ':', 2) = 'person') AS person, max(entity_id) FILTER (split_part(mention_id, ':', 2) = 'context_company') AS ctx,
  max(entity_id) FILTER (split_part(mention_id, ':', 2) = 'counterparty') AS cp, max(entity_id) FILTER (split_part(mention_id, ':', 2) = 'audit_firm') AS firm, max(entity_id) FILTER (split_part(mention_id, ':', 2) = 'subsidiary') AS sub FROM links GROUP BY 1),
kinds AS (SELECT entity_id, max(kind) AS kind FROM entities GROUP BY 1),
j AS (SELECT a.record_id, a.record_type AS t, a.doc_id, a.payload_json AS p, f.filing_year, e.person, e.ctx, e.cp, e.firm, e.sub, k.kind, coalesce(CAST(a.payload_json->>'$.evidence.page' AS INT), 0) AS page, coalesce(a.payload_json->>'$.evidence.quote', '') AS quote,
  coalesce(nullif(a.payload_json->>'$.fiscal_year', ''), f.filing_year, '') AS fy FROM acc a JOIN fil f USING (doc_id) JOIN ends e USING (record_id) LEFT JOIN kinds k ON k.entity_id = e.cp),
two AS (
  SELECT 'DIRECTOR_OF' AS rel, record_id || ':DIRECTOR_OF' AS key, person AS src_id, 'Person' AS src_type, ctx AS dst_id, 'Company' AS dst_type, p->>'$.role' AS role, fy AS yr, j.* FROM j WHERE t = 'directors'
  UNION ALL SELECT 'AUDITED_BY', record_id || ':AUDITED_BY', ctx, 'Company', firm, 'AuditFirm', NULL, fy, j.* FROM j WHERE t = 'auditor'
  UNION ALL SELECT 'SUBSIDIARY_OF', record_id || ':SUBSIDIARY_OF', sub, 'Company', ctx, 'Company', NULL, '', j.* FROM j WHERE t = 'subsidiaries'
  UNION ALL SELECT 'PARTY_TO', record_id || ':PARTY_TO:reporting', ctx, 'Company', left(sha256(record_id), 16), 'RelatedPartyTxn', 'reporting', fy, j.* FROM j WHERE t = 'rpt' AND cp IS NOT NULL AND ctx IS NOT NULL
  UNION ALL SELECT 'PARTY_TO', record_id || ':PARTY_TO:counterparty', cp, CASE WHEN kind = 'person' THEN 'Person' ELSE 'Company' END, left(sha256(record_id), 16), 'RelatedPartyTxn', 'counterparty', fy, j.* FROM j WHERE t = 'rpt' AND cp IS NOT NULL AND ctx IS NOT NULL AND coalesce(kind, '') <> 'audit_firm'),
edges AS (SELECT left(sha256(key), 16) AS edge_id, rel, src_id, src_type, dst_id, dst_type, role,
  CASE WHEN t = 'directors' THEN coalesce(CAST(p->>'$.is_independent' AS BOOLEAN), false) END AS independent, CASE WHEN t = 'directors' THEN coalesce(p->>'$.appointed_on', '') END AS start_date, CASE WHEN t = 'directors' THEN coalesce(p->>'$.ceased_on', '') END AS end_date,
  yr AS fiscal_year, CASE WHEN t = 'subsidiaries' THEN coalesce(CAST(p->>'$.pct_held' AS DOUBLE), 0) END AS pct_held, CASE WHEN t = 'subsidiaries' THEN coalesce(p->>'$.as_of', '') END AS as_of, doc_id, page, quote,
  CASE WHEN t = 'rpt' THEN coalesce(CAST(p->>'$.amount_inr' AS DOUBLE), 0) END AS amount_inr, CASE WHEN t = 'rpt' THEN coalesce(p->>'$.nature', '') END AS nature, CASE WHEN t = 'rpt' THEN coalesce(p->>'$.relationship', '') END AS relationship
  FROM two WHERE src_id IS NOT NULL AND dst_id IS NOT NULL)"""


@query(_EDGES + " SELECT * FROM edges")
def g_edges(spark, d):
    """Records and resolutions as one edge table."""
    return edges_of(spark, d)


@query(_EDGES + " SELECT rel, count(*) AS n_edges, count(DISTINCT src_id) AS n_sources, count(DISTINCT dst_id) AS n_targets FROM edges GROUP BY rel")
def g_counts_by_relation(spark, d):
    """S13."""
    return graph.counts_by_relation(edges_of(spark, d))


_SEEDS = "seeds AS (SELECT entity_id AS id FROM merge_log WHERE entity_id LIKE 'P:%' GROUP BY entity_id HAVING count(*) >= 5)"


def _seeds(spark, d):
    return table(spark, d, "merge_log").where("entity_id like 'P:%'").groupBy("entity_id").count().where("count >= 5").select(F.col("entity_id").alias("id"))


_NEAR = """touch AS (SELECT e.edge_id, e.rel, e.dst_id, e.fiscal_year, s.id AS seed, e.dst_id AS other FROM edges e JOIN seeds s ON e.src_id = s.id
  UNION SELECT e.edge_id, e.rel, e.dst_id, e.fiscal_year, s.id, e.src_id FROM edges e JOIN seeds s ON e.dst_id = s.id AND e.dst_type <> 'RelatedPartyTxn'),
  ride AS (SELECT DISTINCT e.edge_id, e.rel, e.dst_id, e.fiscal_year, t.seed, e.src_id AS other FROM edges e JOIN touch t ON e.rel = 'PARTY_TO' AND t.rel = 'PARTY_TO' AND e.dst_id = t.dst_id),
  near AS (SELECT *, true AS touches FROM touch UNION ALL SELECT *, false FROM ride r WHERE NOT EXISTS (SELECT 1 FROM touch t WHERE t.edge_id = r.edge_id AND t.seed = r.seed))"""


@query(_EDGES + f", {_SEEDS}, {_NEAR} SELECT DISTINCT seed, other, edge_id, rel, touches FROM near")
def g1_expand_hop(spark, d):
    """Edges of one hop in both directions, with the other parties of reached transactions."""
    return graph.neighbours(edges_of(spark, d), _seeds(spark, d)).select("seed", "other", "edge_id", "rel", "touches")


@query(_EDGES + f""", {_SEEDS}, {_NEAR}, k AS (SELECT *, row_number() OVER (PARTITION BY seed ORDER BY coalesce(fiscal_year, '') DESC, edge_id DESC) AS r FROM near WHERE touches),
  kept AS (SELECT seed, edge_id, rel, dst_id FROM k WHERE r <= 3) SELECT seed, edge_id FROM kept UNION SELECT n.seed, n.edge_id FROM near n JOIN kept USING (seed, dst_id) WHERE NOT n.touches AND kept.rel = 'PARTY_TO'""")
def g9_cap_per_seed(spark, d):
    """Three edges a seed, the other parties of their transactions beside them."""
    return graph.cap_per_seed(graph.neighbours(edges_of(spark, d), _seeds(spark, d)), 3).select("seed", "edge_id")


_TRIPLES = """dated AS (SELECT rel, src_id AS a, dst_id AS b FROM edges WHERE fiscal_year = 'FY2022-23' OR rel NOT IN ('DIRECTOR_OF', 'PARTY_TO')), both_ways AS (SELECT rel, a, b FROM dated UNION SELECT rel, b, a FROM dated),
  h1 AS (SELECT * FROM both_ways WHERE a IN (SELECT id FROM seeds))"""


@query(_EDGES + f", {_SEEDS}, {_TRIPLES} SELECT a || '|' || rel || '|' || b AS triple FROM h1 UNION SELECT a || '|' || rel || '|' || b FROM both_ways WHERE a IN (SELECT b FROM h1)")
def g2_neighbour_triples(spark, d):
    """Triples of two hops as strings, one fiscal year."""
    return graph.neighbour_triples(edges_of(spark, d), _seeds(spark, d), 2, "FY2022-23")


@query("""WITH s AS (SELECT DISTINCT 'C:x' || left(sha256(lower(payload_json->>'$.holder_name')), 8) AS company_id, doc_id, lower(payload_json->>'$.company_name') AS held, CAST(payload_json->>'$.pct_pledged_of_holding' AS DOUBLE) AS p
  FROM records WHERE record_type = 'shareholding' AND status IN ('accepted', 'fixed') AND payload_json->>'$.holder_kind' = 'company' AND payload_json->>'$.holder_name' IS NOT NULL AND payload_json->>'$.company_name' IS NOT NULL)
  SELECT company_id, round(sum(p), 6) AS pledged_pct FROM s GROUP BY 1""")
def g5_stake_totals(spark, d):
    """Pledged shares of company holders, summed over their outgoing HOLDS_STAKE edges."""
    p = R.decoded(R.accepted(table(spark, d, "records")), "shareholding").where("p.holder_kind = 'company' and p.holder_name is not null and p.company_name is not null")
    stake = p.select(F.lit("HOLDS_STAKE").alias("rel"), resolve.fallback_id(F.lit("company"), F.lower("p.holder_name")).alias("src_id"), "doc_id", F.lower("p.company_name").alias("dst_id"), F.col("p.pct_pledged_of_holding").alias("pledged_pct")).distinct()
    return graph.stake_totals(stake).withColumn("pledged_pct", F.round("pledged_pct", 6))


@query(_EDGES + """, asked AS (SELECT edge_id FROM edges WHERE page % 7 = 0 AND rel IN ('DIRECTOR_OF', 'PARTY_TO'))
  SELECT edge_id, rel, src_id, dst_id, amount_inr, nature, relationship, fiscal_year FROM edges WHERE edge_id IN (SELECT edge_id FROM asked)""")
def g7_sub_graph(spark, d):
    """The edges of a list of edge ids, with their transactions' fields."""
    e = edges_of(spark, d)
    asked = e.where("page % 7 = 0 and rel in ('DIRECTOR_OF', 'PARTY_TO')").select("edge_id")
    return graph.sub_graph(e, asked).select("edge_id", "rel", "src_id", "dst_id", "amount_inr", "nature", "relationship", "fiscal_year")


@query(_EDGES + """, raw AS (SELECT CASE rel WHEN 'DIRECTOR_OF' THEN 'HAS_DIRECTOR' WHEN 'AUDITED_BY' THEN 'AUDITS' ELSE rel END AS rel, CASE WHEN rel IN ('DIRECTOR_OF', 'AUDITED_BY') THEN dst_id ELSE src_id END AS a, CASE WHEN rel IN ('DIRECTOR_OF', 'AUDITED_BY') THEN src_id ELSE dst_id END AS b FROM edges)
  SELECT DISTINCT left(sha256(concat_ws(':', r, s, t)), 16) AS edge_id, r AS rel, s AS src_id, t AS dst_id FROM (SELECT CASE rel WHEN 'HAS_DIRECTOR' THEN 'DIRECTOR_OF' WHEN 'AUDITS' THEN 'AUDITED_BY' ELSE rel END AS r, CASE WHEN rel IN ('HAS_DIRECTOR', 'AUDITS') THEN b ELSE a END AS s, CASE WHEN rel IN ('HAS_DIRECTOR', 'AUDITS') THEN a ELSE b END AS t FROM raw)""")
def g8_forward_edges(spark, d):
    """Edges under reverse names and without ids, read forward again."""
    e = edges_of(spark, d)
    back = F.col("rel").isin("DIRECTOR_OF", "AUDITED_BY")
    name = F.when(F.col("rel") == "DIRECTOR_OF", "HAS_DIRECTOR").when(F.col("rel") == "AUDITED_BY", "AUDITS").otherwise(F.col("rel"))
    swap = lambda a, b: F.when(back, F.col(b)).otherwise(F.col(a)).alias(a)
    raw = e.select(F.lit("").alias("edge_id"), name.alias("rel"), swap("src_id", "dst_id"), swap("src_type", "dst_type"), swap("dst_id", "src_id"), swap("dst_type", "src_type"))
    return R.forward_edges(raw).select("edge_id", "rel", "src_id", "dst_id")


@query("""WITH n AS (SELECT entity_id, canonical_name, kind, row_number() OVER (PARTITION BY entity_id ORDER BY updated_at DESC NULLS LAST, row_id DESC, canonical_name DESC, kind DESC NULLS LAST) AS k FROM entities WHERE entity_id IS NOT NULL AND canonical_name IS NOT NULL)
  SELECT entity_id, canonical_name AS name, kind, CASE left(entity_id, 2) WHEN 'C:' THEN 'Company' WHEN 'P:' THEN 'Person' WHEN 'A:' THEN 'AuditFirm' END AS vertex_type FROM n WHERE k = 1""")
def g20_entity_labels(spark, d):
    """Name, kind and vertex type of every entity."""
    return graph.entity_labels(table(spark, d, "entities")).withColumn("vertex_type", R.vertex_type(F.col("entity_id")))


@query("SELECT DISTINCT 'HAS_CHUNK' AS rel, doc_id AS src_id, chunk_id AS dst_id FROM chunks WHERE doc_id IS NOT NULL AND chunk_id IS NOT NULL")
def k8_chunk_edges(spark, d):
    """K8: HAS_CHUNK."""
    return R.chunk_edges(table(spark, d, "chunks"))


@query(_EDGES + ", y AS (SELECT * FROM edges WHERE fiscal_year IS NULL OR fiscal_year = '' OR fiscal_year IN ('FY2022-23', 'FY2023-24')) SELECT rel, fiscal_year, count(*) AS n FROM y GROUP BY rel, fiscal_year")
def f5_years_keep_yearless(spark, d):
    """F5."""
    return graph.filter_years(edges_of(spark, d), ["FY2022-23", "FY2023-24"]).groupBy("rel", "fiscal_year").agg(F.count(F.lit(1)).alias("n"))


@query(_EDGES + """, t AS (SELECT dst_id AS id FROM edges WHERE rel = 'DIRECTOR_OF' GROUP BY dst_id ORDER BY count(DISTINCT src_id) DESC, dst_id LIMIT 2)
  SELECT src_id, count(DISTINCT dst_id) AS n_shared FROM edges WHERE rel = 'DIRECTOR_OF' AND dst_id IN (SELECT id FROM t) GROUP BY src_id HAVING count(DISTINCT dst_id) = (SELECT count(*) FROM t)""")
def g4_shared_directors(spark, d):
    """People on the boards of both of the two companies with most directors."""
    e = edges_of(spark, d).where("rel = 'DIRECTOR_OF'")
    t = e.groupBy("dst_id").agg(F.count_distinct("src_id").alias("n")).orderBy(F.desc("n"), "dst_id").limit(2).select(F.col("dst_id").alias("id"))
    return graph.shared_by_all(e, t)


@query(_EDGES + """, start AS (SELECT min(dst_id) AS id FROM edges WHERE rel = 'DIRECTOR_OF'), u AS (SELECT src_id AS a, dst_id AS b FROM edges UNION SELECT dst_id, src_id FROM edges),
  walk AS (SELECT id, 0 AS hops FROM start UNION SELECT u.b, w.hops + 1 FROM walk w JOIN u ON u.a = w.id WHERE w.hops < 3) SELECT id, min(hops) AS hops FROM walk GROUP BY id""")
def g3_distances(spark, d):
    """Breadth-first distances up to three hops."""
    e = edges_of(spark, d)
    return graph.distances(e, e.where("rel = 'DIRECTOR_OF'").agg(F.min("dst_id").alias("id")), 3)


@query(_EDGES + """, deg AS (SELECT entity_id, count(*) AS degree FROM merge_log WHERE entity_id IS NOT NULL GROUP BY entity_id),
  cut AS (SELECT greatest(quantile_cont(degree, 0.99), 25.0) AS c FROM deg) SELECT entity_id, degree FROM deg, cut WHERE degree > c""")
def g15_hubs(spark, d):
    """G14, G15."""
    return graph.hubs(graph.degrees(table(spark, d, "merge_log")))


@query(_EDGES + " SELECT dst_id AS txn, count(DISTINCT edge_id) AS n_parties FROM edges WHERE rel = 'PARTY_TO' AND fiscal_year = 'FY2022-23' AND src_type = 'Company' GROUP BY dst_id HAVING count(DISTINCT edge_id) < 2")
def g12_incomplete_transactions(spark, d):
    """Transactions of a year of which only one party is a company."""
    return graph.incomplete_transactions(edges_of(spark, d).where("fiscal_year = 'FY2022-23' and src_type = 'Company'"))


@query()
def g11_two_hops(spark, d):
    """Two-hop expansion without hubs; brute force in the tests."""
    e = edges_of(spark, d)
    return graph.two_hops(e, _seeds(spark, d), graph.hubs(graph.degrees(table(spark, d, "merge_log"))))


# records and statistics ---------------------------------------------------------------------------------------------

_F = "f AS (SELECT doc_id, max(company_id) AS company_id, max(fiscal_year) AS filing_year FROM filings GROUP BY doc_id), r AS (SELECT r.*, f.company_id, f.filing_year FROM records r JOIN f USING (doc_id) WHERE r.status IN ('accepted', 'fixed'))"


@query("SELECT record_type, status, count(*) AS n FROM records WHERE status IN ('accepted', 'fixed') GROUP BY ALL")
def f1_accepted_records(spark, d):
    """F1, A9."""
    return R.accepted(table(spark, d, "records")).groupBy("record_type", "status").agg(F.count(F.lit(1)).alias("n"))


@query("""WITH p AS (SELECT record_id, record_type AS t, payload_json AS j, coalesce(CAST(payload_json->>'$.pct_holding' AS DOUBLE), CAST(payload_json->>'$.pct_held' AS DOUBLE)) AS pct, CAST(payload_json->>'$.pct_pledged_of_holding' AS DOUBLE) AS pl, CAST(payload_json->>'$.amount_inr' AS DOUBLE) AS a,
    TRY_CAST(payload_json->>'$.appointed_on' AS DATE) AS d1, TRY_CAST(payload_json->>'$.ceased_on' AS DATE) AS d2, TRY_CAST(regexp_extract(payload_json->>'$.fiscal_year', '(20[0-9]{2})', 1) AS INT) AS y, regexp_extract_all(lower(payload_json->>'$.person_name'), '[a-z]+') AS w FROM records),
  b AS (SELECT *, CASE t WHEN 'directors' THEN ['person_name', 'company_name'] WHEN 'shareholding' THEN ['holder_name', 'company_name'] WHEN 'rpt' THEN ['counterparty_name'] WHEN 'auditor' THEN ['company_name'] WHEN 'subsidiaries' THEN ['parent_company', 'subsidiary_name'] ELSE [] END AS need FROM p),
  v AS (SELECT record_id, j, CASE WHEN coalesce(json_type(j, '$.evidence'), 'NULL') = 'NULL' THEN 'missing_evidence' WHEN len(list_filter(need, lambda x: coalesce(trim(json_extract_string(j, '$.' || x)), '') = '')) > 0 THEN 'empty_name'
    WHEN t = 'directors' AND len(w) <= 3 AND list_has_any(w, ['chairman', 'chairperson', 'secretary', 'director', 'manager', 'ceo', 'cfo', 'officer']) THEN 'name_is_role' WHEN pct < 0 OR pct > 100 THEN 'pct_out_of_range' WHEN a < 0 THEN 'amount_negative' END AS rej,
    CASE WHEN a > 1e12 THEN 'amount_outlier' WHEN t = 'directors' AND (abs(year(d1) - y) > 2 OR abs(year(d2) - y) > 2) THEN 'date_implausible' WHEN d1 > d2 THEN 'date_order_invalid' WHEN pl < 0 OR pl > 100 THEN 'pledge_out_of_range' END AS rev FROM b)
  SELECT record_id, CASE WHEN regexp_full_match(json_extract_string(j, '$.din'), '[0-9]{8}') THEN json_extract_string(j, '$.din') END AS din, CASE WHEN rej IS NOT NULL THEN 'rejected' WHEN rev IS NOT NULL THEN 'review' ELSE 'accepted' END AS verdict, coalesce(rej, rev, '') AS reason FROM v""")
def f7_validated_records(spark, d):
    """the ten rules on all six record types."""
    return R.validated(table(spark, d, "records"))


@query("SELECT * EXCLUDE k FROM (SELECT record_id, status, loaded_at, row_number() OVER (PARTITION BY record_id ORDER BY loaded_at DESC NULLS LAST, status DESC NULLS LAST) AS k FROM (SELECT record_id, status, loaded_at FROM records)) WHERE k = 1")
def k1_latest_delivery(spark, d):
    """K1, U5, W18, W19."""
    return R.latest_delivery(table(spark, d, "records").select("record_id", "status", "loaded_at"), "record_id", ["loaded_at"])


@query(f"""WITH {_F}, p AS (SELECT company_id, payload_json->>'$.fiscal_year' AS fiscal_year, payload_json->>'$.person_name' AS person, coalesce(CAST(payload_json->>'$.is_independent' AS BOOLEAN), false) AS i,
  row_number() OVER (PARTITION BY company_id, payload_json->>'$.fiscal_year', payload_json->>'$.person_name' ORDER BY loaded_at DESC NULLS LAST, record_id DESC) AS k FROM r WHERE record_type = 'directors' AND payload_json->>'$.person_name' IS NOT NULL)
  SELECT company_id, fiscal_year, count(*) AS n_people, CAST(sum(CAST(i AS INT)) AS BIGINT) AS n_independent FROM p WHERE k = 1 GROUP BY ALL""")
def a1_board_sizes(spark, d):
    """J1, A1, H20."""
    return S.board_sizes(table(spark, d, "records"), table(spark, d, "filings"))


@query(f"""WITH {_F}, s AS (SELECT company_id, coalesce(nullif(payload_json->>'$.fiscal_year', ''), filing_year, '') AS fiscal_year, list_sort(list_distinct(list(" + "NORMALISED" + "))) AS firms FROM r WHERE record_type = 'auditor' AND company_id IS NOT NULL AND trim(payload_json->>'$.firm_name') <> '' GROUP BY ALL)
  SELECT company_id, fiscal_year, array_to_string(firms, '|') AS firms, coalesce(lag(firms) OVER (PARTITION BY company_id ORDER BY fiscal_year) <> firms, false) AS changed FROM s""".replace('" + "NORMALISED" + "', _NC.format("payload_json->>'$.firm_name'")))
def a2_auditor_changes(spark, d):
    """A2."""
    return S.auditor_changes(table(spark, d, "records"), table(spark, d, "filings"))


@query(f"""WITH {_LAST} SELECT f.company_id, payload_json->>'$.fiscal_year' AS fiscal_year, count(*) AS n_transactions, round(sum(CAST(payload_json->>'$.amount_inr' AS DOUBLE)) / 1e7, 4) AS total_crore FROM acc JOIN fil f USING (doc_id) WHERE record_type = 'rpt' GROUP BY ALL""")
def a3_transaction_totals(spark, d):
    """A3."""
    return S.transaction_totals(table(spark, d, "records"), table(spark, d, "filings"))


@query(f"WITH {_F} SELECT company_id, filing_year, count(DISTINCT payload_json->>'$.subsidiary_name') AS n_subsidiaries FROM r WHERE record_type = 'subsidiaries' GROUP BY ALL")
def a4_subsidiary_counts(spark, d):
    """A4."""
    return S.subsidiary_counts(table(spark, d, "records"), table(spark, d, "filings"))


@query(_EDGES + " SELECT src_id AS person_id, count(DISTINCT dst_id) AS n_boards FROM edges WHERE rel = 'DIRECTOR_OF' GROUP BY 1 HAVING count(DISTINCT dst_id) > 1 ORDER BY n_boards DESC, person_id LIMIT 10")
def a5_multi_board_people(spark, d):
    """A top-ten list."""
    return S.multi_board_people(edges_of(spark, d))


@query("""SELECT count(*) AS n_accepted, round(avg(CASE WHEN coalesce((payload_json->>'$.evidence.quote') <> '' AND CAST(payload_json->>'$.evidence.page' AS INT) <> 0, false) THEN 1.0 ELSE 0.0 END) * 100, 1) AS complete_pct
  FROM records WHERE status IN ('accepted', 'fixed')""")
def a10_provenance(spark, d):
    """A10, F20."""
    return S.provenance(table(spark, d, "records"))


@query("SELECT record_type, count(*) FILTER (status = 'accepted') AS accepted, count(*) FILTER (status = 'fixed') AS fixed, count(*) FILTER (status = 'review') AS review, count(*) FILTER (status = 'rejected') AS rejected FROM records GROUP BY 1")
def a11_outcome_matrix(spark, d):
    """A11."""
    return S.outcome_matrix(table(spark, d, "records"))


_FY = "CASE WHEN regexp_full_match(fiscal_year, '(FY ?)?20[0-9]{2}-[0-9]{2}') THEN 'FY' || right(fiscal_year, 7) WHEN regexp_full_match(fiscal_year, 'FY ?[0-9]{2}') THEN 'FY' || (1999 + CAST(right(fiscal_year, 2) AS INT)) || '-' || right(fiscal_year, 2) ELSE coalesce(fiscal_year, '') END"


@query(f"SELECT company_id, doc_type, {_FY} AS fiscal_year, count(DISTINCT doc_id) AS n_documents, count(DISTINCT doc_id) FILTER (status IN ('parsed', 'extracted')) AS n_parsed FROM filings GROUP BY ALL")
def a28_coverage(spark, d):
    """Filings by company, type and fiscal year in any spelling; years are rows, so none is left out."""
    return S.coverage(table(spark, d, "filings"))


@query(f"""WITH {_F}, b AS (SELECT company_id, coalesce(filing_year, '') AS fy, trim(payload_json->>'$.person_name') AS n, bool_or(coalesce(CAST(payload_json->>'$.is_independent' AS BOOLEAN), false)) AS i FROM r WHERE record_type = 'directors' AND company_id IS NOT NULL AND trim(payload_json->>'$.person_name') <> '' GROUP BY ALL),
  t AS (SELECT 'DIRECTOR_OF' AS topic, company_id || ' had ' || count(*) || CASE WHEN count(*) = 1 THEN ' director' ELSE ' directors' END || ' on record in ' || fy || ', of whom ' || sum(CAST(i AS INT)) || ' are independent.' AS text FROM b GROUP BY company_id, fy
  UNION ALL SELECT 'SUBSIDIARY_OF', company_id || ' listed ' || count(DISTINCT n) || CASE WHEN count(DISTINCT n) = 1 THEN ' subsidiary' ELSE ' subsidiaries' END || ' in ' || fy || '.' FROM (SELECT company_id, coalesce(filing_year, '') AS fy, trim(payload_json->>'$.subsidiary_name') AS n FROM r WHERE record_type = 'subsidiaries' AND company_id IS NOT NULL) WHERE n <> '' GROUP BY company_id, fy
  UNION ALL SELECT 'COVERAGE', 'The dataset has ' || (SELECT count(DISTINCT doc_id) FROM filings) || ' documents covering ' || count(DISTINCT company_id) || ' companies and ' || count(DISTINCT filing_year) || ' fiscal years.' FROM r)
  SELECT topic, text || ' [computed from ' || (SELECT count(DISTINCT record_id) FROM r) || ' accepted records]' AS text FROM t""")
def a7_statistics(spark, d):
    """Statistics as texts with their basis."""
    return S.statistics_texts(table(spark, d, "records"), table(spark, d, "filings"))


@query("""SELECT (SELECT count(DISTINCT doc_id) FROM filings) AS n_documents, (SELECT count(DISTINCT doc_id) FROM filings WHERE status IN ('parsed', 'extracted')) AS n_parsed,
  (SELECT count(DISTINCT chunk_id) FROM chunks) AS n_chunks, (SELECT count(DISTINCT record_id) FROM records) AS n_records, (SELECT count(DISTINCT entity_id) FROM entities) AS n_entities""")
def a8_store_counts(spark, d):
    """A8."""
    return S.store_counts(table(spark, d, "records"), table(spark, d, "filings"), table(spark, d, "chunks"), table(spark, d, "entities"))


@query("SELECT a.doc_id AS doc_a, b.doc_id AS doc_b FROM (SELECT DISTINCT doc_id, company_id, fiscal_year FROM filings) a JOIN (SELECT DISTINCT doc_id, company_id, fiscal_year FROM filings) b ON a.company_id IS NOT DISTINCT FROM b.company_id AND a.fiscal_year IS NOT DISTINCT FROM b.fiscal_year AND a.doc_id < b.doc_id")
def f2_same_company_and_year(spark, d):
    """null-safe equality."""
    f = table(spark, d, "filings").select("doc_id", "company_id", "fiscal_year").distinct()
    a, b = f.alias("a"), f.alias("b")
    on = F.col("a.company_id").eqNullSafe(F.col("b.company_id")) & F.col("a.fiscal_year").eqNullSafe(F.col("b.fiscal_year")) & (F.col("a.doc_id") < F.col("b.doc_id"))
    return a.join(b, on).select(F.col("a.doc_id").alias("doc_a"), F.col("b.doc_id").alias("doc_b"))


@query("SELECT DISTINCT doc_id FROM filings WHERE doc_id NOT IN (SELECT doc_id FROM records WHERE doc_id IS NOT NULL)")
def j9_filings_without_records(spark, d):
    """Anti join."""
    return table(spark, d, "filings").select("doc_id").distinct().join(table(spark, d, "records").select("doc_id"), "doc_id", "left_anti")


# documents ----------------------------------------------------------------------------------------------------------

_PT = "pt AS (SELECT doc_id, page_no, max(coalesce(cleaned_text, text)) AS t FROM parsed_pages WHERE coalesce(cleaned_text, text) IS NOT NULL GROUP BY ALL)"


@query(f"""WITH {_PT}, l AS (SELECT doc_id, page_no, list_filter(list_transform(string_split(t, chr(10)), lambda x: trim(x)), lambda x: x <> '') AS ls FROM pt), n AS (SELECT * FROM l WHERE len(ls) > 0),
  e AS (SELECT DISTINCT doc_id, page_no, unnest(list_transform(list_concat(ls[1:2], ls[greatest(len(ls) - 1, 1):]), lambda x: regexp_replace(x, '[0-9]+', '', 'g'))) AS line FROM n)
  SELECT doc_id, line, count(*) AS n_hits, (SELECT count(*) FROM n m WHERE m.doc_id = e.doc_id) AS n_pages FROM e WHERE line <> '' GROUP BY doc_id, line HAVING count(*) >= 0.6 * n_pages""")
def a27_repeated_edges(spark, d):
    """A27."""
    return documents.repeated_edges(table(spark, d, "parsed_pages"))


_SECTIONS = f"""{_PT}, nt AS (SELECT doc_id, page_no, {_NORM.format('t')} AS n FROM pt), words AS (SELECT * FROM (VALUES """ + ", ".join("({}, '{}', '{}', {})".format(i, k, w.replace("'", "''"), documents.SECTION_LENGTHS[k]) for i, (k, ws) in enumerate(documents.SECTION_WORDS.items()) for w in ws) + """) AS v(nth, kind, w, most)),
  st AS (SELECT doc_id, nth, most, CASE WHEN kind <> 'related_party' THEN kind WHEN contains(n, 'consolidated') THEN 'related_party_consolidated' ELSE 'related_party_standalone' END AS kind, min(page_no) AS page_start FROM nt JOIN words ON contains(n, w) GROUP BY ALL),
  sec AS (SELECT doc_id, kind, page_start, least(page_start + most, CASE WHEN nxt > page_start THEN nxt - 1 ELSE 1000000 END, last_page) AS page_end FROM (SELECT *, lead(page_start) OVER (PARTITION BY doc_id ORDER BY page_start, nth, kind) AS nxt FROM st) JOIN (SELECT doc_id, max(page_no) AS last_page FROM nt GROUP BY 1) USING (doc_id))"""


@query(f"WITH {_SECTIONS} SELECT * FROM sec")
def w21_sections(spark, d):
    """W21, W22."""
    return documents.sections(table(spark, d, "parsed_pages"))


@query(f"WITH {_SECTIONS}, c AS (SELECT doc_id, page_no, min_by(kind, (page_start, kind)) AS kind FROM nt JOIN sec USING (doc_id) WHERE page_no BETWEEN page_start AND page_end GROUP BY ALL) SELECT doc_id, page_no, coalesce(kind, 'other') AS kind FROM nt LEFT JOIN c USING (doc_id, page_no)")
def j16_page_sections(spark, d):
    """J16."""
    p = table(spark, d, "parsed_pages")
    return documents.page_sections(p, documents.sections(p))


@query("""SELECT DISTINCT r.record_id, c.chunk_id FROM records r JOIN chunks c ON r.doc_id = c.doc_id AND CAST(r.payload_json->>'$.evidence.page' AS INT) BETWEEN least(coalesce(c.page_start, c.page_end), c.page_end) AND c.page_end""")
def j14_evidence_chunks(spark, d):
    """Range join as equi-join by page."""
    return documents.evidence_chunks(table(spark, d, "records"), table(spark, d, "chunks"))


@query("""WITH c AS (SELECT chunk_id, concat(' ', trim(regexp_replace(lower(max(text)), '[^a-z0-9]+', ' ', 'g')), ' ') AS t FROM chunks WHERE text IS NOT NULL GROUP BY chunk_id),
  e AS (SELECT DISTINCT entity_id, trim(regexp_replace(lower(canonical_name), '[^a-z0-9]+', ' ', 'g')) AS p FROM entities)
  SELECT DISTINCT chunk_id, entity_id FROM c JOIN e ON p LIKE '% %' AND contains(t, concat(' ', p, ' '))""")
def j15_phrase_mentions(spark, d):
    """Phrase containment as word-pair equi-join."""
    return documents.phrase_mentions(table(spark, d, "chunks"), table(spark, d, "entities"))


@query(f"""WITH RECURSIVE {_PT}, k AS (SELECT doc_id, page_no, greatest(1, length(t) // 4) AS tok, row_number() OVER (PARTITION BY doc_id ORDER BY page_no) AS r FROM pt),
  w AS (SELECT doc_id, r, page_no, tok, 0 AS window_no, tok AS used FROM k WHERE r = 1 UNION ALL
    SELECT k.doc_id, k.r, k.page_no, k.tok, CASE WHEN w.used + k.tok > 4000 THEN w.window_no + 1 ELSE w.window_no END, CASE WHEN w.used + k.tok > 4000 THEN w.tok + k.tok ELSE w.used + k.tok END FROM w JOIN k ON k.doc_id = w.doc_id AND k.r = w.r + 1)
  SELECT doc_id, window_no, page_no FROM w UNION SELECT b.doc_id, b.window_no, a.page_no FROM w b JOIN w a ON a.doc_id = b.doc_id AND a.r = b.r - 1 WHERE b.window_no > a.window_no""")
def w23_page_windows(spark, d):
    """Windows of pages with an overlap of one page."""
    return documents.page_windows(table(spark, d, "parsed_pages"))


@query()
def x2_cleaned_pages(spark, d):
    """Pages without furniture; brute force in the tests."""
    return documents.cleaned_pages(table(spark, d, "parsed_pages"))


# resolution ---------------------------------------------------------------------------------------------------------

@query("""WITH m AS (SELECT mention_id, kind, norm_name, ids['din'] AS din, coalesce(CASE WHEN ids['company_id'] <> '' AND NOT regexp_matches(ids['company_id'], '^0+$') THEN ids['company_id'] END, CASE WHEN ids['cin'] <> '' AND NOT regexp_matches(ids['cin'], '^0+$') THEN ids['cin'] END) AS c, ids['frn'] AS frn FROM mentions)
  SELECT mention_id, CASE WHEN kind = 'person' AND din <> '' AND NOT regexp_matches(din, '^0+$') THEN 'P:' || din WHEN kind = 'company' AND c IS NOT NULL THEN 'C:' || c WHEN kind = 'audit_firm' AND frn <> '' AND NOT regexp_matches(frn, '^0+$') THEN 'A:' || frn END AS official,
  (CASE WHEN kind = 'person' THEN 'P:x' WHEN kind = 'audit_firm' THEN 'A:x' ELSE 'C:x' END) || left(sha256(norm_name), 8) AS fallback FROM m""")
def x8_entity_ids(spark, d):
    """X8, X9."""
    return table(spark, d, "mentions").select("mention_id", resolve.official_id(F.col("kind"), F.col("ids")).alias("official"), resolve.fallback_id(F.col("kind"), F.col("norm_name")).alias("fallback"))


@query()
def j13_candidate_pairs(spark, d):
    """Blocked and scored pairs of names."""
    return resolve.candidate_pairs(table(spark, d, "mentions"))


@query(f"""WITH {_LINKS}, c AS (SELECT entity_id, raw_name, count(*) AS n FROM mentions JOIN links USING (mention_id) WHERE raw_name IS NOT NULL GROUP BY ALL),
  k AS (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY n DESC, length(raw_name) DESC, raw_name) AS r FROM c)
  SELECT entity_id, max(CASE WHEN r = 1 THEN raw_name END) AS canonical_name, string_agg(raw_name, '|' ORDER BY raw_name) AS aliases FROM k GROUP BY entity_id""")
def a23_canonical_names(spark, d):
    """A23."""
    return resolve.canonical_names(table(spark, d, "mentions"), R.latest_links(table(spark, d, "merge_log")))




@query(f"""WITH {_LAST}, nm AS (SELECT substr(entity_id, 3) AS company_id, max(canonical_name) AS name FROM entities WHERE kind = 'company' GROUP BY 1), r AS (SELECT a.record_id, a.record_type AS t, a.payload_json AS p, f.company_id, n.name FROM acc a JOIN fil f USING (doc_id) LEFT JOIN nm n USING (company_id) WHERE record_type IN ('directors', 'rpt', 'auditor', 'subsidiaries')),
  m AS (SELECT record_id || ':context_company' AS mention_id, 'company' AS kind, coalesce(name, company_id) AS raw_name, 'company_id=' || company_id AS id, company_id, record_id FROM r WHERE company_id IS NOT NULL
  UNION ALL SELECT record_id || ':person', 'person', p->>'$.person_name', 'din=' || nullif(p->>'$.din', ''), company_id, record_id FROM r WHERE t = 'directors'
  UNION ALL SELECT record_id || ':counterparty', CASE WHEN regexp_matches(lower(p->>'$.counterparty_name'), ' (limited|ltd|private|pvt|llp|trust|inc|co|corporation)|(limited|ltd|private|pvt|llp|trust|inc|co|corporation)$') THEN 'company' ELSE 'person' END, p->>'$.counterparty_name', NULL, company_id, record_id FROM r WHERE t = 'rpt'
  UNION ALL SELECT record_id || ':audit_firm', 'audit_firm', p->>'$.firm_name', 'frn=' || nullif(p->>'$.firm_registration_no', ''), company_id, record_id FROM r WHERE t = 'auditor' UNION ALL SELECT record_id || ':subsidiary', 'company', p->>'$.subsidiary_name', NULL, company_id, record_id FROM r WHERE t = 'subsidiaries')
  SELECT mention_id, kind, raw_name, CASE WHEN kind = 'person' THEN {_NP.format('raw_name')} ELSE {_NC.format('raw_name')} END AS norm_name, id, company_id AS context_company_id, record_id FROM m WHERE raw_name <> ''""")
def u9_mentions(spark, d):
    """Mentions of accepted records with their reporting companies."""
    names = table(spark, d, "entities").where("kind = 'company'").groupBy(F.expr("substring(entity_id, 3)").alias("company_id")).agg(F.max("canonical_name").alias("name"))
    m = resolve.build_mentions(table(spark, d, "records"), table(spark, d, "filings"), names)
    return m.withColumn("id", F.expr("array_join(transform(map_entries(ids), x -> concat(x.key, '=', x.value)), ',')")).withColumn("id", F.nullif("id", F.lit(""))).drop("ids")


# retrieval and ranking ----------------------------------------------------------------------------------------------

def _questions(spark, d):
    q = table(spark, d, "questions").where("qid is not null and question is not null")
    return q.groupBy(F.col("qid").alias("query_id")).agg(F.max("question").alias("query"))


def _chunk_texts(spark, d):
    return table(spark, d, "chunks").where("text is not null").groupBy(F.col("chunk_id").alias("doc_id")).agg(F.max("text").alias("text"))


_STOP = "(" + ", ".join(f"'{w}'" for w in X.STOP_WORDS) + ")"
_BM25 = f"""d AS (SELECT chunk_id AS doc_id, max(text) AS text FROM chunks WHERE text IS NOT NULL GROUP BY 1), q AS (SELECT qid AS query_id, max(question) AS query FROM questions WHERE qid IS NOT NULL AND question IS NOT NULL GROUP BY 1),
  w AS (SELECT doc_id, list_filter(regexp_extract_all(lower(text), '[a-z0-9]+'), lambda x: x NOT IN {_STOP}) AS ws FROM d), s AS (SELECT count(*) AS n, avg(len(ws)) AS al FROM w),
  t AS (SELECT DISTINCT query_id, unnest(list_filter(regexp_extract_all(lower(query), '[a-z0-9]+'), lambda x: x NOT IN {_STOP})) AS term FROM q),
  p AS (SELECT doc_id, len, term, count(*) AS tf FROM (SELECT doc_id, len(ws) AS len, unnest(ws) AS term FROM w) GROUP BY ALL), f AS (SELECT term, count(*) AS df FROM p GROUP BY 1),
  sc AS (SELECT query_id, doc_id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len / al))) AS score FROM t JOIN p USING (term) JOIN f USING (term), s GROUP BY ALL),
  rk AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM sc WHERE score > 0)"""


@query(f"WITH {_BM25} SELECT query_id, doc_id, round(score, 4) AS score, rank FROM rk WHERE rank <= 8")
def w2_bm25(spark, d):
    """The eight best chunks of every question."""
    return retrieval.bm25(_chunk_texts(spark, d), _questions(spark, d), 8).withColumn("score", F.round("score", 4)).withColumn("rank", F.col("rank").cast("bigint"))


def _vector_hits(spark, d, k):
    v = table(spark, d, "embeddings").where("vec_id is not null and embedding is not null").groupBy("vec_id").agg(F.max("embedding").alias("embedding"))
    return retrieval.vector_top_k(v, v.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding"), k)


@query("""WITH v AS (SELECT vec_id, max(embedding) AS embedding FROM embeddings GROUP BY vec_id), s AS (SELECT q.vec_id AS query_id, v.vec_id, list_dot_product(CAST(q.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[])) AS score FROM v q, v WHERE q.vec_id % 20 = 0),
  k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, vec_id) AS rank FROM s) SELECT query_id, vec_id, rank FROM k WHERE rank <= 10""")
def w1_vector_top_k(spark, d):
    """Exact search of every twentieth vector against all."""
    return _vector_hits(spark, d, 10).select("query_id", "vec_id", F.col("rank").cast("bigint").alias("rank"))


@query(f"""WITH {_BM25}, l AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank, doc_id AS x FROM rk WHERE rank <= 24),
  o AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY doc_id) AS rank FROM l), a AS (SELECT query_id, doc_id, rank FROM l UNION ALL SELECT query_id, doc_id, rank FROM o),
  z AS (SELECT query_id, doc_id, sum(1.0 / (60 + rank)) AS score, min(rank) AS f FROM a GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, f, doc_id) AS rank FROM z)
  SELECT query_id, doc_id, round(score, 6) AS score, rank FROM k WHERE rank <= 8""")
def w3_rank_fusion(spark, d):
    """Keyword ranking fused with a second ranking of its hits."""
    from pyspark.sql import Window

    a = retrieval.bm25(_chunk_texts(spark, d), _questions(spark, d), 24)
    b = a.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("doc_id")))
    return retrieval.reciprocal_rank_fusion([a, b], 8).withColumn("score", F.round("score", 6)).withColumn("rank", F.col("rank").cast("bigint"))


@query()
def w13_evidence_budget(spark, d):
    """Keyword hits of every question that fit 4000 tokens, labelled; brute force in the tests."""
    hits = retrieval.bm25(_chunk_texts(spark, d), _questions(spark, d), 40)
    items = hits.join(_chunk_texts(spark, d), "doc_id").select("query_id", "rank", X.estimate_tokens(F.col("text")).alias("tokens"), "doc_id")
    return retrieval.fit_budget(items, "query_id", "rank", "tokens", 4000)


@query("""SELECT qid, list_filter([""" + ", ".join(f"CASE WHEN regexp_matches(lower(question), '{p}') THEN '{r}' END" for r, p in X.RELATION_WORDS.items()) + """], lambda x: x IS NOT NULL) AS relations,
  CASE WHEN regexp_extract(question, '(?i)FY ?([0-9]{4}-[0-9]{2})', 1) <> '' THEN 'FY' || regexp_extract(question, '(?i)FY ?([0-9]{4}-[0-9]{2})', 1) END AS fiscal_year FROM questions""")
def f12_question_scope(spark, d):
    """F12, F13, F15, H46."""
    return table(spark, d, "questions").select("qid", X.relations_asked(F.col("question")).alias("relations"), X.fiscal_year_of(F.col("question")).alias("fiscal_year"))


# evaluation ---------------------------------------------------------------------------------------------------------

PIPELINES = ["rag", "graphrag", "agent"]
_NA = "trim(regexp_replace(regexp_replace(regexp_replace(replace(regexp_replace(lower({0}), '\\bm\\s*/\\s*s\\b\\.?', ' ', 'g'), '&', ' and '), '[^a-z0-9 ]+', ' ', 'g'), '\\b(llp|ltd|limited|pvt|private|co|company|the)\\b', ' ', 'g'), '\\s+', ' ', 'g'))"
_CRORE = "CASE WHEN lower({0}) LIKE '%crore%' THEN {1} WHEN lower({0}) LIKE '%lakh%' THEN {1} * 0.01 WHEN lower({0}) LIKE '%million%' THEN {1} * 0.1 WHEN lower({0}) LIKE '%billion%' THEN {1} * 100 WHEN {1} >= 1e6 THEN {1} / 1e7 ELSE {1} END"
_RUNS = f"""qs AS (SELECT qid, max(question) AS question, max(category) AS category, max(answer_type) AS answer_type, max(gold_answer) AS gold_answer, max(gold_evidence) AS gold_evidence, max(version) AS version, max(split) AS split FROM questions WHERE qid IS NOT NULL GROUP BY qid),
  h AS (SELECT *, left(md5(qid || pipeline), 1) AS k FROM qs, (VALUES ('rag'), ('graphrag'), ('agent')) AS p(pipeline)),
  results AS (SELECT pipeline || '-run' AS run_id, pipeline, qid, CASE WHEN k IN ('0', '1') THEN 'abstained' WHEN k = '2' THEN 'error' WHEN k = '3' THEN 'budget' ELSE 'ok' END AS status, CASE WHEN k < 'b' THEN gold_answer ELSE reverse(gold_answer) END AS answer_short,
    CASE WHEN k IN ('1', '4', '7', 'a', 'd') THEN gold_evidence ELSE list_transform(gold_evidence, lambda x: struct_pack(doc_id := x.doc_id, page := x.page + 1)) END AS cited, CASE WHEN k IN ('8', '9') THEN 0.5 WHEN k IN ('4', '5', '6', '7', 'c') THEN 1.0 END AS faithfulness,
    100 * length(question) + length(pipeline) AS latency_ms, length(question) / 1024.0 AS cost_usd, length(pipeline) AS llm_calls, CASE WHEN pipeline = 'agent' THEN 2 ELSE 0 END AS tool_calls FROM h),
  z AS (SELECT r.*, q.category, q.answer_type, q.gold_answer AS gold, coalesce(q.category, '') <> 'unanswerable' AS answerable, list_transform(q.gold_evidence, lambda x: x.doc_id || ':' || CAST(x.page AS VARCHAR)) AS ge, list_transform(r.cited, lambda x: x.doc_id || ':' || CAST(x.page AS VARCHAR)) AS ce,
    TRY_CAST(replace(regexp_extract(r.answer_short, '([0-9][0-9,]*(?:\\.[0-9]+)?)', 1), ',', '') AS DOUBLE) AS num, TRY_CAST(q.gold_answer AS DOUBLE) AS want FROM results r JOIN qs q USING (qid)),
  y AS (SELECT *, CASE WHEN len(ge) > 0 THEN len(list_intersect(ge, ce)) / len(list_distinct(ge)) END AS evidence_recall, CASE WHEN len(ce) > 0 THEN len(list_intersect(ce, ge)) / len(list_distinct(ce)) END AS citation_accuracy,
    CASE WHEN NOT answerable THEN CAST(status = 'abstained' AS INT) * 1.0 WHEN status IN ('error', 'abstained') THEN 0.0 WHEN answer_type = 'entity' THEN CASE WHEN coalesce({_NA.format('answer_short')}, '') <> '' AND {_NA.format('answer_short')} = {_NA.format('gold')} THEN 1.0 ELSE 0.0 END
      WHEN answer_type = 'number' THEN CASE WHEN abs(({_CRORE.format('answer_short', 'num')}) - want) <= 0.01 * abs(want) THEN 1.0 ELSE 0.0 END ELSE 0.0 END AS correct FROM z),
  sc AS (SELECT run_id, pipeline, qid, category, answer_type, correct, status = 'abstained' AS abstained, status = 'error' AS error, status = 'budget' AS budget_exceeded, faithfulness, citation_accuracy, evidence_recall,
    CASE WHEN status = 'error' THEN 'bad_query' WHEN status = 'budget' AND correct < 1 THEN 'budget_loop' WHEN NOT answerable THEN CASE WHEN status = 'abstained' THEN NULL ELSE 'hallucination' END WHEN status = 'abstained' THEN 'wrong_abstention' WHEN faithfulness < 1 THEN 'hallucination' WHEN correct >= 1 THEN NULL
      WHEN evidence_recall = 0 THEN 'retrieval_miss' WHEN answer_type = 'number' THEN 'arithmetic_error' WHEN evidence_recall IS NULL THEN 'retrieval_miss' ELSE 'hallucination' END AS failure_label, latency_ms, cost_usd, llm_calls, tool_calls FROM y)"""


def question_rows(spark, d):
    """One row a question."""
    q = table(spark, d, "questions").where("qid is not null")
    return q.groupBy("qid").agg(*[F.max(c).alias(c) for c in ("question", "category", "answer_type", "gold_answer", "gold_evidence", "version", "split")])


def fixture_results(spark, d):
    """Results of three runs made from the questions by a hash, as the test data has no runs: right, turned round and missing
    answers, right and next pages cited, supported or not."""
    q = question_rows(spark, d).withColumn("pipeline", F.explode(F.array(*[F.lit(p) for p in PIPELINES]))).withColumn("k", F.left(F.md5(F.concat("qid", "pipeline")), F.lit(1)))
    k = F.col("k")
    later = F.transform("gold_evidence", lambda x: F.struct(x["doc_id"].alias("doc_id"), (x["page"] + 1).alias("page")))
    return q.select(
        F.concat("pipeline", F.lit("-run")).alias("run_id"), "pipeline", "qid", F.when(k.isin("0", "1"), "abstained").when(k == "2", "error").when(k == "3", "budget").otherwise("ok").alias("status"),
        F.when(k < "b", F.col("gold_answer")).otherwise(F.reverse("gold_answer")).alias("answer_short"), F.when(k.isin("1", "4", "7", "a", "d"), F.col("gold_evidence")).otherwise(later).alias("cited"),
        F.when(k.isin("8", "9"), 0.5).when(k.isin("4", "5", "6", "7", "c"), 1.0).alias("faithfulness"), (100 * F.length("question") + F.length("pipeline")).alias("latency_ms"), (F.length("question") / 1024.0).alias("cost_usd"),
        F.length("pipeline").alias("llm_calls"), F.when(F.col("pipeline") == "agent", 2).otherwise(0).alias("tool_calls"))


def fixture_scores(spark, d):
    return evaluation.score_results(fixture_results(spark, d), question_rows(spark, d))


def fixture_runs(spark):
    rows = [("rag-run", "rag", "test", "2024-01-01", "2024-01-02"), ("graphrag-run", "graphrag", "test", "2024-01-02", None), ("agent-run", "agent", "dev", "2024-01-03", "2024-01-04"), ("empty-run", "agent", "test", "2024-02-01", None)]
    return spark.createDataFrame(rows, "run_id string, pipeline string, split string, started_at string, finished_at string")


_RUN_ROWS = "runs AS (SELECT * FROM (VALUES ('rag-run', 'rag', 'test', '2024-01-01', '2024-01-02'), ('graphrag-run', 'graphrag', 'test', '2024-01-02', NULL), ('agent-run', 'agent', 'dev', '2024-01-03', '2024-01-04'), ('empty-run', 'agent', 'test', '2024-02-01', NULL)) AS v(run_id, pipeline, split, started_at, finished_at))"


@query(f"WITH {_RUNS} SELECT * EXCLUDE (pipeline) FROM sc")
def x21_scores(spark, d):
    """Results scored against the questions."""
    return fixture_scores(spark, d)


_LABELS = evaluation.FAILURE_LABELS[4:]


@query(f"""WITH {_RUNS} SELECT run_id, category, grouping(category) AS overall, count(*) AS n, round(avg(correct), 6) AS correct_mean, round(avg(faithfulness), 6) AS faithfulness_mean, round(avg(citation_accuracy), 6) AS citation_accuracy_mean, round(avg(evidence_recall), 6) AS evidence_recall_mean,
  round(avg(CAST(abstained AS INT)), 6) AS abstention_rate, count(*) FILTER (error) AS error_count, quantile_cont(latency_ms, 0.5) AS latency_median_ms, quantile_cont(latency_ms, 0.9) AS latency_p90_ms, round(avg(cost_usd), 6) AS cost_usd_mean, round(avg(llm_calls), 6) AS llm_calls_mean,
  round(avg(tool_calls), 6) AS tool_calls_mean, round(avg(CAST(budget_exceeded AS INT)), 6) AS budget_exceeded_rate, """ + ", ".join(f"count(*) FILTER (failure_label = '{x}') AS {x}" for x in _LABELS) + " FROM sc GROUP BY GROUPING SETS ((run_id, category), (run_id))")
def a13_summary(spark, d):
    """Metrics and failures by run and category."""
    s = evaluation.summarize(fixture_scores(spark, d))
    means = [c for c in s.columns if c.endswith(("_mean", "_rate"))]
    return s.withColumn("overall", F.col("overall").cast("bigint")).withColumns({c: F.round(c, 6) for c in means})


def _of(scores, pipeline):
    return scores.where(F.col("run_id") == f"{pipeline}-run")


@query()
def a15_paired_difference(spark, d):
    """Bootstrap of two runs by category and overall; bit-equal to numpy in the tests."""
    s = fixture_scores(spark, d)
    return evaluation.paired_difference(_of(s, "graphrag"), _of(s, "rag"))


@query()
def a18_leaders(spark, d):
    """Leading run by category with a paired verdict; brute force in the tests."""
    return evaluation.leaders(fixture_scores(spark, d))


@query(f"WITH {_RUNS} SELECT qid, " + ", ".join(f"max(correct) FILTER (sc.pipeline = '{p}') AS {p}_correct, max(failure_label) FILTER (sc.pipeline = '{p}') AS {p}_label, max(answer_short) FILTER (sc.pipeline = '{p}') AS {p}_answer" for p in PIPELINES) + " FROM sc JOIN results USING (run_id, qid) GROUP BY qid")
def j23_question_table(spark, d):
    """Runs side by side, a row a question."""
    return evaluation.question_table(fixture_scores(spark, d), fixture_results(spark, d), PIPELINES)


@query(f"WITH {_RUNS}, {_RUN_ROWS}, n AS (SELECT run_id, count(*) AS c FROM results GROUP BY 1) SELECT runs.*, coalesce(c, 0) AS n_results, row_number() OVER (ORDER BY coalesce(finished_at, started_at) DESC NULLS LAST, runs.run_id) AS rank FROM runs LEFT JOIN n USING (run_id)")
def a20_run_list(spark, d):
    """Runs with their counts of results, newest first."""
    return evaluation.run_list(fixture_runs(spark), fixture_results(spark, d)).withColumn("rank", F.col("rank").cast("bigint"))


@query(f"WITH {_RUNS}, {_RUN_ROWS}, n AS (SELECT DISTINCT run_id FROM results), k AS (SELECT pipeline, run_id, row_number() OVER (PARTITION BY pipeline ORDER BY (split = 'test') DESC, coalesce(finished_at, started_at) DESC NULLS LAST, run_id) AS r FROM runs JOIN n USING (run_id)) SELECT pipeline, run_id FROM k WHERE r = 1")
def w20_default_runs(spark, d):
    """The newest run with results of every pipeline."""
    return evaluation.default_runs(evaluation.run_list(fixture_runs(spark), fixture_results(spark, d)), "test")


@query(f"""WITH {_RUNS}, {_RUN_ROWS}, k AS (SELECT regexp_replace(lower(trim(regexp_replace(question, '\\s+', ' ', 'g'))), '[?.! ]+$', '') AS question_key, r.pipeline, r.run_id, r.answer_short, row_number() OVER (PARTITION BY question_key, r.pipeline ORDER BY started_at, r.run_id, r.qid, answer_short NULLS FIRST) AS n FROM results r JOIN runs USING (run_id) JOIN qs USING (qid) WHERE status <> 'error')
  SELECT question_key, pipeline, run_id, answer_short FROM k WHERE n = 1""")
def a17_cached_answers(spark, d):
    """First answer without error by question and pipeline."""
    return evaluation.cached_answers(fixture_results(spark, d), fixture_runs(spark), question_rows(spark, d))


@query(f"WITH {_RUNS}, o AS (SELECT run_id, avg(correct) AS c, quantile_cont(latency_ms, 0.5) AS l FROM sc GROUP BY 1) SELECT o.run_id, round(o.c / nullif(b.c, 0), 6) AS accuracy_ratio, round(o.l / nullif(b.l, 0), 6) AS latency_ratio FROM o, o b WHERE b.run_id = 'rag-run'")
def a33_takeaways(spark, d):
    """Ratios to a baseline run."""
    t = evaluation.takeaways(evaluation.summarize(fixture_scores(spark, d)), "rag-run")
    return t.withColumns({c: F.round(c, 6) for c in ("accuracy_ratio", "latency_ratio")})


@query(f"WITH {_RUNS} SELECT run_id, qid, failure_label FROM sc WHERE correct < 1 AND category = 'numerical' AND failure_label IN ('arithmetic_error', 'hallucination')")
def a32_failure_rows(spark, d):
    """Failures of a category by label."""
    return fixture_scores(spark, d).where("correct < 1 and category = 'numerical' and failure_label in ('arithmetic_error', 'hallucination')").select("run_id", "qid", "failure_label")


@query("""SELECT CAST(user_id AS VARCHAR) AS request_id, CAST(sum(floor(value)) AS BIGINT) AS tokens_in, CAST(sum(CAST(props->>'$.k' AS BIGINT)) AS BIGINT) AS tokens_out, round(sum(value), 4) AS cost_usd, count(*) FILTER (event_type = 'click' OR (event_type = 'view' AND floor(value) > 0)) AS llm_calls, count(*) FILTER (event_type = 'error') AS tool_calls FROM events GROUP BY user_id""")
def a21_usage_by_request(spark, d):
    """Usage of each request, events read as steps."""
    e = table(spark, d, "events")
    kind = F.when(F.col("event_type") == "click", "llm").when(F.col("event_type") == "view", "verify").when(F.col("event_type") == "error", "tool").otherwise(F.col("event_type"))
    u = evaluation.usage_by_request(e.select(F.col("user_id").cast("string").alias("request_id"), kind.alias("kind"), F.floor("value").alias("tokens_in"), F.get_json_object("props", "$.k").cast("bigint").alias("tokens_out"), F.col("value").alias("cost_usd")))
    return u.withColumn("cost_usd", F.round("cost_usd", 4))


@query(f"SELECT qid, {_CRORE.format('gold_answer', 'x')} AS crore FROM (SELECT qid, gold_answer, TRY_CAST(replace(regexp_extract(gold_answer, '([0-9][0-9,]*(?:\\.[0-9]+)?)', 1), ',', '') AS DOUBLE) AS x FROM questions)")
def x17_number_in_crore(spark, d):
    """X17, X15."""
    return table(spark, d, "questions").select("qid", answers.number_in_crore(F.col("gold_answer")).alias("crore"))


# scalar functions ---------------------------------------------------------------------------------------------------

@query("""SELECT mention_id, regexp_extract(norm_name, '[^ ]*$') AS surname, array_to_string(list_transform(list_filter(string_split(norm_name, ' '), lambda x: x <> ''), lambda x: x[1]), '') AS initials,
  left(sha256(norm_name), 16) AS h, greatest(1, length(raw_name) // 4) AS tokens FROM mentions WHERE norm_name IS NOT NULL""")
def x6_name_keys(spark, d):
    """X3, X6, X44."""
    m = table(spark, d, "mentions").where("norm_name is not null")
    return m.select("mention_id", X.surname_key(F.col("norm_name")).alias("surname"), X.initials(F.col("norm_name")).alias("initials"), X.short_hash(F.col("norm_name")).alias("h"), X.estimate_tokens(F.col("raw_name")).alias("tokens"))


@query("""SELECT qid, regexp_replace(lower(trim(regexp_replace(question, '\\s+', ' ', 'g'))), '[?.! ]+$', '') AS k, list_filter(list_transform(regexp_split_to_array(gold_answer, '[;\\n]'), lambda x: trim(x)), lambda x: x <> '') AS parts,
  CASE WHEN length(question) <= 40 THEN question ELSE rtrim(left(question, 40)) || ' [cut]' END AS capped FROM questions""")
def x39_question_text(spark, d):
    """X20, X39, X45, F17."""
    q = table(spark, d, "questions")
    return q.select("qid", X.question_key(F.col("question")).alias("k"), X.split_list(F.col("gold_answer")).alias("parts"), X.cap_text(F.col("question"), 10).alias("capped"))


@query("""SELECT DISTINCT fiscal_year, CASE WHEN regexp_full_match(fiscal_year, 'FY[0-9]{4}-[0-9]{2}') THEN make_date(CAST(substr(fiscal_year, 3, 4) AS INT) + 1, 3, 31) END AS ends FROM chunks""")
def x24_fiscal_year_end(spark, d):
    """X24."""
    return table(spark, d, "chunks").select("fiscal_year", X.fiscal_year_end(F.col("fiscal_year")).alias("ends")).distinct()


# logs ---------------------------------------------------------------------------------------------------------------

@query("SELECT date_trunc('day', ts) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def t1_windowed_usage(spark, d):
    """The batch form of the streaming aggregate."""
    return windowed_usage(table(spark, d, "events")).withColumn("total", F.round("total", 4))


@query("SELECT event_id, user_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), 4) AS spent FROM events")
def a22_running_spend(spark, d):
    """Running spend of each user."""
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    return table(spark, d, "events").select("event_id", "user_id", F.round(F.sum("value").over(w), 4).alias("spent"))


@query("SELECT event_id, CAST(props->>'$.k' AS INT) AS k FROM events")
def x42_json_access(spark, d):
    """X42."""
    return table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("int").alias("k"))

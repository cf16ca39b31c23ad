"""Readers with declared schemas: JSON lines, CSV, binary files and names of inbox files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

QUESTION = "qid string, version string, question string, category string, answer_type string, gold_answer string, gold_unit string, gold_evidence array<struct<doc_id:string,page:int>>, split string, verified boolean, verification_note string"
CHUNK = "chunk_id string, doc_id string, company_id string, fiscal_year string, section string, page_start int, page_end int, text string, token_count int"
PARSED = "doc_id string, pages array<struct<page_no:int,text:string,cleaned_text:string,is_probable_scan:boolean>>, tables array<struct<page_no:int,table_idx:int,cells:array<struct<row:int,col:int,text:string>>>>"
#: Named parts of an inbox file's name: COMPANY_doctype_FY2023-24.pdf; the year may be missing.
INBOX_NAME = r"^([A-Z0-9]+)_([a-z_]+?)(?:_(FY\d{4}-\d{2}))?\.pdf$"


def read_json_lines(spark: SparkSession, path: str, schema: str, tolerant: bool = False) -> DataFrame:
    """Typed JSON lines; tolerant leaves out lines that are no JSON, otherwise they fail."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED" if tolerant else "FAILFAST").json(path)


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("header", True).csv(path)


def read_parsed_pages(spark: SparkSession, path: str) -> DataFrame:
    """One row a page of parsed documents in JSON."""
    return spark.read.schema(PARSED).option("multiLine", True).json(path).select("doc_id", F.explode("pages").alias("p")).select("doc_id", "p.*")


def read_inbox(spark: SparkSession, path: str) -> DataFrame:
    """doc_id (sha256 of the bytes), company_id, doc_type, fiscal_year of PDF files; order files have no company."""
    f = spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").load(path).where(F.col("content").startswith(F.lit(b"%PDF")))
    name = F.element_at(F.split("path", "/"), -1)
    part = lambda i: F.nullif(F.regexp_extract(name, INBOX_NAME, i), F.lit(""))
    return f.select(F.sha2("content", 256).alias("doc_id"), F.when(part(2) != "regulatory_order", part(1)).alias("company_id"), part(2).alias("doc_type"), part(3).alias("fiscal_year"), name.alias("file_name")).dropDuplicates(["doc_id"])


def read_chunks(spark: SparkSession, path: str, doc_ids: list[str] | None = None) -> DataFrame:
    """Chunks stored as Parquet by doc_id; doc_ids prunes to their folders, unknown ones give no rows."""
    c = spark.read.schema(CHUNK).parquet(path)
    return c if doc_ids is None else c.where(F.col("doc_id").isin(*doc_ids))


def read_table_cells(spark: SparkSession, path: str) -> DataFrame:
    """One row a table cell of parsed documents in JSON: doc_id, page_no, table_idx, row, col, text."""
    t = spark.read.schema(PARSED).option("multiLine", True).json(path).select("doc_id", F.explode("tables").alias("t"))
    return t.select("doc_id", "t.page_no", "t.table_idx", F.explode("t.cells").alias("c")).select("doc_id", "page_no", "table_idx", "c.*")


def read_pdf_pages(spark: SparkSession, path: str, parse) -> DataFrame:
    """(doc_id, page_no, text) of PDF files by an injected parser: bytes -> [text of page 1, ...]; one file is one row."""
    @F.pandas_udf("array<string>")
    def run(s):
        return s.map(lambda b: parse(bytes(b)))

    f = spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").load(path).where(F.col("content").startswith(F.lit(b"%PDF")))
    return f.select(F.sha2("content", 256).alias("doc_id"), F.posexplode(run("content")).alias("p", "text")).select("doc_id", (F.col("p") + 1).alias("page_no"), "text")


def read_scores(spark: SparkSession, runs_dir: str, run_id: str, schema: str) -> DataFrame:
    """Scores of one run; FileNotFoundError if there are none."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{runs_dir}/{run_id}/scores.jsonl")
    if not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
        raise FileNotFoundError(f"no scores for run {run_id!r} in {runs_dir}")
    return read_json_lines(spark, path.toString(), schema).withColumn("run_id", F.lit(run_id))


def read_results(spark: SparkSession, path: str, schema: str, key: str = "qid") -> DataFrame:
    """Appended JSON lines, the last line of each key: by file and place in it."""
    line = spark.read.text(path).where("value <> ''").select("value", F.struct("_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id().alias("n")).alias("at"))
    return line.select(F.from_json("value", schema).alias("r"), "at").groupBy(F.col(f"r.{key}").alias("k")).agg(F.max_by("r", "at").alias("r")).select("r.*")


def read_dimension(spark: SparkSession, path: str, key: str, schema: str) -> DataFrame:
    """A small list of a YAML file's key as a table, read on the driver."""
    import yaml

    with open(path, encoding="utf-8") as f:
        rows = (yaml.safe_load(f) or {}).get(key) or []
    return spark.createDataFrame(rows, schema)


def fetch_targets(companies: DataFrame, doc_types: list[str], years: list[str]) -> DataFrame:
    """(company_id, doc_type, fiscal_year): every document to look for; two short lists beside each company."""
    lists = F.array(*map(F.lit, doc_types)), F.array(*map(F.lit, years))
    return companies.select("company_id", F.explode(lists[0]).alias("doc_type")).withColumn("fiscal_year", F.explode(lists[1]))

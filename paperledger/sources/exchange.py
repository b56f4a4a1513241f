"""Reading OCR output, model answers and exchange messages, and writing messages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..cluster import materialize

STORE_SCHEMAS = {
    "documents": "id string, owner_id string, company_id string, original_name string, content_type string, size_bytes bigint, storage_key string, sha256 string, status string, recognition string, ocr_text string, error string, onec_status string, onec_ref string, onec_message string, onec_updated_at timestamp, approved_by string, approved_at timestamp, approval_note string, archived_at timestamp, created_at timestamp, updated_at timestamp",
    "companies": "id string, name string, unp string, folder string, approval_required boolean, is_active boolean, created_at timestamp, updated_at timestamp",
    "users": "id string, login string, role string, is_active boolean, company_id string, created_at timestamp",
    "company_accountants": "company_id string, user_id string, assigned_at timestamp",
    "counterparties": "id string, company_id string, unp string, name string, synonyms array<string>, source string, created_at timestamp, updated_at timestamp",
    "export_jobs": "id string, document_id string, kind string, status string, attempts int, last_error string, next_attempt_at timestamp, created_at timestamp, updated_at timestamp",
    "audit_log": "id bigint, actor_id string, action string, entity string, entity_id string, meta string, created_at timestamp",
    "device_tokens": "id string, user_id string, platform string, token string, created_at timestamp, updated_at timestamp",
}

RECOGNITION = "doc_type string, doc_type_confidence double, fields map<string, struct<value: string, confidence: double, source: string>>, lines array<struct<name: string, qty: string, unit: string, price: string, amount: string, amount_no_vat: string, vat: string, account: string>>, missing array<string>, rejected array<string>, auto_pass boolean, _corrupt_record string"


def read_store(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """S1. The store's tables from Parquet, with their schemas."""
    return {name: spark.read.schema(schema).parquet(f"{path.rstrip('/')}/{name}") for name, schema in STORE_SCHEMAS.items()}


def parse_recognition(documents: DataFrame, column: str = "recognition") -> DataFrame:
    """S2. Adds rec and bad_json: JSON that can't be read is marked, not dropped."""
    rec = F.from_json(column, RECOGNITION, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"})
    return documents.withColumn("rec", rec).withColumn("bad_json", F.col("rec._corrupt_record").isNotNull())


def fields_from_recognition(parsed: DataFrame, key: str = "doc_id") -> DataFrame:
    """S3. doc_id, key, value, confidence, source."""
    return parsed.select(F.col(key).alias("doc_id"), F.explode(F.map_entries("rec.fields")).alias("f")).select("doc_id", F.col("f.key").alias("key"), "f.value.*")


def _doc_of(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]+?)(?:-words)?\.[A-Za-z0-9]+$", 1)


def read_words_tsv(spark: SparkSession, path: str) -> DataFrame:
    """S4. doc_id (from the file's name), x0, y0, x1, y1, text; a header line and lines without four
    numbers are left out. Only the first four tabs separate, so a text may hold others."""
    rows = spark.read.text(path).select(_doc_of(F.col("_metadata.file_path")).alias("doc_id"), F.split("value", "\t", 5).alias("p"))
    box = [F.get("p", F.lit(k)).try_cast("double").alias(c) for k, c in enumerate(("x0", "y0", "x1", "y1"))]
    return rows.select("doc_id", *box, F.get("p", F.lit(4)).alias("text")).where("x0 is not null and y0 is not null and x1 is not null and y1 is not null and text is not null")


def read_ocr_tsv(spark: SparkSession, path: str) -> DataFrame:
    """S5. Words of 12-column OCR output: without the header, blank texts, negative confidence, and
    boxes that aren't numbers."""
    rows = spark.read.text(path).select(_doc_of(F.col("_metadata.file_path")).alias("doc_id"), F.split("value", "\t").alias("p")).where(F.size("p") >= 12)
    number = lambda k: F.get("p", F.lit(k)).try_cast("double")
    rows = rows.select("doc_id", number(1).cast("int").alias("page_no"), number(6).alias("x0"), number(7).alias("y0"), (number(6) + number(8)).alias("x1"), (number(7) + number(9)).alias("y1"), number(10).alias("conf"), F.trim(F.get("p", F.lit(11))).alias("text"))
    return rows.where("x0 is not null and y0 is not null and x1 is not null and y1 is not null and conf >= 0 and text <> ''").drop("conf")


def parse_model_answer(answers: DataFrame, column: str = "answer", key: str = "doc_id") -> DataFrame:
    """S10. doc_id, key, value of stored model answers: fields under "fields" or flat; numbers and
    strings are values, nested ones and null are blank."""
    whole = F.try_parse_json(F.col(column))
    flat = F.from_json(F.when(whole.isNotNull(), F.col(column)), "map<string, string>")
    nested = F.from_json(F.element_at(flat, "fields"), "map<string, string>")
    rows = answers.select(F.col(key).alias("doc_id"), F.explode(F.map_entries(F.coalesce(nested, flat))).alias("f")).select("doc_id", F.lower("f.key").alias("key"), F.col("f.value").alias("raw"))
    value = F.when(F.col("raw").isNull() | F.col("raw").rlike(r"^\s*[\[{]"), "").otherwise(F.trim("raw"))
    return rows.where("key not in ('lines', 'table', 'fields')").select("doc_id", "key", value.alias("value"))


KNOWN_KEYS = ("number", "date", "total", "vat_amount", "amount_no_vat", "currency", "unp", "inn", "kpp", "counterparty", "organization", "organization_unp", "contract_number", "contract_date", "account_debit", "account_credit", "account_vat")


def extra_fields(fields: DataFrame) -> DataFrame:
    """S15. doc_id and extra: array<struct<_name, _VALUE>> of fields outside the known keys that fit a
    message, by key."""
    fit = ~F.col("key").isin(*KNOWN_KEYS) & (F.trim("value") != "") & ~F.col("key").rlike(r"[\s|]") & (F.length("key") <= 40) & ~F.col("value").rlike(r"[|\n]") & (F.length("value") <= 200)
    return fields.where(fit).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct(F.col("key").alias("_name"), F.col("value").alias("_VALUE")))).alias("extra"))


def build_payload(docs: DataFrame, fields: DataFrame, lines: DataFrame, kind: str) -> DataFrame:
    """S11. Messages as nested rows: doc_id, folder, kind and message. docs: doc_id, folder, doc_type,
    object, missing (comma-joined). One shuffle of each side by document."""
    wanted = ("number", "date", "total", "vat_amount", "currency", "unp", "counterparty")
    wide = fields.groupBy("doc_id").agg(*(F.max(F.when(F.col("key") == k, F.col("value"))).alias(k) for k in wanted))
    items = lines.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("line_no", "name", "qty", "unit", "price", "amount"))).alias("items"))
    rows = docs.join(wide, "doc_id", "left").join(items, "doc_id", "left").join(extra_fields(fields), "doc_id", "left")
    line = F.transform("items", lambda x: F.struct(*(x[c].alias(t) for c, t in (("name", "Name"), ("qty", "Quantity"), ("unit", "Unit"), ("price", "Price"), ("amount", "Amount")))))
    missing = F.filter(F.split(F.coalesce("missing", F.lit("")), ","), lambda x: x != "")
    message = F.struct(
        F.lit(kind).alias("_kind"), (F.size(missing) > 0).alias("_incomplete"), F.col("doc_id").cast("string").alias("SourceId"), F.col("doc_type").alias("Type"), F.struct(F.col("object").alias("_object"), F.lit(kind).alias("_kind")).alias("Target"),
        F.col("number").alias("Number"), F.col("date").alias("Date"), F.col("total").alias("Total"), F.col("vat_amount").alias("VATAmount"), F.col("currency").alias("Currency"), F.struct(F.col("counterparty").alias("Name"), F.col("unp").alias("UNP")).alias("Counterparty"),
        F.struct(line.alias("Line")).alias("Lines"), F.struct(missing.alias("Field")).alias("MissingFields"), F.struct(F.col("extra").alias("Field")).alias("AdditionalFields"),
    )
    return rows.select("doc_id", "folder", F.lit(kind).alias("kind"), message.alias("message"))


def to_messages(payload: DataFrame) -> DataFrame:
    """S13. doc_id, folder, kind, body (XML) and its sha256."""
    body = F.to_xml("message", {"rowTag": "Document"})
    return payload.select("doc_id", "folder", "kind", body.alias("body")).withColumn("sha256", F.sha2("body", 256))


def write_exchange_xml(payload: DataFrame, path: str) -> DataFrame:
    """S13. Appends messages below a folder for each company, some files for each instead of one for
    each document. A message that stands there already is left out; one of another body is a conflict,
    returned as (doc_id, kind) and not written. Repeating the call changes nothing."""
    new = to_messages(payload)
    try:
        there = payload.sparkSession.read.parquet(f"{path}/index").select("doc_id", "kind", F.col("sha256").alias("old"))
    except Exception as e:  # the first call finds no index
        if "PATH_NOT_FOUND" not in str(e):
            raise
        there = None
    if there is not None:
        new = new.join(there, ["doc_id", "kind"], "left")
        conflicts = new.where("old <> sha256").select("doc_id", "kind")
        new = new.where("old is null").drop("old")
    else:
        conflicts = new.where("false").select("doc_id", "kind")
    conflicts, new = materialize(conflicts, "xml-conflicts"), materialize(new, "xml-new")
    new.repartition("folder").select("folder", "body").write.mode("append").partitionBy("folder").text(f"{path}/messages")
    new.select("doc_id", "kind", "sha256").write.mode("append").parquet(f"{path}/index")
    return conflicts


def read_exchange_xml(spark: SparkSession, path: str) -> DataFrame:
    """S14. Messages below a folder, as nested rows."""
    return spark.read.format("xml").option("rowTag", "Document").option("recursiveFileLookup", "true").load(f"{path}/messages")


def table_markdown(cells: DataFrame) -> DataFrame:
    """S16. doc_id and md: a pipe table of cells (doc_id, row_no, col_no, title, value, is_total); columns
    without a title are named by number, totals come last."""
    clean = lambda c: F.regexp_replace(F.regexp_replace(F.coalesce(c, F.lit("")), r"\|", r"\\|"), r"[\r\n]+", " ")
    row = cells.groupBy("doc_id", "is_total", "row_no").agg(F.transform(F.array_sort(F.collect_list(F.struct("col_no", clean(F.col("value")).alias("v")))), lambda x: x["v"]).alias("v"))
    title = F.when(F.trim(F.coalesce("title", F.lit(""))) == "", F.concat(F.lit("гр."), (F.col("col_no") + 1).cast("string"))).otherwise(clean(F.col("title")))
    head = cells.groupBy("doc_id", "col_no").agg(F.min(title).alias("t")).groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("col_no", "t"))), lambda x: x["t"]).alias("h"))
    body = row.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("is_total", "row_no", "v"))), lambda x: x["v"]).alias("rows"))
    bar = lambda v: F.concat(F.lit("| "), F.array_join(v, " | "), F.lit(" |"))
    rule = bar(F.transform("h", lambda _: F.lit("---")))
    return head.join(body, "doc_id").select("doc_id", F.array_join(F.concat(F.array(bar(F.col("h")), rule), F.transform("rows", bar)), "\n").alias("md"))


OCR_RESPONSE = "text string, flat string, error string, boxes array<struct<text: string, bbox: array<double>>>, tables array<struct<cells: array<struct<row: int, col: int, rowspan: int, colspan: int, header: boolean, text: string>>>>, _corrupt_record string"


def read_ocr_json(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """S6. words (doc_id, page_no, seq, text, x0, y0, x1, y1), grid_cells (doc_id, grid_no, row, col, rowspan,
    colspan, header, text) and pages (doc_id, page_no, layout, flat, error) of an OCR service's responses, one
    file each, named ``<doc>.json`` or ``<doc>-p<page>.json`` (a file without a page is page 1).

    A blank flat text is the layout without its cells' bars. Files that are no response and responses
    with an error come as pages with that error, and have neither words nor cells. Blank words and boxes
    without four numbers drop out. Grids are numbered over a document's pages, in the pages' order.
    """
    raw = spark.read.text(path, wholetext=True).select("value", F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)\.json$", 1).alias("name"))
    page = F.regexp_extract("name", r"^(.*?)-p([0-9]+)$", 2).try_cast("int")
    doc = F.when(page.isNotNull(), F.regexp_extract("name", r"^(.*?)-p([0-9]+)$", 1)).otherwise(F.col("name"))
    r = F.from_json("value", OCR_RESPONSE, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"})
    rows = raw.select(doc.alias("doc_id"), F.coalesce(page, F.lit(1)).alias("page_no"), r.alias("r"))
    error = F.when(F.col("r._corrupt_record").isNotNull() | F.col("r").isNull(), F.lit("no response")).otherwise(F.nullif(F.col("r.error"), F.lit("")))
    rows = rows.withColumn("error", error)
    layout = F.when(F.col("error").isNull(), F.coalesce("r.text", F.lit("")))
    bare = F.regexp_replace(F.regexp_replace("r.text", r" \| ", " "), r"\|", " ")
    flat = F.when(F.col("error").isNull(), F.when(F.trim(F.coalesce("r.flat", F.lit(""))) != "", F.col("r.flat")).otherwise(F.coalesce(bare, F.lit(""))))
    pages = rows.select("doc_id", "page_no", layout.alias("layout"), flat.alias("flat"), "error")
    good = rows.where("error is null")
    words = good.select("doc_id", "page_no", F.posexplode("r.boxes").alias("seq", "b")).where(F.size("b.bbox") == 4)
    words = words.select("doc_id", "page_no", F.col("seq").cast("bigint").alias("seq"), "b.text", *(F.get("b.bbox", F.lit(k)).alias(c) for k, c in enumerate(("x0", "y0", "x1", "y1"))))
    words = words.where("trim(text) <> '' and x0 is not null and y0 is not null and x1 is not null and y1 is not null")
    before = F.sum(F.size(F.coalesce("r.tables", F.array().cast("array<struct<cells: array<struct<row: int, col: int, rowspan: int, colspan: int, header: boolean, text: string>>>>")))).over(Window.partitionBy("doc_id").orderBy("page_no").rowsBetween(Window.unboundedPreceding, -1))
    grids = good.withColumn("before", F.coalesce(before, F.lit(0))).select("doc_id", "before", F.posexplode("r.tables").alias("k", "t"))
    cells = grids.select("doc_id", (F.col("before") + F.col("k")).cast("int").alias("grid_no"), F.explode("t.cells").alias("c")).select("doc_id", "grid_no", "c.*")
    return words, cells, pages


def read_expected(spark: SparkSession, path: str) -> DataFrame:
    """S9. doc_id, key, value of golden files under ``path``: ``<doc>/expected.json``, else ``<doc>.json`` beside it,
    else the entry of the document's name in a shared ``expected.json`` at the top.

    A file has doc_type and fields ({key: {value}} or {key: value}), or all keys flat; nested values other
    than these are left out, and a null value is an expectation that there is none. Files that are no
    JSON object give no rows.
    """
    files = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json").text(path, wholetext=True).select("value", F.col("_metadata.file_path").alias("at"))
    top = F.lit(path.rstrip("/").rpartition("/")[2])
    parts = files.withColumn("name", F.regexp_extract("at", r"([^/]+)\.json$", 1)).withColumn("folder", F.regexp_extract("at", r"([^/]+)/[^/]+\.json$", 1)).withColumn("m", F.from_json("value", "map<string, string>"))
    is_shared = (F.col("name") == "expected") & (F.col("folder") == top)
    own = parts.where(~is_shared).select(F.when(F.col("name") == "expected", F.col("folder")).otherwise(F.col("name")).alias("doc_id"), F.when(F.col("name") == "expected", 0).otherwise(1).alias("rank"), "m")
    shared = parts.where(is_shared).select(F.explode("m").alias("name", "entry")).select(F.regexp_replace("name", r"\.[A-Za-z0-9]+$", "").alias("doc_id"), F.lit(2).alias("rank"), F.from_json("entry", "map<string, string>").alias("m"))
    best = own.unionByName(shared).where("m is not null").groupBy("doc_id").agg(F.min_by("m", "rank").alias("m"))
    fields = F.from_json(F.try_element_at("m", F.lit("fields")), "map<string, string>")
    flat = best.select("doc_id", F.explode(F.map_filter("m", lambda k, v: k != "fields")).alias("key", "raw"))
    rows = flat.unionByName(best.select("doc_id", F.explode(fields).alias("key", "raw")))
    nested = F.from_json("raw", "map<string, string>")
    rows = rows.withColumn("value", F.when(F.col("raw").rlike(r"^\s*\{"), F.try_element_at(nested, F.lit("value"))).otherwise(F.col("raw")))
    keep = F.col("raw").isNull() | ~F.col("raw").rlike(r"^\s*[\[{]") | F.array_contains(F.map_keys(nested), "value")
    return rows.where(keep).select("doc_id", "key", F.trim("value").alias("value"))

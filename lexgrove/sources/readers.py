"""Scans and sinks: JSON lines, documents, whole files, HTML blocks, office files, calendars, parameters."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexgrove.functions.text import fact_date, html_text
from lexgrove.operators.statute import OPENERS

DOCUMENT_KINDS = ("letter", "plenum", "review", "ruling", "constitutional", "appeal")
DOCUMENT = "doc_id string, kind string, agency string, number string, date date, title string, text string, source_url string, mandatory boolean, retrieved_at string, sha256 string, status string, category string, tags array<string>"
UNIT = "unit_id string, act string, kind string, parent_unit_id string, number string, title string, label string, context string, is_chunk boolean, text string, full_text string, text_hash string, paragraphs array<string>, edit_note string, duplicate_of string, inferred boolean"
POSITION = "position_id string, doc_id string, unit_id string, stance string, summary string, quote string, confidence double, extracted_by string, model string, verified boolean, verified_by string, created_at string"
PARAMETER = "name string, title string, value double, unit string, source_unit_id string, anchor string, valid_from date, valid_to date, valid_from_source string, conditions map<string,string>, region string, tax string, status string"
#: Where a heading starts a block of its own.
MARK = rf"^(?:{'|'.join(OPENERS)})\s"


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One object per line; blank lines give no row, unknown keys are dropped, missing ones are NULL."""
    return spark.read.schema(schema).json(path)


def write_json_lines(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).option("ignoreNullFields", "false").json(path)


def units(spark: SparkSession, folder: str, skip_act: str | None = None) -> DataFrame:
    """Unit records of every act in a folder, but one."""
    rows = spark.read.schema(UNIT).option("pathGlobFilter", "*_units.jsonl").json(folder)
    return rows if skip_act is None else rows.where(F.col("act") != skip_act)


def documents(spark: SparkSession, folder: str) -> DataFrame:
    """Interpretation documents of all files but those of positions; a row of an unknown kind fails the read, a
    missing hash is computed."""
    rows = spark.read.schema(DOCUMENT).option("pathGlobFilter", "*.jsonl").json(folder).where(~F.col("_metadata.file_name").startswith("positions"))
    known = F.col("kind").isin(*DOCUMENT_KINDS)
    checked = F.when(known, F.col("kind")).otherwise(F.raise_error(F.concat(F.lit("unknown document kind: "), F.coalesce("kind", F.lit("NULL")))))
    return rows.withColumn("kind", checked).withColumn("sha256", F.coalesce("sha256", F.sha2("text", 256)))


def whole_texts(spark: SparkSession, path: str) -> DataFrame:
    """path, text, sha256 of whole files."""
    return spark.read.format("binaryFile").load(path).select("path", F.decode("content", "UTF-8").alias("text"), F.sha2("content", 256).alias("sha256"))


def missing(rows: DataFrame, target: DataFrame, keys: list[str]) -> DataFrame:
    """What an incremental load still has to do."""
    return rows.join(target.select(*keys), keys, "left_anti")


def parameters(spark: SparkSession, path: str, known_units: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows whose source unit is known, rows that were skipped) of a JSON file with a list ``parameters``."""
    rows = spark.read.option("multiLine", "true").schema(f"parameters array<struct<{PARAMETER.replace(' ', ':').replace(',:', ',')}>>").json(path).select(F.explode("parameters").alias("p")).select("p.*")
    key = known_units.select(F.col("unit_id").alias("source_unit_id")).distinct()
    return rows.join(key, "source_unit_id", "left_semi"), rows.join(key, "source_unit_id", "left_anti")


def load_parameters(old: DataFrame, new: DataFrame) -> DataFrame:
    """A full reload of federal rows; regional rows of old stay."""
    return old.where("region is not null").unionByName(new)


def load_regional(old: DataFrame, new: DataFrame) -> DataFrame:
    """Regional rows are replaced by (name, region, valid_from)."""
    keys = ["name", "region", "valid_from"]
    on = [F.col(f"o.{k}").eqNullSafe(F.col(f"n.{k}")) for k in keys]
    return old.alias("o").join(new.select(*keys).alias("n"), on, "left_anti").unionByName(new)


def calendar_overrides(spark: SparkSession, folder: str) -> DataFrame:
    """day, working, year of <year>.json files; a file that is not JSON gives nothing."""
    rows = spark.read.option("multiLine", "true").option("mode", "DROPMALFORMED").schema("holidays array<date>, workdays array<date>").option("pathGlobFilter", "[0-9][0-9][0-9][0-9].json").json(folder)
    rows = rows.withColumn("year", F.regexp_extract(F.input_file_name(), r"(\d{4})\.json$", 1).cast("int"))
    off = rows.select("year", F.explode("holidays").alias("day"), F.lit(False).alias("working"))
    return off.unionByName(rows.select("year", F.explode("workdays").alias("day"), F.lit(True).alias("working")))


def html_blocks(pages: DataFrame, key: str, html: str = "html") -> DataFrame:
    """key, n, block, centred of each paragraph of pages(key, html) that says something.

    A paragraph reaches from its tag to the next opening or closing one; it is centred where an attribute says so.
    """
    paragraph = r"(?is)(<p(?:\s[^>]*)?>.*?)(?=</?p[\s>]|$)"
    found = F.regexp_extract_all(F.coalesce(F.col(html).cast("string"), F.lit("")), F.lit(paragraph), F.lit(1))
    head = lambda p: F.substring_index(p, ">", 1)
    flat = lambda p: F.trim(F.regexp_replace(html_text(F.substring(p, F.length(head(p)) + 2, F.length(p))), r"[\s\u00A0]+", " "))
    told = F.filter(F.transform(found, lambda p: F.struct(flat(p).alias("block"), F.lower(head(p)).contains("center").alias("centred"))), lambda b: b["block"] != "")
    return pages.select(key, F.posexplode(told).alias("n", "__b")).select(key, "n", "__b.block", "__b.centred")


def statute_blocks(blocks: DataFrame, key: str) -> DataFrame:
    """Blocks of the legal bank joined: neighbouring centred ones unless they open a unit, and notes '<..' up to '..>'."""
    order = W.partitionBy(key).orderBy("n")
    opened = F.sum(F.when(F.col("block").startswith("<"), 1).otherwise(0)).over(order)
    closed = F.coalesce(F.sum(F.when(F.col("block").endswith(">"), 1).otherwise(0)).over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    row = blocks.withColumn("__inside", (opened > closed) & ~F.col("block").startswith("<")).withColumn("__before", F.lag("centred").over(order))
    joins = F.col("__inside") | (F.col("centred") & F.coalesce("__before", F.lit(False)) & ~F.col("block").rlike(MARK))
    row = row.withColumn("__b", F.sum((~joins).cast("int")).over(order))
    listed = row.groupBy(key, "__b").agg(F.sort_array(F.collect_list(F.struct("n", "block"))).alias("l"))
    return listed.select(key, F.col("__b").alias("n"), F.array_join(F.transform("l", lambda x: x["block"]), " ").alias("block"))


def convert(format_: Column, content: Column) -> Column:
    """HTML becomes text, other formats pass."""
    return F.when(F.lower(format_).isin("html", "htm"), html_text(content)).otherwise(content)


def docx_text(data: bytes) -> str:
    """Paragraphs of a word file, blank ones dropped."""
    ns = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        root = ElementTree.fromstring(z.read("word/document.xml"))
    found = ("".join(t.text or "" for t in p.iter(f"{ns}t")) for p in root.iter(f"{ns}p"))
    return "\n\n".join(p for p in found if p.strip())


def pdf_text(data: bytes) -> str:
    """Pages of a PDF, each under its number; needs the optional package pypdf."""
    from pypdf import PdfReader

    pages = [(p.extract_text() or "").strip() for p in PdfReader(io.BytesIO(data)).pages]
    return "\n\n".join(f"[page {i}]\n{t or '(no text layer)'}" for i, t in enumerate(pages, 1))


def xlsx_text(data: bytes, rows: int = 500) -> str:
    """Sheets as Markdown rows, empty rows dropped; of a longer sheet ``rows`` rows and a line with the number of the others.
    Needs the optional package openpyxl."""
    from openpyxl import load_workbook

    out = []
    for sheet in load_workbook(io.BytesIO(data), read_only=True, data_only=True):
        kept = [r for r in sheet.iter_rows(values_only=True) if any(v is not None for v in r)]
        out.append("\n".join([f"## {sheet.title}", *("| " + " | ".join("" if v is None else str(v) for v in r) + " |" for r in kept[:rows]), *([f"({len(kept) - rows} more rows)"] if len(kept) > rows else [])]))
    return "\n\n".join(out)


def file_texts(spark: SparkSession, path: str) -> DataFrame:
    """path, text, error of files by extension: md, txt, csv, json as they are; html, docx, pdf, xlsx by their readers."""

    def read(name: str, data: bytes) -> str:
        kind = name.rsplit(".", 1)[-1].lower()
        if kind in ("md", "txt", "csv", "json", "html", "htm"):
            return data.decode("utf-8-sig")
        reader = {"docx": docx_text, "pdf": pdf_text, "xlsx": xlsx_text}.get(kind)
        if reader is None:
            raise ValueError(f"unsupported format .{kind}")
        return reader(data)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, errors = [], []
            for name, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                try:
                    texts.append(read(name, data))
                    errors.append(None)
                except Exception as e:  # a file that cannot be read is a row, not a failure of the job
                    texts.append(None)
                    errors.append(str(e))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string()), pa.array(errors, pa.string())], names=["path", "text", "error"])

    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content").mapInArrow(run, "path string, text string, error string")
    return raw.withColumn("text", F.when(F.col("path").rlike(r"(?i)\.html?$"), html_text("text")).otherwise(F.col("text")))


def letter_listing(pages: DataFrame, key: str, html: str = "html") -> DataFrame:
    """key, link, number, date, title of the items of stored listing pages; each item is a link whose text names number and date."""
    item = F.explode(F.regexp_extract_all(html, F.lit(r"(?is)(<a\s[^>]*href=[^>]*>.*?</a>)"), F.lit(1)))
    rows = pages.select(key, item.alias("a"))
    title = html_text("a")
    return rows.select(
        key, F.regexp_extract("a", r"""(?i)href=["']?([^"'\s>]+)""", 1).alias("link"), F.regexp_extract(title, r"(?:№|N)\s*([\p{L}\d@/.-]+)", 1).alias("number"), fact_date(title).alias("date"), title.alias("title"),
    ).where("number <> '' and date is not null")


def court_act(blocks: DataFrame, key: str) -> DataFrame:
    """key, text: blocks after the one that says 'постановляет' up to the signature; acts of three blocks or fewer are left out."""
    first = F.min(F.when(F.lower("block").rlike(r"постановля\p{L}+\s*:?\s*$|дать следующие разъяснения"), F.col("n"))).over(W.partitionBy(key))
    last = F.min(F.when(F.col("block").rlike(r"(?iu)^(председатель|секретарь пленума|судья)"), F.col("n"))).over(W.partitionBy(key))
    body = blocks.withColumn("__f", first).withColumn("__l", last).where((F.col("n") > F.col("__f")) & (F.col("__l").isNull() | (F.col("n") < F.col("__l")) | (F.col("__l") < F.col("__f"))))
    text = body.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("n", "block"))).alias("l")).where("size(l) > 3")
    return text.select(key, F.array_join(F.transform("l", lambda x: x["block"]), "\n\n").alias("text"))


def edition_day(label: Column) -> Column:
    """The date in the label of an edition."""
    return fact_date(label)


def save_vectors(vectors: DataFrame, known_units: DataFrame, path: str, model: str) -> None:
    """Vectors of known units as the model's partition; other models' partitions stay."""
    rows = vectors.join(known_units.select("unit_id").distinct(), "unit_id", "left_semi").withColumn("model", F.lit(model))
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("model").parquet(path)


def graph_json(weights: DataFrame) -> DataFrame:
    """One JSON object per edge."""
    return weights.select(F.to_json(F.struct("src", "dst", "weight")).alias("value"))


def letter_page(pages: DataFrame, key: str, html: str = "html") -> DataFrame:
    """key, text, question, tags, category of stored letter pages: the question is what stands before the answer's
    heading, tags are links to a tag list, the category is the last crumb."""
    text = html_text(F.regexp_replace(html, r"(?is)<(?:nav|header|footer)\b.*?</(?:nav|header|footer)>", ""))
    tags = F.regexp_extract_all(html, F.lit(r"(?is)<a\s[^>]*href=[^>]*tag[^>]*>\s*([^<]+?)\s*</a>"), F.lit(1))
    crumbs = F.regexp_extract_all(html, F.lit(r"(?is)class=[\"'][^\"']*crumb[^\"']*[\"'][^>]*>\s*(?:<a[^>]*>)?\s*([^<]+?)\s*<"), F.lit(1))
    return pages.select(key, text.alias("text"), F.trim(F.regexp_extract(text, r"(?su)^(.*?)\n(?:Ответ|ОТВЕТ)\b", 1)).alias("question"), F.array_distinct(tags).alias("tags"), F.when(F.size(crumbs) > 0, F.element_at(crumbs, -1)).alias("category"))


def ministry_page(pages: DataFrame, key: str, html: str = "html", attachment: str | None = None, least: int = 200) -> DataFrame:
    """key, number, date, title, text of stored ministry pages, in either title layout ("от DATE № N" or "№ N от DATE");
    the text comes from the page, else from the attached word file's text; shorter than ``least`` gives no row."""
    title = html_text(F.regexp_extract(html, r"(?is)<h1[^>]*>(.*?)</h1>", 1))
    own = html_text(F.regexp_extract(html, r"(?is)<article[^>]*>(.*)</article>", 1))
    text = own if attachment is None else F.when(F.length(own) >= least, own).otherwise(F.coalesce(attachment, own))
    rows = pages.select(key, F.regexp_extract(title, r"(?:№|N)\s*([\p{L}\d@/.-]*[\p{L}\d@])", 1).alias("number"), fact_date(title).alias("date"), title.alias("title"), text.alias("text"))
    return rows.where((F.col("number") != "") & F.col("date").isNotNull() & (F.length("text") >= least))

"""Spreadsheet sources and sinks. A workbook is a zip of XML, read with the standard library inside a task.

Files come through Spark's binaryFile source, so any path that Spark reads will do. Limits hold before anything is unpacked.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import numbers as N
from ..functions import text as T
from ..functions import url as U

MAX_BYTES, MAX_ROWS, MAX_COLUMNS, MAX_RATIO = 25 << 20, 50_000, 27, 200
#: Header, then column name, in the workbook's order. Fixed values.
COMPANY_SHEET = {
    "Company ID": "id", "Company Name": "name", "Industry": "industry", "Company Description": "company_description", "City": "city", "State": "state", "Country": "country", "Known Website": "known_website",
    "Official Website": "official_website", "Website Discovery Method": "website_discovery_method", "Website Candidate URLs": "website_candidate_urls", "Website Verification Notes": "website_verification_notes",
    "Website Verified": "website_verified", "Careers Page URL": "careers_page_url", "Job Board URL": "job_board_url", "Job Board Discovery Method": "job_board_discovery_method", "Jobs RSS Feed URL": "jobs_rss_feed_url",
    "Job Platform": "job_platform", "Feed Found": "feed_found", "Search Status": "search_status", "Confidence": "confidence", "Last Checked": "last_checked", "Notes": "notes", "Founded Year": "founded_year",
    "Total Assets": "total_assets", "Assets As Of Date": "assets_as_of_date", "Company Information Last Checked": "company_info_last_checked",
}
INTAKE = ("Company Name", "City", "State", "Known Website", "Notes")
DEFAULTS = {"industry": "Financial Services", "country": "United States", "job_board_discovery_method": "Not Found", "search_status": "Needs Review"}
_NS = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"


def check_archive(content: bytes) -> None:
    if len(content) > MAX_BYTES:
        raise ValueError("the workbook is larger than 25 MiB")
    if not content.startswith(b"PK\x03\x04"):
        raise ValueError("the content is no workbook")
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        packed, full = (sum(getattr(i, a) for i in z.infolist()) for a in ("compress_size", "file_size"))
        if full > MAX_RATIO * max(1, packed) or full > 8 * MAX_BYTES:
            raise ValueError("the workbook unpacks to far more than it holds")


def sheet_rows(content: bytes, sheet: int = 1) -> list[list[str]]:
    """Cell values of a sheet as stripped strings; ragged rows and gaps are filled with ''."""
    check_archive(content)
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        names = z.namelist()
        shared: list[str] = []
        if "xl/sharedStrings.xml" in names:
            shared = ["".join(t.text or "" for t in s.iter(f"{_NS}t")) for s in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).iter(f"{_NS}si")]
        sheets = sorted((n for n in names if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)), key=lambda n: int(re.search(r"\d+", n)[0]))
        root = ElementTree.fromstring(z.read(sheets[sheet - 1]))
    out: list[list[str]] = []
    for row in root.iter(f"{_NS}row"):
        if len(out) > MAX_ROWS:
            raise ValueError(f"the sheet has more than {MAX_ROWS} rows")
        cells: dict[int, str] = {}
        for k, c in enumerate(row.iter(f"{_NS}c")):
            letters = re.match("[A-Z]+", c.get("r", ""))
            at = k
            if letters:
                at = 0
                for ch in letters[0]:
                    at = at * 26 + ord(ch) - 64
                at -= 1
            if at >= MAX_COLUMNS:
                continue
            v, kind = c.find(f"{_NS}v"), c.get("t")
            if kind == "inlineStr":
                cells[at] = "".join(t.text or "" for t in c.iter(f"{_NS}t"))
            elif v is not None and v.text is not None:
                cells[at] = shared[int(v.text)] if kind == "s" else {"1": "True", "0": "False"}.get(v.text, v.text) if kind == "b" else v.text
        out.append([cells.get(k, "").strip() for k in range(max(cells, default=-1) + 1)])
    return out


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        paths, numbers, maps = [], [], []
        for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist()):
            rows = sheet_rows(content)
            head = rows[0] if rows else []
            for k, row in enumerate(rows[1:], 1):
                paths.append(path)
                numbers.append(k)
                maps.append([(h, row[i] if i < len(row) else "") for i, h in enumerate(head) if h])
        yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(numbers, pa.int64()), pa.array(maps, pa.map_(pa.string(), pa.string()))], ["path", "row", "cells"])


def read_workbook(spark: SparkSession, path: str) -> DataFrame:
    """(path, row, cells: header -> text) of every workbook below path."""
    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(_records, "path string, row bigint, cells map<string,string>")


def _cell(header: str) -> Column:
    return F.coalesce(F.try_element_at("cells", F.lit(header)), F.lit(""))


def read_intake(spark: SparkSession, path: str) -> DataFrame:
    """The five intake columns; rows without a company name are left out; a workbook without that header is an error."""
    rows = read_workbook(spark, path)
    named = rows.withColumn("cells", F.when(F.map_contains_key("cells", "Company Name"), F.col("cells")).otherwise(F.raise_error(F.lit("the workbook has no 'Company Name' column"))))
    return named.select("row", *(_cell(h).alias(h) for h in INTAKE)).where("`Company Name` <> ''")


def read_companies(spark: SparkSession, path: str) -> DataFrame:
    """The master workbook in the store's column names, normalised."""
    rows = read_workbook(spark, path).select("row", *(_cell(h).alias(c) for h, c in COMPANY_SHEET.items())).where("name <> ''")
    return normalized_companies(rows)


def normalized_companies(rows: DataFrame) -> DataFrame:
    """Defaults for blanks, an id where there is none, confidence as a number."""
    out = {c: F.when(T.blank(c) == "", v).otherwise(F.col(c)) for c, v in DEFAULTS.items()}
    out["id"] = F.when(T.blank("id") == "", U.company_id("official_website", "known_website", "name", "state")).otherwise(F.col("id"))
    return rows.withColumns(out | {"confidence": N.confidence("confidence")})


def _xml(rows: list[tuple[str, ...]]) -> bytes:
    from xml.sax.saxutils import escape

    body = "".join(f"<row>{''.join(f'<c t="inlineStr"><is><t xml:space="preserve">{escape(v or "")}</t></is></c>' for v in r)}</row>" for r in rows)
    return f'<?xml version="1.0" encoding="UTF-8"?><worksheet xmlns="{_NS[1:-1]}"><sheetData>{body}</sheetData></worksheet>'.encode()


def workbook_bytes(header: list[str], rows: list[tuple[str, ...]]) -> bytes:
    out = io.BytesIO()
    rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("[Content_Types].xml", '<?xml version="1.0"?><Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/><Override PartName="/xl/worksheets/sheet1.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/></Types>')
        z.writestr("_rels/.rels", f'<?xml version="1.0"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Type="{rel}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        z.writestr("xl/workbook.xml", f'<?xml version="1.0"?><workbook xmlns="{_NS[1:-1]}" xmlns:r="{rel}"><sheets><sheet name="Sheet1" sheetId="1" r:id="r1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", f'<?xml version="1.0"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Type="{rel}/worksheet" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/worksheets/sheet1.xml", _xml([tuple(header), *rows]))
    return out.getvalue()


def write_workbook(df: DataFrame, path: str, columns: dict[str, str]) -> None:
    """One workbook of at most MAX_ROWS rows, cells made safe; written beside its place, then renamed into it."""
    shown = df.select(*(T.safe_cell(F.col(c).cast("string")).alias(h) for h, c in columns.items()))
    rows = shown.limit(MAX_ROWS + 1).collect()  # bounded by what a workbook may hold
    if len(rows) > MAX_ROWS:
        raise ValueError(f"a workbook holds at most {MAX_ROWS} rows")
    spark = df.sparkSession
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    target, part = jvm.org.apache.hadoop.fs.Path(path), jvm.org.apache.hadoop.fs.Path(f"{path}.part")
    fs = target.getFileSystem(conf)
    with_stream = fs.create(part, True)
    with_stream.write(bytearray(workbook_bytes(list(columns), [tuple(r) for r in rows])))
    with_stream.close()
    fs.delete(target, False)
    if not fs.rename(part, target):
        raise OSError(f"could not put {path} in its place")

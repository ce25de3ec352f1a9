"""Exports: the list as CSV or a workbook, the corpus as files."""

from __future__ import annotations

import io
import zipfile
from xml.sax.saxutils import escape

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The columns of an exported list, and the tables a corpus may hold.
FIELDS = (
    "address neighborhood borough metro property_type transaction_type size_sf divisible_min_sf divisible_max_sf floor ceiling_height_ft "
    "asking_rent rent_unit lease_type sale_price availability_date walk_score transit_score broker_name broker_firm broker_phone our_description source source_url"
).split()
CORPUS_TABLES = ("listing", "parcel")
DERIVED_TABLES = ("poi", "transit_nearby", "listing_vec", "crawl_log", "provider_cache")


def export_fields(listings: DataFrame) -> DataFrame:
    """The exported columns in order; those a table lacks are null, others are left out."""
    return listings.select(*(F.col(c) if c in listings.columns else F.lit(None).cast("string").alias(c) for c in FIELDS))


def write_csv(listings: DataFrame, path: str) -> None:
    """One CSV file with a header; for lists, which one task can hold."""
    export_fields(listings).coalesce(1).write.mode("overwrite").option("header", True).option("emptyValue", "").option("nullValue", "").option("escape", '"').csv(path)


SHEET_ROWS = 1_048_575  # below the header, as many as a sheet can hold


def workbook(listings: DataFrame, sheet_rows: int = SHEET_ROWS) -> bytes:
    """All rows as the bytes of an .xlsx file: a sheet with a header row, and further ones past ``sheet_rows`` rows."""

    def cell(v) -> str:
        if v is None:
            return "<c/>"
        if isinstance(v, (int, float)):
            return f"<c><v>{v}</v></c>"
        return f'<c t="inlineStr"><is><t xml:space="preserve">{escape(str(v))}</t></is></c>'

    ns, doc = "http://schemas.openxmlformats.org", "officeDocument/2006/relationships"
    head, rows, sheets = '<?xml version="1.0" encoding="UTF-8"?>', export_fields(listings).toLocalIterator(), 0
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        row = next(rows, None)
        while row is not None or not sheets:
            sheets += 1
            with z.open(f"xl/worksheets/sheet{sheets}.xml", "w", force_zip64=True) as sheet:
                sheet.write(f'{head}<worksheet xmlns="{ns}/spreadsheetml/2006/main"><sheetData><row>{"".join(map(cell, FIELDS))}</row>'.encode())
                for _ in range(sheet_rows):
                    if row is None:
                        break
                    sheet.write(f"<row>{''.join(map(cell, row))}</row>".encode())
                    row = next(rows, None)
                sheet.write(b"</sheetData></worksheet>")
    n = range(1, sheets + 1)
    kinds = "".join(f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>' for i in n)
    listed = "".join(f'<sheet name="listings{"" if i == 1 else f" {i}"}" sheetId="{i}" r:id="r{i}"/>' for i in n)
    links = "".join(f'<Relationship Id="r{i}" Type="{ns}/{doc}/worksheet" Target="worksheets/sheet{i}.xml"/>' for i in n)
    parts = {
        "[Content_Types].xml": f'<Types xmlns="{ns}/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/>{kinds}</Types>',
        "_rels/.rels": f'<Relationships xmlns="{ns}/package/2006/relationships"><Relationship Id="r1" Type="{ns}/{doc}/officeDocument" Target="xl/workbook.xml"/></Relationships>',
        "xl/workbook.xml": f'<workbook xmlns="{ns}/spreadsheetml/2006/main" xmlns:r="{ns}/{doc}"><sheets>{listed}</sheets></workbook>',
        "xl/_rels/workbook.xml.rels": f'<Relationships xmlns="{ns}/package/2006/relationships">{links}</Relationships>',
    }
    with zipfile.ZipFile(out, "a", zipfile.ZIP_DEFLATED) as z:
        for name, text in parts.items():
            z.writestr(name, head + text)
    return out.getvalue()


def write_corpus(tables: dict[str, DataFrame], path: str, derived: bool = False) -> list[str]:
    """Write the tables that may leave, by name: CSV and JSON lines (gzip) of listings in order, Parquet of all."""
    allowed = [t for t in (*CORPUS_TABLES, *(DERIVED_TABLES if derived else ())) if t in tables]
    for name in allowed:
        tables[name].write.mode("overwrite").parquet(f"{path}/{name}.parquet")
    if "listing" in allowed:
        rows = tables["listing"].orderBy("id")
        flat = rows.select(*(F.to_json(c).alias(c) if t.startswith(("array", "map", "struct")) else F.col(c) for c, t in rows.dtypes))
        flat.write.mode("overwrite").option("header", True).option("compression", "gzip").csv(f"{path}/listing.csv")
        rows.write.mode("overwrite").option("compression", "gzip").json(f"{path}/listing.jsonl")
    return allowed


# Names of the API's fields that differ from a plain change of case.
RENAMED = {"our_description": "description"}


def api_name(column: str) -> str:
    if column in RENAMED:
        return RENAMED[column]
    head, *rest = column.split("_")
    return head + "".join(p.capitalize() for p in rest)


def to_api(listings: DataFrame) -> DataFrame:
    """API names; lists that are null become empty."""

    def one(c: str, t: str) -> Column:
        return F.coalesce(F.col(c), F.array().cast(t)) if t.startswith("array") else F.coalesce(F.col(c), F.create_map().cast(t)) if t.startswith("map") else F.col(c)

    return listings.select(*(one(c, t).alias(api_name(c)) for c, t in listings.dtypes))


def map_pins(listings: DataFrame) -> DataFrame:
    """id and a JSON pin of listings with coordinates."""
    return listings.where("lat is not null and lng is not null").select("id", F.to_json(F.struct("id", "lat", "lng", F.coalesce("address", F.lit("")).alias("label"))).alias("pin"))


def bar_width(score: str | Column, weight: str | Column) -> Column:
    """Width of a score's bar in percent; 0 where the weight is 0."""
    s, w = (F.col(x) if isinstance(x, str) else x for x in (score, weight))
    return F.when(w != 0, F.bround(F.lit(100) * s / w, 0).cast("int")).otherwise(0)

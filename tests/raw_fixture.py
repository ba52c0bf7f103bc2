"""A small raw extract in the 22-column text layout."""

import csv
import io

from utilscope.schema import RAW_COLUMNS

DEFAULTS = {
    "Prscrbr_NPI": "1003000126", "Prscrbr_Last_Org_Name": "Smith, Jr", "Prscrbr_First_Name": "Ann",
    "Prscrbr_City": "Miami", "Prscrbr_State_Abrvtn": "FL", "Prscrbr_State_FIPS": "12",
    "Prscrbr_Type": "Endocrinology", "Prscrbr_Type_Src": "S", "Brnd_Name": "Ozempic",
    "Gnrc_Name": "Semaglutide", "Tot_Clms": "20", "Tot_30day_Fills": "25.5", "Tot_Day_Suply": "600",
    "Tot_Drug_Cst": "1000.10", "Tot_Benes": "12",
}


def raw_row(**changes) -> dict:
    return {c: changes.get(c, DEFAULTS.get(c, "")) for c in RAW_COLUMNS}


def csv_text(rows: list[dict], header: list[str] = RAW_COLUMNS) -> str:
    out = io.StringIO()
    writer = csv.writer(out, lineterminator="\n")
    writer.writerow(header)
    writer.writerows([row[c] for c in RAW_COLUMNS] for row in rows)
    return out.getvalue()


def write_year(folder, year: int, rows: list[dict], name: str = "extract.csv"):
    target = folder / f"year={year}"
    target.mkdir(parents=True, exist_ok=True)
    (target / name).write_text(csv_text(rows), encoding="utf-8")
    return folder

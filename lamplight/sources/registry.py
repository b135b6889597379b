"""The registry of portals, in its fixed order."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

SCHEMA = "state_ord int, key string, name string, start_url string, data_dirname string, pdf_dirname string, ocr_langs string, language_code string, filename_from_url boolean, capture_table_metadata boolean, extra_ca string"
# The portals.
STATES = (
    (0, "cg", "Chhattisgarh", "https://cgwcd.gov.in/", "cg", "cgwcd_all_pdfs", "hin+eng", "hi", False, False, None),
    (1, "bihar", "Bihar", "https://wcdc.bihar.gov.in/", "bihar", "bhwcd_all_pdfs", "hin+eng", "hi", False, False, None),
    (2, "odisha", "Odisha", "https://wcd.odisha.gov.in/", "odisha", "odwcd_all_pdfs", "hin+eng+ori", "hi", False, False, None),
    (3, "up", "Uttar Pradesh", "https://balvikasup.gov.in/", "up", "upwcd_all_pdfs", "hin+eng", "hi", False, False, None),
    (4, "delhi", "Delhi", "https://wcd.delhi.gov.in/", "delhi", "dwcd_all_pdfs", "hin+eng", "hi", False, False, None),
    (5, "karnataka", "Karnataka", "https://wcd.karnataka.gov.in/", "karnataka", "kwcd_all_pdfs", "kan+eng", "kn", True, True, "globalsign-gcc-r46-ov-tls-ca-2025.pem"),
)


def registry(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(STATES), SCHEMA)


def resolve(spark: SparkSession, keys: list[str] | None = None) -> DataFrame:
    """The named portals, all without names; an unknown name is an error."""
    known = {s[1] for s in STATES}
    wanted = [k.lower() for k in keys or []]
    if missing := sorted(set(wanted) - known):
        raise KeyError(f"unknown: {', '.join(missing)}; there are {', '.join(s[1] for s in STATES)}")
    rows = registry(spark)
    return rows.filter(rows["key"].isin(wanted)) if wanted else rows

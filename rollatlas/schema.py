"""Column names of the directory export and of the clean tables.

Inside Spark every column is snake_case; the export's own headers are kept for
reading and for compatibility output.
"""

from __future__ import annotations

from pyspark.sql import types as T

NO_DATA = "No Data"
ACTIVE = "Active"
DISTRICT_TYPES = ("District", "County Office")
SCHOOL_TYPE = "School"
REDACTED = "information redacted"

# The 41 headers of the directory export, in file order.
RAW_HEADERS = [
    "Record Type", "CDS Code", "Federal District ID", "Federal School ID",
    "Federal Charter District ID", "County", "District", "School", "Status",
    "Open Date", "Closed Date", "Charter Yes/No", "Charter Number", "Funding Type",
    "Educational Program Type", "Entity Type", "Low Grade", "High Grade",
    "Virtual Instruction Type", "Magnet Yes/No", "Year Round Yes/No", "Public Yes/No",
    "Multilingual Yes/No", "Website", "Latitude", "Longitude", "Last Update",
    "Street Address", "Street City", "Street State", "Street Zip", "Mailing Address",
    "Mailing City", "Mailing State", "Mailing Zip", "Phone", "Phone Extension",
    "Fax Number", "Administrator Name", "Administrator Phone",
    "Administrator Phone Ext.",
]

# Columns kept for a district and for a school, in output order.
DISTRICT_HEADERS = [
    "CDS Code", "District", "County", "Status", "Entity Type", "Funding Type",
    "Street Address", "Street City", "Street State", "Street Zip", "Phone", "Website",
    "Low Grade", "High Grade", "Latitude", "Longitude",
]
SCHOOL_HEADERS = [
    "CDS Code", "School", "Street Address", "Street City", "Street State", "Street Zip",
    "Phone", "Website", "Low Grade", "High Grade", "Status", "Public Yes/No",
    "Educational Program Type", "Latitude", "Longitude",
]


def snake(header: str) -> str:
    words = header.lower().replace("/", " ").replace(".", " ").split()
    return "_".join(words)


RAW_COLUMNS = [snake(h) for h in RAW_HEADERS]
DISTRICT_COLUMNS = [snake(h) for h in DISTRICT_HEADERS]
SCHOOL_COLUMNS = [snake(h) for h in SCHOOL_HEADERS]
HEADER_OF = dict(zip(RAW_COLUMNS, RAW_HEADERS))

RAW_SCHEMA = T.StructType([T.StructField(c, T.StringType()) for c in RAW_COLUMNS])

GAZETTEER_SCHEMA = T.StructType(
    [
        T.StructField("query", T.StringType(), False),
        T.StructField("rank", T.IntegerType(), False),
        T.StructField("lat", T.StringType()),
        T.StructField("lon", T.StringType()),
        T.StructField("display_name", T.StringType()),
        T.StructField("name", T.StringType()),
        T.StructField("class", T.StringType()),
        T.StructField("type", T.StringType()),
    ]
)

"""Column layout of the tables this package reads and writes."""

from pyspark.sql import types as T

#: Stored columns, in output order.
OUTPUT_COLUMNS = ["title", "url", "company", "description", "salary", "qualifications", "scraped_at"]

#: The arrival number orders rows wherever "first" matters. It is unique.
ARRIVAL = "arrival"

POSTING = T.StructType([T.StructField(c, T.StringType()) for c in OUTPUT_COLUMNS])
STORED = T.StructType([T.StructField(ARRIVAL, T.LongType()), *POSTING.fields])

#: What stands for "no value" in a written table.
MISSING_TEXT = "N/A"

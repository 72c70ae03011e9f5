"""Raw request rows -> accepted SQL texts or typed transport rejects."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewarden import vocab
from tablewarden.functions.json import is_json_text, json_object
from tablewarden.functions.once import with_computed_once

# Fixed value: accepted content type prefix, case-sensitive.
JSON_CONTENT_TYPE = "application/json"
# A leading byte-order mark is no part of the JSON text.
BYTE_ORDER_MARK = "\\A\ufeff"


def triage(requests: DataFrame) -> DataFrame:
    """Add ``sql`` and ``transport_code``, NULL for an accepted request.

    Content type first, then "is a JSON object", then "``sql`` is a string",
    then its size in bytes. An empty ``sql`` is accepted here: it is a request,
    and later rejected and audited as one.
    """
    parsed = requests.withColumn("_body", json_object(F.regexp_replace("body", BYTE_ORDER_MARK, "")))
    field = F.try_variant_get(F.col("_body"), "$.sql", "variant")
    typed = parsed.withColumn(
        "_sql", F.when(is_json_text(field), F.try_variant_get(F.col("_body"), "$.sql", "string"))
    )
    code = (
        F.when(
            ~F.coalesce(F.startswith(F.col("content_type"), F.lit(JSON_CONTENT_TYPE)), F.lit(False)),
            F.lit("invalid_content_type"),
        )
        .when(F.col("_body").isNull(), F.lit("invalid_json"))
        .when(F.col("_sql").isNull(), F.lit("invalid_request"))
        .when(F.octet_length("_sql") > vocab.MAX_SQL_BYTES, F.lit("sql_too_large"))
    )
    judged = with_computed_once(typed, _text=F.col("_sql"), transport_code=code)
    return judged.select(
        *requests.columns,
        F.when(F.col("transport_code").isNull(), F.col("_text")).alias("sql"),
        "transport_code",
    )


def accepted_requests(triaged: DataFrame) -> DataFrame:
    """What goes on to policy and audit; transport rejects are never audited."""
    return triaged.filter(F.col("transport_code").isNull())


def transport_rejects(triaged: DataFrame) -> DataFrame:
    return triaged.filter(F.col("transport_code").isNotNull())

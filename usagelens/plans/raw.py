"""Raw export cells derived from the test tables.

Each expression is plain SQL that Spark and other engines read alike, so a query and its
check start from the same text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from usagelens.plans.views import spread, table

ID = "CAST(event_id AS STRING)"
TENTH = "CAST(floor(event_id / 10) AS BIGINT)"
DATE = (
    f"('2026-0' || CAST(1 + {TENTH} % 9 AS STRING) || '-' || "
    f"lpad(CAST(1 + {TENTH} % 28 AS STRING), 2, '0'))"
)
CLOCK = (
    f"(lpad(CAST({TENTH} % 24 AS STRING), 2, '0') || ':' || "
    f"lpad(CAST({TENTH} % 60 AS STRING), 2, '0'))"
)

NUMBER_CELL = f"""CASE event_id % 13
    WHEN 0 THEN {ID} WHEN 1 THEN '1,' || lpad(CAST(event_id % 1000 AS STRING), 3, '0')
    WHEN 2 THEN '  ' || {ID} || '.75 ' WHEN 3 THEN '$' || {ID} || '.5' WHEN 4 THEN ''
    WHEN 5 THEN '   ' WHEN 6 THEN 'n/a' WHEN 7 THEN {ID} || 'e2'
    WHEN 8 THEN '-' || {ID} || '.25' WHEN 9 THEN 'inf' WHEN 10 THEN {ID} || 'd'
    WHEN 11 THEN '-$' || {ID} END"""

TIME_CELL = f"""CASE event_id % 11
    WHEN 0 THEN CAST(1700000000 + event_id * 60 AS STRING)
    WHEN 1 THEN CAST((1700000000 + event_id) * 1000 + 999 AS STRING)
    WHEN 2 THEN {DATE} || 'T' || {CLOCK} || ':00Z' WHEN 3 THEN {DATE} || ' ' || {CLOCK}
    WHEN 4 THEN ' ' || {DATE} || 'T' || {CLOCK} || '-05:00' WHEN 5 THEN replace({DATE}, '-', '')
    WHEN 6 THEN {DATE} || ' garbage' WHEN 7 THEN '12345678901' WHEN 8 THEN ''
    WHEN 9 THEN {DATE} END"""

STATUS_CELL = """CASE event_id % 9
    WHEN 0 THEN '200' WHEN 1 THEN '429' WHEN 2 THEN '500.0' WHEN 3 THEN 'Error'
    WHEN 4 THEN 'success' WHEN 5 THEN ' ' WHEN 6 THEN '399' WHEN 7 THEN 'FAILED' END"""

MODEL_CELL = """CASE user_id % 5
    WHEN 0 THEN 'gpt-4o' WHEN 1 THEN 'claude-3-haiku-20240307' WHEN 2 THEN ''
    WHEN 3 THEN ' o1-preview ' END"""

# A name per part that puts tier words next to letters, digits and separators.
MODEL_NAME = """CASE CAST(floor(p_partkey / 16) AS BIGINT) % 4
        WHEN 0 THEN '' WHEN 1 THEN 'x' WHEN 2 THEN 'Acme-' ELSE '7' END
    || CASE p_partkey % 16
        WHEN 0 THEN 'gemini-1.5-pro' WHEN 1 THEN 'mini' WHEN 2 THEN 'lite' WHEN 3 THEN 'O1'
        WHEN 4 THEN 'o3' WHEN 5 THEN 'GPT-4o' WHEN 6 THEN 'gpt-4.5-nano' WHEN 7 THEN 'ultra'
        WHEN 8 THEN '3.5-turbo' WHEN 9 THEN '35-turbo' WHEN 10 THEN 'sonnet'
        WHEN 11 THEN 'gemini-pro' WHEN 12 THEN 'mistral-large' WHEN 13 THEN 'gpt-5'
        WHEN 14 THEN p_name ELSE 'Flash' END
    || CASE CAST(floor(p_partkey / 64) AS BIGINT) % 3
        WHEN 0 THEN '' WHEN 1 THEN 'r' ELSE '-' || CAST(p_size AS STRING) END"""

# The first line of a file that could hold the event.
HEAD_LINE = f"""CASE event_id % 10
    WHEN 0 THEN '{{"usage": {{"prompt_tokens": ' || {ID} || '}}, "model": "m"}}'
    WHEN 1 THEN '{{"model": "m", "id": ' || {ID} || '}}'
    WHEN 2 THEN 'request_id,created_at,Request_Body,col' || {ID}
    WHEN 3 THEN 'request_id, "prompt_tokens" ,col' || {ID}
    WHEN 4 THEN 'col' || {ID} || ',N_Context_Tokens_Total'
    WHEN 5 THEN 'n_requests,n_generated_tokens_total,col' || {ID}
    WHEN 6 THEN '"usage_date_utc",col' || {ID}
    WHEN 7 THEN 'date,input_tokens,output_tokens,col' || {ID}
    WHEN 8 THEN 'alpha,beta,col' || {ID} ELSE '[' || {ID} || ']' END"""

# A log line per event: two of nine are broken or no object, one is blank.
LOG_LINE = f"""CASE event_id % 9
    WHEN 0 THEN '{{"model": "m", "usage": {{"promp' WHEN 1 THEN '[' || {ID} || ']'
    WHEN 2 THEN '   ' ELSE '{{"model": "m", "n": ' || {ID} || '}}' END"""


def event_cells(spark: SparkSession, sf_dir: str, **cells: str) -> DataFrame:
    """Events with extra text columns given as SQL."""
    made = {name: F.expr(text) for name, text in cells.items()}
    return spread(table(spark, sf_dir, "events")).withColumns(made)

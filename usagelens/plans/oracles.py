"""SQL equivalents of the registered queries, over the same tables."""

from __future__ import annotations

from usagelens.functions.prompts import DEFAULT_SALT
from usagelens.plans import raw
from usagelens.plans.views import MODELS, PROMPT_WORDS, TEMPLATES, VOCABULARY

# Written out here, so that a wrong pattern in the engine does not pass on both sides.
NUMBER = r"^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?$"
ISO_DATE_TIME = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}([T ].*)?$"
LOOSE_DATE = r"^[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}$"
IDENTIFIER = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}|org-[A-Za-z0-9]{8,}|sk-[A-Za-z0-9.]{2,}"
ALLOWED_MAIL = r"^[A-Za-z0-9._%+-]+@example\.com$"
REASON = "unavailable from this export format"
ADVICE = ("recommend", "should ", "consider ", "savings", "switch to", "migrate")

_MODELS = "[" + ", ".join("NULL" if m is None else f"'{m}'" for m in MODELS) + "]"
_LOG = "'litellm_jsonl'"
_BILL = "'openai_csv'"

# Price tiers without look-behind, which this dialect lacks.
_TIER = """CASE
    WHEN regexp_matches(lower(model),
        '(^|[^a-z])mini|nano|(^|[^a-z])lite([^a-z]|$)|haiku|flash|3\\.5-turbo|35-turbo') THEN 'cheap'
    WHEN regexp_matches(lower(model),
        'opus|(^|[^a-z0-9])o1([^a-z]|$)|(^|[^a-z0-9])o3([^a-z]|$)|gpt-4\\.5|gpt-5|ultra') THEN 'frontier'
    WHEN regexp_matches(lower(model),
        'gpt-4|sonnet|gemini-1\\.5-pro|gemini-pro|mistral-large') THEN 'mid'
    ELSE 'unknown' END"""

_USAGE = f"""log AS (
    SELECT {_LOG} AS source_format, CASE WHEN event_id % 97 <> 0 THEN ts END AS ts,
        ({_MODELS})[user_id % 8 + 1] AS model, CAST(floor(value * 100) AS BIGINT) AS input_tokens,
        event_id % 800 AS output_tokens, value / 1000 AS cost_usd,
        coalesce(event_type = 'error', false) AS is_error, 1 AS n, true AS per_request
    FROM events),
bill AS (
    SELECT {_BILL} AS source_format, l_shipdate AS ts, ({_MODELS})[l_suppkey % 8 + 1] AS model,
        CAST(floor(l_extendedprice) AS BIGINT) AS input_tokens, CAST(NULL AS BIGINT) AS output_tokens,
        CASE WHEN l_linenumber % 3 <> 0 THEN l_extendedprice * l_discount END AS cost_usd,
        false AS is_error, coalesce(nullif(CAST(floor(l_quantity) AS BIGINT), 0), 1) AS n,
        false AS per_request
    FROM lineitem),
both_logs AS (SELECT * FROM log UNION ALL SELECT * FROM bill)"""

_SUMS = """CAST(sum(n) AS BIGINT) AS n_requests,
    CAST(coalesce(sum(input_tokens), 0) AS BIGINT) AS input_tokens,
    CAST(coalesce(sum(output_tokens), 0) AS BIGINT) AS output_tokens,
    round(CAST(sum(CAST(cost_usd AS DECIMAL(28, 10))) AS DOUBLE), 6) AS cost_usd"""

_NAME = "coalesce(nullif(model, ''), 'unknown')"
_DAY = "coalesce(strftime(ts, '%Y-%m-%d'), 'unknown')"


def _spend(source: str) -> str:
    return f"""WITH {_USAGE}
SELECT source_format, {_NAME} AS model, {_DAY} AS day, {_SUMS} FROM {source} GROUP BY 1, 2, 3"""


def _mix(source: str) -> str:
    return f"""WITH {_USAGE}
SELECT source_format, {_TIER} AS tier, count(DISTINCT {_NAME}) AS n_models,
    CAST(sum(n) AS BIGINT) AS n_requests, CAST(coalesce(sum(input_tokens), 0) AS BIGINT) AS input_tokens,
    CAST((SELECT sum(n) FROM {source}) AS BIGINT) AS total_requests,
    round_even(sum(n) / (SELECT sum(n) FROM {source}), 4) AS share_of_requests
FROM {source} GROUP BY 1, 2"""


def _by_day(source: str) -> str:
    return f"""WITH {_USAGE}
SELECT source_format, strftime(ts, '%Y-%m-%d') AS day, CAST(sum(n) AS BIGINT) AS n_requests,
    round(CAST(sum(CAST(cost_usd AS DECIMAL(28, 10))) AS DOUBLE), 6) AS cost_usd
FROM {source} WHERE ts IS NOT NULL GROUP BY 1, 2"""


_STATS = """count(v) AS count, coalesce(min(v), 0) AS min, coalesce(quantile_disc(v, 0.5), 0) AS p50,
    coalesce(quantile_disc(v, 0.9), 0) AS p90, coalesce(quantile_disc(v, 0.99), 0) AS p99,
    coalesce(max(v), 0) AS max, coalesce(round_even(avg(v), 1), 0) AS mean"""

_FLAGS = f"""flags AS (
    SELECT source_format, bool_or(per_request) AS per_request, false AS has_prompt_text,
        bool_or(cost_usd IS NOT NULL) AS has_cost,
        bool_or(input_tokens IS NOT NULL OR output_tokens IS NOT NULL) AS has_tokens,
        bool_or(ts IS NOT NULL) AS has_timestamp, bool_or(input_tokens IS NOT NULL) AS has_input_tokens
    FROM both_logs GROUP BY 1)"""


def _number(cell: str) -> str:
    return f"CASE WHEN regexp_matches({cell}, '{NUMBER}') THEN TRY_CAST({cell} AS DOUBLE) END"


def _whole(cell: str) -> str:
    n = _number(f"trim(replace(trim({cell}), ',', ''))")
    return f"TRY_CAST(trunc({n}) AS BIGINT)"


def _real(cell: str) -> str:
    n = _number(f"trim(ltrim(replace(trim({cell}), ',', ''), '$'))")
    return f"CASE WHEN isfinite({n}) THEN {n} END"


def _time(cell: str) -> str:
    t = f"trim({cell})"
    day = f"substr({t}, 1, 10)"
    return f"""CASE
    WHEN regexp_matches({t}, '^[0-9]{{9,10}}$') THEN make_timestamp(TRY_CAST({t} AS BIGINT) * 1000000)
    WHEN regexp_matches({t}, '^[0-9]{{12,13}}$')
        THEN make_timestamp(TRY_CAST({t} AS BIGINT) // 1000 * 1000000)
    WHEN regexp_matches({t}, '^[0-9]{{8}}$') THEN try_strptime({t}, '%Y%m%d')
    WHEN regexp_matches({t}, '{ISO_DATE_TIME}') THEN coalesce(
        try_strptime(substr(replace({t}, 'T', ' '), 1, 16), '%Y-%m-%d %H:%M'),
        try_strptime({day}, '%Y-%m-%d'))
    WHEN regexp_matches({day}, '{LOOSE_DATE}') THEN try_strptime({day}, '%Y-%m-%d') END"""


_ERROR_WORD = "coalesce(lower({c}) IN ('failure', 'error', 'failed'), false)"


def _http_error(cell: str) -> str:
    n = _number(f"trim({cell})")
    return f"CASE WHEN {n} IS NOT NULL THEN trunc({n}) >= 400 ELSE {_ERROR_WORD.format(c=cell)} END"


def _sketches(source: str, key: str, text: str) -> str:
    """Common tables ending in ``sketch`` (key, h, sk)."""
    return f"""words AS (
    SELECT {key} AS key, list_filter(string_split_regex(lower({text}), '[ \\t\\n\\v\\f\\r]+'), lambda w: w <> '') AS ws
    FROM {source}),
runs AS (
    SELECT key, sha256('{DEFAULT_SALT}' || array_to_string(ws, ' ')) AS h,
        CASE WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')]
            ELSE list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2])
        END AS sh
    FROM words WHERE len(ws) > 0),
sketch AS (
    SELECT key, h, list_sort(list_distinct(list_transform(sh,
        lambda s: CAST('0x' || substr(md5(s), 1, 15) AS BIGINT))))[1:128] AS sk
    FROM runs)"""


def _jaccard(a: str, b: str) -> str:
    union = f"list_distinct(list_concat({a}, {b}))"
    low = f"list_sort({union})[1:128]"
    return f"""CASE WHEN len({a}) < 128 AND len({b}) < 128
    THEN len(list_intersect({a}, {b})) / len({union})
    ELSE len(list_intersect(list_intersect({a}, {b}), {low})) / len({low}) END"""


# Every pair of distinct prompts that share any sketch value is checked.
_NEAR = f"""uniq AS (SELECT h, count(*) AS n, any_value(sk) AS sk FROM sketch GROUP BY h),
post AS (SELECT h, unnest(sk) AS v FROM uniq),
pairs AS (
    SELECT a.h AS a, b.h AS b, count(*) AS shared FROM post a JOIN post b ON a.v = b.v AND a.h < b.h
    GROUP BY 1, 2),
scored AS (
    SELECT p.a, p.b, CASE WHEN len(x.sk) < 128 AND len(y.sk) < 128
        THEN p.shared / (len(x.sk) + len(y.sk) - p.shared) ELSE {_jaccard('x.sk', 'y.sk')} END AS j
    FROM pairs p JOIN uniq x ON x.h = p.a JOIN uniq y ON y.h = p.b),
close AS (
    SELECT a AS h FROM scored WHERE j >= 0.5 UNION SELECT b FROM scored WHERE j >= 0.5),
flagged AS (
    SELECT u.h AS prompt_hash, u.n AS n_records, (u.n > 1 OR c.h IS NOT NULL) AS is_near
    FROM uniq u LEFT JOIN close c ON c.h = u.h)"""

_EXACT_COLUMNS = """CAST(sum(n_records) AS BIGINT) AS analyzed_records,
    CAST(sum(CASE WHEN n_records > 1 THEN n_records ELSE 0 END) AS BIGINT) AS exact_duplicate_records,
    round_even(sum(CASE WHEN n_records > 1 THEN n_records ELSE 0 END) / sum(n_records), 4)
        AS exact_duplicate_rate"""
_NEAR_COLUMNS = f"""{_EXACT_COLUMNS},
    CAST(sum(CASE WHEN is_near THEN n_records ELSE 0 END) AS BIGINT) AS near_duplicate_records,
    round_even(sum(CASE WHEN is_near THEN n_records ELSE 0 END) / sum(n_records), 4)
        AS near_duplicate_rate"""

_DOCS = _sketches("documents", "doc_id", "text")


def _hash_number(key: str, below: int) -> str:
    return f"CAST('0x' || substr(md5({key}), 1, 12) AS BIGINT) % {below}"


_TEMPLATED = f"""made AS (
    SELECT event_id, 't' || CAST(event_id % {TEMPLATES} AS STRING) || ':' AS template,
        'e' || CAST(event_id AS STRING) || ':' AS own,
        CASE WHEN event_id % 10 BETWEEN 4 AND 6
            THEN {_hash_number("'e' || CAST(event_id AS STRING) || ':at'", PROMPT_WORDS)} END AS changed
    FROM events),
texts AS (
    SELECT event_id, array_to_string(list_transform(range(0, {PROMPT_WORDS}), lambda i: 'tok' || CAST(
        {_hash_number("(CASE WHEN event_id % 10 >= 7 OR coalesce(i = changed, false) THEN own ELSE template END) || CAST(i AS STRING)", VOCABULARY)}
        AS STRING)), ' ') AS text
    FROM made),
{_sketches("texts", "event_id", "text")}"""

# The request log of events, as its reader should see it.
_LOG_ROWS = f"""seen AS (
    SELECT event_id, event_id % 3 AS third, event_type, props, value,
        CASE WHEN event_id % 3 <> 0 THEN strftime(ts, '%Y-%m-%d %H:%M:%S') END AS "at",
        ({_MODELS})[user_id % 8 + 1] AS model,
        CASE WHEN event_id % 3 = 0 THEN '/v1/chat' ELSE event_type END AS route,
        CASE WHEN event_id % 3 = 2 THEN CAST(floor(value * 10) AS BIGINT)
            ELSE CAST(floor(value * 100) AS BIGINT) END AS input_tokens,
        CASE WHEN event_id % 3 <> 2 THEN event_id % 800 END AS output_tokens,
        CASE WHEN event_id % 3 <> 2 THEN value END AS cost_usd,
        (coalesce(event_type = 'error', false) OR event_id % 7 = 0) AS is_error,
        CASE WHEN event_type = 'error' THEN 'failure' ELSE 'success' END AS status,
        CASE event_id % 3 WHEN 1 THEN concat_ws(' ', 'say', lower(event_type), lower(props))
            WHEN 2 THEN concat_ws(' ', lower(event_type), lower(props)) END AS text
    FROM events)"""


def _hash_and_size(text: str) -> str:
    """Hash and sketch size of a text without repeated shingles, words split by one blank."""
    return f"""CASE WHEN {text} <> '' THEN sha256('{DEFAULT_SALT}' || {text}) END AS prompt_hash,
    CASE WHEN {text} <> '' THEN greatest(len(string_split({text}, ' ')) - 2, 1) END AS sketch_size"""


_DOC_STATS = f"""doc_stats AS (SELECT {_NEAR_COLUMNS} FROM flagged)"""

# The lines of the JSON report: (source_format, metric, key) and the figures that are checked.
_LINES = f"""every AS (
    SELECT source_format, ts, model, input_tokens, output_tokens, n, per_request FROM both_logs
    UNION ALL SELECT {_LOG}, NULL, source, n_chars, NULL, 1, true FROM documents),
named AS (SELECT *, {_NAME} AS name, {_DAY} AS day, {_TIER} AS tier FROM every),
plain_lines AS (
    SELECT source_format, 'spend_by_model_day' AS metric, day || ' ' || name AS key, sum(n) AS n
    FROM named GROUP BY source_format, day, name
    UNION ALL SELECT source_format, 'model_mix', tier, sum(n) FROM named GROUP BY source_format, tier
    UNION ALL SELECT source_format, 'tier_models', tier || ' ' || name, sum(n) FROM named GROUP BY source_format, tier, name
    UNION ALL SELECT source_format, 'by_day', day, sum(n) FROM named WHERE ts IS NOT NULL GROUP BY source_format, day
    UNION ALL SELECT source_format, 'by_hour', lpad(CAST(hour(ts) AS VARCHAR), 2, '0'), sum(n)
    FROM named WHERE ts IS NOT NULL AND per_request GROUP BY source_format, hour(ts)
    UNION ALL SELECT DISTINCT source_format, unnest(['error_rate', 'long_context_tail']), '', NULL FROM named WHERE per_request),
lines AS (
    SELECT source_format, metric, key, n, NULL AS requests, NULL AS error_reason, NULL AS exact_duplicates,
        NULL AS near_duplicates, NULL AS p90 FROM plain_lines
    UNION ALL SELECT source_format, 'report', '', NULL, CAST(sum(n) AS BIGINT),
        CASE WHEN NOT bool_or(per_request) THEN 'unavailable from this export format' END, NULL, NULL, NULL
    FROM named GROUP BY 1
    UNION ALL SELECT source_format, 'token_histograms', 'input', NULL, NULL, NULL, NULL, NULL, quantile_disc(input_tokens, 0.9)
    FROM named WHERE per_request GROUP BY 1
    UNION ALL SELECT source_format, 'token_histograms', 'output', NULL, NULL, NULL, NULL, NULL, quantile_disc(output_tokens, 0.9)
    FROM named WHERE per_request GROUP BY 1
    UNION ALL SELECT {_LOG}, 'duplicate_prompts', '', NULL, NULL, NULL, exact_duplicate_records, near_duplicate_records, NULL
    FROM doc_stats)"""


ORACLES: dict[str, str] = {
    "spend_by_model_day": _spend("log"),
    "billing_spend_by_model_day": _spend("bill"),
    "streamed_spend": _spend("log"),
    "totals": f"""WITH {_USAGE}
SELECT source_format, CAST(sum(n) AS BIGINT) AS requests,
    CAST(coalesce(sum(input_tokens), 0) AS BIGINT) AS input_tokens,
    CAST(coalesce(sum(output_tokens), 0) AS BIGINT) AS output_tokens,
    round(CAST(sum(CAST(cost_usd AS DECIMAL(28, 10))) AS DOUBLE), 6) AS cost_usd
FROM both_logs GROUP BY 1""",
    "capabilities": f"WITH {_USAGE}, {_FLAGS} SELECT * FROM flags",
    "metric_availability": f"""WITH {_USAGE}, {_FLAGS},
rules AS (
    SELECT source_format, unnest(['spend_by_model_day', 'token_histograms', 'duplicate_prompts',
        'model_mix', 'error_rate', 'temporal_patterns', 'long_context_tail']) AS metric,
        unnest([has_tokens OR has_cost, per_request AND has_tokens, has_prompt_text, true,
        per_request, has_timestamp, per_request AND has_tokens AND has_input_tokens]) AS ok
    FROM flags)
SELECT source_format, metric, CASE WHEN ok THEN 'computed' ELSE 'unavailable' END AS status,
    CASE WHEN NOT ok THEN '{REASON}' END AS reason FROM rules""",
    "model_mix": _mix("log"),
    "billing_model_mix": _mix("bill"),
    "tier_models": f"""WITH {_USAGE}
SELECT source_format, {_TIER} AS tier, {_NAME} AS model, CAST(sum(n) AS BIGINT) AS n_requests
FROM log GROUP BY 1, 2, 3""",
    "error_rate": f"""WITH {_USAGE}
SELECT source_format, CAST(sum(n) AS BIGINT) AS total_requests,
    CAST(sum(CASE WHEN is_error THEN n ELSE 0 END) AS BIGINT) AS error_requests,
    round_even(sum(CASE WHEN is_error THEN n ELSE 0 END) / sum(n), 4) AS error_rate
FROM both_logs WHERE per_request GROUP BY 1""",
    "requests_by_day": _by_day("log"),
    "billing_requests_by_day": _by_day("bill"),
    "requests_by_hour": f"""WITH {_USAGE}
SELECT source_format, CAST(hour(ts) AS INTEGER) AS hour, CAST(sum(n) AS BIGINT) AS n_requests
FROM log WHERE ts IS NOT NULL GROUP BY 1, 2""",
    "token_histograms": f"""WITH {_USAGE},
vals AS (
    SELECT source_format, 'input' AS kind, input_tokens AS v FROM log
    UNION ALL SELECT source_format, 'output', output_tokens FROM log)
SELECT source_format, kind, {_STATS} FROM vals GROUP BY 1, 2""",
    "long_context_tail": f"""WITH {_USAGE},
ranked AS (
    SELECT source_format, input_tokens AS v, row_number() OVER (ORDER BY input_tokens DESC) AS r,
        count(*) OVER () AS n
    FROM log WHERE input_tokens IS NOT NULL)
SELECT source_format, quantile_disc(v, 0.95) AS p95_input_tokens, quantile_disc(v, 0.99) AS p99_input_tokens,
    max(v) AS max_input_tokens, count(*) FILTER (WHERE v > 32000) AS requests_over_32k_input,
    CAST(sum(v) FILTER (WHERE r <= greatest(n // 100, 1)) AS BIGINT) AS top_1pct_input_tokens,
    CAST(sum(v) AS BIGINT) AS all_input_tokens,
    round_even(sum(v) FILTER (WHERE r <= greatest(n // 100, 1)) / sum(v), 4)
        AS share_of_input_tokens_in_top_1pct_requests
FROM ranked GROUP BY 1""",
    "coerce_numbers": f"""WITH c AS (SELECT event_id, {raw.NUMBER_CELL} AS cell FROM events)
SELECT event_id, {_whole('cell')} AS as_long, {_real('cell')} AS as_double,
    coalesce(nullif({_whole('cell')}, 0), 1) AS as_requests FROM c""",
    "coerce_timestamps": f"""WITH c AS (SELECT event_id, {raw.TIME_CELL} AS cell FROM events),
t AS (SELECT event_id, {_time('cell')} AS ts FROM c)
SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS "at", {_DAY} AS day,
    CAST(hour(ts) AS INTEGER) AS hour FROM t""",
    "error_flags": f"""WITH c AS (SELECT event_id, {raw.STATUS_CELL} AS cell FROM events)
SELECT event_id, {_http_error('cell')} AS http_error, {_ERROR_WORD.format(c='cell')} AS log_error FROM c""",
    "alias_pick": f"""WITH c AS (
    SELECT event_id, {raw.NUMBER_CELL} AS amount, {raw.STATUS_CELL} AS cost FROM events)
SELECT event_id, coalesce(CASE WHEN trim(cost) <> '' THEN cost END,
    CASE WHEN trim(amount) <> '' THEN amount END) AS picked FROM c""",
    "price_tiers": f"""WITH p AS (SELECT p_partkey, {raw.MODEL_NAME} AS model FROM part)
SELECT p_partkey, model, {_TIER} AS tier FROM p""",
    "file_formats": f"""WITH l AS (SELECT {raw.HEAD_LINE} AS line FROM events),
c AS (
    SELECT line, CASE WHEN line LIKE '{{%' THEN [] ELSE list_transform(string_split(line, ','),
        lambda x: lower(trim(trim(trim(x), '"')))) END AS cols,
        CASE WHEN line LIKE '{{%' THEN json_keys(line) ELSE [] END AS keys
    FROM l)
SELECT CASE
    WHEN list_has_any(keys, ['call_type', 'usage', 'response_cost', 'litellm_call_id', 'messages'])
        THEN 'litellm_jsonl'
    WHEN list_contains(cols, 'request_id')
        AND list_has_any(cols, ['request_body', 'prompt_tokens']) THEN 'helicone'
    WHEN len(list_filter(cols, lambda x: contains(x, 'n_context_tokens'))) > 0
        OR list_has_all(cols, ['n_requests', 'n_generated_tokens_total']) THEN 'openai_csv'
    WHEN list_contains(cols, 'usage_date_utc')
        OR list_has_all(cols, ['input_tokens', 'output_tokens']) THEN 'anthropic_csv'
    ELSE 'unknown' END AS format, count(*) AS files
FROM c GROUP BY 1""",
    "chat_text": """SELECT conv_id, turn, sha256(CASE WHEN text <> '' THEN text || chr(10) ELSE '' END
    || upper(role)) AS text_hash FROM conversations""",
    "prompt_sketches": f"""WITH {_DOCS}
SELECT d.doc_id, s.h AS prompt_hash, len(s.sk) AS sketch_size,
    md5(array_to_string(s.sk, ',')) AS sketch_digest
FROM documents d LEFT JOIN sketch s ON s.key = d.doc_id""",
    "sketch_jaccard": f"""WITH {_DOCS},
every AS (SELECT d.doc_id, s.sk FROM documents d LEFT JOIN sketch s ON s.key = d.doc_id)
SELECT a.doc_id, round(coalesce({_jaccard('a.sk', 'b.sk')}, 0), 9) AS jaccard
FROM every a JOIN every b ON b.doc_id = a.doc_id + 1""",
    "exact_duplicates": f"""WITH {_DOCS},
uniq AS (SELECT h, count(*) AS n_records FROM sketch GROUP BY h)
SELECT {_LOG} AS source_format, {_EXACT_COLUMNS} FROM uniq""",
    "near_duplicates": f"""WITH {_DOCS}, {_NEAR}
SELECT {_LOG} AS source_format, {_NEAR_COLUMNS} FROM flagged""",
    "near_duplicate_flags": f"WITH {_DOCS}, {_NEAR} SELECT * FROM flagged",
    "templated_near_duplicates": f"""WITH {_TEMPLATED}, {_NEAR}
SELECT {_LOG} AS source_format, {_NEAR_COLUMNS} FROM flagged""",
    "request_log_lines": f"""WITH {_LOG_ROWS}
SELECT "at", model, route, input_tokens, output_tokens, cost_usd, is_error, status, 1 AS n_requests,
    {_hash_and_size('text')} FROM seen""",
    "request_log_csv": f"""WITH c AS (
    SELECT *, {raw.TIME_CELL} AS created, {raw.MODEL_CELL} AS model, {raw.NUMBER_CELL} AS number,
        {raw.STATUS_CELL} AS code,
        CASE WHEN event_id % 4 <> 0 THEN lower(props)
            WHEN event_id % 8 = 0 THEN lower(event_type) END AS text
    FROM events)
SELECT strftime({_time('created')}, '%Y-%m-%d %H:%M:%S') AS "at",
    CASE WHEN trim(model) <> '' THEN model END AS model, event_type AS route,
    {_whole('number')} AS input_tokens, event_id AS output_tokens, {_real('number')} AS cost_usd,
    {_http_error('code')} AS is_error, CASE WHEN trim(code) <> '' THEN code END AS status,
    1 AS n_requests, {_hash_and_size('text')} FROM c""",
    "activity_csv": f"""SELECT ({_MODELS})[l_suppkey % 8 + 1] AS model, l_returnflag AS route,
    strftime(l_shipdate, '%Y-%m-%d') AS day, count(*) AS rows,
    CAST(sum(CASE WHEN floor(l_quantity) = 1 THEN 1 ELSE floor(l_quantity - 1) END) AS BIGINT) AS n_requests,
    CAST(sum(floor(l_extendedprice)) AS BIGINT) AS input_tokens,
    CAST(sum(CASE WHEN l_linenumber % 2 = 0 THEN l_partkey END) AS BIGINT) AS output_tokens
FROM lineitem GROUP BY 1, 2, 3""",
    "cache_usage_csv": f"""SELECT ({_MODELS})[l_suppkey % 8 + 1] AS model, l_linestatus AS route,
    count(*) AS rows, count(l_shipdate) AS dated, count(*) AS n_requests,
    CAST(sum(CASE l_linenumber % 3 WHEN 0 THEN l_partkey WHEN 1 THEN floor(l_extendedprice) + floor(l_quantity)
        ELSE floor(l_quantity) END) AS BIGINT) AS input_tokens,
    CAST(sum(l_suppkey) AS BIGINT) AS output_tokens, CAST(0 AS BIGINT) AS costs
FROM lineitem GROUP BY 1, 2""",
    "cost_csv": f"""SELECT 'anthropic_csv' AS source_format,
    coalesce(({_MODELS})[l_suppkey % 8 + 1], 'unknown') AS model, strftime(l_shipdate, '%Y-%m-%d') AS day,
    count(*) AS n_requests, CAST(0 AS BIGINT) AS input_tokens, CAST(0 AS BIGINT) AS output_tokens,
    round(sum(l_quantity), 6) AS cost_usd
FROM lineitem GROUP BY 2, 3""",
    "malformed_line_numbers": f"""WITH l AS (
    SELECT row_number() OVER (ORDER BY event_id) AS number, trim({raw.LOG_LINE}) AS line FROM events),
f AS (
    SELECT number, CASE WHEN line = '' THEN NULL WHEN NOT json_valid(line) THEN 'malformed JSON'
        WHEN line NOT LIKE '{{%' THEN 'expected a JSON object' END AS reason FROM l)
SELECT number, reason FROM f WHERE reason IS NOT NULL""",
    "request_log_any_case": f"""WITH c AS (
    SELECT *, {raw.NUMBER_CELL} AS number, {raw.STATUS_CELL} AS code,
        CASE WHEN event_id % 2 = 0 AND props <> '' THEN lower(props) WHEN event_id % 3 = 0 THEN lower(event_type) END AS text
    FROM events)
SELECT event_type AS route, count(*) AS rows, count(ts) AS dated, CAST(sum({_whole('number')}) AS BIGINT) AS input_tokens,
    CAST(sum(event_id) AS BIGINT) AS output_tokens, count(*) FILTER (WHERE {_http_error('code')}) AS errors,
    count(nullif(trim(text), '')) AS prompts, count(DISTINCT nullif(trim(text), '')) AS distinct_prompts
FROM c GROUP BY 1""",
    "long_log_lines": """SELECT event_type AS model, count(*) AS rows, CAST(sum(event_id) AS BIGINT) AS input_tokens,
    count(*) AS prompts, count(DISTINCT event_id) AS distinct_prompts, CAST(0 AS BIGINT) AS faults
FROM events GROUP BY 1""",
    "quoted_csv": f"""WITH c AS (
    SELECT event_type AS route, event_id AS input_tokens, event_id || ', said "' || event_type || '"\n\n'
        || repeat('",\n', CAST(event_id % 7 AS BIGINT)) || coalesce(props, '') AS cell FROM events),
t AS (SELECT *, lower(trim(regexp_replace(cell, '\\s+', ' ', 'g'))) AS text FROM c)
SELECT route, input_tokens, sha256('{DEFAULT_SALT}' || text) AS prompt_hash FROM t""",
    "reports_by_file": f"""WITH {_LOG_ROWS},
activity AS (
    SELECT CASE WHEN floor(l_quantity) = 1 THEN 1 ELSE floor(l_quantity - 1) END AS n,
        floor(l_extendedprice) AS i, CASE WHEN l_linenumber % 2 = 0 THEN l_partkey END AS o FROM lineitem)
SELECT {_LOG} AS source_format, count(*) AS requests, CAST(sum(input_tokens) AS BIGINT) AS input_tokens,
    CAST(sum(output_tokens) AS BIGINT) AS output_tokens,
    (SELECT count(*) FROM events WHERE event_type = 'error' OR event_id % 7 = 0) AS errors,
    CAST(7 AS BIGINT) AS computed_metrics FROM seen
UNION ALL SELECT {_BILL}, CAST(sum(n) AS BIGINT), CAST(sum(i) AS BIGINT), CAST(sum(o) AS BIGINT), NULL, 3 FROM activity
UNION ALL SELECT 'helicone', 0, 0, 0, 0, 1""",
    "report_document": f"""WITH {_USAGE}, {_DOCS}, {_NEAR}, {_DOC_STATS}, {_LINES},
parts AS (
    SELECT *, CASE metric WHEN 'spend_by_model_day' THEN 1 WHEN 'token_histograms' THEN 2 WHEN 'duplicate_prompts' THEN 3
        WHEN 'model_mix' THEN 4 WHEN 'tier_models' THEN 4 WHEN 'error_rate' THEN 5 WHEN 'by_day' THEN 6
        WHEN 'by_hour' THEN 6 ELSE 7 END AS section, CASE metric WHEN 'by_hour' THEN 3 ELSE 1 END AS slot,
        CASE metric WHEN 'tier_models' THEN 1 ELSE 0 END AS sub, split_part(key, ' ', 1) AS list
    FROM lines WHERE metric <> 'report')
SELECT source_format, section, slot, sub, count(*) AS elements,
    count(*) - CASE sub WHEN 1 THEN count(DISTINCT list) ELSE 1 END AS after_others
FROM parts GROUP BY 1, 2, 3, 4""",
    "fragment_audit": r"""WITH d AS (SELECT doc_id, text, substr(text, doc_id % 50 + 1, doc_id % 60) AS cut FROM documents),
plain AS (SELECT trim(regexp_replace(text, '[ 	
]+', ' ', 'g'), ' ') AS t FROM d),
blocks AS (
    SELECT DISTINCT lower(unnest(list_transform(range(0, CAST(length(t) // 16 AS BIGINT)), lambda i: substr(t, i * 16 + 1, 16)))) AS b
    FROM plain WHERE length(t) >= 16),
cells AS (
    SELECT doc_id, CASE doc_id % 2 WHEN 0 THEN 'cut' ELSE 'reversed' END AS "column",
        CASE doc_id % 2 WHEN 0 THEN cut ELSE reverse(cut) END AS text FROM d WHERE length(cut) > 0),
c AS (SELECT *, lower(trim(regexp_replace(text, '[ 	
]+', ' ', 'g'), ' ')) AS t FROM cells),
g AS (SELECT doc_id, unnest(list_transform(range(1, length(t) - 14), lambda i: substr(t, i, 16))) AS b FROM c WHERE length(t) >= 16),
hit AS (SELECT DISTINCT doc_id FROM g JOIN blocks USING (b))
SELECT "column", count(*) AS cells, count(*) FILTER (WHERE length(text) >= 200) AS long_cells, count(h.doc_id) AS leaking_cells
FROM c LEFT JOIN hit h USING (doc_id) GROUP BY 1""",
    "output_fragment_audit": f"""WITH {_USAGE}, {_DOCS}, {_NEAR}, {_DOC_STATS}, {_LINES}
SELECT metric AS "column", CAST(0 AS BIGINT) AS long_cells, CAST(0 AS BIGINT) AS leaking_cells FROM lines GROUP BY 1""",
    "malformed_log_lines": f"""WITH l AS (SELECT trim({raw.LOG_LINE}) AS line FROM events),
f AS (
    SELECT CASE WHEN line = '' THEN NULL WHEN NOT json_valid(line) THEN 'malformed JSON'
        WHEN line NOT LIKE '{{%' THEN 'expected a JSON object' END AS reason FROM l)
SELECT reason, count(*) AS lines FROM f WHERE reason IS NOT NULL GROUP BY 1""",
    "mixed_exports": f"""WITH {_LOG_ROWS}
SELECT {_LOG} AS source_format, count(*) AS records, count(*) AS n_requests,
    CAST(sum(input_tokens) AS BIGINT) AS input_tokens, CAST(sum(output_tokens) AS BIGINT) AS output_tokens,
    count(text) AS prompts, count("at") AS dated FROM seen
UNION ALL SELECT {_BILL}, count(*),
    CAST(sum(CASE WHEN floor(l_quantity) = 1 THEN 1 ELSE floor(l_quantity - 1) END) AS BIGINT),
    CAST(sum(floor(l_extendedprice)) AS BIGINT),
    CAST(sum(CASE WHEN l_linenumber % 2 = 0 THEN l_partkey END) AS BIGINT), 0, count(l_shipdate)
FROM lineitem""",
    "normalized_profile": f"""WITH {_USAGE}, {_DOCS},
rows AS (
    SELECT source_format, ts, model, input_tokens, output_tokens, cost_usd, CAST(NULL AS STRING) AS h FROM both_logs
    UNION ALL SELECT {_LOG}, NULL, d.source, d.n_chars, NULL, NULL, s.h
    FROM documents d LEFT JOIN sketch s ON s.key = d.doc_id),
statuses AS (SELECT {_LOG} AS source_format, count(event_type) AS c FROM events)
SELECT r.source_format, count(*) AS records, count(ts) AS filled_timestamp, count(model) AS filled_model,
    count(input_tokens) AS filled_input_tokens, count(output_tokens) AS filled_output_tokens,
    count(cost_usd) AS filled_cost_usd, coalesce(any_value(s.c), 0) AS filled_status,
    count(h) AS filled_prompt_hash
FROM rows r LEFT JOIN statuses s ON s.source_format = r.source_format GROUP BY 1""",
    "report_summary": f"""WITH {_USAGE}, {_DOCS}, {_NEAR}, {_DOC_STATS},
every AS (
    SELECT * FROM both_logs UNION ALL
    SELECT {_LOG}, NULL, source, n_chars, NULL, NULL, false, 1, true FROM documents),
sums AS (
    SELECT source_format, CAST(sum(n) AS BIGINT) AS requests,
        CAST(coalesce(sum(input_tokens), 0) AS BIGINT) AS input_tokens,
        CAST(coalesce(sum(output_tokens), 0) AS BIGINT) AS output_tokens,
        round(CAST(sum(CAST(cost_usd AS DECIMAL(28, 10))) AS DOUBLE), 6) AS cost_usd, bool_or(per_request) AS per_request,
        count(DISTINCT {_NAME} || '|' || {_DAY}) AS spend_rows,
        CAST(sum(CASE WHEN is_error THEN n ELSE 0 END) AS BIGINT) AS errors,
        quantile_disc(input_tokens, 0.99) AS p99, count(*) FILTER (WHERE input_tokens > 32000) AS over
    FROM every GROUP BY 1)
SELECT s.source_format, requests, input_tokens, output_tokens, cost_usd,
    CASE WHEN per_request THEN 7 ELSE 3 END AS computed_metrics, spend_rows,
    d.analyzed_records, d.exact_duplicate_records, d.exact_duplicate_rate, d.near_duplicate_records,
    d.near_duplicate_rate, CASE WHEN per_request THEN errors END AS error_requests,
    CASE WHEN per_request THEN p99 END AS p99_input_tokens,
    CASE WHEN per_request THEN over END AS requests_over_32k_input
FROM sums s LEFT JOIN doc_stats d ON s.per_request""",
    "report_json": f"""WITH {_USAGE}, {_DOCS}, {_NEAR}, {_DOC_STATS}, {_LINES}
SELECT source_format, metric, count(*) AS lines, min(key) AS first_key, max(key) AS last_key,
    CAST(sum(n) AS BIGINT) AS n_requests, max(requests) AS requests, max(error_reason) AS error_reason,
    max(exact_duplicates) AS exact_duplicates, max(near_duplicates) AS near_duplicates,
    CAST(sum(p90) AS BIGINT) AS p90
FROM lines GROUP BY 1, 2""",
    "leak_audit": """WITH cells AS (
    SELECT unnest(['text', 'lang', 'source']) AS "column", unnest([text, lang, source]) AS t FROM documents)
SELECT "column", count(*) AS cells, count(*) FILTER (WHERE length(t) >= 200) AS long_cells,
    count(*) FILTER (WHERE contains(lower(t), 'licensed under') OR contains(lower(t), 'password')
        OR contains(lower(t), 'the of') OR contains(lower(t), lower('Éeau'))) AS leaking_cells
FROM cells WHERE t IS NOT NULL GROUP BY 1""",
    "large_totals": f"""WITH {_USAGE}
SELECT source_format, CAST(sum(n) AS VARCHAR) AS requests,
    CAST(sum(CAST(n AS HUGEINT) * 1000000000000000 + 900000000000000000 - coalesce(input_tokens, 0)) AS VARCHAR) AS input_tokens,
    CAST(count(cost_usd) * 1000000000 AS VARCHAR) AS cost_usd
FROM bill GROUP BY 1""",
    "near_vector_flags": """WITH rows AS (
    SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
    UNION ALL SELECT -vec_id - 1, list_transform(CAST(embedding AS DOUBLE[]),
        lambda x, i: CASE WHEN i - 1 = vec_id % len(embedding) THEN -x ELSE x END) FROM embeddings),
numbered AS (SELECT *, row_number() OVER () AS r FROM rows),
near AS (SELECT DISTINCT a.r FROM numbered a JOIN numbered b
    ON a.r <> b.r AND list_cosine_similarity(a.v, b.v) >= 0.95)
SELECT vec_id, count(*) OVER (PARTITION BY v) AS copies, r IN (SELECT r FROM near) AS is_near FROM numbered""",
    "output_leak_audit": f"""WITH {_USAGE}, {_DOCS}, {_NEAR}, {_DOC_STATS}, {_LINES}
SELECT unnest(['metric', 'key', 'value']) AS "column", (SELECT count(*) FROM lines) AS cells,
    CAST(0 AS BIGINT) AS leaking_cells""",
    "output_advice_cells": """SELECT unnest(['metric', 'key', 'value']) AS "column",
    CAST(0 AS BIGINT) AS advising_cells""",
    "identifier_scan": f"""WITH cells AS (
    SELECT unnest(['text', 'lang', 'source']) AS "column", unnest([text, lang, source]) AS t FROM documents),
hits AS (SELECT "column", unnest(regexp_extract_all(t, '{IDENTIFIER}')) AS hit FROM cells)
SELECT "column", CASE WHEN contains(hit, '@') THEN 'mail' WHEN hit LIKE 'org-%' THEN 'organisation'
    ELSE 'key' END AS kind, count(*) AS hits
FROM hits WHERE NOT regexp_matches(hit, '{ALLOWED_MAIL}') GROUP BY 1, 2""",
    "advice_cells": """WITH cells AS (
    SELECT unnest(['text', 'lang', 'source']) AS "column", unnest([text, lang, source]) AS t FROM documents)
SELECT "column", count(*) AS cells, count(*) FILTER (WHERE """
    + " OR ".join(f"contains(lower(t), '{w}')" for w in ADVICE)
    + """) AS advising_cells FROM cells WHERE t IS NOT NULL GROUP BY 1""",
}

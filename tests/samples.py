"""Small exports in every format, made by rule. All rows and figures are our own.

``plain_*`` give the figures that a report should show, from the rows, in plain Python.
"""

from __future__ import annotations

import csv
import io
import json
import math
import random
from collections import Counter, defaultdict
from typing import NamedTuple

PROMPTS = [
    "Which of these garden plants can stay outside when the first frost comes in autumn?",
    "Which of these garden plants can stay outside when the first snow comes in winter?",
    "Write a toast for my aunt who has run the village bakery for thirty years.",
    "How many litres of paint do I need for a barn wall of six by nine metres?",
    "Name three rivers that flow north and say where each one meets the sea.",
    "Explain to a child of eight why the moon looks larger near the horizon.",
    "Plan a day of walking near a lake with a stop for lunch and a short ferry ride.",
]
TIERS = {"gpt-4.1-mini": "cheap", "claude-3-5-haiku-latest": "cheap", "gpt-4o-2024-11-20": "mid", "claude-opus-4": "frontier"}
MODELS = list(TIERS)


class Request(NamedTuple):
    time: str
    model: str
    prompt: str
    tokens_in: int
    tokens_out: int
    cost: float
    failed: bool


def _requests() -> list[Request]:
    rng = random.Random(77)
    rows = []
    for i in range(23):
        day, hour = 9 + i // 6, 6 + (i * 5) % 11
        tokens_in = rng.choice([rng.randint(20, 90), rng.randint(400, 2500), 61234 if i == 17 else 33])
        rows.append(Request(
            f"2025-11-{day:02d}T{hour:02d}:{rng.randint(0, 59):02d}:00", MODELS[rng.randrange(4)], PROMPTS[i % 5 if i < 20 else 4 + i % 3],
            61234 if i == 17 else tokens_in, 0 if i == 4 else rng.randint(3, 700), round(tokens_in * 3.1e-6 + i * 1e-5, 7), i in (4, 11, 19),
        ))
    return rows


REQUESTS = _requests()


def request_log(rows: list[Request] = REQUESTS) -> str:
    lines = []
    for r in rows:
        line = {
            "call_type": "completion",
            "model": r.model,
            "messages": [{"role": "system", "content": ""}, {"role": "user", "content": r.prompt}],
            "usage": {"prompt_tokens": r.tokens_in, "completion_tokens": r.tokens_out},
            "startTime": r.time,
            "response_cost": r.cost,
            "status": "failure" if r.failed else "success",
        }
        if r.failed:
            line["exception"] = "RateLimit"
        lines.append(json.dumps(line))
    return "\n".join(lines) + "\n"


def table(header: list[str], rows: list[list]) -> str:
    out = io.StringIO()
    writer = csv.writer(out, lineterminator="\n")
    writer.writerow(header)
    writer.writerows(rows)
    return out.getvalue()


def request_csv(rows: list[Request] = REQUESTS) -> str:
    header = ["request_id", "created_at", "model", "prompt_tokens", "completion_tokens", "status", "request_body"]
    cells = []
    for i, r in enumerate(rows):
        body = json.dumps({"model": r.model, "messages": [{"role": "user", "content": r.prompt}]})
        cells.append([f"q-{i * 7}", r.time + "Z", r.model, r.tokens_in, r.tokens_out, "503" if r.failed else "200", body])
    return table(header, cells)


# (day, model, input, output, requests)
BILLED = [
    (f"2025-{10 + i // 4}-{3 + 5 * (i % 4):02d}", MODELS[(i * 3) % 4], 1000 + 137 * i * i, 90 * i + 11, 4 + (i * 13) % 29) for i in range(8)
]


def simple_billing() -> str:
    return table(
        ["timestamp", "model", "operation", "n_context_tokens_total", "n_generated_tokens_total", "n_requests"],
        [[f"{day}T00:00:00", model, "chat", i, o, n] for day, model, i, o, n in BILLED],
    )


# (epoch seconds, model, input, output, requests); None is a blank cell
ACTIVITY = [
    (1762300800, "gpt-4.1-mini", 7310, 415, 12), (1762300800, "gpt-4o-2024-11-20", 2204, 1333, 9),
    (1762387200, "whisper-1", None, None, 41), (1762473600, "gpt-4.1-mini", 64, None, 1),
]


def activity_billing() -> str:
    blank = lambda x: "" if x is None else f"{x}.0"
    return table(
        ["project_name", "operation", "n_context_tokens_total", "n_generated_tokens_total", "model", "timestamp", "num_requests"],
        [["lab", "chat" if i else "", blank(i), blank(o), model, at, n] for at, model, i, o, n in ACTIVITY],
    )


# (day, model, input, output, cost)
CONSOLE = [(f"2025-09-{1 + 2 * i:02d}", MODELS[1 + 2 * (i % 2)], 5150 * (i + 3), 611 * (i + 1), 0.37 + i / 8) for i in range(6)]


def console_billing() -> str:
    return table(["date", "workspace", "model", "input_tokens", "output_tokens", "cost_usd"],
                 [[day, "atelier", model, i, o, cost] for day, model, i, o, cost in CONSOLE])


# (time, model, no cache, write 5m, write 1h, read, output)
CACHED = [(f"2025-08-{7 + i} 1{i}:00", MODELS[i % 2 * 2 + 1], 31 * i, 1200 if i == 1 else 0, 17 * (i == 2), 908 * i, 5 + 64 * i) for i in range(5)]


def cache_usage() -> str:
    return table(
        ["usage_date_utc", "model_version", "workspace", "usage_input_tokens_no_cache", "usage_input_tokens_cache_write_5m",
         "usage_input_tokens_cache_write_1h", "usage_input_tokens_cache_read", "usage_output_tokens"],
        [[at, model, "atelier", *counts] for at, model, *counts in CACHED],
    )


# (day, model, kind, cost)
COSTS = [(f"2025-07-{20 + i // 2}", ("Claude Sonnet 4", "Claude Haiku 3.5")[i % 2], ("output", "input_no_cache")[i // 3], f"{0.21 * i * i:.2f}") for i in range(6)]


def token_costs() -> str:
    return table(["usage_date_utc", "model", "workspace", "token_type", "cost_usd"],
                 [[day, model, "atelier", kind, cost] for day, model, kind, cost in COSTS])


def nearest_rank(values: list[int], percent: int) -> int:
    return sorted(values)[max(1, math.ceil(percent / 100 * len(values))) - 1]


def plain_histogram(values: list[int]) -> dict:
    return {
        "count": len(values), "min": min(values), "p50": nearest_rank(values, 50), "p90": nearest_rank(values, 90),
        "p99": nearest_rank(values, 99), "max": max(values), "mean": round(sum(values) / len(values), 1),
    }


def plain_spend(rows: list[Request]) -> dict:
    out: dict = defaultdict(lambda: [0, 0, 0, 0.0])
    for r in rows:
        own = out[r.time[:10], r.model]
        for i, x in enumerate((1, r.tokens_in, r.tokens_out, r.cost)):
            own[i] += x
    return dict(out)


def plain_mix(rows: list[Request]) -> list[dict]:
    counts, tokens = Counter(TIERS[r.model] for r in rows), Counter()
    for r in rows:
        tokens[TIERS[r.model]] += r.tokens_in
    return [
        {"tier": t, "models": sorted({r.model for r in rows if TIERS[r.model] == t}), "n_requests": n,
         "share_of_requests": round(n / len(rows), 4), "input_tokens": tokens[t]}
        for t, n in sorted(counts.items())
    ]


def exact_duplicates(rows: list[Request]) -> int:
    return sum(n for n in Counter(r.prompt for r in rows).values() if n > 1)

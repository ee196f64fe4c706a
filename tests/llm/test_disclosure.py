"""Terms that disclose an entity, against shares counted plainly; texts with very many entities."""

from __future__ import annotations

import math
import random
import re
import time

import pytest

import plain
from usagelens.llm import pii

WORD = re.compile(r"[^\W\d_]{2,}")
SENTENCE = re.compile(r"(?<=[.!?])\s+|[\r\n]+")


def named(kind, value):
    return kind + ":" + (re.sub("[^0-9]", "", value) if kind in ("card", "phone") else value.lower())


def entities_of(text):
    out = set()
    for s in plain.base_spans(text):
        kind, a, b = s.split(":")
        out.add(named(kind, text[int(a) : int(b)]))
    return out


def words_of(text):
    for kind in plain.PII.values():
        text = kind.sub(" ", text)
    return set(WORD.findall(text.lower()))


def plain_terms(texts):
    """{(text, term): share} over distinct texts."""
    texts = {t or "" for t in texts}
    ents = {t: set().union(*(entities_of(s) for s in SENTENCE.split(t))) for t in texts}
    words = {t: set(WORD.findall(t.lower())) for t in texts}
    inside = {t: set().union(*(words_of(s) for s in SENTENCE.split(t))) for t in texts}
    out = {}
    for e in set().union(*ents.values()):
        held = [t for t in texts if e in ents[t]]
        for w in set().union(*(inside[t] for t in held)):
            with_both = [t for t in held if w in inside[t]]
            df, n = sum(w in words[t] for t in texts), len(with_both)
            own = math.log2(len(texts) / len(held))
            share = 1 - math.log2(df / n) / own if own > 0 else 0.0
            if share < pii.GENERALISE - 1e-12:
                continue
            for t in with_both:
                near = any(e in entities_of(s) and w in words_of(s) for s in SENTENCE.split(t))
                if n >= pii.SUPPORT or near:
                    out[t, w] = max(out.get((t, w), 0), share)
    return out


def plain_spans(text, terms):
    base = plain.base_spans(text)
    taken = [tuple(map(int, s.split(":")[1:])) for s in base]
    return base + [
        f"term:{m.start()}:{m.end()}" for m in WORD.finditer(text)
        if (text, m[0].lower()) in terms and not any(a <= m.start() < b for a, b in taken)
    ]


def corpus(seed):
    rng = random.Random(seed)
    vocabulary = [f"{a}{b}" for a in ("ka", "lo", "mi", "tu", "ze") for b in ("ra", "bo", "nix", "é")]
    texts = []
    for i in range(70):
        parts = [" ".join(rng.choices(vocabulary, k=rng.randint(1, 9))) + rng.choice([".", "!", "", "\n"]) for _ in range(rng.randint(1, 4))]
        if i % 3 == 0:
            parts.insert(rng.randint(0, len(parts)), rng.choice(["bob@mail.net", "10.0.0.7", "Bob@Mail.net", "ann@x.org"]) + " own" + "abcdefg"[i % 7] * 2)
        texts.append(" ".join(parts))
    far = "zebulon heads this one. " + "Some words go between them here. " * 12 + "Write to zeb@far.org now"
    texts += [far + f" v{'abcde'[i] * 3}" for i in range(5)] + ["Once only quillon met q@once.net there. Nothing of hapaxo here."]
    return texts + [texts[0], texts[3], None, ""]


@pytest.mark.parametrize("seed", [1, 2])
def test_terms_are_those_of_plain_shares(documents, seed):
    texts = corpus(seed)
    want = plain_terms(texts)
    got = {r["doc_id"]: r["spans"] for r in pii.personal_data(documents(list(enumerate(texts)))).collect()}
    assert {i: s.split(",") if s else [] for i, s in got.items()} == {i: plain_spans(t or "", want) for i, t in enumerate(texts)}
    flagged = {w for _, w in want}
    assert {"zebulon", "quillon"} <= flagged and "hapaxo" not in flagged


def test_texts_with_very_many_entities(documents):
    many = " ".join(f"mail user{i}@host{i % 50}.example.org or 10.{i % 200}.{i // 200}.7 now" for i in range(8000))
    start = time.time()
    made = documents([(1, many), (2, "a plain text"), (3, many[:50000])])
    rows = {r["doc_id"]: r for r in pii.personal_data(made).collect()}
    assert (rows[1]["n_email"], rows[1]["n_ip"]) == (8000, 8000)
    assert rows[1]["spans"].startswith(",".join(plain.base_spans(many)[:100]))
    clean = {r["doc_id"]: r["text"] for r in pii.sanitised(made).collect()}
    assert "@" not in clean[1] and clean[1].count("[EMAIL]") == 8000 and clean[2] == "a plain text"
    assert time.time() - start < 120

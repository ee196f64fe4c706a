"""Bounds of the language model hold by language."""

from __future__ import annotations

import random

from usagelens.llm import langid


def test_even_share():
    assert langid.even_share([], 100, 7) == 7
    assert langid.even_share([5, 1000], 100, 1) == 95
    assert langid.even_share([50, 50], 100, 1) == 50
    assert langid.even_share([1000] * 100, 100, 20) == 20


def test_rare_languages_stay_when_tables_and_sample_overflow(documents, monkeypatch):
    rng = random.Random(5)
    hot = ["".join(rng.choices("abcdefg", k=6)) for _ in range(300)]
    rows = [(i, " ".join(rng.choices(hot, k=20)), "aa") for i in range(3000)]
    rows += [(5000 + i, "zuvo wozy", "zz") for i in range(8)] + [(6000 + i, f"quor{'xyz'[i % 3] * (i + 1)}", "yy") for i in range(8)]
    made = documents(rows).select("doc_id", "text", "lang")
    monkeypatch.setattr(langid, "LEAST_ROWS", 20, raising=False)
    monkeypatch.setattr(langid, "LEAST_ENTRIES", 20, raising=False)
    model = langid.fit(made, sample_rows=300, max_words=100, max_grams=200)
    assert model.langs == ["aa", "yy", "zz"]
    assert model.predict("zuvo wozy")[0] == "zz" and model.predict("quorxx")[0] == "yy"
    assert model.predict(" ".join(hot[:10]))[0] == "aa"

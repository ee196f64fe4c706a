"""Every operator on rows with nulls, empty, long and repeated texts, ties and clashing columns."""

from __future__ import annotations

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

import plain
from usagelens.llm import ann, html_text, langid, minhash, mixing, packing, pii, quality, token_counts, tokens, topk

LONG = " ".join(f"word{i % 700}x{i}" for i in range(30000))
ROWS = [
    (1, None, "en", "b"), (2, "", None, "b"), (3, "   \n\t ", "en", None), (4, "one", "en", "a"),
    (5, "one two three four five six seven eight nine ten", "en", "a"),
    (5, "one two three four five six seven eight nine ten", "en", "a"),
    (6, "One TWO three four five six seven eight nine ten", "en", "c"),
    (7, LONG, "en", "b"), (8, LONG + " tail", "de", "b"), (None, "no id here at all", None, "a"),
    (9, "12345 !!! 678", "fr", "Ä"), (10, 'say "quoted" text', "fr", None),
]


def collected(df):
    return [r.asDict() for r in df.collect()]


@pytest.fixture
def rows(documents):
    return documents(ROWS)


@pytest.fixture
def empty(documents):
    return documents([])


def test_packing_round_trip(rows, empty):
    got = collected(packing.pack(rows))
    want = Counter((r[0], len(tokens.token_ids(r[1]))) for r in ROWS)
    pieces = defaultdict(list)
    for r in got:
        pieces[r["doc_id"]].append(r)
    for (doc, n), copies in want.items():
        if copies > 1:
            continue
        ids, at = tokens.token_ids(dict((r[0], r[1]) for r in ROWS)[doc]), 0
        for p in sorted(pieces[doc], key=lambda p: p["start"]):
            assert (p["start"], p["doc_tokens"]) == (at, n)
            assert zlib.crc32(ids[at : at + p["length"]].tobytes()) == p["ids_crc32"]
            at += p["length"]
        assert at == n
    sequences = defaultdict(list)
    for r in got:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for s in sequences.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at & (at - 1) == 0 and at <= packing.CAPACITY
    assert sum(r["length"] for r in got) == sum(n * c for (_, n), c in want.items())
    assert packing.pack(empty).collect() == []


def test_packing_closes_every_sequence_without_padding():
    rng = random.Random(4)
    for waiting in (1, 2, 3, 32):
        for _ in range(30):
            packer = packing.Packer(64, 0, waiting)
            lengths = [rng.randint(1, 300) for _ in range(rng.randint(0, 40))]
            for i, n in enumerate(lengths):
                packer.add(i, np.arange(n, dtype="<u4"))
            packer.finish()
            sizes, seen = Counter(), defaultdict(list)
            for doc, start, length, _, n, sequence, _ in packer.rows:
                sizes[sequence] += length
                seen[doc].append((start, length))
                assert n == lengths[doc]
            assert sum(sizes.values()) == sum(lengths)
            assert all(s & (s - 1) == 0 and s <= 64 for s in sizes.values())
            assert sum(s < 64 for s in sizes.values()) <= 6
            for doc, n in enumerate(lengths):
                at = 0
                for start, length in sorted(seen[doc]):
                    assert start == at
                    at += length
                assert at == n


def test_packing_keeps_most_documents_whole():
    rng = random.Random(9)
    packer = packing.Packer(2048, 0)
    lengths = [min(2048, int(rng.lognormvariate(6, 1)) + 1) for _ in range(5000)]
    for i, n in enumerate(lengths):
        packer.add(i, np.zeros(n, "<u4"))
    packer.finish()
    pieces = Counter(r[0] for r in packer.rows)
    assert sum(pieces.values()) < 1.35 * len(lengths) and sum(c == 1 for c in pieces.values()) > 0.7 * len(lengths)


def test_ids_equal_those_of_the_tokenizers_library(rows):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    for text in [r[1] for r in ROWS] + ["a  b\n\n c\t<|endoftext|> don't ß日本  x", "'" * 40, "1" * 500]:
        own = t.encode(text or "", add_special_tokens=False).ids
        assert tokens.token_ids(text).tolist() == own + [1]


MARKED = [
    "<|endoftext|>", "a  b\n\n c\t<|endoftext|> don't ß日本  x", "x  <|endoftext|><|endoftext|>  y", "<|endoftext|", "a <|ENDOFTEXT|>",
]


def test_ids_equal_those_of_the_library_at_its_defaults():
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for text in [r[1] for r in ROWS] + MARKED + ["'" * 40, "1" * 500, " \n "]:
        own = t.encode(text or "", add_special_tokens=False).ids
        assert tokens.token_ids(text, encode_special_tokens=False).tolist() == own + [1]


def test_added_tokens_inside_texts(documents):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = {i: t.encode(text, add_special_tokens=False).ids + [1] for i, text in enumerate(MARKED)}
    made = documents(list(enumerate(MARKED)))
    counted = token_counts.count_tokens(made).collect()
    assert {r["doc_id"]: r["tokens"] for r in counted} == {i: len(ids) for i, ids in want.items()}
    for r in packing.pack(made).collect():
        own = np.array(want[r["doc_id"]], dtype="<u4")
        assert r["doc_tokens"] == len(own)
        assert zlib.crc32(own[r["start"] : r["start"] + r["length"]].tobytes()) == r["ids_crc32"]


def test_token_counts(rows, empty):
    for block in (7, 64, 1 << 16):
        counted = token_counts.count_tokens(rows, block_tokens=block, file_tokens=20 * block)
        got = Counter((r["doc_id"], r["tokens"]) for r in collected(counted))
        assert got == Counter((r[0], len(tokens.token_ids(r[1]))) for r in ROWS)
    assert token_counts.count_tokens(empty).collect() == []


def test_texts_with_long_runs_of_white_space(documents):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = {1: " " * 1_000_000, 2: "a" + "\n" * 1_200_000 + "<|endoftext|>", 3: "word " * 100 + "\t" * 4_000_000}
    want = {i: len(t.encode(x, add_special_tokens=False).ids) + 1 for i, x in texts.items()}
    made = documents(list(texts.items()))
    assert {r["doc_id"]: r["tokens"] for r in token_counts.count_tokens(made).collect()} == want
    assert {r["doc_id"]: r["doc_tokens"] for r in packing.pack(made).collect()} == want


def test_separator_scan_of_flat_files(spark, tmp_path):
    rng = np.random.default_rng(2)
    want = []
    for f in range(3):
        ids = rng.integers(0, 6, 1000 * f + 13).astype("<u2")
        if f == 1:
            ids[ids == 5] = 0  # a file without a separator
        (tmp_path / f"part {f}.bin").write_bytes(ids.tobytes())
        ends = (np.flatnonzero(ids == 5) + 1).tolist()
        edges = [0, *ends]
        want += [(f, i, b - a, True) for i, (a, b) in enumerate(zip(edges, ends))]
        if edges[-1] < len(ids):
            want.append((f, len(ends), len(ids) - edges[-1], False))
    (tmp_path / "empty.bin").write_bytes(b"")
    blocks = token_counts.file_blocks(spark, str(tmp_path), block_tokens=17)
    got = token_counts.document_lengths(token_counts.block_ends(blocks, end_id=5)).collect()
    assert sorted((int(r["file"][-5]), r["number"], r["tokens"], r["closed"]) for r in got) == sorted(want)


def test_near_duplicates(documents, rows, empty):
    got = collected(minhash.near_duplicates(rows))
    assert len(got) == len(ROWS)
    by = {r["doc_id"]: r for r in got}
    want = plain.near_duplicate_components({r[0]: r[1] for r in ROWS if r[0] is not None})
    assert {k: by[k]["component_id"] for k in want} == want
    assert all(r["n_shingles"] == len(plain.shingle_set(dict((x[0], x[1]) for x in ROWS)[r["doc_id"]])) for r in got)
    assert by[None]["component_id"] is None and by[None]["kept"] is True
    assert minhash.near_duplicates(empty).collect() == []


@pytest.mark.parametrize("words", [4, 5])
def test_near_duplicates_equal_all_pairs(documents, words):
    rng = random.Random(words)
    vocabulary = [f"w{i}" for i in range(3000)]
    shared = rng.choices(vocabulary, k=60)
    base = rng.choices(vocabulary, k=80)
    texts = {}
    for i in range(160):
        kind = i % 4
        if kind == 0:  # a shared passage and own words
            w = shared + rng.choices(vocabulary, k=rng.randint(5, 60))
        elif kind == 1:  # variants of one text, near the threshold
            w = list(base)
            for _ in range(rng.randint(0, 5)):
                w[rng.randrange(len(w))] = rng.choice(vocabulary)
        elif kind == 2 and i > 8:  # a variant of an earlier text: chains
            w = texts[i - 4].split()
            w[rng.randrange(len(w))] = rng.choice(vocabulary)
        else:
            w = rng.choices(vocabulary, k=rng.randint(1, 90))
        texts[i] = " ".join(w)
    got = minhash.near_duplicates(documents(list(texts.items())), words=words)
    assert {r["doc_id"]: r["component_id"] for r in got.collect()} == plain.near_duplicate_components(texts, words)


def test_word_hashes_do_not_depend_on_segments(monkeypatch):
    text = "alpha beta  gamma\n" * 500 + "x" * 5000 + " end"
    whole = minhash.shingles(text)
    monkeypatch.setattr(minhash, "SEGMENT", 97)
    assert (minhash.shingles(text) == whole).all()
    assert len(whole) == len(plain.shingle_set(text))


def test_personal_data(documents, empty):
    texts = [
        None, "", "a@b.c_d@e.f..g@h.i", "x@y", "a.b+c%d-e@f-g.h.ij, k@l.m.", "@a.b a@.b a@b..c", "1.2.3.4.5.6.7.8 256.1.1.1 001.02.3.4",
        "0000000000000000300.1.1.1", "4111 1111 1111 1111", "4111-1111-1111-1111-", "4111  1111 1111 1111", "5" * 40, "4012888888881881x",
        "+1 (736) 555-2678 +49-30-1234567. +1 2 3", "+1((((((((2 +123456789012345678", "é+1 736 555 2678 ü a@b.co",
        "1" * 20000, "1 " * 20000, "a" * 30000 + "@", "a@" + "b." * 9000 + "c", "1." * 9000, "+" + "1" * 30000, "+1(" * 3000,
        "4111 1111 1111 1111 a@b.co 4111111111111111\n10.0.0.1\t+1 736 555 2678",
    ]
    made = documents(list(enumerate(texts)) + [(3, texts[4]), (None, "+1 736 555 2678")])
    import hashlib

    for r in collected(pii.personal_data(made)):
        text = "+1 736 555 2678" if r["doc_id"] is None else texts[r["doc_id"]]
        options = [text, texts[4]] if r["doc_id"] == 3 else [text]
        bases = [",".join(plain.base_spans(t)) for t in options]
        assert r["base_sha256"] in [hashlib.sha256(b.encode()).hexdigest() for b in bases]
        assert any(r["spans"].startswith(b) for b in bases)
        assert r["n_email"] + r["n_ip"] + r["n_card"] + r["n_phone"] in [b.count(":") // 2 for b in bases]
    assert pii.personal_data(empty).collect() == []


def test_terms_that_disclose_an_entity(documents):
    rows = [(i, f"filler number{i} common words around everywhere {i}") for i in range(40)]
    rows += [(100 + i, f"note {'abcde'[i]}aa write zebulon at zeb@example.com about {'abcde'[i]}bb common") for i in range(5)]
    made = documents(rows)
    by = {r["doc_id"]: r["spans"] for r in pii.personal_data(made).collect()}
    text = dict(rows)[100]
    at = text.index("zebulon")
    assert f"term:{at}:{at + 7}" in by[100].split(",")
    assert not any("term" in by[i] for i in range(40))
    assert not any(f"term:{text.index('common')}:" in s for s in by[100].split(","))
    clean = {r["doc_id"]: r for r in pii.sanitised(made).collect()}
    assert "zeb" not in clean[100]["text"] and "[EMAIL]" in clean[100]["text"]
    assert clean[3]["text"] == dict(rows)[3] and clean[3]["lang_pred"] == "x"


def test_sanitised_keeps_rows_and_columns(rows, empty):
    got = pii.sanitised(rows)
    assert got.columns == rows.columns
    assert sorted(map(repr, got.collect())) == sorted(map(repr, rows.collect()))
    assert pii.sanitised(empty).collect() == []


def test_mixing(documents, rows, empty):
    got = collected(mixing.mixed_sizes(rows))
    sizes = plain.source_words(ROWS)
    want = plain.targets(sizes)
    names = {(r[0], len(plain.WORD.findall(r[1] or ""))): r[3] for r in ROWS}
    taken = Counter()
    for r in got:
        source = names[r["doc_id"], r["size"]]
        assert r["source_size"] == sizes[source] and r["target"] == pytest.approx(want[source])
        assert 0 <= r["taken"] <= 2 * r["size"]
        taken[source] += r["taken"]
    assert len(got) == len(ROWS)
    assert all(abs(taken[s] - want[s]) <= 1 for s in sizes)
    assert mixing.mixed_sizes(empty).collect() == []


def test_mixing_targets_and_reruns(documents):
    rng = random.Random(8)
    rows = []
    for s in range(12):
        for _ in range(rng.choice([1, 3, 40])):
            rows.append((len(rows), " ".join(["w"] * rng.randint(0, 300)), "en", f"s{s}" if s else None))
    made = documents(rows)
    first = sorted(map(tuple, mixing.mixed_sizes(made).collect()))
    assert first == sorted(map(tuple, mixing.mixed_sizes(made.repartition(5)).collect()))
    want = plain.targets(plain.source_words(rows))
    by = {r[0]: r for r in first}
    for i, _, _, source in rows:
        assert by[i][3] == pytest.approx(want[source])
    drawn = mixing.mixed_documents(made, shards=5).groupBy("doc_id").sum("words").collect()
    assert {r[0]: r[1] for r in drawn} == {r[0]: r[4] for r in first if r[4]}


def test_mixed_sizes_add_up_the_placed_copies(documents, monkeypatch):
    made = documents([(1, "a b c", "en", "s"), (1, "d e", "en", "t"), (1, "d e", "en", "t"), (None, "f", "en", None)] + [
        (i, "w " * 200, "en", "st"[i % 2]) for i in range(2, 600)
    ])
    want = Counter(r["taken"] for r in mixing.mixed_sizes(made).collect())
    assert sum(want.values()) == made.count()
    split = mixing.shard_quotas
    monkeypatch.setattr(mixing, "shard_quotas", lambda *a: split(*a).where("source = 's'"))
    got = mixing.mixed_sizes(made).collect()
    assert sum(r["taken"] for r in got) < sum(k * n for k, n in want.items()) and len(got) == made.count()


def test_all_passes_of_a_source_are_placed(documents):
    made = documents([(i, "w " * 9, "en", "a" if i < 5 else "b") for i in range(60)])
    shares = {"budget": 4.0, "most": 6}
    sizes = mixing.mixed_sizes(made, **shares).collect()
    drawn = mixing.mixed_documents(made, **shares).groupBy("doc_id").sum("words").collect()
    assert sum(r["taken"] for r in sizes if r["doc_id"] < 5) == 5 * 9 * 6
    assert {r[0]: r[1] for r in drawn} == {r["doc_id"]: r["taken"] for r in sizes if r["taken"]}


def test_splitting_tree_keeps_quotas(spark):
    quotas = [("a", 1000), ("b", 7), (None, 93), ("c", 1)]
    made = spark.createDataFrame(quotas, "source string, quota bigint")
    got = mixing.shard_quotas(made, shards=9).collect()
    total, shards = Counter(), Counter()
    for r in got:
        total[r["source"]] += r["quota"]
        shards[r["shard"]] += r["quota"]
    assert total == dict(quotas)
    assert set(shards) == set(range(9)) and max(shards.values()) - min(shards.values()) <= 4


def test_hypergeometric_draws(spark):
    draws = spark.range(4000).selectExpr("(id + 0.5) / 4000 as u").select(
        mixing._hypergeometric(*(mixing.F.lit(x) for x in (30, 100, 40)), mixing.F.col("u")).alias("x")
    )
    got = np.array([r[0] for r in draws.collect()])
    assert got.mean() == pytest.approx(12, abs=0.02)
    assert got.var() == pytest.approx(40 * 0.3 * 0.7 * 60 / 99, rel=0.02)


def test_language_id(documents, rows, empty):
    rng = random.Random(1)
    words = {"xx": ["kala", "mora", "tilu", "veso"], "yy": ["strum", "blick", "drong", "fleck"]}
    made = documents([(i, " ".join(rng.choices(words[lang], k=20)), lang) for i in range(200) for lang in [("xx", "yy")[i % 2]]])
    got = {r["doc_id"]: r for r in langid.identify(made).collect()}
    assert all(got[i]["lang_pred"] == ("xx", "yy")[i % 2] for i in range(200))
    model = langid.fit(made.select("doc_id", "text", "lang"))
    assert model.predict("strumblick")[0] == "yy" and model.predict("Kalamora")[0] == "xx"
    assert model.predict(None) == model.predict("123 ...") == ("und", 0.0)
    edge = [(r["doc_id"], r["lang_pred"], r["score"]) for r in langid.identify(rows).collect()]
    assert len(edge) == len(ROWS) and all(0 <= s <= 1 for _, _, s in edge)
    assert {p for d, p, _ in edge if d in (1, 2, 3, 9)} == {"und"}
    assert langid.identify(empty).collect() == []


def test_quality(documents, spark):
    rng = random.Random(3)
    good = lambda: " ".join(rng.choices(["plain", "words", "of", "prose.", "And", "more"], k=rng.randint(5, 400)))
    junk = lambda: " ".join(w + "###" for w in rng.choices(["plain", "words", "of", "prose"], k=rng.randint(5, 400)))
    made = [(i, junk() if i % 3 == 0 else good()) for i in range(240)] + [(900, None), (901, ""), (901, "")]
    labels = spark.createDataFrame([(i, int(i % 3 != 0), None) for i in range(240)] + [(900, None, 1)], "doc_id bigint, quality int, toxic int")
    got = quality.classify(documents(made), labels).collect()
    assert len(got) == len(made) and all(0 <= r["score"] <= 1 for r in got)
    held = [r for r in got if r["held_out"] and r["doc_id"] < 900]
    assert held and all(r["predicted"] == int(r["doc_id"] % 3 != 0) for r in held)
    none = quality.classify(documents(made), labels.where("false")).collect()
    assert {r["score"] for r in none} == {0.5}
    assert quality.classify(documents([]), labels).collect() == []


def test_network_reads_every_byte_and_has_right_gradients():
    rng = np.random.default_rng(0)
    net = quality.Network()
    net.p["out"] = rng.normal(size=2 * quality.FILTERS).astype(np.float32)
    text = "".join(rng.choice(list("abcdef ."), 5000))
    cut = quality.chunks(text)
    step = quality.CHUNK - quality.OVERLAP
    joined = np.concatenate([cut[0], *(c[quality.OVERLAP :] for c in cut[1:])])
    assert bytes(joined[joined < 256].astype(np.uint8)).decode() == text and step > 0
    together = net.score([text, "", None, text[:100]])
    assert together == pytest.approx([net.score([t])[0] for t in (text, "", None, text[:100])], abs=1e-6)
    docs, y = [quality.chunks(text[:900]), quality.chunks(text[900:2000])], np.array([1.0, 0.0])

    def loss():
        p = np.array([net.combine(h.max(axis=0), h.mean(axis=0)) for h in map(net.pooled, docs)])
        return -(y * np.log(p) + (1 - y) * np.log(1 - p)).mean()

    grads = net.gradients(docs, y)
    for name in ("out", "bias", "filters", "embed"):
        at = np.unravel_index(np.abs(grads[name]).argmax(), grads[name].shape)
        old = net.p[name][at]
        net.p[name][at] = old + 1e-3
        up = loss()
        net.p[name][at] = old - 1e-3
        assert (up - loss()) / 2e-3 == pytest.approx(grads[name][at], rel=0.05, abs=1e-4)
        net.p[name][at] = old


VECTORS = "vec_id bigint, embedding array<float>, label int, score double, rank int"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 0, 0.0, 0) for i, v in rows], VECTORS)


def edge_vectors():
    rng = np.random.default_rng(5)
    rows = [(int(i), rng.normal(size=12).astype("f4").tolist()) for i in range(700)]
    rows += [(1000 + i, rows[0][1]) for i in range(60)]  # ties
    rows += [(2000, None), (2001, [None] * 12), (2020, [float("nan")] * 12), (2040, [float("inf")] * 12), (None, [1.0] * 12)]
    return rows + [rows[3]]  # a repeated row


def usable(rows):
    return {i: np.array(v, float) for i, v in rows if i is not None and v and None not in v and np.isfinite(v).all()}


@pytest.mark.parametrize("shard_rows", [100, 8192])
def test_top_k_equals_all_scores(spark, shard_rows):
    rows = edge_vectors()
    got = defaultdict(list)
    for r in topk.top_k(vectors(spark, rows), shard_rows=shard_rows).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    own = {i: np.floor(256 * v).astype(int) for i, v in usable(rows).items()}
    for q in (i for i in own if i % 50 == 0):
        best = sorted((-int(own[q] @ v), i) for i, v in own.items() if i != q)[:5]
        assert got.pop(q) == [(k + 1, i, -s) for k, (s, i) in enumerate(best)]
    assert not got
    assert topk.top_k(vectors(spark, [])).collect() == []
    assert topk.top_k(vectors(spark, [(50, [1.0])])).collect() == []


def test_blocks_are_pruned():
    rng = np.random.default_rng(1)
    rows = (rng.normal(size=(20, 8))[rng.integers(0, 20, 4000)] * 100 + rng.normal(size=(4000, 8))).astype(np.int64)
    rows = rows[topk.like_rows(rows)]
    ids = np.arange(len(rows))
    score, best, made = topk.block_search(ids[:50], rows[:50], np.full(50, topk.NONE), ids, rows, 5)
    every = rows[:50] @ rows.T
    every[np.arange(50), np.arange(50)] = topk.NONE
    assert (score == -np.sort(-every, axis=1)[:, :5]).all()
    assert made < 0.5 * every.size


@pytest.mark.parametrize("scale", [False, True])
def test_nearest_recall(spark, scale):
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(15, 32))
    rows = []
    for i in range(1500):
        v = centres[i % 15] + 0.7 * rng.normal(size=32)
        v /= np.linalg.norm(v)
        rows.append((i, (v * (rng.uniform(0.5, 2) if scale else 1)).astype("f4").tolist()))
    rows += [(5000, [0.0] * 32), (5020, None)]
    got = defaultdict(list)
    for r in ann.nearest(vectors(spark, rows), shard_rows=400).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    own = {i: v for i, v in usable(rows).items() if v.any()}
    hits = total = 0
    for q in (i for i in own if i % 20 == 0):
        best = sorted((-(own[q] @ v), i) for i, v in own.items() if i != q)[:20]
        assert all(s == pytest.approx(own[q] @ own[i]) for i, s in got[q]) and len(got[q]) == 20
        hits += len({i for _, i in best} & {i for i, _ in got[q]})
        total += 20
    assert set(got) == {i for i in own if i % 20 == 0} and hits / total >= 0.9
    assert ann.nearest(vectors(spark, [])).collect() == []
    assert [tuple(r) for r in ann.nearest(vectors(spark, [(20, [1.0, 0.0]), (21, [0.5, 0.0])])).collect()] == [(20, 1, 21, 0.5)]


PAGE = """<!DOCTYPE html><html><head><title>T</title><script>var a="<p>no</p>";</script></head><body>
<nav><ul><li><a href="/a">Home</a></li><li><a href="/b">News page</a></li></ul></nav><div class="ad">Buy this now.</div>
<article><h1>A {n} title &amp; more</h1><p>First paragraph of the story number {n}, with  several words; and
a <a href="#">link</a> in it.<p>Second &lt;one&gt;, which says that much more is known, and more to come.<br>After the break.
<!-- <p>hidden</p> --></article><footer>&copy; site &middot; all rights.</footer></body></html>"""


def test_main_text(spark):
    pages = [(i, f"u{i}", PAGE.replace("{n}", str(i)), "x") for i in range(30)]
    pages += [(30, "u", None, "x"), (31, None, "", "x"), (32, "u", "<article><p>cut of", "x"), (1, "u1", PAGE.replace("{n}", "1"), "x")]
    made = spark.createDataFrame(pages, "page_id bigint, url string, html string, text string")
    got = collected(html_text.main_text(made, plans=200))
    assert len(got) == len(pages) and all(r["n_chars"] == len(r["text"]) for r in got)
    by = {r["page_id"]: r["text"] for r in got}
    assert by[7] == (
        "A 7 title & more\nFirst paragraph of the story number 7, with several words; and a link in it.\n"
        "Second <one>, which says that much more is known, and more to come. After the break."
    )
    assert by[30] == by[31] == ""
    assert html_text.main_text(made.where("false")).collect() == []


def test_kept_nodes_are_consistent():
    nodes = html_text.listed(html_text.parse("<div><p>a</p><div><p>b</p>loose<ul><li>c<li>d</ul></div></div>"))
    keep = html_text.decode(nodes, np.random.default_rng(0).random(len(nodes)))
    assert all(keep[n.parent.index] for n in nodes[1:] if keep[n.index])


def test_page_plans_held_out():
    rng = random.Random(12)
    long = [" ".join(rng.choices("some words that stand in a longer text of a page".split(), k=rng.randint(15, 60))) + "." for _ in range(100)]
    short = [" ".join(rng.choices("home about us news world".split(), k=rng.randint(1, 4))) for _ in range(40)]
    model = html_text.train([f"<html><body><article>{''.join(f'<p>{t}</p>' for t in long[i:i + 5])}</article></body></html>" for i in range(0, 95, 5)], plans=250)
    exact = 0
    for _ in range(60):
        plan = html_text.page_plan(rng, long, short)
        marked = html_text.listed(html_text.parse(html_text.OUT.sub(' role="dataout"', plan)))
        good = np.ones(len(marked), bool)
        for n in marked[1:]:
            good[n.index] = good[n.parent.index] and "dataout" not in n.tokens
        exact += html_text.kept_text(marked, good) == html_text.extract([html_text.OUT.sub("", plan)], model)[0]
    assert exact >= 45

"""Collocations, hard negatives and token files against plain versions, and their edge cases."""

from __future__ import annotations

import io
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import zstandard

import plain
from usagelens.llm import collocations, hard_negatives, shards, token_files, tokens


def all_counts(docs):
    n, f = Counter(), Counter()
    for lang, text in docs:
        lang = lang or "und"
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(plain.UPPER)):
            w = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(w)
            for i in range(len(w)):
                for k in range(1, 6):
                    if i + k <= len(w):
                        f[lang, tuple(w[i : i + k])] += 1
    return n, f


def plain_collocations(docs, least, top):
    n, f = all_counts(docs)
    candidates = {p: a for p, a in f.items() if len(p[1]) > 1 and a >= least}
    out = []
    for (lang, w), a in candidates.items():
        longer = [b for (other, x), b in candidates.items() if other == lang and len(x) > len(w) and any(
            x[i : i + len(w)] == w for i in range(len(x) - len(w) + 1))]
        if any(100 * b >= 100 * a for b in longer):
            continue
        cuts = [(1000 * a * n[lang] // (f[lang, w[:k]] * f[lang, w[k:]]), k) for k in range(1, len(w))]
        score, k = min(cuts)
        out.append((lang, " ".join(w), a, f[lang, w[:k]], f[lang, w[k:]], n[lang], score))
    ranked = []
    for lang in {r[0] for r in out}:
        own = sorted((r for r in out if r[0] == lang), key=lambda r: (-r[6], -r[2], r[1].encode()))
        ranked += [(r[0], i + 1, *r[1:]) for i, r in enumerate(own[:top])]
    return sorted(ranked)


def phrase_texts(seed):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(30)] + ["é", "日本", "a\x00b", "\x01", "\x00", "x\x85y", "A"]
    docs = [("en", None), ("en", ""), (None, " \t "), ("de", "one word"), (None, "Only. ONE, each")]
    docs += [("en", "the same line, again and again") for _ in range(20)]
    for i in range(60):
        words = rng.choices(vocabulary, weights=range(len(vocabulary), 0, -1), k=rng.randint(0, 120))
        docs.append((rng.choice(["en", "de", None, "und"]), "".join(w + rng.choice([" ", "  ", "\t", ", ", "\n"]) for w in words)))
    return docs


@pytest.mark.parametrize("segment", [64, 1 << 20])
def test_collocations_equal_plain_counts(spark, segment):
    docs = phrase_texts(3)
    frame = spark.createDataFrame(docs, "lang string, text string").selectExpr("*", "1 AS a", "2 AS rank", "text AS phrase")
    got = collocations.collocations(frame, least=4, top=50, route_bytes=512, segment=segment)
    assert sorted(tuple(r) for r in got.collect()) == plain_collocations(docs, 4, 50)


def test_collocations_of_nothing(spark):
    frame = spark.createDataFrame([], "lang string, text string")
    assert collocations.collocations(frame).collect() == []
    assert collocations.collocations(spark.createDataFrame([(None, None), ("en", "a b")], "lang string, text string")).collect() == []


@pytest.mark.parametrize("cutoff", [2, 50])
def test_multikey_sort(cutoff):
    rng = np.random.default_rng(cutoff)
    columns = [rng.integers(1, 4, 3000)] + [rng.integers(0, 6, 3000) for _ in range(4)]
    for a, b in zip(columns[1:], columns[2:]):
        b[a == 0] = 0  # nothing follows the end
    order = collocations.multikey_sort(columns, np.arange(3000), cutoff)
    keys = [tuple(c[i] for c in columns) for i in order]
    assert keys == sorted(keys) and sorted(order) == list(range(3000))


def test_a_long_text_is_read_in_segments():
    text = ("alpha beta gamma. delta " * 400 + "x" * 900 + " end of it").encode()
    whole = collocations.sorted_suffixes([(b"en", text, len(text))])
    want = dict(zip(whole[0].to_pylist(), whole[1].tolist()))
    for size in (7, 100, 1000):
        got = Counter()
        for part, own in collocations.segments(text, 5, size):
            keys, counts = collocations.sorted_suffixes([(b"en", part, own)])
            got.update(dict(zip(keys.to_pylist(), counts.tolist())))
        assert got == want


def test_scores_and_counts_beyond_64_bits(spark):
    keys = [b"en\x00a\x00b", b"en\x00b", b"en\x00c"]
    rows = spark.createDataFrame([(0, k, c) for k, c in zip(keys, (4 * 10**15, 10**15, 9 * 10**16))], collocations.SUFFIXES)
    counts = {(r["phrase"], r["words"]): r["a"] for r in collocations.phrase_counts(rows.coalesce(1)).collect()}
    assert counts["", 0] == 95 * 10**15 and counts["a b", 2] == 4 * 10**15 and counts["b", 1] == 10**15


VECTORS = "vec_id bigint, label bigint, embedding array<double>, score double, n int"


def plain_negatives(rows):
    usable = [
        (i, label, [int(np.floor(256 * x)) for x in v]) for i, label, v in rows
        if i is not None and label is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)
    ]
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    out = []
    for i, label, v in usable:
        if i % 50:
            continue
        others = sorted(((-dot(v, w), j, own) for j, own, w in usable if j != i))
        for minus, j, own in [o for o in others if o[2] == label][:5]:
            fits = [(n, k) for n, k, other in others if other != label and 50 * -minus <= 100 * -n <= 95 * -minus][:3]
            out += [(i, j, r + 1, k, -minus, -n) for r, (n, k) in enumerate(fits)]
    return sorted(out)


def vector_rows(seed, n=700):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        v = rng.normal(size=6) + (2 if i % 3 else -1)
        rows.append((i, int(rng.integers(0, 4)), v.tolist()))
    rows += [(i, 1, [1.0, 2.0, 0.5, 0.5, 1.0, 1.0]) for i in range(1000, 1040)]  # ties
    rows += [(50, 2, [2.0] * 6), (50, 1, [1.5] * 6), (7, 3, [2.0] * 6), (7, 3, [1.0] * 6)]  # repeated ids
    rows += [(2000, None, [1.0]), (None, 1, [1.0]), (2050, 1, None), (2100, 2, [float("nan")]), (2150, 1, [None]),
             (2200, 9, [1.0]), (2250, 1, []), (2300, 1, [-1.0, -1.0]), (2350, 1, [0.0] * 6), (2400, 1, [1.0, 1.0])]
    return rows


@pytest.mark.parametrize("shard_rows", [40, 4096])
def test_hard_negatives_equal_all_scores(spark, shard_rows, monkeypatch):
    monkeypatch.setattr(shards, "BLOCK_QUERIES", 8)
    rows = vector_rows(1)
    frame = spark.createDataFrame([(*r, 1.0, 2) for r in rows], VECTORS)
    got = hard_negatives.hard_negatives(frame, shard_rows=shard_rows)
    assert sorted(tuple(r) for r in got.collect()) == plain_negatives(rows)


def test_hard_negatives_of_nothing(spark):
    assert hard_negatives.hard_negatives(spark.createDataFrame([], VECTORS)).collect() == []
    one = spark.createDataFrame([(50, 1, [1.0], 0.0, 0), (51, 2, [1.0], 0.0, 0)], VECTORS)
    assert hard_negatives.hard_negatives(one).collect() == []


def test_trees_prune_and_tile():
    rng = np.random.default_rng(5)
    rows = np.concatenate([rng.integers(-5, 5, (400, 8)) + 200 * c for c in range(6)]).astype(np.int64)
    labels = rng.integers(0, 3, len(rows))
    order = hard_negatives.tiled(rows, labels, 32)
    assert sorted(order) == list(range(len(rows))) and (np.diff(labels[order]) >= 0).all()
    ids = np.arange(len(rows))
    tree = hard_negatives.Tree(rows[order], labels[order], 32, 4)
    q = rows[:5]
    least, most = tree.intervals(q)
    s = q @ rows[order].T
    for leaf in range(tree.leaves):
        part = s[:, 32 * leaf : 32 * leaf + 32]
        assert (least[:, leaf] <= part.min(axis=1)).all() and (most[:, leaf] >= part.max(axis=1)).all()
    everything = np.full(5, shards.NONE), np.full(5, np.iinfo(np.int64).max)
    windows = hard_negatives.Windows(q, np.arange(5), ids[:5], labels[:5], *everything, False, 3)
    assert windows.scan(tree, ids[order], rows[order], labels[order]) < s.size / 3


def test_score_windows_of_whole_numbers():
    for p in (*range(-300, 301), 10**17 + 33, 1 - 10**17):
        low, high = (int(x[0]) for x in hard_negatives.scores_between(np.array([p])))
        assert 50 * p <= 100 * low < 50 * p + 100 and 95 * p - 100 < 100 * high <= 95 * p


TEXTS = [
    (3, "three words here"), (None, "no id"), (1, None), (2, ""), (2, "again two"), (2, "again two"),
    (5, "long " * 40000), (4, "a  b\n\n<|endoftext|> ß日本"), (-7, "below"), (2**62, "last"),
]


def test_token_files_round_trip(documents):
    docs = documents(TEXTS)
    files = token_files.write_files(docs, file_ids=50, frame_ids=64)
    back = token_files.read_files(files, read_ids=16).collect()
    ids = lambda t: tokens.token_ids(t, end=2, encode_special_tokens=False).tobytes()
    assert Counter((r["doc_id"], bytes(r["ids"])) for r in back) == Counter((i, ids(t)) for i, t in TEXTS)
    at = 0
    in_order = sorted(back, key=lambda r: r["start"])
    assert [r["doc_id"] for r in in_order] == sorted((t[0] for t in TEXTS), key=lambda i: (i is not None, i))
    for r in in_order:
        assert r["start"] == at
        at += len(r["ids"]) // 4
    some = token_files.read_files(files, wanted=[2, 5, 99]).collect()
    assert Counter(r["doc_id"] for r in some) == {2: 3, 5: 1}
    assert {(r["start"], bytes(r["ids"])) for r in some} <= {(r["start"], bytes(r["ids"])) for r in back}
    assert token_files.read_files(files, wanted=[]).collect() == []


def test_token_files_digest(documents):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    unique = [x for x in TEXTS if x[0] not in (None, 2)]
    at = 0
    want = []
    for i, text in sorted(unique):
        ids = np.array(t.encode(text or "", add_special_tokens=False).ids + [2], "<u4")
        want.append((i, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert sorted(tuple(r) for r in token_files.stored_documents(documents(unique)).collect()) == want
    assert token_files.stored_documents(documents([])).collect() == []


def test_frames_stand_alone_and_are_checked():
    out = io.BytesIO()
    writer = token_files.FileWriter(out, frame_ids=4)
    rows = [np.arange(n, dtype="<u4") for n in (3, 0, 9)]
    for i, r in enumerate(rows):
        writer.add(i, r)
    writer.close()
    data = out.getvalue()
    own = b"".join(r.tobytes() for r in rows)
    assert zstandard.ZstdDecompressor().stream_reader(data, read_across_frames=True).read().startswith(own)

    class Counted(io.BytesIO):
        got = 0

        def read(self, n=-1):
            self.got += n
            return super().read(n)

    file = Counted(data)
    reader = token_files.FileReader(file)
    before = file.got
    assert reader.document(2) == rows[2].tobytes() and file.got - before == int(reader.table[2:5, 0].sum())
    assert reader.start.tolist() == [0, 3, 3, 12]
    broken = bytearray(data)
    broken[-9 - 12 * len(reader.table) + 8] ^= 1  # the first checksum
    with pytest.raises(ValueError, match="checksum"):
        token_files.FileReader(io.BytesIO(bytes(broken))).document(0)
    with pytest.raises(ValueError, match="seek table"):
        token_files.FileReader(io.BytesIO(data[:-1]))


def test_words_are_cut_as_defined():
    data = np.frombuffer(b"a b.\tc\x0bd,,e f", np.uint8)
    start, piece, words = collocations.words_of(data)
    assert words.to_pylist() == [b"a", b"b", b"c", b"d", b"e", b"f"] and piece.tolist() == [0, 0, 1, 2, 4, 4]
    assert isinstance(words, pa.BinaryArray) and start.tolist() == [0, 2, 5, 7, 10, 12]

"""Importance resampling against plain Python, and its defined results for odd rows."""

import collections
import hashlib
import math
import re
import zlib

import numpy as np
import pyarrow as pa
from tidemark.llm import gram_buckets, importance, queries

ODD = [None, "", " . ", "a", "Hello, World foo-bar", "é Ünï A1 b2 " + "x" * 5000 + " yy " + "Z" * 70, "İSTANBUL Σ ß 日本語\x1cx", "word " * 3000, "tail"]


def features(text, buckets=10_000):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)
    return [zlib.crc32(" ".join(words[i : i + k]).encode()) % buckets for k in (1, 2, 3) for i in range(len(words) - k + 1)], len(words)


def expected(docs, target):
    """doc -> (n_features, weight, score, rank), for distinct ids."""
    own = {i: features(t) for i, t in docs}
    s, t = collections.Counter(), collections.Counter()
    for f, _ in own.values():
        s.update(f)
    for text in target:
        t.update(features(text)[0])
    of_s, of_t, rows = sum(s.values()), sum(t.values()), {}
    gain = [math.floor(1000 * math.log((t[b] + 1) * (of_s + 10_000) / ((s[b] + 1) * (of_t + 10_000)))) for b in range(10_000)]
    for i, (f, _) in own.items():
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in f)
        rows[i] = (len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))))
    fit = sorted((i for i in own if own[i][1] >= 20), key=lambda i: (-rows[i][2], -1 if i is None else i))
    rank = {i: k + 1 for k, i in enumerate(fit[: 5 * len(fit) // 100])}
    return {i: (*r, rank.get(i)) for i, r in rows.items()}


def as_told(found):
    return {r["doc_id"]: (r["n_features"], r["weight"], r["score"], r["rank"]) for r in found.collect()}


def test_whole_table(spark, small):
    docs = [tuple(r) for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()]
    target = [r["text"] for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
    got = queries.op13_importance_resampling(spark, small)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"] and as_told(got) == expected(docs, target)


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "x", "y", 7) for i, t in rows], "doc_id long, text string, weight string, bucket string, n_words int").repartition(3)


def test_odd_rows(spark):
    rows = [(i, t) for i, t in enumerate(ODD)] + [(None, "one two three " * 9)] + [(100 + k, f"w{k} some words of a text " * 5) for k in range(60)]
    target = frame(spark, [(0, "some words of a text"), (1, None)])
    assert as_told(importance.resample(frame(spark, rows), target)) == expected(rows, ["some words of a text", None])


def test_empty_tables(spark):
    none, one = frame(spark, [(0, "a")]).where("doc_id = 1"), frame(spark, [(0, "a b"), (1, None)])
    assert importance.resample(none, one).count() == 0
    assert as_told(importance.resample(one, none)) == expected([(0, "a b"), (1, None)], [])


def test_repeated_rows_and_ties(spark):
    rows = [(k % 20, f"the same twenty words {'again ' * 16}") for k in range(400)]
    got = importance.resample(frame(spark, rows), frame(spark, [(0, "other")])).collect()
    drawn = sorted((r["rank"], r["doc_id"], r["score"]) for r in got if r["rank"])
    assert len(got) == 400 and [r for r, _, _ in drawn] == list(range(1, 21))
    assert {d for _, d, _ in drawn} == {max({r["doc_id"] for r in got}, key=lambda d: ([r["score"] for r in got if r["doc_id"] == d][0], -d))}


def test_buckets_of_a_batch():
    texts = ODD[::-1] + ODD
    stream, bounds, n_words = gram_buckets.gram_buckets(pa.array(texts, pa.string()), 10_000)
    for i, t in enumerate(texts):
        want, n = features(t)
        assert sorted(stream[bounds[i] : bounds[i + 1]].tolist()) == sorted(want) and n_words[i] == n
    sliced = gram_buckets.gram_buckets(pa.array(texts, pa.string()).slice(3, 4), 10_000)
    assert sliced[2].tolist() == n_words[3:7].tolist()


def test_crc_of_joined_strings():
    a, b = b"some bytes", b"q" * 1000
    for n in (0, 1, 63, 64, 65, 1000):
        moved = gram_buckets.moved(np.array([zlib.crc32(a)], np.uint32), np.array([n]))
        assert int(moved[0]) ^ zlib.crc32(b[:n]) == zlib.crc32(a + b[:n])


def test_runs():
    values, lengths = importance.runs(np.array([5, 1, 5, 5, 0], np.uint16))
    assert (values.tolist(), lengths.tolist()) == ([0, 1, 5], [1, 1, 3]) and importance.runs(np.zeros(0, np.uint16))[0].size == 0

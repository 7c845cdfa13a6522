"""Best-fit packing: every id in one place, ids as the library gives them, and few sequences."""

import collections
import random
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from tidemark.llm import best_fit, byte_ids, queries
from tokenizers import Tokenizer

BYTES = public_tokenizers.path("byte_bpe_50k.json")
ODD = [None, "", " ", "  ", "a  b", " a ", "a\n b", "a\nb c\n", "x <|endoftext|> y", "x<|endoftext|>y z", "don't 's it", "é\xa0 x", "a\x00 b", "foo \x85", "tab\tx y", "日本 語 x", "\x1c a \x1c b", "word " * 5000, "x" * 9000]


LIBRARY = Tokenizer.from_file(BYTES)


def library_ids(text):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids


def check(rows, ids_of, capacity=2048):
    """Every document's pieces are its ids; sequences are gapless. -> (sequences, the least number there can be)"""
    pieces, sequences = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        pieces[r["doc_id"]].append(r)
        sequences[r["sequence_id"]].append(r)
    assert set(pieces) == set(ids_of)
    for d, found in pieces.items():
        at = 0
        for k, p in enumerate(sorted(found, key=lambda p: p["start"])):
            part = np.asarray(ids_of[d][at : at + p["length"]], "<u4")
            assert p["piece"] == k and p["start"] == at and len(part) == p["length"] > 0 and zlib.crc32(part.tobytes()) == p["ids_crc32"]
            assert p["length"] == capacity or k == 0
            at += p["length"]
        assert at == len(ids_of[d]) and len(found) == -(-at // capacity)
    for found in sequences.values():
        at = 0
        for p in sorted(found, key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at <= capacity
    return len(sequences), -(-sum(map(len, ids_of.values())) // capacity)


def frame(spark, texts):
    return spark.createDataFrame([(i, t, *"abcdef") for i, t in enumerate(texts)], "doc_id long, text string, piece string, part string, size string, sequence_id string, rank string, is_piece string").repartition(3)


def test_ids_are_the_library_s():
    rng = random.Random(1)
    texts = ODD + ["".join(rng.choice(["a", "b ", "\n", " ", "'s", "1", "é", "<|endoftext|>", ",", "日", "\x1d", "\t"]) for _ in range(rng.randint(1, 14))) for _ in range(3000)]
    for text, ids in zip(texts, byte_ids.byte_ids(BYTES).encode_batch(pa.array(texts))):
        assert ids.tolist() == LIBRARY.encode(text or "", add_special_tokens=False).ids, text


def test_whole_table(spark, small):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    n, least = check(queries.op12_best_fit_packing(spark, small).collect(), {d: [*library_ids(t), 0] for d, t in texts.items()})
    assert n <= least + 2


def test_odd_rows(spark):
    check(best_fit.pack(frame(spark, ODD), BYTES).collect(), {i: [*library_ids(t), 0] for i, t in enumerate(ODD)})


def test_empty_and_repeated(spark):
    assert best_fit.pack(frame(spark, ODD).where("doc_id < 0"), BYTES).count() == 0
    rows = best_fit.pack(frame(spark, ["the same text"] * 50).withColumn("doc_id", best_fit.F.lit(None).cast("long")), BYTES).collect()
    assert len(rows) == 50 and len({(r["sequence_id"], r["offset"]) for r in rows}) == 50


@pytest.mark.parametrize("lengths", ["mixed", "hot", "short"])
def test_many_partitions(spark, lengths):
    """Without joined partitions, so that gaps are handed down; a third of the pieces of one length, or only short ones."""
    rng = random.Random(2)
    n = {"mixed": lambda: rng.choice([3, 20, 70, 200, 400, 700, 900, 1500]) + rng.randint(0, 60), "hot": lambda: rng.choice([300, rng.randint(1, 1100), rng.randint(1, 300)]), "short": lambda: rng.randint(1, 40)}[lengths]
    texts = [" a" * n() for _ in range(1500)]
    joined = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = best_fit.pack(frame(spark, texts), BYTES).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", joined)
    found, least = check(rows, {i: library_ids(t) + [0] for i, t in enumerate(texts)})
    assert found <= least + 8 * len(best_fit.bounds(2048)) and found <= least * (1.06 if lengths != "short" else 1.6)


def test_open_gaps_give_the_successor():
    rng, gaps, held = random.Random(4), best_fit.OpenGaps(), []
    for k in range(3000):
        size = rng.randint(1, 60)
        if rng.random() < 0.5:
            gaps.add(size, k)
            held.append(size)
        else:
            want = min((h for h in held if h >= size), default=None)
            found = gaps.take(size)
            assert (found and found[0]) == want
            if want:
                held.remove(want)
    assert [g for g, _ in gaps.left()] == sorted(held)


def test_gaps_are_handed_to_the_nearest():
    #: (part, pieces, tokens, gaps, their size)
    assert best_fit.hand_down([(0, 0, 0, 4, 4000), (1, 0, 0, 2, 1000), (2, 3, 2000, 0, 0), (3, 9, 100, 0, 0)]) == [(1, 0, 2, 2), (0, 0, 1, 2), (0, 1, 2, 3)]
    assert best_fit.hand_down([(0, 5, 100, 0, 0), (1, 0, 0, 3, 30)]) == []


def test_cut_and_bounds():
    assert [best_fit.cut(n, 10) for n in (1, 10, 11, 25)] == [[1], [10], [1, 10], [5, 10, 10]]
    for capacity in (8, 100, 2048):
        assert sorted(x for high, low in best_fit.bounds(capacity) for x in range(low, high + 1)) == list(range(1, capacity // 2 + 1))

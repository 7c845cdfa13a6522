"""The corpus operators against brute force, and their defined results for odd rows."""

import collections
import math
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from compare import connect, differs
from pyspark.sql import functions as F
from tidemark.llm import components, dart_minhash, decontaminate, id_coder, line_spread, near_copies, packing, quality, queries, suffix_dedup, token_count, token_file, toxicity, url_rules, word_ids
from tokenizers import Tokenizer

import __spark_entry__ as entry
import corpus_pipeline

WORDS, BYTES = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")
ODD = [None, "", " ", "\n\n", "  two  blanks \n\n here\t\n", "<|endoftext|> a <|endoftext|>", "İSTANBUL Σ ß é é ½ 日本語\x1cx", "don't I'll 12345 ...", "a", "The same line.\nThe same line.", "word " * 3000]
NAMES = "score host path rule verdict start length n_words held_out _text _key _all _kept _lines _removed _line _hash _gone class_id sequence_id".split()


def frame(spark, texts, source=lambda i: "s"):
    """Documents with extra columns whose names clash with those of results."""
    rows = [(i, t, source(i), *["x"] * len(NAMES)) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, " + ", ".join(f"{n} string" for n in NAMES)).repartition(3)


def prose(rng, n):
    return " ".join("".join(rng.choice(["ka", "lo", "mi", "tu", "re", "so"]) for _ in range(rng.randint(1, 5))) for _ in range(n))


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_oracle(spark, small, name):
    assert differs(entry.queries()[name](spark, small), entry.oracle_sql()[name], connect(small)) is None


def test_token_counts(spark):
    library = Tokenizer.from_file(BYTES)
    got = {r["doc_id"]: r for r in token_count.count_tokens(frame(spark, ODD), BYTES).collect()}
    for i, t in enumerate(ODD):
        assert got[i]["n_tokens"] == len(library.encode(t or "", add_special_tokens=False).ids), t
        assert got[i]["n_bytes"] == len((t or "").encode()) and got[i]["over_limit"] == (got[i]["n_tokens"] > 1024)


def library_ids(t):
    return Tokenizer.from_file(WORDS).encode(t or "", add_special_tokens=False).ids


def test_merges_pop_the_lowest_rank():
    ranks = {("a", "b"): 1, ("b", "c"): 0, ("a", "bc"): 2}
    assert token_count.merged_count(list("abc"), ranks) == 1 and token_count.merged_count(list("aab"), ranks) == 2 and token_count.merged_count([], ranks) == 0


def check_packing(rows, ids_of):
    pieces, sequences = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        pieces[r["doc_id"]].append(r)
        sequences[r["sequence_id"]].append(r)
    assert set(pieces) == set(ids_of)
    for d, ps in pieces.items():
        at = 0
        for p in sorted(ps, key=lambda p: p["start"]):
            assert p["start"] == at and p["length"] > 0 and p["doc_tokens"] == len(ids_of[d])
            part = np.asarray(ids_of[d][at : at + p["length"]], "<u4")
            assert zlib.crc32(part.tobytes()) == p["ids_crc32"]
            at += p["length"]
        assert at == len(ids_of[d])
    padding = 0
    for ps in sequences.values():
        at = 0
        for p in sorted(ps, key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert 0 < at <= 4096
        padding += 0 if at & (at - 1) == 0 else 4096 - at
    return padding / sum(map(len, ids_of.values()))


def test_packing(spark):
    rng = random.Random(3)
    texts = ODD + [prose(rng, rng.choice([3, 40, 400, 4000])) for _ in range(60)]
    rows = packing.pack(frame(spark, texts), WORDS).collect()
    assert check_packing(rows, {i: [*library_ids(t), 2] for i, t in enumerate(texts)}) < 0.02


def test_cuts_fill_their_classes():
    for n in range(1, 9000, 7):
        parts = packing.cuts(n, 4096)
        assert sum(x for _, x in parts) == n and all(4096 // (j + 1) < x <= 4096 // j for j, x in parts)


def test_token_file(spark):
    texts = ODD + ["repeat"] * 3
    blocks = token_file.write_ids(frame(spark, texts), WORDS, block_ids=500)
    got = sorted(token_file.read_ids(blocks).collect())
    start = 0
    for (d, s, n, crc), t in zip(got, texts):
        ids = np.asarray([*library_ids(t), 1], "<u4")
        assert (s, n, crc) == (start, len(ids), zlib.crc32(ids.tobytes())), t
        start += n
    assert len(got) == len(texts)
    block = bytearray(blocks.first()["coded"])
    block[-1] ^= 1
    with pytest.raises(id_coder.BlockError):
        id_coder.decode(bytes(block))


@pytest.mark.parametrize("n", [0, 1, 47, 48, 5000, 300_000])
def test_coder_round_trip(n):
    rng = np.random.default_rng(n)
    for ids in (rng.integers(0, 65536, n), rng.geometric(0.01, n) % 5000, np.zeros(n), np.tile(rng.integers(0, 49000, 50), n // 50 + 1)[:n]):
        ids = ids.astype("<u4")
        assert np.array_equal(id_coder.decode(id_coder.encode(ids)), ids)


def test_token_file_takes_any_key(spark):
    rows = [("b", "two words"), (None, "no key"), (None, "none either"), ("a", None), ("b", "two words"), ("a", "x" * 200_000)]
    docs = spark.createDataFrame(rows, "name string, text string").repartition(3)
    got = token_file.read_ids(token_file.write_ids(docs, WORDS, key="name"), "name", "string").orderBy("start").collect()
    assert [r["name"] for r in got] == [None, None, "a", "a", "b", "b"]
    sums = lambda rows: collections.Counter((k, zlib.crc32(np.asarray([*library_ids(t), 1], "<u4").tobytes())) for k, t in rows)
    assert collections.Counter((r["name"], r["ids_crc32"]) for r in got) == sums(rows)
    assert [r["start"] for r in got] == [0, *np.cumsum([r["n_tokens"] for r in got])[:-1].tolist()]


def test_coder_takes_all_ids_and_beats_deflate(small):
    ids = np.array([2**32 - 1, 0, 7, 2**31] * 300, "<u4")
    assert np.array_equal(id_coder.decode(id_coder.encode(ids)), ids)
    many = np.random.default_rng(3).integers(0, 2**32, 300_000).astype("<u4")  # more symbols than order 0 has in its table
    assert np.array_equal(id_coder.decode(id_coder.encode(many)), many)
    import pyarrow.parquet as pq

    own = word_ids.word_ids(WORDS).encode_batch(pq.read_table("/root/testdata/sf0.1/documents.parquet").column("text").combine_chunks())
    ids = np.concatenate(own).astype("<u4")[: token_file.BLOCK_IDS]
    assert len(id_coder.encode(ids)) < 0.97 * len(zlib.compress(ids.astype("<u2").tobytes(), 9))


def test_coder_learns():
    ids = np.tile(np.random.default_rng(1).integers(0, 49000, 300), 1000).astype("<u4")
    assert len(id_coder.encode(ids)) < 0.2 * 2 * len(ids)


def weighted_shingles(text):
    """The weighted five-word shingles of a text, written down from the contract alone."""
    words = ["".join(c for c in w.lower() if c.isalnum()) for w in (text or "").split()]
    words = [w for w in words if w]
    n = min(5, len(words))
    return collections.Counter(" ".join(words[k : k + n]) for k in range(len(words) - n + 1)) if words else collections.Counter()


def weighted_jaccard(a, b):
    return sum((a & b).values()) / sum((a | b).values())


def brute_links(texts, least=0.8):
    """All pairs."""
    sets = dict(enumerate(map(weighted_shingles, texts)))
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and weighted_jaccard(sets[a], sets[b]) >= least:
                ra, rb = find(a), find(b)
                root[max(ra, rb)] = min(ra, rb)
    return {i: find(i) for i in sets}


def edited(rng, text, share):
    words = text.split()
    for _ in range(max(1, int(share * len(words)))):
        words[rng.randrange(len(words))] = "edit" + str(rng.randrange(1000))
    return " ".join(words)


def test_near_duplicates(spark):
    rng = random.Random(5)
    texts = ODD + [prose(rng, 200) for _ in range(10)]
    for k in range(11, 16):
        texts += [texts[k], texts[k].upper() + "!"] + [edited(rng, texts[k], s) for s in (0.005, 0.01, 0.02, 0.05)]
    texts += ["one two", "one two", "few words here"]
    got = {r["doc_id"]: r["class_id"] for r in dart_minhash.near_classes(frame(spark, texts)).collect()}
    assert got == brute_links(texts)


def test_variants_about_the_threshold_are_classed_exactly(spark):
    rng = random.Random(17)
    texts = []
    for _ in range(6):  # edited copies of one text, most pairs of which agree 0.75 to 0.85
        base = prose(rng, 160)
        texts += [edited(rng, base, rng.choice([0.014, 0.02, 0.022])) for _ in range(60)]
    want = brute_links(texts)
    assert len(set(want.values())) > 10 and max(collections.Counter(want.values()).values()) > 10
    assert {r["doc_id"]: r["class_id"] for r in dart_minhash.near_classes(frame(spark, texts)).collect()} == want


def test_hot_buckets_are_split_and_stay_exact(spark, monkeypatch):
    """One group holds most rows; blocks and runs are so small that its buckets are cut many times."""
    rng = random.Random(23)
    base = prose(rng, 150)
    texts = [edited(rng, base, rng.choice([0.01, 0.02, 0.03])) for _ in range(150)] + [base] * 40 + [prose(rng, 60) for _ in range(20)]
    monkeypatch.setattr(dart_minhash, "BLOCK_ROWS", 4)
    monkeypatch.setattr(dart_minhash, "RUN", 8)
    assert {r["doc_id"]: r["class_id"] for r in dart_minhash.near_classes(frame(spark, texts)).collect()} == brute_links(texts)


def test_rows_that_share_a_key_or_have_none(spark):
    rng = random.Random(29)
    a, b, c, d = (prose(rng, 60) for _ in range(4))
    rows = [(1, a), (1, a), (2, b), (2, c), (3, c), (None, a), (None, d), (None, d), (None, edited(rng, d, 0.01)), (None, None), (None, " "), (4, None), (4, None), (5, "")]
    docs = spark.createDataFrame([(k, t, "x") for k, t in rows], "doc_id long, text string, __near_key string").repartition(3)
    got = {(r["doc_id"], r["class_id"]) for r in dart_minhash.near_classes(docs).collect()}
    assert got == {(1, 1), (2, 2), (3, 2), (None, None), (4, 4), (5, 5)}
    kept = dart_minhash.keep_one(docs)
    assert kept.columns == docs.columns
    by_key = collections.Counter(r["doc_id"] for r in kept.collect())
    assert by_key == {1: 1, 2: 1, 4: 1, 5: 1, None: 3}  # of the rows without a key: one of the group of d, and the two without words
    named = docs.selectExpr("concat('k', doc_id) AS doc_id", "text")
    assert {(r["doc_id"], r["class_id"]) for r in dart_minhash.near_classes(named).collect()} == {("k1", "k1"), ("k2", "k2"), ("k3", "k2"), (None, None), ("k4", "k4"), ("k5", "k5")}


def test_near_duplicates_recall_on_a_real_table(spark, small):
    """Every pair of sf0.001 at 0.8 or more, found by comparing all pairs that share a shingle."""
    texts = [r["text"] for r in spark.read.parquet(f"{small}/documents.parquet").orderBy("doc_id").collect()]
    got = {r["doc_id"]: r["class_id"] for r in dart_minhash.near_classes(spark.read.parquet(f"{small}/documents.parquet")).collect()}
    assert [got[d] for d in sorted(got)] == [sorted(got)[c] for c in brute_links(texts).values()]


def test_signatures_estimate_weighted_similarity():
    rng = np.random.default_rng(2)
    base = rng.integers(0, 1 << 60, 400).astype(np.uint64)
    a, b = np.concatenate([base, base[:100]]), np.concatenate([base[:300], base[:100], rng.integers(0, 1 << 60, 60).astype(np.uint64)])
    true = weighted_jaccard(collections.Counter(a.tolist()), collections.Counter(b.tolist()))
    sig = dart_minhash.signatures([a, b, a[::-1], base[:1]], 2000)
    assert abs((sig[0] == sig[1]).mean() - true) < 0.05 and (sig[0] == sig[2]).all() and len(set(sig[3].tolist())) == 2000


def test_components(spark):
    rng = random.Random(1)
    edges = [(k, k + 1) for k in range(0, 60)] + [(1000, 1000 + k) for k in range(1, 300)] + [(rng.randrange(2000, 2100), rng.randrange(2000, 2100)) for _ in range(60)]
    got = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    root = {}
    find = lambda x: x if root.setdefault(x, x) == x else find(root[x])
    for a, b in edges:
        ra, rb = find(a), find(b)
        root[max(ra, rb)] = min(ra, rb)
    assert got == {x: find(x) for x in root if find(x) != x}


def brute_spans(texts):
    words = [decontaminate.terms(t) for t in texts]
    own = collections.defaultdict(set)
    for i, w in enumerate(words):
        for k in range(len(w) - 49):
            own[tuple(w[k : k + 50])].add(i)
    out = set()
    for i, w in enumerate(words):
        c = np.zeros(len(w) + 2, int)
        for k in range(len(w) - 49):
            if len(own[tuple(w[k : k + 50])]) > 1:
                c[k + 1 : k + 51] = 1
        d = np.diff(c)
        out |= {(i, int(a), int(b)) for a, b in zip(np.flatnonzero(d == 1), np.flatnonzero(d == -1))}
    return out


@pytest.mark.parametrize("partitions", [3, 150])
def test_shared_passages(spark, partitions):
    rng = random.Random(8)
    hot, other = prose(rng, 60), prose(rng, 51)
    texts = ODD + [prose(rng, rng.randint(10, 90)) + " " + hot + " " + prose(rng, rng.randint(0, 90)) for _ in range(120)]
    texts += [prose(rng, 30) + " " + other + " " + hot[: rng.randint(200, 400)] for _ in range(10)] + [other[:-6], prose(rng, 300)]
    texts += [edited(rng, texts[20], 0.03), texts[21], texts[22] + " " + texts[23], hot, hot + " " + hot]
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {tuple(r) for r in suffix_dedup.repeated_spans(frame(spark, texts)).select("doc_id", "start_word", "end_word").collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 8)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert got == brute_spans(texts)


def test_decontamination(spark):
    rng = random.Random(4)
    items = [prose(rng, 25) + ". " + prose(rng, 8) for _ in range(150)] + ["short item", None, ""]
    texts = ODD + [prose(rng, 300) for _ in range(20)]
    texts += [prose(rng, rng.randint(0, 400)) + " " + items[k].upper() + ", " + prose(rng, 100) for k in range(40)]
    texts += [items[50].rsplit(". ", 1)[0] + " " + prose(rng, 40), prose(rng, 50) + " " + " ".join(items[60:63])]
    table = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.find_leaks(frame(spark, texts), table).collect()}
    plain = [" " + " ".join(decontaminate.terms(t)) + " " for t in texts]
    want = {(d, i) for d, t in enumerate(plain) for i, x in enumerate(items) if decontaminate.terms(x) and " " + " ".join(decontaminate.terms(x)) + " " in t}
    assert want <= got and all(d >= 31 for d, i in got - want) and len(got - want) <= 1
    empty = table.where("false")
    assert decontaminate.find_leaks(frame(spark, texts), empty).count() == 0


def test_edited_items_are_found(spark):
    rng = random.Random(11)
    own = lambda n: [f"{w}{rng.randrange(10**6)}" for w in prose(rng, n).split()]
    items, common = [own(32) + ["end."] + own(k % 8 + 1) for k in range(40)], own(40)
    items += [common + own(10)] + [common[:20] + ["other."] + common[20:]] * 60  # ten rare words at the end of common ones
    edits = [x[:-1] + ["changed"] for x in items[:40]] + [x[:33] for x in items[:40]] + [items[40][:43]]
    texts = [" ".join(own(90) + e + own(70)) for e in edits]
    table = spark.createDataFrame([(k, " ".join(x)) for k, x in enumerate(items)], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.find_leaks(frame(spark, texts), table).collect()}
    runs = lambda words: decontaminate.shingles(decontaminate.terms(" ".join(words)))
    share = {(d, i): len(runs(t.split()) & runs(x)) / len(runs(x)) for d, t in enumerate(texts) for i, x in enumerate(items)}
    assert {p for p, s in share.items() if s >= 0.8} == got and all((k, k) in got for k in range(40)) and (80, 40) in got
    parted = table.where("item_id < 40").selectExpr("item_id", "substring_index(text, 'end.', 1) AS q", "substring_index(text, 'end.', -1) AS a")
    assert not {r["doc_id"] for r in decontaminate.find_leaks(frame(spark, texts), parted, question="q", answer="a", item_text=None).collect()} & set(range(40, 80))


def test_decontamination_against_plain_bm25(spark):
    """Scores and overlaps recomputed in plain Python for every passage and item; a long item does not hide short ones."""
    import math

    rng = random.Random(41)
    items = [prose(rng, 12) + ". " + prose(rng, 6) for _ in range(30)] + [prose(rng, 300) + ". " + prose(rng, 40)]
    texts = [prose(rng, 40) + " " + items[k] + " " + prose(rng, 40) for k in (0, 3, 30)] + [prose(rng, 80), None, items[5]]
    rows = decontaminate.find_leaks(frame(spark, texts), spark.createDataFrame(list(enumerate(items)), "doc_id long, text string"), item_key="doc_id").collect()
    words = [decontaminate.terms(t) for t in items]
    n, mean = len(items), sum(map(len, words)) / len(items)
    df = collections.Counter(w for x in words for w in set(x))

    def impacts(k):
        tf = collections.Counter(words[k])
        own = {w: math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * c * 2.2 / (c + 1.2 * (0.25 + 0.75 * len(words[k]) / mean)) for w, c in tf.items()}
        return {w: v / sum(own.values()) for w, v in own.items()}

    assert {(r["doc_id"], r["item_doc_id"]) for r in rows} == {(0, 0), (1, 3), (2, 30), (5, 5)}
    for r in rows:
        k, text = r["item_doc_id"], decontaminate.terms(texts[r["doc_id"]])
        width = max(128, 2 * len(words[k]))
        held = set(text[r["passage_start"] : r["passage_start"] + width + 200])
        assert r["score"] <= 1 + 1e-9 and r["score"] >= sum(v for w, v in impacts(k).items() if w in held) - 0.2
        assert r["question_overlap"] == r["answer_overlap"] == 1.0
    docs = frame(spark, [*texts, items[7], items[7]]).selectExpr("IF(doc_id < 6, doc_id, NULL) AS doc_id", "text")
    left = decontaminate.drop_leaks(docs, spark.createDataFrame(list(enumerate(items)), "item_id long, text string"))
    assert sorted(r["doc_id"] for r in left.collect()) == [3, 4]


def test_block_max_search_is_exhaustive(monkeypatch):
    rng = random.Random(6)
    items = [(k, prose(rng, 20).split(), prose(rng, 5).split()) for k in range(200)]
    frequency = collections.Counter(w for _, q, a in items for w in {*q, *a})
    index = decontaminate.Index(items, frequency, 200, 25.0)
    queries_, words, want = [], [], set()
    for q in range(30):
        text = items[q * 5][1] + items[q * 5][2] + prose(rng, 60).split()
        ids = {index.numbers[w] for w in text if w in index.numbers}
        scores = np.zeros(200)
        for t, i, v in zip(index.term, index.item, index.impact):
            scores[i] += v * (int(t) in ids)
        want |= {(q, int(i)) for i in np.flatnonzero(scores >= decontaminate.THRESHOLD)}
        queries_ += [q] * len(ids)
        words += list(ids)
    got = index.search(np.array(queries_), np.array(words))
    assert set(zip(got[0].tolist(), got[1].tolist())) == want


def test_item_shards_give_the_same_leaks(spark, monkeypatch):
    rng = random.Random(7)
    items = spark.createDataFrame([(k, prose(rng, 30) + ". " + prose(rng, 9)) for k in range(60)], "item_id long, text string")
    texts = [prose(rng, 50) + " " + r["text"] for r in items.collect()]
    rows = lambda: sorted(map(tuple, decontaminate.find_leaks(frame(spark, texts), items).select("doc_id", "item_id", F.round("score", 6)).collect()))
    whole = rows()
    monkeypatch.setattr(decontaminate, "MOST_ITEM_BYTES", 3000)
    assert rows() == whole and len(whole) >= 60


def test_url_rules(spark):
    urls = [None, "", "no scheme", "http://Example.COM/en/7?x", "http://a.example.com/en/71#f", "https://example.com/en/8", "ftp://com/en/", "http://notcom/en/", "https://x.net/de/8", "https://b.example.net/de/81", "http://x.org/es/", "http://u.org/casino/", "http://u.org/help/casino", "http://u.org/casinos", "a://b://c/d", "http://x.com?/en/"]
    pages = spark.createDataFrame([(i, u, "h") for i, u in enumerate(urls)], "page_id long, url string, host string")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_rules.filter_urls(pages, queries.HOST_RULES + queries.PATTERN_RULES).collect()}
    assert got[0] == got[1] == ("", "", None, "allow") and got[2] == ("", "", None, "allow")
    assert got[3] == ("example.com", "/en/7", "example.com/en/7", "allow") and got[4][2:] == ("example.com/en/7", "allow") and got[5][2:] == ("com/en/", "block")
    assert got[6][2:] == ("com/en/", "block") and got[7][2] is None and got[8][2:] == ("net/de/", "allow") and got[9][2:] == ("example.net/de/8", "block") and got[10][2:] == ("org/es/", "block")
    assert got[11][3] == "block" and got[12][3] == "allow" and got[13][3] == "allow" and got[14][:2] == ("b:", "//c/d") and got[15][1:3] == ("", None)


def test_rule_shards_give_the_same_verdicts(spark, small, monkeypatch):
    pages = spark.read.parquet(f"{small}/pages.parquet")
    rows = lambda: sorted(tuple(r)[:5] for r in url_rules.filter_urls(pages, queries.HOST_RULES + queries.PATTERN_RULES).collect())
    whole = rows()
    monkeypatch.setattr(url_rules, "MOST_RULE_BYTES", 30)
    assert len(url_rules._shards(queries.HOST_RULES + queries.PATTERN_RULES)) > 3 and rows() == whole


def test_rare_token_index_runs_few_rules():
    rules = [url_rules.PatternRule("block", f"/tag{k}/common/", frozenset({f"tag{k}", "common"})) for k in range(100)]
    index = url_rules.RuleIndex(rules, {"common": 1000})
    assert index.judge("http://x.org/tag5/common/")[3:] == (True, False, 1)


def test_quality(spark):
    rows = {r["doc_id"]: r for r in quality.judge(frame(spark, ODD)).collect()}
    assert rows[0]["n_words"] == 0 and rows[0]["base_failed"] and not rows[0]["kept"]
    assert rows[9]["n_dup_lines"] == 1 and rows[10]["n_repeat_words"] == 3000 and rows[10]["base_failed"]
    rng = random.Random(2)
    for n in (4, 5, 6, 40, 300):
        words = [bytes([97 + rng.randrange(3)]) for _ in range(n)]
        seen = collections.Counter(tuple(words[k : k + 5]) for k in range(n - 4))
        held = {k + j for k in range(n - 4) if seen[tuple(words[k : k + 5])] > 1 for j in range(5)}
        assert quality.repeated_words(words) == len(held)
    ledger = quality.ledger(frame(spark, ODD + ["a normal text of more than ten words that nothing at all objects to"]))
    for r in quality.ablations(ledger).collect():
        bit = 1 << next(x.bit for x in quality.RULES if x.name == r["rule"])
        failed = [x["failed"] for x in ledger.collect()]
        masked = [f & quality.POLICIES[quality.LATEST] for f in failed]
        assert (r["n_failed"], r["n_only"], r["n_kept_without"]) == (sum(bool(f & bit) for f in masked), sum(f == bit for f in masked), sum(f & ~bit == 0 for f in masked))


def test_toxicity(spark, small):
    rows = queries.op8_toxicity(spark, "/root/testdata/sf0.1").join(spark.read.parquet("/root/testdata/sf0.1/labels.parquet"), "doc_id").where("held_out").select("score", "toxic", "predicted").toPandas()
    ranks = rows.score.rank()
    n = rows.toxic.sum()
    auc = (ranks[rows.toxic == 1].sum() - n * (n + 1) / 2) / (n * (len(rows) - n))
    assert auc > 0.95 and rows[rows.predicted == 1].toxic.mean() > 0.9
    docs, labels = frame(spark, ODD), spark.createDataFrame([(8, 1), (9, 0), (3, None)], "doc_id long, toxic int")
    got = toxicity.score(docs, toxicity.fit(docs, labels)).collect()
    assert len(got) == len(ODD) and all(0 <= r["score"] <= 1 for r in got)
    with pytest.raises(ValueError, match="too long to learn"):
        toxicity.fit(docs, labels, most_bytes=5)
    model = toxicity.fit(docs, labels.where("false"))
    assert {r["score"] for r in toxicity.score(docs, model).collect()} == {0.0}


def _word_margin(model, word):
    """A plain loop over the word's bag."""
    marked, units = f"<{word}>", [zlib.crc32(word.encode()) % toxicity.BUCKETS]
    for n in range(toxicity.SHORTEST, toxicity.LONGEST + 1):
        for at in range(len(marked) - n + 1):
            h = n
            for c in marked[at : at + n]:
                h = (h * 0x9E3779B97F4A7C15 + ord(c)) % 2**64
            units.append(int(dart_minhash.mixed(np.array([h], np.uint64))[0]) % toxicity.BUCKETS)
    return sum(float(model.margins[u]) for u in units) / len(units)


def test_toxicity_scores_equal_a_plain_loop(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    model = toxicity.fit(docs, spark.read.parquet(f"{small}/labels.parquet"))
    texts = ODD[:-1] + [r["text"] for r in docs.limit(15).collect()]
    known = {}
    for text, got in zip(texts, toxicity.Scorer(model).scores(texts)):
        values = [known.setdefault(w, None) or known.update({w: _word_margin(model, toxicity.bare(w))}) or known[w] for w in toxicity.words_of(text or "")]
        best = max((sum(values[k : k + 2]) / 2 for k in range(len(values) - 1)), default=values[0] if values else 0.0)
        assert abs(got - 1 / (1 + math.exp(-(model.bias + best)))) < 1e-6


def test_a_toxicity_verdict_does_not_depend_on_offsets(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.fit(docs, labels)
    own, moved = (toxicity.score(d, model).select("doc_id", "predicted") for d in (docs, docs.withColumn("text", F.concat(F.lit("the "), "text"))))
    changed = own.join(moved.withColumnRenamed("predicted", "other"), "doc_id").where("predicted <> other").count()
    assert changed <= 0.01 * own.where("predicted = 1").count()


def test_a_very_long_labelled_text_hides_no_other(spark):
    texts = [f"{'bad words here' if i % 2 else 'all is well'} number {i}" for i in range(60)]
    docs, labels = frame(spark, ["bad " * 2000] + texts), spark.createDataFrame([(i, int(i % 2 == 0)) for i in range(61)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels, most_bytes=200_000)
    assert model.constant is None and toxicity.keep_clean(docs, model).count() < 61


def test_line_spread(spark):
    texts = [None, "", "\n \n"] + [f"own {i}\nshared line\nown again {i} with some more letters" for i in range(30)] + ["shared line"] + [f"near {i // 20} and more\nlong own text number {i} of this page" for i in range(30)]
    site = lambda i: f"site{i % 15}" if i < 34 else f"site{(i - 34) % 9}"
    docs = frame(spark, texts, site)
    got = {r["doc_id"]: r for r in line_spread.dedup_lines(docs).collect()}
    assert got[0]["text"] is None and got[0][line_spread.LINES] == 0 and got[1]["text"] == "" and got[2]["text"] == "\n \n"
    assert got[5]["text"] == "own 2\nown again 2 with some more letters" and got[5][line_spread.REMOVED] == 1 and got[5]["score"] == "x"
    assert got[33]["text"] == "" and got[33][line_spread.REMOVED] == 1  # all of it goes
    assert all(got[i][line_spread.REMOVED] == 0 for i in range(34, 64))


def test_pages_that_are_mostly_boilerplate_are_cleaned(spark):
    texts = [f"Home | About | Contact us today\nAll rights reserved by the owners of this site\nSign up for our newsletter\nown {i}" for i in range(40)]
    got = line_spread.dedup_lines(frame(spark, texts, lambda i: f"s{i}")).collect()
    assert all(r["text"] == f"own {r['doc_id']}" and r[line_spread.REMOVED] == 3 for r in got) and len(got) == 40


def test_the_pipeline_cleans_pages_that_are_mostly_boilerplate(spark, small):
    """Distinct pages lose the lines they share; copies of one page on many sites keep theirs, and one copy is left by the next stage."""
    rng = random.Random(8)
    shared = "Home | About us | Contact us today\nAll rights reserved by the owners\nSign up for our newsletter"
    pages = [f"{shared}\n{prose(rng, 9)}" for _ in range(40)]
    copied = "\n".join(prose(rng, 30) for _ in range(4))
    docs = frame(spark, pages + [copied] * 15 + [f"{copied}\nand {i}" for i in range(15)], lambda i: f"s{i}").select("doc_id", "text", F.lit("en").alias("lang"), "source", F.length("text").cast("long").alias("n_chars"))
    cleaned = corpus_pipeline.written(corpus_pipeline.dedup_lines(spark, docs, small), "test")
    got = {r["doc_id"]: r for r in cleaned.collect()}
    assert all(got[i]["text"] == p.rpartition("\n")[2] and got[i]["n_chars"] == len(got[i]["text"]) for i, p in enumerate(pages))
    assert all(got[i]["text"].startswith(copied) for i in range(40, 70))
    left = {r["doc_id"] for r in corpus_pipeline.dedup_documents(spark, cleaned, small).collect()}
    assert set(range(40)) < left and len(left) == 41


def test_the_line_stage_runs_no_python_on_executors(spark, small, monkeypatch):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    for name in ("mapInArrow", "mapInPandas"):
        monkeypatch.setattr(type(docs), name, lambda *_: pytest.fail("Python on executors"))
    assert corpus_pipeline.dedup_lines(spark, docs, small).count() == docs.count()


def test_native_near_copies_agree_with_brute_force(spark):
    """Classes by all pairs of shingle sets: exact and edited copies, chains of edits, short texts, none; a repeated key is one document."""
    rng = random.Random(5)
    texts = [prose(rng, 60) for _ in range(8)]
    for i in range(40):
        words = texts[rng.randrange(len(texts))].split()
        words[rng.randrange(len(words))] = f"new{i}"
        texts.append(" ".join(words))
    texts += [texts[0], texts[0].upper() + " !", "a b", "A, b.", "", None, "..."]
    got = sorted(r[0] for r in near_copies.copied_keys(frame(spark, texts)).collect())
    words = [re.sub(r"[^a-z0-9\s]", "", (t or "").lower()).split() for t in texts]
    sets = [{tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))} if w else set() for w in words]
    root = list(range(len(texts)))
    for _ in texts:
        for a in range(len(texts)):
            for b in range(a):
                if sets[a] and sets[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                    root[a] = root[b] = min(root[a], root[b])
    assert got == [i for i, r in enumerate(root) if r < i] and len(got) > 20
    both = frame(spark, ["x y z", texts[1], texts[1], "u v w"]).withColumn("doc_id", F.when(F.col("doc_id") == 3, 2).otherwise(F.col("doc_id")))
    assert [r[0] for r in near_copies.copied_keys(both).collect()] == [2]


def test_line_spread_keeps_columns_named_like_its_helpers(spark, monkeypatch):
    texts = [f"own {i} with many letters of its own\nline a\nlast {i}" for i in range(12)]
    names = ["__spread_hits", "__spread_all", "__spread_kept", "__spread_key", "__spread_text"]
    docs = frame(spark, texts, lambda i: f"s{i}").select("doc_id", "text", "source", *[F.lit(n).alias(n) for n in names])
    for most in (20_000, 0):
        monkeypatch.setattr(line_spread, "MOST_LITERALS", most)
        got = line_spread.dedup_lines(docs).collect()
        assert len(got) == 12 and all(r[n] == n for r in got for n in names) and all(r[line_spread.REMOVED] == 1 for r in got)


def test_pairs_of_blocks_of_one_bucket_are_spread(spark, monkeypatch):
    counts = {7: (20, 3), 8: (1, 1)}
    rows = [(7, True, p, f"t{p}") for p in range(20)] + [(7, False, p, f"f{p}") for p in range(3)] + [(8, True, 0, "x"), (8, False, 0, "y")]
    blocks = spark.createDataFrame([(b, o, p, *counts[b], r) for b, o, p, r in rows], "_bucket long, _other boolean, _part long, _others long, _mains long, _rows string")
    want = {(7, f"t{a}", f"t{b}") for a in range(20) for b in range(a, 20)} | {(7, f"t{a}", f"f{b}") for a in range(20) for b in range(3)} | {(8, "x", "x"), (8, "x", "y")}
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for at_once, least in ((16, 2), (4, 5)):
            monkeypatch.setattr(dart_minhash, "BLOCKS_AT_ONCE", at_once)
            got = dart_minhash.block_pairs(blocks).select("_bucket", "_left", "_right", F.spark_partition_id().alias("at")).collect()
            assert sorted((r["_bucket"], r["_left"], r["_right"]) for r in got) == sorted(want)
            assert len({r["at"] for r in got if r["_bucket"] == 7}) >= least
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_token_counts_refuse_a_file_with_another_pattern():
    with pytest.raises(ValueError, match="byte-level pattern"):
        token_count.TokenCounter(WORDS)


def test_line_spread_joins_long_lists(spark, monkeypatch):
    texts = [f"own {i} with many letters of its own\nline a\nline b\nlast {i}" for i in range(12)]
    docs = frame(spark, texts, lambda i: f"s{i}")
    few = sorted(map(tuple, line_spread.dedup_lines(docs).select("doc_id", "text", line_spread.REMOVED).collect()))
    monkeypatch.setattr(line_spread, "MOST_LITERALS", 1)
    assert sorted(map(tuple, line_spread.dedup_lines(docs).select("doc_id", "text", line_spread.REMOVED).collect())) == few and few[0][2] == 2


def test_empty_tables(spark):
    docs = frame(spark, ["x"]).where("false")
    for df in (token_count.count_tokens(docs, BYTES), packing.pack(docs, WORDS), quality.judge(docs), line_spread.dedup_lines(docs), dart_minhash.near_classes(docs), suffix_dedup.repeated_spans(docs), token_file.read_ids(token_file.write_ids(docs, WORDS))):
        assert df.count() == 0


def test_pipeline(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    columns, known = docs.columns, {r["doc_id"]: r["text"] for r in docs.collect()}
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.written(stage(spark, docs, small), "test")
        assert docs.columns == columns
        assert {r["doc_id"] for r in docs.collect()} <= set(known)
    kept = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert decontaminate.find_leaks(docs, spark.read.parquet(f"{small}/benchmark.parquet")).count() == 0
    assert len(set(brute_links([kept[d] for d in sorted(kept)]).values())) == len(kept)
    rows = corpus_pipeline.STAGES[-1][1](spark, docs, small).collect()
    check_packing(rows, {d: [*library_ids(t), 2] for d, t in kept.items()})
    assert {r["doc_id"] for r in corpus_pipeline.run(spark, small).collect()} == set(kept)


def test_pipeline_stages_take_odd_rows(spark, small):
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, frame(spark, ODD).unionByName(frame(spark, ODD[:3])), small).count() > 0
        assert stage(spark, frame(spark, ["x"]).where("false"), small).count() == 0


def test_bags_of_a_batch_are_held_a_part_at_a_time(monkeypatch):
    import numpy as np
    from tidemark.llm import toxicity

    words = [f"word{k}" for k in range(35)]
    model = toxicity.Model(np.random.default_rng(0).normal(0, 1, toxicity.BUCKETS), 0.0)
    whole, sizes, plain = model.of_words(words), [], toxicity.bags
    monkeypatch.setattr(toxicity, "WORDS_AT_ONCE", 10)
    monkeypatch.setattr(toxicity, "bags", lambda some: sizes.append(len(some)) or plain(some))
    assert (model.of_words(words) == whole).all() and sizes == [10, 10, 10, 5]
    assert len(model.of_words([])) == 0


def test_leaders_leave_a_task_in_bounded_batches():
    """Signatures are sliced from the array, not held as objects beside it, and a worker's memory of words is bounded."""
    n = 2 * dart_minhash.EMITTED + 7
    sig = np.arange(n * dart_minhash.COORDINATES, dtype=np.uint64).astype(np.uint8).reshape(n, -1)
    leads = np.arange(n) % 3 > 0
    out = list(dart_minhash._emit(np.arange(n), np.arange(n) * 2, sig, leads, [(0, 1)]))
    rows = [b for b in out if b.column(3).null_count == 0]
    assert max(b.num_rows for b in out) <= dart_minhash.EMITTED and sum(b.num_rows for b in rows) == leads.sum()
    assert [x for b in rows for x in b.column(3).to_pylist()] == [x.tobytes() for x in sig[leads]]
    assert [x for b in rows for x in b.column(1).to_pylist()] == (np.flatnonzero(leads) * 2).tolist() and out[-1].column(2).to_pylist() == [2]
    words = dart_minhash._WordHashes()
    for i in range(dart_minhash.MOST_WORDS + 10):
        words[f"w{i}"]
    assert len(words) == 10

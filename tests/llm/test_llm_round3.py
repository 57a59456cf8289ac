"""The prefix trie, packing and ranked search on odd tables, against brute force in plain Python."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from check import compare, connect
from pairwell.llm import packing, prefix_trie, queries, ranked_search

SF = "/root/testdata/sf0.001"
BPE = public_tokenizers.path("byte_bpe_50k.json")
TURNS = "conv_id long, turn long, role string, text string, digest int, pos string, c double, words string"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_trie(rows, every=20, most=4):
    own = defaultdict(list)
    for c, turn, role, text, *_ in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    turns = {c: [t[2:] for t in sorted(v)] for c, v in own.items()}
    nodes = defaultdict(list)
    for c in turns:
        h = zlib.crc32(str(c).encode()) % most
        seq = tuple(turns.get(c - math.fmod(c, every), [])[:h] + turns[c][h:])
        for d in range(len(seq) + 1):
            nodes[seq[:d]].append((c, len(seq)))
    children = Counter(k[:-1] for k in nodes if k)
    saved, leaves = Counter(), Counter()
    for k, v in nodes.items():
        words = len(re.findall(r"[^\x20\x09-\x0D]+", k[-1][1])) if k else 0
        for d in range(len(k) + 1):
            saved[k[:d]] += (len(v) - 1) * words
            leaves[k[:d]] += children[k] == 0
    least = {k: min(c for c, _ in v) for k, v in nodes.items()}
    ends = {k: ",".join(str(c) for c in sorted(c for c, n in v if n == len(k))) for k, v in nodes.items()}
    return Counter((least[k], len(k), least[k[:-1]] if k else None, len(v), children[k], leaves[k], saved[k], hashlib.sha256(ends[k].encode()).hexdigest()) for k, v in nodes.items())


def trie_rows(seed):
    rng = random.Random(seed)
    rows = []
    for c in [*range(45), 60, 61, 79, 200, 1003, -5]:
        length = rng.choice([0, 1, 1, 2, 3, 5, 8, 9, 17, 33])
        start = [("user", "hello there"), (None, "a\tb  c"), ("user", None), ("", "")][: rng.randrange(5)]
        turns = [*start, *[(rng.choice(["user", "assistant"]), rng.choice(["x", "yes no", "é  ü", "w " * 40])) for _ in range(length)]]
        for i, (role, text) in enumerate(turns or [("user", "only")]):
            rows.append((c, None if i == 0 and c % 7 == 0 else i // 2 if c % 5 == 0 else i, role, text, 1, "p", 2.0, "w"))
    same = [(300 + i, j, "user", f"turn {j}", 1, "p", 2.0, "w") for i in range(30) for j in range(6)]  # copies
    return [*rows, *same, rows[3], rows[3], (None, 1, "user", "lost", 1, "p", 2.0, "w")]


@pytest.mark.parametrize("seed", [1, 2])
def test_trie_is_that_of_brute_force(spark, monkeypatch, seed):
    monkeypatch.setattr(prefix_trie, "CHUNK_IDS", 4)
    rows = trie_rows(seed)
    random.Random(seed).shuffle(rows)
    turns = prefix_trie.ordered(spark.createDataFrame(rows, TURNS).repartition(5))
    got = prefix_trie.prefix_trie(*prefix_trie.spliced(turns))
    assert Counter(map(tuple, got.collect())) == brute_trie(rows)


def test_trie_of_nothing_of_no_turns_and_of_one_turn(spark):
    for rows in ([], [(2, 0, "user", "gone", 1, "p", 2.0, "w")], [(20, 0, "user", "a b", 1, "p", 2.0, "w")], [(None, 0, "user", "a", 1, "p", 2.0, "w")]):
        turns = prefix_trie.ordered(spark.createDataFrame(rows, TURNS))
        assert Counter(map(tuple, prefix_trie.prefix_trie(*prefix_trie.spliced(turns)).collect())) == brute_trie(rows)
    assert zlib.crc32(b"2") % 4 > 0  # the second table's only conversation is left without turns


def test_trie_of_plain_conversations(spark):
    rows = [(c, i, "user", f"t{min(i, c)}", 1, "p", 2.0, "w") for c in range(4) for i in range(70)]
    turns = prefix_trie.ordered(spark.createDataFrame(rows, TURNS))
    got = prefix_trie.prefix_trie(turns, turns.select("conv_id").distinct())
    root = got.where("depth = 0").first()
    assert (root["n_convs"], root["n_children"], root["n_leaves"], got.count()) == (4, 1, 4, 1 + 70 + 69 + 68 + 67)


@pytest.mark.parametrize("name", ["op11_prefix_trie", "op13_ranked_search"])
def test_queries_equal_their_sql(spark, name):
    ok, message = compare(spark, connect(SF), name, SF)
    assert ok, message


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    texts = [" ".join(f"w{rng.randrange(900)}" for _ in range(rng.choice([1, 5, 30, 200, 700]))) for _ in range(60)]
    return [*texts, None, "", "<|endoftext|> it's", "é" * 3000, "word " * 9000, texts[0], texts[0]]


def placed(pieces):
    """The rows of a packing, after its rules are checked: every document whole, offsets without gaps, tokens as the library has them."""
    rows = pieces.collect()
    of_doc, of_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        of_doc[r["row"]].append(r)
        of_seq[r["sequence_id"]].append(r)
    for v in of_doc.values():
        at = 0
        for r in sorted(v, key=lambda r: r["start"]):
            assert r["start"] == at and r["length"] > 0
            at += r["length"]
        assert at == v[0]["doc_tokens"]
    for v in of_seq.values():
        at = 0
        for r in sorted(v, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert {r["window"] for r in v} == {at}
    return rows, of_doc, of_seq


@pytest.mark.parametrize("parts,fan_in,block", [(1, 64, 1 << 20), (9, 2, 3000), (5, 64, 500)])
def test_packing_keeps_every_token_and_pads_once(spark, texts, parts, fan_in, block):
    docs = spark.createDataFrame([(i if i != 7 else None, t, 1, "x") for i, t in enumerate(texts)], "doc_id long, text string, row int, part string").repartition(parts)
    made = packing.TOKENS | {"ids_crc32": ("long", queries._crc32)}
    rows, of_doc, of_seq = placed(packing.pack(docs, BPE, fan_in=fan_in, block_tokens=block, made=made))
    whole = Tokenizer.from_file(BPE)
    want = Counter(tuple([*whole.encode(t or "", add_special_tokens=False).ids, 1]) for t in texts)
    got = Counter()
    for v in of_doc.values():
        raw = b"".join(bytes(r["ids"]) for r in sorted(v, key=lambda r: r["start"]))
        got[tuple(int.from_bytes(raw[i : i + 4], "little") for i in range(0, len(raw), 4))] += 1
    assert got == want
    assert all(zlib.crc32(bytes(r["ids"])) == r["ids_crc32"] for r in rows)
    odd = [v for v in of_seq.values() if v[0]["window"] not in packing.TIERS]
    assert len(odd) <= 1 and all(v[0]["window"] < packing.TIERS[0] for v in odd)


def test_packing_of_nothing_and_of_one_empty_text(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert packing.pack(none, BPE).collect() == [] and packing.step_groups(packing.pack(none, BPE)).collect() == []
    one = packing.pack(spark.createDataFrame([(None, None)], "doc_id long, text string"), BPE).collect()
    assert [(r["doc_id"], r["start"], r["length"], bytes(r["ids"])) for r in one] == [(None, 0, 1, b"\1\0\0\0")]


def test_packing_prefers_whole_documents(spark):
    docs = spark.createDataFrame([(i, "the " * n) for i, n in enumerate([1500, 400, 145, 999, 22] * 8)], "doc_id long, text string").coalesce(1)
    rows, of_doc, _ = placed(packing.pack(docs, BPE))
    assert sum(len(v) == 1 for v in of_doc.values()) >= 0.7 * len(of_doc)


def test_steps_are_balanced(spark):
    pieces = spark.range(1000).select(F.floor(F.col("id") / 2).alias("sequence_id"), F.when(F.col("id") < 600, 2048).otherwise(512).cast("long").alias("window"), (F.col("id") % 97 + 1).alias("length"))
    steps = packing.step_groups(pieces, 1 << 14).groupBy("step", "window").agg(F.count(F.lit(1)).alias("n"), F.sum("cost").alias("cost")).collect()
    for window in (2048, 512):
        tier = [r for r in steps if r["window"] == window]
        assert max(r["n"] for r in tier) - min(r["n"] for r in tier) <= 1 and all(r["n"] * window <= 1 << 14 for r in tier)
        assert max(r["cost"] for r in tier) < 1.2 * min(r["cost"] for r in tier)
    assert sorted(r["step"] for r in steps) == list(range(len(steps)))


def split(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def brute_search(docs, items, k):
    counts = [(d, Counter(split(t))) for d, t in docs if split(t)]
    n_docs, n_terms = len(counts), sum(sum(c.values()) for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    out = []
    for i, text in sorted(set(items), key=str):
        scored = []
        for d, c in counts:
            m = 100 - 25 + (25 * sum(c.values()) * n_docs) // n_terms
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 12 * m)) for t in split(text) if t in c)
            if score > 0:
                scored.append((-score, d is None, d or 0, d))
        out += [(i, r, d, -s) for r, (s, _, _, d) in enumerate(sorted(scored)[:k], 1)]
    return Counter(out)


@pytest.mark.parametrize("exact,groups,fan_in", [(1 << 53, 4 << 20, 256), (1, 300, 2)])
def test_search_is_that_of_brute_force(spark, monkeypatch, exact, groups, fan_in):
    monkeypatch.setattr(ranked_search, "EXACT", exact)
    monkeypatch.setattr(ranked_search, "FAN_IN", fan_in)
    monkeypatch.setattr(ranked_search, "CELLS", 40)
    rng = random.Random(8)
    word = lambda: rng.choice(["the", "THE", "Éa", "ß", "x1", *[f"w{rng.randrange(300)}" for _ in range(4)]])
    docs = [(i, rng.choice([" ", ", ", "\n", "-"]).join(word() for _ in range(rng.choice([1, 4, 20, 60])))) for i in range(150)]
    docs += [(200, None), (201, ""), (202, "?!"), (None, "the x1"), (5, docs[5][1]), (5, docs[5][1]), (203, "the " * 3000), (204, "w1" * 4000)]
    items = [(i, " ".join(word() for _ in range(12))) for i in range(9)] + [(50, None), (51, "..."), (52, "nowhere"), (53, "the the THE w1"), (0, "x1")]
    items.append(items[0])
    frame = spark.createDataFrame([(*d, 1, "y", 2) for d in docs], "doc_id long, text string, score int, item string, rank int").repartition(7)
    given = spark.createDataFrame([(*i, 3, 4) for i in items], "item_id long, text string, doc_id int, terms int")
    got = ranked_search.search(frame, given, k=6, item_bytes=groups, batch_bytes=500)
    assert Counter(map(tuple, got.collect())) == brute_search(docs, items, 6)


def test_search_of_nothing(spark):
    docs, items = spark.createDataFrame([(1, "a b")], "doc_id long, text string"), spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert ranked_search.search(docs.where("false"), items).collect() == []
    assert ranked_search.search(docs, items.where("false")).collect() == []
    assert [tuple(r)[:3] for r in ranked_search.search(docs, items).collect()] == [(1, 1, 1)]

"""The numpy kernels of the operators against plain Python."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from pairwell.llm import bpe, lattice, leaks, ngram_join, quality, token_counts, topk, warc
from pairwell.llm.pretokens import by_bytes, column_bytes, safe_pieces

PATH = public_tokenizers.path("byte_bpe_50k.json")
SIGNS = ["a", "b", " ", "  ", "\n", "\t", "'", "'s", "'re", "'ll", "don't", "I'M", "é", "ß", "漢字", "😀", " ", "　", "1", "٣", "²", "!", "...", "<|endoftext|>", "<|", "aaaaaaa", "\x00", "\x1c", "\x85", "ing", "the", " the", "_"]


def texts(n, seed=1):
    rng = random.Random(seed)
    return ["".join(rng.choice(SIGNS) for _ in range(rng.randrange(30))) for _ in range(n)] + ["", "a" * 3000, " " * 500, "x y" * 200, "'" * 50]


def test_bpe_is_the_library():
    whole, v = Tokenizer.from_file(PATH), bpe.vocabulary(PATH)
    many = texts(3000)
    data, offsets = column_bytes(pa.array(many))
    ids, ends = bpe.encode_batch(v, data, offsets)
    want = [whole.encode(t, add_special_tokens=False).ids for t in many]
    assert [ids[a:b].tolist() for a, b in zip(ends[:-1], ends[1:], strict=True)] == want
    assert bpe.decode_batch(v, ids, ends) == [whole.decode(w, skip_special_tokens=False) for w in want] == many


def test_bpe_decodes_broken_bytes_like_the_library():
    v, whole = bpe.vocabulary(PATH), Tokenizer.from_file(PATH)
    ids = np.array(whole.encode("漢字", add_special_tokens=False).ids[:1], np.uint32)
    assert bpe.decode_batch(v, ids, np.array([0, 1])) == [whole.decode(ids.tolist(), skip_special_tokens=False)]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"])
def test_counts_are_the_library(name):
    path = public_tokenizers.path(name)
    count, may_cut = token_counts.counter(path)
    many = texts(500, 2)
    if name.endswith(".model"):
        import sentencepiece

        want = [len(x) for x in sentencepiece.SentencePieceProcessor(model_file=path).encode(many)]
    else:
        want = [len(x) for x in Tokenizer.from_file(path).encode_batch(many, add_special_tokens=False)]
    assert count(many) == want
    assert may_cut == (name == "byte_bpe_50k.json")


def test_pieces_are_safe_and_whole():
    count, _ = token_counts.counter(PATH)
    long = " ".join(texts(400, 3))
    for size in (1, 7, 100):
        pieces = safe_pieces(long, size)
        assert "".join(pieces) == long and len(pieces) > 10
        assert sum(count(pieces)) == count([long])[0]


def test_rows_by_bytes():
    data, offsets = column_bytes(pa.array(["aa", None, "bbbbbb", "", "c"]))
    assert bytes(data) == b"aabbbbbbc"
    assert list(by_bytes(offsets, 3)) == [(0, 2), (2, 4), (4, 5)] or list(by_bytes(offsets, 3))[-1][1] == 5
    assert list(by_bytes(np.zeros(1, np.int64), 3)) == []


def test_topk_is_exact():
    rng = np.random.default_rng(0)
    rows = rng.integers(-300, 300, (700, 9))
    rows[50:400] = rows[50]
    ids = np.sort(rng.choice(10_000, 700, replace=False))
    slices, low = topk.sliced(rows)
    for q in [0, 50, 51, 399, 500, 699]:
        got, score = topk.block_top(slices, low, ids, ids[q], rows[q], 5)
        want = sorted((-int(s), int(i)) for s, i in zip(rows @ rows[q], ids, strict=True) if i != ids[q])[:5]
        assert sorted((-int(s), int(i)) for s, i in zip(score, got, strict=True)) == want
    one, low = topk.sliced(np.zeros((2, 3), np.int64))
    assert topk.block_top(one, low, np.array([4, 9]), 4, np.array([0, -7, 3]), 5)[0].tolist() == [9]


def test_quantised_floor():
    assert topk.quantised(pa.array([[-0.001, 0.5, 1 / 256]], pa.list_(pa.float64()))).tolist() == [[-1, 128, 1]]


def test_lattice_sums_all_segmentations():
    p = lattice.pieces(public_tokenizers.path("piece_bpe_32k.model"))
    words = [b"the", b"tionthand", "éaux".encode(), b"a", b"x" * 40, b"!%"]

    def total(s, memo):  # over all first pieces
        if not s:
            return 1.0
        if s not in memo:
            node, memo[s] = 0, 0.0
            for i, b in enumerate(s):
                node = p.child[node, b]
                if not node:
                    break
                if p.ends[node] >= 0:
                    memo[s] += p.prior[p.ends[node]] * total(s[i + 1 :], memo)
        return memo[s]

    offsets = np.concatenate([[0], np.cumsum([len(w) for w in words])])
    data = np.frombuffer(b"".join(words), np.uint8)
    assert np.allclose(lattice.word_scores(p, p.prior, data, offsets), [np.log(total(b" " + w, {})) for w in words])
    counts = lattice.expected(p, p.prior, data, offsets, np.ones(len(words)))
    assert counts[p.opens].sum() == pytest.approx(len(words))  # each segmentation opens one word
    assert p.prior.sum() == pytest.approx(1)


def test_words_and_grams():
    many = ["A b  c\n", "", "a B", " \t", "É é", "a b c d a b c", "x"]
    data, offsets = column_bytes(pa.array(many))
    words, codes, sizes = lattice.words_of(data, offsets)
    names = [w.decode() for w in lattice._trimmed(words).to_pylist()]
    at = np.concatenate([[0], np.cumsum(sizes)])
    assert [[names[c] for c in codes[a:b]] for a, b in zip(at[:-1], at[1:], strict=True)] == [["a", "b", "c"], [], ["a", "b"], [], ["É", "é"], list("abcdabc"), ["x"]]
    grams, ends = ngram_join.gram_sets(data, offsets, 3)
    assert np.diff(ends).tolist() == [1, 0, 1, 0, 1, 4, 1]
    assert grams[ends[0]] in grams[ends[5] : ends[6]]


def test_bitmaps_never_exceed_the_difference():
    rng = random.Random(5)
    for n in (3, 90, 700):
        words = [f"w{rng.randrange(10**6)}" for _ in range(n)]
        other = [w if rng.random() > 0.05 else f"v{rng.randrange(10**6)}" for w in words] + ["z"] * rng.randrange(n)
        data, offsets = column_bytes(pa.array([" ".join(words), " ".join(other)]))
        grams, ends = ngram_join.gram_sets(data, offsets, 3)
        a, b = set(grams[: ends[1]].tolist()), set(grams[ends[1] :].tolist())
        for share in (0.5, 2):
            maps = ngram_join._bitmaps(grams, ends, share)
            assert ngram_join.differing(maps.slice(0, 1), maps.slice(1, 1))[0] <= len(a ^ b)


def edit_distance(item, text):
    row = [0] * (len(text) + 1)
    for i, a in enumerate(item, 1):
        new = [i]
        for j, b in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (a != b)))
        row = new
    return min(row)


def test_edit_distance():
    rng = random.Random(3)
    for _ in range(200):
        a, b = (bytes(rng.choice(b"ab ") for _ in range(rng.randrange(lo, hi))) for lo, hi in ((1, 12), (0, 20)))
        assert leaks.distance(a, b, 99) == edit_distance(a, b)
    assert leaks.distance(b"abcdefgh", b"zzzz", 3) == 4


def prose(rng, words):
    return " ".join("".join(rng.choice(["th", "er", "on", "an", "in", "re", "ti", "es", "st"]) for _ in range(rng.randrange(1, 4))) for _ in range(words))


def recall(items, hosts, rate=0.2):
    """(share of hosts in which the item of the same place is found, all that is found), after the distances are checked."""
    ready = leaks.prepared(items, rate)
    got = leaks.found(ready, *column_bytes(pa.array(hosts)), rate)
    plain = [bytes(leaks.normal(d, o[1:])[0]) for d, o in (column_bytes(pa.array([h])) for h in hosts)]
    assert all(leaks.distance(ready.texts[k], plain[t], len(ready.texts[k])) <= d <= int(rate * len(ready.texts[k])) for t, x in got.items() for k, d in x.items())
    true = [i for i, t in enumerate(ready.texts) if leaks.distance(t, plain[i], len(t)) <= int(rate * len(t))]
    return sum(i in got.get(i, {}) for i in true) / len(true), got


@pytest.mark.parametrize("size", [40, 45, 60, 100, 200, 400])
def test_leaks_are_found_at_every_edit_rate(size):
    rng = random.Random(size)
    items = [(i, prose(rng, 120)[:size].strip()) for i in range(120)]

    def host(text, rate):
        raw = text.encode()
        return f"{prose(rng, 30)} {leaks.edited(rng, raw, int(rate * len(raw))).decode('utf-8', 'ignore').upper()}\n {prose(rng, 30)}"

    for rate, least in ((0, 1.0), (0.05, 0.98), (0.1, 0.97), (0.15, 0.93), (0.2, 0.9)):
        assert recall(items, [host(x, rate) for _, x in items])[0] >= least, rate


def test_limits_come_from_all_items(monkeypatch):
    rng = random.Random(6)
    items = [(i, f"{i:02d} {prose(rng, 120)[:97].strip()}") for i in range(60)]
    true, tried = leaks.edited, Counter()

    def edited(rng, text, edits):
        tried[text] += 1
        return true(rng, text, edits)

    monkeypatch.setattr(leaks, "edited", edited)
    ready = leaks.prepared(items)
    assert set(tried) == set(ready.texts) and min(tried.values()) >= 16 and tried.total() >= 384


def test_leaks_in_unspaced_text_and_glued_to_signs():
    rng = random.Random(2)
    signs = [chr(0x4E00 + i) for i in range(400)]
    run = lambda n: "".join(rng.choice(signs) for _ in range(n))
    items = [(i, run(27)) for i in range(60)]
    assert recall(items, [run(50) + x + run(50) for _, x in items])[0] == 1
    latin = [(i, prose(rng, 8)[:45].strip()) for i in range(100)]
    for a, b in (('"', '"'), ("(", ")"), ("\u2014", "."), ("x", "x")):
        assert recall(latin, [f"{prose(rng, 20)} {a}{x}{b} {prose(rng, 20)}" for _, x in latin])[0] == 1


def test_leaks_of_short_items_and_none_in_clean_text():
    rng = random.Random(7)
    items = [(i, prose(rng, rng.randrange(12, 60))) for i in range(150)]
    clean = [prose(rng, 200) for _ in range(50)] + [""]
    ready = leaks.prepared([*items, (900, "Zq 7"), (901, "zq  7"), (902, "")])
    assert leaks.found(ready, *column_bytes(pa.array(clean)), 0.2) == {}
    got = leaks.found(ready, *column_bytes(pa.array(["a zq\n7", "", "zq 7 zq 7", "zq7"])), 0.2)
    assert got == {0: {150: 0, 151: 0}, 2: {150: 0, 151: 0}}
    assert leaks.found(leaks.prepared([]), *column_bytes(pa.array(clean)), 0.2) == {}


def test_classifier_learns_words_parts_and_stammer():
    rng = random.Random(2)
    good = [prose(rng, 80) for _ in range(120)]
    bad = [prose(rng, 40).upper() for _ in range(40)] + [" ".join([prose(rng, 1)] * 40) for _ in range(40)]
    model = quality.train(good[:80] + bad[:30] + bad[40:70], [1] * 80 + [0] * 60)
    data, offsets = column_bytes(pa.array([*good[80:], *bad[30:40], *bad[70:], "", None, " \n"]))
    got = quality.scores(model, data, offsets)
    assert (got[:40] > 0.5).all() and (got[40:60] < 0.5).mean() > 0.9 and len(set(got[60:])) == 1
    assert quality.train([], []).bias == 0 and quality.train(["a"], [1]).bias > 0


def plain_features(text, bits):
    """The features of one text as the docstring tells them, one after the other."""
    mix, top, shift = 0x9E3779B1, 1 << 32, 32 - bits
    words = re.findall(rb"[^\x20\x09-\x0D]+", text)
    names = [sum((b + 1) * pow(mix, k + 1, top) for k, b in enumerate(w)) % top for w in words]
    out = [((n ^ 0x5BD1E995) * mix % top) >> shift for n in names]
    for a, b in zip(names, names[1:]):
        out.append(((0x2545F491 if a == b else (a * mix + b) % top) * mix % top) >> shift)
    for w in words:
        edged = [0, *[b + 1 for b in w], 0]
        for size in (3, 4, 5):
            for i in range(len(edged) - size + 1):
                n = edged[i]
                for k, v in enumerate(edged[i + 1 : i + size], 2):
                    n = (n * mix + v + k) % top
                out.append((n * mix % top) >> shift)
    return out


def test_classifier_scores_are_those_of_plain_sums():
    rng = random.Random(4)
    model = quality.train([prose(rng, 30) for _ in range(20)] + [prose(rng, 5) * 6 for _ in range(20)], [1] * 20 + [0] * 20, bits=10)
    many = [*[prose(rng, rng.randrange(1, 50)) for _ in range(30)], "a", "a a", "é ß\t\n x", "word " * 300, ""]
    got = quality.scores(model, *column_bytes(pa.array(many)))
    for text, score in zip(many, got, strict=True):
        ids = plain_features(text.encode(), 10)
        mean = np.mean(model.vectors[ids].astype(np.float64), axis=0) if ids else np.zeros(model.vectors.shape[1])
        logits = model.weights.astype(np.float64) @ mean
        assert score == pytest.approx(1 / (1 + np.exp(-(logits[1] - logits[0] + model.bias))), abs=1e-5)


def test_warc_frames_and_records():
    rows = [warc.record_bytes(i, u, p, hashlib.sha1(p).digest(), r, "2020-01-01T00:00:00Z") for i, u, p, r in ((1, "http://x/ ä", b"<p>\r\n\r\n</p>", None), (2, None, b"", None), (None, "u", b"q", 7))]
    got = list(warc.parsed(b"".join(rows)))
    assert [(r.page_id, r.url, r.record_type, r.refers_to, r.payload_bytes, r.payload) for r in got] == [
        (1, "http://x/%20%C3%A4", "response", None, 11, b"<p>\r\n\r\n</p>"), (2, None, "response", None, 0, b""), (None, "u", "revisit", 7, 1, None)
    ]
    assert all(re.fullmatch("[A-Z2-7]{32}", r.payload_digest) for r in got)
    broken = rows[0].replace(b"<p>", b"<q>")
    with pytest.raises(ValueError):
        list(warc.parsed(broken))

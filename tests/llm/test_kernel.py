import random
import re

import numpy as np
import pyarrow as pa

from lexgrove.llm import near_dedup, quality
from lexgrove.llm.textkernel import PRIME, Words, powers, segment_hash, slices, whole_windows, window_hash

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def test_words_match_the_pattern_and_equal_words_hash_alike():
    rng = random.Random(1)
    texts = ["".join(rng.choice("ab é\t\n\x0b\x0c\r 　") for _ in range(rng.randrange(0, 60))) for _ in range(300)]
    w = Words(pa.array(texts))
    found = [bytes(w.data[a:b]).decode() for a, b in zip(w.starts, w.ends)]
    assert found == [x for t in texts for x in WORD.findall(t)]
    assert w.counts.tolist() == [len(WORD.findall(t)) for t in texts]
    by_word = {}
    for x, h in zip(found, w.hashes.tolist()):
        assert by_word.setdefault(x, h) == h
    assert len(set(by_word.values())) == len(by_word)


def test_hashes_do_not_depend_on_place_or_batch():
    texts = ["x " * i + "needle in hay" for i in range(50)]
    whole = Words(pa.array(texts))
    last = whole.hashes[whole.first[1:] - 1]
    assert len(set(last.tolist())) == 1
    parts = np.concatenate([Words(pa.array(texts).slice(i, j - i)).hashes for i, j in slices(pa.array(texts), 100)])
    assert (parts == whole.hashes).all()


def test_windows_stay_in_their_row():
    w = Words(pa.array(["a b c", "", "d e", "f g h i"]))
    at = np.flatnonzero(whole_windows(w.first, 3, len(w.hashes)))
    assert at.tolist() == [0, 5, 6]
    assert len(window_hash(w.hashes, 3)) == 7
    assert len(window_hash(w.hashes, 20)) == 0


def test_windows_do_not_depend_on_blocks(monkeypatch):
    from lexgrove.llm import textkernel

    h = np.random.default_rng(5).integers(0, 2**64, 1000, dtype=np.uint64)
    whole = window_hash(h, 20)
    monkeypatch.setattr(textkernel, "WINDOW_BLOCK", 7)
    assert (window_hash(h, 20) == whole).all() and len(whole) == 981 and len(window_hash(h[:19], 20)) == 0


def doubling(n, a, b):
    """The sequence that defeats every polynomial modulo a power of two, and its complement."""
    bits = [bin(i).count("1") & 1 for i in range(n)]
    return [b if x else a for x in bits], [a if x else b for x in bits]


def test_doubling_patterns_have_hashes_of_their_own():
    x, y = doubling(2048, "a", "b")
    w = Words(pa.array(["".join(x), "".join(y)]))
    assert len(w.hashes) == 2 and w.hashes[0] != w.hashes[1]
    w = Words(pa.array([" ".join(x), " ".join(y)]))
    assert len(set(window_hash(w.hashes, 2048)[[0, 2048]].tolist())) == 2
    assert len(set(near_dedup.copy_keys(pa.array([" ".join(x), " ".join(y), "", " ".join(x) + "\n"])))) == 3
    out, _ = quality.judge(pa.array([" ".join(x) + "\n" + " ".join(y), " ".join(x) + "\n" + " ".join(x)]))
    assert out["n_dup_lines"].tolist() == [0, 1]


def test_lines_are_compared_by_content(monkeypatch):
    monkeypatch.setattr(quality, "segment_hash", lambda codes, a, b: np.zeros(len(a), np.uint64))
    out, _ = quality.judge(pa.array(["one\ntwo\none\n\ntwo", "one\nthree"]))
    assert out["n_dup_lines"].tolist() == [2, 0]


def test_segment_hash_is_the_polynomial():
    p = int(PRIME)
    codes = np.random.default_rng(2).integers(0, 2**64, 50, dtype=np.uint64)
    base = 0x123456789ABCDEF1
    up, down = powers(60, 7)
    assert all(int(u) * int(v) % p == 1 for u, v in zip(up[:60], down[:60]))
    seen = {}
    for a in range(50):
        for b in range(a, 51):
            key = [sum((int(c) >> 31 * half & p) * pow((base >> 31 * half) % (p - 3) + 2, i, p) for i, c in enumerate(codes[a:b])) % p for half in (0, 1)]
            h = int(segment_hash(codes, np.array([a]), np.array([b]), base)[0])
            assert seen.setdefault((b - a, *key), h) == h
    assert len(set(seen.values())) == len(seen)

"""Rows and plain versions that several tests use."""

import random
import re

DDL = "doc_id long, text string, lang string, source string, n_chars long, id long, h long, fp long, size long, s string, `key` string, shard int, quality_score double, bench_words long, value string"
rng = random.Random(5)
WORDS = ["wo" + "".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(400)]


def prose(n, seed):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) for _ in range(n))


def rows():
    long = prose(20_000, 1)
    base = [(1, prose(80, 2), "en", "a"), (2, prose(80, 2), "en", "a"), (3, prose(80, 2) + " more", "en", None), (4, "", "en", "b"), (5, None, None, "b"), (6, " \n\t ", "fr", None), (7, long, "de", "a"), (7, long, "de", "a"), (None, prose(60, 3), "en", "c"), (None, None, None, None), (8, "é ü 漢字 " * 30, "fr", "a"), (9, "Word, word! WORD\x0bword\r\nword", "en", "b"), (10, "two words", "en", "b"), (11, "two words", "en", "b"), (12, "the same line\n" * 40, "en", "a")]
    return [(i, t, la, so, 1, 5, 6, 7, 8, "x", "k", 9, 0.5, 3, "v") for i, t, la, so in base]


def plain_jump(key, n):
    b, j = -1, 0
    while j < n:
        b = j
        key = (key * 2862933555777941757 + 1) % (1 << 64)
        j = int((b + 1) * ((1 << 31) / ((key >> 33) + 1)))
    return b


def brute_overlap(text, items):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    w, hit, owners = words(text), set(), set()
    for item, t in items:
        v = words(t)
        k = min(8, len(v))
        grams = {tuple(v[i : i + k]) for i in range(len(v) - k + 1)} if k else set()
        for i in range(len(w) - k + 1 if k else 0):
            if tuple(w[i : i + k]) in grams:
                hit |= set(range(i, i + k))
                owners.add(str(item) if item is not None else "")
    return len(w), len(hit), sorted(owners)

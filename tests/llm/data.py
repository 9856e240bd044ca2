"""Small corpora for the tests, and brute-force answers."""

import random
import re

SCHEMA = "doc_id long, text string, lang string, source string, fp long, id long, shard int, spans string, key string, h long"


def word(rng, n=400):
    k = rng.randrange(n)
    return "".join("bcdfglmnprst"[k // 7**i % 12] + "aeiou"[k // 5**i % 5] for i in range(3)) + ("é" if k % 9 == 0 else "")


def prose(rng, n):
    return " ".join(word(rng) + rng.choice(["", "", "", ".", ",\n"]) for _ in range(n))


def corpus(seed=1, n=120):
    """Rows with repeats of all kinds: copies, edited copies, shared passages, periodic texts."""
    rng = random.Random(seed)
    texts = [prose(rng, rng.randrange(5, 160)) for _ in range(n)]
    passage = prose(rng, 60)
    for i in range(0, n, 7):
        texts[i] = texts[i] + " " + passage + " " + prose(rng, 10)
    for i in range(3, n, 10):
        texts[i] = texts[i - 1]
    for i in range(4, n, 10):
        w = texts[i - 2].split(" ")
        w[rng.randrange(len(w))] = "zzz"
        texts[i] = " ".join(w)
    texts[5] = "na " * 300
    texts[6] = "x" * 900
    texts[8] = passage + " " + passage
    texts[9], texts[11], texts[12] = "", None, " \t\n "
    texts[13] = "one two"
    rows = [(i * 3 % (3 * n + 1), t, ["en", "de", None][i % 3], [None, "b", "a", "c"][i % 4], 1, 2, 3, "s", "k", 4) for i, t in enumerate(texts)]
    rng.shuffle(rows)
    return rows


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")

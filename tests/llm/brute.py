"""Plain implementations that the operators are held against, and awkward documents."""

import hashlib
import re

import numpy as np
import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sha(text):
    return hashlib.sha256(text.encode() if isinstance(text, str) else text).hexdigest()


def passage(i, n=60):
    rng = np.random.default_rng(i)
    return " ".join("".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), rng.integers(2, 9))) for _ in range(n))


def texts():
    """Empty, null, blank, one word, long, repeated, overlapping and periodic texts, other scripts included."""
    a, b, c = passage(1, 200), passage(2, 150), passage(3, 400)
    return [
        a, a, a + " tail", "head " + a, b + " " + a[:900], None, "", " \t\n ", "one", "Ünïcode wörds ŝĥ " + b, c, c[:1500] + " x " + c[1500:], "ab " * 700, "ab " * 690, "z" * 1500, "é" * 900,
        c + "\n" + c, passage(4, 5000), passage(4, 5000) + " end", "A B C d e f", "a b c D E F", b.upper(), "x\x0by\x0cz w",
    ]


def windows(rows, n=20):
    seen, out = set(), {}
    for i, text in sorted(rows, key=lambda r: r[0]):
        words, gone = WORD.findall(text or ""), set()
        for k in range(len(words) - n + 1):
            key = tuple(words[k : k + n])
            if key in seen:
                gone |= set(range(k, k + n))
            seen.add(key)
        out[i] = (len(words), len(gone), sha(" ".join(w for j, w in enumerate(words) if j not in gone)))
    return out


def strings(rows, n=400):
    from collections import Counter

    data = [(i, (t or "").encode()) for i, t in rows]
    count = Counter(t[k : k + n] for _, t in data for k in range(len(t) - n + 1))
    out = {}
    for i, t in data:
        cover = np.zeros(len(t) + 1, int)
        for k in range(len(t) - n + 1):
            if count[t[k : k + n]] > 1:
                cover[k] += 1
                cover[k + n] -= 1
        gone = np.cumsum(cover[:-1]) > 0
        spans = int((np.diff(np.concatenate(([0], gone.astype(int)))) == 1).sum()) if len(t) else 0
        out[i] = (len(t), int(gone.sum()), spans, sha(np.frombuffer(t, np.uint8)[~gone].tobytes()))
    return out


def simhash(text):
    words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def components(prints, bits=3):
    label = {i: i for i in prints}
    changed = True
    while changed:
        changed = False
        for i, a in prints.items():
            low = min(label[j] for j, b in prints.items() if (a ^ b).bit_count() <= bits)
            if low < label[i]:
                label[i], changed = low, True
    return label


def benchmark_hits(rows, items, n=10):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    cut = lambda t: word.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    of = {}
    for name, text in items:
        w = cut(text)
        for k in range(max(1, len(w) - n + 1) if w else 0):
            of.setdefault(tuple(w[k : k + n]), set()).add(str(name))
    out = {}
    for i, text in rows:
        w, hit, names = cut(text), set(), set()
        for size in {len(x) for x in of}:
            for k in range(len(w) - size + 1):
                found = of.get(tuple(w[k : k + size]))
                if found:
                    hit |= set(range(k, k + size))
                    names |= found
        out[i] = (len(w), len(hit), len(names), sha(",".join(sorted(names))), bool(hit))
    return out

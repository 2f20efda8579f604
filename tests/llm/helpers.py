"""Small frames with every awkward row, and plain versions of the operators to compare with."""

from __future__ import annotations

import hashlib
import re

WORD = re.compile("[^\x20\x09-\x0d]+")
CLASHING = ("row", "words", "text_sha256", "keep_id", "bucket", "chunk", "size", "h", "key", "kept", "id", "n", "u")


def sentence(seed: int, n: int) -> str:
    return " ".join(hashlib.md5(f"{seed} {k}".encode()).hexdigest()[: 3 + (seed + k) % 6] for k in range(n)) + "."


LONG = "\n".join(sentence(900 + k, 40) for k in range(400))
BASE = sentence(1, 60)
TEXTS = [
    (1, BASE), (2, BASE), (3, BASE.replace(BASE.split()[30], "changed")), (4, None), (5, ""), (6, " \t\n\x0b\r "), (7, "one"),
    (8, "one two three"), (9, "ONE two three"), (10, sentence(2, 80) + "\n" + BASE), (11, LONG), (12, LONG + " more."),
    (13, "été über 日本語 😀 " * 30), (14, sentence(3, 50)), (15, "same words again and " * 30), (16, None), (17, "x" * 5000),
    (None, sentence(4, 40)), (None, BASE), (18, sentence(5, 30)), (18, sentence(5, 30)), (19, "Don't <|endoftext|> stop 12345    !!"),
    (20, "a | b | c | d | e | f | g | h | i | j | k | l"), (21, "aaaa" * 200 + " " + "abab" * 100),
]


def documents(spark, rows=TEXTS, source=lambda i, k: None if k % 7 == 3 else f"s{k % 5}"):
    """Rows with clashing extra columns."""
    data = [(i, t, source(i, k), *[k] * len(CLASHING)) for k, (i, t) in enumerate(rows)]
    extra = ", ".join(f"`{c}` int" for c in CLASHING)
    return spark.createDataFrame(data, f"doc_id long, text string, source string, {extra}")


def table(df) -> list[dict]:
    return [r.asDict() for r in df.collect()]


def shingles(text: str | None, width: int) -> set:
    words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if len(words) < width:
        return {tuple(words)} if words else set()
    return {tuple(words[k : k + width]) for k in range(len(words) - width + 1)}


def near_components(rows: list[tuple], width: int, percent: int) -> dict:
    """Smallest id reachable over links of at least ``percent`` per cent, by comparing all pairs."""
    sets = {}
    for i, t in rows:
        if i is not None:
            sets.setdefault(i, []).append(shingles(t, width))
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for a, i in enumerate(ids):
        for j in ids[:a]:
            for x in sets[i]:
                for y in sets[j]:
                    if x and y and 100 * len(x & y) >= percent * len(x | y):
                        p, q = sorted((root(i), root(j)))
                        parent[q] = p
    return {i: root(i) for i in ids}


def repeated(rows: list[tuple], length: int) -> list[tuple]:
    """(id, bytes, removed, spans, digest) by looking up every window."""
    texts = [(i, (t or "").encode()) for i, t in rows]
    late = 1 << 63
    first: dict[bytes, int] = {}
    for i, b in texts:
        for k in range(len(b) - length + 1):
            w = b[k : k + length]
            first[w] = min(first.get(w, late), late if i is None else i)
    out = []
    for i, b in texts:
        gone = bytearray(len(b))
        for k in range(len(b) - length + 1):
            if first[b[k : k + length]] < (late if i is None else i):
                gone[k : k + length] = b"\1" * length
        spans = sum(1 for k in range(len(b)) if gone[k] and not (k and gone[k - 1]))
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def line_verdict(text: str | None, few=10, share=20, window=5) -> dict:
    words = WORD.findall(text or "")
    grams: dict[tuple, list[int]] = {}
    for k in range(len(words) - window + 1):
        grams.setdefault(tuple(words[k : k + window]), []).append(k)
    again = {k + j for at in grams.values() if len(at) > 1 for k in at for j in range(window)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return {
        "n_words": len(words), "word_chars": sum(map(len, words)), "n_symbols": sum(c in "#*$%&|<>" for c in text or ""),
        "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(again),
        "base_failed": len(words) < few or 100 * len(again) > share * len(words),
    }

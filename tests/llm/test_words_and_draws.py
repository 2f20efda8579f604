"""Importance resampling, word windows and spelling variants against plain versions on awkward rows."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter

import pytest
from helpers import BASE, LONG, TEXTS, WORD, documents, sentence, table

from panelweave.llm import importance, near_dup, spellings, word_windows

SMALL = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def features(text: str | None, width: int) -> tuple[int, list[int]]:
    words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (text or "").translate(SMALL))
    runs = [" ".join(words[k : k + n]) for n in range(1, width + 1) for k in range(len(words) - n + 1)]
    return len(words), [zlib.crc32(r.encode()) % 10000 for r in runs]


@pytest.mark.parametrize("width", [1, 2, 3])
def test_resampling_draws_like_a_plain_version(spark, width):
    target = spark.createDataFrame([(BASE,), (None,), (sentence(3, 50),)], "text string")
    got = table(importance.resampled(documents(spark), target, width=width))
    own = [(i, *features(t, width)) for i, t in TEXTS]
    s, t = Counter(b for _, _, f in own for b in f), Counter(b for (x,) in target.collect() for b in features(x, width)[1])
    S, T = sum(s.values()), sum(t.values())
    want = []
    for i, n, f in own:
        gains = [math.floor(1000 * math.log((t[b] + 1) * (S + 10000) / ((s[b] + 1) * (T + 10000)))) for b in f]
        weight = sum(gains) // len(gains) if gains else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        want.append((i, n, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32)))))
    assert Counter((r["doc_id"], r["n_words"], r["n_features"], r["weight"], r["score"]) for r in got) == Counter(want)
    able = sorted((-x[4], x[0] is None, x[0] or 0) for x in want if x[1] >= 20)
    drawn = sorted((r["rank"], -r["score"], r["doc_id"]) for r in got if r["rank"] is not None)
    assert [d[0] for d in drawn] == list(range(1, len(able) * 25 // 100 + 1))
    assert [d[1] for d in drawn] == [a[0] for a in able[: len(drawn)]]


def test_drawn_rows_and_empty_tables(spark):
    docs = documents(spark)
    out = importance.drawn_rows(docs, docs)
    assert out.columns == docs.columns and 0 < out.count() < len(TEXTS)
    assert importance.resampled(docs.limit(0), docs).count() == 0
    assert importance.resampled(docs, docs.limit(0)).count() == len(TEXTS)


def windows_left(rows: list[tuple], width: int) -> list[tuple]:
    first: dict = {}
    split = [(i, WORD.findall(t or "")) for i, t in rows]
    place = lambda i: math.inf if i is None else i
    for i, words in split:
        for k in range(len(words) - width + 1):
            key = tuple(words[k : k + width])
            first[key] = min(first.get(key, (math.inf, math.inf)), (place(i), k))
    out = []
    for i, words in split:
        gone = {k + j for k in range(len(words) - width + 1) if first[tuple(words[k : k + width])] != (place(i), k) for j in range(width)}
        kept = " ".join(w for j, w in enumerate(words) if j not in gone)
        out.append((i, len(words), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


@pytest.mark.parametrize("width", [1, 5, 20])
@pytest.mark.parametrize("held", [60, 500_000])
def test_repeated_windows_go_like_in_a_plain_version(spark, monkeypatch, width, held):
    monkeypatch.setattr(word_windows, "PASS_WINDOWS", 400)
    monkeypatch.setattr(word_windows.window_blobs, "__defaults__", (held,))
    rows = TEXTS + [(40, "a b " + BASE), (41, BASE + " " + BASE), (18, sentence(6, 60)), (50, sentence(6, 60)), (51, LONG[3:])]
    got = word_windows.cleaned(documents(spark, rows), width=width)
    assert Counter((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in table(got)) == Counter(windows_left(rows, width))
    for r in table(got):
        assert sum(e - s for s, e in r["spans"]) == r["n_removed"]
        assert all(a[1] < b[0] for a, b in zip(r["spans"], r["spans"][1:]))
        assert hashlib.sha256(r["kept"].encode()).hexdigest() == r["kept_sha256"]


def test_windows_of_an_empty_table(spark):
    assert word_windows.cleaned(documents(spark).limit(0)).count() == 0


def one_edit(a: str, b: str) -> bool:
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def spelled(rows: list[tuple], every: int) -> dict:
    counts: Counter = Counter()
    for i, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = run.translate(SMALL)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % every == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    n = {w: c for w, c in counts.items() if len(w) >= 5 and c >= 3}
    near = {w: [x for x in n if one_edit(w, x)] for w in n}
    form = {}
    for w in n:
        best = min(near[w], key=lambda x: (-n[x], x), default=None)
        form[w] = best if best and n[best] >= 2 * n[w] else None
    out = {}
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out[w] = (n[w], len(near[w]), form[w], n[form[w]] if form[w] else None, root)
    return out


@pytest.mark.parametrize("block_rows", [4, 3000])
@pytest.mark.parametrize("every", [3, 97])
def test_spellings_like_a_plain_version(spark, every, block_rows):
    rows = TEXTS + [(60 + k, f"Straße straße strasse garçon garcon letter leter lettter bbbbb bbbbbb {'letter ' * k}") for k in range(9)]
    rows += [(80 + k, "colour " * 4 ** k + "colours color colr ") for k in range(4)]
    got = {r["word"]: (r["n"], r["n_near"], r["form"], r["form_n"], r["root"]) for r in table(
        spellings.variants(documents(spark, rows), every=every, block_rows=block_rows))}
    assert got == spelled(rows, every) and len(got) > 10


def test_spellings_of_nothing(spark):
    assert spellings.variants(documents(spark).limit(0)).count() == 0
    with pytest.raises(ValueError):
        spellings.variants(documents(spark), times=1)


def thue_morse(flip: bool) -> str:
    return "".join("ab"[(bin(k).count("1") + flip) % 2] for k in range(1024))


def test_words_of_like_structure_are_not_linked(spark):
    """The two words defeat polynomial hashes modulo powers of two; they share no shingle."""
    docs = spark.createDataFrame([(1, thue_morse(False)), (2, thue_morse(True))], "doc_id long, text string")
    assert {r["doc_id"]: r["component_id"] for r in table(near_dup.near_groups(docs, width=4))} == {1: 1, 2: 2}

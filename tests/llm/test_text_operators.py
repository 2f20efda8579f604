"""Rules, deduplication, near-duplicates, mixing and repeats against plain versions on awkward rows."""

from __future__ import annotations

import hashlib
from collections import Counter

import pytest
from helpers import BASE, TEXTS, documents, line_verdict, near_components, repeated, sentence, shingles, table
from pyspark.sql import functions as F

from panelweave.llm import content_sort, line_rules, mixing, near_dup, repeats, weak_labels


def test_line_rules_count_like_a_plain_version(spark):
    got = table(line_rules.judge_lines(documents(spark)).select("row.doc_id", "row.text", "row.words", "judged.*"))
    assert len(got) == len(TEXTS)
    for r in got:
        want = line_verdict(r["text"])
        assert {k: r[k] for k in want} == want
    assert {r["doc_id"] for r in got if r["kept"]} >= {1, 2, 3, 10, 14}


def test_bad_lines_go_and_documents_that_lose_too_much(spark):
    good, menu, loud = sentence(7, 30), "Home | News | About | Contact | Help | More | Login", "BUY!! NOW!! CHEAP!! GREAT!! DEAL!!"
    rows = [(1, f"{good}\n{menu}\n{sentence(8, 30)}"), (2, f"{menu}\n{menu}\n{good}\n" + "\n".join([loud] * 9)), (3, good), (4, None)]
    docs = documents(spark, rows)
    out = {r["doc_id"]: r for r in table(line_rules.cleaned(docs))}
    assert set(out) == {1, 3} and out[1]["text"] == f"{good}\n{sentence(8, 30)}" and out[3]["text"] == good
    assert line_rules.cleaned(docs).columns == docs.columns
    assert line_rules.cleaned(docs.limit(0)).count() == 0


@pytest.mark.parametrize("keep", ["smallest", "largest"])
@pytest.mark.parametrize("share", [0.002, 0.9])
def test_exact_groups(spark, keep, share):
    rows = TEXTS + [(100 + k, BASE) for k in range(60)] + [(None, None)]
    got = table(content_sort.group_equal(documents(spark, rows), keep=keep, hot_share=share, sample=1.0))
    texts: dict[str, list] = {}
    for i, t in rows:
        texts.setdefault(hashlib.sha256((t or "").encode()).hexdigest(), []).append(i)
    assert Counter((r["text_sha256"], r["doc_id"]) for r in got) == Counter((s, i) for s, ids in texts.items() for i in ids)
    for r in got:
        ids = [i for i in texts[r["text_sha256"]] if i is not None]
        assert r["group_size"] == len(texts[r["text_sha256"]])
        assert r["keep_id"] == ((min if keep == "smallest" else max)(ids) if ids else None)
        assert not r["kept"] or r["doc_id"] == r["keep_id"]
    assert Counter(r["text_sha256"] for r in got if r["kept"]) == Counter(texts.keys())
    left = content_sort.kept_rows(documents(spark, rows), keep=keep, hot_share=share, sample=1.0)
    assert Counter(hashlib.sha256((r["text"] or "").encode()).hexdigest() for r in table(left)) == Counter(texts.keys())
    assert left.columns == documents(spark).columns


def test_exact_groups_after_normalising_and_of_nothing(spark):
    docs = documents(spark)
    got = {r["doc_id"]: r["keep_id"] for r in table(content_sort.group_equal(docs, normalise=F.lower))}
    assert got[9] == 8
    assert content_sort.group_equal(docs.limit(0)).count() == 0 == content_sort.kept_rows(docs.limit(0)).count()
    with pytest.raises(ValueError):
        content_sort.group_equal(docs, keep="first")


def family(n: int, base: str, edits: int) -> list[tuple]:
    """Near copies that differ from a base in a few words each."""
    out = []
    for k in range(n):
        words = base.split()
        for e in range(edits):
            words[(17 * k + 31 * e) % len(words)] = f"w{k}x{e}"
        out.append((1000 + k, " ".join(words)))
    return out


@pytest.mark.parametrize("small_list", [32, 3])
@pytest.mark.parametrize("edits", [1, 2, 3])
def test_near_groups_equal_all_pairs(spark, small_list, edits):
    rows = TEXTS + family(40, sentence(50, 120), edits) + [(2000 + k, sentence(60, 9) + f" tail{k} end{k % 3}") for k in range(12)]
    got = table(near_dup.near_groups(documents(spark, rows), small_list=small_list, block_rows=8, hot_share=0.0005, parts=3))
    want = near_components(rows, 5, 80)
    assert len(got) == len(rows)
    for r in got:
        if r["doc_id"] is None:
            assert r["component_id"] is None and r["kept"]
        else:
            assert r["component_id"] == want[r["doc_id"]] and r["kept"] == (r["doc_id"] == want[r["doc_id"]])
    sizes = {(i, len(shingles(t, 5))) for i, t in rows}
    assert {(r["doc_id"], r["n_shingles"]) for r in got} == sizes


def test_near_rows_that_stay(spark):
    docs = documents(spark)
    left = near_dup.kept_rows(docs)
    assert left.columns == docs.columns
    want = near_components(TEXTS, 5, 80)
    assert {r["doc_id"] for r in table(left)} == {i for i in want if want[i] == i} | {None}
    assert near_dup.near_groups(docs.limit(0)).count() == 0


@pytest.mark.parametrize("spread", [0, 100_000])
def test_repeats_equal_a_lookup_of_every_window(spark, monkeypatch, spread):
    monkeypatch.setattr(repeats, "SPREAD_OVER", spread)
    rows = TEXTS + family(12, sentence(50, 120), 2) + [(3000 + k, f"head {k} " + BASE[20:75] + f" tail {k}") for k in range(6)]
    got = Counter(tuple(r.values()) for r in table(repeats.repeated_spans(documents(spark, rows))))
    assert got == Counter(repeated(rows, 50))


def test_repeats_of_nothing_and_in_small_chunks(spark, monkeypatch):
    assert repeats.repeated_spans(documents(spark).limit(0)).count() == 0
    monkeypatch.setattr(repeats, "CHUNK_BYTES", 3000)
    monkeypatch.setattr(repeats, "SLICE_BYTES", 700)
    monkeypatch.setattr(repeats, "BUCKET_BYTES", 2000)
    got = table(repeats.repeated_spans(documents(spark).repartition(3), texts=True))
    assert Counter(tuple(r.values())[:5] for r in got) == Counter(repeated(TEXTS, 50))
    assert all(hashlib.sha256(r["kept"]).hexdigest() == r["kept_sha256"] for r in got)


def test_mixing_meets_targets(spark):
    rows = [(k, sentence(k, 5 + k % 40)) for k in range(600)] + TEXTS
    docs = documents(spark, rows, source=lambda i, k: None if k % 11 == 3 else "big" if k % 3 == 0 else f"s{k % 4}")
    got = table(mixing.mixed(docs).select("row.doc_id", "row.source", "size", "source_size", "target", "copies", "taken"))
    assert len(got) == len(rows)
    totals, taken = Counter(), Counter()
    for r in got:
        totals[r["source"]] += r["size"]
        taken[r["source"]] += r["taken"]
        assert 0 <= r["taken"] <= 2 * r["size"] and r["taken"] == r["size"] * r["copies"]
    for r in got:
        assert r["source_size"] == totals[r["source"]] and r["target"] <= 2 * r["source_size"]
        assert abs(taken[r["source"]] - r["target"]) <= max(x["size"] for x in got)
    assert sum({r["source"]: r["target"] for r in got}.values()) == pytest.approx(1.5 * sum(totals.values()))
    again = mixing.taken_rows(docs.repartition(5))
    assert again.columns == docs.columns
    assert Counter(r["doc_id"] for r in table(again)) == sum((Counter({r["doc_id"]: r["copies"]}) for r in got), Counter())
    assert mixing.mixed(docs.limit(0)).count() == 0
    assert table(mixing.mixed(documents(spark, [(1, None), (2, "")])).select("taken")) == [{"taken": 0}] * 2


def test_weak_labels_without_known_labels(spark):
    good = [(k, "\n".join(" ".join(f"{w[:5]} the a" for w in sentence(10 * k + j, 6).rstrip(".").split()).capitalize() + "." for j in range(5))) for k in range(200)]
    bad = [(1000 + k, " ".join(w + ("***", "$$$", "###")[k % 3] for w in sentence(k, 40).split())) for k in range(30)]
    bad += [(2000 + k, " ".join(w.upper() + "!!" for w in sentence(k, 40).split())) for k in range(30)]
    bad += [(3000 + k, (sentence(k, 1) + " ") * 60) for k in range(30)]
    docs = documents(spark, good + bad + [(5000, None), (5001, ""), (None, good[0][1])])
    found, model = weak_labels.quality(docs)
    got = {r["doc_id"]: r for r in table(found)}
    assert len(got) == len(good) + len(bad) + 3
    assert sum(got[i]["kept"] for i, _ in good) >= 0.98 * len(good)
    assert sum(got[i]["kept"] for i, _ in bad) <= 0.05 * len(bad)
    assert not got[5000]["kept"] and not got[5001]["kept"] and got[None]["kept"]
    right = model.accuracy()
    assert 0.5 < model.share < 0.9 and right["short_words"] > 0.9
    assert right["variety"] < 0.5  # it misjudges these documents, which the votes of the others show
    empty, _ = weak_labels.quality(docs.limit(0))
    assert empty.count() == 0


def test_weak_labels_agree_with_held_out_labels(spark):
    folder = "/root/testdata/sf0.01"
    found = weak_labels.quality_query(spark, folder).join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id")
    right = found.select(F.avg((F.col("kept") == (F.col("quality") == 1)).cast("int")), F.count("*")).first()
    assert right[0] > 0.97 and right[1] > 300

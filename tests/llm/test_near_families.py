"""Long lists of near-duplicates: a passage that many documents share costs no comparison of all with all."""

from __future__ import annotations

import pytest
from helpers import documents, near_components, sentence, table

from panelweave.llm import near_dup

PASSAGE = sentence(70, 60)


def sharing(n: int, own: int) -> list[tuple]:
    """Documents of a common passage and ``own`` words that no other has."""
    return [(100 + k, f"{PASSAGE} {sentence(1000 + 7 * k, own)}") for k in range(n)]


def test_texts_of_a_family_are_hashed_once_more(spark, monkeypatch, tmp_path):
    log, plain = str(tmp_path / "hashed"), near_dup.shingle_hashes

    def counted(texts, width):
        with open(log, "a") as f:
            f.write(f"{len(texts)}\n")
        return plain(texts, width)

    monkeypatch.setattr(near_dup, "shingle_hashes", counted)
    rows = sharing(96, 40)
    got = table(near_dup.near_groups(documents(spark, rows), small_list=3, block_rows=8))
    assert {r["doc_id"]: r["component_id"] for r in got} == near_components(rows, 5, 80) == {i: i for i, _ in rows}
    with open(log) as f:
        assert 0 < sum(map(int, f)) <= 2 * len(rows)


@pytest.mark.parametrize(("block_rows", "width"), [(3, 5), (192, 4)])
def test_families_equal_all_pairs(spark, block_rows, width):
    rows = [(1, f"{PASSAGE} {sentence(71, 45)}"), (2, f"{sentence(72, 25)} {PASSAGE}")]  # the smallest ids are near to none
    for own in (2, 4, 6, 8, 10, 12, 14, 20):
        rows += [(own * 100 + i, t) for i, t in sharing(7, own)]
    rows += [(5000 + k, " ".join(PASSAGE.split()[k : 44 + k])) for k in range(12)]
    rows += [(6000 + k, f"{PASSAGE} {sentence(90, 300)} {sentence(91 + k, 12 * k)}") for k in range(9)]
    rows += [(7000, f"{PASSAGE} {sentence(74, 7)}"), (7000, f"{PASSAGE} {sentence(75, 30)}"), (None, PASSAGE), (8000, PASSAGE), (8000, PASSAGE)]
    got = table(near_dup.near_groups(documents(spark, rows), width=width, small_list=2, block_rows=block_rows))
    want = near_components(rows, width, 80)
    assert sorted((r["doc_id"] or 0, r["component_id"]) for r in got if r["doc_id"]) == sorted((i, want[i]) for i, _ in rows if i)
    assert len(set(want.values())) < len(want)

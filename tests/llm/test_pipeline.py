"""The pipeline on a small table against plain versions of its stages, and the registered queries on a real one."""

from __future__ import annotations

import hashlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from helpers import WORD, near_components, sentence, table

import __spark_entry__ as entry
import corpus_pipeline
from panelweave.llm import byte_bpe, line_rules

MENU = "Home | News | About | Contact | Help | More | Login | Exit"


def rows() -> list[tuple]:
    out = []
    for k in range(60):
        text = "\n".join(sentence(100 * k + j, 30) for j in range(3))
        out.append((k, text + ("\n" + MENU if k % 5 == 0 else "")))
    out += [(100 + k, out[k][1]) for k in range(0, 60, 6)]  # exact copies
    out += [(200 + k, out[k][1].replace(out[k][1].split()[50], "other")) for k in range(0, 60, 7)]  # near copies
    out += [(300, MENU), (301, None), (302, ""), (303, "too short."), (304, "again and again " * 40)]
    return out


def mix(docs: list[dict]) -> list[dict]:
    size = lambda d: len(WORD.findall(d["text"] or ""))
    sources = sorted({d["source"] for d in docs}, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(sources)}
    total = {s: sum(size(d) for d in docs if d["source"] == s) for s in sources}
    capped: set = set()
    while True:
        each = (1.5 * sum(total.values()) - sum(2 * total[s] for s in capped)) / sum(w for s, w in weight.items() if s not in capped)
        new = {s for s in sources if weight[s] * each > 2 * total[s]}
        if new == capped:
            break
        capped = new
    out = []
    for s in sources:
        own = sorted((int(hashlib.md5(str(d["doc_id"]).encode()).hexdigest()[:15], 16), d["doc_id"]) for d in docs if d["source"] == s)
        by_id = {d["doc_id"]: d for d in docs}
        target = min(2 * total[s], weight[s] * each)
        times = int(target // total[s])
        rest, upto, once = target - times * total[s], 0, set()
        for _, i in own:
            n = size(by_id[i])
            if upto + n > rest:
                if upto + n - rest < rest - upto:
                    once.add(i)
                break
            upto += n
            once.add(i)
        for _, i in own:
            out += [by_id[i]] * min(2, times + (i in once))
    return out


def test_pipeline_equals_plain_stages(spark, tmp_path):
    data = [(i, t, "en", None if i % 9 == 4 else f"s{i % 4}", len(t or "")) for i, t in rows()]
    docs = spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    got = Counter(tuple(r.values()) for r in table(corpus_pipeline.run(spark, str(tmp_path))))

    clean = {r["doc_id"]: r for r in table(line_rules.cleaned(docs))}
    assert set(clean) == {i for i, _ in rows() if i < 300} and not any(MENU in r["text"] for r in clean.values())
    first = {}
    for i in sorted(clean):
        first.setdefault(clean[i]["text"], i)
    left = [clean[i] for i in sorted(first.values())]
    group = near_components([(d["doc_id"], d["text"]) for d in left], 5, 80)
    left = [d for d in left if group[d["doc_id"]] == d["doc_id"]]
    assert len(left) == 60
    tokens, ids = byte_bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=dict(zip(tokens, ids)), special_tokens={})
    want = Counter()
    for d in mix(left):
        codes = np.array(library.encode_ordinary(d["text"]), "<u4")
        want[d["doc_id"], len(codes), hashlib.sha256(codes.tobytes()).hexdigest(), hashlib.sha256(d["text"].encode()).hexdigest()] += 1
    assert got == want


def test_stages_and_columns(spark):
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["quality_rules", "exact_dedup", "near_dedup", "source_mixing", "byte_bpe"]
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:2]:
        assert stage(spark, docs, "").columns == docs.columns
        assert stage(spark, docs.limit(0), "").count() == 0


@pytest.mark.parametrize("number", range(1, 11))
def test_each_operator_has_one_query(number):
    assert len([n for n in entry.queries() if n.startswith(f"op{number}_")]) == 1
    assert "pipeline" in entry.queries()

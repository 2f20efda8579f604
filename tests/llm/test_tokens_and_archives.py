"""Tokenizers against their libraries, archives by round trip, URL filters against plain lookups."""

from __future__ import annotations

import base64
import gzip
import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from helpers import CLASHING, TEXTS, documents, table
from pyarrow import fs
from tokenizers import Tokenizer

from panelweave.llm import byte_bpe, token_counts, url_filter, warc
from panelweave.llm.common import new_folder

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def odd_texts(n: int = 400) -> list[tuple]:
    rng = random.Random(5)
    signs = [lambda: chr(rng.randrange(32, 127)), lambda: chr(rng.choice([rng.randrange(0xD800), rng.randrange(0xE000, 0x110000)])),
             lambda: rng.choice(" \n\t\x0b\x1c\x85\xa0'"), lambda: rng.choice("ereathins"), lambda: rng.choice("éèßñç")]
    return [(5000 + k, "".join(rng.choice(signs)() for _ in range(rng.randrange(80)))) for k in range(n)]


@pytest.fixture(scope="module")
def rows():
    return TEXTS + odd_texts()


def test_codes_equal_the_library(spark, rows):
    tokens, ids = byte_bpe.read_ranks(RANKS)
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=dict(zip(tokens, ids)), special_tokens={})
    got = table(byte_bpe.coded(documents(spark, rows), RANKS, public_tokenizers.PATTERN))
    want = sorted((str(i), np.array(library.encode_ordinary(t or ""), "<u4").tobytes(), (t or "").encode()) for i, t in rows)
    assert sorted((str(r["doc_id"]), bytes(r["ids"]), bytes(r["decoded"])) for r in got) == want
    digests = table(byte_bpe.digests(documents(spark, rows), RANKS, public_tokenizers.PATTERN))
    assert sorted(r["ids_sha256"] for r in digests) == sorted(hashlib.sha256(x[1]).hexdigest() for x in want)
    assert sum(r["n_tokens"] for r in digests) == sum(len(x[1]) for x in want) // 4
    assert byte_bpe.coded(documents(spark).limit(0), RANKS, public_tokenizers.PATTERN).count() == 0


def test_perfect_hash_is_minimal():
    keys = [f"k{i}".encode() for i in range(5000)]
    made = byte_bpe.PerfectHash(keys)
    assert sorted(made.slots) == list(range(5000))
    assert all(made.slot(k) == i for i, k in enumerate(keys))
    assert byte_bpe.PerfectHash([b"only"]).slot(b"only") == 0


def test_counts_equal_the_library(spark, rows):
    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    want = sorted((str(i), len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False).ids)) for i, t in rows)
    got = table(token_counts.token_counts(documents(spark, rows), path))
    assert sorted((str(r["doc_id"]), r["n_bytes"], r["n_tokens"]) for r in got) == want
    assert all(r["over_limit"] == (r["n_tokens"] > 512) for r in got)
    assert token_counts.token_counts(documents(spark).limit(0), path).count() == 0
    with pytest.raises(ValueError):
        token_counts.Merges.read(public_tokenizers.path("word_bpe_49k.json"))


def test_very_long_texts_come_in_pieces(monkeypatch):
    merges = token_counts.Merges.read(public_tokenizers.path("byte_bpe_50k.json"))
    text = "word and <|endoftext|> " * 20_000
    whole = token_counts._counter(*merges).counts([text])
    monkeypatch.setattr("panelweave.llm.pretokens.PIECES_AT_ONCE", 1000)
    assert token_counts._counter(*merges)._long(text) == whole[0]


PAGES = [
    (5, "http://a.org/1", "<p>same</p>"), (3, "http://a.org/2", "<p>same</p>"), (9, None, "<p>same</p>"), (4, "http://b.org/\r\nx", "ü " * 4000),
    (7, "http://c.org", None), (8, "http://c.org/e", ""), (None, "http://d.org", "<p>same</p>"), (None, None, None), (3, "http://a.org/3", "<p>same</p>"),
    (1, "http://e.org", "only"), (2, "http://f.org", "x" * 300_000),
]


def pages(spark, rows=PAGES):
    extra = ", ".join(f"`{c}` int" for c in (*CLASHING, "payload", "sha", "first", "shard"))
    return spark.createDataFrame([(*r, *[0] * (len(CLASHING) + 4)) for r in rows], f"page_id long, url string, html string, {extra}")


def written_names(folder: str) -> dict[str, str]:
    store, path = fs.FileSystem.from_uri(f"{folder}/data")
    out = {}
    for f in store.get_file_info(fs.FileSelector(path)):
        with store.open_input_stream(f.path, compression=None) as raw:
            out[f.base_name] = hashlib.sha1(raw.read()).hexdigest()
    return out


@pytest.mark.parametrize("sizes", [(16_000_000, 256_000_000), (2000, 500)])
def test_archives_come_back(spark, sizes):
    folder = new_folder(spark)
    manifest = warc.write_archives(pages(spark), folder, shard_bytes=sizes[0], file_bytes=sizes[1])
    got = table(warc.read_archives(manifest, folder))
    assert sorted((str(r["page_id"]), r["payload_bytes"], r["payload_digest"]) for r in got) == sorted(
        (str(i), len((h or "").encode()), base64.b32encode(hashlib.sha1((h or "").encode()).digest()).decode()) for i, _, h in PAGES
    )
    told = sorted((str(r["page_id"]), r["record_type"], r["refers_to"]) for r in got)
    assert told == sorted([
        ("3", "response", None), ("3", "revisit", 3), ("5", "revisit", 3), ("9", "revisit", 3), ("7", "response", None), ("8", "revisit", 7),
        ("4", "response", None), ("None", "response", None), ("None", "response", None), ("1", "response", None), ("2", "response", None),
    ])
    assert all(bytes(r["payload"]) == (dict((i, h) for i, _, h in PAGES)[r["page_id"]] or "").encode()
               for r in got if r["record_type"] == "response" and r["page_id"] is not None)
    files = {r["name"]: r["sha1"] for r in table(manifest)}
    assert written_names(folder) == files  # nothing temporary is left
    again = new_folder(spark)
    warc.write_archives(pages(spark).repartition(7), again, shard_bytes=sizes[0], file_bytes=sizes[1])
    assert written_names(again) == files
    if sizes[0] < 16_000_000:
        assert len(files) > 2


def test_archives_of_nothing_small_payloads_and_damage(spark):
    folder = new_folder(spark)
    manifest = warc.write_archives(pages(spark).limit(0), folder)
    assert manifest.count() == 0 and warc.read_archives(manifest, folder).count() == 0
    folder = new_folder(spark)
    manifest = warc.write_archives(pages(spark), folder, least_bytes=100)
    assert {r["record_type"] for r in table(warc.read_archives(manifest, folder, payloads=False))} == {"response"}
    store, path = fs.FileSystem.from_uri(f"{folder}/data")
    name = store.get_file_info(fs.FileSelector(path))[0].path
    with store.open_output_stream(name, compression=None) as out:
        out.write(gzip.compress(warc.record("1", None, b"other", None)))
    with pytest.raises(Exception, match="differs"):
        warc.read_archives(manifest, folder).count()


URLS = [None, "", "no url", "http://", "HTTP://WWW.Example.COM/en/1", "https://example.com/en/1?x=/fr/", "http://blog.example.com/en/", "http://example.com/de",
        "http://x.net/es/1", "http://x.net/fr/", "http://net/es/", "http://x.net#/es/", "a://b://c/en/", "http://spam.org/", "http://sub.spam.org?q", "http://notspam.org/",
        "http://spam.org.uk/", "http://ÉCOLE.org/É", "http://..spam.org/", "http://spam.org:80/", "http://x.com?en/", "http://x.com"]


def plain_verdict(url, listed):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    host, tail = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut]), rest[cut:]
    path = tail[: min([tail.find(c) for c in "?#" if c in tail] or [len(tail)])]
    fits = [r for r in url_filter.RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fits, key=lambda r: len(r.name), default=None)
    parts = host.split(".")
    hit = bool(host) and any(".".join(parts[k:]) in listed for k in range(len(parts)))
    return host, path, best and best.name, best.verdict if best else "block" if hit else "allow"


def test_urls_like_plain_lookups(spark):
    data = [(k, u, *[0] * len(CLASHING)) for k, u in enumerate(URLS * 2)]
    table_ = spark.createDataFrame(data, "page_id long, url string, " + ", ".join(f"`{c}` int" for c in CLASHING))
    listed = spark.createDataFrame([("spam.org",), ("other.org",), (None,), ("spam.org",)], "key string")
    got = table(url_filter.judge_urls(table_, url_filter.RULES, listed).select("row.url", "host", "path", "rule", "verdict"))
    assert len(got) == len(data)
    for r in got:
        assert (r["host"], r["path"], r["rule"], r["verdict"]) == plain_verdict(r["url"], {"spam.org", "other.org"})
    assert url_filter.judge_urls(table_.limit(0), url_filter.RULES, listed).count() == 0
    none = url_filter.judge_urls(table_, (), listed.limit(0))
    assert {r["verdict"] for r in table(none)} == {"allow"}


def test_cascade_is_exact_for_its_universe(spark):
    universe = spark.range(20_000).selectExpr("concat('host', id, '.org') AS key")
    listed = universe.where("hash(key) % 7 = 0")
    cascade = url_filter.build_cascade(universe, listed, rate=0.3)
    assert len(cascade.levels) > 3
    marked = universe.withColumn("says", cascade.listed(universe["key"])).selectExpr("says = (hash(key) % 7 = 0) AS right")
    assert {r["right"] for r in table(marked)} == {True}

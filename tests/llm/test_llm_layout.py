"""Archives, shards and packing."""

import gzip
import hashlib
import os
import random
import tracemalloc
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from corpusloom.llm import packing, sharding, warc

WORD_PIECES = public_tokenizers.path("word_bpe_49k.json")

# Archives

PAGES = "page_id long, url string, html string, lang string, digest string"


def page_rows():
    big, small = "<p>é" * 400, "<p>x"
    rows = [(1, "http://a/1", big), (2, "http://a/2", big), (3, None, small), (4, "", small), (5, "http://a b/\r\nX: y\x7f", None),
            (6, "http://ä/ü", ""), (7, "u", big + "!"), (8, "u", "WARC/1.1\r\n\r\n" * 90), (9, "u", "z" * 300000), (None, "u", big),
            (None, "n", "n" * 2000), (None, "n", "n" * 2000), (20, "t", "t" * 1000), (20, "t", "t" * 1000), (21, "s", "s" * 999), (22, "s", "s" * 999)]
    return [(*r, "en", "q") for r in rows]


def expected(rows, least=1000):
    groups = defaultdict(list)
    for page, _, html, *_ in rows:
        groups[(html or "").encode()].append(page)
    out = []
    for page, _, html, *_ in rows:
        payload = (html or "").encode()
        known = [p for p in groups[payload] if p is not None]
        keep = max(known, default=None) if len(payload) >= least and len(groups[payload]) > 1 else None
        revisit = keep is not None and page != keep
        out.append((page, len(payload), hashlib.sha1(payload).hexdigest(), "revisit" if revisit else "response", keep if revisit else None))
    return Counter(out)


def test_round_trip(spark, tmp_path):
    pages = spark.createDataFrame(page_rows(), PAGES).repartition(3)
    assert Counter(map(tuple, warc.round_trip(pages, str(tmp_path)).collect())) == expected(page_rows())
    assert warc.round_trip(pages.where("false"), str(tmp_path / "none")).count() == 0


def test_archives_and_index(spark, tmp_path):
    pages = spark.createDataFrame(page_rows(), PAGES)
    manifest = warc.write(pages, str(tmp_path), file_bytes=2000)
    files = {r.file: r for r in manifest.collect()}
    assert len(files) > 1 and sum(r.records for r in files.values()) == len(page_rows())
    assert all(os.path.getsize(tmp_path / f) == r.bytes for f, r in files.items())
    for r in warc.index(manifest, str(tmp_path)).collect():
        with open(tmp_path / r.file, "rb") as f:
            f.seek(r.offset)
            fields, block = warc._parse(gzip.decompress(f.read(r.length)))
        assert fields["WARC-Type"] == r.record_type and int(fields["Content-Length"]) == len(block)
        assert fields["WARC-Target-URI"] == r.url and "\n" not in r.url and " " not in r.url
        if r.record_type == "response":
            assert hashlib.sha1(block.partition(b"\r\n\r\n")[2]).hexdigest() == r.payload_digest


def test_only_selected_records_are_read(spark, tmp_path):
    pages = spark.createDataFrame(page_rows(), PAGES)
    index = warc.index(warc.write(pages, str(tmp_path)), str(tmp_path))
    got = warc.fetch(index.where("page_id in (7, 9)"), str(tmp_path), lambda f, b: (f["WARC-Target-URI"], len(b)), "url string, n long")
    assert sorted(r.n > 300000 for r in got.collect()) == [False, True]


def test_coalesced_reads_cover_the_selected():
    rng = random.Random(1)
    for _ in range(50):
        at, entries = 0, []
        for _ in range(rng.randint(0, 30)):
            at += rng.choice([0, 0, 5, 100])
            n = rng.randint(1, 40)
            entries.append((at, n))
            at += n
        reads = warc.coalesce(entries, gap=10, most=64)
        assert [e for *_, held in reads for e in held] == entries
        for first, size, held in reads:
            assert held[0][0] == first and held[-1][0] + held[-1][1] == first + size and (size <= 64 or len(held) == 1)
            assert all(b[0] - a[0] - a[1] <= 10 for a, b in zip(held, held[1:]))


def test_unfinished_files_are_not_listed(spark, tmp_path):
    (tmp_path / "left-behind.warc.gz").write_bytes(b"half a rec")
    pages = spark.createDataFrame(page_rows(), PAGES)
    assert warc.round_trip(pages, str(tmp_path)).count() == len(page_rows())


# Shards

def check_shards(docs, got, shards=40):
    rows = [(r.doc_id, len((r.text or "").encode()) + 16, zlib.crc32((r.text or "").encode())) for r in docs.collect()]
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in got) == Counter(rows)
    slots = defaultdict(list)
    for r in got:
        assert r.law == "bytes" and r.grown_shard is None and 0 <= r.shard < shards
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    sizes = Counter()
    for r in got:
        sizes[r.shard] += r["size"]
    return sizes


def test_shards_of_odd_rows(tricky, no_docs):
    check_shards(tricky, sharding.assign(tricky).collect())
    assert sharding.assign(no_docs).count() == 0


def test_sizes_are_near_equal_with_a_hot_text(spark):
    rng = random.Random(3)
    rows = [(i, "the same text " * 20 if i % 3 == 0 else "w " * rng.randint(1, 500)) for i in range(6000)] + [(9000, "long " * 9000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    sizes = check_shards(docs, sharding.assign(docs).collect())
    assert len(sizes) == 40 and max(sizes.values()) - min(sizes.values()) < 0.03 * np.mean(list(sizes.values()))


def test_overfull_ranges_are_subdivided(spark, monkeypatch):
    monkeypatch.setattr(sharding, "SAMPLES_PER_RANGE", 1)
    rows = spark.range(20000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("x"), (F.col("id") % 50).cast("int")).alias("text"))
    keyed = sharding.with_key(rows).select("__key", "__size").cache()
    _, found = sharding.ranges(keyed, 4, 16)
    total = sum(size for *_, size in found)
    assert sum(n for _, n, _ in found) == 20000 and max(size for *_, size in found) <= 2 * total / 64


def test_equal_rows_are_divided(spark):
    """A hundred thousand rows equal in id and text, and twenty thousand others; samples stay as few as ranges ask for."""
    same = spark.range(100_000).select(F.lit(7).cast("long").alias("doc_id"), F.lit("the same words").alias("text"))
    docs = same.unionByName(spark.range(20_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), F.col("id")).alias("text")))
    keyed = sharding.stored(sharding.with_key(docs).select("__key", "__size"))
    total = keyed.agg(F.sum("__size")).first()[0]
    assert sharding._sample(keyed, F.lit(total / (40 * 64 * sharding.SAMPLES_PER_RANGE)), 0).count() < 2 * 40 * 64 * sharding.SAMPLES_PER_RANGE
    sizes = check_shards(docs, sharding.assign(docs).collect())
    assert len(sizes) == 40 and max(sizes.values()) - min(sizes.values()) < 0.05 * np.mean(list(sizes.values()))


def test_written_shards(spark, tmp_path):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.concat(F.lit("t"), F.col("id")).alias("text"), F.lit(1).alias("shard_size"))
    sharding.write(docs, str(tmp_path / "s"), shards=5)
    back = spark.read.parquet(str(tmp_path / "s"))
    assert back.groupBy("shard").count().count() == 5 and back.select("doc_id").distinct().count() == back.count() == 3000
    named = {r.doc_id: r.shard for r in sharding.assign(docs, shards=5).collect()}
    assert all(named[r.doc_id] == r.shard for r in back.collect())


# Packing

def test_best_fit_takes_the_tightest():
    rng = random.Random(1)
    for _ in range(100):
        lengths = [rng.randint(1, 64) for _ in range(rng.randint(0, 150))]
        room = {}
        got = packing.best_fit(lengths, 64)
        for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
            number, offset = got[i]
            fits = [r for r in room.values() if r >= lengths[i]]
            assert 64 - offset == min(fits, default=64) == room.get(number, 64)
            room[number] = 64 - offset - lengths[i]


def test_word_ids_are_those_of_whole_texts(tricky, monkeypatch):
    monkeypatch.setattr(packing, "CACHE_WORDS", 50)
    texts = [r.text or "" for r in tricky.collect()] + ["DON'T can't 'tis it's", "éa Å ﬁ ΑΣ Σ.", "a\u0085b c　d", "x<|endoftext|>y", "!!! ??", "12 3.4 a1"]
    plain, ours = Tokenizer.from_file(WORD_PIECES), packing.WordIds(WORD_PIECES)
    for text, ids in zip(texts, ours.batch([t.encode() for t in texts], step=3)):
        assert np.frombuffer(ids, "<u4").tolist() == plain.encode(text, add_special_tokens=False).ids


def test_word_ids_remember_little():
    ours = packing.WordIds(WORD_PIECES)
    tracemalloc.start()
    try:
        texts = (" ".join(f"an{i:06d}" for i in range(at, at + 1000)).encode() for at in range(0, 600_000, 1000))
        got = sum(1 for _ in ours.batch(list(texts), step=8))
        held = tracemalloc.get_traced_memory()[0]
    finally:
        tracemalloc.stop()
    assert got == 600 and held < 64e6


@pytest.mark.parametrize("group_docs", [16384, 5])
def test_packed_documents(tricky, group_docs):
    cut = packing.pieces(tricky, WORD_PIECES, with_ids=True)
    got = packing.pack(cut, group_docs=group_docs).collect()
    plain = Tokenizer.from_file(WORD_PIECES)
    docs = Counter((r.doc_id, tuple(plain.encode(r.text or "", add_special_tokens=False).ids + [1])) for r in tricky.collect())
    held = defaultdict(list)
    for r in got:
        ids = np.frombuffer(r.ids, "<u4")
        assert len(ids) == r.length <= 2048 and zlib.crc32(r.ids) == r.ids_crc32
        held[r.doc_id, r.doc_tokens, r.start].append(tuple(ids.tolist()))
    for (doc, ids), times in docs.items():
        for start in range(0, len(ids), 2048):
            mine = held[doc, len(ids), start]
            assert mine.count(ids[start:start + 2048]) >= times
    assert sum(r.length for r in got) == sum(len(ids) * n for (_, ids), n in docs.items())
    places = defaultdict(list)
    for r in got:
        places[r.sequence_id].append((r.offset, r.length))
    for p in places.values():
        at = 0
        for offset, length in sorted(p):
            assert offset == at
            at += length
        assert at <= 2048


def test_little_padding(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("word "), (F.hash("id") % 700 + 700).cast("int")).alias("text"))
    n = packing.pack(packing.pieces(docs, WORD_PIECES)).agg(F.sum("length"), F.countDistinct("sequence_id")).first()
    assert n[0] / n[1] > 0.98 * 2048


def test_sequences_hold_the_ids(tricky, no_docs):
    packed = packing.pack(packing.pieces(tricky, WORD_PIECES, with_ids=True)).cache()
    rows = {r.sequence_id: r for r in packing.sequences(packed, pad_id=9).collect()}
    for r in packed.collect():
        ids = np.frombuffer(rows[r.sequence_id].ids, "<u4")
        assert len(ids) == 2048 and ids[r.offset:r.offset + r.length].tobytes() == bytes(r.ids)
    for r in rows.values():
        used = sum(1 for _ in r.doc_ids)
        assert used == len(r.offsets)
    assert packing.pack(packing.pieces(no_docs, WORD_PIECES)).count() == 0

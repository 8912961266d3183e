import random
import re

import pytest
from hypothesis import given, settings, strategies as st

from corpusloom.functions.pieces import cut_text, pack_paragraphs
from corpusloom.operators import chunk
from corpusloom.plans import catalog, corpus
from corpusloom.schemas import CHUNK

ALPHABET = st.sampled_from(list("ab。；;. \n\t|x"))


@settings(max_examples=150, deadline=None)
@given(st.text(ALPHABET, max_size=900))
def test_pieces_cover_the_text(t):
    pieces = cut_text(t, max_chars=60, overlap=8)
    body = re.sub(r"[ \t]+", " ", t).strip()
    assert all(pieces) and all(p == p.strip() for p in pieces)
    at = 0
    for p in pieces:
        found = body.index(p)
        assert body.find(p, max(0, at - len(p) - 60)) >= 0 and found <= len(body)
        at = max(at, body.find(p, max(0, at - len(p) - 60)) + len(p))
    if body:
        assert body.endswith(pieces[-1])
        assert set(body) - set(" \n") <= set("".join(pieces))
    for p in pieces:
        assert len(p) <= 60 or "|" in p


def test_sizes_around_the_limit():
    assert len(cut_text("x" * 1200)) == 1
    two = cut_text("x" * 1201)
    assert [len(p) for p in two] == [1200, 151]
    assert cut_text("") == [] and cut_text(" \t ") == []


def test_first_separator_kind_wins():
    t = "a" * 500 + "。" + "b" * 400 + ". " + "c" * 600
    assert cut_text(t)[0] == "a" * 500 + "。"
    early = "a" * 300 + "。" + "b" * 2000
    assert len(cut_text(early)[0]) == 1200


def test_cut_moves_to_the_end_of_a_table():
    rows = "".join(f"| r{i} | a. value |\n" for i in range(200))
    t = "p" * 1000 + "\n" + rows + "after the table"
    first = cut_text(t)[0]
    assert first.endswith("| r199 | a. value |") and len(first) > 1200
    # A cut at a line end does not fall on a row.
    plain = "p" * 1000 + "\n" + "| r | value |\n" * 200
    assert len(cut_text(plain)[0]) <= 1200
    assert cut_text("| " + "x" * 3000) == ["| " + "x" * 3000]


def test_a_long_line_is_no_table_because_the_text_begins_with_one():
    pieces = cut_text("| a | b |\n| c | d |\n" + "word | other. " * 500)
    assert len(pieces) > 5 and max(map(len, pieces)) <= 1200
    # A row is one line from its first character on, also for the pieces that begin in it.
    row = "| " + "cell. " * 500 + "|\n"
    pieces = cut_text("intro\n" + row + "end. " * 500, overlap=0)
    assert pieces[0] == ("intro\n" + row).strip() and max(map(len, pieces[1:])) <= 1200


def test_empty_text_gives_title_chunk(spark):
    docs = spark.createDataFrame(
        [("d1", "local", "T", "", None, "", [], "other"), ("d2", "local", "T2", "body", 2000, "u", ["a"], "rct")],
        "doc_id string, source string, title string, text string, year int, url string, tags array<string>, evidence_level string")
    rows = {r["chunk_id"]: r["text"] for r in chunk.docs_to_chunks(docs).collect()}
    assert rows == {"d1#c0": "T", "d2#c0": "body"}


def greedy(rows, least):
    out = []
    for r in rows:
        if out and out[-1]["doc_id"] == r["doc_id"] and (len(out[-1]["text"]) < least or len(r["text"]) < least):
            out[-1]["text"] = f"{out[-1]['text']} {r['text']}".strip()
            out[-1]["url"] = out[-1]["url"] or r["url"]
            out[-1]["year"] = out[-1]["year"] or r["year"]
        else:
            out.append(dict(r))
    seen = {}
    for r in out:
        i = seen.get(r["doc_id"], 0)
        seen[r["doc_id"]] = i + 1
        r["chunk_index"], r["chunk_id"] = i, f"{r['doc_id']}#c{i}"
    return out


def test_merge_of_a_chunk_table_equals_the_sequential_merge(spark):
    rng = random.Random(3)
    sizes = [[50, 50, 500], [500, 50, 500], [119, 121], [120, 120], [50], [10] * 30, [10] * 5 + [300, 300], [118, 5, 200]]
    sizes += [[rng.choice([1, 30, 60, 119, 120, 300]) for _ in range(rng.randrange(1, 12))] for _ in range(60)]
    rows = [dict(chunk_id=f"d{d:03d}#c{i}", doc_id=f"d{d:03d}", source="s", title="t", text=chr(97 + i % 26) * n,
                 year=rng.choice([None, 2000 + i]), url=rng.choice(["", f"u{i}"]), tags=["a"], evidence_level="other", chunk_index=i)
            for d, ns in enumerate(sizes) for i, n in enumerate(ns)]
    fields = CHUNK.fieldNames()
    df = spark.createDataFrame([tuple(r[f] for f in fields) for r in rows], CHUNK)
    got = sorted([r.asDict() for r in chunk.merge_tiny_chunks(df).collect()], key=lambda r: (r["doc_id"], r["chunk_index"]))
    assert got == greedy(rows, 120)

    arrays = spark.createDataFrame([(["x" * n for n in ns],) for ns in sizes], "p array<string>")
    inside = arrays.select(chunk.merge_tiny_pieces(arrays["p"], 120)).collect()
    for ns, r in zip(sizes, inside):
        want = greedy([dict(doc_id="d", text="x" * n, url="", year=None) for n in ns], 120)
        assert r[0] == [w["text"] for w in want]


def test_traceability_counts(spark):
    bad = [("a#c0", "a", "s", "t", "x", None, "", [], "other", 0), ("b", "b", "s", " ", "x", None, "u", [], "other", 0),
           ("c#c0", "z", "s", "t", "", None, "u", [], "other", 0)]
    r = chunk.traceability(spark.createDataFrame(bad, CHUNK)).first()
    assert (r["total"], r["missing_title"], r["missing_url"], r["missing_text"], r["bad_ids"], r["mismatched_ids"], r["ok"]) == (
        3, 1, 1, 1, 1, 1, False)
    good = spark.createDataFrame(bad[:1], CHUNK)
    assert chunk.traceability(good).first()["ok"] is True


@settings(max_examples=100, deadline=None)
@given(st.text(st.sampled_from(list("ab.!\n ")), max_size=400))
def test_packed_paragraphs_stay_below_the_limit(t):
    parts = pack_paragraphs(t, 50)
    assert all(len(p) <= 50 for p in parts)
    assert re.sub(r"\s", "", "".join(parts)) == re.sub(r"\s", "", t)


def test_build_gate_takes_documents_without_text(spark, tmp_path):
    """The query's documents have a title each, so one without text is a chunk of its title; without a title the gate still raises."""
    rows = [(i, "word " * 30, "en", "src0", 150) for i in range(98)] + [(98, None, "en", "src0", 0), (99, "", "en", "src0", 0), (100, " \n\t", None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    assert [tuple(r) for r in catalog.QUERIES["build_gate"](spark, str(tmp_path)).collect()] == [(True, 101)]
    with pytest.raises(Exception, match="chunk traceability failed"):
        chunk.require_buildable(chunk.docs_to_chunks(corpus.docs(spark, str(tmp_path))), 100).collect()

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import audit, evaluate, gate, topics, verify

CTX = [("pmid:111111", "https://pubmed.ncbi.nlm.nih.gov/111111/"), ("nct:NCT00000001", ""), ("local:a", "")]


@pytest.fixture(scope="module")
def contexts(spark):
    rows = [("q", i + 1, d, u) for i, (d, u) in enumerate(CTX)]
    return spark.createDataFrame(rows, "question_id string, rank int, doc_id string, url string")


@pytest.mark.parametrize("answer,want", [
    ("x [1][3]", {}), ("x [4]", {"invalid_brackets": [4]}), ("PMID: 111111", {}), ("PMID 999999", {"fake_pmids": ["999999"]}),
    ("nct00000001", {}), ("NCT99999999", {"fake_ncts": ["NCT99999999"]}), ("见PMID:222222", {}), ("(local:a).", {}),
    ("pmid:111111#c0", {}), ("pmid:111111.", {}), ("local:b，ok", {"fake_docs": ["local:b"]}), ("none", {}),
    ("[0] PMID999999 pmid:999999", {"invalid_brackets": [0], "fake_pmids": ["999999", "999999"], "fake_docs": ["pmid:999999"]})])
def test_audit(spark, contexts, answer, want):
    a = spark.createDataFrame([("q", answer)], "question_id string, answer string")
    r = audit.verify_citations(a, contexts).first()
    for name in ("invalid_brackets", "fake_pmids", "fake_ncts", "fake_docs"):
        assert r[name] == want.get(name, []), name
    assert r["ok"] is (not want) and r["fake_citation_count"] == sum(map(len, want.values()))


def test_compat_keeps_trailing_characters(spark, contexts):
    a = spark.createDataFrame([("q", "pmid:111111#c0")], "question_id string, answer string")
    assert audit.verify_citations(a, contexts, compat=True).first()["fake_docs"] == ["pmid:111111#c0"]


def test_more_contexts_never_add_fakes(spark, contexts):
    a = spark.createDataFrame([("q", "PMID 999999 [4] local:z")], "question_id string, answer string")
    more = contexts.unionByName(spark.createDataFrame([("q", 4, "pmid:999999", "")], contexts.schema))
    few, many = (audit.verify_citations(a, c).first()["fake_citation_count"] for c in (contexts, more))
    assert (few, many) == (3, 1)


def test_answer_without_contexts(spark, contexts):
    a = spark.createDataFrame([("other", "[1]")], "question_id string, answer string")
    r = audit.verify_citations(a, contexts).first()
    assert (r["n_contexts"], r["invalid_brackets"], r["ok"]) == (0, [1], False)


def test_small_columns(one):
    c = F.col("a")
    assert one(audit.baseline_fake_signal(c), a="PMID 12345 NCT12345678 [1][2][3]") == 3
    assert one(audit.phrase_hits(c), a="根据某项研究 发表于《X》 Li et al. 著名的 A 试验") == 4
    assert one(audit.repair_brackets(c, F.array(F.lit(4), F.lit(12))), a="x [4] y [1][12]") == "x  y [1]"
    assert one(evaluate.gold_coverage(c, F.array(F.lit("LDL"), F.lit("salt"))), a="ldl only") == 0.5
    assert one(evaluate.gold_coverage(c, F.array().cast("array<string>")), a="x") == 0.0


def test_gate_reasons(spark):
    q = spark.createDataFrame([
        ("scope", "火星 血压", "clinical"), ("nohits", "血压 高", "clinical"), ("foreign", "alpha beta", "nutrition"),
        ("half", "alpha beta", "nutrition"), ("weak", "血压 x", "clinical"), ("edge", "a b c d e f g h i", "nutrition"),
        ("fine", "血压 y", "clinical")], "question_id string, question string, track string")
    ctx = [("scope", 1, "火星", "", "rct"), ("foreign", 1, "gamma", "", "other"), ("half", 1, "none", "", "other"),
           ("half", 2, "alpha", "", "other"), ("weak", 1, "z", "", "ebook"), ("edge", 1, "a x", "", "other"),
           ("fine", 1, "z", "", "rct"), ("foreign", 4, "alpha beta", "", "other")]
    c = spark.createDataFrame(ctx, "question_id string, rank int, text string, title string, evidence_level string")
    got = {r["question_id"]: r["reason"] for r in gate.relevance_gate(q, c, expect_levels=["guideline", "meta", "rct"]).collect()}
    assert got == {"scope": "out_of_scope", "nohits": "low_relevance", "foreign": "low_relevance", "half": None,
                   "weak": "missing_evidence_type", "edge": "low_relevance", "fine": None}


def test_tips(spark):
    rows = [("q", 1, "建议少盐。每天服药。无关句子！建议 少盐。"), ("q", 2, "避免油炸；可以散步？增加蔬菜！减少糖。坚持运动。选择鱼。")]
    c = spark.createDataFrame(rows, "question_id string, rank int, text string")
    got = [r["tip"] for r in gate.action_tips(c).orderBy("n").collect()]
    assert got == ["建议少盐。", "避免油炸；", "可以散步？", "增加蔬菜！", "减少糖。"]


def test_fresh_documents_go_in_front(spark):
    ctx = spark.createDataFrame([("q", i, f"d{i}") for i in (1, 2, 3)], "question_id string, rank int, doc_id string")
    new = spark.createDataFrame([("q", 0, "n0"), ("q", 1, "d2"), ("q", 2, "n2"), ("q", 3, "n0")], "question_id string, pos int, doc_id string")
    out = gate.augment_with_fresh(ctx, new, k=2).orderBy("rank").collect()
    assert [r["doc_id"] for r in out] == ["n2", "n0", "d1", "d2"]


def test_summary_of_no_results_is_zero(spark):
    rag = "struct<fake_citation_count:int,has_citations:boolean,refused:boolean,gold_coverage:double,n_contexts:int>"
    empty = spark.createDataFrame([], f"id string, rag {rag}, baseline struct<fake_citation_signal:int,gold_coverage:double>")
    r = evaluate.summarize(empty).first()
    assert r["n"] == 0 and r["rag_refusal_rate"] == 0.0


def test_lint(spark):
    good = "".join(f"## {s}\n" for s in topics.rules.TOPIC_SECTIONS) + "更新于 2024 非诊疗建议 [pmid:1] [note]"
    pages = spark.createDataFrame([("ok", good), ("bad", "## 适用范围 [pmid:2] [wiki:ok]"), ("loose", good)], "slug string, text string")
    index = spark.createDataFrame([("ok",), ("bad",), ("missing",)], "slug string")
    known = spark.createDataFrame([("pmid:1",)], "doc_id string")
    got = {(r["slug"], r["issue"]): r["detail"] for r in topics.lint_pages(pages, index, known).collect()}
    assert set(got) == {("missing", "no_page"), ("loose", "not_in_index"), ("bad", "missing_sections"), ("bad", "no_update_mark"),
                        ("bad", "no_disclaimer"), ("bad", "unknown_citation")}
    assert got["bad", "unknown_citation"] == "pmid:2" and "适用范围" not in got["bad", "missing_sections"]


def test_identifiers(spark):
    catalog = spark.createDataFrame(
        [("pmid:1", "Title", 2000, "J", "u", "10.1/A", {}), ("pmid:2", "Retracted: x", 2001, "J", "u", "", {}),
         ("pmid:3", "x", None, "", "", "", {"pub_types": '["Retraction of Publication"]'})],
        "doc_id string, title string, year int, journal string, url string, doi string, extra map<string,string>")
    ids = spark.createDataFrame([("PMID:1",), ("10.1/a",), ("2",), ("3",), ("9",)], "identifier string")
    got = {r["identifier"]: r["note"] for r in verify.verify_identifiers(ids, catalog).collect()}
    assert got == {"PMID:1": "ok", "10.1/a": "ok", "2": "withdrawn", "3": "withdrawn", "9": "not_found"}


def _plans(monkeypatch, name):
    """Executed plans of all results of ``verify``'s function ``name``."""
    plain, seen = getattr(verify, name), []
    monkeypatch.setattr(verify, name, lambda *a: seen.append(plain(*a)) or seen[-1])
    return lambda: [df._jdf.queryExecution().executedPlan().toString() for df in seen]


@pytest.mark.parametrize("askers", [10_000, 20])
def test_titles_are_not_copied_for_those_who_ask(spark, monkeypatch, askers):
    monkeypatch.setattr(verify, "fits", lambda df: False)
    monkeypatch.setattr(verify, "ASKERS", askers, raising=False)
    catalog = spark.range(300).selectExpr(
        "concat('pmid:', id) doc_id", "concat('title ', id) title", "2000 year", "'' journal", "'' url",
        "concat('10.1/', id % 200) doi", "cast(map() as map<string,string>) extra")
    ids = spark.sql("select '7' identifier from range(100) union all select concat('10.1/', id) from range(250) union all select null")
    plans = _plans(monkeypatch, "answered")
    got = verify.verify_identifiers(ids, catalog).groupBy("identifier", "doc_id", "title", "note").count().collect()
    want = {("7", "pmid:7", "title 7", "ok", 100), (None, None, None, "not_found", 1)}
    want |= {(f"10.1/{i}", f"pmid:{min([i, i + 200], key=str)}", f"title {min([i, i + 200], key=str)}", "ok", 1) for i in range(100)}
    want |= {(f"10.1/{i}", f"pmid:{i}", f"title {i}", "ok", 1) for i in range(100, 200)}
    want |= {(f"10.1/{i}", None, None, "not_found", 1) for i in range(200, 250)}
    assert {tuple(r) for r in got} == want
    assert all("SortMergeJoin" in p for p in plans()) and (askers == 20 or not any("Generate" in p for p in plans()))


@pytest.mark.parametrize("askers", [10_000, 20])
def test_trial_records_are_not_broadcast(spark, monkeypatch, askers):
    monkeypatch.setattr(verify, "ASKERS", askers, raising=False)
    monkeypatch.setattr(verify, "fits", lambda df: False)
    trials = spark.range(300).selectExpr("concat('NCT', id) nct_id", "concat('t', id) title")
    ids = spark.sql("select 'nct7' nct_id from range(100) union all select concat('NCT', id) from range(400) union all select 'x'")
    plans = _plans(monkeypatch, "answered")
    got = dict(verify.trial_records(ids, trials).groupBy("note").count().collect())
    assert got == {"ok": 400, "not_found": 100, "bad_format": 1}
    assert plans() and all("SortMergeJoin" in p for p in plans())


def test_topic_selection_order_and_unknown_slug(spark):
    docs = spark.createDataFrame([("a", 0, 2000, ["x"]), ("b", 1, None, ["x", "y", "y"]), ("c", 2, 2010, ["x"]), ("d", 3, 2010, ["x"])],
                                 "doc_id string, ord long, year int, tags array<string>")
    t = topics.topic_table(spark, [("s", "S", ["x", "y"])])
    assert [r["doc_id"] for r in topics.select_docs(docs, t, 3).orderBy("rank").collect()] == ["b", "c", "d"]
    with pytest.raises(ValueError):
        topics.refresh_page(docs, t, "none", "now")

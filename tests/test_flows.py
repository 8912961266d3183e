import json
import os

from pyspark.sql import functions as F

from corpusloom.operators import common, curate
from corpusloom.plans import ask, build
from corpusloom.plans.answers import finish_answers
from corpusloom.plans.evaluate import compare_arms, write_evaluation
from corpusloom.sources import files

CONTEXT = "question_id string, rank int, doc_id string, source string, title string, text string, year int, url string, evidence_level string"


def contexts(spark):
    return spark.createDataFrame([
        ("n", 1, "pmid:100001", "pubmed", "t", "建议减少盐。避免熬夜；每次 5 mg。", 2000, "", "rct"),
        ("c", 1, "pmid:100001", "pubmed", "t", "应坚持运动。", 2000, "", "rct")], CONTEXT)


def test_answers_are_audited_and_worded(spark):
    answers = spark.createDataFrame([
        ("n", "每次服药 5 mg [1] PMID: 100001", "nutrition", False), ("c", "见 [7]。 [99999999999999999999]", "clinical", False),
        ("r", "无法回答 [9]", "nutrition", True)], "question_id string, answer string, track string, refused boolean")
    got = {r["question_id"]: r for r in finish_answers(answers, contexts(spark), terms=[("mg", "毫克")]).collect()}
    assert got["n"]["ok"] and "5 毫克" in got["n"]["answer"] and "切勿自行调整" in got["n"]["answer"]
    assert got["n"]["tips"] and all("mg" not in t for t in got["n"]["tips"])
    assert not got["c"]["ok"] and "无效引用编号" in got["c"]["answer"] and got["c"]["tips"] == []
    assert got["r"]["answer"] == "无法回答 [9]" and got["r"]["tips"] == []


def test_evaluation_is_written_and_read_back(spark, tmp_path):
    items = spark.createDataFrame([("n", "nutrition", ["盐"]), ("c", "clinical", ["x", "运动"]), ("z", "clinical", [])],
                                  "id string, track string, gold_points array<string>")
    rag = spark.createDataFrame([("n", "少盐 [1]", False), ("c", "拒绝", True)], "question_id string, answer string, refused boolean")
    plain = spark.createDataFrame([("n", "PMID: 1234567 [1] [2] [3]"), ("c", "多运动")], "question_id string, answer string")
    out = write_evaluation(compare_arms(items, rag, plain, contexts(spark)), str(tmp_path / "e"))
    rows = {r["id"]: r for r in out["results"].collect()}
    assert set(rows) == {"n", "c", "z"} and rows["n"]["rag"]["gold_coverage"] == 1.0 and rows["n"]["baseline"]["fake_citation_signal"] == 2
    assert rows["c"]["rag"]["n_contexts"] == 0 and rows["c"]["baseline"]["gold_coverage"] == 0.5
    assert out["summary"].first()["n"] == 3 and out["table"].count() == 3 and out["rubric"].count() == 12
    assert {"results", "summary", "delta", "cases", "rubric", "table"} <= set(os.listdir(tmp_path / "e"))


def test_build_returns_search_tables_and_cleans_up(spark, tmp_path):
    body = "salt and blood pressure trial. " * 40
    docs = files.fixed_docs(spark, [dict(doc_id=f"pmid:{i}", source="pubmed", title=f"Study {i}", text=f"{i} {body}", tags=["diet"], url="u")
                                    for i in range(20)])
    files.write_docs(docs, str(tmp_path / "landed"))
    kb = build.build_corpus([files.read_docs(spark, str(tmp_path / "landed"))], str(tmp_path / "kb"), "2025-01-01", target_chunks=10,
                            paths=[str(tmp_path / "landed")])
    assert kb["vectors"].count() == kb["chunks"].count() and kb["files"].count() > 0
    assert json.loads(kb["manifest"].first()["config"])["target_chunks"] == 10
    assert not os.path.exists(tmp_path / "kb" / "_run")
    asked = spark.createDataFrame([("q", "salt blood pressure", "clinical")], "question_id string, question string, track string")
    scan = ask.ask_batch(kb["chunks"], asked, 3).collect()
    assert ask.ask_batch(kb["chunks"], asked, 3, vectors=kb["vectors"], keyword_index=kb["keyword_index"]).collect() == scan


def test_run_folder_is_removed(spark, tmp_path):
    with common.run_folder(spark, str(tmp_path / "run")) as folder:
        assert common.stored(spark.range(3)).count() == 3 and len(os.listdir(folder)) == 1
    assert not os.path.exists(folder)
    assert common.stored(spark.range(2), str(tmp_path / "own")).count() == 2 and os.path.exists(tmp_path / "own")


def test_values_outside_the_closed_lists(spark):
    docs = files.fixed_docs(spark, [dict(doc_id="a"), dict(doc_id="b", source="blog", evidence_level="none"), dict(doc_id="c", source=None)])
    got = {(r["doc_id"], r["field"], r["value"]) for r in curate.outside_lists(docs).collect()}
    assert got == {("b", "source", "blog"), ("b", "evidence_level", "none"), ("c", "source", None)}
    assert docs.where(F.col("doc_id") == "a").count() == 1

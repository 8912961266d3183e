import json

import pytest
from pyspark.sql import functions as F

from corpusloom.functions import rules
from corpusloom.functions.pieces import pack_paragraphs
from corpusloom.operators import chunk, curate, search_store, topics
from corpusloom.plans import ask, build, catalog
from corpusloom.schemas import STUDIES
from corpusloom.sources import curated, files, markdown, payloads
from corpusloom.streaming import incremental


def test_docs_write_and_read(spark, tmp_path):
    docs = files.fixed_docs(spark, [dict(doc_id="a", title="T", tags=["x"], year=2000, extra={"k": "v"}), dict(doc_id="b", text="正文")])
    assert files.write_docs(docs, str(tmp_path / "d")) == 2
    back = {r["doc_id"]: r for r in files.read_docs(spark, str(tmp_path / "d")).collect()}
    assert back["a"]["extra"] == {"k": "v"} and back["b"]["text"] == "正文"
    (tmp_path / "arr.json").write_text(json.dumps([{"doc_id": "z", "tags": []}, {"doc_id": "y"}], indent=1))
    assert [r["doc_id"] for r in files.read_docs(spark, str(tmp_path / "arr.json"), arrays=True).orderBy("pos").collect()] == ["z", "y"]
    assert files.read_docs(spark, str(tmp_path / "none")).count() == 0


def test_one_file_of_many_rows(spark, tmp_path):
    docs = files.fixed_docs(spark, [dict(doc_id=f"d{i:02d}", text="t") for i in range(20)])
    files.write_docs(docs.coalesce(1), str(tmp_path / "d"))
    back = files.read_docs(spark, str(tmp_path / "d")).orderBy("pos").collect()
    assert [r["doc_id"] for r in back] == [f"d{i:02d}" for i in range(20)]


def test_rejected_records_are_listed(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"doc_id":"a"}\n{broken\n\n{"doc_id":"b"}\n')
    assert [r["doc_id"] for r in files.read_docs(spark, str(tmp_path / "a.json")).orderBy("pos").collect()] == ["a", "b"]
    bad = files.rejected_docs(spark, str(tmp_path / "a.json")).collect()
    assert [r["value"] for r in bad] == ["{broken"] and bad[0]["pos"]["file"].endswith("a.json")
    (tmp_path / "arr").mkdir()
    for name, text in (("one", '[{"doc_id":"x"},{"doc_id":"y"}]'), ("two", "[1, "), ("none", "[ ]"), ("obj", '{"doc_id":"z"}')):
        (tmp_path / "arr" / f"{name}.json").write_text(text)
    assert {r["doc_id"] for r in files.read_docs(spark, str(tmp_path / "arr"), arrays=True).collect()} == {"x", "y", "z"}
    assert files.rejected_docs(spark, str(tmp_path / "arr"), arrays=True).count() == 1
    lines = spark.createDataFrame([("{no",), ('{"id":"1"}',), (" ",)], "value string")
    assert files.questions_from_lines(lines).count() == 1 and files.rejected_lines(lines).count() == 1
    bad = spark.createDataFrame([("{no", 0), ('{"studies":[]}', 1)], "value string, pos long")
    assert payloads.rejected_payloads(bad, STUDIES).count() == 1 and payloads.studies(bad).count() == 0


@pytest.mark.parametrize("size", [60, 333, 5000, 10 ** 8])
@pytest.mark.parametrize("layout", ["indented", "one a line", "some a line", "comma first"])
def test_an_array_is_read_by_several_tasks(spark, tmp_path, size, layout):
    """Every record once, in place, wherever splits fall; strings full of brackets, quotes and escapes; nested values; a broken record."""
    odd = ['a "quoted" ]} [{', "back\\slash \\", "line\nbreak", "", "x" * 700, "},\n{", "[", "\ufeff"]
    rows = [{"doc_id": f"d{i}", "text": odd[i % len(odd)], "tags": ["a", "]"][:i % 3], "extra": {"k": "{" * (i % 4)}} for i in range(60)]
    if layout == "indented":
        text = json.dumps(rows, indent=2)
    elif layout == "one a line":
        text = "[" + ",\n".join(json.dumps(r) for r in rows) + "]\n"
    elif layout == "some a line":
        text = "[\n" + ",\n".join(", ".join(json.dumps(r) for r in rows[i:i + 7]) for i in range(0, 60, 7)) + "\n]"
    else:
        text = "\n[\n  " + "\n, ".join(json.dumps(r) for r in rows) + "\n]\n\n"
    (tmp_path / "a.json").write_text(text)
    (tmp_path / "b.json").write_text(json.dumps({"doc_id": "one", "text": "object", "tags": ["t"]}, indent=2))
    (tmp_path / "c.json").write_text('[\n{"doc_id": "before"},\n{"doc_id": nonsense},\n{"doc_id": "after"}\n]')
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        got = files.read_docs(spark, str(tmp_path), arrays=True).orderBy("pos").collect()
        rejected = files.rejected_docs(spark, str(tmp_path), arrays=True).collect()
        splits = spark.read.text(str(tmp_path / "a.json")).rdd.getNumPartitions()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert [r["doc_id"] for r in got] == [r["doc_id"] for r in rows] + ["one", "before", "after"]
    assert [(r["text"], r["tags"], r["extra"]) for r in got[:60]] == [(r["text"], r["tags"], r["extra"]) for r in rows]
    assert [r["value"] for r in rejected] == ['{"doc_id": nonsense}']
    assert (splits > 10) == (size < 1000)


def test_order_follows_paths_and_places_not_sizes(spark, tmp_path):
    for name, size in (("a", 10), ("b", 5000), ("c", 90000)):
        (tmp_path / f"{name}.md").write_text(f"# {name}\n" + "x" * size)
        (tmp_path / f"{name}.json").write_text("\n".join(json.dumps({"doc_id": f"{name}{i}", "text": "y" * size}) for i in range(3)))
    found = markdown.markdown_docs(markdown.read_markdown(spark, str(tmp_path)), max_chars=10 ** 6).orderBy("pos").collect()
    assert [r["title"] for r in found] == ["a", "b", "c"]
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        read = [files.read_docs(spark, str(tmp_path / f"{n}.json")).orderBy("pos").collect() for n in "abc"]
        assert [[r["doc_id"] for r in rows] for rows in read] == [[f"{n}{i}" for i in range(3)] for n in "abc"]
        every = files.read_docs(spark, str(tmp_path / "*.json")).orderBy("pos").collect()
        assert [r["doc_id"] for r in every] == [f"{n}{i}" for n in "abc" for i in range(3)]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_more_than_31_sources(spark):
    one = [files.fixed_docs(spark, [dict(doc_id=f"s{i}"), dict(doc_id="all", title=str(i))]) for i in range(40)]
    merged = curate.merge_first_wins(curate.union_sources(*one))
    assert merged.count() == 41 and merged.where("doc_id = 'all'").first()["title"] == "0"
    assert [r["doc_id"] for r in merged.orderBy("ord").collect()] == ["s0", "all", *[f"s{i}" for i in range(1, 40)]]


def test_long_years_are_no_year(spark):
    item = {"id": "5", "title": "T", "pubYear": "20201111111"}
    p = spark.createDataFrame([(json.dumps({"resultList": {"result": [item]}}), 0)], "value string, pos long")
    assert payloads.europepmc_docs(p).first()["year"] is None


def test_questions_skip_blank_lines(spark, tmp_path):
    (tmp_path / "q.jsonl").write_text('{"id":"c1","question":"Q","track":"clinical","must_cite":true,"gold_points":["a"]}\n\n   \n{"id":"x1","question":"R"}\n')
    rows = {r["id"]: r for r in files.read_questions(spark, str(tmp_path / "q.jsonl")).collect()}
    assert set(rows) == {"c1", "x1"} and rows["x1"]["gold_points"] == [] and rows["x1"]["must_cite"] is True


def test_markdown_directory(spark, tmp_path):
    (tmp_path / "short.md").write_text("# T\nbody")
    long = "intro\r\n# One\n" + "para one. " * 20 + "\n\n" + "x" * 400 + "\n## \nuntitled\n####### no heading\n#not\n# Two\n"
    (tmp_path / "long.md").write_text(long)
    (tmp_path / "skip.txt").write_text("no")
    files_df = markdown.read_markdown(spark, str(tmp_path))
    rows = {r["doc_id"]: r for r in markdown.markdown_docs(files_df, whole_below=100, max_chars=250).collect()}
    assert rows["local:md:short"]["text"] == "# T\nbody" and rows["local:md:short"]["title"] == "short"
    assert rows["local:md:long:0"]["title"] == "long" and rows["local:md:long:0"]["text"] == "intro"
    body = ("# One\n" + "para one. " * 20 + "\n\n" + "x" * 400).strip()
    parts = pack_paragraphs(body, 250)
    assert [rows[f"local:md:long:1:{j}"]["text"] for j in range(len(parts))] == parts
    assert rows["local:md:long:1:0"]["title"] == "One（1）"
    assert rows["local:md:long:2"]["title"] == "One" and "####### no heading\n#not" in rows["local:md:long:2"]["text"]
    assert rows["local:md:long:3"]["title"] == "Two"


def test_literature_tables(spark):
    md = ("# list\n| 证据角色 | 文献 | PMID |\n|---|---|---|\n| 文献 RCT | Li et al. *Heart* <b>x</b> | PMID 1234567 · 10.1000/ab |  2019 |\n"
          "| again | et al | 1234567 |\n| BM25 | 7654321 |\n| 队列 | [Wu et al](http://x) | 87654321 | \n text | 11111111\n")
    rows = {r["doc_id"]: r for r in markdown.literature_docs(spark.createDataFrame([("f", md)], "file string, text string")).collect()}
    assert set(rows) == {"pmid:1234567", "pmid:87654321"}
    a = rows["pmid:1234567"]
    assert (a["title"], a["doi"], a["year"], a["journal"]) == ("Li et al. *Heart* x", "10.1000/ab", 2019, "Li et al. *Heart* <b>x</b>")
    assert a["evidence_level"] == "rct" and rows["pmid:87654321"]["evidence_level"] == "observational"
    assert rows["pmid:87654321"]["title"] == "Wu et al"
    assert a["text"].startswith(rules.LITERATURE_TEXT_PREFIX)


def test_literature_skip_words_and_year_cells(spark):
    md = ("| PARAGRAPH ÑRAGA | Li et al. | 1234567 |\n| GraphRAG | Wu et al. | 2345678 |\n| 用RAG检索 | Wu et al. | 3456789 |\n"
          "| call 555-1941 | Ma et al. | 4567890 | 2011 |\n| in 1999 | Xu et al. | 5678901 |\n")
    rows = markdown.literature_docs(spark.createDataFrame([("f", md)], "file string, text string")).collect()
    assert {(r["doc_id"], r["year"]) for r in rows} == {("pmid:1234567", None), ("pmid:4567890", 2011), ("pmid:5678901", 1999)}


XML = """<?xml version="1.0"?><PubmedArticleSet><PubmedArticle><MedlineCitation><PMID>11</PMID><Article><Journal><JournalIssue><PubDate>
<MedlineDate>2001 Jan</MedlineDate></PubDate></JournalIssue><Title>J One</Title></Journal><ArticleTitle>Salt <i>and</i> pressure</ArticleTitle>
<Abstract><AbstractText>First <b>bold</b> part.</AbstractText><AbstractText>Second.</AbstractText></Abstract><PublicationTypeList>
<PublicationType>Meta-Analysis</PublicationType></PublicationTypeList></Article></MedlineCitation><PubmedData><ArticleIdList>
<ArticleId IdType="doi">10.1/own</ArticleId></ArticleIdList><ReferenceList><Reference><ArticleIdList><ArticleId IdType="doi">10.1/other</ArticleId>
</ArticleIdList></Reference></ReferenceList></PubmedData></PubmedArticle><PubmedArticle><MedlineCitation><PMID>12</PMID><Article>
<ArticleTitle>Only title &amp; sodium</ArticleTitle></Article></MedlineCitation></PubmedArticle></PubmedArticleSet>"""


@pytest.mark.parametrize("parts", [0, 1, 2, 24, 25, 26, 60])
def test_articles_of_many_parts(parts):
    made = "".join(f"<AbstractText>part <b>x</b> y {i}</AbstractText>" for i in range(parts))
    got = payloads.article_fields(f"<PubmedArticle><Abstract>{made}</Abstract></PubmedArticle>")
    assert got["parts"] == [f"part x y {i}" for i in range(parts)]


def test_broken_articles_are_listed(spark):
    rows = spark.createDataFrame([("<PubmedArticle><PMID>1</PubmedArticle>", 0), ("<PubmedArticle><PMID>2</PMID></PubmedArticle>", 1), (None, 2)],
                                 "xml string, pos long")
    assert [r["doc_id"] for r in payloads.pubmed_docs(rows).collect()] == ["pmid:2"]
    assert {r["pos"] for r in payloads.rejected_articles(rows).collect()} == {0, 2}


def test_article_xml(spark, tmp_path):
    (tmp_path / "a.xml").write_text(XML)
    rows = {r["doc_id"]: r for r in payloads.pubmed_docs(payloads.read_pubmed_xml(spark, str(tmp_path))).collect()}
    a = rows["pmid:11"]
    assert (a["title"], a["text"], a["year"], a["journal"], a["doi"]) == (
        "Salt and pressure", "First bold part.\nSecond.", 2001, "J One", "10.1/own")
    assert a["evidence_level"] == "meta" and a["extra"] == {"pub_types": '["Meta-Analysis"]'}
    b = rows["pmid:12"]
    assert (b["text"], b["year"], b["tags"], b["doi"]) == ("Only title & sodium", None, ["diet"], "")


def test_registry_payload(spark, tmp_path):
    study = {"protocolSection": {"identificationModule": {"nctId": "NCT00000001", "briefTitle": "Diet"}, "statusModule": {"overallStatus": "DONE"},
             "outcomesModule": {"secondaryOutcomes": [{"measure": "m", "timeFrame": "t"}]}}}
    (tmp_path / "t.json").write_text(json.dumps({"studies": [study, {"protocolSection": {}}]}, indent=1))
    rows = payloads.trial_docs(payloads.studies(payloads.read_json_payloads(spark, str(tmp_path)))).orderBy("pos").collect()
    assert rows[0]["text"] == "Diet\n\nStatus: DONE\nConditions: \nInterventions: \nPrimary Outcome: m（t）"
    assert (rows[0]["doc_id"], rows[0]["tags"], rows[0]["year"]) == ("nct:NCT00000001", ["diet"], None)


def test_europepmc_payload(spark):
    item = {"source": "MED", "id": "5", "pmid": "5", "title": "T", "pubYear": "2020", "isOpenAccess": "Y"}
    p = spark.createDataFrame([(json.dumps({"resultList": {"result": [item, {"doi": "10.1/x"}]}}), 0)], "value string, pos long")
    a, b = payloads.europepmc_docs(p).orderBy("pos").collect()
    assert (a["doc_id"], a["text"], a["url"]) == ("epmc:MED:5", "T", "https://pubmed.ncbi.nlm.nih.gov/5/")
    assert (b["doc_id"], b["url"]) == ("epmc:MED:10.1/x", "https://europepmc.org/article/MED/10.1/x")


def test_curated_lines(spark):
    lines = ['{"id":" pmid:7 ","text":"x","source_type":"cohort_study","pmcid":"P"}', '{"id":""}', ""]
    df = spark.createDataFrame([(v, i) for i, v in enumerate(lines)], "value string, pos long")
    r = curated.curated_docs(df, "salt").collect()
    assert len(r) == 1 and r[0]["title"] == "pmid:7" and r[0]["tags"] == ["salt", "cohort_study"]
    assert r[0]["url"].endswith("/7/") and r[0]["evidence_level"] == "observational" and r[0]["extra"] == {"source_type": "cohort_study", "pmcid": "P"}


def make_docs(spark, n=40):
    body = "salt and blood pressure trial. " * 60
    return files.fixed_docs(spark, [dict(doc_id=f"pmid:{i}", source="pubmed", title=f"Study {i}", text=f"Number {i}. " + body,
                                         tags=["hypertension", "diet"], year=2000 + i % 20, url="u", evidence_level="rct") for i in range(n)])


def test_build_and_ask(spark, tmp_path):
    docs = make_docs(spark)
    out = build.build_corpus([docs, docs], str(tmp_path / "kb"), "2025-01-01", target_chunks=50)
    stages = {r["stage"]: r["n"] for r in out["manifest"].collect()}
    assert stages["source_0"] == stages["documents"] == 40 and stages["topic_pages"] == 8
    assert stages["documents_with_pages"] == 48 and stages["chunks"] == out["chunks"].count() >= 80
    topics.write_pages(out["topic_pages"], str(tmp_path / "pages"))
    assert len(list((tmp_path / "pages").glob("slug=*"))) == 8
    with pytest.raises(Exception, match="too few chunks"):
        build.build_corpus([docs], str(tmp_path / "kb2"), "2025-01-01", target_chunks=10_000)
    q = spark.createDataFrame([("c1", "sodium blood pressure", "clinical"), ("n1", "他汀吃多少", "nutrition"), ("x1", "mars dust", "clinical")],
                              "question_id string, question string, track string")
    kept = []
    rows = {r["question_id"]: r for r in ask.ask_batch(out["chunks"], q, 3, contexts_to=kept.append).collect()}
    assert rows["n1"]["reason"] == "dosage_request" and rows["x1"]["reason"] == "out_of_scope"
    assert rows["c1"]["refused"] is False and rows["c1"]["n_contexts"] == 3 and rows["c1"]["block"].startswith("[1] (")
    assert kept[0].where("question_id = 'c1'").count() == 3
    build.write_search_tables(out["chunks"], str(tmp_path / "kb"))
    again = ask.ask_batch(
        out["chunks"], q, 3, vectors=(now := search_store.snapshot(spark, str(tmp_path / "kb" / "search"))).vectors,
        keyword_index=now.keyword_index).collect()
    assert {r["question_id"]: r for r in again} == rows


def test_stream_replaces_documents(spark, tmp_path):
    landing, table, state = (str(tmp_path / n) for n in ("in", "table", "state"))

    def land(n, text):
        docs = make_docs(spark, n).withColumn("text", F.concat(F.lit(text), "text")).drop("pos")
        docs.coalesce(1).write.mode("append").json(landing)

    def run():
        q = incremental.stream_documents(spark, landing, table, state, buckets=4)
        q.awaitTermination(120)
        assert q.exception() is None

    land(6, "old ")
    run()
    first = incremental.read_chunks(spark, table)
    before = first.count()
    assert first.select("doc_id").distinct().count() == 6
    assert search_store.snapshot(spark, table).body["buckets"] == 4
    land(2, "new ")
    run()
    second = incremental.read_chunks(spark, table)
    assert second.count() == before
    heads = {r["doc_id"]: r["text"][:3] for r in second.where("chunk_index = 0").collect()}
    assert heads["pmid:0"] == heads["pmid:1"] == "new" and heads["pmid:5"] == "old"
    want = chunk.docs_to_chunks(make_docs(spark, 6).withColumn("text", F.concat(F.lit("old "), "text")), merge_below=rules.CHUNK_MIN_CHARS)
    assert second.count() == want.count()


def test_files_of_documents_grow_with_the_table(spark, tmp_path):
    rows = [(i, f"title {i}\n" + "some text " * 400, "en", "s", 4000 + i) for i in range(4000)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(16).write.parquet(
        str(tmp_path / "documents.parquet"))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "100k")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        back = catalog.QUERIES["docs_files"](spark, str(tmp_path))
        assert len(back.inputFiles()) > 3 and back.select("doc_id").distinct().count() == back.count() == len(rows)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")

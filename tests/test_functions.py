import pytest
from pyspark.sql import functions as F

from corpusloom.functions import rules, scoring, text, wording
from corpusloom.functions.pieces import embed_text, embedder

C = F.col


@pytest.mark.parametrize("raw,title,want", [
    ("Practice Guideline", "x", "guideline"), ("", "A Meta-Analysis of a guideline", "guideline"),
    ("Systematic Review", "", "meta"), ("Randomized Controlled Trial", "", "rct"), ("", "某某随机研究", "rct"),
    ("Cohort", "", "observational"), ("", "The handbook", "ebook"), ("", "wikipedia", "wiki"), ("Letter", "x", "other")])
def test_level_from_type_and_title(one, raw, title, want):
    assert one(text.normalize_level(C("a"), C("b"), rules.TITLE_LEVEL_RULES), a=raw, b=title) == want


def test_text_rules_put_meta_before_guideline(one):
    blob = "a guideline and a meta-analysis"
    assert one(text.level_from_rules(C("a"), rules.TEXT_LEVEL_RULES), a=blob) == "meta"
    assert one(text.normalize_level(C("a"), F.lit(""), rules.TITLE_LEVEL_RULES), a=blob) == "guideline"


@pytest.mark.parametrize("doi,want", [
    (" https://doi.org/10.1/A ", "10.1/a"), ("http://doi.org/10.1/a", "10.1/a"), ("DOI: 10.1/a", "10.1/a"), ("doi:", ""),
    ("https://doi.org/doi:10.1/a", "10.1/a")])
def test_doi(one, doi, want):
    assert one(text.normalize_doi(C("a")), a=doi) == want


@pytest.mark.parametrize("title,want", [
    ("The Salt Trial", "salttrial"), ("A  Salt-Trial!", "salttrial"), ("———", ""), ("Theory", "theory"), ("限盐 研究_1", "限盐研究_1"),
    (" an Été", "été")])
def test_title(one, title, want):
    assert one(text.normalize_title(C("a")), a=title) == want


def test_tokens_mix_words_and_character_pairs(one):
    got = one(text.search_tokens(C("a")), a="DASH饮食 and 钠 Étude LDL-C 高血压患者 x_1")
    assert got == ["dash", "饮食", "and", "钠", "tude", "ldl", "c", "高血", "血压", "压患", "患者", "x_1"]
    assert one(text.index_tokens(C("a")), a="—— é") == ["empty"]
    assert one(text.word_set(C("a")), a="Étude é étude 高血压!") == ["étude", "é", "高血压"]


def test_recency(one):
    w = lambda y: one(scoring.recency_weight(C("y").cast("int"), 2024), y=y)
    assert (w(2024), w(2016), w(2030), w(None)) == (1.0, 0.5, 1.0, 0.5)


def test_plain_terms_cascade_in_order(one):
    got = one(wording.plain_terms(C("a")), a="低密度脂蛋白胆固醇（LDL-C）")
    want = "低密度脂蛋白胆固醇（LDL-C）"
    for term, plain in rules.PLAIN_TERMS:
        want = want.replace(term, plain)
    assert got == want and got.count("坏胆固醇") >= 2


@pytest.mark.parametrize("q,want", [
    ("他汀每天吃多少", True), ("二甲双胍 500 mg 怎么服用", True), ("可以停药吗", True), ("每天吃几克盐", False), ("地中海饮食好吗", False)])
def test_dose_request(one, q, want):
    assert one(wording.asks_for_dose(C("a")), a=q) is want


def test_dose_in_answer(one):
    assert one(wording.mentions_dose(C("a")), a="每次 5 mg") is True
    assert one(wording.mentions_dose(C("a")), a="每天盐少于 5 克") is False


def test_query_expansion(one):
    e = wording.expand_query(C("q"))
    assert one(e, q=" 坚果和DASH ") == "坚果和DASH nuts cardiovascular risk DASH diet blood pressure hypertension"
    assert one(e, q="其他") == "其他"
    assert one(e, q="坚果" + "x" * 600).endswith("x nuts cardiovascular risk")
    assert len(one(wording.expand_query(C("q"), most=500), q="坚果" + "x" * 600)) == 500
    assert one(wording.search_text(C("q")), q=" a\nb ") == "a\nb" and one(wording.search_text(C("q"), True, 1), q="ac\nb") == "a"


@pytest.mark.parametrize("d,i,o,want", [
    ("hypertension", "", "", "hypertension[Title/Abstract] OR hypertension[MeSH Terms] AND hasabstract[text]"),
    ("type 2  diabetes", "a b OR c", "risk",
     '"type 2 diabetes"[Title/Abstract] OR type 2 diabetes[MeSH Terms] AND ("a b"[Title/Abstract] OR c[Title/Abstract])'
     ' AND risk[Title/Abstract] AND hasabstract[text]'),
    ("", "", "", "")])
def test_literature_query(one, d, i, o, want):
    assert one(wording.literature_query(C("d"), C("i"), C("o")), d=d, i=i, o=o) == want


def test_term_clauses(one):
    t = wording.decorate_term(C("q"), C("a"), C("b"), C("k"))
    assert one(t, q=" salt ", a=2018, b=0, k="review") == 'salt AND 2018:3000[dp] AND "review"[pt]'
    assert one(t, q="salt", a=0, b=0, k="") == "salt"


def test_ocr(one):
    got = one(text.clean_ocr(C("a"), rules.OCR_PAGE_MARK), a="===== 第3页 =====\nx\n\n\n\ny \t  z\n===== 第4页 =====\n")
    assert got == "x\n\ny z"


def test_completeness(one):
    c = scoring.completeness(C("n"), F.lit(True), F.lit(True), F.lit(False), F.lit(True), F.lit(2))
    assert one(c, n=10) == 10 + 1000 + 500 + 300 + 200


def test_embedding_matches_plain_hashing(spark):
    import hashlib
    import math
    import re

    def plain(t):
        vec = [0.0] * 384
        for tok in re.findall(r"\w+", t.lower()) or ["empty"]:
            h = int(hashlib.md5(tok.encode()).hexdigest(), 16)
            vec[h % 384] += 1
            vec[h // 384 % 384] += 0.5
        n = math.sqrt(sum(v * v for v in vec))
        return [v / n for v in vec]

    texts = ["", "salt Salt sugar", "高血压 饮食 é_1", "a " * 500]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", embedder()(C("t")).alias("v")).collect()
    for r in got:
        assert r["v"] == pytest.approx(plain(r["t"]), abs=1e-12)
    assert embed_text("x").shape == (384,)


def test_evidence_card(one):
    card = wording.evidence_card(C("t"), C("y").cast("int"), C("j"), C("u"))
    assert one(card, t="", y=0, j="", u="") == "标题：（无标题）\n年份：未知 | 期刊：未知\n链接："

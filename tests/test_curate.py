import random

from pyspark.sql import functions as F, types as T

from corpusloom.operators import curate
from corpusloom.operators.common import stored
from corpusloom.schemas import DOC, DOC_FIELDS
from corpusloom.sources.files import fixed_docs

SCHEMA = T.StructType(DOC.fields + [T.StructField("ord", T.LongType())])


def frame(spark, rows):
    return spark.createDataFrame([tuple(r[f] for f in DOC_FIELDS) + (i,) for i, r in enumerate(rows)], SCHEMA)


def doc(doc_id, **kw):
    base = dict(doc_id=doc_id, source="local", title="", text="", year=None, url="", tags=[], evidence_level="other",
                journal="", doi="", extra={})
    return {**base, **kw}


def score(d):
    return (len(d["text"].strip()) + 1000 * bool(d["year"]) + 500 * bool(d["url"]) + 500 * bool(d["journal"])
            + 300 * bool(d["doi"]) + 100 * len(d["tags"]))


def walk(rows, key):
    """The fold, one document at a time."""
    groups = {}
    for r in rows:
        k = key(r)
        if k not in groups:
            groups[k] = r
            continue
        old = groups[k]
        top, low = (r, old) if score(r) > score(old) else (old, r)
        new = dict(top)
        for f in ("url", "journal", "doi", "year"):
            new[f] = top[f] or low[f]
        new["text"] = top["text"] if top["text"].strip() or not low["text"].strip() else low["text"]
        new["tags"] = top["tags"] + [t for t in low["tags"] if t not in top["tags"]]
        new["extra"] = {**low["extra"], **top["extra"]}
        groups[k] = new
    return {v["doc_id"]: v for v in groups.values()}


def check(spark, rows, key):
    got = {r["doc_id"]: r.asDict() for r in curate.dedupe_fold(frame(spark, rows)).collect()}
    want = walk(rows, key)
    assert set(got) == set(want)
    for k, w in want.items():
        for f in DOC_FIELDS:
            assert got[k][f] == w[f], (k, f)


def test_fold_equals_sequential_walk_with_one_hot_key(spark):
    rng = random.Random(7)
    rows = []
    for i in range(2500):
        k = rng.randrange(150) if rng.random() < 0.6 else 0
        rows.append(doc(
            f"d{i}", title=f"The Title {k}", year=rng.choice([None, 2000 + i % 20]), url=rng.choice(["", f"u{i}"]),
            text=rng.choice(["", "  ", "x" * rng.randrange(5), "y" * rng.randrange(900), "z" * rng.randrange(3000)]),
            tags=rng.sample(list("abcdefgh"), rng.randrange(4)), journal=rng.choice(["", f"j{i}"]),
            doi=f"10.1/{k}" if k % 3 == 1 else "",
            extra={rng.choice("pqr"): f"v{i}" for _ in range(rng.randrange(3))}))
    check(spark, rows, lambda r: r["doi"] or r["title"])


def test_fold_on_rising_completeness(spark):
    """Every document takes over from the one before."""
    rows = [doc(f"d{i}", title="same", text="x" * (i + 1), tags=[f"t{i % 5}"]) for i in range(300)]
    check(spark, rows, lambda r: "k")


def test_dedupe_edges(spark):
    rows = [
        doc("pmid:1", doi="10.1/a", title="The Salt Trial", tags=["x"], text="t" * 10),
        doc("epmc:MED:1", doi="https://doi.org/10.1/A", title="Salt trial", year=2020, url="u", tags=["y"], text="t" * 10),
        doc("local:n1", title="A  Salt-Trial!", year=2019, text="t" * 400),
        doc("local:n2", title="salt trial", url="v", tags=["z"], text="t" * 400),
        doc("local:n3", doi="doi:", title="!!!", text="t" * 5),
        doc("local:n4", title="———", text="t" * 5)]
    out = {r["doc_id"]: r for r in curate.dedupe_fold(frame(spark, rows)).collect()}
    assert set(out) == {"epmc:MED:1", "local:n1", "local:n3", "local:n4"}
    assert out["epmc:MED:1"]["tags"] == ["y", "x"]
    assert (out["local:n1"]["url"], out["local:n1"]["tags"], out["local:n1"]["year"]) == ("v", ["z"], 2019)


def test_dedupe_is_idempotent_and_keys_are_unique(spark):
    rows = [doc(f"d{i}", title=f"t {i % 7}", text="x" * (i * 13 % 50)) for i in range(60)]
    once = curate.dedupe_fold(frame(spark, rows))
    twice = curate.dedupe_fold(once)
    assert sorted(map(str, once.select("doc_id", "text", "ord").collect())) == sorted(
        map(str, twice.select("doc_id", "text", "ord").collect()))
    keys = once.select(curate.dedupe_key(F.col("doc_id"), F.col("doi"), F.col("title")).alias("k"))
    assert keys.distinct().count() == keys.count() == 7


def test_first_source_wins(spark):
    a = fixed_docs(spark, [dict(doc_id="pmid:1", title="first"), dict(doc_id="pmid:2")])
    b = fixed_docs(spark, [dict(doc_id="pmid:1", title="later copy", year=2024), dict(doc_id="pmid:3")])
    out = curate.merge_first_wins(curate.union_sources(a, b)).orderBy("ord").collect()
    assert [(r["doc_id"], r["title"]) for r in out] == [("pmid:1", "first"), ("pmid:2", ""), ("pmid:3", "")]


def test_open_access(spark):
    rows = [doc("a", extra={"isOpenAccess": "y"}), doc("b", extra={"inPMC": "Y"}, doi="10.1/x"), doc("c", extra={"inPMC": "Y"}),
            doc("d"), doc("e", extra={"inPMC": "Y"}, url="u")]
    from pyspark.sql import Observation
    seen = Observation()
    got = curate.open_access_only(frame(spark, rows), seen).collect()
    assert sorted(r["doc_id"] for r in got) == ["a", "b", "e"]
    assert seen.get == {"kept": 3, "dropped": 2}


def test_enrich_keeps_explicit_level(spark):
    rows = [doc("a", title="Guideline on diet", tags=["local"]), doc("b", title="随机 study", evidence_level="ebook", text="Blood Pressure")]
    out = {r["doc_id"]: r for r in curate.enrich_local(frame(spark, rows)).collect()}
    assert (out["a"]["tags"], out["a"]["evidence_level"]) == (["local", "diet", "guideline"], "guideline")
    assert (out["b"]["tags"], out["b"]["evidence_level"]) == (["hypertension"], "ebook")


def test_equal_positions_do_not_multiply_rows(spark):
    rows = [doc("a", title="x", text="1"), doc("b", title="x", text="22"), doc("c", title="y", doi="10.1/z"), doc("d", title="q", doi="10.1/z", text="t")]
    same = frame(spark, rows).withColumn("ord", F.lit(5).cast("long"))
    got = {r["doc_id"]: r for r in curate.dedupe_fold(same).collect()}
    assert set(got) == {"b", "d"} and got["b"]["ord"] == 5


def test_fold_sends_single_documents_past(spark):
    rows = [doc(f"d{i}", title=f"t{i}", text="x", tags=["a", "a"], year=0, extra={"k": "", "l": "v"}) for i in range(5)]
    got = curate.dedupe_fold(frame(spark, rows)).collect()
    assert len(got) == 5 and all(r["tags"] == ["a"] and r["year"] is None and r["extra"] == {"l": "v"} for r in got)


def test_any_split_into_batches_folds_alike(spark):
    rng = random.Random(11)
    rows = []
    for i in range(220):
        k = rng.randrange(25) if rng.random() < 0.7 else 0
        rows.append(doc(f"d{i}", title=rng.choice(["The ", ""]) + f"Title {k}" if rng.random() < 0.9 else "", text="x" * rng.choice([0, 0, 3, 900, 1500]),
                        year=rng.choice([None, 0, 2001 + i % 9]), url=rng.choice(["", f"u{i}"]), journal=rng.choice(["", f"j{i}"]),
                        doi=rng.choice(["", "", f"10.1/{k % 7}", f"https://doi.org/10.1/{k % 7}"]), tags=rng.sample("abcdef", rng.randint(0, 3)),
                        extra={rng.choice("pqr"): rng.choice(["", f"e{i}"])}))
    whole = frame(spark, rows)
    want = {r["doc_id"]: r for r in curate.dedupe_fold(whole).collect()}
    for cuts in ([70], [1, 2, 100, 219]):
        corpus, at = None, 0
        for end in [*cuts, len(rows)]:
            part = stored(whole.where((F.col("ord") >= at) & (F.col("ord") < end)))
            before = corpus
            corpus = stored(curate.dedupe_fold(part) if corpus is None else curate.fold_into(corpus, part))
            if before is not None:
                changed, gone = curate.folded_changes(before, corpus)
                kept = {r["doc_id"] for r in before.collect()} - {r["doc_id"] for r in gone.collect()}
                assert kept | {r["doc_id"] for r in changed.collect()} == {r["doc_id"] for r in corpus.collect()}
            at = end
        assert {r["doc_id"]: r for r in corpus.collect()} == want


def test_texts_of_single_documents_do_not_move(spark):
    rows = [doc(f"d{i}", title=f"T{i if i > 40 else i % 7}", text=f"text {i}") for i in range(300)]
    whole = stored(frame(spark, rows))
    for df in (curate.merge_first_wins(whole), curate.dedupe_fold(whole)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        # The branch of rows that are certainly alone reads the table and goes through broadcast joins only.
        union = df._jdf.queryExecution().optimizedPlan()
        branches = []

        def split(p):
            if p.nodeName() == "Union":
                for i in range(p.children().size()):
                    split(p.children().apply(i))
            elif p.nodeName() == "Project" and p.children().apply(0).nodeName() in ("Union", "Project"):
                split(p.children().apply(0))
            else:
                branches.append(p.toString())

        split(union)
        alone = [b for b in branches if "Window" not in b and "Aggregate [key" not in b and "NOT " in b.upper() and "LeftAnti" not in b]
        assert alone and all(b.count("Join LeftOuter") == b.count("strategy=broadcast") for b in alone), plan

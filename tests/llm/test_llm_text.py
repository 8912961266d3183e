"""Licence scan, quality model, language model and decontamination."""

import hashlib
import random
import re
from collections import Counter
from itertools import product

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.llm import decontaminate, license_scan, line_crf, masked_lm

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words_of(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


# Licence scan

def test_template_regions():
    a = license_scan.compile_template("x", 'Keep <<beginOptional>>all of<<beginOptional>> my<<endOptional>><<endOptional>> this '
                                           '<<var;name="who";original="me";match="[a-z]+( [a-z]+)?">> notice')
    def end(text):
        return a.end(text.encode().split(), 0)
    assert end("keep this big notice") == 4 and end("keep all of this my own notice") == 7
    assert end("keep all of my this one notice more") == 7
    assert end("keep this notice") is None and end("keep all this one notice") is None
    assert end("keep this a b c notice") is None and end("keep this 12 notice") is None
    assert a.needed == {b"keep", b"this", b"notice"} and a.firsts() == {b"keep"}


def test_automaton_agrees_with_a_pattern():
    """A template of optional words as a regular expression over joined words."""
    a = license_scan.compile_template("x", "a<<beginOptional>>b<<endOptional>><<beginOptional>>b c<<endOptional>>a")
    pattern = re.compile(r"a( b)?( b c)? a(?= |$)")
    for size in range(1, 7):
        for row in product("abc", repeat=size):
            line = " ".join(row)
            ends = [len(m.group().split()) for m in [pattern.match(line)] if m]
            # A greedy pattern and the longest way agree where there is only one way.
            got = a.end([w.encode() for w in row], 0)
            assert (got is not None) == bool(ends)


def test_full_texts_and_near_misses():
    scanner = license_scan.Scanner()
    def labels(text):
        return {label for label, *_ in scanner.matches([w.encode() for w in words_of(text)])}
    for label, markup in license_scan.TEMPLATES:
        shown = re.sub(r'<<var;name="[^"]*";original="([^"]*)".*?>>', r" \1 ", markup)
        bare = re.sub(r"<<beginOptional>>.*?<<endOptional>>", " ", shown) if "<<beginOptional>><<var" not in markup else None
        whole = re.sub(r"<<(beginOptional|endOptional)>>", " ", shown)
        assert label in labels("x " + whole + " y") or "<<endOptional>><<beginOptional>>" in markup
        if bare:
            assert label in labels(bare)
    assert "mit" not in labels("Permission is hereby granted, free of charge, to any person obtaining a copy of nothing")
    assert labels("Licensed under CC BY-NC 4.0.") == {"cc-by-nc"} and labels("Licensed under CC BY-XX 4.0.") == set()
    assert labels("GNU General Public License version 3") == {"gpl", "gpl-3.0"}


@pytest.mark.parametrize("label", ["mit", "bsd-2-clause", "bsd-3-clause", "isc", "0bsd", "zlib", "bsl-1.0", "unlicense"])
def test_a_whole_licence_without_one_sentence_is_none(label):
    scanner = license_scan.Scanner()
    markup = max((m for x, m in license_scan.TEMPLATES if x == label), key=len)
    bare = re.sub(r"<<beginOptional>>(?:(?!<<beginOptional>>).)*?<<endOptional>>", " ", re.sub(
        r'<<var;name="[^"]*";original="([^"]*)".*?>>', r" \1 ", markup))
    bare = re.sub(r"<<beginOptional>>.*?<<endOptional>>", " ", bare)

    def found(text):
        return label in {x for x, *_ in scanner.matches([w.encode() for w in words_of("see " + text + " end")])}

    sentences = re.split(r"(?<=[.;:]) +", bare)
    assert found(bare) and found(bare.upper()) and len(sentences) >= 3
    for i, s in enumerate(sentences):
        if len(words_of(s)) >= 3:
            assert not found(" ".join(sentences[:i] + sentences[i + 1:])), s


@pytest.mark.parametrize("n", [1, 24, 25, 400])
def test_open_regions_have_no_length_bound(n):
    scanner, names = license_scan.Scanner(), " ".join(f"holder{i}" for i in range(n))
    def found(label):
        """The one template of a label with its open regions filled with ``names``."""
        markup = max((m for x, m in license_scan.TEMPLATES if x == label), key=len)
        text = re.sub(r"<<(beginOptional|endOptional)>>", " ", re.sub(r'<<var;(?:(?!>>).)*match="[^"]*\.\+">>', f" copyright {names} ", markup))
        words = [w.encode() for w in words_of("x " + text + " y")]
        return len(words), [(a, b) for x, _, a, b in scanner.matches(words) if x == label]
    for label in ("mit", "bsd-2-clause", "bsd-3-clause"):
        size, spans = found(label)
        assert (1, size - 1) in spans
    a = license_scan.compile_template("x", 'by <<var;name="w";original="me";match=".+">> as is')
    words = f"by {names} as x as is later as is".encode().split()
    assert a.end(words, 0) == n + 5 and a.end(b"by as is".split(), 0) is None
    b = license_scan.compile_template("x", 'v <<var;name="w";original="4 0";match="[0-9]( [0-9])?">>')
    assert b.end(b"v 4 0 1 2".split(), 0) == 3


def test_scan_against_brute_force(tricky, no_docs, table_of):
    texts = [r.text for r in tricky.collect()] + ["mit license mit license apache license", "General Public\nLicense, general-public-license",
             "éMIT License", "mit licenses", "MIT License " * 50]
    got = license_scan.scan(table_of(enumerate(texts)), with_spans=True).collect()
    for r in got:
        w = words_of(texts[r.doc_id])
        places = [(i, label) for label, p in license_scan.BASE for i in range(len(w)) if w[i:i + len(p.split())] == p.lower().split()]
        at = [i for i, _ in places]
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (len(w), len(at), min(at, default=None), max(at, default=None))
        assert r.base_labels == ",".join(sorted({x for _, x in places})) and set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(","))
        inside = {k for s in r.spans for k in range(s.first, s.end)}
        assert r.score == (len(inside) / len(w) if w else 0)
    assert license_scan.scan(no_docs).count() == 0 and license_scan.scan(tricky).count() == tricky.count()


# Quality

def test_marginals_against_enumeration():
    rng = np.random.default_rng(0)
    sizes, psi = np.array([3, 1, 5, 2, 1]), rng.normal(size=(2, 2))
    e = rng.normal(size=sizes.sum())
    forward, backward = line_crf.chain_of(sizes).messages(e, psi)
    at = 0
    for n in sizes:
        total, good = 0, np.zeros(n)
        for y in product((0, 1), repeat=int(n)):
            p = np.exp(sum(e[at + t] * y[t] for t in range(n)) + sum(psi[y[t], y[t + 1]] for t in range(n - 1)))
            total, good = total + p, good + p * np.array(y)
        assert np.allclose(1 / (1 + np.exp(-(forward + backward)[at:at + n])), good / total)
        at += n


def noisy(rng, bad):
    lines = [" ".join(rng.choice(["the", "on", "of", "an"]) + rng.choice("abcdefgh") for _ in range(12)) + "." for _ in range(rng.randint(1, 8))]
    if bad:
        lines[rng.randrange(len(lines))] = rng.choice(["BUY!! NOW!! " * 10, "a%%% b### c$$$ " * 10, "x | y | z | " * 10])
    return "\n".join(lines)


@pytest.fixture(scope="module")
def marked(spark):
    rng = random.Random(2)
    rows = [(i, noisy(rng, i % 3 == 0), int(i % 3 != 0)) for i in range(600)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2], 0) for r in rows] + [(None, 1, 0), (7, None, 1)], "doc_id long, quality int, toxic int")
    return docs, labels


def test_held_out_accuracy(marked):
    docs, labels = marked
    rows = line_crf.quality(docs, labels).join(labels.where("quality is not null"), "doc_id").where("held_out").collect()
    assert len(rows) > 100 and sum(r.predicted == r.quality for r in rows) > 0.97 * len(rows)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)


def test_scores_use_the_text_alone(marked, spark):
    docs, labels = marked
    changed = labels.withColumn("quality", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, 1 - F.col("quality"))
                                .otherwise(F.col("quality")))
    a = {r.doc_id: r.score for r in line_crf.quality(docs, labels).collect()}
    b = {r.doc_id: r.score for r in line_crf.quality(docs.withColumn("lang", F.lit("zz")), changed).collect()}
    assert a == b


def test_quality_of_odd_rows(tricky, no_docs, marked):
    rows = line_crf.quality(tricky, marked[1].where("doc_id < 20")).collect()
    assert len(rows) == tricky.count() and all(0 <= r.score <= 1 for r in rows)
    none = marked[1].where("false")
    assert {r.score for r in line_crf.quality(tricky, none).collect()} == {0.5}
    kept = line_crf.keep_good(tricky, none)
    assert kept.columns == tricky.columns and kept.count() == tricky.count()
    assert line_crf.quality(no_docs, marked[1]).count() == 0 == line_crf.keep_good(no_docs, none).count()


def test_batches_do_not_change_scores(marked):
    docs, labels = marked
    model = line_crf.train(docs, labels)
    raw = [r.text.encode() for r in docs.orderBy("doc_id").limit(40).collect()] + [b"", b"\n\n"]
    rows, sizes, weight = line_crf._features(raw)
    chain = line_crf.chain_of(sizes)
    together = np.add.reduceat(model.marginals(rows, chain) * weight, chain.starts) / np.add.reduceat(weight, chain.starts)
    for text, score in zip(raw, together):
        rows, sizes, weight = line_crf._features([text])
        assert abs((model.marginals(rows, line_crf.chain_of(sizes)) * weight).sum() / weight.sum() - score) < 1e-6


# Language model

def small_network():
    rng = np.random.default_rng(1)
    n = masked_lm.Network.of(3 * masked_lm.Network.new(1).flat())
    for f in ("near", "bias", "to_class", "class_bias", "to_word", "word_bias"):
        setattr(n, f, getattr(n, f).astype(np.float64))
    return n, rng.integers(0, masked_lm.VOCABULARY + 2, (20, 4)), rng.integers(0, masked_lm.VOCABULARY, 20)


def test_probabilities_sum_to_one():
    n, context, _ = small_network()
    every = np.arange(masked_lm.VOCABULARY)
    assert abs(np.exp(n.log_probabilities(np.repeat(context[:1], len(every), axis=0), every)).sum() - 1) < 1e-9


def test_gradient():
    n, context, target = small_network()
    slope, back = n.gradient(context, target)
    for name in ("bias", "to_class", "class_bias", "to_word", "word_bias"):
        values, g = getattr(n, name).ravel(), getattr(slope, name).ravel()
        for i in np.argsort(-np.abs(g))[:5]:
            old, out = values[i], []
            for d in (1e-5, -1e-5):
                values[i] = old + d
                out.append(n.log_probabilities(context, target).sum())
            values[i] = old
            assert abs((out[0] - out[1]) / 2e-5 - g[i]) < 1e-4
    old, out = n.near[1, context[3, 1], 2], []
    for d in (1e-5, -1e-5):
        n.near[1, context[3, 1], 2] = old + d
        out.append(n.log_probabilities(context, target).sum())
    assert abs((out[0] - out[1]) / 2e-5 - back[context[:, 1] == context[3, 1], 2].sum()) < 1e-4


def test_training_learns_the_neighbours(spark):
    rng = random.Random(1)
    def doc(shuffled):
        w = [x for _ in range(40) for x in rng.choice([("red", "green", "blue"), ("one", "two", "three")])]
        if shuffled:
            rng.shuffle(w)
        return " ".join(w)
    rows = [(i, doc(i % 10 == 9)) for i in range(400)]
    got = masked_lm.pseudo_likelihood(spark.createDataFrame(rows, "doc_id long, text string"), rate=0.5, rounds=3).collect()
    plain = [r.mean_log_prob for r in got if r.doc_id % 10 != 9]
    mixed = [r.mean_log_prob for r in got if r.doc_id % 10 == 9]
    assert min(plain) > max(mixed) and np.mean(plain) > -1.5
    assert all(0 < r.score < 1 and r.n_words == 120 for r in got)


def test_every_word_is_trained_on(spark, monkeypatch):
    rng = random.Random(2)
    rows = [(i, " ".join(x for _ in range(40) for x in rng.choice([("red", "green", "blue"), ("one", "two", "three")]))) for i in range(400)]
    docs = spark.createDataFrame([*rows, (None, None), (5, "")], "doc_id long, text string")
    got = masked_lm.pseudo_likelihood(docs).collect()
    assert np.mean([r.mean_log_prob for r in got if r.n_words]) > -1.5
    seen, mean = [], masked_lm._averaged

    def averaged(trained, *rest):
        seen.append(trained.where("block = 0").agg(F.sum("n")).first()[0])
        return mean(trained, *rest)
    monkeypatch.setattr(masked_lm, "_averaged", averaged)
    monkeypatch.setattr(masked_lm, "PART_EXAMPLES", 5000)
    masked_lm.pseudo_likelihood(docs).collect()
    assert sum(seen) == 400 * 120 and len(seen) == masked_lm.ROUNDS


def test_scores_against_word_by_word(tricky, no_docs, spark):
    numbers = masked_lm.WordNumbers(masked_lm.frequent_words(tricky.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))))
    network, _, _ = small_network()
    score = masked_lm.scorer(numbers, network)
    rows = tricky.where("length(text) < 1000 or text is null").select("doc_id", "text", score(F.coalesce("text", F.lit(""))).alias("s")).collect()
    for r in rows:
        ids = [masked_lm.VOCABULARY] * 2 + numbers.encode([w.encode() for w in words_of(r.text)]).tolist() + [masked_lm.VOCABULARY + 1] * 2
        total = sum(network.log_probabilities(np.array([[*ids[i - 2:i], *ids[i + 1:i + 3]]]), np.array([ids[i]]))[0] for i in range(2, len(ids) - 2))
        assert r.s.n_words == len(ids) - 4 and abs(total - r.s.log_prob) < 1e-6 * max(1, abs(total))
    got = masked_lm.pseudo_likelihood(tricky).collect()
    assert len(got) == tricky.count() and all((r.log_prob, r.score) == (0, 0) for r in got if not r.n_words)
    assert masked_lm.pseudo_likelihood(no_docs).count() == 0


def test_every_rare_word_has_a_probability(spark, monkeypatch):
    """log p(bucket) plus the word's share of its bucket, against counts of all words; in many blocks and lists."""
    monkeypatch.setattr(masked_lm, "BLOCK_WORDS", 700)
    rng = random.Random(3)
    bodies = [" ".join(f"w{min(rng.randrange(6000), rng.randrange(6000))}" for _ in range(60)) for _ in range(150)]
    bodies += [bodies[0], "only here", "", None]
    docs = spark.createDataFrame(list(enumerate(bodies)), "doc_id long, text string").repartition(3)
    counts = Counter(w for t in bodies for w in words_of(t))
    frequent = masked_lm.frequent_words(docs)
    assert len(counts) > len(frequent) + 500
    sizes = Counter()
    for w in counts.keys() - {f.decode() for f in frequent}:
        sizes[masked_lm.xxhash.xxh3_64_intdigest(w.encode()) % masked_lm.BUCKETS] += counts[w]
    network, _, _ = small_network()
    score = masked_lm.scorer(masked_lm.WordNumbers(frequent), network)
    want = {r.doc_id: r.s.log_prob for r in docs.select("doc_id", score(F.coalesce("text", F.lit(""))).alias("s")).collect()}
    monkeypatch.setattr(masked_lm, "train", lambda *_: network)
    got = {r.doc_id: r.log_prob for r in masked_lm.pseudo_likelihood(docs).collect()}
    for d, t in enumerate(bodies):
        rare = [w for w in words_of(t) if w.encode() not in frequent]
        share = sum(np.log(counts[w] / sizes[masked_lm.xxhash.xxh3_64_intdigest(w.encode()) % masked_lm.BUCKETS]) for w in rare)
        assert abs(got[d] - want[d] - share) < 1e-6 * max(1, abs(got[d]))


def test_frequent_words_are_counted_over_all(tricky, monkeypatch):
    monkeypatch.setattr(masked_lm, "_COUNTED", 5)
    want = Counter(w for r in tricky.collect() for w in words_of(r.text))
    got = masked_lm.frequent_words(tricky.select("doc_id", F.coalesce("text", F.lit("")).alias("text")))
    top = sorted(want.items(), key=lambda x: (-x[1], x[0].encode()))[:masked_lm.VOCABULARY - masked_lm.BUCKETS]
    assert [w.decode() for w in got] == [w for w, _ in top]


# Decontamination

def contamination(docs, items, window=10):
    found = {}
    for item, text in items:
        w = words_of(text)
        n = min(window, len(w))
        for i in range(len(w) - n + 1 if w else 0):
            found.setdefault(tuple(w[i:i + n]), set()).add(item)
    out = []
    for d, text in docs:
        w, hit, ids = words_of(text), set(), set()
        for n in {len(k) for k in found}:
            for i in range(len(w) - n + 1):
                if tuple(w[i:i + n]) in found:
                    hit |= set(range(i, i + n))
                    ids |= found[tuple(w[i:i + n])]
        names = ",".join(sorted(str(i) for i in ids if i is not None))
        out.append((d, len(w), len(hit), len(ids - {None}), hashlib.sha256(names.encode()).hexdigest(), bool(hit)))
    return Counter(out)


@pytest.mark.parametrize("block_bytes", [8 << 20, 40])
def test_contamination(tricky, no_docs, spark, block_bytes):
    rng = random.Random(9)
    def prose(n):
        return " ".join(rng.choice("abc") + rng.choice("xyz") for _ in range(n))
    items = [(i, prose(rng.choice([1, 2, 9, 10, 11, 30]))) for i in range(12)]
    items += [(3, items[0][1]), (20, None), (21, ""), (22, "..."), (None, prose(12)), (10, tricky.where("doc_id = 6").first().text), (2, "ÉÀ ça")]
    known = [t for _, t in items if t]
    docs = [(100 + i, prose(rng.randint(0, 60)) + ", " + rng.choice(known).upper() + "! " + prose(rng.randint(0, 9))) for i in range(60)]
    docs += [(r.doc_id, r.text) for r in tricky.collect()] + [(200, "éà ça"), (201, "ÉÀ ça")]
    table, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    monkey = decontaminate.with_spans(table, bench, block_bytes=block_bytes)
    assert monkey.columns == ["doc_id", "text", "__scan"]
    want = contamination(docs, items)
    if block_bytes > 40:
        assert Counter(map(tuple, decontaminate.digest(table, bench).collect())) == want
    hits = {(r.doc_id, r.text): len(r["__scan"].spans) > 0 for r in monkey.collect()}
    bad = Counter(d for (d, *_, b) in want.elements() if b)
    assert Counter(d for (d, t) in docs if hits[d, t]) == bad
    kept = decontaminate.clean(table, bench)
    assert kept.count() == len(docs) - sum(bad.values())
    assert decontaminate.clean(tricky, bench).columns == tricky.columns
    empty = bench.where("false")
    assert decontaminate.digest(no_docs, bench).count() == 0
    assert not any(r.contaminated for r in decontaminate.digest(tricky, empty).collect())


def test_original_offsets():
    text = "Start: The quick-BROWN  fox, éa jumps."
    assert [text[a:b] for a, b in decontaminate.original_spans(text, [(1, 3), (5, 1)])] == ["The quick-BROWN", "éa"]

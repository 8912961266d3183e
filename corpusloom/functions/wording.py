"""Query wording, plain-language wording and fixed text layouts."""

from pyspark.sql import Column, functions as F

from corpusloom.functions import rules
from corpusloom.functions.text import contains_any, cut, matches_any, or_else, rstrip, strip


def expand_query(question: Column, rewritten: Column | None = None, aliases=rules.QUERY_ALIASES,
                 most: int | None = None) -> Column:
    """Append the search phrase of every alias row whose word is in the question; at most ``most`` characters if given."""
    base = strip(or_else(rewritten, question) if rewritten is not None else question)
    low = F.lower(question)
    found = F.array_distinct(F.array_compact(F.array(*[
        F.when(contains_any(low, [w.lower() for w in words]), F.lit(phrase)) for words, phrase in aliases
    ])))
    return F.when(F.size(found) == 0, base).otherwise(
        cut(F.concat_ws(" ", base, F.array_join(found, " ")), most))


def search_text(question: Column, first_line: bool = False, most: int | None = None) -> Column:
    """Rewrite used when no model is at hand: the question itself, on request its first line or first characters only."""
    text = strip(question)
    return cut(F.split(text, "\n")[0] if first_line else text, most)


def plain_terms(text: Column, terms=rules.PLAIN_TERMS) -> Column:
    """Replacements run in table order and may act on earlier replacements."""
    for term, plain in terms:
        text = F.replace(text, F.lit(term), F.lit(plain))
    return text


def asks_for_dose(question: Column, patterns=rules.DOSAGE_PATTERNS) -> Column:
    return matches_any(F.lower(question), patterns)


def mentions_dose(text: Column, amount=rules.DOSE_AMOUNT_PATTERN, words=rules.DOSE_WORDS) -> Column:
    return matches_any(text, [amount]) & contains_any(text, words)


def detect_track(question: Column, nutrition_words=rules.NUTRITION_TRACK_WORDS) -> Column:
    return F.when(contains_any(F.lower(question), nutrition_words), "nutrition").otherwise("clinical")


def wants_live_search(question: Column, hits: Column, min_hits: int = 3, words=rules.RECENCY_WORDS) -> Column:
    return (F.coalesce(hits, F.lit(0)) < min_hits) | contains_any(F.lower(question), words)


def _pico_part(part: Column, mesh: bool) -> Column:
    subs = F.filter(F.split(strip(part), r"(?i)\s+OR\s+"), lambda s: strip(s) != "")

    def clause(s: Column) -> Column:
        s = F.regexp_replace(strip(s), r"\s+", " ")
        quoted = F.when(F.contains(s, F.lit(" ")), F.concat(F.lit('"'), s, F.lit('"'))).otherwise(s)
        text = F.concat(quoted, F.lit("[Title/Abstract]"))
        return F.concat(text, F.lit(" OR "), s, F.lit("[MeSH Terms]")) if mesh else text

    clauses = F.transform(subs, clause)
    joined = F.array_join(clauses, " OR ")
    grouped = F.when(F.size(clauses) > 1, F.concat(F.lit("("), joined, F.lit(")"))).otherwise(joined)
    return F.when(F.coalesce(part, F.lit("")) != "", grouped)


def literature_query(disease: Column, intervention: Column, outcome: Column) -> Column:
    """Population AND intervention AND outcome, with a subject-heading variant on the first."""
    parts = F.array_compact(F.array(
        _pico_part(disease, True), _pico_part(intervention, False), _pico_part(outcome, False)))
    return F.when(F.size(parts) == 0, "").otherwise(
        F.concat(F.array_join(parts, " AND "), F.lit(" AND hasabstract[text]")))


def decorate_term(query: Column, year_from: Column, year_to: Column, article_type: Column) -> Column:
    """Year range and article type clauses; 0 and null mean "open"."""
    lo, hi = F.coalesce(year_from, F.lit(0)), F.coalesce(year_to, F.lit(0))
    years = F.when((lo != 0) | (hi != 0), F.concat(
        F.lit(" AND "), F.when(lo != 0, lo).otherwise(1800).cast("string"), F.lit(":"),
        F.when(hi != 0, hi).otherwise(3000).cast("string"), F.lit("[dp]"))).otherwise("")
    kind = F.when(F.coalesce(article_type, F.lit("")) != "", F.concat(
        F.lit(' AND "'), article_type, F.lit('"[pt]'))).otherwise("")
    return F.concat(strip(query), years, kind)


def evidence_block(index: Column, level: Column, title: Column, source: Column, year: Column,
                   doc_id: Column, url: Column, snippet: Column) -> Column:
    return F.concat(
        F.lit("["), index.cast("string"), F.lit("] ("), level, F.lit(") "), title, F.lit(" | "), source,
        F.lit(" | "), F.coalesce(F.when(year != 0, year.cast("string")), F.lit("n/a")), F.lit(" | "), doc_id,
        F.lit("\nURL: "), url, F.lit("\n"), snippet)


def evidence_card(title: Column, year: Column, journal: Column, url: Column) -> Column:
    return F.concat(
        F.lit("标题："), or_else(title, F.lit("（无标题）")),
        F.lit("\n年份："), F.coalesce(F.when(year != 0, year.cast("string")), F.lit("未知")),
        F.lit(" | 期刊："), or_else(journal, F.lit("未知")),
        F.lit("\n链接："), F.coalesce(url, F.lit("")))


def refusal_message(reason: Column, n_contexts: Column, source_counts: Column) -> Column:
    """What was found, what is missing, what to try. ``source_counts`` is display text."""
    def by_reason(table):
        out = F.lit(table["low_relevance"])
        for key in ("missing_evidence_type", "out_of_scope"):
            out = F.when(reason == key, F.lit(table[key])).otherwise(out)
        return out

    got = F.when(F.coalesce(n_contexts, F.lit(0)) == 0, F.lit(rules.REFUSAL_NOTHING_FOUND)).otherwise(
        F.concat(F.lit("检索到 "), n_contexts.cast("string"), F.lit(" 条证据，来源分布 "), source_counts))
    return F.concat(
        F.lit(rules.REFUSAL_HEAD), F.lit("我能确认的是："), got, F.lit("；但"), by_reason(rules.REFUSAL_MISSING),
        F.lit("。\n如需继续："), by_reason(rules.REFUSAL_SUGGEST), F.lit("。\n"), F.lit(rules.REFUSAL_TAIL))


def audit_note(answer: Column, ok: Column, invalid_brackets: Column, fake_pmids: Column,
               fake_ncts: Column, fake_docs: Column) -> Column:
    """Append the list of claims that could not be verified; answers that pass stay as they are."""
    def quoted(items: Column) -> Column:
        return F.concat(F.lit("["), F.array_join(F.transform(
            items, lambda x: F.concat(F.lit("'"), x, F.lit("'"))), ", "), F.lit("]"))

    def part(label: str, items: Column, shown: Column) -> Column:
        return F.when(F.size(items) > 0, F.concat(F.lit(label), shown))

    numbers = F.concat(F.lit("["), F.array_join(invalid_brackets.cast("array<string>"), ", "), F.lit("]"))
    note = F.concat_ws(
        "；",
        part("无效引用编号: ", invalid_brackets, numbers),
        part("无法核实的 PMID: ", fake_pmids, quoted(fake_pmids)),
        part("无法核实的 NCT: ", fake_ncts, quoted(fake_ncts)),
        part("无法核实的文档 ID: ", fake_docs, quoted(fake_docs)))
    return F.when(ok, answer).otherwise(F.concat(
        rstrip(answer), F.lit("\n\n> 引用校验："), or_else(note, F.lit("检测到可疑引用")),
        F.lit("。请仅采信与证据面板一致的引用。")))

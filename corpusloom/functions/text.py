"""Text column functions.

Word characters are spelled ``[\\p{L}\\p{N}_]`` everywhere because the JVM's
``\\w`` is ASCII only.
"""

from pyspark.sql import Column, functions as F

WORD = r"[\p{L}\p{N}_]"
NOT_AFTER_WORD = rf"(?<!{WORD})"
NOT_BEFORE_WORD = rf"(?!{WORD})"
# Everything a Unicode-aware strip removes.
SPACES = ("\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005"
          "\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000")


def strip(c: Column) -> Column:
    return F.trim(c, F.lit(SPACES))


def rstrip(c: Column) -> Column:
    return F.rtrim(c, F.lit(SPACES))


def text_or_empty(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def is_blank(c: Column) -> Column:
    return strip(text_or_empty(c)) == ""


def or_else(*cols: Column) -> Column:
    """First argument that is neither null nor empty; the last one otherwise."""
    *head, last = cols
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in head], last)


def head(c: Column, n: int) -> Column:
    return F.substring(c, 1, n)


def cut(c: Column, most: int | None) -> Column:
    """At most ``most`` characters; None keeps the whole text."""
    return c if most is None else head(c, most)


def whole_number(c: Column) -> Column:
    """Text of digits as an integer; null for any other text and for numbers that do not fit."""
    return F.when(c.rlike("^[0-9]+$"), c.try_cast("int"))


def contains_any(c: Column, words: list[str]) -> Column:
    hit = F.lit(False)
    for w in words:
        hit = hit | F.contains(c, F.lit(w))
    return hit


def matches_any(c: Column, patterns: list[str]) -> Column:
    """True where one of the patterns is found; digits and spaces are Unicode-aware."""
    return c.rlike("(?U)" + "|".join(f"(?:{p})" for p in patterns))


def level_from_rules(blob: Column, rules, default: Column | str = "other") -> Column:
    """First rule with a word inside ``blob`` (already lower case) names the level."""
    out = F.lit(default) if isinstance(default, str) else default
    for level, words in reversed(rules):
        out = F.when(contains_any(blob, words), F.lit(level)).otherwise(out)
    return out


def tags_from_rules(blob: Column, rules) -> Column:
    """Tags whose words occur inside ``blob`` (already lower case), in rule order."""
    return F.array_compact(F.array(*[
        F.when(contains_any(blob, words), F.lit(tag)) for tag, words in rules
    ]))


def normalize_level(raw_type: Column, title: Column, rules) -> Column:
    blob = F.lower(F.concat_ws(" ", text_or_empty(raw_type), text_or_empty(title)))
    return level_from_rules(blob, rules)


def normalize_doi(doi: Column) -> Column:
    d = F.lower(strip(doi))
    for prefix in ("^https://doi\\.org/", "^http://doi\\.org/", "^doi:"):
        d = F.regexp_replace(d, prefix, "")
    return strip(d)


def normalize_title(title: Column) -> Column:
    t = F.regexp_replace(strip(F.lower(title)), r"(?U)^(the|a|an)\s+", "")
    return F.regexp_replace(t, rf"[^\p{{L}}\p{{N}}_]+", "")


def word_set(c: Column) -> Column:
    """Distinct word runs, the form used by the overlap gate."""
    return F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit(rf"{WORD}+"), F.lit(0)))


def search_tokens(c: Column) -> Column:
    """Latin/digit runs as words, CJK runs as two-character windows.

    Rows without two adjacent CJK characters skip the window step, which is not
    code-generated.
    """
    runs = F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9_]+|[一-鿿]+"), F.lit(0))

    def windows(run: Column) -> Column:
        pairs = F.transform(F.sequence(F.lit(1), F.length(run) - 1), lambda i: F.substring(run, i, F.lit(2)))
        return F.when(run.rlike("^[一-鿿]{2}"), pairs).otherwise(F.array(run))

    return F.when(c.rlike("[一-鿿]{2}"), F.flatten(F.transform(runs, windows))).otherwise(runs)


def index_tokens(c: Column) -> Column:
    """Search tokens, with the stand-in token for text that has none.

    The test for "none" stops at the first token character, which is cheaper
    than looking at the size of a second token array.
    """
    c = text_or_empty(c)
    none = F.when(F.lower(c).rlike("[a-z0-9_一-鿿]"), F.array().cast("array<string>")).otherwise(
        F.array(F.lit("empty")))
    return F.concat(search_tokens(c), none)


def lower_text(c: Column) -> Column:
    """What ``pieces.token_lists`` splits into ``index_tokens`` inside a task."""
    return F.lower(text_or_empty(c))


def clean_ocr(c: Column, page_mark: str) -> Column:
    t = F.regexp_replace(c, "(?mU)" + page_mark, "")
    t = F.regexp_replace(t, "\n{3,}", "\n\n")
    return strip(F.regexp_replace(t, "[ \t]{2,}", " "))


def overlap_ratio(query_words: Column, context_words: Column) -> Column:
    """Share of the query's distinct words found in the context; 0 if either is empty."""
    n = F.size(query_words)
    shared = F.size(F.array_intersect(query_words, context_words))
    return F.when((n == 0) | (F.size(context_words) == 0), F.lit(0.0)).otherwise(shared / n)

"""Weights and priorities as columns."""

from pyspark.sql import Column, functions as F

from corpusloom.functions import rules


def lookup(c: Column, table: dict, default) -> Column:
    pairs = [F.lit(x) for kv in table.items() for x in kv]
    return F.coalesce(F.element_at(F.create_map(*pairs), c), F.lit(default))


def level_priority(level: Column) -> Column:
    return lookup(level, rules.LEVEL_PRIORITY, rules.LEVEL_PRIORITY["other"])


def level_boost(level: Column) -> Column:
    return lookup(level, rules.LEVEL_BOOST, 1.0)


def recency_weight(year: Column, ref_year: int, half_life: int = 8) -> Column:
    """Halves every ``half_life`` years; unknown year is neutral. The reference
    year is always an argument so that a rerun gives the same result."""
    age = F.greatest(F.lit(0), F.lit(ref_year) - year)
    return F.when(year.isNull(), F.lit(0.5)).otherwise(F.pow(F.lit(0.5), age / F.lit(half_life)))


def combined_priority(level: Column, year: Column, ref_year: int,
                      level_w: float = 1.0, recency_w: float = 0.5) -> Column:
    return level_priority(level) * level_w + recency_weight(year, ref_year) * recency_w


def completeness(text_len: Column, year: Column, url: Column, journal: Column, doi: Column,
                 n_tags: Column) -> Column:
    """Fixed weights: text length + 1000 year + 500 url + 500 journal + 300 doi + 100 per tag.

    ``year``, ``url``, ``journal`` and ``doi`` are booleans: is the field filled?
    """
    return (text_len
            + F.when(year, 1000).otherwise(0)
            + F.when(url, 500).otherwise(0)
            + F.when(journal, 500).otherwise(0)
            + F.when(doi, 300).otherwise(0)
            + n_tags * 100).cast("long")


def retrieval_boost(level: Column, tags: Column, source: Column,
                    prefer_levels: list[str] | None, boost_tags: list[str] | None) -> Column:
    """Level weight x preferred level x tag overlap x topic page."""
    b = level_boost(level)
    if prefer_levels:
        b = b * F.when(level.isin(prefer_levels), 1.15).otherwise(1.0)
    if boost_tags:
        wanted = F.array(*[F.lit(t) for t in boost_tags])
        b = b * F.when(F.coalesce(F.arrays_overlap(tags, wanted), F.lit(False)), 1.2).otherwise(1.0)
    return b * F.when(source == "wiki", 1.05).otherwise(1.0)

"""Column expressions over text: match tiers, keyword hits, keyword extraction, identifiers, estimates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that no query is searched by.
STOPWORDS = ("a", "an", "and", "are", "as", "at", "be", "by", "do", "for", "from", "how", "in", "is", "it", "of", "on", "or", "that", "the", "this", "to", "was", "what", "where", "which", "with")
# Characters that the full-text query syntax gives a meaning.
QUERY_SPECIALS = r'+-&|!(){}[]^"~*?:\/'


def strings(values: Sequence[str]) -> Column:
    return F.array(*[F.lit(v) for v in values]) if values else F.array().cast("array<string>")


def matches(column: Column, needle: str) -> Column:
    """Case-insensitive substring test; null text doesn't match."""
    return F.contains(F.lower(F.coalesce(column, F.lit(""))), F.lit(needle.lower()))


def any_keyword(column: Column, keywords: Sequence[str]) -> Column:
    low = F.lower(F.coalesce(column, F.lit("")))
    return F.exists(strings([k.lower() for k in keywords]), lambda k: F.contains(low, k))


def keyword_hits(column: Column, keywords: Sequence[str]) -> Column:
    """How many of the keywords the text contains."""
    low = F.lower(F.coalesce(column, F.lit("")))
    return F.aggregate(strings([k.lower() for k in keywords]), F.lit(0), lambda n, k: n + F.contains(low, k).cast("int"))


def match_tier(name: Column, query: str, other: int = 40) -> Column:
    """100 for the name itself, 80 for a prefix, 60 for a part, ``other`` where something else matched."""
    low, wanted = F.lower(name), F.lit(query.lower())
    return F.when(low == wanted, 100).when(F.startswith(low, wanted), 80).when(F.contains(low, wanted), 60).otherwise(other)


def tokens(column: Column) -> Column:
    """Lower-case runs of letters, digits and underscores in ASCII."""
    return F.regexp_extract_all(F.lower(F.coalesce(column, F.lit(""))), F.lit("([a-z0-9_]+)"), 1)


def keywords(column: Column, most: int = 5) -> Column:
    """The first words of two characters or more that aren't stop words; the whole text where there are none."""
    found = F.filter(tokens(column), lambda w: (F.length(w) > 1) & ~w.isin(*STOPWORDS))
    return F.when(F.size(found) == 0, F.array(column)).otherwise(F.slice(found, 1, most))


def escaped(column: Column) -> Column:
    """The text with the full-text syntax's characters escaped."""
    inside = "".join("\\" + c for c in QUERY_SPECIALS)
    return F.regexp_replace(column, f"([{inside}])", r"\\$1")


def token_estimate(column: Column, chars: int = 3) -> Column:
    return F.floor(F.length(column) / chars)


def diagram_id(column: Column) -> Column:
    """The name with what a diagram id can't have replaced; ids don't begin with a digit."""
    clean = F.regexp_replace(column, "[^a-zA-Z0-9_]", "_")
    return F.when(clean.rlike("^[0-9]"), F.concat(F.lit("_"), clean)).otherwise(clean)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays, null where either has no length."""
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)

    def norm(v: Column) -> Column:
        return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x))

    return dot / F.nullif(norm(a) * norm(b), F.lit(0.0))

"""Opening names taken from the opening link of a game header."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed patterns: the link tag, and the shortest leading part that ends in a family word.
LINK_PATTERN = r'\[ECOUrl "https?://[^"]+/openings/([^"]+)"\]'
FAMILY_PATTERN = "^(.+?(?:Defense|Gambit|Opening|Game|Attack|System))"

NO_OPENING = "No Opening"
NOT_MINE = "N/A"


def _match(text: Column, pattern: str) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, 1), F.lit(""))


def opening_slug(pgn: Column) -> Column:
    """Slug of the opening link, NULL when the header has none."""
    return _match(pgn, LINK_PATTERN)


def slug_or_default(slug: Column) -> Column:
    return F.coalesce(slug, F.lit("No-Opening"))


def opening_family(slug: Column) -> Column:
    return F.coalesce(_match(slug, FAMILY_PATTERN), slug, F.lit(NO_OPENING))


def my_opening(eco: Column, color: Column) -> Column:
    """White owns the openings that are no defense, Black owns the defenses."""
    is_defense = eco.contains("Defense")
    mine = ((color == "white") & ~is_defense) | ((color == "black") & is_defense)
    return F.when((eco != NO_OPENING) & mine, eco).otherwise(NOT_MINE)

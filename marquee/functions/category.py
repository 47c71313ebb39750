"""One category an event: structured genres first, then keywords in order, else the catch-all."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

CATCH_ALL = "more-to-do"

# Categories in their order with their keywords.
CATEGORIES = (
    ("live-music-concerts", ("concert", "live music", "band", "dj set", "dj ", "jazz", "blues", "hip hop", "hip-hop", "country music", "rock show", "indie", "rap", "r&b", "soul", "folk", "metal", "punk", "singer")),
    ("comedy", ("comedy", "stand-up", "standup", "stand up", "improv", "open mic", "comedian", "laughs")),
    ("performing-visual-arts", ("theater", "theatre", "dance", "opera", "ballet", "symphony", "orchestra", "gallery", "exhibit", "museum", "film", "cinema", "art show", "art walk", "drag show", "burlesque", "magic show", "spoken word", "poetry")),
    ("sports-fitness", ("game", "match", "tournament", "grizzlies", "hustle", "tigers", "nba", "nfl", "mlb", "nhl", "mls", "soccer", "football", "basketball", "baseball", "hockey", "run", "race", "5k", "marathon", "half marathon", "yoga", "cycling", "bike ride", "triathlon", "crossfit", "fitness", "workout", "gym")),
    ("festivals", ("festival", "fair", "carnival", "flea market", "holiday market", "street fest", "block party", "pride", "oktoberfest", "mardi gras")),
    ("family-community", ("family", "kids", "children", "youth", "parent", "toddler", "baby", "community", "volunteer", "charity", "fundraiser", "neighborhood", "civic", "town hall", "free event", "all ages")),
    (CATCH_ALL, ()),
)

# The category of each structured genre.
GENRES = {
    "music": "live-music-concerts", "arts & theatre": "performing-visual-arts", "sports": "sports-fitness", "family": "family-community",
    "miscellaneous": "more-to-do", "classical": "performing-visual-arts", "comedy": "comedy", "dance/electronic": "live-music-concerts",
    "jazz": "live-music-concerts", "blues": "live-music-concerts", "r&b": "live-music-concerts", "hip-hop/rap": "live-music-concerts",
    "rock": "live-music-concerts", "country": "live-music-concerts", "pop": "live-music-concerts", "folk": "live-music-concerts",
    "metal": "live-music-concerts", "theatre": "performing-visual-arts", "dance": "performing-visual-arts", "film": "performing-visual-arts",
}


def keyword_pattern(words: tuple[str, ...]) -> str:
    """One alternation a category, so that a text is scanned once for each."""
    return r"\b(?:" + "|".join(re.escape(w) for w in words) + r")\b"


def categorize(genres: Column, title: Column, description: Column) -> Column:
    """genres: an array of names, or null."""
    order = {slug: i for i, (slug, _) in enumerate(CATEGORIES)}
    ranks = F.create_map(*[F.lit(x) for name, slug in GENRES.items() for x in (name, order[slug])])
    best = F.array_min(F.transform(F.coalesce(genres, F.array().cast("array<string>")), lambda g: F.try_element_at(ranks, F.lower(F.trim(g)))))
    slugs = F.array(*[F.lit(slug) for slug, _ in CATEGORIES])
    text = F.lower(F.concat_ws(" ", F.coalesce(title, F.lit("")), F.coalesce(description, F.lit(""))))
    scanned = F.lit(CATCH_ALL)
    for slug, words in reversed(CATEGORIES):
        if words:
            scanned = F.when(text.rlike("(?U)" + keyword_pattern(words)), F.lit(slug)).otherwise(scanned)
    return F.when(best.isNotNull(), F.get(slugs, best)).otherwise(scanned)

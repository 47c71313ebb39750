"""How an event is shown, and what a writer is told of it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from marquee.functions.times import SHAPE

# What marks a title as of sports, or of a concert.
SPORTS = (
    " vs ", " vs. ", " v ", "game", "match", "tournament", "fc", "legion", "barons", "redbirds", "grizzlies", "hustle", "tigers", "nba", "nfl", "mlb", "nhl", "mls",
)
CONCERTS = ("tour", "live", "concert", "presents", "performing")


def long_date(text: Column) -> Column:
    """Saturday, June 21 at 7:00 PM; the date alone at midnight; other texts as they are."""
    t = F.when(text.rlike(r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}$"), F.try_to_timestamp(text, F.lit(SHAPE)))
    day = F.date_format(t, "EEEE, MMMM d")
    midnight = (F.hour(t) == 0) & (F.minute(t) == 0)
    return F.when(t.isNull(), text).when(midnight, day).otherwise(F.concat(day, F.lit(" at "), F.date_format(t, "h:mm a")))


def call_to_action(ticket_url: Column) -> Column:
    return F.when(F.coalesce(ticket_url, F.lit("")) != "", "Get Tickets").otherwise("More Info")


def _any(text: Column, marks: tuple[str, ...]) -> Column:
    return F.exists(F.array(*[F.lit(m) for m in marks]), lambda m: F.contains(text, m))


def event_class(title: Column, source: Column) -> Column:
    """sports, concert or other."""
    low = F.lower(F.coalesce(title, F.lit("")))
    concert = _any(low, CONCERTS) | F.coalesce(source == "Ticketmaster", F.lit(False))
    return F.when(_any(low, SPORTS), "sports").when(concert, "concert").otherwise("other")


def enrichment_context(title: Column, venue: Column, city_slug: Column, start: Column, cost: Column, categories: Column, source: Column) -> Column:
    """What is known of an event, a line each, with the class of text that is asked for."""
    line = lambda label, value: F.when(F.coalesce(value, F.lit("")) != "", F.concat(F.lit(f"{label}: "), value))
    kind = event_class(title, source)
    # The closing lines of each class.
    ends = (
        F.when(kind == "sports", "Type: Professional or semi-professional sports match\nNote: Use your knowledge of these teams to write an exciting match preview.")
        .when(kind == "concert", "Type: Live music or entertainment event\nNote: Use your knowledge of this artist to write an engaging description.")
        .otherwise("Note: Write an engaging local events description based on the event details.")
    )
    return F.concat_ws(
        "\n", F.concat(F.lit("Event: "), F.coalesce(title, F.lit(""))), line("Venue", venue), line("City", F.initcap(F.replace(F.coalesce(city_slug, F.lit("")), F.lit("-"), F.lit(" ")))),
        line("Date", F.substring(start, 1, 10)), line("Price", cost), line("Category", F.array_join(categories, ", ")), ends,
    )

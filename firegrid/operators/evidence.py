"""Rules over reviews of forecast cases that were collected elsewhere."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import contains_words, domain_class

POSITIVE = ["confirmed", "probable", "signal_observed"]


def _names(text: Column, place: Column) -> Column:
    return contains_words(text, place)


def validate_reviews(reviews: DataFrame, cases: DataFrame) -> DataFrame:
    """Each review with its verdict, capped confidence and the first rule it breaks (null if none).

    ``reviews``: ``case, verdict, confidence, searches, event_at, location,
    checked_at, sources`` (array of ``url, title, excerpt, published_at, strength,
    cited``); ``cases``: ``case, place, issued_at, window_end``. A positive
    verdict needs a search, an event inside the window at the named place, and
    dated, cited, trusted sources that name the place; it is confirmed only with
    a direct report of an authority. Other verdicts keep no event or sources.
    """
    t = reviews.join(cases, "case")
    positive = F.col("verdict").isin(POSITIVE)
    s, place = F.col("sources"), F.col("place")
    late = F.col("checked_at") + F.expr("interval 5 minutes")
    kind = lambda x: domain_class(x["url"])
    dated = F.forall(s, lambda x: F.coalesce(x["published_at"].between(F.col("issued_at"), late), F.lit(False)))
    named = F.forall(s, lambda x: _names(F.concat_ws(" ", x["title"], F.coalesce(x["excerpt"], F.lit(""))), place))
    checks = [
        ("no_search", F.col("searches") == 0), ("no_window", F.col("window_end").isNull()), ("no_event_date", F.col("event_at").isNull()),
        ("event_outside_window", ~F.col("event_at").between(F.col("issued_at"), F.col("window_end"))), ("no_location", F.col("location").isNull()),
        ("other_location", ~_names(F.col("location"), place)), ("source_not_cited", ~F.forall(s, lambda x: x["cited"])), ("source_date", ~dated),
        ("source_does_not_name_place", ~named), ("source_not_trusted", F.exists(s, lambda x: kind(x) == "other")), ("no_source", F.size(s) == 0),
    ]
    error = F.coalesce(*(F.when(positive & F.coalesce(bad, F.lit(False)), F.lit(name)) for name, bad in checks))
    direct = F.exists(s, lambda x: (kind(x) == "authority") & (x["strength"] == "direct"))
    verdict = F.when((F.col("verdict") == "confirmed") & ~direct, "probable").otherwise(F.col("verdict"))
    cap = F.when(~positive, 0.50).when(F.col("verdict") == "signal_observed", 0.70).when((F.col("verdict") == "confirmed") & direct, 0.95).otherwise(0.85)
    return t.select("case", verdict.alias("verdict"), F.least("confidence", cap).alias("confidence"), F.when(positive, F.col("event_at")).alias("event_at"), F.when(positive, F.size(s)).otherwise(0).alias("sources"), error.alias("error"))

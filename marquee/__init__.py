"""Event-listing jobs on Spark: feeds, resolution, content-store hygiene, scoring and digests."""

"""Spark-native analytics for point-of-interest (attraction) data.

Layout:
  sources/    table readers, landing CSV / crawl-card shaping, test-table views
  sinks/      layer, mart, summary and factor writers
  functions/  column-level building blocks (buckets, JSON columns, regions, images)
  operators/  DataFrame -> DataFrame operators (cleaning, search, behaviour,
              interactions, similarity)
  plans/      the mart families (screen, home, pages) and recommender pipelines
  streaming/  Structured Streaming versions of the behaviour ingest

Every operator is lazy: it takes DataFrames and returns a DataFrame; nothing
collects, caches or creates a session.
"""

__version__ = "0.1.0"

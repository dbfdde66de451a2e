"""A Spark engine for text knowledge corpora: ingest, link, check, search."""

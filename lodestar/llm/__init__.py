"""Training-data operators: deduplication, scoring, scanning and mixing of document corpora on Spark."""

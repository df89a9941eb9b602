"""Operators on whole tables: joins, clustering, aggregation, curation."""

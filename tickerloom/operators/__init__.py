"""Relational operators: ranking, scoping, ingest, maintenance, scoring."""

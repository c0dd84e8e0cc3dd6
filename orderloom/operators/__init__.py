"""The analytics: ingest quality, session profile, order book, as-of, views, audits."""

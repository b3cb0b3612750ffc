"""Fixture views, the query catalog and the SQL oracles."""

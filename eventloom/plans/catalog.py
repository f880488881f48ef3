"""Queries over the driver's tables, one per operator, each with its SQL twin where SQL can say it."""

from __future__ import annotations

from eventloom.plans import catalog_chains, catalog_documents, catalog_entities, catalog_patterns, catalog_tables

PARTS = (catalog_chains, catalog_patterns, catalog_entities, catalog_tables, catalog_documents)


def flagship(spark, sf_dir):
    """Chains per user with the signature of their middle events."""
    return queries()["chain_signatures"](spark, sf_dir)


def queries():
    return {name: made[0] for part in PARTS for name, made in part.QUERIES.items()}


def oracle_sql():
    return {name: made[1] for part in PARTS for name, made in part.QUERIES.items() if made[1]}

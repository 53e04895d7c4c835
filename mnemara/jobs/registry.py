"""Every query of the library, by name, with the SQL that gives the same rows where SQL can express it."""

from __future__ import annotations

from mnemara.jobs import guarded, ingest, recall, records, streams, texts

PARTS = (recall, records, texts, ingest, guarded, streams)


def queries():
    return {name: f for part in PARTS for name, f in part.QUERIES.items()}


def oracle_sql():
    return {name: sql for part in PARTS for name, sql in part.SQL.items()}

"""Registered queries and the SQL each is checked against, by subject."""

from registry import analysis, documents, files, reports, scalars, statements, suppliers, uploads

MODULES = (analysis, suppliers, documents, uploads, scalars, statements, reports, files)


def all_queries():
    return {name: fn for m in MODULES for name, fn in m.QUERIES.items()}


def all_sql():
    return {name: sql for m in MODULES for name, sql in m.SQL.items()}

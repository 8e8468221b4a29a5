"""Registered queries of the library, each with the SQL of the same result where SQL can express it."""

from foliolens.queries import documents, geometry, graphs, layout, pages, tensors, text

MODULES = (text, layout, documents, geometry, tensors, graphs, pages)


def queries():
    return {name: build for m in MODULES for name, (build, _) in m.QUERIES.items()}


def oracle_sql():
    return {name: sql for m in MODULES for name, (_, sql) in m.QUERIES.items() if sql}

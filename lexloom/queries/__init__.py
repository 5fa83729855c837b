"""Queries over the project's tables, one for each operator, and their SQL."""

from lexloom.queries import evaluate, lines, model, more

QUERIES = {**lines.QUERIES, **model.QUERIES, **evaluate.QUERIES, **more.QUERIES}
ORACLE = {**lines.ORACLE, **model.ORACLE, **evaluate.ORACLE, **more.ORACLE}

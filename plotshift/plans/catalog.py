"""All registered queries and their SQL counterparts."""

from __future__ import annotations

from plotshift.plans import features, features_sql, models, models_sql, spatial, spatial_sql, tables, tables_sql

QUERIES = {**features.QUERIES, **tables.QUERIES, **spatial.QUERIES, **models.QUERIES}
SQL = {**features_sql.SQL, **tables_sql.SQL, **spatial_sql.SQL, **models_sql.SQL}

"""The registered queries of the library and their equivalents in SQL."""

from __future__ import annotations

from mosaiq.plans import collections, files, filters, rasters, regions, reshape, shapes, tables
from mosaiq.plans.common import Query

QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}
for _plans in (tables.plans, files.plans, rasters.plans, filters.plans, regions.plans, reshape.plans, collections.plans, shapes.plans):
    QUERIES |= _plans.queries
    ORACLE |= _plans.oracle
FLAGSHIP = "group_mean_join_back"

"""All queries of the package outside the llm subpackage, by name."""

from burstmill.plans import area_queries, catalog_queries, product_queries, raster_queries

QUERIES = catalog_queries.QUERIES | area_queries.QUERIES | raster_queries.QUERIES | product_queries.QUERIES
ORACLES = catalog_queries.ORACLES | area_queries.ORACLES | raster_queries.ORACLES | product_queries.ORACLES

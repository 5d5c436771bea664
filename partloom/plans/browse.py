"""A catalog request: one page of cards and the size of the whole answer."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from partloom.operators import aggregates, paging, projections


@dataclass(frozen=True)
class CatalogPage:
    cards: DataFrame
    totals: DataFrame


def browse(parts: DataFrame, fitments: DataFrame, query: paging.CatalogQuery, order: list[str], *, core: bool = False) -> CatalogPage:
    """Cards of the requested page and, as a separate one-row frame, total, pages and whether more follow.

    Makes are looked up for the page's parts only, so the fitment scan is reduced before anything is grouped.
    """
    page = paging.query_catalog(parts, fitments, query)
    makes = aggregates.part_makes(fitments.join(page.select("sku"), "sku", "left_semi"), order)
    totals = paging.count_matches(paging.matching_parts(parts, fitments, query), query.size, query.page)
    return CatalogPage(projections.catalog_cards(page, makes, core=core), totals)



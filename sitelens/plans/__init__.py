"""Plans of all queries, each with its SQL."""


def catalogue() -> dict:
    """name -> (query, SQL or None)."""
    from . import compare_queries, dom_queries, list_queries, page_queries, record_queries, relational_queries, site_queries, store_queries

    out: dict = {}
    for module in (page_queries, compare_queries, dom_queries, site_queries, relational_queries, store_queries, record_queries, list_queries):
        out |= module.catalogue()
    return out

"""DataFrame operators: retrieval, fusion, ledger, graph, enrichment and analytics."""

"""SQL counterparts of the registered queries, one module per area."""

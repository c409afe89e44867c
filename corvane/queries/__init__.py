"""Driver queries with their SQL counterparts, one module per area; ``collect`` gathers them."""

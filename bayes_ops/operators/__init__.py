"""DataFrame operators: filters, sufficient statistics, grids, windows,
listing, comparisons, draws, derived views and the result cache."""

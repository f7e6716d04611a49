"""Plans: the end-to-end run, the query registry and its SQL oracles."""

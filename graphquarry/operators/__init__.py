"""DataFrame-to-DataFrame operators: extraction, resolution, history and graph queries."""

"""Plans: the query catalog, EDA summary, training run and mart exports."""

"""Plans: stage pipelines, dataset builds and the registered queries."""

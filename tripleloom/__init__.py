"""Knowledge-graph construction, curation, query, data preparation and scoring on Spark."""

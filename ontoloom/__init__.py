"""ontoloom: ontology analytics and corpus preparation as Spark DataFrame programs."""

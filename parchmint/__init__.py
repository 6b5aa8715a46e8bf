"""Spark-native analytics over records, versions and passages that carry provenance and imprecise dates."""

"""Spark-native analytics over multivariate sensor series: repair, scoring, events, evidence, reports."""

"""Spark-native engine for measuring and improving labeled text datasets."""

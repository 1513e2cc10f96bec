"""Spark-native comparison of a real dataset with a synthetic one."""

"""Spark-native site maps and crawl analytics over stored pages and fetch logs."""

"""Spark-native analytics over social posts, comment threads and the insight tables built on them."""

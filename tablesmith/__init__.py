"""A Spark-native analytics engine: messy tables to typed, linked, safely queried ones."""

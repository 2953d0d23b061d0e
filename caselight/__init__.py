"""caselight: Spark-native analytics over collections of court judgments and other long texts."""

"""filelens: Spark-native analytics for large media-file catalogs."""

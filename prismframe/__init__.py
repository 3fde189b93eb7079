"""prismframe: a PySpark-native engine for labelled image-style datasets."""

"""tidefold: a PySpark-native engine for upload collection, account data and text corpora."""

"""A PySpark-native engine for preparing, retrieving, analysing and evaluating document corpora."""

"""cytoloom: a PySpark-native engine for tables of segmented cells from tissue images."""

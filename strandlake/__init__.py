"""A PySpark-native engine for sets of DNA k-mers held as ordinary DataFrames."""

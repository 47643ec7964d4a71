"""partloom: a PySpark-native engine for heterogeneous part lists."""

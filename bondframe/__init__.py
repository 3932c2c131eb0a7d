"""A PySpark-native engine for labelled graphs: molecules as nested columns."""

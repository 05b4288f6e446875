"""A PySpark-native engine that turns tables of raw web pages into compact Markdown."""

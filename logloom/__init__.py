"""logloom: a PySpark-native engine for agent-session logs and text corpora."""

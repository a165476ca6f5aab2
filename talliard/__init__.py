"""talliard: a PySpark-native engine for event-sourced ledgers and the logs that feed them."""

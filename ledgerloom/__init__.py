"""ledgerloom: a PySpark-native analytics engine for household ledgers."""

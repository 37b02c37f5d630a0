"""trackloom: geo-temporal track analytics as composable PySpark DataFrame operators."""

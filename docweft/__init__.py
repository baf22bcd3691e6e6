"""docweft: analytics and conversion of structured-document corpora on Spark."""

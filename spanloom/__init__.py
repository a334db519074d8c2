"""spanloom: execution-trace analytics as composable Spark DataFrame operators."""

"""Layout choice before a plan is built: session tables, pre-aggregates, statements beyond Spark SQL, result cache."""

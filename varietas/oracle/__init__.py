"""DuckDB SQL text for the correctness oracle (used by ``__spark_entry__.oracle_sql``)."""

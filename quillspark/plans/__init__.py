"""The registered queries over the driver's tables, and the same in DuckDB SQL."""

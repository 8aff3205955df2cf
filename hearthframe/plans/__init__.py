"""The catalogue of queries and the DuckDB SQL each is checked against."""

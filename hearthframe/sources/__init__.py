"""Raw layers: schemas, readers, page and record parsers, and deterministic sample views over the given tables."""

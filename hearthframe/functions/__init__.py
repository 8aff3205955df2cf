"""Column functions: text extraction, finance and normal curve, plane geometry."""

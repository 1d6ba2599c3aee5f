"""The daily job as an available-now stream."""

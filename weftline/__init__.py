"""weftline: document and telemetry analytics expressed as PySpark DataFrame plans."""

"""Plans made on the driver: paths, types, inferred schemas, settings."""

"""Data quality: rules, the one-pass engine, profiling, templates."""

"""Stage wiring: context, pipeline, summary, query catalog and SQL oracle."""

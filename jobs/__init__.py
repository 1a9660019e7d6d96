"""Runnable jobs: each module has run(spark, ...), a command line and a config file beside it."""

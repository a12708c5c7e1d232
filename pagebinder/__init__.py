"""pagebinder: web pages, threads and job logs as tables, on PySpark."""

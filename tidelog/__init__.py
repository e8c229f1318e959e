"""Versioned keyed records on Spark: change log, last-write-wins views, scans, runs, compaction, sketches."""

"""Spatio-temporal demand analytics written as Spark DataFrame jobs.

Timestamped, located records become fixed-width time slots and zones, demand
is counted per (slot, zone), enriched with calendar and zone features, and
fitted and scored for every zone in one job.

``functions``  column expressions (slots, grids, flags, scores)
``operators``  DataFrame -> DataFrame building blocks
``sources``    tables, files, JDBC snapshots, reports
``plans``      end-to-end jobs and the query catalog
"""

__version__ = "0.1.0"

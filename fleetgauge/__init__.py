"""fleetgauge: observability analytics for fleets of data pipelines, on Spark.

Layout
------
``functions``   column expressions (text, time, outcome rules, links, globs)
``sources``     readers, writers and configuration tables
``operators``   DataFrame-to-DataFrame building blocks
``plans``       whole jobs: collect metrics, alert, digest
``streaming``   Structured Streaming forms of alerting and log sessionising
"""

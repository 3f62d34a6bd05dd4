"""tamarack: shortlist analytics over messy listing, page and event tables, as Spark jobs.

Every operator is a DataFrame-to-DataFrame (or Column-to-Column) function; the physical
strategy is left to Catalyst, AQE and Tungsten.
"""

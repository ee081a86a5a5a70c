"""corpusmill: curation of source-code corpora as Spark jobs.

Every operator takes DataFrames and returns a DataFrame.  Nothing here starts a
Spark action unless its name says so (``publish_*``, ``require_*``,
``upsert_*``), and nothing collects data to the driver.
"""

__version__ = "0.1.0"

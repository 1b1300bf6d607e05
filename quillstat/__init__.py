"""quillstat: byline, section and gender analytics for news pages on Spark.

Public entry points take and return DataFrames or Columns:

* ``quillstat.functions`` - column expressions (text clean-up, name splitting).
* ``quillstat.operators`` - extraction, gender, reports, evaluation, mentions.
* ``quillstat.sources`` - rule tables, readers and writers.
* ``quillstat.streaming`` - incremental story ingest.
* ``quillstat.plans`` - inputs derived from the driver tables and the query catalog.
"""

from quillstat.session import get_session, checkpoint_dir

__all__ = ["get_session", "checkpoint_dir"]

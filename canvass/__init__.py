"""canvass - questionnaire analytics as Spark DataFrame plans.

Every public function takes and returns ``pyspark.sql.DataFrame`` (or a
``Column``) and is lazy: nothing runs until the caller writes or collects.
Only bounded results (vocabularies, fitted parameters, statistics of a few
rows) are ever brought to the driver, and each such pull is size-guarded.
"""

__version__ = "0.1.0"

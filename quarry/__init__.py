"""quarry: retail and document analytics expressed as Spark DataFrame plans.

Sub-packages
------------
sources    table loaders, binding views, CSV ingest, file inventory
functions  column-expression helpers (text, JSON, formats, money)
operators  row policy, document pipeline, search, quality checks, analytics
plans      semantic metric layer, verified questions, query registry
streaming  incremental refresh of the search index
"""

__version__ = "0.1.0"

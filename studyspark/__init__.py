"""Document study and study-history analytics as Spark DataFrame programs.

functions   column expressions over text, quotes, questions, pages and HTML
operators   DataFrame to DataFrame: history, library, selection, verification, layout
sources     files, state, fetching, models, and the sinks that write back
streaming   incremental ingest and activity over event streams
plans       the registered queries over the driver's tables, and their SQL
llm         operations of a training-data pipeline (can be removed as a whole)
"""

"""pulse: PySpark jobs for analysing large discussion archives.

Sub-packages
------------
sources     readers, declared schemas and sinks
functions   column expressions (time, text, keywords, missing values, hashing)
operators   DataFrame -> DataFrame building blocks
plans       the end-to-end jobs an analyst runs
streaming   the daily activity and keyword-rate jobs over an arriving table
catalog     every job on the test tables, each with its check SQL
"""

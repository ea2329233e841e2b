"""Event analytics on Spark with the evidence attached.

Every function takes DataFrames (or Columns) and returns DataFrames (or Columns); nothing here holds a
session or triggers a job unless its docstring says so.
"""

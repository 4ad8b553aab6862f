"""moraine: changing large tables safely with Spark.

Everything here is DataFrame and Column code.  A table definition is compared,
judged and linted as rows of an inventory; a table change is a projection; a
constraint is a check that runs on the data before the change is published.
"""

"""verdigris: a PySpark-native engine for evaluation data.

Tables of items, replies, verdicts and dialogue turns go in; scored records,
folds, metrics and reports come out.  Everything is a DataFrame or Column
transform, so the plans are Catalyst's to optimise.
"""

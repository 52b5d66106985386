"""Operators for preparing training text: one module for each operator.

Every operator takes DataFrames and returns a DataFrame. Row-wise work runs in
``mapInArrow`` over slices of an Arrow batch, so a task holds a few hundred
documents at a time; whatever needs rows of several documents together goes
through a Spark shuffle.
"""

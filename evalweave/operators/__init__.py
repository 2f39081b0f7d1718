"""DataFrame-to-DataFrame operators.

They are lazy, with two exceptions: the size checks of :mod:`evalweave.operators.joins`
fetch a bounded number of group or hot-key records to choose a join, and early stopping
writes its one row per run when a log has runs too long for one task.
"""

"""Operators for preparing large text corpora for language-model training.

Nothing else in ``ebbtide`` imports this subpackage; it only borrows the
general helpers in ``ebbtide.session`` and ``ebbtide.sources``.  Every operator
takes a DataFrame and column names, reads just those columns and returns its
own fixed columns, so extra or clashing columns of the input do no harm.
"""

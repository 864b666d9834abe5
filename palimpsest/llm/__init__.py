"""Training-data operators. Nothing else in the package imports this subpackage.

Each module holds one operator with a general interface; :mod:`queries` applies them to the
standard tables and :mod:`oracles` holds the SQL that can be stated for them.
"""

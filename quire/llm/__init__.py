"""Training-data pipeline operators: ten independent modules over document and page tables.

Nothing else in the library imports this subpackage.  ``queries`` registers one query per operator.
"""

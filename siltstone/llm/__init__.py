"""Training-data operators: one module for each operator, one function for each step.

Nothing else in the library imports this subpackage.
"""

"""Operators for preparing language-model training data.

Each module holds one operator with its own general interface; ``queries``
applies them to the driver's tables. Nothing else in the package imports this
folder.
"""

"""Operators for preparing training data at corpus scale.

Nothing else in :mod:`arbora` imports this subpackage.  Each module holds one
operator with a general interface; ``queries`` derives the registered digest
queries from them.
"""

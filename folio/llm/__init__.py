"""Operations for preparing training data: one module an operator, queries in ``queries``.

Nothing else in the package imports this subpackage.
"""

"""Operations that prepare text corpora for model training.

Nothing else in the library imports this subpackage.  ``queries`` holds the
registered queries and their SQL twins; every other module holds one operator.
"""

"""Operations of a training-data pipeline over text, pages and conversations.

Nothing else in the package imports this one.
"""

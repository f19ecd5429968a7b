"""Operations of a training-data pipeline over plain document tables.

Each module holds one operator with its own general interface; ``queries``
holds the thin queries that are registered for the driver.  No other part of
the library imports this subpackage.
"""

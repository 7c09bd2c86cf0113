"""Exceptions of the store and its operators."""


class CacheError(Exception):
    """Any failure of the tile cache."""


class Invalid(CacheError):
    """The request breaks a rule of the data model."""


class Corrupt(CacheError):
    """Stored rows disagree with what they say about themselves."""


class Collision(CacheError):
    """Two addresses have one numeric key."""


class Busy(CacheError):
    """Another writer holds the store."""

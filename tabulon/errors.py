"""What can go wrong, by name."""


class StoreError(Exception):
    """Base of all errors of this library."""


class DuplicateKey(StoreError):
    pass


class NoSuchType(StoreError):
    pass


class SchemaMismatch(StoreError):
    pass


class UnsupportedPredicate(StoreError):
    pass


class BadRow(StoreError):
    pass


class TypeNotEmpty(StoreError):
    pass


class UnsupportedForBulk(StoreError):
    pass


class NotAppendable(StoreError):
    pass


class VersionUnavailable(StoreError):
    pass


class WouldBlock(StoreError):
    pass


class Durability(StoreError):
    pass


class Corrupt(StoreError):
    pass


class CompactionMismatch(StoreError):
    pass

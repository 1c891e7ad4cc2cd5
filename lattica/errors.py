"""Errors of the engine."""


class LatticaError(Exception):
    """Base of all."""


class DatasetExists(LatticaError):
    """A dataset is there already and overwrite wasn't asked for."""


class DatasetLocked(LatticaError):
    """Another writer holds the dataset."""


class DatasetCorrupt(LatticaError):
    """What is stored doesn't agree with its manifest."""


class IncompatibleSchema(LatticaError, ValueError):
    """Parts or annotations that must agree don't."""


class LossyCast(LatticaError, ValueError):
    """A cast would change values."""


class NonIntegerCounts(LatticaError, ValueError):
    """Counts that aren't whole numbers of 0 or more."""


class DuplicateEntries(LatticaError, ValueError):
    """One (row, column) is stored twice."""


class ColumnOutOfBounds(LatticaError, ValueError):
    """An entry's column is not one of the matrix."""

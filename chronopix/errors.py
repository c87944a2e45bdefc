"""Exceptions of the library."""


class SeriesTooShort(ValueError):
    """A series has too few observations to segment."""


class TrainingDataError(ValueError):
    """Labels cannot be matched to segments without ambiguity."""


class UnknownAlgorithm(KeyError):
    """No algorithm or estimator of this name is registered."""

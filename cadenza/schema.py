"""Canonical tables and the errors of eager checks.

A series is the group of rows with the same key columns (station_id, component); mjd orders it, seq breaks ties. NaN is a
missing value and is kept apart from NULL.
"""

from __future__ import annotations

KEYS = ["station_id", "component"]
SERIES = "station_id string, component string, unit string, seq bigint, t timestamp, mjd double, value double, flag smallint"


class CadenzaError(Exception):
    """Root of all errors."""


class DataError(CadenzaError):
    """The data do not suit the operator."""


class SeriesTooShort(DataError):
    pass


class MissingValue(DataError):
    pass


class IoError(CadenzaError):
    pass


class FileNotFound(IoError):
    pass


class ParseError(IoError):
    pass


class ConfigError(CadenzaError):
    """A parameter is outside its range."""


class AlgorithmError(CadenzaError):
    pass


class ConvergenceError(AlgorithmError):
    pass


class SingularMatrix(AlgorithmError):
    pass

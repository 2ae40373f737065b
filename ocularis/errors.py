"""Errors by cause."""


class OcularisError(Exception):
    """Base of all errors of this library."""


class ValidationError(OcularisError):
    """A dataset breaks its contract."""


class SchemaError(OcularisError):
    """A table or column isn't what it should be."""


class TimebaseError(OcularisError):
    """Times can't be normalised or aligned."""


class CoordinateError(OcularisError):
    """A coordinate space is unknown or can't be converted."""


class BackendError(OcularisError):
    """An optional outside engine is needed and isn't there."""


class ModelError(OcularisError):
    """A model can't be fitted or used."""


class GovernanceError(OcularisError):
    """A gate of evidence isn't passed."""

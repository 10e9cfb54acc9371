"""Errors of the engine; all are ValueErrors, so callers can catch them as one."""


class VocabularyError(ValueError):
    """A vocabulary file or table that can't be used."""


class TokenError(ValueError):
    """A token id outside of the id space, or one that stands for nothing."""


class SpecialTokenError(ValueError):
    """An unknown special token, or one in a text that doesn't allow it."""

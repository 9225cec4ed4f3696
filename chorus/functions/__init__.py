"""Column-expression builders (text, normalisation, scores) and the Arrow UDFs."""

from chorus.functions import normalize, scores, text  # noqa: F401

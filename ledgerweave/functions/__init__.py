"""Column-expression rules: text, key, date and amount normalisation."""

from .normalize import *  # noqa: F401,F403

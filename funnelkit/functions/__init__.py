from . import quantiles, scalar, vocab  # noqa: F401

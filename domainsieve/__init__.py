"""DNS threat analytics as PySpark DataFrame operators."""

from domainsieve.params import Params

__all__ = ["Params"]

"""Connected components, as the library has them."""

from aspectra.functions.components import components

__all__ = ["components"]

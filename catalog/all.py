"""Imports every module that registers queries."""

import catalog.features  # noqa: F401
import catalog.text  # noqa: F401
import catalog.risk  # noqa: F401
import catalog.areas  # noqa: F401
import catalog.quality  # noqa: F401
import catalog.model  # noqa: F401
import catalog.reviews  # noqa: F401

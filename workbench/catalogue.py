"""All registered queries."""

from workbench import (  # noqa: F401
    catalogue_alert,
    catalogue_collect,
    catalogue_config,
    catalogue_digest,
    catalogue_explore,
)
from workbench.registry import SPARK, SQL  # noqa: F401

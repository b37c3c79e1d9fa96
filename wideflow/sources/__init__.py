"""Sources and sinks (SRC-1..3, SNK-1..5) and the ``obs`` stand-in table."""

from wideflow.sources.io import (  # noqa: F401
    read_table, read_variant, read_variants, write_table,
)
from wideflow.sources.fixtures import obs, OBS_SQL, with_obs  # noqa: F401

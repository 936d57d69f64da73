from velostat.sources.export import bi_prepare, published, snake_case, write_exports  # noqa: F401
from velostat.sources.files import (  # noqa: F401
    LEGACY_SCHEMA,
    MODERN_SCHEMA,
    read_trips_csv,
    read_trips_parquet,
    read_trips_table,
)
from velostat.sources.fixtures import legacy_source, modern_source, read_table  # noqa: F401

from ectolog.sources.readers import read_csv, read_csv_checked, read_csv_text, read_snapshot  # noqa: F401
from ectolog.sources.sinks import (  # noqa: F401
    history_rows,
    load_model,
    replace_partitions,
    save_model,
    write_bucketed,
    write_csv,
    write_history,
    write_snapshot,
)

from condmon.sources.labels import (
    clean_labels, clean_set_params, read_labels, read_raw_csv, read_set_params, with_modality,
)
from condmon.sources.recordings import FILE_STEM, check_files, existing_refs, file_listing, read_recordings
from condmon.sources.runs import (
    FAMILY_TREE, METRICS, RUN_SCHEMA, SEED_TREE, SHORT, flatten_runs, read_constants, read_history,
    read_runs, union_runs, with_tree_seed,
)
from condmon.sources.sinks import constants_document, results_json, set_lines, write_constants, write_report

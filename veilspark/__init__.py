"""Personal-data detection, pseudonymisation and anonymisation as Spark jobs."""

from .functions.detectors import DETECTORS, register_detector
from .functions.text import fold, strip
from .operators.anonymise import anonymise, generalise_partitions, partition
from .operators.audit import audit_classes, diversity, global_frequencies, t_distance, violations
from .operators.cleaning import fill_missing
from .operators.labels import label_columns, with_flag
from .operators.pseudonymise import (
    PSEUDONYMISERS,
    encode_identifiers,
    encode_text,
    generalise,
    pseudonymise_email,
    pseudonymise_labelled,
    register_pseudonymiser,
    to_interval,
)
from .operators.spans import full_spans, spans, split_side
from .operators.uniqueness import combination_uniqueness, uniqueness
from .plans.publish import run
from .sources.dictionaries import (
    build_dictionary,
    country_dictionary,
    name_dictionary,
    read_lines,
    region_dictionary,
    term_dictionary,
)
from .sources.pages import extract_cells
from .sources.tables import (
    read_labels,
    read_records,
    read_table,
    write_labels,
    write_table,
)
from .spec import PrivacySpec, nan_to_null, with_row_order

from .readers import (clean_docstring_examples, intent_examples, load_data, normalise_examples,
                      parse_json_column, read_json_array, read_jsonl, register_loader, seeded_slice)
from .sinks import read_answers, row_count, write_answers, write_json_array, write_records
from .tables import TABLES, corpus, synth_code, table

__all__ = [
    "TABLES", "clean_docstring_examples", "corpus", "intent_examples", "load_data",
    "normalise_examples", "parse_json_column", "read_answers", "read_json_array", "read_jsonl",
    "register_loader", "row_count", "seeded_slice", "synth_code", "table", "write_answers",
    "write_json_array", "write_records",
]

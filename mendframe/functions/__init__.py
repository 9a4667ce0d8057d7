"""The column API."""

from mendframe.functions.columns import (
    align,
    apply_patch,
    apply_patch_and_validate,
    chunks,
    coerce,
    coerce_candidates,
    completion,
    json_objects,
    leaves,
    markdown_blocks,
    match_enum,
    merge_evidence,
    merge_values,
    normalize_key,
    normalize_patches,
    parse,
    parse_candidates,
    parse_number,
    schema_errors,
    slice_doc,
    slice_schema,
    token_span,
    tokens,
)

__all__ = ["align", "apply_patch", "apply_patch_and_validate", "chunks", "coerce", "coerce_candidates", "completion", "json_objects", "leaves", "markdown_blocks", "match_enum", "merge_evidence", "merge_values", "normalize_key", "normalize_patches", "parse", "parse_candidates", "parse_number", "schema_errors", "slice_doc", "slice_schema", "token_span", "tokens"]

"""Column-expression helpers (JVM-side, codegen-friendly)."""

from equiloan.functions.columns import (  # noqa: F401
    clamp,
    code_is,
    col_of,
    flag,
    normalize_code,
    portable_hash,
    round6,
    safe_div,
    sanitize_name,
    sanitize_names,
)

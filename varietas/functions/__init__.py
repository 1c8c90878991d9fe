"""Column-level functions (T*, M*): built-in Spark expressions only."""

from varietas.functions.treebank import (  # noqa: F401
    split_whitespace,
    strip_whitespace,
    treebank_detokenize,
    treebank_string,
    treebank_tokens,
)
from varietas.functions.scalar import (  # noqa: F401
    arc_cost,
    dot,
    join_tokens,
    l2_normalize,
    rstrip_line,
)

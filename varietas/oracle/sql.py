"""Oracle SQL (DuckDB) for the registered queries.

The Treebank rules are the same fixed values as the library's (their results are pinned by written-out
tokens in the tests); everything else is written independently of the Spark code.

Each entry recomputes the query from the driver views with plain SQL (window functions, joins,
aggregates).  Where the Spark job is incremental (prefix curves), the SQL recomputes every
prefix from scratch, so the two agree only if the incremental rewrite is right.
"""

from __future__ import annotations

from varietas.oracle import duck

NL = "chr(10)"


def lines_cte(name: str, source: str, keys: list[str], where: str = "true", blank_ok: bool = False) -> str:
    k = ", ".join(keys)
    filt = "" if blank_ok else f"where length(rtrim(text, ' ' || {NL})) > 0"
    return (f"{name} as (select * from (select {k}, generate_subscripts(s, 1) - 1 as line_no, unnest(s) as text "
            f"from (select {k}, string_split(text, {NL}) as s from {source} where {where})) {filt})")


DOC_LINES = lines_cte("doc_lines", "documents", ["doc_id"], blank_ok=True)
USER_LINES = lines_cte("user_lines0", "conversations", ["conv_id", "turn"], "role = 'user'")
GEN_LINES = lines_cte("gen_lines0", "conversations", ["conv_id", "turn"], "role = 'assistant'")
DEV_LINES = lines_cte("dev_lines0", "benchmark", ["item_id"])
USER_ORDERED = ("user_lines as (select row_number() over (order by conv_id, turn, line_no) as sent_id, text "
                "from user_lines0)")
GEN_ORDERED = ("gen_lines as (select row_number() over (order by conv_id, turn, line_no) as sent_id, text "
               "from gen_lines0)")
DEV_ORDERED = "dev_lines as (select row_number() over (order by item_id, line_no) as sent_id, text from dev_lines0)"


def with_(*ctes: str) -> str:
    return "with " + ",\n".join(ctes) + "\n"


def recursive(*ctes: str) -> str:
    return "with recursive " + ",\n".join(ctes) + "\n"


def tb_tokens(expr: str = "text") -> str:
    return duck.treebank_tokens(expr)


def doc_tokens_cte(name: str = "doc_toks") -> str:
    return f"{name} as (select doc_id, line_no, {tb_tokens()} as toks from doc_lines)"


def vectors_cte() -> str:
    """(rank, word, v): embedding of rank r ↔ r-th most frequent corpus token (ties by token)."""
    return (
        "doc_words as (select unnest(toks) as word from doc_toks),\n"
        "word_freq as (select word, count(*) as n from doc_words group by word),\n"
        "ranked_words as (select word, row_number() over (order by n desc, word) - 1 as rank from word_freq),\n"
        "vectors as (select cast(r.rank as integer) as rank, r.word, e.embedding as v "
        "from embeddings e join ranked_words r on e.vec_id = r.rank)"
    )


def vec_norm_cte() -> str:
    return (
        "vec_norm as (select rank, word, case when sqrt(list_sum(list_transform(v, lambda x: cast(x as double) * x))) > 0 "
        "then list_transform(v, lambda x: cast(x as double) / sqrt(list_sum(list_transform(v, lambda y: cast(y as double) * y)))) "
        "end as u from vectors)"
    )

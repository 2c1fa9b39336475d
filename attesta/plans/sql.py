"""Pieces of SQL shared by the oracle twins."""

from __future__ import annotations

from attesta.functions import text as T


def stop_list(stop: tuple[str, ...]) -> str:
    return "(" + ", ".join(f"'{s}'" for s in stop) + ")"


def toks(column: str, stop: tuple[str, ...] = T.STOP_PRODUCTION, least: int = 1) -> str:
    rule = f" and x not in {stop_list(stop)}" if stop else ""
    return f"list_filter(regexp_split_to_array(lower(strip_accents({column})), '[^0-9a-z]+'), lambda x: length(x) >= {least}{rule})"


def bags(weight: int = 2, stop: tuple[str, ...] = T.STOP_PRODUCTION, least: int = 1, body=None) -> str:
    """CTEs bag(doc_id, toks), d(doc_id, term, f, dl), st(n, avgdl)."""
    body = body or (lambda c: toks(c, stop, least))
    parts = body("text") + "".join(f" || {body('source')}" for _ in range(weight))
    return f"""bag as (select doc_id, {parts} as toks from documents),
d as (select doc_id, term, count(*) as f, any_value(dl) as dl from (select doc_id, len(toks) as dl, unnest(toks) as term from bag) group by doc_id, term),
st as (select count(*) as n, avg(len(toks)) as avgdl from bag),
dfs as (select term, count(*) as df from d group by term)"""


def questions(stop: tuple[str, ...] = T.STOP_PRODUCTION, least: int = 1, body=None) -> str:
    body = body or (lambda c: toks(c, stop, least))
    return f"q as (select query_id, term, count(*) as qtf from (select item_id as query_id, unnest({body('text')}) as term from benchmark) group by query_id, term)"


IDF = "ln(1 + (n - df + 0.5::double) / (df + 0.5::double))"


def scored(k1: float = 1.2, b: float = 0.75) -> str:
    """CTEs parts(query_id, doc_id, term, part), scored(query_id, doc_id, score)."""
    share = f"f * ({k1}::double + 1) / (f + {k1}::double * (1 - {b}::double + {b}::double * dl / avgdl))"
    return f"""parts as (select query_id, doc_id, term, qtf * ({IDF} * ({share})) as part from d join dfs using (term) join q using (term) cross join st),
scored as (select query_id, doc_id, round(sum(part), 6) as score from parts group by query_id, doc_id having round(sum(part), 6) > 0)"""


def top(k: int, source: str = "scored", name: str = "ranked") -> str:
    return f"{name} as (select *, cast(row_number() over (partition by query_id order by score desc, doc_id) as int) as rank from {source} qualify rank <= {k})"


EXPECTED = "expected as (select b.item_id as query_id, d.doc_id from benchmark b join documents d on contains(d.text, b.text))"

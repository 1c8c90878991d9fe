"""DuckDB SQL for lattice decoding: k-best strings by a recursive query over positions (oracle side).

``slots(key..., pos, word, cost)`` and raw counts ``cnt(key..., ord, h, w, c)`` are given; the recursion keeps the k
cheapest strings per (sentence, last two words) and position, and p(w | h) is the Witten–Bell recursion on the counts.
Addends are rounded to 1e-9 as the decoder does, so sums are exact.
"""

from __future__ import annotations

UNITS = "1000000000"


def decode_ctes(k: int, by: str = "", slots: str = "slots", cnt: str = "cnt") -> list[str]:
    """CTEs ending in ``best(by, sent_id, rank, sent, score)`` for order-3 models (one model per value of ``by``)."""
    b = f"{by}, " if by else ""
    kb = f"k.{by}, " if by else ""

    def same(x: str, y: str) -> str:
        return f" and {x}.{by} = {y}.{by}" if by else ""
    sizes = (f"dsize as (select {b}count(distinct w) * 1.0 as nv from (select {b}w from {cnt} where ord = 1 union all "
             f"select distinct {b}unnest(['</s>', '<unk>']) from {cnt}) t" + (f" group by {by}" if by else "") + ")")
    out = [
        f"ds0 as (select {b}sent_id, pos, word, min(round(cost * {UNITS})::bigint) as cost from {slots} group by all)",
        f"ds as (select * from ds0 union all select {b}sent_id, max(pos) + 1, '</s>', 0 from ds0 group by all)",
        f"dkeys as (select distinct {'a.' + by + ', ' if by else ''}"
        "case when a.pos = 0 then null when a.pos = 1 then '<s>' else y.word end as w2, "
        "case when a.pos = 0 then '<s>' else x.word end as w1, a.word as w from ds a "
        f"left join ds x on x.sent_id = a.sent_id and x.pos = a.pos - 1{same('x', 'a')} "
        f"left join ds y on y.sent_id = a.sent_id and y.pos = a.pos - 2{same('y', 'a')})",
        f"dctx as (select {b}ord, h, sum(c) as ch, count(*) as th from {cnt} group by all)", sizes]
    joins, expr = [], "(1.0 / s.nv)"
    for m, h in ((1, "''"), (2, "k.w1"), (3, "k.w2 || ' ' || k.w1")):
        joins.append(f"left join dctx x{m} on x{m}.ord = {m} and x{m}.h = {h}{same(f'x{m}', 'k')} "
                     f"left join {cnt} c{m} on c{m}.ord = {m} and c{m}.h = {h} and c{m}.w = k.w{same(f'c{m}', 'k')}")
        expr = (f"(case when x{m}.ch is null then {expr} else (coalesce(c{m}.c, 0) + x{m}.th * {expr}) / (x{m}.ch + x{m}.th) end)")
    on = f"join dsize s on s.{by} = k.{by}" if by else "cross join dsize s"
    out.append(f"dp as (select {kb}k.w2, k.w1, k.w, round(-ln({expr}) * {UNITS})::bigint as step from dkeys k {on} {' '.join(joins)})")
    rb = f"r.{by}, " if by else ""
    out.append(f"""walk as (
  select distinct {b}sent_id, -1::bigint as pos, null::varchar as w2, '<s>' as w1, '' as sent, 0::bigint as cost from ds
  union all
  select {b}sent_id, pos, w2, w1, sent, cost from (
    select {rb}r.sent_id, r.pos + 1 as pos, r.w1 as w2, a.word as w1,
      case when a.word = '</s>' then r.sent when r.sent = '' then a.word else r.sent || ' ' || a.word end as sent,
      r.cost + a.cost + p.step as cost
    from walk r join ds a on a.sent_id = r.sent_id and a.pos = r.pos + 1{same('a', 'r')}
    join dp p on p.w2 is not distinct from r.w2 and p.w1 = r.w1 and p.w = a.word{same('p', 'r')}) t
  qualify row_number() over (partition by {b}sent_id, w2, w1 order by cost, sent) <= {k})""")
    out.append(f"""best as (select {b}sent_id, row_number() over (partition by {b}sent_id order by cost, sent) as rank, sent, cost / {UNITS}.0 as score
  from walk where w1 = '</s>' qualify rank <= {k})""")
    return out


def error_rate(words: str, sent: str) -> str:
    """Share of positions of the list ``words`` whose decoded word differs (no path: all)."""
    same = (f"len(list_filter(generate_series(1, len({words})), lambda i: {words}[i] = string_split(coalesce({sent}, ''), ' ')[i]))")
    return f"case when coalesce(len({words}), 0) > 0 then (len({words}) - {same}) / len({words})::double else 0.0 end"

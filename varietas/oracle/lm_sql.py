"""DuckDB SQL for n-gram counts, smoothed models and scores (oracle side).

The SQL computes each smoothing method straight from its textbook recursion; scoring evaluates
p_N(w | h) = mix(c(h_N w), c(h_N), T(h_N), p_{N-1}) order by order with pass-down for unseen
histories — it never uses a backoff-weight table, so it checks the Spark formulation independently.
"""

from __future__ import annotations

from varietas.oracle import duck

WS_TOKS = "list_filter(regexp_split_to_array({e}, {ws}), lambda x: x <> '')"


def ws_tokens(expr: str) -> str:
    return duck.split_whitespace(expr)


def events_sql(src: str, order: int, toks_expr: str, keep: str = "") -> str:
    """SELECT of (keep, pos, ord, h, w) over ``src`` with token list ``toks_expr``."""
    k = (keep + ", ") if keep else ""
    return f"""select {k}j - 1 as pos, n as ord,
        array_to_string(seq[j - n + 1 : j - 1], ' ') as h, seq[j] as w
 from (select {k}list_concat(['<s>'], {toks_expr}, ['</s>']) as seq from {src}) s,
      lateral (select unnest(range(2, len(seq) + 1)) as j) jj,
      lateral (select unnest(range(1, least({order}, j) + 1)) as n) nn"""


def counts_ctes(src: str, order: int, toks_expr: str, name: str = "cnt") -> list[str]:
    return [f"{name}_ev as ({events_sql(src, order, toks_expr)})",
            f"{name} as (select ord, h, w, count(*) as c from {name}_ev group by ord, h, w)"]


def lower(h: str) -> str:
    return f"regexp_replace({h}, '^[^ ]* ?', '')"


def model_ctes(order: int, method: str, cnt: str = "cnt", k: float = 1.0, discount_fallback: bool = True,
               bins: int = -1) -> list[str]:
    """CTEs producing ``probs(ord, h, w, p)`` and ``ctxg(ord, h, g)`` from counts table ``cnt``."""
    out = [f"vocab as (select w from {cnt} where ord = 1 union select '</s>' union select '<unk>')",
           "vsize as (select count(*) * 1.0 as nv from vocab)"]
    base = cnt
    if method == "kneser_ney":
        parts = []
        for n in range(1, order + 1):
            if n == order:
                parts.append(f"select ord, h, w, c, c as a from {cnt} where ord = {n}")
            else:
                parts.append(
                    f"select x.ord, x.h, x.w, x.c, case when x.h = '<s>' or starts_with(x.h, '<s> ') then x.c "
                    f"else coalesce(u.cont, x.c) end as a from {cnt} x left join "
                    f"(select {lower('h')} as lh, w, count(*) as cont from {cnt} where ord = {n + 1} group by 1, 2) u "
                    f"on u.lh = x.h and u.w = x.w where x.ord = {n}")
        out.append("kn as (" + " union all ".join(parts) + ")")
        out.append("""kcc as (select ord, sum(case when a = 1 then 1 else 0 end) as n1, sum(case when a = 2 then 1 else 0 end) as n2,
            sum(case when a = 3 then 1 else 0 end) as n3, sum(case when a = 4 then 1 else 0 end) as n4 from kn group by ord)""")
        out.append("""kd0 as (select ord, n1 * 1.0 / (n1 + 2 * n2) as y, n1, n2, n3, n4 from kcc)""")
        out.append("""kd1 as (select ord, 1 - 2 * y * n2 / n1 as d1, 2 - 3 * y * n3 / n2 as d2, 3 - 4 * y * n4 / n3 as d3 from kd0)""")
        fb = "1" if discount_fallback else "0"
        out.append(f"""kdisc as (select ord, case when ok then d1 else 0.5 end as d1, case when ok then d2 else 1.0 end as d2,
            case when ok then d3 else 1.5 end as d3 from (select *, coalesce(d1 between 0 and 1 and d2 between 0 and 2
            and d3 between 0 and 3 and not isnan(d1) and not isnan(d2) and not isnan(d3), false) or {fb} = 0 as ok from kd1))""")
        base = "(select ord, h, w, a as c from kn)"
    out.append(f"""ctx as (select ord, h, sum(c) as ch, count(*) as th, sum(case when c = 1 then 1 else 0 end) as n1,
        sum(case when c = 2 then 1 else 0 end) as n2, sum(case when c >= 3 then 1 else 0 end) as n3p
        from {base} group by ord, h)""")
    if method == "absolute" and bins > 1:
        counts = ", ".join(f"sum(case when c = {j} then 1 else 0 end) as m{j}" for j in range(1, bins + 2))
        per = ", ".join(f"case when coalesce({j} - {j + 1} * d * m{j + 1} / nullif(m{j}, 0) between 0 and {j}, false) "
                        f"then {j} - {j + 1} * d * m{j + 1} / nullif(m{j}, 0) else d end as d{j}" for j in range(1, bins + 1))
        out.append(f"""adisc as (select ord, {per} from (select *, coalesce(m1 * 1.0 / nullif(m1 + 2 * m2, 0), 0.5) as d
            from (select ord, {counts} from {cnt} group by ord)))""")
        pick = "case " + " ".join(f"when x.c = {j} then ad.d{j}" for j in range(1, bins)) + f" else ad.d{bins} end"
        out.append(f"""ataken as (select x.ord, x.h, sum(least({pick}, x.c)) as taken from {cnt} x join adisc ad on ad.ord = x.ord
            group by x.ord, x.h)""")
    elif method == "absolute":
        out.append(f"""adisc as (select ord, coalesce(sum(case when c = 1 then 1 else 0 end) * 1.0 /
            nullif(sum(case when c = 1 then 1 else 0 end) + 2 * sum(case when c = 2 then 1 else 0 end), 0), 0.5) as d
            from {cnt} group by ord)""")
    if method == "katz":
        kk = 5 if bins < 0 else bins
        sums = ", ".join(f"sum(case when c = {j} then 1 else 0 end) as m{j}" for j in range(1, kk + 2))
        out.append(f"kcc as (select ord, {sums} from {cnt} group by ord)")
        dcols = []
        for r in range(1, kk + 1):
            d = f"(({r + 1}.0 * m{r + 1} / m{r}) / {r} - ({kk + 1}.0 * m{kk + 1} / m1)) / (1 - ({kk + 1}.0 * m{kk + 1} / m1))"
            dcols.append(f"case when coalesce({d} > 0 and {d} <= 1, false) then {d} else 1.0 end as kd{r}")
        out.append(f"kdisc as (select ord, {', '.join(dcols)} from kcc)")
    for n in range(1, order + 1):
        if n == 1:
            low = "(select 1.0 / nv from vsize)"
            join_low = ""
        else:
            low = "pl.p"
            join_low = f"join p{n - 1} pl on pl.h = {lower('x.h')} and pl.w = x.w"
        c, ch, th = "x.c * 1.0", "t.ch * 1.0", "t.th * 1.0"
        extra = ""
        if method == "witten_bell":
            p = f"({c} + {k} * {th} * {low}) / ({ch} + {k} * {th})"
            g = f"{k} * {th} / ({ch} + {k} * {th})"
        elif method in ("unsmoothed", "presmoothed"):
            p, g = f"{c} / {ch}", "0.0"
        elif method == "absolute" and bins > 1:
            extra = "join adisc ad on ad.ord = x.ord join ataken tkn on tkn.ord = x.ord and tkn.h = x.h"
            g = f"tkn.taken / {ch}"
            p = f"greatest({c} - ({pick}), 0) / {ch} + {g} * {low}"
        elif method == "absolute":
            extra = "join adisc ad on ad.ord = x.ord"
            p = f"greatest({c} - ad.d, 0) / {ch} + ad.d * {th} / {ch} * {low}"
            g = f"ad.d * {th} / {ch}"
        elif method == "kneser_ney":
            extra = "join kdisc kd on kd.ord = x.ord"
            g = f"(kd.d1 * t.n1 + kd.d2 * t.n2 + kd.d3 * t.n3p) / {ch}"
            dj = "case when x.c = 1 then kd.d1 when x.c = 2 then kd.d2 else kd.d3 end"
            p = f"greatest({c} - {dj}, 0) / {ch} + {g} * {low}"
        elif method == "katz":
            kk = 5 if bins < 0 else bins
            extra = "join kdisc kd on kd.ord = x.ord"
            dr = "case " + " ".join(f"when x.c = {r} then kd.kd{r}" for r in range(1, kk + 1)) + " else 1.0 end"
            out.append(f"""q{n} as (select x.h, x.w, {dr} * {c} / {ch} as pk, (1 - {dr}) * {c} / {ch} as lft, {low} as plo,
                {c} as cc, {ch} as chh, {th} as thh from {base} x join ctx t on t.ord = x.ord and t.h = x.h {extra} {join_low}
                where x.ord = {n})""")
            den = "1 - max(thh) * (select 1.0 / nv from vsize)" if n == 1 else "1 - sum(plo)"
            out.append(f"""a{n} as (select h, sum(lft) as num, {den} as den from q{n} group by h)""")
            out.append(f"""p{n} as (select q.h, q.w, case when a.num > 1e-12 and a.den > 1e-12 then q.pk
                else (q.cc + q.thh * q.plo) / (q.chh + q.thh) end as p,
                case when a.num > 1e-12 and a.den > 1e-12 then a.num / a.den else q.thh / (q.chh + q.thh) end as g
                from q{n} q join a{n} a on a.h = q.h)""")
            continue
        out.append(f"""p{n} as (select x.h, x.w, {p} as p, {g} as g from {base} x join ctx t on t.ord = x.ord and t.h = x.h
            {extra} {join_low} where x.ord = {n})""")
    out.append("probs as (" + " union all ".join(f"select {n} as ord, h, w, p, g from p{n}" for n in range(1, order + 1)) + ")")
    return out


def dev_events_ctes(dev: str, order: int) -> list[str]:
    """Dev words mapped to <unk> outside the vocabulary; one row per scored word with histories h1..hN."""
    hs = ", ".join(
        [f"'' as h1"] + [f"case when j > {m - 1} then array_to_string(seq[j - {m - 1} : j - 1], ' ') end as h{m}"
                         for m in range(2, order + 1)])
    return [
        f"dtok as (select sent_id, generate_subscripts(t, 1) as pos, unnest(t) as tok from (select sent_id, {ws_tokens('text')} as t from {dev}))",
        "dmap as (select d.sent_id, d.pos, case when v.w is null then '<unk>' else d.tok end as t, v.w is null as oov "
        "from dtok d left join vocab v on v.w = d.tok)",
        f"dseq as (select s.sent_id, list_concat(['<s>'], coalesce(m.ts, []::varchar[]), ['</s>']) as seq, "
        f"list_concat([false], coalesce(m.os, []::boolean[]), [false]) as oo from (select distinct sent_id from {dev}) s "
        f"left join (select sent_id, list(t order by pos) as ts, list(oov order by pos) as os from dmap group by sent_id) m "
        f"on m.sent_id = s.sent_id)",
        f"dev_ev as (select sent_id, j - 1 as pos, seq[j] as w, oo[j] as oov, {hs} "
        f"from dseq, lateral (select unnest(range(2, len(seq) + 1)) as j) jj)",
    ]


def recursion_score_sql(order: int, k: float = 1.0, cnt: str = "cnt", by_i: str | None = None) -> str:
    """SELECT (sent_id, pos, w, oov, log10p) by the Witten–Bell recursion over raw counts.

    With ``by_i`` (a table of prefix numbers ``i``) every dev word is scored once per prefix, against
    ``cnt``/``ctx`` tables that carry an ``i`` column.
    """
    joins, p_prev = [], "(1.0 / (select nv from vsize))"
    exprs = []
    src = "dev_ev e"
    sel_i = ""
    if by_i:
        src = f"dev_ev e cross join {by_i} r"
        sel_i = "r.i, "
    for m in range(1, order + 1):
        oi = f" and x{m}.i = r.i" if by_i else ""
        ci = f" and c{m}.i = r.i" if by_i else ""
        joins.append(f"left join ctx x{m} on x{m}.ord = {m} and x{m}.h = e.h{m}{oi} "
                     f"left join {cnt} c{m} on c{m}.ord = {m} and c{m}.h = e.h{m} and c{m}.w = e.w{ci}")
        pm = (f"case when x{m}.ch is null then {{prev}} else (coalesce(c{m}.c, 0) + {k} * x{m}.th * {{prev}}) / "
              f"(x{m}.ch + {k} * x{m}.th) end")
        exprs.append(pm)
    expr = p_prev
    for pm in exprs:
        expr = pm.replace("{prev}", f"({expr})")
    return f"select {sel_i}e.sent_id, e.pos, e.w, e.oov, log10({expr}) as log10p from {src} " + " ".join(joins)


def kn_curve_sql(order: int, tl: str = "tl", dev: str = "dev_lines") -> list[str]:
    """CTEs retraining interpolated modified Kneser–Ney (discount fallback) for every prefix ``i`` of
    ``tl(i, text)`` and scoring the dev words by the recursion; ends with ``sc(i, log10p)``."""
    out = [f"cnt_ev as ({events_sql(tl, order, ws_tokens('text'), keep='i')})",
           "cnt as (select i, ord, h, w, count(*) as c from cnt_ev group by i, ord, h, w)"]
    parts = []
    for n in range(1, order + 1):
        if n == order:
            parts.append(f"select i, ord, h, w, c as a from cnt where ord = {n}")
        else:
            parts.append(
                f"select x.i, x.ord, x.h, x.w, case when x.h = '<s>' or starts_with(x.h, '<s> ') then x.c "
                f"else coalesce(u.cont, x.c) end as a from cnt x left join "
                f"(select i, {lower('h')} as lh, w, count(*) as cont from cnt where ord = {n + 1} group by 1, 2, 3) u "
                f"on u.i = x.i and u.lh = x.h and u.w = x.w where x.ord = {n}")
    out.append("kn as (" + " union all ".join(parts) + ")")
    out.append("""kcc as (select i, ord, sum(case when a = 1 then 1 else 0 end) as n1, sum(case when a = 2 then 1 else 0 end) as n2,
        sum(case when a = 3 then 1 else 0 end) as n3, sum(case when a = 4 then 1 else 0 end) as n4 from kn group by i, ord)""")
    out.append("""kd1 as (select i, ord, 1 - 2 * y * n2 / n1 as d1, 2 - 3 * y * n3 / n2 as d2, 3 - 4 * y * n4 / n3 as d3
        from (select *, n1 * 1.0 / nullif(n1 + 2 * n2, 0) as y from kcc) t)""")
    out.append("""kdisc as (select i, ord, case when ok then d1 else 0.5 end as d1, case when ok then d2 else 1.0 end as d2,
        case when ok then d3 else 1.5 end as d3 from (select *, coalesce(d1 between 0 and 1 and d2 between 0 and 2
        and d3 between 0 and 3 and not isnan(d1) and not isnan(d2) and not isnan(d3), false) as ok from kd1))""")
    out.append("""kctx as (select i, ord, h, sum(a) as sa, sum(case when a = 1 then 1 else 0 end) as n1,
        sum(case when a = 2 then 1 else 0 end) as n2, sum(case when a >= 3 then 1 else 0 end) as n3 from kn group by i, ord, h)""")
    out.append("vocab as (select distinct w from cnt where ord = 1 union select '</s>' union select '<unk>')")
    out.append("vsize as (select count(*) * 1.0 as nv from vocab)")
    out += dev_events_ctes(dev, order)
    joins, expr = [], "(1.0 / (select nv from vsize))"
    for m in range(1, order + 1):
        joins.append(f"left join kn a{m} on a{m}.i = r.i and a{m}.ord = {m} and a{m}.h = e.h{m} and a{m}.w = e.w "
                     f"left join kctx x{m} on x{m}.i = r.i and x{m}.ord = {m} and x{m}.h = e.h{m} "
                     f"left join kdisc d{m} on d{m}.i = r.i and d{m}.ord = {m}")
        a = f"coalesce(a{m}.a, 0)"
        dj = f"(case when {a} = 1 then d{m}.d1 when {a} = 2 then d{m}.d2 else d{m}.d3 end)"
        gam = f"((d{m}.d1 * x{m}.n1 + d{m}.d2 * x{m}.n2 + d{m}.d3 * x{m}.n3) / x{m}.sa)"
        expr = (f"case when x{m}.sa is null or x{m}.sa = 0 then ({expr}) else "
                f"greatest({a} - {dj}, 0) / x{m}.sa + {gam} * ({expr}) end")
    out.append(f"sc as (select r.i, log10({expr}) as log10p from dev_ev e cross join pref r {' '.join(joins)})")
    return out


def kn_steps_sql(order: int, tl: str = "steps", dev: str = "dev_lines") -> list[str]:
    """CTEs of interpolated modified Kneser–Ney (discount fallback) models of ``{tl(p, text): p <= i}`` for every ``i`` of
    ``pref``, from running counts and as-of joins; ends with ``sc(i, log10p, mult)``."""
    bos = "(h = '<s>' or starts_with(h, '<s> '))"
    hit = lambda j: f"(a {'>=' if j == 3 else '='} {j})::int - (was {'>=' if j == 3 else '='} {j})::int"
    out = [f"sev as ({events_sql(tl, order, ws_tokens('text'), keep='p')})",
           "sraw as (select ord, h, w, p, count(*) as d from sev group by all)",
           "sfirst as (select ord, h, w, min(p) as p from sraw group by all)",
           f"scont as (select ord - 1 as ord, {lower('h')} as h, w, p, count(*) as d from sfirst where ord >= 2 group by all)",
           f"sda as (select * from sraw where ord = {order} or {bos} union all select * from scont where not {bos})",
           "srun as (select *, sum(d) over (partition by ord, h, w order by p) as a from sda)",
           "smove as (select *, a - d as was from srun)",
           f"""sctx as (select ord, h, p, sum(d) over k as sa, sum(n1) over k as n1, sum(n2) over k as n2, sum(n3) over k as n3 from (
             select ord, h, p, sum(d) as d, sum({hit(1)}) as n1, sum({hit(2)}) as n2, sum({hit(3)}) as n3 from smove group by all)
             window k as (partition by ord, h order by p))""",
           f"""scc as (select ord, p, sum(n1) over k as n1, sum(n2) over k as n2, sum(n3) over k as n3, sum(n4) over k as n4 from (
             select ord, p, sum({hit(1)}) as n1, sum({hit(2)}) as n2, sum((a = 3)::int - (was = 3)::int) as n3,
               sum((a = 4)::int - (was = 4)::int) as n4 from smove group by all) window k as (partition by ord order by p))""",
           """sd1 as (select ord, p, 1 - 2 * y * n2 / n1 as d1, 2 - 3 * y * n3 / n2 as d2, 3 - 4 * y * n4 / n3 as d3
             from (select *, n1 * 1.0 / nullif(n1 + 2 * n2, 0) as y from scc) t)""",
           """sdisc as (select ord, p, case when ok then d1 else 0.5 end as d1, case when ok then d2 else 1.0 end as d2,
             case when ok then d3 else 1.5 end as d3 from (select *, coalesce(d1 between 0 and 1 and d2 between 0 and 2
             and d3 between 0 and 3 and not isnan(d1) and not isnan(d2) and not isnan(d3), false) as ok from sd1))""",
           "sdi as (select r.i, d.* from (select i, unnest([1, 2, 3]) as ord from pref) r asof join sdisc d on d.ord = r.ord and d.p <= r.i)",
           "vocab as (select distinct w from sraw where ord = 1 union select '</s>' union select '<unk>')",
           "vsize as (select count(*) * 1.0 as nv from vocab)", *dev_events_ctes(dev, order)]
    hs = ", ".join(f"h{m}" for m in range(1, order + 1))
    out.append(f"skeys as (select {hs}, w, count(*) as mult from dev_ev group by all)")
    out.append("sgrid as (select r.i, e.* from skeys e cross join pref r)")
    joins, expr = [], "(1.0 / (select nv from vsize))"
    for m in range(1, order + 1):
        joins.append(f"asof left join (select * from smove where ord = {m}) a{m} on a{m}.h = g.h{m} and a{m}.w = g.w and a{m}.p <= g.i "
                     f"asof left join (select * from sctx where ord = {m}) x{m} on x{m}.h = g.h{m} and x{m}.p <= g.i "
                     f"left join sdi d{m} on d{m}.i = g.i and d{m}.ord = {m}")
        a = f"coalesce(a{m}.a, 0)"
        dj = f"(case when {a} = 1 then d{m}.d1 when {a} = 2 then d{m}.d2 else d{m}.d3 end)"
        gam = f"((d{m}.d1 * x{m}.n1 + d{m}.d2 * x{m}.n2 + d{m}.d3 * x{m}.n3) / x{m}.sa)"
        expr = (f"case when x{m}.sa is null or x{m}.sa = 0 then ({expr}) else "
                f"greatest({a} - {dj}, 0) / x{m}.sa + {gam} * ({expr}) end")
    out.append(f"sc as (select g.i, g.mult, log10({expr}) as log10p from sgrid g {' '.join(joins)})")
    return out

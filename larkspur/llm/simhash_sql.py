"""The SimHash query in SQL for another engine that knows neither XXH64 nor trees: the hash unit by unit in recursive steps, links
by comparing all distinct fingerprints, components by transitive closure. Only for small tables."""

from __future__ import annotations

from string import ascii_lowercase, ascii_uppercase

#: The five primes of XXH64.
P1, P2, P3, P4, P5 = 11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261
_ALL = 1 << 64


def _mod(x: str) -> str:
    return f"(({x}) % {_ALL}::uhugeint)"


def _times(a: str, b: int) -> str:
    return _mod(f"({a}) * {b}::uhugeint")


def _rotated(x: str, bits: int) -> str:
    return _mod(f"(({x}) << {bits}) | (({x}) >> {64 - bits})")


def _read(place: str, n: int) -> str:
    """n bytes from ``place`` of the hexadecimal text x, the lowest first."""
    return "('0x' || " + " || ".join(f"substr(x, 2 * ({place}) + {2 * k + 1}, 2)" for k in range(n - 1, -1, -1)) + ")::uhugeint"


def _after(source: str, *steps: dict[str, str]) -> str:
    """The source with columns replaced step by step."""
    for step in steps:
        source = f"(select * replace ({', '.join(f'{x} as {name}' for name, x in step.items())}) from {source})"
    return source


def oracle_sql(seed: int = 42, shingle: int = 3, radius: int = 3) -> str:
    lanes = range(1, 5)
    begin = [(seed + P1 + P2) % _ALL, (seed + P2) % _ALL, seed, (seed - P1) % _ALL]
    stripe = _after(
        "(select * from st where n - pos >= 32)",
        {f"v{k}": _mod(f"v{k} + {_times(_read(f'pos + {8 * k - 8}', 8), P2)}") for k in lanes},
        {f"v{k}": _rotated(f"v{k}", 31) for k in lanes},
        {f"v{k}": _times(f"v{k}", P1) for k in lanes},
    )
    joined = [{"h": _mod(" + ".join(_rotated(f"v{k}", bits) for k, bits in zip(lanes, (1, 7, 12, 18), strict=True)))}]
    for k in lanes:
        joined += [{f"v{k}": _times(f"v{k}", P2)}, {f"v{k}": _rotated(f"v{k}", 31)}, {"h": _mod(f"xor(h, {_times(f'v{k}', P1)}) * {P1}::uhugeint + {P4}::uhugeint")}]
    merged = _after("(select *, 0::uhugeint as h from st where n >= 32 and n - pos < 32)", *joined, {"h": _mod("h + n::uhugeint")})
    by_unit = lambda eight, four, one: f"case when n - pos >= 8 then {eight} when n - pos >= 4 then {four} else {one} end"
    tail = _after(
        "(select * from tl where pos < n)",
        {"u": by_unit(_read("pos", 8), _read("pos", 4), _read("pos", 1))},
        {"u": by_unit(_times("u", P2), _times("u", P1), _times("u", P5))},
        {"u": by_unit(_rotated("u", 31), "u", "u")},
        {"u": by_unit(_times("u", P1), "u", "u")},
        {"h": "xor(h, u)"},
        {"h": by_unit(_rotated("h", 27), _rotated("h", 23), _rotated("h", 11))},
        {"h": by_unit(_mod(f"h * {P1}::uhugeint + {P4}::uhugeint"), _mod(f"h * {P2}::uhugeint + {P3}::uhugeint"), _times("h", P1))},
        {"pos": "pos + " + by_unit("8", "4", "1")},
    )
    mixed = _after("(select s, h from tl where pos >= n)", {"h": "xor(h, h >> 33)"}, {"h": _times("h", P2)}, {"h": "xor(h, h >> 29)"}, {"h": _times("h", P3)}, {"h": "xor(h, h >> 32)"})
    words = f"regexp_extract_all(translate(coalesce(text, ''), '{ascii_uppercase}', '{ascii_lowercase}'), " + r"'[^\x20\x09-\x0D]+')"
    return f"""
with recursive d as (select row_number() over () as row, doc_id, {words} as w from documents),
sh as (select row, unnest(list_transform(range(1, greatest(1, len(w) - {shingle - 1}) + 1), lambda i: array_to_string(w[i : i + {shingle - 1}], ' '))) as s from d where len(w) > 0),
ct as (select row, s, count(*) as many from sh group by row, s),
un as (select s, hex(encode(s)) as x, octet_length(encode(s))::bigint as n from (select distinct s from ct)),
st as (
  select s, x, n, 0::bigint as pos, {", ".join(f"{x}::uhugeint as v{k}" for k, x in zip(lanes, begin, strict=True))} from un where n >= 32
  union all select s, x, n, pos + 32, v1, v2, v3, v4 from {stripe}),
tl as (
  (select s, x, n, pos, h, 0::uhugeint as u from {merged} union all select s, x, n, 0::bigint, {seed + P5}::uhugeint + n::uhugeint, 0::uhugeint from un where n < 32)
  union all select s, x, n, pos, h, u from {tail}),
hs as (select s, h::ubigint as h from {mixed}),
bt as (select row, k, sum(case when (h >> k::ubigint) & 1 = 1 then many else 0 end) * 2 > sum(many) as one from ct join hs using (s), range(64) r(k) group by row, k),
fp as (select d.row, doc_id, coalesce(f, 0::ubigint) as f from d left join (select row, sum(case when one then (1::hugeint << k::hugeint) else 0::hugeint end)::ubigint as f from bt group by row) using (row)),
cl as (select f, min(doc_id) as least from fp group by f),
ln as (select a.f as a, b.f as b from cl a join cl b on bit_count(xor(a.f, b.f)) <= {radius}),
rc as (select a, b from ln union select rc.a, ln.b from rc join ln on rc.b = ln.a),
cp as (select a as f, min(least) as component_id from rc join cl on rc.b = cl.f group by a)
select doc_id, lpad(lower(hex(f)), 16, '0') as fingerprint, component_id from fp join cp using (f)"""

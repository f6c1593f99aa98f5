"""The contracts of this subpackage that plain SQL can express, for comparison on small tables."""

from __future__ import annotations

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _with(names: dict[str, str], final: str, recursive: bool = False) -> str:
    body = ",\n".join(f"{name} as {'' if recursive else 'materialized '}({sql})" for name, sql in names.items())
    return f"with {'recursive ' if recursive else ''}{body}\n{final}"


def near_duplicates() -> str:
    """Sets of 5-word shingles, all pairs that share one, and what can be reached over links."""
    names = {
        "worded": f"select doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x20\\x09-\\x0D]+') as w from documents",
        "sets": """
            select doc_id, case when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')]
                   else list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' '))) end as s
            from worded""",
        "shingles": "select doc_id, unnest(s) as shingle from sets",
        "shared": """
            select a.doc_id as a, b.doc_id as b, count(*) as n from shingles a join shingles b on a.shingle = b.shingle and a.doc_id < b.doc_id
            group by 1, 2""",
        "links": """
            select a, b from shared join sets x on x.doc_id = a join sets y on y.doc_id = b
            where 100 * n >= 75 * (len(x.s) + len(y.s) - n)""",
        "edges": "select a, b from links union all select b, a from links",
        "reached": "select doc_id as a, doc_id as b from documents union select r.a, e.b from reached r join edges e on e.a = r.b",
        "least": "select a as doc_id, min(b) as component_id from reached group by a",
    }
    return _with(names, """
        select doc_id, cast(len(s) as bigint) as n_shingles, component_id, doc_id = component_id as kept from sets join least using (doc_id)""", True)


def suffix_dedup(length: int = 100) -> str:
    """Every string of bytes, where it starts first, and the bytes that later ones cover. Two hex digits are a byte."""
    names = {
        "bytes": "select doc_id, hex(encode(coalesce(text, ''))) as h, octet_length(encode(coalesce(text, ''))) as n from documents",
        "strings": f"select doc_id, i, substr(h, cast(2 * i + 1 as integer), {2 * length}) as s from (select doc_id, h, unnest(range(n - {length} + 1)) as i from bytes) u",
        "later": "select doc_id, i from (select doc_id, i, row_number() over (partition by s order by doc_id, i) as rank from strings) r where rank > 1",
        "gone": f"select distinct doc_id, unnest(range(i, i + {length})) as i from later",
        "runs": "select doc_id, count(*) as n_spans from (select doc_id, i, lag(i) over (partition by doc_id order by i) as before from gone) g where before is null or before < i - 1 group by doc_id",
        "places": "select doc_id, h, unnest(range(n)) as i from bytes",
        "rest": """
            select doc_id, string_agg(substr(h, cast(2 * i + 1 as integer), 2), '' order by i) as h
            from places p where not exists (select 1 from gone g where g.doc_id = p.doc_id and g.i = p.i) group by doc_id""",
        "removed": "select doc_id, count(*) as n_removed from gone group by doc_id",
    }
    return _with(names, """
        select doc_id, cast(n as bigint) as n_bytes, coalesce(n_removed, 0) as n_removed, coalesce(n_spans, 0) as n_spans,
               sha256(unhex(coalesce(rest.h, ''))) as kept_sha256
        from bytes left join removed using (doc_id) left join runs using (doc_id) left join rest using (doc_id)""")


def vector_codes(parts: int = 4, entries: int = 256, rounds: int = 4, scale: int = 1024) -> str:
    """Lloyd rounds over whole numbers, every distance in full."""
    names = {
        "clean": f"""
            select vec_id, label, list_transform(embedding, lambda c: cast(floor({scale} * c::double) as bigint)) as x from embeddings
            where embedding is not null and len(list_filter(embedding, lambda c: c is not null and isfinite(c))) = len(embedding)""",
        "numbered": "select *, row_number() over (order by vec_id nulls last, x) as r from clean",
        "cut": f"""
            select r, cast(p as integer) as p, x[p * (len(x) // {parts}) + 1 : (p + 1) * (len(x) // {parts})]::double[] as v from numbered, range({parts}) k(p)""",
        "book_0": f"select p, r - 1 as e, v from cut where r <= {entries}",
    }
    for t in range(rounds + 1):
        names[f"near_{t}"] = f"""
            select r, p, min(struct_pack(d := list_dot_product(c.v, c.v) - 2 * list_dot_product(c.v, b.v) + list_dot_product(b.v, b.v), e := b.e)) as m
            from cut c join book_{t} b using (p) group by r, p"""
        if t < rounds:
            names[f"mean_{t}"] = f"""
                select p, e, list(floor(s / n) order by i) as v
                from (select p, m.e as e, i, sum(c) as s, count(*) as n
                      from (select p, m, unnest(v) as c, generate_subscripts(v, 1) as i from near_{t} join cut using (r, p)) u group by all) s
                group by p, e"""
            names[f"book_{t + 1}"] = f"select p, e, coalesce(n.v, b.v) as v from book_{t} b left join mean_{t} n using (p, e)"
    names |= {
        "coded": f"select r, string_agg(printf('%02x', m.e), '' order by p) as code, cast(sum(m.d) as bigint) as error from near_{rounds} group by r",
        "flat": f"select p, e, unnest(v) as c, generate_subscripts(v, 1) as i from book_{rounds}",
        "digest": "select sha256(string_agg(cast(cast(c as bigint) as varchar), ',' order by p, e, i)) as h from flat",
    }
    return _with(names, """
        select vec_id, code, error, cast(sum(error) over (partition by label) as bigint) as label_error, (select h from digest) as codebooks_sha256
        from numbered join coded using (r)""")


def oracle_sql() -> dict[str, str]:
    return {"op2_minhash": near_duplicates(), "op8_suffix_dedup": suffix_dedup(), "op13_vector_codes": vector_codes()}

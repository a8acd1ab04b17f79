"""SQL for operators 11 to 13, as plain as can be: all pairs where the operators search."""

from __future__ import annotations

PARTS, ENTRIES, ROUNDS = 4, 256, 4


def vector_codes_sql() -> str:
    """Every part against every entry, in doubles that hold whole numbers."""
    assigned = """assigned{n} as materialized (
            select no, p, v, k - 1 as k, d from (
                select part.no, part.p, part.v, book.k, list_dot_product(part.v, part.v) - 2 * list_dot_product(part.v, book.v) + list_dot_product(book.v, book.v) as d,
                       row_number() over (partition by part.no, part.p order by d, book.k) as place
                from part join book{n} as book using (p)) where place = 1)"""
    updated = """sums{n} as (select p, k + 1 as k, j, floor(sum(x) / count(*)) as x
                   from (select p, k, unnest(v) as x, generate_subscripts(v, 1) as j from assigned{b}) group by all),
        made{n} as (select p, k, list(x order by j) as v from sums{n} group by p, k),
        book{n} as materialized (select p, k, coalesce(made{n}.v, old.v) as v from book{b} as old left join made{n} using (p, k))"""
    steps = [assigned.format(n=0)]
    for n in range(1, ROUNDS + 1):
        steps += [updated.format(n=n, b=n - 1), assigned.format(n=n)]
    return f"""
        with kept as materialized (
            select row_number() over (order by vec_id nulls last, embedding) as no, vec_id, label,
                   list_transform(embedding, lambda x: floor(1024 * x::double)) as v
            from embeddings where embedding is not null and list_bool_and(list_transform(embedding, lambda x: x is not null and isfinite(x)))),
        part as materialized (
            select no, p, v[(p * (len(v) // {PARTS}) + 1):((p + 1) * (len(v) // {PARTS}))] as v from kept, range({PARTS}) as r(p)),
        book0 as materialized (select p, no as k, v from part where no <= {ENTRIES}),
        {", ".join(steps)},
        coded as (select no, string_agg(printf('%02x', k::int), '' order by p) as code, sum(d)::bigint as error from assigned{ROUNDS} group by no),
        book as (select sha256(string_agg(x::bigint::varchar, ',' order by p, k, j)) as codebooks_sha256
                 from (select p, k, unnest(v) as x, generate_subscripts(v, 1) as j from book{ROUNDS}))
        select vec_id, code, error, sum(error) over (partition by label)::bigint as label_error, codebooks_sha256
        from kept join coded using (no), book"""


def spelling_sql() -> str:
    """CRC-32 byte by byte with the polynomial's table; near words by equal leftovers after leaving one letter out."""
    step = "xor(c >> 1, case when c & 1 = 1 then 3988292384 else 0 end)"
    return f"""
        with recursive bits(b, c, i) as (
            select b, b, 0 from range(256) as r(b) union all select b, {step}, i + 1 from bits where i < 8),
        crc as (select list(c order by b) as t from bits where i = 8),
        run as (select coalesce(doc_id::varchar, '') as id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-zÀ-ÿ]{{6,}}')) as w from documents),
        unit as materialized (select id, w, count(*) as n from run group by all),
        byte as (select id, w, n, list_transform(range(1, octet_length(encode(id || ':' || w)) + 1),
                        lambda i: ('0x' || substr(hex(encode(id || ':' || w)), 2 * i - 1, 2))::bigint) as bytes from unit),
        hashed as (select w, n, xor(4294967295, list_reduce(list_prepend(4294967295::bigint, bytes),
                          lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]))) as h from byte, crc),
        word as materialized (
            select w, sum(n)::bigint as n from (
                select case when h % 199 = 0 then substr(w, 1, (h % length(w))::int) || substr(w, (h % length(w))::int + 2) else w end as w, n from hashed)
            where length(w) >= 6 group by w having sum(n) >= 5),
        left_out as (select w, n, i, substr(w, 1, i - 1) || substr(w, i + 1) as x from (select w, n, unnest(range(1, length(w) + 1)) as i from word)),
        pair as materialized (
            select a.w as a, b.w as b from left_out a join left_out b on a.x = b.x and a.i = b.i and a.w <> b.w
            union select a.w, b.w from left_out a join word b on a.x = b.w
            union select b.w, a.w from left_out a join word b on a.x = b.w),
        best as (select a as w, count(*) as n_near, first(b order by word.n desc, encode(b)) as form, max(word.n) as form_n from pair join word on word.w = b group by a),
        formed as materialized (
            select word.w, word.n, coalesce(n_near, 0) as n_near, case when form_n >= 5 * word.n then form end as form, case when form_n >= 5 * word.n then form_n end as form_n
            from word left join best using (w)),
        path(w, root) as (select w, w from formed union select path.w, formed.form from path join formed on formed.w = path.root where formed.form is not null)
        select w as word, form, path.root, n, n_near, form_n from formed join path using (w)
        where path.root in (select w from formed where form is null)"""


def contamination_sql(size: int = 10) -> str:
    """Windows of every length that items have, joined as strings with the documents' runs of as many words."""
    found = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
    return f"""
        with doc as materialized (select row_number() over () as no, doc_id, {found} as words from documents),
        item as (select coalesce(item_id::varchar, '') as item_id, {found} as words from benchmark),
        windows as materialized (
            select distinct item_id, least({size}, len(words)) as k, array_to_string(words[i:(i + least({size}, len(words)) - 1)], ' ') as x
            from item, lateral (select unnest(range(1, greatest(1, len(words) - {size - 1}) + 1)) as i) where len(words) > 0),
        runs as (select no, i, k, array_to_string(words[i:(i + k - 1)], ' ') as x
                 from doc, (select distinct k from windows), lateral (select unnest(range(1, len(words) - k + 2)) as i)),
        met as materialized (select no, i, k, item_id from runs join windows using (k, x)),
        hit as (select no, count(distinct j) as n_hit from (select no, unnest(range(i, i + k)) as j from met) group by no),
        owned as (select no, count(*) as n_items, string_agg(item_id, ',' order by encode(item_id)) as ids from (select distinct no, item_id from met) group by no)
        select doc_id, len(words)::bigint as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
               sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
        from doc left join hit using (no) left join owned using (no)"""

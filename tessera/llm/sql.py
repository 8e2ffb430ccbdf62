"""SQL for an independent engine that gives the rows of queries, of those that take more than a few lines."""

from __future__ import annotations

#: (id, component) of the least id that links (a, b) reach, for ids that have links; links are given both ways.
COMPONENTS = """reach(id, other) as (select a, b from links union select r.id, l.b from reach r join links l on l.a = r.other),
    components as (select id, least(id, min(other)) as component from reach group by id)"""

LE32 = "substr(printf('%08x', {n}), 7, 2) || substr(printf('%08x', {n}), 5, 2) || substr(printf('%08x', {n}), 3, 2) || substr(printf('%08x', {n}), 1, 2)"

#: Payloads as hexadecimal text; the file is a one-channel 8-bit PCM file at 8,000 samples a second.
OP3_SQL = f"""
    with sized as (select row_number() over () as row, doc_id, hex(encode(coalesce(text, ''))) as h, octet_length(encode(coalesce(text, '')))::bigint as n_bytes from documents),
    padded as (select *, greatest(64, (n_bytes + 63) // 64 * 64)::bigint as n from sized),
    payloads as materialized (select row, doc_id, n_bytes, n, rpad(h, (2 * n)::int, '0') as p from padded),
    files as (select *, '52494646' || {LE32.format(n='36 + n')} || '57415645666d7420' || '10000000' || '01000100' || '401f0000401f0000' || '01000800' || '64617461' || {LE32.format(n='n')} || p as f from payloads),
    polynomial as (select list_transform(range(0, 256), lambda k: list_reduce(list_concat([k::bigint], range(0, 8)), lambda c, i: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end)) as t),
    tails as (select row, list_transform(range(0, 64), lambda i: ('0x' || substr(p, (2 * (n - 64 + i) + 1)::int, 2))::bigint) as b from payloads),
    crcs as (select row, xor(list_reduce(list_concat([4294967295::bigint], b), lambda c, v: xor(c >> 8, t[(xor(c, v) & 255) + 1])), 4294967295) as crc from tails, polynomial),
    samples as (select row, i, ('0x' || substr(p, (2 * i + 1)::int, 2))::bigint - 128 as x from (select row, p, unnest(range(0, n)) as i from payloads)),
    features as (select row, sum(x)::double as s, sum(x * x)::double as q, count(*)::double as m, count(*) filter (where turned) as crossings
        from (select *, (x < 0) <> lag(x < 0) over (partition by row order by i) as turned from samples) group by row)
    select doc_id, n_bytes, n as payload_bytes, sha256(unhex(p)) as payload_sha256, crc::bigint as tail_crc32, 44 + n as media_bytes, sha256(unhex(f)) as media_sha256,
        'mean=' || printf('%.4f', s / m) || ';rms=' || printf('%.4f', sqrt(q / m)) || ';crossings=' || crossings as feature
    from files join crcs using (row) join features using (row)"""

OP6_SQL = f"""
    with recursive words as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') as w from documents),
    runs as (select distinct doc_id, array_to_string(w[i : i + 4], ' ') as s from (select doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) as i from words where len(w) > 0)),
    shingles as (select doc_id, md5_number(s) as s from runs),
    sizes as (select doc_id, count(*) as n from shingles group by doc_id),
    sets as (select doc_id, md5(string_agg(s::varchar, ',' order by s)) as k from shingles group by doc_id),
    classes as (select k, min(doc_id) as rep from sets group by k),
    few as (select s.* from shingles s join classes c on c.rep = s.doc_id),
    shared as (select a.doc_id as a, b.doc_id as b, count(*) as n from few a join few b on a.s = b.s and a.doc_id <> b.doc_id group by a.doc_id, b.doc_id),
    links as (select a, b from shared join sizes x on x.doc_id = a join sizes y on y.doc_id = b where 100 * shared.n >= 75 * (x.n + y.n - shared.n)),
    {COMPONENTS}
    select d.doc_id, coalesce(z.n, 0)::bigint as n_shingles, coalesce(c.component, k.rep, d.doc_id) as component_id, coalesce(c.component, k.rep, d.doc_id) = d.doc_id as kept
    from documents d left join sizes z on z.doc_id = d.doc_id left join sets s on s.doc_id = d.doc_id left join classes k on k.k = s.k left join components c on c.id = k.rep"""

OP9_SQL = """
    with raw as (select row_number() over () as row, doc_id, hex(encode(coalesce(text, ''))) as h, octet_length(encode(coalesce(text, '')))::bigint as n from documents),
    parts as (select row, base, substr(h, (2 * base + 1)::int, 2398) as p from (select row, h, unnest(range(0, n - 199, 1000)) as base from raw where n >= 200)),
    windows as (select row, base + j as i, hash(substr(p, (2 * j + 1)::int, 400)) as w from (select *, unnest(range(0, least(1000, length(p) // 2 - 199))) as j from parts)),
    repeated as (select row, i from windows join (select w from windows group by w having count(*) > 1) using (w)),
    marked as (select *, case when i <= lag(i) over (partition by row order by i) + 200 then 0 else 1 end as new from repeated),
    numbered as (select *, sum(new) over (partition by row order by i) as span from marked),
    spans as (select row, span, min(i) as a, max(i) + 200 as b from numbered group by row, span),
    pieces as (select row, b as a, lead(a) over (partition by row order by a) as b from spans),
    heads as (select row, 0::bigint as a, min(a) as b from spans group by row),
    kept as (select row, string_agg(substr(h, (2 * a + 1)::int, (2 * (coalesce(b, n) - a))::int), '' order by a) as k from (from pieces union all from heads) join raw using (row) group by row),
    sums as (select row, sum(b - a)::bigint as n_removed, count(*) as n_spans from spans group by row)
    select doc_id, n as n_bytes, coalesce(n_removed, 0)::bigint as n_removed, coalesce(n_spans, 0)::bigint as n_spans, sha256(unhex(coalesce(k, h))) as kept_sha256
    from raw left join sums using (row) left join kept using (row)"""

OP10_SQL = f"""
    with recursive usable as (select vec_id, label, embedding::double[] as v from embeddings where label is not null and embedding is not null
        and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0),
    links as (select x.vec_id as a, y.vec_id as b from usable x join usable y on x.label = y.label and x.vec_id <> y.vec_id and len(x.v) = len(y.v) where list_cosine_similarity(x.v, y.v) >= 0.98),
    degrees as (select a, count(*) as n from links group by a),
    {COMPONENTS}
    select vec_id, coalesce(n, 0)::bigint as n_links, coalesce(component, vec_id) as component_id, coalesce(component, vec_id) = vec_id as kept
    from embeddings left join degrees on a = vec_id left join components on id = vec_id"""

LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP11_SQL = f"""
    with docs as (select row_number() over () as doc, coalesce(lang, '') as lang, coalesce(source, '') as source, regexp_extract_all({LOWERED}, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') as w from documents),
    uses as (select doc, lang, source, unnest(w) as term from docs),
    kept as (select lang, term from uses group by lang, term having count(distinct doc) >= 30),
    counts as (select u.lang, u.source, u.term, count(*) as n from uses u join kept k on k.lang = u.lang and k.term = u.term group by u.lang, u.source, u.term),
    totals as (select lang, source, sum(n) as total from counts group by lang, source),
    langs as (select l.lang, count(k.term) as v from (select distinct lang from docs) l left join kept k on k.lang = l.lang group by l.lang),
    groups as (select g.lang, g.source, l.v, coalesce(t.total, 0) as total from (select distinct lang, source from docs) g join langs l on l.lang = g.lang left join totals t on t.lang = g.lang and t.source = g.source),
    shares as (select g.lang, g.source, k.term, coalesce(c.n, 0) as n, (1 + (1000000000::hugeint * (coalesce(c.n, 0) + 5)) // (g.total + 5 * g.v))::bigint as p
        from groups g join kept k on k.lang = g.lang left join counts c on c.lang = g.lang and c.source = g.source and c.term = k.term),
    together as (select lang, term, sum(n) as n from counts group by lang, term),
    alls as (select lang, sum(n) as total, count(*) as v from together group by lang),
    means as (select t.lang, t.term, (1 + (1000000000::hugeint * (t.n + 5)) // (a.total + 5 * a.v))::bigint as q from together t join alls a on a.lang = t.lang),
    sums as (select x.lang, x.source, y.source as item, sum(abs(x.p - y.p)) as value from shares x join shares y on y.lang = x.lang and y.term = x.term and y.source <> x.source group by x.lang, x.source, y.source),
    found as (select g.lang, g.source, 'pair' as part, h.source as item, coalesce(s.value, 0)::bigint as value
            from groups g join groups h on h.lang = g.lang and h.source <> g.source left join sums s on s.lang = g.lang and s.source = g.source and s.item = h.source
        union all select s.lang, s.source, 'term', s.term, s.p - q from shares s join means m on m.lang = s.lang and m.term = s.term where s.n > 0 and p > q),
    ranked as (select *, row_number() over (partition by lang, source, part order by value desc, encode(item)) as rank from found)
    select lang, source, part, item, value, rank::int as rank from ranked where part = 'pair' or rank <= 50"""

OP12_SQL = """
    with named as (select doc_id, sha256(regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', ' ', 'g')) as s from documents),
    groups as (select s, min(doc_id) as keep_id, count(*) as n from named group by s)
    select doc_id, keep_id, n::bigint as group_size, doc_id = keep_id as kept, named.s as text_sha256 from named join groups on groups.s = named.s"""

OP13_SQL = f"""
    with texts as (select coalesce(lang, 'und') as lang, unnest(regexp_split_to_array({LOWERED}, '[.,;:!?\\x0A-\\x0D]')) as piece from documents),
    worded as (select lang, regexp_extract_all(piece, '[^\\x20\\x09]+') as w from texts),
    starts as (select lang, w, unnest(range(1, len(w) + 1)) as i from worded),
    grams as (select lang, w, i, unnest(range(1, least(5, len(w) - i + 1) + 1)) as k from starts),
    f as (select lang, k, array_to_string(w[i : i + k - 1], ' ') as phrase, count(*) as a from grams group by all),
    totals as (select lang, sum(a) as n from f where k = 1 group by lang),
    often as (select * from f where a >= 100),
    candidates as (select *, string_split(phrase, ' ') as w from often where k > 1),
    cuts as (select lang, phrase, a, cut, array_to_string(w[1 : cut], ' ') as one, array_to_string(w[cut + 1 : k], ' ') as two from (select *, unnest(range(1, k)) as cut from candidates)),
    scores as (select c.lang, c.phrase, c.a, c.cut, x.a as l, y.a as r, n, ((1000::hugeint * c.a * n) // (x.a::hugeint * y.a))::bigint as score
        from cuts c join often x on x.lang = c.lang and x.phrase = c.one join often y on y.lang = c.lang and y.phrase = c.two join totals t on t.lang = c.lang),
    best as (select * from (select *, row_number() over (partition by lang, phrase order by score, cut) as turn from scores) where turn = 1),
    inside as (select lang, a, array_to_string(w[i : j], ' ') as phrase from (select *, unnest(range(i + 1, k + 1)) as j from (select *, unnest(range(1, k)) as i from candidates)) where j - i + 1 < k),
    longer as (select lang, phrase, max(a) as most from inside group by lang, phrase),
    left_ as (select b.* from best b left join longer o on o.lang = b.lang and o.phrase = b.phrase where most is null or 100 * most < 100 * b.a),
    ranked as (select *, row_number() over (partition by lang order by score desc, a desc, encode(phrase)) as rank from left_)
    select lang, rank, phrase, a::bigint as a, l::bigint as l, r::bigint as r, n::bigint as n, score from ranked where rank <= 2000"""

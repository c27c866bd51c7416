"""DuckDB SQL for the queries that SQL can express, written without the package's own constants."""

SPACE = r"[\x20\x09-\x0D]+"
ENDS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
BITS = "flatten(list_transform(string_split({}, ''), lambda c: list_transform(range(8), lambda b: (ascii(c) >> b::integer) & 1)))"
"""The bits of an ASCII string, the lowest of each byte first."""
CRC32 = (
    "xor(list_reduce(list_concat([4294967295::ubigint], " + BITS + "::ubigint[]), "
    "lambda crc, bit: xor(crc >> 1, xor(crc, bit) % 2 * 3988292384)), 4294967295::ubigint)"
)
LOWERED = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"



def _edit(audit: str, cost: str, letter: str) -> str:
    """An audit, written behind its cost in six digits, after one more edit: least() then compares cost, then audit."""
    return f"lpad((left({audit}, 6)::int + {cost})::varchar, 6, '0') || substr({audit}, 7) || '{letter}'"


def _inserted(states: str) -> str:
    """SQL of the four states' best audits [start, s, u, a] after inserts."""
    first = f"list_transform([{states}], lambda v: [v[1], v[2], least(v[3], {_edit('least(v[1], v[2], v[4])', '3', 'I')}), v[4]])[1]"
    second = f"list_transform([{first}], lambda v: [v[1], v[2], v[3], least(v[4], {_edit('v[3]', '3', 'I')})])[1]"
    return f"list_transform([{second}], lambda v: [v[1], v[2], least(v[3], {_edit('v[4]', '3', 'I')}), v[4]])[1]"


def _consumed() -> str:
    """SQL of the states after the row x = [initial, fault]."""
    more, stays = "(case when x[2] = 'truncated' then 3 else 0 end)", "x[2] in ('truncated', '')"
    opened, answered = "least(a[1], a[2], a[4])", "a[3]"
    return f"""[{_edit('a[1]', '4', 'D')},
        least({_edit('a[2]', '4', 'D')}, case when {stays} and x[1] = 's' then {_edit('a[1]', more, 'K')} end),
        least({_edit('a[3]', '4', 'D')}, case when {stays} then {_edit(opened, '3 + ' + more, 'R')} end,
              case when {stays} and x[1] = 'u' then {_edit(opened, more, 'K')} end),
        least({_edit('a[4]', '4', 'D')}, case when {stays} then {_edit(answered, '3 + ' + more, 'R')} end,
              case when {stays} and x[1] = 'a' then {_edit(answered, more, 'K')} end)]"""


NUMBERS = r"regexp_replace({}, '(^|[^\pL\pN])[0-9]+($|[^\pL\pN])', '\1' || chr(1) || '\2', 'g')"
"""Numbers that are no part of a word, marked. A mark takes the characters beside it, so it takes two rounds for all."""

ORACLE = {
    "op1_quality_rules": rf"""
        with d as (select row_number() over () r, doc_id, coalesce(source, '') host, coalesce(text, '') t from documents),
        w as (select r, regexp_extract_all(t, '[^\x20\x09-\x0D]+') w, string_split(t, chr(10)) l from d),
        s as (select r, w, list_filter(l, lambda x: trim(x, {ENDS}) <> '') l from w),
        g as (select r, unnest(range(1, len(w) - 1)) pos, w from s where len(w) >= 3),
        n as (select r, pos, count(*) over (partition by r, w[pos] || ' ' || w[pos + 1] || ' ' || w[pos + 2]) c from g),
        rep as (select r, count(distinct p) c from (select r, unnest([pos, pos + 1, pos + 2]) p from n where c > 1) group by r),
        ln as (select distinct host, t, unnest(string_split(t, chr(10))) line, generate_subscripts(string_split(t, chr(10)), 1) pos from d),
        k as (select host, t, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) n, trim(replace({NUMBERS.format(NUMBERS.format(LOWERED.format("line")))}, chr(1), '0'), {ENDS}) k from ln),
        f as (select host, k from k where n > 0 group by all having count(distinct t) >= 10),
        fw as (select host, t, sum(n) n from k join f using (host, k) group by all),
        a as (select d.doc_id, len(s.w) n_words, length(array_to_string(s.w, '')) word_chars,
              length(d.t) - length(translate(d.t, '#*$%&|<>', '')) n_symbols,
              len(s.l) - len(list_distinct(s.l)) n_dup_lines, coalesce(rep.c, 0) n_repeat_words, coalesce(fw.n, 0)::bigint fr
              from d join s using (r) left join rep using (r) left join fw using (host, t))
        select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, fr n_frequent_words,
        n_words < 50 or 100 * n_repeat_words > 50 * n_words base_failed,
        not (n_words < 50 or 100 * n_repeat_words > 50 * n_words) and (n_words - fr) * 100 >= n_words * 30 kept from a
    """,
    "op4_decontaminate": rf"""
        with w as (select row_number() over () r, doc_id,
              regexp_extract_all({LOWERED.format("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w from documents),
        b as (select item_id::varchar item, regexp_extract_all({LOWERED.format("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w from benchmark),
        bw as (select distinct item, n, array_to_string(w[pos:pos + n - 1], ' ') g
              from (select item, w, least(10, len(w)) n, unnest(range(1, len(w) - least(10, len(w)) + 2)) pos from b where len(w) > 0)),
        dw as (select r, n, pos, array_to_string(w[pos:pos + n - 1], ' ') g
              from (select r, w, n, unnest(range(1, len(w) - n + 2)) pos from w, (select distinct n from bw) where len(w) >= n)),
        hit as (select r, n, pos, item from dw join bw using (n, g)),
        spans as (select r, count(distinct p) c from (select r, unnest(range(pos, pos + n)) p from (select distinct r, n, pos from hit)) group by r),
        items as (select r, list_sort(list_distinct(list(item))) i from hit group by r)
        select doc_id, len(w) n_words, coalesce(spans.c, 0) n_hit, coalesce(len(i), 0) n_items,
        sha256(coalesce(array_to_string(i, ','), '')) items_sha256, coalesce(spans.c, 0) > 0 contaminated
        from w left join spans using (r) left join items using (r)
    """,
    "op5_chat_format": r"""
        with m as (select conv_id, turn, coalesce(role, '') role, coalesce(text, '') t from conversations
              union all select -7, unnest([0, 1]), unnest(['user', 'assistant']), '</s>[INST] ok [/INST]'),
        e as (select *, replace(replace(replace(replace(replace(t, '\', '\\'), '<s>', '<\s>'), '</s>', '<\/s>'), '[INST]', '[\INST]'), '[/INST]', '[\/INST]') x,
              replace(replace(replace(replace(replace(role, '\', '\\'), '<s>', '<\s>'), '</s>', '<\/s>'), '[INST]', '[\INST]'), '[/INST]', '[\/INST]') y from m),
        a as (select conv_id, count(*) n_turns, string_agg(role || chr(10) || t || chr(10), '' order by turn, role, t) turns,
              coalesce(string_agg(t, '' order by turn, role, t) filter (role = 'assistant'), '') loss,
              sum(length(x) + length(y) + length('<s>[INST]  [/INST]</s>'))::bigint formatted_chars from e group by conv_id)
        select conv_id, n_turns, sha256(turns) turns_sha256, length(loss) loss_chars, sha256(loss) loss_sha256, formatted_chars from a
    """,
    "op6_line_dedup": rf"""
        with l as (select r, doc_id, unnest(l) line, generate_subscripts(l, 1) pos
              from (select row_number() over () r, doc_id, string_split(coalesce(text, ''), chr(10)) l from documents)),
        k as (select *, {LOWERED.format(f"trim(line, {ENDS})")} k from l),
        f as (select k from k where length(k) >= 1 group by k having count(distinct r) >= 10)
        select any_value(doc_id) doc_id, count(*) n_lines, count(*) - count(*) filter (f.k is null) n_dropped,
        sha256(coalesce(string_agg(line, chr(10) order by pos) filter (f.k is null), '')) kept_sha256
        from k left join f using (k) group by r
    """,
    "op11_prefix_trie": rf"""
        with m as (select conv_id c, coalesce(role, '') r, coalesce(text, '') t, turn from conversations where conv_id is not null),
        own as (select c, list(struct_pack(r := r, t := t) order by turn nulls first, r, t) l from m group by c),
        h as (select c, l, (({CRC32.format("c::varchar")}) % 4)::bigint h from own),
        s as (select h.c, list_concat(coalesce(b.l[1:h], []), h.l[h + 1:]) l from h left join own b on b.c = h.c - h.c % {20}),
        p as (select c, d, l[1:d] p, len(l) = d is_end,
              case when d > 0 then len(regexp_extract_all(l[d].t, '[^\x20\x09-\x0D]+')) else 0 end w
              from (select *, unnest(range(0, len(l) + 1)) d from s)),
        n as (select p, any_value(d) d, min(c) c, count(*) n, any_value(w) w,
              sha256(coalesce(string_agg(c::varchar, ',' order by c) filter (is_end), '')) e from p group by p),
        k as (select n.*, (select count(*) from n x where x.d = n.d + 1 and x.p[1:n.d] = n.p) kids from n)
        select k.c conv_id, k.d depth, u.c parent_conv_id, k.n n_convs, k.kids n_children, sub.leaves n_leaves, sub.saved saved_tokens, k.e ends_sha256
        from k left join n u on u.d = k.d - 1 and u.p = k.p[1:k.d - 1]
        join (select a.p, count(*) filter (x.kids = 0) leaves, sum((x.n - 1) * x.w)::bigint saved
              from k a join k x on x.d >= a.d and x.p[1:a.d] = a.p group by a.p) sub on sub.p = k.p
    """,
    "op12_cover_tree": """
        with recursive v as (select vec_id, embedding::double[] e from embeddings where embedding is not null and len(embedding) > 0
              and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0),
        l as (select a.vec_id a, b.vec_id b from v a join v b on a.vec_id <> b.vec_id and list_cosine_similarity(a.e, b.e) >= 0.9),
        r as (select a n, a m from l union select r.n, l.b from r join l on r.m = l.a),
        c as (select n, min(m) m from r group by n),
        k as (select a, count(*) k from l group by a)
        select vec_id, coalesce(k, 0) n_links, coalesce(m, vec_id) component_id, coalesce(m, vec_id) = vec_id kept
        from embeddings left join c on n = vec_id left join k on a = vec_id
    """,
    "op13_structure_repair": rf"""
        with o as (select conv_id, turn, coalesce(role, ' ') r, coalesce(text, ' ') t,
              coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' ') i from conversations),
        z as (select *, ({CRC32.format("i")}) % 20 h from o),
        m as (select conv_id, turn, case when h = 4 then 'user' else r end r,
              case when h = 1 then '' when h = 2 then regexp_replace(t, '[.!?]', '', 'g') else t end t
              from (select *, unnest(range(case when h = 3 then 2 else 1 end)) from z where h <> 0)),
        n as (select *, row_number() over (partition by conv_id order by turn nulls first, r, t) n, trim(t, {ENDS}) b, left(r, 1) l from m),
        d as (select *, row_number() over (partition by conv_id, r, t order by n) > 1 again, lag(l) over (partition by conv_id order by n) || l pair from n),
        f as (select *, case when b = '' then 'blank' when again then 'duplicate' when right(b, 1) not in ('.', '!', '?') then 'truncated' else '' end fault from d),
        c as (select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) gaps, count(*) filter (fault = 'blank') blank,
              count(*) filter (fault = 'duplicate') duplicate, count(*) filter (fault = 'truncated') truncated,
              count(*) filter (pair not in ('su', 'ua', 'au')) illegal, list([l, fault] order by n) x, list([r, t] order by n) said from f group by conv_id),
        s as (select *, list_reduce(list_concat([{_inserted("['000000', null, null, null]")}], x), lambda a, x: {_inserted(_consumed())}) v from c),
        a as (select * exclude (v, x), left(least(v[1], v[4]), 6)::bigint cost, substr(least(v[1], v[4]), 7) audit from s),
        e as (select conv_id, said, x, audit, k, audit[k] edit,
              length(replace(left(audit, k), 'I', '')) row, length(replace(left(audit, k), 'D', '')) nth
              from (select a.*, c.x, unnest(range(1, length(audit) + 1)) k from a join c on a.conv_id is not distinct from c.conv_id)),
        w as (select *, nth - (first_value(edit = 'K' and x[row][1] = 's') over (partition by conv_id order by k))::int u from e where edit <> 'D'),
        p as (select conv_id, sha256(string_agg(case when edit = 'K' then said[row][1] when u % 2 = 1 then 'user' else 'assistant' end
              || ':' || case when edit = 'I' then '' else said[row][2] end, chr(10) order by k)) q from w group by conv_id)
        select g.conv_id, coalesce(gaps, 0) gaps, coalesce(blank, 0) blank, coalesce(duplicate, 0) duplicate, coalesce(truncated, 0) truncated,
        coalesce(illegal, 0) illegal, coalesce(cost, 0) as "cost", coalesce(audit, '') audit, coalesce(q, sha256('')) repaired_sha256
        from (select distinct conv_id from conversations) g left join a on a.conv_id is not distinct from g.conv_id
        left join p on p.conv_id is not distinct from g.conv_id
    """,
}

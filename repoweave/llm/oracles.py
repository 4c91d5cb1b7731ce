"""DuckDB statements for the dealt operators that SQL can express. All constants are written out here."""

WORD = r"[^\x20\x09-\x0D]+"


# Sizes and targets of the mix of sources: limits are reached by rising ratio of limit to weight, the rest shares a level.
SOURCE_TARGETS = f"""with sized as (
  select doc_id, source, coalesce(len(regexp_extract_all(text, '{WORD}')), 0)::bigint as size from documents),
sizes as (select source, sum(size)::bigint as source_size from sized group by source),
ranked as (
  select *, 1 + (row_number() over (order by encode(source) nulls last) - 1) % 3 as weight, 3 * source_size as lim
  from sizes),
before as (
  select *, sum(source_size) over () as total, sum(weight) over () as weights,
         coalesce(sum(lim) over earlier, 0) as lim_before, coalesce(sum(weight) over earlier, 0) as weight_before
  from ranked
  window earlier as (order by lim / weight, encode(source) nulls last rows between unbounded preceding and 1 preceding)),
level as (select max((total - lim_before)::double / (weights - weight_before)::double) as level from before)
select doc_id, source, size, source_size, least(lim::double, level * weight) as target
from sized join before using (source), level"""

# Documents that link share a shingle, so pairs come from a join on shingles; components from the closure over links.
SHINGLE_JOIN = f"""with recursive words as (
  select doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD}') as w from documents),
shingles as (
  select distinct doc_id, array_to_string(w[i : i + 2], ' ') as shingle
  from (select doc_id, w, unnest(range(1, greatest(len(w) - 1, 2))) as i from words where len(w) > 0)),
sizes as (select doc_id, count(*) as n from shingles group by doc_id),
shared as (
  select a.doc_id as x, b.doc_id as y, count(*) as hits
  from shingles a join shingles b on a.shingle = b.shingle and a.doc_id < b.doc_id group by 1, 2),
links as (
  select x, y from shared join sizes a on a.doc_id = x join sizes b on b.doc_id = y
  where 100 * hits >= 90 * (a.n + b.n - hits)),
ways as (select x, y from links union all select y, x from links),
reach as (select x, y from ways union select r.x, w.y from reach r join ways w on w.x = r.y)
select d.doc_id, coalesce(s.n, 0)::bigint as n_shingles,
       least(d.doc_id, (select min(y) from reach r where r.x = d.doc_id)) as component_id
from documents d left join sizes s on s.doc_id = d.doc_id"""


def _crc32(text: str) -> str:
    """CRC-32 of a VARCHAR of ASCII characters, bit by bit: a byte is put in, then eight shifts (-1) follow."""
    steps = f"flatten(list_transform(string_split({text}, ''), lambda c: [ord(c)::bigint, -1, -1, -1, -1, -1, -1, -1, -1]))"
    step = "case when x >= 0 then xor(acc, x) else xor(acc >> 1, (acc & 1) * 3988292384) end"
    return f"xor(list_reduce(list_prepend(4294967295::bigint, {steps}), lambda acc, x: {step}), 4294967295)"


# Periods from 2^k to 2^(k+1) - 1 are found for k below this; the longest text may have 2^(PERIOD_BITS + 2) words.
PERIOD_BITS = 22


def _periodic_runs() -> str:
    """A run of smallest period q holds windows of L = 2^(k+1) words with q <= L <= 2q, each of which comes again exactly q
    words on and not earlier. Windows are named by their first place, from the names of their halves."""
    parts = [
        f"""docs as (select row_number() over () as row_id, doc_id,
       regexp_extract_all(coalesce(text, ''), '{WORD}') as w, {_crc32('doc_id::varchar')} as h from documents)""",
        """plan as (select *, h // 10 as g, len(w) as n, case when len(w) > 0 then (h // 10) % len(w) end as a from docs)""",
        """planted as (select row_id, doc_id, n, case when h % 10 = 0 and n > 0 then
       list_transform(range(n), lambda i: w[1 + case when i >= a then a + (i - a) % (1 + (n - a) // (3 + g % 8)) else i end])
       else w end as w from plan)""",
        "places as (select row_id, unnest(w) as word, unnest(range(n)) as i from planted)",
        "names0 as materialized (select row_id, i, min(i) over (partition by row_id, word) as x from places)",
    ]
    for k in range(PERIOD_BITS):
        parts.append(
            f"""halves{k} as (select row_id, i, x, lead(x, {1 << k}) over (partition by row_id order by i) as y from names{k})"""
        )
        parts.append(
            f"""names{k + 1} as materialized (
  select row_id, i, min(i) over (partition by row_id, x, y) as x,
         lead(i) over (partition by row_id, x, y order by i) - i as d from halves{k} where y is not null)"""
        )
        parts.append(
            f"""runs{k} as (
  select row_id, min(i) as start, max(i) - min(i) + {2 << k} + d as length, d as period
  from (select row_id, i, d, i - row_number() over (partition by row_id, d order by i) as island
        from names{k + 1} where d >= {1 << k} and d < {2 << k})
  group by row_id, d, island having max(i) - min(i) + {2 << k} + d >= greatest(6, 4 * d))"""
        )
    every = " union all ".join(f"select * from runs{k}" for k in range(PERIOD_BITS))
    return f"""with {', '.join(parts)},
runs as materialized ({every}),
of_row as (
  select row_id, count(*) as n_runs, sha256(string_agg(concat(start, ',', length, ',', period, chr(10)), ''
           order by start, period)) as runs_sha256,
         first({{'s': start, 'l': length, 'p': period}} order by length desc, start, period) as best
  from runs group by row_id),
dropped as (select distinct row_id, unnest(range(start + period, start + length)) as i from runs),
kept as (
  select row_id, string_agg(w[i + 1], ' ' order by i) as rest
  from (select p.row_id, p.w, unnest(range(n)) as i from planted p) anti join dropped using (row_id, i) group by row_id)
select doc_id, coalesce(n_runs, 0) as n_runs, best.s::bigint as start, best.l::bigint as length, best.p::bigint as period,
       (1000 * best.l // best.p)::bigint as exponent_milli, coalesce(runs_sha256, sha256('')) as runs_sha256,
       sha256(coalesce(rest, '')) as collapsed_sha256
from planted left join of_row using (row_id) left join kept using (row_id)"""


PERIODIC_RUNS = _periodic_runs()


COLLOCATIONS = r"""with pieces as (
  select row_number() over () as id, lang, unnest(string_split_regex(text, '[.,;:!?\x0A-\x0D]')) as piece
  from (select coalesce(lang, 'und') as lang,
               translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as text from documents)),
words as (select lang, regexp_extract_all(piece, '[^\x20\x09]+') as w from pieces),
totals as (select lang, sum(len(w)) as n from words group by lang),
counts as materialized (
  select lang, k, phrase, count(*) as f
  from (select lang, k, array_to_string(w[i : i + k - 1], ' ') as phrase
        from (select lang, w, k, unnest(range(1, len(w) - k + 2)) as i from words, range(1, 6) sizes(k) where len(w) >= k))
  group by lang, k, phrase having count(*) >= 100),
longer as (
  select lang, array_to_string(w[i : i + j - 1], ' ') as phrase, max(f) as f
  from (select lang, f, k, w, j, unnest(range(1, k - j + 2)) as i
        from (select lang, f, k, string_split(phrase, ' ') as w from counts where k > 2), range(2, 5) parts(j) where j < k)
  group by 1, 2),
candidates as (
  select c.lang, c.phrase, c.f as a, c.k as size, string_split(c.phrase, ' ') as w
  from counts c left join longer l on l.lang = c.lang and l.phrase = c.phrase
  where c.k > 1 and coalesce(100 * l.f >= 100 * c.f, false) = false),
cuts as (
  select lang, phrase, a, k, array_to_string(w[1 : k], ' ') as head, array_to_string(w[k + 1 : size], ' ') as rest
  from (select *, unnest(range(1, size)) as k from candidates)),
scored as (
  select c.lang, c.phrase, c.a, c.k, x.f as l, y.f as r, n,
         (1000::hugeint * c.a::hugeint * n::hugeint) // (x.f::hugeint * y.f::hugeint) as score
  from cuts c join counts x on x.lang = c.lang and x.phrase = c.head
       join counts y on y.lang = c.lang and y.phrase = c.rest join totals t on t.lang = c.lang),
lowest as (select * from scored qualify row_number() over (partition by lang, phrase order by score, k) = 1)
select lang, rank, phrase, a::bigint as a, l::bigint as l, r::bigint as r, n::bigint as n, score::bigint as score
from (select *, row_number() over (partition by lang order by score desc, a desc, encode(phrase)) as rank from lowest)
where rank <= 2000"""

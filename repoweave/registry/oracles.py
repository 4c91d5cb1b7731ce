"""DuckDB statements that compute the same rows as the queries, written against the plain tables."""

from __future__ import annotations

from repoweave.registry import fixtures as fx
from repoweave.registry.queries import (
    CUT, PAGE_ITEMS, PRESENT, ROW_LENGTH, SAMPLE, SEED, TOP, VOCAB,
)

# Fixed values, written out so that a wrong constant in the code under test shows.
REPO_MARK, FILE_MARK, END_MARK = "<repo_name>", "<file_sep>", "<|endoftext|>"
END_ID, FIRST_WORD_ID, IGNORED_LABEL = 256, 257, -100
SQL_PIECE = " ?[^ \\n\\r\\t]+|[ \\n\\r\\t]"
MIN_SIZE_KB = 100_000
WHITELIST = ["机器学习"]
BLACKLIST = [
    "mirror", "fork", "test", "example", "assignment", "homework",
    "tutorial", "course", "workshop", "bootcamp", "practice", "solution",
    "interview", "coding", "challenge", "template", "study", "education",
    "教程", "学习", "教育", "课程", "练习", "解决方案", "挑战", "作业", "测试", "示例",
    "教學", "學習", "教育", "課程", "練習", "解決方案", "挑戰", "作業", "測試", "示例",
    "チュートリアル", "学習", "教育", "コース", "演習", "解決", "チャレンジ", "課題", "テスト", "例",
    "튜토리얼", "학습", "교육", "코스", "연습", "해결", "도전", "과제", "테스트", "예제",
]

CODE = f"code_files as ({fx.CODE_FILES})"
NUMBERED = f"""{CODE},
numbered as (select *, cast(substr(repo_name, 4) as integer) as repo_ord from code_files)"""
JAVA = f"java_files as ({fx.JAVA_FILES})"
NESTED = f"nested_files as ({fx.NESTED_FILES})"
BOTH = f"{CODE}, {JAVA}, both_files as (select * from code_files union all select * from java_files)"
ITEMS = f"items as ({fx.SEARCH_ITEMS})"
PACKAGES = f"packages as ({fx.PACKAGES})"

PY_PATTERN = r"(?m)^\s*(?:import\s+([\w\.]+)|from\s+([\w\.]+)\s+import)"
JAVA_PATTERN = r"(?m)^import\s+([\w\.]+);"


def _py_imports(files: str) -> str:
    return f"""
select distinct repo_name, rel_path, module from (
  select repo_name, rel_path, unnest(regexp_extract_all(content, '{PY_PATTERN}', 1)) as module from {files}
  union all
  select repo_name, rel_path, unnest(regexp_extract_all(content, '{PY_PATTERN}', 2)) as module from {files})
where module <> '' and module <> '__future__'"""


JAVA_IMPORTS = f"""
select distinct repo_name, rel_path, module from (
  select repo_name, rel_path, unnest(regexp_extract_all(
    string_split(string_split(array_to_string(string_split(content, chr(10))[1:100], chr(10)), 'public class')[1], 'interface')[1],
    '{JAVA_PATTERN}', 1)) as module
  from java_files)"""

INDEX = """
module_index as (
  select repo_name, file_name, target from (
    select repo_name, string_split(rel_path, '/')[-1] as file_name, rel_path as target,
           row_number() over (partition by repo_name, string_split(rel_path, '/')[-1]
                              order by string_split(rel_path, '/')[:-2]) as nth
    from nested_files)
  where nth = 1)"""

PY_EDGES = f"""
py_imports as ({_py_imports("code_files")}),
py_edges as (
  select i.repo_name, i.rel_path as src, f.rel_path as dst
  from py_imports i join code_files f on i.repo_name = f.repo_name and f.rel_path = i.module || '.py')"""
JAVA_EDGES = f"""
java_imports as ({JAVA_IMPORTS}),
java_edges as (
  select i.repo_name, i.rel_path as src, f.rel_path as dst
  from java_imports i join java_files f on i.repo_name = f.repo_name and f.rel_path = i.module || '.java')"""
ALL_EDGES = f"{PY_EDGES}, {JAVA_EDGES}, all_edges as (select * from py_edges union select * from java_edges)"


def _graph(files: str, edges: str, definitions: str) -> str:
    """Reachability decides everything about cycles: an edge is on one when its target reaches its source."""
    return f"""recursive {definitions},
plain as (select repo_name, src, dst from {edges} where src <> dst),
reach as (
  select repo_name, src, dst from plain
  union
  select r.repo_name, r.src, e.dst from reach r join plain e on e.repo_name = r.repo_name and e.src = r.dst),
acyclic as (
  select p.repo_name, p.src, p.dst from plain p
  where not exists (select 1 from reach r where r.repo_name = p.repo_name and r.src = p.dst and r.dst = p.src)),
linked as (select repo_name, src as rel_path from plain union select repo_name, dst from plain),
component as (
  select l.repo_name, l.rel_path,
         least(l.rel_path, min(case when b.src is not null then r.dst end)) as scc_id
  from linked l
  left join reach r on r.repo_name = l.repo_name and r.src = l.rel_path
  left join reach b on b.repo_name = l.repo_name and b.src = r.dst and b.dst = l.rel_path
  group by l.repo_name, l.rel_path),
depth as (
  select repo_name, rel_path, cast(0 as bigint) as level from {files}
  union
  select d.repo_name, e.dst, d.level + 1 from depth d join acyclic e on e.repo_name = d.repo_name and e.src = d.rel_path),
node_level as (select repo_name, rel_path, max(level) as level from depth group by repo_name, rel_path)"""


GRAPH = _graph("code_files", "py_edges", f"{CODE}, {PY_EDGES}")

def _draw(purpose: str, key: str) -> str:
    return f"md5(concat('{purpose}:{SEED}:', {key}))"


def _record(content: str = "content") -> str:
    return f"""case when substr({_draw("context", "file_path")}, 1, 1) <= '7'
     then concat('{REPO_MARK}', repo_name, '{FILE_MARK}', file_path, chr(10), {content}, '{END_MARK}')
     else concat({content}, '{END_MARK}') end"""


_ORDER = f"{_draw('order', 'file_path')}, file_path"


def _corpus(window: str, source: str = "numbered") -> str:
    return f"""select repo_ord, repo_name, file_path, string_split(file_path, '.')[-1] as language, {_record()} as content,
  row_number() over ({window}) - 1 as pos from {source}"""


def _words(items: list[str]) -> str:
    return "[" + ", ".join(f"'{w}'" for w in items) + "]"


def _has(items: list[str]) -> str:
    return f"list_bool_or(list_transform({_words(items)}, lambda w: contains(lower(description), w)))"


INVALID = f"(description is null or ({_has(BLACKLIST)} and not {_has(WHITELIST)}))"

MANIFEST = """
once as (
  select source as repo_name, cast(substr(source, 4) as integer) as number, concat('repos/', source) as path
  from (select distinct source from documents)),
manifest as (
  select number as repo_ord, case when number % 4 = 0 then concat(repo_name, ' ') else repo_name end as repo_name, path from once
  union all
  select number + 1000, repo_name, concat(path, '/again') from once where number % 3 = 0)"""

# Records end in the end marker and hold it nowhere else: it is cut off, and its id put behind the ids of the rest.
TOKENS = f"""
{NUMBERED},
recs as (
  select file_path as doc_id, substr(content, 1, length(content) - {len(END_MARK)}) as text
  from (select file_path, {_record()} as content from numbered)),
pieces as (
  select doc_id, unnest(p) as piece, unnest(range(len(p))) as nth
  from (select doc_id, regexp_extract_all(text, '{SQL_PIECE}') as p from recs)),
vocab as (
  select piece, n, cast({FIRST_WORD_ID - 1} + row_number() over (order by n desc, piece) as integer) as token_id
  from (select piece, count(*) as n from pieces group by piece order by n desc, piece limit {VOCAB})),
coded as (
  select doc_id, nth,
         case when token_id is not null then [token_id]
              else list_transform(regexp_extract_all(hex(encode(p.piece)), '..'), lambda h: cast(concat('0x', h) as integer)) end as ids
  from pieces p left join vocab v on p.piece = v.piece),
filled as (select doc_id, flatten(list(ids order by nth)) as ids from coded group by doc_id),
word_ids as (
  select d.doc_id, list_append(coalesce(f.ids, cast([] as integer[])), {END_ID}) as ids
  from recs d left join filled f on f.doc_id = d.doc_id),
lengths as (select doc_id, ids, cast(len(ids) as bigint) as n_tokens from word_ids),
placed as (
  select *, cast(coalesce(sum(n_tokens) over (order by doc_id rows between unbounded preceding and 1 preceding), 0) as bigint) as "offset"
  from lengths)"""

# Lower case for A-Z only, and words between blanks and line breaks.
LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
SQL_WORD = r"[^\x20\x09-\x0D]+"

# All pairs of documents that share a shingle, and the closure over those that are alike enough.
NEAR_DEDUP = f"""with recursive words as (
  select doc_id, regexp_extract_all({LOWERED}, '{SQL_WORD}') as w from documents),
shingles as (
  select distinct doc_id, array_to_string(w[i : i + 4], ' ') as shingle
  from (select doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) as i from words where len(w) > 0)),
sizes as (select doc_id, count(*) as n from shingles group by doc_id),
shared as (
  select a.doc_id as x, b.doc_id as y, count(*) as hits
  from shingles a join shingles b on a.shingle = b.shingle and a.doc_id < b.doc_id group by 1, 2),
links as (
  select x, y from shared join sizes a on a.doc_id = x join sizes b on b.doc_id = y
  where 100 * hits >= 80 * (a.n + b.n - hits)),
ways as (select x, y from links union all select y, x from links),
reach as (select x, y from ways union select r.x, w.y from reach r join ways w on w.x = r.y)
select d.doc_id, coalesce(s.n, 0)::bigint as n_shingles,
       least(d.doc_id, (select min(y) from reach r where r.x = d.doc_id)) as component
from documents d left join sizes s on s.doc_id = d.doc_id"""

LEAKS = f"""items as (
  select distinct item_id, k, array_to_string(w[i : i + k - 1], ' ') as gram
  from (select item_id, w, k, unnest(range(1, len(w) - k + 2)) as i
        from (select item_id, w, least(13, len(w)) as k
              from (select item_id, regexp_extract_all({LOWERED}, '{SQL_WORD}') as w from benchmark)))),
grams as (
  select distinct doc_id, k, array_to_string(w[i : i + k - 1], ' ') as gram
  from (select doc_id, w, k, unnest(range(1, len(w) - k + 2)) as i
        from (select doc_id, regexp_extract_all({LOWERED}, '{SQL_WORD}') as w from documents), (select distinct k from items)
        where len(w) >= k)),
leaks as (select doc_id, item_id, count(*) as grams from grams join items using (k, gram) group by all)"""

# Kinds, their patterns and marks, in the order in which they are replaced.
SQL_BYTE = "(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
SQL_KINDS = {
    "email": (r"[A-Za-z0-9._%+-]{1,64}@[A-Za-z0-9.-]{1,253}\.[A-Za-z]{2,24}", "<EMAIL>"),
    "secret": (
        r"""((?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]"""
        r"""|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["'']? {0,8}[:=] {0,8}["'']?)[A-Za-z0-9+/_.=-]{8,}""",
        r"\1<SECRET>",
    ),
    "key": (r"\b(?:AKIA[A-Z0-9]{12,}|[0-9a-f]{32,})\b", "<KEY>"),
    "ip": (rf"\b{SQL_BYTE}(?:\.{SQL_BYTE}){{3}}\b", "<IP>"),
    "card": (r"\b(?:[0-9]{13,16}|[0-9]{4}(?:[ -][0-9]{4}){3})\b", "<CARD>"),
    "phone": (r"(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{2,4}\)|\b[0-9]{2,4})[ .-]?[0-9]{3,4}[ .-][0-9]{3,4}\b", "<PHONE>"),
}


def _redacted() -> str:
    steps, counts = "select * from documents", ""
    for name, (pattern, mark) in SQL_KINDS.items():
        steps = f"""select * replace (regexp_replace(text, '{pattern}', '{mark}', 'g') as text),
          coalesce(len(regexp_extract_all(text, '{pattern}')), 0) as n_{name} from ({steps})"""
        counts += f", n_{name}"
    return f"select doc_id, text{counts} from ({steps})"


ORACLES: dict[str, str] = {
    "exact_dedup": """select doc_id, lang, source, n_chars from documents
        qualify row_number() over (partition by text order by doc_id) = 1""",
    "exact_copies": "select sha256(text) as digest, min(doc_id) as first_key, count(*) as copies from documents group by text",
    "near_dedup": NEAR_DEDUP,
    "decontamination_report": f"with {LEAKS} select doc_id, item_id, grams from leaks",
    "decontaminate": f"with {LEAKS} select doc_id, n_chars from documents where doc_id not in (select doc_id from leaks)",
    "redact": _redacted(),
    "language_of": f"with {BOTH} select file_path, string_split(file_path, '.')[-1] as language from both_files",
    "rel_path": f"with {BOTH} select file_path, rel_path from both_files",
    "source_files": f"""with {BOTH} select repo_name, rel_path, 'java' as source_language from both_files
        where rel_path like '%.java'""",
    "extension_filter": f"""with {BOTH} select repo_name, rel_path from both_files
        where rel_path like '%3.py' or rel_path like '%.java'""",
    "format_context": f"with {CODE} select repo_name, file_path, {_record()} as content from code_files",
    "truncate_content": f"select doc_id, substr(text, 1, {CUT}) as content from documents",
    "truncate_record": f"""select doc_id, substr(concat(text, '{END_MARK}'), 1, {CUT}) as cut,
        case when length(text) + {len(END_MARK)} <= {CUT} then concat(text, '{END_MARK}')
             else concat(substr(text, 1, {CUT - len(END_MARK)}), '{END_MARK}') end as cut_with_mark from documents""",
    "decode_text": "select doc_id, text as content from documents",
    "repo_stats": f"with {BOTH} select repo_name, count(*) as n_files from both_files group by repo_name",
    "language_stats": f"""with {BOTH} select repo_name, string_split(rel_path, '.')[-1] as language, count(*) as n_files
        from both_files group by all""",
    "extract_imports_py": f"with {CODE} {_py_imports('code_files')}",
    "extract_imports_java": f"with {JAVA} {JAVA_IMPORTS}",
    "future_imports_dropped": f"with {NESTED} {_py_imports('nested_files')}",
    "import_counts": f"""with {CODE}, {JAVA}, found as (
          select * from ({_py_imports("code_files")}) union all select * from ({JAVA_IMPORTS})),
        both_files as (select repo_name, rel_path from code_files union all select repo_name, rel_path from java_files)
        select b.repo_name, b.rel_path, count(f.module) as n_imports
        from both_files b left join found f on f.repo_name = b.repo_name and f.rel_path = b.rel_path group by all""",
    "module_index": f"with {NESTED}, {INDEX} select * from module_index",
    "resolve_imports": f"""with {NESTED}, {INDEX}, found as ({_py_imports("nested_files")})
        select f.repo_name, f.rel_path, f.module, m.target
        from found f join module_index m on m.repo_name = f.repo_name and m.file_name = f.module || '.py'""",
    "dependency_edges": f"with {CODE}, {JAVA}, {ALL_EDGES} select * from all_edges",
    "drop_self_loops": f"with {CODE}, {PY_EDGES} select * from py_edges where src <> dst",
    "compose_graphs": f"with {CODE}, {JAVA}, {ALL_EDGES} select * from all_edges",
    "graph_nodes": f"with {BOTH} select repo_name, rel_path from both_files",
    "components": f"with {GRAPH} select * from component",
    "break_cycles": f"with {GRAPH} select * from acyclic",
    "topo_levels": f"with {GRAPH} select * from node_level",
    "components_large_repos": f"with {GRAPH} select * from component",
    "break_cycles_large_repos": f"with {GRAPH} select * from acyclic",
    "topo_levels_large_repos": f"with {GRAPH} select * from node_level",
    "graph_stats": f"""with {GRAPH},
        big as (select repo_name, scc_id from component group by all having count(*) > 1)
        select n.repo_name, n.n_nodes, (select count(*) from py_edges e where e.repo_name = n.repo_name) as n_edges,
          (select count(*) from big b where b.repo_name = n.repo_name) as n_cyclic_components,
          (select count(*) from plain p where p.repo_name = n.repo_name)
            - (select count(*) from acyclic a where a.repo_name = n.repo_name) as n_cycle_edges
        from (select repo_name, count(*) as n_nodes from code_files group by repo_name) n""",
    "stored_graph": f"""with {CODE}, {PY_EDGES}
        select repo_name, rel_path as src, cast(null as varchar) as dst from code_files
        union all select repo_name, src, dst from py_edges""",
    "incremental_imports": f"""with {CODE}, found as ({_py_imports("code_files")})
        select c.repo_name, c.rel_path, sha256(c.file_path) as path_key,
          case when substr(md5(c.file_path), 1, 1) <= '7' then 'cached' else
            (select string_agg(f.module, ' ' order by f.module) from found f
             where f.repo_name = c.repo_name and f.rel_path = c.rel_path) end as modules,
          substr(md5(c.file_path), 1, 1) <= '7' as from_cache
        from code_files c""",
    "import_store": f"""with {CODE}, found as ({_py_imports("code_files")}),
        sets as (select repo_name, rel_path, string_agg(module, ' ' order by module) as modules, count(*) as n from found group by all)
        select c.repo_name, c.rel_path, modules, substr(md5(c.file_path), 1, 1) <= '7' as from_cache, n as n_stored
        from code_files c left join sets using (repo_name, rel_path)""",
    "order_files": f"""with {GRAPH} select repo_name, rel_path, level,
        row_number() over (partition by repo_name order by level desc, rel_path) - 1 as pos from node_level""",
    "order_by_walk": f"""with {NESTED} select repo_name, rel_path, row_number() over (
          partition by repo_name order by string_split(rel_path, '/')[:-2], string_split(rel_path, '/')[-1]) - 1 as pos
        from nested_files""",
    "shuffle_in_repo": f"""with {CODE} select repo_name, file_path,
        row_number() over (partition by repo_name order by {_ORDER}) - 1 as pos from code_files""",
    "shuffle_global": f"""with {CODE} select repo_name, file_path,
        row_number() over (order by {_ORDER}) - 1 as pos from code_files""",
    "sample_rows": f"""select doc_id, text as content from documents
        order by {_draw("order", "doc_id")}, doc_id limit {SAMPLE}""",
    "corpus_setting1": f"with {NUMBERED} {_corpus(f'order by {_ORDER}')}",
    "corpus_setting2": f"with {NUMBERED} {_corpus(f'partition by repo_name order by {_ORDER}')}",
    "corpus_setting3": f"""with {GRAPH}, leveled as (
          select c.*, cast(substr(c.repo_name, 4) as integer) as repo_ord, l.level
          from code_files c join node_level l on l.repo_name = c.repo_name and l.rel_path = c.rel_path)
        {_corpus("partition by repo_name order by level desc, rel_path", "leveled")}""",
    "corpus_walk_order": f"with {NUMBERED} {_corpus('partition by repo_name order by rel_path')}",
    "invalid_description": f"with {ITEMS} select name, {INVALID} as invalid from items",
    "repo_candidates": f"with {ITEMS} select * from items where has_issues and size > {MIN_SIZE_KB} and not {INVALID}",
    "top_repos": f"""with {ITEMS} select cast(floor(row_ord / {PAGE_ITEMS}) as bigint) as page, name, html_url from items
        where has_issues and size > {MIN_SIZE_KB} and not {INVALID} order by row_ord limit {TOP}""",
    "top_packages": f"with {PACKAGES} select * from packages order by download_count desc, row_ord limit {TOP}",
    "selection_manifest": f"""with {ITEMS} select cast(row_ord as integer) as repo_ord, name as repo_name, html_url as url,
        concat('repos/', name) as path, '.java' as extensions from items""",
    "search_page_items": f"""with {ITEMS} select cast(floor(row_ord / {PAGE_ITEMS}) as bigint) as page,
        row_ord % {PAGE_ITEMS} as "at", name, html_url, stars as stargazers_count, has_issues, size, description from items""",
    "search_page_sizes": f"""with {ITEMS} select cast(floor(row_ord / {PAGE_ITEMS}) as bigint) as page,
        count(*) as n_items from items group by 1""",
    "package_ranking_rows": f"with {PACKAGES} select row_ord, project, download_count from packages",
    "manifest_as_written": f"with {MANIFEST} select * from manifest",
    "manifest_deduped": f"""with {MANIFEST} select repo_ord, repo_name, path from (
          select repo_ord, rtrim(repo_name) as repo_name, path,
                 row_number() over (partition by rtrim(repo_name) order by repo_ord) as nth from manifest)
        where nth = 1""",
    "missing_repos": f"""with {MANIFEST} select repo_ord, rtrim(repo_name) as repo_name, path from manifest
        where rtrim(repo_name) not in (
          select source from documents where cast(substr(source, 4) as integer) < {PRESENT})""",
    "first_link": "select concat('pkg', page_id) as project, case when page_id % 5 <> 0 then url end as link from pages",
    "package_links": f"""with {PACKAGES} select p.row_ord, p.project, p.download_count,
          case when g.page_id % 5 <> 0 then g.url end as url
        from packages p left join pages g on p.project = concat('pkg', g.page_id)""",
    "rejects": f"""with {PACKAGES} select p.project as repo_name, cast(null as varchar) as rel_path, 'download' as stage,
          'no download link' as reason
        from packages p left join pages g on p.project = concat('pkg', g.page_id)
        where g.page_id is null or g.page_id % 5 = 0""",
    "archive_name": "select page_id, concat('v', page_id, '.1') as archive from pages",
    "scanned_repos": f"""with {BOTH} select cast(substr(repo_name, 4) as integer) as repo_ord, repo_name, rel_path,
        rel_path like '%.py' as selected, content, cast(null as varchar) as read_error from both_files""",
    "archive_members": """select concat('p', doc_id) as repo_name, 'src/main.py' as rel_path,
        concat('repos/p', doc_id, '/src/main.py') as file_path, text as content from documents""",
    "jsonl_round_trip": f"""with {CODE} select repo_name, file_path, 'py' as language, substr({_record()}, 1, {CUT}) as content
        from code_files""",
    "mixed_corpus": f"""with {BOTH} select repo_name, file_path, string_split(file_path, '.')[-1] as language, {_record()} as content
        from both_files""",
    "vocabulary": f"with {TOKENS} select piece, n, token_id from vocab",
    "tokenize_words": f"with {TOKENS} select doc_id, array_to_string(ids, ' ') as ids from word_ids",
    "tokenize_bytes": f"""with {TOKENS} select doc_id, array_to_string(list_append(list_transform(
        regexp_extract_all(hex(encode(text)), '..'), lambda h: cast(concat('0x', h) as integer)), {END_ID}), ' ') as ids from recs""",
    "training_rows": f"""with {TOKENS}, padded as (
          select doc_id, list_resize(ids, {ROW_LENGTH}, {END_ID}) as row,
                 list_resize(list_resize(cast([] as integer[]), least(len(ids), {ROW_LENGTH}), 1), {ROW_LENGTH}, 0) as mask
          from word_ids)
        select doc_id, array_to_string(row, ' ') as input_ids, array_to_string(mask, ' ') as attention_mask,
          array_to_string(list_transform(row, lambda x: case when x = {END_ID} then {IGNORED_LABEL} else x end), ' ') as labels
        from padded""",
    "token_offsets": f'with {TOKENS} select doc_id, n_tokens, "offset" from placed',
    "flatten_tokens": f"""with {TOKENS}
        select "offset" + unnest(range(len(ids))) as position, unnest(ids) as token from placed""",
    "token_stats": f"""with {TOKENS} select count(*) as n_rows, cast(sum(n_tokens) as bigint) as n_tokens,
        cast(sum(n_tokens) as double) / count(*) as avg_tokens from lengths""",
    "distinct_tokens": f"""with {TOKENS} select count(distinct token) as n_distinct_tokens
        from (select unnest(ids) as token from word_ids)""",
    "merged_token_sketches": f"""with {TOKENS} select count(distinct token) as n_distinct_tokens, true as close
        from (select unnest(ids) as token from word_ids)""",
    "token_preview": f"""with {TOKENS} select w.doc_id, array_to_string(w.ids, ' ') as ids, d.text as decoded
        from word_ids w join recs d on d.doc_id = w.doc_id
        order by {_draw("order", "w.doc_id")}, w.doc_id limit {SAMPLE}""",
    "stored_tokens": f"""with {TOKENS} select doc_id, "offset", n_tokens, array_to_string(ids, ' ') as ids from placed""",
}

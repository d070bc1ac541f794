"""DuckDB SQL of the queries that SQL can express."""

# A word, and the letters that are lower-cased.
WORD = r"[^\x20\x09-\x0D]+"
LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def near_duplicates(n: int, percent: int, source: str = "documents") -> str:
    gram = " || ' ' || ".join(f"ws[i + {k}]" for k in range(n))
    return f"""
    with recursive w as (
        select doc_id, coalesce(regexp_extract_all({LOWER}, '{WORD}'), []) as ws from {source}
    ), s as (
        select doc_id, list_distinct(case
            when len(ws) = 0 then []
            when len(ws) < {n} then [array_to_string(ws, ' ')]
            else list_transform(range(1, len(ws) - {n} + 2), lambda i: {gram}) end) as sh
        from w
    ), e as (
        select doc_id, len(sh) as n, unnest(sh) as g from s
    ), met as (
        select a.doc_id as x, b.doc_id as y, a.n + b.n as total, count(*) as i
        from e a join e b on a.g = b.g and a.doc_id < b.doc_id and 100 * least(a.n, b.n) >= {percent} * greatest(a.n, b.n)
        group by all having 100 * count(*) >= {percent} * (a.n + b.n - count(*))
    ), links as (
        select x, y from met union all select y, x from met
    ), reach(doc_id, c) as (
        select doc_id, doc_id from s
        union
        select l.y, r.c from reach r join links l on l.x = r.doc_id where r.c < l.y
    ), named as (
        select doc_id, min(c) as component_id from reach group by 1
    )
    select doc_id, cast(len(sh) as bigint) as n_shingles, component_id, doc_id = component_id as kept
    from s join named using (doc_id)
    """


def line_dedup(words: int, leading: int, variants: int, agree: float, source: str = "documents") -> str:
    """Without hashes; otherwise as the operator. Rows: doc_id, text, n_lines, n_dropped."""
    return f"""
    with l as (
        select doc_id, text, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) - 1 as pos
        from {source}
    ), w as (
        select doc_id, text, pos, string_split(trim(regexp_replace(
            regexp_replace(line, '[^\\x20\\x09-\\x0D]*[0-9][^\\x20\\x09-\\x0D]*', '<*>', 'g'),
            '[\\x20\\x09-\\x0D]+', ' ', 'g'), ' '), ' ') as words
        from l
    ), p as (
        select doc_id, text, pos, words, [cast(len(words) as varchar), {", ".join(f"words[{k + 1}]" for k in range(leading))}] as leaf,
            array_to_string(words, ' ') as own
        from w where len(words) >= {words}
    ), own as (
        select own, leaf, any_value(words) as words, min(text) as low, max(text) as high, min((doc_id, pos)) as first from p group by own, leaf
    ), wide as (
        select leaf from own group by leaf having count(*) >= {variants} and min(low) <> max(high)
    ), forms as (
        select * from own semi join wide using (leaf)
    ), places as (
        select leaf, unnest(words[{leading + 1}:]) as word, unnest(range({leading + 1}, len(words) + 1)) as k from forms
    ), loose as (
        select leaf, list(k) as loose from (
            select leaf, k, max(n) as top, sum(n) as n from (select leaf, k, word, count(*) as n from places group by all) group by all
        ) where 2 * top < n group by leaf
    ), masks as (
        select f.*, {1 - agree} * (len(words) - {leading}) + 1e-9 as room,
            list_filter(range({leading + 1}, len(words) + 1), lambda i: words[i] <> '<*>') as ones,
            list_filter(coalesce(loose, []), lambda i: words[i] <> '<*>') as few
        from forms f left join loose using (leaf)
    ), keys as (
        select own, leaf, low, high, first, unnest(
            case when room >= 1 then list_transform(ones, lambda k: {{'k': k, 'key': array_to_string(list_transform(words, lambda w, i: case when i = k then '<*>' else w end), ' ')}}) else [] end
            || case when len(few) > 1 and len(few) <= room then [{{'k': 2147483647, 'key': array_to_string(list_transform(words, lambda w, i: case when list_contains(few, i) then '<*>' else w end), ' ')}}] else [] end, recursive := true
        ) from masks
    ), masked as (
        select leaf, key, count(*) as variants from keys group by all having count(*) >= {variants} and min(low) <> max(high)
    ), ranked as (
        select own, leaf, key, first, row_number() over (partition by own, leaf order by variants desc, k) as r from keys join masked using (leaf, key)
    ), chosen as (
        select own, leaf, min(first) over (partition by leaf, key) as first from ranked where r = 1
    ), recurring as (
        select own, leaf, first from chosen
        union all select own, leaf, first from own anti join chosen using (own, leaf) where low <> high
    ), gone as (
        select p.doc_id, p.pos from p join recurring using (own, leaf) where (p.doc_id, p.pos) <> recurring.first
    )
    select d.doc_id, coalesce(any_value(k.rest), case when any_value(d.text) is not null then '' end) as text,
        cast(coalesce(len(string_split(any_value(d.text), chr(10))), 0) as bigint) as n_lines,
        cast(coalesce(any_value(g.n), 0) as bigint) as n_dropped
    from {source} d
    left join (select doc_id, string_agg(line, chr(10) order by pos) as rest from l anti join gone using (doc_id, pos) group by 1) k using (doc_id)
    left join (select doc_id, count(*) as n from gone group by 1) g using (doc_id)
    group by d.doc_id
    """


def url_filter(rules: list[tuple[str, str]], levels: int, children: int, least: int, strength: float, alike: float, purity: float, source: str = "pages") -> str:
    """For paths of at most `levels` segments."""
    case = []
    for verdict, rule in sorted(rules, key=lambda r: -len(r[1])):
        at, _, start = rule.partition("/")
        case.append(((rule, verdict), f"when (host = '{at}' or ends_with(host, '.{at}')) and starts_with(path, '/{start}') then"))
    rule_case = "case " + " ".join(f"{c} '{r[0]}'" for r, c in case) + " end"
    verdict_case = "case " + " ".join(f"{c} '{r[1]}'" for r, c in case) + " end"

    def smoothed(k: str, n: str, towards: str) -> str:
        return f"({k} + {strength} * {towards}) / ({n} + {strength})"

    steps, closed = [], []
    for x in range(levels + 1):
        goes_on = f"len(segs) > {x} and paths >= {least}"
        closed.append(f"select host, path, template || case when len(segs) > {x} then '/**' else '' end as template, purity from r{x} where not ({goes_on})")
        if x == levels:
            break
        steps.append(f"""c{x} as (
        select *, case when regexp_matches(segs[{x + 1}], '[0-9]') then '*' else segs[{x + 1}] end as child from r{x} where {goes_on}
    ), d{x} as (
        select * replace (case when (select count(distinct b.child) from c{x} b where b.host = a.host and b.template = a.template) > {children} then '*' else child end as child) from c{x} a
    ), g{x} as (
        select host, template, child, sum(n) as n, sum(k) as k, count(*) as paths, max(purity) as above from d{x} group by all
    ), k{x} as (
        select *, sum(n) over kin as kin_n, sum(k) over kin as kin_k from g{x} window kin as (partition by host, template)
    ), a{x} as (
        select *, not coalesce(n > 0 and kin_n > n and abs(k / n - (kin_k - k) / (kin_n - n))
            > {alike} * sqrt((kin_k / kin_n) * (1 - kin_k / kin_n) * (1 / n + 1 / (kin_n - n))), false) as alike from k{x}
    ), p{x} as (
        select host, template, child, paths, above,
            case when alike then sum(case when alike then n else 0 end) over kin else n end as pn,
            case when alike then sum(case when alike then k else 0 end) over kin else k end as pk
        from a{x} window kin as (partition by host, template)
    ), r{x + 1} as (
        select d.host, d.path, d.n, d.k, d.segs, d.template || '/' || d.child as template, p.paths, {smoothed("p.pk", "p.pn", "p.above")} as purity
        from d{x} d join p{x} p using (host, template, child)
    )""")
    return f"""
    with u as (
        select page_id,
            coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') as host,
            coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') as path
        from {source}
    ), s as (
        select host, path, count(*) as pages, {rule_case} as rule, {verdict_case} as ruled, list_filter(string_split(path, '/'), lambda x: x <> '') as segs
        from u group by host, path
    ), l as (
        select *, case when ruled is not null then pages else 0 end as n, case when ruled = 'block' then pages else 0 end as k from s
    ), h as (
        select host, sum(n) as n, sum(k) as k, count(*) as paths from l group by host
    ), prior as (
        select {smoothed("coalesce(sum(k), 0)", "coalesce(sum(n), 0)", "0.5")} as prior from l
    ), r0 as (
        select l.host, path, l.n, l.k, segs, '' as template, paths, {smoothed("h.k", "h.n", "prior")} as purity from l join h using (host), prior
    ), {", ".join(steps)}, found as ({" union all ".join(closed)})
    select page_id, host, path, rule, coalesce(ruled, case when purity >= {purity} then 'block' else 'allow' end) as verdict, template,
        round(purity, 6) as purity
    from u join s using (host, path) join found using (host, path)
    """


# Fixed value: the reflected polynomial of CRC-32; a byte is eight steps.
CRC32 = """xor(4294967295, list_reduce(
            [4294967295::bigint] || list_transform(range(1, len(cast(doc_id as varchar)) + 1), lambda i: ascii(cast(doc_id as varchar)[i])::bigint),
            lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, z: xor(x >> 1, 3988292384 * (x & 1)))))"""


def ranked_search(k: int) -> str:
    terms = f"regexp_extract_all({LOWER}, '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"
    return f"""
    with t as (
        select doc_id, unnest({terms}) as term from documents
    ), tf as (
        select doc_id, term, count(*) as tf from t group by all
    ), size as (
        select doc_id, count(*) as n from t group by all
    ), whole as (
        select count(*) as docs, cast(sum(n) as bigint) as terms from size
    ), wanted as (
        select distinct item_id, term from (select item_id, unnest({terms}) as term from benchmark)
    ), weight as (
        select term, cast(floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1))) as bigint) as w
        from tf, whole where term in (select term from wanted) group by term, docs
    ), scored as (
        select item_id, doc_id, cast(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * docs) // terms)))) as bigint) as score
        from wanted join tf using (term) join weight using (term) join size using (doc_id), whole group by all
    )
    select item_id, cast(row_number() over (partition by item_id order by score desc, doc_id) as integer) as rank, doc_id, score
    from scored where score > 0 qualify rank <= {k}
    """


def merkle_manifest(arity: int, levels: int, group_levels: int) -> str:
    """For groups of at most arity ** levels rows, and arity ** group_levels groups."""

    def leaf(text: str) -> str:
        fields = ("doc_id", "source", "lang", "n_chars", text)
        return "sha256(" + " || ".join(f"coalesce(strlen(cast({f} as varchar)) || ':' || cast({f} as varchar), '-')" for f in fields) + ")"

    def trees(name: str, levels: int) -> str:
        """From {name}0 (tree, place, h): nodes of each level with what stands before and after them in their run."""
        steps = []
        for k in range(levels):
            steps.append(f"""{name}{k + 1} as (
        select tree, place // {arity} as place, sha256(string_agg(h, '' order by place)) as h from {name}{k}
        where tree in (select tree from {name}{k} group by tree having count(*) > 1) group by all
    ), {name}_run{k} as (
        select a.tree, a.place, coalesce(string_agg(b.h, '' order by b.place) filter (b.place < a.place), '') as before,
            coalesce(string_agg(b.h, '' order by b.place) filter (b.place > a.place), '') as after
        from {name}{k} a join {name}{k} b on a.tree = b.tree and a.place // {arity} = b.place // {arity}
        where a.tree in (select tree from {name}{k} group by tree having count(*) > 1) group by all
    )""")
        return ", ".join(steps)

    def tops(name: str, levels: int) -> str:
        return " union all ".join(f"select tree, h from {name}{k} where tree in (select tree from {name}{k} group by tree having count(*) = 1)" for k in range(levels + 1))

    folds, last = [], "start"
    for name, count in (("node", levels), ("top", group_levels)):
        for k in range(count):
            on = f"r.tree = {last}.tree and r.place = {last}.position // {arity**k}" if name == "node" else f"r.place = {last}.tree // {arity**k}"
            folds.append(f"""{name}_fold{k} as (
        select {last}.* replace (proof || coalesce(before || after, '') as proof, case when before is null then folded else sha256(before || folded || after) end as folded)
        from {last} left join {name}_run{k} r on {on}
    )""")
            last = f"{name}_fold{k}"
    return f"""
    with crcs as (
        select distinct doc_id, {CRC32} as crc from documents
    ), leaves as (
        select doc_id, source, {leaf("text")} as leaf,
            {leaf("case when crc % 2 = 0 then replace(text, chr(10), '') else text end")} as changed
        from documents left join crcs using (doc_id)
    ), start as (
        select *, dense_rank() over (order by source nulls first) - 1 as tree,
            row_number() over (partition by source order by doc_id nulls first, leaf) - 1 as position, '' as proof, changed as folded
        from leaves
    ), node0 as (select tree, position as place, leaf as h from start), {trees("node", levels)}, subroots as ({tops("node", levels)}),
    top0 as (select 0 as tree, tree as place, h from subroots), {trees("top", group_levels)}, roots as ({tops("top", group_levels)}),
    {", ".join(folds)}
    select doc_id, leaf, subroots.h as subroot, roots.h as root, sha256(proof) as proof_sha256, folded as folded_root, folded = roots.h as verified
    from {last} join subroots using (tree), roots
    """


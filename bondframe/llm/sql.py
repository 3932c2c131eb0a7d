"""DuckDB SQL for the queries of this subpackage that SQL can express.

The other queries (hashed fingerprints, trained models, token merges, fuzzy
groups) are held against brute force, round trips or held-out rows in tests.
"""

from __future__ import annotations

from . import contamination, secrets, shard, urls
from .queries import RULES, SHARDS


def _crc_table() -> str:
    """The 256 entries of CRC-32, from its polynomial."""
    out = []
    for c in range(256):
        for _ in range(8):
            c = c >> 1 ^ (0xEDB88320 if c & 1 else 0)
        out.append(c)
    return "[" + ", ".join(map(str, out)) + "]::BIGINT[]"


def _unit(key: str, salt: str) -> str:
    return f"((CAST(concat('0x', substr(md5(concat({key}, ':', {salt})), 1, 13)) AS BIGINT) + 0.5) / 4503599627370496.0)"


def sharding() -> str:
    def best(n: int) -> str:
        return f"list_last(list_sort(list_transform(range({n}), lambda i: {{'s': -1.0 / ln({_unit('k', 'i')}), 'i': i}}))).i::INT"

    crc = "list_reduce(list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda h: CAST(concat('0x', h) AS BIGINT))), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]))"
    return f"""WITH crc AS (SELECT {_crc_table()} AS t), d AS (SELECT doc_id, coalesce(doc_id::VARCHAR, '') AS k, coalesce(strlen(text), 0) + 1 AS size, CASE WHEN text IS NOT NULL THEN xor({crc}, 4294967295) END AS text_crc32 FROM documents, crc),
 b AS (SELECT *, {best(SHARDS)} AS shard, {best(SHARDS + 1)} AS grown_shard, floor({_unit('k', "'slot'")} * (SELECT greatest({shard.LEAST_BLOCKS}, ceil(count(*) / {shard.BLOCK_ROWS}.0)) FROM documents)) AS block FROM d)
 SELECT doc_id, CAST(size AS BIGINT) AS size, text_crc32, 'key' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY block, doc_id, size, text_crc32) - 1 AS slot, grown_shard FROM b"""


def decontamination() -> str:
    words = "regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')"
    return f"""WITH it AS (SELECT item_id, w, least({contamination.WIDTH}, len(w)) AS k FROM (SELECT item_id, {words} AS w FROM benchmark WHERE text IS NOT NULL) WHERE len(w) > 0),
 ish AS (SELECT DISTINCT item_id, k, array_to_string(w[i:i + k - 1], ' ') AS s FROM it, unnest(range(1, len(w) - k + 2)) t(i)), size AS (SELECT item_id, count(*) AS n FROM ish GROUP BY 1), ks AS (SELECT DISTINCT k FROM ish),
 dsh AS (SELECT DISTINCT doc_id, k, array_to_string(w[i:i + k - 1], ' ') AS s FROM (SELECT doc_id, {words} AS w FROM documents WHERE text IS NOT NULL), ks, unnest(range(1, greatest(1, len(w) - k + 2))) t(i))
 SELECT doc_id, ish.item_id, max(n) AS n_shingles, count(*) AS n_common FROM ish JOIN dsh ON ish.k = dsh.k AND ish.s = dsh.s JOIN size ON size.item_id = ish.item_id GROUP BY doc_id, ish.item_id HAVING count(*) >= {contamination.CONTAINED} * max(n)"""


def secret_scan() -> str:
    quote = lambda s: s.replace("'", "''")

    def spans(pattern: str, kind: int, least: int, group: int = 0) -> str:
        p = quote(pattern)
        return f"""SELECT r, {kind} AS kind, upto - length(hit) AS s, upto AS e FROM (SELECT r, hit, held, sum(length(gap) + length(hit)) OVER (PARTITION BY r ORDER BY i) AS upto FROM
 (SELECT r, unnest(range(len(hits))) AS i, unnest(hits) AS hit, unnest(held) AS held, unnest(gaps[:len(hits)]) AS gap FROM (SELECT r, regexp_extract_all(t, '{p}') AS hits, regexp_extract_all(t, '{p}', {group}) AS held, string_split_regex(t, '{p}') AS gaps FROM d))) WHERE length(held) >= {least}"""

    names = "[" + ", ".join(f"'{k}'" for k in secrets.KINDS) + "]"
    part = f"""SELECT r, CASE WHEN n <= 32 AND x SIMILAR TO '[A-Z0-9]*[A-Z][A-Z0-9]*' AND regexp_matches(x, '[0-9]') THEN 3 WHEN n BETWEEN 20 AND 128 AND regexp_matches(x, '[0-9]') AND regexp_matches(x, '[A-Z]') AND regexp_matches(x, '[a-z]') THEN 4 END AS kind, s, e
 FROM (SELECT p.r, s, e, e - s AS n, substr(t, s::INT + 1, (e - s)::INT) AS x FROM ({spans(secrets.PART, 3, 16)}) p JOIN d ON d.r = p.r)"""
    near = lambda kinds: f"EXISTS (SELECT 1 FROM every o WHERE o.r = w.r AND o.kind IN ({kinds}) AND abs(o.s - w.s) <= {secrets.SCOPE})"
    joined = lambda cond: f"coalesce(string_agg(concat({names}[kind + 1], ':', s::BIGINT, ':', e::BIGINT), ',' ORDER BY s, kind) FILTER (WHERE {cond}), '')"
    return f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents), base AS ({spans(secrets.ASSIGN, 0, 12, 2)} UNION ALL {spans(secrets.ACCESS, 1, 18)} UNION ALL {spans(secrets.HEX, 2, 16)}),
 part AS ({part}), ends AS ({spans(secrets.ENDPOINT, 5, 1)}), every AS (SELECT * FROM base UNION ALL SELECT * FROM part WHERE kind IS NOT NULL UNION ALL SELECT * FROM ends),
 weak AS (SELECT * FROM every w WHERE kind = 3 AND {near('0, 2, 4')} UNION ALL SELECT * FROM every w WHERE kind = 4 AND {near('1, 3')} UNION ALL SELECT * FROM every w WHERE kind = 5 AND {near('1, 3')} AND {near('0, 2, 4')}),
 spans AS (SELECT * FROM base UNION ALL SELECT * FROM weak)
 SELECT d.doc_id, count(*) FILTER (WHERE kind = 0) AS n_assign, count(*) FILTER (WHERE kind = 1) AS n_access, count(*) FILTER (WHERE kind = 2) AS n_hex, sha256({joined('kind <= 2')}) AS base_sha256, {joined('kind >= 0')} AS spans FROM d LEFT JOIN spans ON spans.r = d.r GROUP BY d.r, d.doc_id"""


def url_filter() -> str:
    lower = f"translate(regexp_extract(url, '{urls.PARTS}', 1), '{urls.UPPER}', '{urls.LOWER}')"
    rules = []
    for verdict, rule in RULES:
        domain, slash, rest = rule.partition("/")
        rules.append(f"CASE WHEN (host = '{domain}' OR ends_with(host, '.{domain}')) AND starts_with(path, '{slash}{rest}') THEN {{'n': {len(rule)}, 'rule': '{rule}', 'verdict': '{verdict}'}} END")
    seg = lambda k: f"CASE WHEN len(segs) > {k} THEN {f'segs[{k + 1}]' if k < urls.DEPTH else f'array_to_string(segs[{k + 1}:], chr(47))'} END"
    levels = ""
    for k in range(1, urls.DEPTH + 1):
        levels += f""", s{k} AS (SELECT *, {seg(k)} AS seg FROM t{k - 1}), k{k} AS (SELECT host, template, seg, sum(n) AS n, sum(labelled) AS l, sum(bad) AS b FROM s{k} WHERE seg IS NOT NULL GROUP BY ALL),
 n{k} AS (SELECT host, template, sum(n) AS all_n, (sum(b) + 1.0) / (sum(l) + 2.0) AS p, count(*) AS fan FROM k{k} GROUP BY ALL),
 m{k} AS (SELECT a.host, a.template, a.seg, CASE WHEN (fan > {urls.FANOUT} AND a.n * {urls.FANOUT} < all_n) OR abs(a.b - a.l * p) <= {urls.Z} * sqrt(a.l * p * (1 - p)) THEN '*' ELSE a.seg END AS name FROM k{k} a JOIN n{k} b ON a.host = b.host AND a.template = b.template),
 t{k} AS (SELECT s.host, shape, s.n, labelled, bad, segs, CASE WHEN name IS NULL THEN s.template ELSE concat(s.template, '/', name) END AS template FROM s{k} s LEFT JOIN m{k} m ON m.host = s.host AND m.template = s.template AND m.seg = s.seg)"""
    share = lambda b, n, up: f"({b} + {up} * {urls.ALPHA}) / ({n} + {urls.ALPHA})"
    return f"""WITH pg AS (SELECT page_id, coalesce({lower}, '') AS host, coalesce(regexp_extract(url, '{urls.PARTS}', 2), '') AS path FROM pages), lb AS (SELECT doc_id AS key, max(1 - quality) AS bad FROM labels WHERE quality IS NOT NULL AND doc_id IS NOT NULL GROUP BY 1),
 pl AS (SELECT page_id, host, path, regexp_replace(path, '{urls.VARIABLE}', '#', 'g') AS shape, bad FROM pg LEFT JOIN lb ON lb.key = TRY_CAST(regexp_extract(path, '.*?([0-9]{{1,18}})[^0-9]*$', 1) AS BIGINT)),
 t0 AS (SELECT host, shape, n, labelled, bad, string_split(shape, '/') AS segs, '' AS template FROM (SELECT host, shape, count(*) AS n, count(bad) AS labelled, coalesce(sum(bad), 0) AS bad FROM pl GROUP BY host, shape)){levels},
 tot AS (SELECT coalesce((sum(bad) + 1.0) / (sum(labelled) + 2.0), 0.5) AS share FROM t0), hs AS (SELECT host, {share('sum(bad)', 'sum(labelled)', 'max(share)')} AS share FROM t0, tot GROUP BY host),
 lf AS (SELECT t.host, t.template, {share('sum(bad)', 'sum(labelled)', 'max(share)')} AS bad_share FROM t{urls.DEPTH} t JOIN hs ON hs.host = t.host GROUP BY t.host, t.template)
 SELECT page_id, pl.host, path, r.rule AS rule, coalesce(r.verdict, CASE WHEN bad_share >= {urls.REJECT} THEN 'block' ELSE 'allow' END) AS verdict, template
 FROM (SELECT *, list_last(list_sort(list_filter([{', '.join(rules)}], lambda x: x IS NOT NULL))) AS r FROM pl) pl JOIN (SELECT t.host, t.shape, t.template, bad_share FROM t{urls.DEPTH} t JOIN lf ON lf.host = t.host AND lf.template = t.template) t ON t.host = pl.host AND t.shape = pl.shape"""


ORACLE: dict[str, str] = {"op1_sharding": sharding(), "op3_url_filter": url_filter(), "op6_secrets": secret_scan(), "op9_decontamination": decontamination()}

"""DuckDB SQL for the corpus queries that SQL can express."""

from keystrata.llm.oracle_hash import xxh64

#: The reflected polynomial of CRC-32, the multiplier and scale of the jump.
_CRC_TABLE = "list_transform(range(0, 256), lambda n: list_reduce(list_prepend(n::uinteger, range(0, 8)::uinteger[]), lambda c, i: if(c & 1 = 1, xor(3988292384::uinteger, c >> 1), c >> 1)))"

SHARDING = f"""
with recursive t as materialized (select {_CRC_TABLE} as crc),
sized as (
  select doc_id, octet_length(encode(coalesce(text, '')))::bigint + 1 as size,
    list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda x: ('0x' || x)::uinteger) as bytes from documents
),
checked as (
  select doc_id, size, xor(4294967295::uinteger, list_reduce(list_prepend(4294967295::uinteger, bytes), lambda c, x: xor(c >> 8, t.crc[(xor(c, x) & 255) + 1])))::bigint as text_crc32 from sized, t
),
jumps(doc_id, n, state, here, ahead) as (
  select doc_id, n, doc_id::hugeint, -1::bigint, 0::bigint from documents, (values (8), (9)) v(n)
  union all
  select doc_id, n, moved, ahead, floor((ahead + 1) * (2147483648::double / ((moved // 8589934592) + 1)::double))::bigint
  from (select *, (state * 2862933555777941757 + 1) % 18446744073709551616 as moved from jumps where ahead < n)
),
shards as (select doc_id, max(here) filter (n = 8)::int as shard, max(here) filter (n = 9)::int as grown_shard from jumps where ahead >= n group by doc_id)
select doc_id, size, text_crc32, 'key' as law, shard, row_number() over (partition by shard order by doc_id) - 1 as slot, grown_shard from checked join shards using (doc_id)
"""

WARC = r"""
with p as (select page_id, lower(trim(coalesce(url, ''))) as url, encode(coalesce(html, '')) as body from pages),
q as (
  select page_id, octet_length(body)::bigint as payload_bytes, sha1(body) as payload_digest, split_part(url, '#', 1) as u,
    strftime(make_timestamp((1700000000 + page_id % 1000000000) * 1000000), '%Y-%m-%dT%H:%M:%SZ') as captured from p
),
parts as (
  select *, regexp_extract(u, '^(.*?)://', 1) as scheme, regexp_extract(u, '^.*?://([^/?]*)', 1) as site, regexp_extract(u, '^.*?://[^/?]*/?(.*)$', 1) as path from q
),
hosts as (select *, regexp_replace(regexp_replace(regexp_replace(site, '^.*@', ''), case when scheme = 'http' then ':80$' else ':443$' end, ''), '^www\.', '') as host from parts),
keyed as (
  select *, max(page_id) over (partition by payload_digest) as kept,
    case when contains(u, '://') then array_to_string(list_reverse(string_split(split_part(host, ':', 1), '.')), ',') || regexp_extract(host, ':.*$') || ')/' || path else u end as url_key from hosts
)
select page_id, payload_bytes, payload_digest, case when payload_bytes >= 1000 and page_id <> kept then 'revisit' else 'response' end as record_type,
  case when payload_bytes >= 1000 and page_id <> kept then kept end as refers_to, url_key, captured, row_number() over (order by url_key, captured, page_id) - 1 as index_pos
from keyed
"""

_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

DECONTAMINATION = f"""
with d as materialized (select doc_id, {_WORDS} as w from documents),
b as (select item_id, {_WORDS} as w from benchmark),
windows as materialized (
  select distinct item_id, n, array_to_string(w[i : i + n - 1], ' ') as s
  from (select item_id, w, least(len(w), 10) as n, unnest(range(1, len(w) - least(len(w), 10) + 2)) as i from b where len(w) > 0)
),
met as materialized (
  select doc_id, i, n, item_id
  from (select doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') as s from (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) as i from d, (select distinct n from windows) where len(w) >= n))
  join windows using (n, s)
),
hits as (select doc_id, count(distinct place)::bigint as n_hit from (select doc_id, unnest(range(i, i + n)) as place from met) group by doc_id),
items as (select doc_id, count(*)::bigint as n_items, string_agg(item, ',' order by item) as named from (select distinct doc_id, item_id::varchar as item from met) group by doc_id)
select doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, sha256(coalesce(named, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join hits using (doc_id) left join items using (doc_id)
"""


#: Every 50-byte string of every text in hexadecimal; what a smaller doc_id holds goes, overlapping or touching stretches are one run.
SUFFIX_DEDUP = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
n AS (SELECT doc_id, h, (length(h) // 2)::BIGINT AS n FROM d),
c AS (SELECT doc_id, unnest(range(0, greatest(n - 49, 0), 512)) AS c, n, h FROM n),
w AS (SELECT doc_id, c, range(0, least(512, n - 49 - c)) AS j, substring(h, 2 * c + 1, 1122) AS h FROM c),
s AS MATERIALIZED (SELECT doc_id, c + unnest(j) AS i, unnest(list_transform(j, lambda k: md5(substring(h, 2 * k + 1, 100)))) AS s FROM w),
first AS (SELECT s, min(doc_id) AS low FROM s GROUP BY s HAVING min(doc_id) < max(doc_id)),
hit AS (SELECT s.doc_id, s.i FROM s JOIN first USING (s) WHERE s.doc_id > first.low),
mark AS (SELECT doc_id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 50 THEN 0 ELSE 1 END AS new FROM hit),
run AS (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS r FROM mark),
cut AS (SELECT doc_id, r, min(i) AS a, max(i) + 50 AS b FROM run GROUP BY doc_id, r),
piece AS (
  SELECT n.doc_id, cut.a AS pos, substring(n.h, 2 * coalesce(lag(cut.b) OVER (PARTITION BY n.doc_id ORDER BY cut.a), 0) + 1, 2 * (cut.a - coalesce(lag(cut.b) OVER (PARTITION BY n.doc_id ORDER BY cut.a), 0))) AS t
  FROM cut JOIN n USING (doc_id)
  UNION ALL SELECT n.doc_id, n.n + 1, substring(n.h, 2 * coalesce(e.b, 0) + 1) FROM n LEFT JOIN (SELECT doc_id, max(b) AS b FROM cut GROUP BY doc_id) AS e USING (doc_id)
),
kept AS (SELECT doc_id, string_agg(t, '' ORDER BY pos) AS t FROM piece GROUP BY doc_id),
gone AS (SELECT doc_id, sum(b - a)::BIGINT AS n_removed, count(*)::BIGINT AS n_spans FROM cut GROUP BY doc_id)
SELECT n.doc_id, n.n AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans, sha256(unhex(kept.t)) AS kept_sha256
FROM n JOIN kept USING (doc_id) LEFT JOIN gone USING (doc_id)
"""

#: Brute force over all pairs of usable vectors.
NEAREST = """
WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings),
u AS (
  SELECT vec_id, x FROM v
  WHERE x IS NOT NULL AND len(x) > 0 AND len(list_filter(x, lambda y: y IS NULL OR isnan(y) OR isinf(y))) = 0 AND len(list_filter(x, lambda y: y <> 0)) > 0
),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.x, c.x) AS score FROM u q JOIN u c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id AND len(q.x) = len(c.x)),
r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""

#: Words, 4-word shingles, their XXH64 and the majority of each bit; fingerprints at 4 or fewer differing bits, closed over steps.
SIMHASH = f"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents
),
g AS (
  SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) END) AS s FROM d
),
x AS (SELECT s, hex(encode(s)) AS x, octet_length(encode(s)) AS n FROM (SELECT DISTINCT s FROM g)),
k AS MATERIALIZED (SELECT s, {xxh64("x", "n")} AS h FROM x),
h AS (SELECT doc_id, h FROM g JOIN k USING (s)),
f AS (SELECT doc_id, {" + ".join(f"CASE WHEN 2 * sum((h >> {b}) & 1) > count(*) THEN {1 << b}::UBIGINT ELSE 0::UBIGINT END" for b in range(64))} AS fp FROM h GROUP BY doc_id),
p AS MATERIALIZED (SELECT d.doc_id, coalesce(f.fp, 0::UBIGINT) AS fp FROM d LEFT JOIN f USING (doc_id)),
u AS MATERIALIZED (SELECT fp, min(doc_id) AS least FROM p GROUP BY fp),
e AS MATERIALIZED (SELECT a.fp AS a, b.fp AS b FROM u a JOIN u b ON bit_count(xor(a.fp, b.fp)) <= 4),
r AS (SELECT fp AS fp, fp AS near FROM u UNION SELECT r.fp, e.b FROM r JOIN e ON e.a = r.near),
c AS (SELECT r.fp, min(u.least) AS component_id FROM r JOIN u ON u.fp = r.near GROUP BY r.fp)
SELECT p.doc_id, lower(lpad(hex(p.fp), 16, '0')) AS fingerprint, c.component_id FROM p JOIN c USING (fp)
"""

"""DuckDB SQL for the queries that SQL can state."""

from .license_scan import license_sql

WARC = """
with p as (
  select page_id, url, octet_length(encode(coalesce(html, ''))) as payload_bytes, sha256(coalesce(html, '')) as payload_digest from pages),
f as (select payload_digest, min(page_id) as first_id from p where payload_bytes >= 100 group by payload_digest)
select page_id, cast(payload_bytes as bigint) as payload_bytes, payload_digest,
  case when payload_bytes >= 100 and page_id > first_id then 'revisit' else 'response' end as record_type,
  case when payload_bytes >= 100 and page_id > first_id then first_id end as refers_to, coalesce(url, '') as target_uri, true as payload_ok
from p left join f using (payload_digest)
"""

TOP_K = """
with v as (
  select vec_id, list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) as v from embeddings
  where embedding is not null and vec_id is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (
  select q.vec_id as query_id, c.vec_id, cast(list_inner_product(cast(q.v as double[]), cast(c.v as double[])) as bigint) as score
  from v q join v c on q.vec_id % 50 = 0 and q.vec_id <> c.vec_id),
r as (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s)
select query_id, cast(rank as int) as rank, vec_id, score from r where rank <= 5
"""

NEAR_DUPLICATES = """
with recursive d as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') as w from documents),
s as (
  select doc_id, case when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')]
    else list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) end as sh from d),
n as (select doc_id, cast(len(sh) as bigint) as n from s),
f as (select doc_id, unnest(sh) as x from s),
m as (select a.doc_id as a, b.doc_id as b, count(*) as n_shared from f a join f b on a.x = b.x and a.doc_id < b.doc_id group by 1, 2),
l as (select a, b from m join n na on na.doc_id = a join n nb on nb.doc_id = b where 100 * n_shared >= 75 * (na.n + nb.n - n_shared)),
e as (select a, b from l union all select b, a from l),
r(doc_id, other) as (select doc_id, doc_id from n union select r.doc_id, e.b from r join e on e.a = r.other)
select n.doc_id, n.n as n_shingles, c.component_id, n.doc_id = c.component_id as kept
from n join (select doc_id, min(other) as component_id from r group by doc_id) c using (doc_id)
"""

ORACLES: dict[str, str] = {"op1_warc_revisits": WARC, "op2_license_scan": license_sql(), "op9_exact_topk": TOP_K, "op10_minhash_odd_sketch": NEAR_DUPLICATES}

"""The SQL that the text operators' queries are checked against, where SQL can express them.

``op1``, ``op7``, ``op10`` and the pipeline need tokenizers or 64-bit hashes that SQL doesn't have; their tests compare with plain Python.
"""

from __future__ import annotations

from quire.llm import quality, queries, url_filter

_B = r" \t\n\x0B\f\r"

OP2 = f"""
WITH r AS (
  SELECT doc_id, coalesce(strlen(text), 0)::BIGINT AS bytes,
         CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) AS h
  FROM documents),
s AS (
  SELECT k, h >> (60 - k) AS a, sum(bytes)::BIGINT AS shard_bytes, count(*) AS shard_docs
  FROM r, (SELECT unnest(range(0, 41)) AS k) GROUP BY ALL HAVING sum(bytes) <= {queries.SHARD_BYTES}),
leaf AS (
  SELECT r.*, s.k, s.shard_bytes, s.shard_docs,
         row_number() OVER (PARTITION BY doc_id ORDER BY s.k) AS turn
  FROM r JOIN s ON h >> (60 - k)::INTEGER = a)
SELECT doc_id, bytes, CASE WHEN k = 0 THEN '' ELSE lpad(bin(h >> (60 - k)), k::INTEGER, '0') END AS shard,
       k::INTEGER AS depth, shard_bytes, shard_docs
FROM leaf WHERE turn = 1
"""


def _vote(r: quality.Rule) -> str:
    ratio = f"({r.value} / {r.base}::DOUBLE)"
    return f"CASE WHEN {r.base} < {r.least} THEN 0 WHEN {ratio} >= {r.bad} THEN -1 WHEN {ratio} <= {r.good} THEN 1 ELSE 0 END"


_N = len(quality.RULES)
_P = (
    "(1 / (1 + exp(-(ln(share / (1 - share)) + list_sum(list_transform(range(1, {n}), lambda j: "
    "CASE {v}[j] WHEN 1 THEN ln(good[j] / (1 - bad[j])) WHEN -1 THEN ln((1 - good[j]) / bad[j]) ELSE 0.0 END))))))"
).replace("{n}", str(_N + 1))


def _rate(vote: int, mass: str, start: float) -> str:
    def total(which: str) -> str:
        return f"coalesce(list_sum(list_transform(w, lambda x: CASE WHEN x.v[j] {which} THEN x.n * {mass} ELSE 0.0 END)), 0.0)"

    s = quality.SEEN
    return f"list_transform(range(1, {_N + 1}), lambda j: ({total(f'= {vote}')} + {s * start}) / ({total('<> 0')} + {s}))"


OP3 = f"""
WITH RECURSIVE t AS (
  SELECT doc_id, coalesce(text, '') AS x, regexp_extract_all(coalesce(text, ''), '[^{_B}]+') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^{_B}]')) AS l
  FROM documents),
places AS (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM t),
twice AS (SELECT doc_id, i FROM places QUALIFY count(*) OVER (PARTITION BY doc_id, w[i : i + 2]) > 1),
again AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM twice) GROUP BY 1),
s AS (
  SELECT t.doc_id, len(w)::BIGINT AS n_words, length(regexp_replace(x, '[{_B}]+', '', 'g'))::BIGINT AS word_chars,
         length(regexp_replace(x, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols,
         (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(again.n, 0)::BIGINT AS n_repeat_words,
         len(l)::BIGINT AS n_lines, length(regexp_replace(x, '[^A-Z]+', '', 'g'))::BIGINT AS n_capitals,
         (len(w) - len(list_distinct(w)))::BIGINT AS n_same_words,
         length(regexp_replace(x, '[{_B}\\p{{L}}]+', '', 'g'))::BIGINT AS n_marks
  FROM t LEFT JOIN again USING (doc_id)),
j AS MATERIALIZED (SELECT *, [{", ".join(_vote(r) for r in quality.RULES)}] AS v FROM s),
seen AS MATERIALIZED (SELECT list({{'v': v, 'n': n}} ORDER BY v) AS p FROM (SELECT v, count(*)::DOUBLE AS n FROM j GROUP BY 1)),
em(turn, share, good, bad) AS (
  SELECT 0, {quality.PRIOR_GOOD}::DOUBLE, list_transform(range({_N}), lambda i: {quality.GOOD_KNOWN}::DOUBLE),
         list_transform(range({_N}), lambda i: {quality.BAD_KNOWN}::DOUBLE)
  UNION ALL
  SELECT turn + 1,
         (list_sum(list_transform(w, lambda x: x.n * x.p)) + {quality.SEEN * quality.PRIOR_GOOD}) / (list_sum(list_transform(w, lambda x: x.n)) + {quality.SEEN}),
         {_rate(1, "x.p", quality.GOOD_KNOWN)}, {_rate(-1, "(1 - x.p)", quality.BAD_KNOWN)}
  FROM (SELECT turn, list_transform(p, lambda y: {{'v': y.v, 'n': y.n, 'p': {_P.replace("{v}", "y.v")}}}) AS w FROM em, seen WHERE turn < {quality.ROUNDS})),
last AS (SELECT share, good, bad FROM em WHERE turn = {quality.ROUNDS})
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND {_P.replace("{v}", "v")} >= 0.5 AS kept
FROM j, last
"""

OP4 = f"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^{_B}]+'))::BIGINT AS size,
         md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS turn FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY 1),
w AS (
  SELECT *, source_size * 2.0::DOUBLE AS cap, sum(source_size) OVER () * 1.5::DOUBLE AS budget,
         ([5.0, 2.0, 1.0])[1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3]::DOUBLE AS weight FROM s),
f AS (SELECT *, cap / weight AS full_at, row_number() OVER (ORDER BY cap / weight, source NULLS LAST) AS i FROM w),
l AS (
  SELECT *, (budget - coalesce(sum(cap) OVER (ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
            / sum(weight) OVER (ORDER BY i DESC ROWS UNBOUNDED PRECEDING) AS level FROM f),
g AS (SELECT *, min_by(level, i) FILTER (WHERE level < full_at) OVER () AS common FROM l),
goal AS (SELECT source, source_size, CASE WHEN common IS NULL THEN cap ELSE least(cap, common * weight) END AS target, floor(budget)::BIGINT AS budget FROM g),
q AS (
  SELECT d.*, source_size, target, budget,
         (sum(size) OVER (PARTITION BY d.source ORDER BY turn, size, doc_id ROWS UNBOUNDED PRECEDING))::BIGINT AS given
  FROM d JOIN goal ON d.source IS NOT DISTINCT FROM goal.source),
c AS (
  SELECT *, least(greatest(floor(target)::BIGINT - (copy * source_size + given - size), 0), size) AS share,
         CASE WHEN target = 0 THEN 0.0 ELSE (copy * source_size + given) / target END AS finish
  FROM q, (SELECT unnest([0, 1]) AS copy)),
t AS (SELECT *, (sum(share) OVER (ORDER BY finish, doc_id, copy ROWS UNBOUNDED PRECEDING))::BIGINT AS total FROM c)
SELECT doc_id, any_value(size) AS size, any_value(source_size) AS source_size, any_value(target) AS target,
       sum(greatest(least(budget - total + share, share), 0))::BIGINT AS taken
FROM t GROUP BY doc_id
"""


def _op5() -> str:
    host = "coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), '')"
    lower = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    rules = sorted(queries.RULES, key=lambda r: -len(r.name))
    fits = [f"(host = '{r.host}' OR host LIKE '%.{r.host}') AND starts_with(path, '{r.path}')" for r in rules]
    case = lambda value: "CASE " + " ".join(f"WHEN {f} THEN '{value(r)}'" for f, r in zip(fits, rules)) + " END"
    d = url_filter.DAMPING
    turns = ["rank0 AS (SELECT kind, host, seed AS rank FROM seeds)"]
    for i in range(url_filter.ROUNDS):
        turns.append(
            f"rank{i + 1} AS MATERIALIZED (SELECT kind, host, sum(rank) AS rank FROM (SELECT kind, host, {1 - d} * seed AS rank FROM seeds UNION ALL "
            f"SELECT e.kind, e.dst, {d} * rank * share FROM rank{i} r JOIN edges e ON r.kind = e.kind AND r.host = e.src) GROUP BY ALL)"
        )
    return f"""
WITH u AS (
  SELECT page_id, {lower.format(host)} AS host,
         coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path, html FROM pages),
r AS (SELECT page_id, host, path, {case(lambda r: r.name)} AS rule, {case(lambda r: r.verdict)} AS verdict FROM u),
hosts AS (
  SELECT host, avg((coalesce(verdict, '') = 'allow')::INTEGER) AS trust, avg((coalesce(verdict, '') = 'block')::INTEGER) AS distrust
  FROM r GROUP BY 1),
seeds AS (
  SELECT 'trust' AS kind, host, trust AS seed FROM hosts WHERE trust > 0
  UNION ALL SELECT 'distrust', host, distrust FROM hosts WHERE distrust > 0),
hrefs AS (SELECT host AS src, unnest(regexp_extract_all(html, '(?i)href\\s*=\\s*["'']?\\s*((?:[a-z][a-z0-9+.-]*:)?//[^"''\\s>/?#]+)', 1)) AS a FROM u),
links AS (SELECT src, {lower.format("regexp_extract(a, '//(.*)$', 1)")} AS dst FROM hrefs),
counted AS (SELECT src, dst, count(*) AS n FROM links WHERE dst <> '' AND src <> dst GROUP BY ALL),
both_ways AS (SELECT 'trust' AS kind, src, dst, n FROM counted UNION ALL SELECT 'distrust', dst, src, n FROM counted),
edges AS MATERIALIZED (SELECT kind, src, dst, n / sum(n) OVER (PARTITION BY kind, src) AS share FROM both_ways),
{", ".join(turns)},
scores AS (
  SELECT host, coalesce(sum(rank) FILTER (WHERE kind = 'trust'), 0) AS trust, coalesce(sum(rank) FILTER (WHERE kind = 'distrust'), 0) AS distrust
  FROM rank{url_filter.ROUNDS} GROUP BY 1)
SELECT page_id, r.host, path, rule,
       coalesce(verdict, CASE WHEN coalesce(distrust, 0) > {url_filter.MARGIN} * coalesce(trust, 0) THEN 'block' ELSE 'allow' END) AS verdict
FROM r LEFT JOIN scores s ON r.host = s.host
"""


_ESC = "replace({}, '\\', '\\\\')"
for _c in ("<turn", "</turn", '">'):
    _ESC = f"replace({_ESC}, '{_c}', '{_c[0]}\\{_c[1:]}')"

OP6 = f"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\\### Assistant: </turn> ok'),
o AS (
  SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS before,
         lead(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS after FROM t),
g AS (
  SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS whole,
         coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, text), '') AS learnt,
         sum(length('<turn role="' || {_ESC.format("role")} || '">' || chr(10) || {_ESC.format("text")} || '</turn>' || chr(10)))::BIGINT AS formatted_chars,
         bool_and(CASE role WHEN 'system' THEN before IS NULL WHEN 'user' THEN before IS NULL OR before IN ('system', 'assistant')
                            WHEN 'assistant' THEN before IS NOT DISTINCT FROM 'user' ELSE false END AND (after IS NOT NULL OR role = 'assistant')) AS valid
  FROM o GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(whole) AS turns_sha256, length(learnt)::BIGINT AS loss_chars, sha256(learnt) AS loss_sha256, formatted_chars, valid
FROM g
"""

OP8 = """
WITH p AS (
  SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS sha FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY sha, payload_bytes) AS first FROM p)
SELECT page_id, payload_bytes,
       list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         1 + ((CAST('0x' || substr(sha, 1 + 5 * (i // 4)::INTEGER, 5) AS INTEGER) >> (15 - 5 * (i % 4))::INTEGER) & 31)::INTEGER, 1)), 'string_agg', '') AS payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to
FROM f
"""

OP9 = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score,
         row_number() OVER (PARTITION BY q.vec_id ORDER BY list_inner_product(q.v, c.v) DESC, c.vec_id) AS rank
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0)
WHERE rank <= 5
"""

ORACLES: dict[str, str] = {
    "op2_shards": OP2, "op3_quality": OP3, "op4_mixing": OP4, "op5_urls": _op5(), "op6_chat": OP6, "op8_warc": OP8, "op9_topk": OP9,
}

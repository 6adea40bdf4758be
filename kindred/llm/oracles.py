"""DuckDB SQL that gives the rows of the queries, where SQL can express them."""

from __future__ import annotations

import public_tokenizers

from .importance import BUCKETS, LEAST_WORDS, PERCENT
from .importance import SEED as SAMPLE_SEED
from .sharding import SEED
from .url_filter import ADDRESS, LOWER, RULES, SUFFIXES, THRESHOLD, UPPER, Z

OP1 = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS q FROM embeddings),
a AS (SELECT vec_id, min(q) AS q FROM v WHERE vec_id % 50 = 0 GROUP BY vec_id),
s AS (SELECT a.vec_id AS query_id, b.vec_id, list_sum(list_transform(list_zip(a.q, b.q), lambda p: p[1] * p[2]))::BIGINT AS score
      FROM a JOIN v b ON a.vec_id <> b.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INT AS rank, vec_id, score FROM r WHERE rank <= 5
"""

OP5 = """
WITH RECURSIVE v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS x FROM embeddings),
n AS (SELECT vec_id, x, sqrt(list_sum(list_transform(x, lambda c: c * c))) AS norm FROM v),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM n a JOIN n b ON a.vec_id <> b.vec_id
      AND list_sum(list_transform(list_zip(a.x, b.x), lambda p: p[1] * p[2])) / (a.norm * b.norm) >= 0.95),
reach(a, b) AS (SELECT vec_id, vec_id FROM v UNION SELECT r.a, l.b FROM reach r JOIN l ON r.b = l.a),
c AS (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a),
k AS (SELECT a AS vec_id, count(*) AS n_links FROM l GROUP BY a)
SELECT vec_id, coalesce(n_links, 0) AS n_links, component_id, vec_id = component_id AS kept FROM c LEFT JOIN k USING (vec_id)
"""


def _crc_table() -> list[int]:
    def entry(c):
        for _ in range(8):
            c = c >> 1 ^ (0xEDB88320 if c & 1 else 0)
        return c
    return [entry(i) for i in range(256)]


def _bits32(text: str) -> str:
    return f"('0x' || substr(md5({text}), 1, 8))::BIGINT"


OP6 = f"""
WITH t AS (SELECT {_crc_table()}::BIGINT[] AS crc),
d AS (SELECT doc_id, source, coalesce(text, '') AS text FROM documents),
b AS (SELECT doc_id, source, octet_length(encode(text)) + 8 AS size,
             list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda h: ('0x' || h)::BIGINT) AS bytes FROM d),
s AS (SELECT doc_id, source, size::BIGINT AS size,
             xor(list_reduce(list_prepend(4294967295::BIGINT, bytes), lambda c, x: xor(c >> 8, crc[(xor(c, x) & 255) + 1])), 4294967295::BIGINT) AS text_crc32,
             CASE WHEN source IS NULL THEN '-' ELSE '+' || source END AS stratum, md5('{SEED}:' || doc_id) AS mix FROM b, t),
f AS (SELECT *, ((row_number() OVER (PARTITION BY stratum ORDER BY mix, doc_id) - 1)::DOUBLE
                 + ({_bits32(f"'{SEED}:' || stratum")}::DOUBLE + 0.5::DOUBLE) / 4294967296.0::DOUBLE) / (count(*) OVER (PARTITION BY stratum))::DOUBLE AS frac FROM s),
p AS (SELECT *, row_number() OVER (ORDER BY frac, stratum, mix, doc_id) - 1 AS place, count(*) OVER () AS n FROM f),
c AS (SELECT *, place * 24 // n AS shard FROM p)
SELECT doc_id, size, text_crc32, 'rows' AS law, shard::INT AS shard, (place - (shard * n + 23) // 24)::BIGINT AS slot, NULL::INT AS grown_shard, source FROM c
"""

_RULES = sorted(RULES, key=lambda r: -len(r[1]) - len(r[2]))


def _rule_case(out) -> str:
    return "CASE " + " ".join(f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{out(w, h, p)}'"
                              for w, h, p in _RULES) + " END"


def _level(key: str, parent: str) -> str:
    return f"""
own_{key} AS (SELECT {key}, {parent}, sum(k) AS k, sum(n) AS n FROM hosts GROUP BY {key}, {parent}),
mu_{key} AS (SELECT {parent}, sum(k)::DOUBLE / sum(n) AS mu FROM own_{key} GROUP BY {parent}),
m_{key} AS (SELECT sum(n * pow(k::DOUBLE / n - mu, 2) - mu * (1 - mu)) AS over_, sum(mu * (1 - mu) * (n - 1)) AS room
            FROM own_{key} JOIN mu_{key} USING ({parent}) WHERE n > 0),
w_{key} AS (SELECT round(1 / least(greatest(CASE WHEN room <> 0 THEN over_ / room ELSE 0.1 END, 0.001), 0.5) - 1, 3) AS m FROM m_{key})"""


OP7 = f"""
WITH u AS (SELECT page_id, substr(url, instr(url, '://') + 3) AS rest, coalesce(contains(url, '://'), false) AS known FROM pages),
hp AS (SELECT page_id, CASE WHEN known THEN translate(regexp_extract(rest, '^([^/?#]*)', 1), '{UPPER}', '{LOWER}') ELSE '' END AS host,
              CASE WHEN known THEN regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) ELSE '' END AS path FROM u),
o AS (SELECT doc_id AS page_id, CASE WHEN toxic = 1 OR quality = 0 THEN 0 WHEN toxic = 0 AND quality = 1 THEN 1 END AS good FROM labels),
s AS (SELECT page_id, sum(good) AS k, count(good) AS n FROM o GROUP BY page_id),
hc AS (SELECT host, coalesce(sum(k), 0)::BIGINT AS k, coalesce(sum(n), 0)::BIGINT AS n,
              regexp_replace(regexp_replace(regexp_replace(host, '^.*@', ''), ':[0-9]*$', ''), '\\.$', '') AS name FROM hp LEFT JOIN s USING (page_id) GROUP BY host),
hl AS (SELECT *, regexp_matches(name, '{ADDRESS}') AS address, regexp_extract(name, '([^.]*\\.)?[^.]*$', 0) AS two FROM hc),
hosts AS (SELECT host, k, n, CASE WHEN address THEN name WHEN two IN {SUFFIXES} THEN regexp_extract(name, '([^.]*\\.)?([^.]*\\.)?[^.]*$', 0) ELSE two END AS domain,
                 CASE WHEN address THEN 'address' WHEN two IN {SUFFIXES} THEN two ELSE regexp_extract(name, '[^.]*$', 0) END AS suffix, 0 AS top FROM hl),
{_level("host", "domain")},{_level("domain", "suffix")},{_level("suffix", "top")},
p0 AS (SELECT (coalesce(sum(k), 0) + 1)::DOUBLE / (coalesce(sum(n), 0) + 2) AS p FROM hosts),
sx AS (SELECT suffix, (k + m * p) / (n + m) AS ps FROM own_suffix, w_suffix, p0),
dx AS (SELECT domain, (k + m * ps) / (n + m) AS pd FROM own_domain JOIN sx USING (suffix), w_domain),
hx AS (SELECT host, k + m * pd AS a, n - k + m * (1 - pd) AS b FROM own_host JOIN dx USING (domain), w_host),
j AS (SELECT host, a / (a + b) - {Z} * sqrt(a * b / (pow(a + b, 2) * (a + b + 1))) AS bound FROM hx)
SELECT page_id, host, path, {_rule_case(lambda w, h, p: h + p)} AS rule,
       coalesce({_rule_case(lambda w, h, p: w)}, CASE WHEN bound >= {THRESHOLD} THEN 'allow' ELSE 'block' END) AS verdict,
       round(bound, 6) AS reputation FROM hp JOIN j USING (host)
"""

OP9 = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
u AS (SELECT doc_id, generate_subscripts(w, 1) AS pos, unnest(w) AS word FROM d),
s AS (SELECT doc_id, pos, string_agg(word, ' ') OVER o AS key, count(*) OVER o AS n FROM u
      WINDOW o AS (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 19 FOLLOWING)),
r AS (SELECT doc_id, pos, row_number() OVER (PARTITION BY key ORDER BY doc_id, pos) AS seen FROM s WHERE n = 20),
gone AS (SELECT DISTINCT doc_id, unnest(range(pos, pos + 20)) AS pos FROM r WHERE seen > 1),
k AS (SELECT doc_id, count(*) AS n_kept, string_agg(word, ' ' ORDER BY pos) AS kept FROM u ANTI JOIN gone USING (doc_id, pos) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, len(w)::BIGINT - coalesce(n_kept, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN k USING (doc_id)
"""

#: Fixed values of the XXH64 specification.
P1, P2, P3, P4, P5 = 11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261
SEED64 = 42


def _low(x: str) -> str:
    return f"(({x}) % 18446744073709551616::UHUGEINT)"


def _num(x: int) -> str:
    return f"{x % 2**64}::UHUGEINT"


def _times(x: str, p: int) -> str:
    return _low(f"({x}) * {_num(p)}")


def _turn(x: str, r: int) -> str:
    return f"({_times(x, 1 << r)} + ({x}) // {_num(1 << (64 - r))})"


def _lane(at: str, size: int) -> str:
    """The little-endian number of ``size`` bytes from byte ``at`` of the hexadecimal text h."""
    return "('0x' || " + " || ".join(f"substr(h, 2 * ({at}) + {2 * k + 1}, 2)" for k in reversed(range(size))) + ")::UBIGINT::UHUGEINT"


def _round(v: str, lane: str) -> str:
    return _times(_turn(f"{_low(f'{v} + {_times(lane, P2)}')}", 31), P1)


def _xor(a: str, b: str) -> str:
    return f"xor(({a})::UBIGINT, ({b})::UBIGINT)::UHUGEINT"


def _merged() -> str:
    h = _low(f"{_turn('v1', 1)} + {_turn('v2', 7)} + {_turn('v3', 12)} + {_turn('v4', 18)}")
    for v in ("v1", "v2", "v3", "v4"):
        h = _low(f"{_times(_xor(h, _round('0::UHUGEINT', v)), P1)} + {_num(P4)}")
    return h


OP10 = rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sh AS (SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
       ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS s FROM d),
x AS (SELECT s, hex(encode(s)) AS h, octet_length(encode(s)) AS n FROM (SELECT DISTINCT s FROM sh)),
lanes(s, h, n, pos, v1, v2, v3, v4) AS (
  SELECT s, h, n, 0::BIGINT, {_num(SEED64 + P1 + P2)}, {_num(SEED64 + P2)}, {_num(SEED64)}, {_num(SEED64 - P1)} FROM x
  UNION ALL SELECT s, h, n, pos + 32, {_round('v1', _lane('pos', 8))}, {_round('v2', _lane('pos + 8', 8))}, {_round('v3', _lane('pos + 16', 8))}, {_round('v4', _lane('pos + 24', 8))}
  FROM lanes WHERE n - pos >= 32),
m AS (SELECT s, h, n, pos, CASE WHEN n >= 32 THEN {_merged()} ELSE {_num(SEED64 + P5)} END AS a FROM lanes WHERE n - pos < 32),
tail(s, h, n, pos, a) AS (
  SELECT s, h, n, pos, {_low('a + n::UHUGEINT')} FROM m
  UNION ALL SELECT s, h, n, pos + CASE WHEN n - pos >= 8 THEN 8 WHEN n - pos >= 4 THEN 4 ELSE 1 END,
    CASE WHEN n - pos >= 8 THEN {_low(_times(_turn(_xor('a', _round('0::UHUGEINT', _lane('pos', 8))), 27), P1) + ' + ' + _num(P4))}
         WHEN n - pos >= 4 THEN {_low(_times(_turn(_xor('a', _times(_lane('pos', 4), P1)), 23), P2) + ' + ' + _num(P3))}
         ELSE {_times(_turn(_xor('a', _times(_lane('pos', 1), P5)), 11), P1)} END
  FROM tail WHERE n > pos),
f1 AS (SELECT s, {_times(_xor('a', f'a // {_num(1 << 33)}'), P2)} AS a FROM tail WHERE n = pos),
f2 AS (SELECT s, {_times(_xor('a', f'a // {_num(1 << 29)}'), P3)} AS a FROM f1),
hs AS (SELECT s, {_xor('a', f'a // {_num(1 << 32)}')}::UBIGINT AS a FROM f2),
p AS (SELECT doc_id, count(*) AS n, {", ".join(f"sum(a >> {i} & 1) AS s{i}" for i in range(64))} FROM sh JOIN hs USING (s) GROUP BY doc_id),
fp AS (SELECT doc_id, coalesce({" + ".join(f"(CASE WHEN 2 * s{i} > n THEN {1 << i}::UBIGINT ELSE 0::UBIGINT END)" for i in range(64))}, 0::UBIGINT) AS f FROM d LEFT JOIN p USING (doc_id)),
k AS (SELECT f, min(doc_id) AS id FROM fp GROUP BY f),
e AS (SELECT a.id AS a, b.id AS b FROM k a JOIN k b ON bit_count(xor(a.f, b.f)) <= 3),
r(a, b) AS (SELECT id, id FROM k UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
c AS (SELECT a AS id, min(b) AS component_id FROM r GROUP BY a)
SELECT doc_id, format('{{:016x}}', f) AS fingerprint, component_id FROM fp JOIN k USING (f) JOIN c USING (id)
"""

OP4 = rf"""
WITH RECURSIVE v AS (SELECT hex(from_base64(token)) AS h FROM read_csv('{public_tokenizers.path("byte_bpe_50k.tiktoken")}', delim=' ', header=false,
                     columns={{'token': 'VARCHAR', 'rank': 'INT'}}, auto_detect=false, quote='', escape='')),
l AS (SELECT DISTINCT length(h) AS size FROM v),
d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^ 	-
]+') AS w FROM documents),
x AS (SELECT word, hex(encode(' ' || word)) AS h FROM (SELECT DISTINCT unnest(w) AS word FROM d)),
g(word, h, place, n) AS (SELECT word, h, 0::BIGINT, 0::BIGINT FROM x UNION ALL
  SELECT g.word, g.h, place + max(size), n + 1 FROM g JOIN l ON size <= length(g.h) - place JOIN v ON v.h = substr(g.h, place + 1, size) GROUP BY g.word, g.h, place, n),
c AS (SELECT word, max(n) AS n FROM g GROUP BY word),
t AS (SELECT doc_id, sum(n)::BIGINT AS n FROM (SELECT doc_id, unnest(w) AS word FROM d) JOIN c USING (word) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_tokens, 0::BIGINT AS n_unknown FROM d LEFT JOIN t USING (doc_id)
"""

#: The pattern's white space, which RE2 has no name for, and a mark that stands where a run of it is cut: before its
#: last character if text follows. RE2 can't look ahead, so the mark is put there first; no text holds it.
WHITE, MARK = r"[\t-\r\x{85}\p{Z}]", "\uE000"
PIECE = (r"''s|''t|''re|''ve|''m|''ll|''d| ?\p{L}+| ?\p{N}+| ?[^\t-\r\x{85}\p{Z}\p{L}\p{N}\x{E000}]+|" + WHITE + "+")

OP2 = rf"""
WITH RECURSIVE v AS (SELECT hex(from_base64(token)) AS h, rank FROM read_csv('{public_tokenizers.path("byte_bpe_50k.tiktoken")}', delim=' ', header=false,
                     columns={{'token': 'VARCHAR', 'rank': 'INT'}}, auto_detect=false, quote='', escape='')),
cut AS (SELECT h, rank, unnest(range(2, length(h), 2)) AS k FROM v WHERE length(h) > 2),
merges AS MATERIALIZED (SELECT l.rank::BIGINT << 32 | r.rank AS pair, cut.rank AS merged FROM cut JOIN v l ON l.h = substr(cut.h, 1, k) JOIN v r ON r.h = substr(cut.h, k + 1)),
d AS (SELECT doc_id, regexp_extract_all(regexp_replace(coalesce(text, ''), '({WHITE})({WHITE})([^\t-\r\x{{85}}\p{{Z}}])', '\1{MARK}\2\3', 'g'), '{PIECE}') AS w FROM documents),
u AS (SELECT doc_id, generate_subscripts(w, 1) AS place, unnest(w) AS word FROM d),
x AS MATERIALIZED (SELECT word, regexp_extract_all(hex(encode(word)), '..') AS b FROM (SELECT DISTINCT word FROM u)),
words AS MATERIALIZED (SELECT word, list(rank ORDER BY i) AS ids FROM (SELECT word, unnest(b) AS h, generate_subscripts(b, 1) AS i FROM x) JOIN v USING (h) GROUP BY word),
enc(word, ids) USING KEY (word) AS (
  SELECT word, ids FROM words
  UNION
  SELECT word, ids[:p - 1] || [merged] || ids[p + 2:] FROM (
    SELECT word, (best >> 32)::INT AS merged, best & 4294967295 AS p FROM (
      SELECT word, min(merged::BIGINT << 32 | pos) AS best
      FROM (SELECT word, unnest(ids) AS tok, unnest(ids[2:]) AS nxt, generate_subscripts(ids, 1) AS pos FROM enc)
      JOIN merges ON tok::BIGINT << 32 | nxt = pair GROUP BY word)
  ) JOIN enc USING (word)
),
o AS (SELECT doc_id, place, ids FROM u JOIN enc USING (word)),
t AS (SELECT doc_id, place, unnest(ids) AS id, generate_subscripts(ids, 1) AS pos FROM o),
g AS (SELECT doc_id, count(*) AS n, string_agg(id, ' ' ORDER BY place, pos) AS line, string_agg(h, '' ORDER BY place, pos) AS raw FROM t JOIN v ON v.rank = t.id GROUP BY doc_id)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_tokens, sha256(coalesce(line, '')) AS ids_sha256, sha256(unhex(coalesce(raw, ''))) AS decoded_sha256 FROM d LEFT JOIN g USING (doc_id)
"""

FEATURE = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

OP12 = f"""
WITH t AS (SELECT {_crc_table()}::BIGINT[] AS crc),
d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{FEATURE}') AS w FROM documents),
u AS (SELECT doc_id, unnest(w) AS word FROM d),
b AS (SELECT unnest(regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{FEATURE}')) AS word FROM benchmark),
x AS (SELECT word, list_transform(regexp_extract_all(hex(encode(word)), '..'), lambda h: ('0x' || h)::BIGINT) AS bytes FROM (SELECT word FROM u UNION SELECT word FROM b)),
k AS (SELECT word, xor(list_reduce(list_prepend(4294967295::BIGINT, bytes), lambda c, x: xor(c >> 8, crc[(xor(c, x) & 255) + 1])), 4294967295::BIGINT) % {BUCKETS} AS bucket FROM x, t),
s AS (SELECT bucket, count(*) AS s FROM u JOIN k USING (word) GROUP BY bucket),
a AS (SELECT bucket, count(*) AS t FROM b JOIN k USING (word) GROUP BY bucket),
n AS (SELECT (SELECT count(*) FROM u) AS all_s, (SELECT count(*) FROM b) AS all_t),
g AS (SELECT bucket, floor(1000 * ln((coalesce(t, 0)::DOUBLE + 1) * (all_s + {BUCKETS})::DOUBLE / ((s::DOUBLE + 1) * (all_t + {BUCKETS})::DOUBLE)))::BIGINT AS gain FROM s LEFT JOIN a USING (bucket), n),
m AS (SELECT doc_id, count(*) AS n_features, floor(sum(gain)::DOUBLE / count(*))::BIGINT AS weight FROM u JOIN k USING (word) JOIN g USING (bucket) GROUP BY doc_id),
f AS (SELECT doc_id, coalesce(n_features, 0)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight, {_bits32("").replace("md5()", f"sha256('{SAMPLE_SEED}:' || doc_id)")} AS h FROM d LEFT JOIN m USING (doc_id)),
z AS (SELECT *, weight + floor(-1000 * ln(-ln((h::DOUBLE + 0.5::DOUBLE) / 4294967296.0::DOUBLE)))::BIGINT AS score FROM f),
r AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, count(*) OVER () AS n FROM z WHERE n_features >= {LEAST_WORDS})
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= {PERCENT} * n // 100 THEN rank END::BIGINT AS rank FROM z LEFT JOIN r USING (doc_id)
"""

ORACLE_SQL = {"op2_bpe": OP2, "op10_simhash": OP10, "op12_importance": OP12, "op4_token_counts": OP4, "op1_exact_topk": OP1, "op5_embedding_dedup": OP5, "op6_sharding": OP6, "op7_url_filter": OP7, "op9_substring_dedup": OP9}

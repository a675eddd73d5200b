"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

import math

from .licenses import PHRASES, SPREAD, TELLING, TEMPLATES, THRESHOLD, template_words, words

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = rf"regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+')"

OP2 = rf"""
WITH RECURSIVE w AS (SELECT doc_id, {_WORDS} AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i+4], ' ') AS shingle
      FROM (SELECT doc_id, ws, unnest(range(1, greatest(2, len(ws) - 3))) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * common >= 85 * (x.n + y.n - common)),
reach(doc_id, other) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, l.b FROM reach r JOIN links l ON l.a = r.other),
c AS (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id)
SELECT c.doc_id, coalesce(n.n, 0) AS n_shingles, component_id, c.doc_id = component_id AS kept FROM c LEFT JOIN n USING (doc_id)
"""


def _seats(votes: str, group: str, key: str, vote: str, seats: str) -> str:
    """Quotas by highest quotients vote/(2k-1), all quotients ranked."""
    total = f"SELECT *, sum({vote}) OVER (PARTITION BY {group}) AS total FROM {votes}"
    each = f"SELECT *, unnest(range(1, CAST(ceil({vote} / greatest(total, 1e-300) * {seats}) AS BIGINT) + 3)) AS k FROM ({total})"
    ranked = f"SELECT *, row_number() OVER (PARTITION BY {group} ORDER BY {vote} / (2 * k - 1) DESC, {key}) AS r FROM ({each})"
    return f"SELECT {group}, {key}, count(*) AS quota FROM ({ranked}) WHERE r <= {seats} GROUP BY {group}, {key}"


OP6 = rf"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size, md5('17:' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS dice FROM documents),
n AS (SELECT greatest(1, CAST(ceil(count(*) / 512.0) AS BIGINT)) AS shards FROM documents),
e AS (SELECT d.*, source IS NULL AS s_null, coalesce(source, '') AS s, CAST('0x' || substr(dice, 1, 8) AS BIGINT) % (SELECT shards FROM n) AS shard FROM d),
src AS (SELECT *, row_number() OVER (ORDER BY s_null, s) - 1 AS rank FROM (SELECT s_null, s, CAST(sum(size) AS BIGINT) AS source_size FROM e GROUP BY s_null, s)),
w AS (SELECT *, CAST([3, 1, 2][1 + rank % 3] AS DOUBLE) AS weight, 2.0 * source_size AS cap FROM src),
f AS (SELECT *, 1.5 * sum(source_size) OVER () - coalesce(sum(cap) OVER b, 0) AS free, sum(weight) OVER () - coalesce(sum(weight) OVER b, 0) AS weights FROM w WINDOW b AS (ORDER BY cap / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
lv AS (SELECT arg_min(free / weights, cap / weight + rank * 1e-9) AS level FROM f WHERE cap > free / weights * weight),
t AS (SELECT rank, s_null, s, source_size, CASE WHEN level IS NULL THEN cap ELSE least(cap, CAST(level * weight AS DOUBLE)) END AS target, 0 AS one FROM f, lv),
t2 AS (SELECT *, CAST(floor(sum(target) OVER () / 64 + 0.5) AS BIGINT) AS blocks FROM t),
q1 AS ({_seats("t2", "one", "rank", "target", "blocks")}),
o AS (SELECT e.*, t2.rank, source_size, target, coalesce(q1.quota, 0) AS source_blocks, greatest(1, least((SELECT shards FROM n), source_size // 4096)) AS own_shards
      FROM e JOIN t2 ON e.s_null = t2.s_null AND e.s = t2.s LEFT JOIN q1 ON q1.rank = t2.rank),
g AS (SELECT *, shard % own_shards AS own, (shard % own_shards) % CAST(ceil(sqrt(own_shards)) AS BIGINT) AS grp FROM o),
by_own AS (SELECT rank, grp, own, any_value(target) AS target, any_value(source_blocks) AS source_blocks, sum(size) AS shard_size FROM g GROUP BY ALL),
by_grp AS (SELECT rank, grp, any_value(source_blocks) AS source_blocks, sum(shard_size) AS group_size FROM by_own GROUP BY ALL),
q2 AS ({_seats("by_grp", "rank", "grp", "group_size", "source_blocks")}),
v AS (SELECT b.*, coalesce(q2.quota, 0) AS group_blocks FROM by_own b LEFT JOIN q2 ON q2.rank = b.rank AND q2.grp = b.grp),
q3 AS ({_seats("v", "rank, grp", "own", "shard_size", "group_blocks")}),
w1 AS (SELECT v.*, least(coalesce(q3.quota, 0) * 64, 2 * shard_size) AS words FROM v LEFT JOIN q3 ON q3.rank = v.rank AND q3.grp = v.grp AND q3.own = v.own),
w2 AS (SELECT *, 2 * shard_size - words AS room, CAST(floor(target) AS BIGINT) - sum(words) OVER (PARTITION BY rank) AS rest FROM w1),
w3 AS (SELECT *, words + greatest(0, least(room, rest - coalesce(sum(room) OVER b, 0))) - greatest(0, least(words, -rest - coalesce(sum(words) OVER b, 0))) AS last FROM w2 WINDOW b AS (PARTITION BY rank ORDER BY grp, own ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
k AS (SELECT g.doc_id, g.size, g.source_size, g.target, w3.shard_size, w3.last AS words, sum(g.size) OVER (PARTITION BY g.rank, g.own ORDER BY substr(dice, 9, 24), g.doc_id, g.size ROWS UNBOUNDED PRECEDING) - g.size AS start
      FROM g JOIN w3 ON w3.rank = g.rank AND w3.own = g.own)
SELECT doc_id, size, CAST(source_size AS BIGINT) AS source_size, CAST(target AS DOUBLE) AS target, CAST(greatest(0, least(size, words - start)) + greatest(0, least(size, words - shard_size - start)) AS BIGINT) AS taken FROM k
"""

_LICENSE_WORDS = r"regexp_extract_all({}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


def _op10() -> str:
    found = []
    for phrase, label in PHRASES.items():
        test = " AND ".join(f"ws[i + {k + 1}] = '{w}'" for k, w in enumerate(phrase.split()))
        found.append(f"SELECT doc_id, i, '{label}' AS label FROM p WHERE {test}")
    listed = lambda some: "[" + ", ".join(f"'{x}'" for x in some) + "]"
    sides = ", ".join("('{}', {}, {}, {}, {})".format(label, listed(w.decode() for w in sorted(some)), math.ceil(THRESHOLD * len(some) - 1e-9), SPREAD * len(words(TEMPLATES[label])), listed(f" {x} " for x in TELLING[label])) for label, some in template_words(TEMPLATES).items())
    return rf"""
WITH w AS (SELECT doc_id, {_LICENSE_WORDS.format(_LOWER)} AS ws FROM documents),
p AS (SELECT doc_id, ws, unnest(range(len(ws))) AS i FROM w),
base AS ({" UNION ALL ".join(found)}),
b AS (SELECT doc_id, count(*) AS n_base, min(i) AS first_word, max(i) AS last_word, list(DISTINCT label) AS labels FROM base GROUP BY doc_id),
c AS (SELECT doc_id, ws, label, side, need, span, telling FROM w, (VALUES {sides}) AS t(label, side, need, span, telling) WHERE list_has_any(ws, side) AND len(list_intersect(ws, side)) >= need),
r AS (SELECT *, ' ' || array_to_string(ws[i:i + span - 1], ' ') || ' ' AS run FROM (SELECT *, unnest(range(1, len(ws) + 1)) AS i FROM c) WHERE list_contains(side, ws[i])),
m AS (SELECT doc_id, label, max(len(list_intersect(ws[i:i + span - 1], side))) AS n, any_value(need) AS need, any_value(len(side)) AS size FROM r WHERE len(list_filter(telling, lambda x: contains(run, x))) = len(telling) GROUP BY doc_id, label),
f AS (SELECT doc_id, list(DISTINCT label) AS labels, max(n / size) AS c FROM m WHERE n >= need GROUP BY doc_id)
SELECT w.doc_id, len(ws) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(array_to_string(list_sort(b.labels), ','), '') AS base_labels,
       array_to_string(list_sort(list_distinct(list_concat(coalesce(b.labels, []), coalesce(f.labels, [])))), ',') AS labels, CAST(greatest(CASE WHEN n_base > 0 THEN 1 ELSE 0 END, coalesce(f.c, 0)) AS DOUBLE) AS score
FROM w LEFT JOIN b USING (doc_id) LEFT JOIN f USING (doc_id)
"""


OP8 = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS body FROM pages),
q AS (SELECT page_id, octet_length(body) AS payload_bytes, sha1(body) AS payload_digest, count(*) OVER g AS n, max(page_id) OVER g AS keep
      FROM p WINDOW g AS (PARTITION BY sha1(body), octet_length(body)))
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 1000 AND n > 1 AND page_id <> keep THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND n > 1 AND page_id <> keep THEN keep END AS refers_to
FROM q
"""

OP11 = """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))
"""

#: CRC-32 of ASCII and Latin texts, a byte at a time: the table from its rule, then a fold over the bytes.
_CRC_TABLE = "crc_table AS (SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) AS c FROM (SELECT unnest(range(256)) AS i)))"


def _crc(text: str) -> str:
    """Of a text's UTF-8 bytes, with crc_table's t in reach."""
    hexes = f"hex(encode({text}))"
    each = f"list_transform(range(octet_length(encode({text}))), lambda k: CAST('0x' || substr({hexes}, 2 * k + 1, 2) AS BIGINT))"
    return f"xor(list_reduce(list_prepend(4294967295, {each}), lambda c, b: xor(c // 256, t[xor(c, b) % 256 + 1])), 4294967295)"


OP12 = rf"""
WITH RECURSIVE {_CRC_TABLE},
r AS (SELECT coalesce(CAST(doc_id AS VARCHAR), 'null') AS id, unnest(regexp_extract_all({_LOWER}, '[A-Za-zÀ-ÿ]+')) AS run FROM documents),
o AS (SELECT id, run, count(*) AS times FROM r WHERE length(run) >= 6 GROUP BY id, run),
h AS (SELECT run, times, {_crc("id || ':' || run")} AS h FROM o, crc_table),
v AS (SELECT CASE WHEN h % 199 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, CAST(sum(times) AS BIGINT) AS n FROM h GROUP BY 1),
w AS (SELECT word, n, length(word) AS l FROM v WHERE length(word) >= 6 AND n >= 5),
gaps AS (SELECT word, n, l, i, substr(word, 1, i - 1) || '_' || substr(word, i + 1) AS same, substr(word, 1, i - 1) || substr(word, i + 1) AS less FROM (SELECT *, unnest(range(1, l + 1)) AS i FROM w)),
near AS (SELECT a.word, b.word AS other, b.n AS other_n FROM gaps a JOIN gaps b ON a.same = b.same AND a.word <> b.word
         UNION SELECT a.word, b.word, b.n FROM gaps a JOIN w b ON a.less = b.word UNION SELECT b.word, a.word, a.n FROM gaps a JOIN w b ON a.less = b.word),
best AS (SELECT word, count(*) AS n_near, first(other ORDER BY other_n DESC, other) AS other, max(other_n) AS other_n FROM near GROUP BY word),
f AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN other_n >= 5 * w.n THEN other END AS form, CASE WHEN other_n >= 5 * w.n THEN other_n END AS form_n FROM w LEFT JOIN best USING (word)),
chain(word, last) AS (SELECT word, word FROM f UNION ALL SELECT c.word, f.form FROM chain c JOIN f ON f.word = c.last WHERE f.form IS NOT NULL)
SELECT f.word, f.form, c.last AS root, f.n, f.n_near, f.form_n FROM f JOIN chain c ON c.word = f.word JOIN f e ON e.word = c.last AND e.form IS NULL
"""


def _leaf(n_chars: str = "n_chars") -> str:
    each = [f"coalesce(octet_length(encode(CAST({x} AS VARCHAR))) || ':' || CAST({x} AS VARCHAR), '-')" for x in ("doc_id", "source", "lang", n_chars, "text")]
    return f"sha256({' || '.join(each)})"


def _levels(of: str, by: str) -> str:
    """All nodes above those of a table ({by}, pos, h, n): the levels of every group, a parent for every two."""
    pair = f"SELECT {by}, lvl, pos, h, n, lead(h) OVER (PARTITION BY {by} ORDER BY pos) AS h2 FROM {{0}} WHERE n > 1"
    return f"SELECT {by}, 0 AS lvl, pos, h, n FROM {of} UNION ALL SELECT {by}, lvl + 1, pos // 2, sha256(h || coalesce(h2, '')), (n + 1) // 2 FROM ({pair}) WHERE pos % 2 = 0"


OP13 = f"""
WITH RECURSIVE {_CRC_TABLE},
d AS (SELECT doc_id, coalesce('=' || lang, '') AS g, {_leaf()} AS leaf, {_leaf(f"CASE WHEN {_crc('CAST(doc_id AS VARCHAR)')} % 7 = 0 THEN n_chars + 1 ELSE n_chars END")} AS changed FROM documents, crc_table),
l AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, leaf AS h, count(*) OVER (PARTITION BY g) AS n FROM d),
low(g, lvl, pos, h, n) AS ({_levels("l", "g").format("low")}),
s AS (SELECT g, h, row_number() OVER (ORDER BY g) - 1 AS pos, count(*) OVER () AS n, 0 AS one FROM low WHERE n = 1),
high(one, lvl, pos, h, n) AS ({_levels("s", "one").format("high")}),
steps(g, doc_id, leaf, lvl, pos, n, f, proof) AS (
    SELECT g, doc_id, leaf, 0, pos, n, changed, '' FROM l
    UNION ALL SELECT t.g, doc_id, leaf, t.lvl + 1, t.pos // 2, (t.n + 1) // 2, sha256(CASE WHEN t.pos % 2 = 1 THEN coalesce(x.h, '') || f ELSE f || coalesce(x.h, '') END), proof || coalesce(x.h, '')
    FROM steps t LEFT JOIN low x ON x.g = t.g AND x.lvl = t.lvl AND x.pos = xor(t.pos, 1) WHERE t.n > 1),
more(g, doc_id, leaf, lvl, pos, n, f, proof) AS (
    SELECT t.g, doc_id, leaf, 0, s.pos, s.n, f, proof FROM steps t JOIN s ON s.g = t.g WHERE t.n = 1
    UNION ALL SELECT t.g, doc_id, leaf, t.lvl + 1, t.pos // 2, (t.n + 1) // 2, sha256(CASE WHEN t.pos % 2 = 1 THEN coalesce(x.h, '') || f ELSE f || coalesce(x.h, '') END), proof || coalesce(x.h, '')
    FROM more t LEFT JOIN high x ON x.lvl = t.lvl AND x.pos = xor(t.pos, 1) WHERE t.n > 1)
SELECT doc_id, leaf, s.h AS subroot, r.h AS root, sha256(proof) AS proof_sha256, f AS folded_root, f = r.h AS verified
FROM more JOIN s ON s.g = more.g, (SELECT h FROM high WHERE n = 1) r WHERE more.n = 1
"""

ORACLE_SQL = {"op2_minhash": OP2, "op6_mix": OP6, "op8_warc": OP8, "op10_licenses": _op10(), "op11_exact_dedup": OP11, "op12_spelling": OP12, "op13_merkle": OP13}

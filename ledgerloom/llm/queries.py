"""The registered queries of the training-data operators and their SQL."""

from __future__ import annotations

from .byte_bpe import round_trip_digest
from .common import read
from .decontaminate import contaminated
from .html_extract import extract_main_text
from .language_id import language_digest
from .lexical_search import ranked_search
from .line_dedup import dedup_digest
from .packing import pack
from .prefix_trie import conversation_trie
from .quality import quality_rules
from .secrets import BOUNDED, KINDS, SCOPE, STRONG, WEAK, secret_digest
from .simhash import near_duplicate_digest
from .suffix_dedup import remove_repeats
from .token_counts import token_counts

QUERIES = {
    "op1_quality_rules": lambda spark, d: quality_rules(read(spark, d, "documents")),
    "op2_line_dedup": lambda spark, d: dedup_digest(read(spark, d, "documents")),
    "op3_simhash_near_dedup": lambda spark, d: near_duplicate_digest(read(spark, d, "documents")),
    "op4_secret_scan": lambda spark, d: secret_digest(read(spark, d, "documents")),
    "op5_benchmark_decontamination": lambda spark, d: contaminated(read(spark, d, "documents"), read(spark, d, "benchmark")).drop("text_hash"),
    "op6_suffix_array_dedup": lambda spark, d: remove_repeats(read(spark, d, "documents")),
    "op7_language_id": lambda spark, d: language_digest(read(spark, d, "documents"), read(spark, d, "pages")),
    "op8_token_counts": lambda spark, d: token_counts(read(spark, d, "documents")),
    "op9_packing": lambda spark, d: pack(read(spark, d, "documents")),
    "op10_html_extraction": lambda spark, d: extract_main_text(read(spark, d, "pages")),
    "op11_conversation_trie": lambda spark, d: conversation_trie(read(spark, d, "conversations")),
    "op12_lexical_search": lambda spark, d: ranked_search(read(spark, d, "documents"), read(spark, d, "benchmark")),
    "op13_byte_bpe": lambda spark, d: round_trip_digest(read(spark, d, "documents")),
}

WORDS = r"list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '')"

OP1 = rf"""WITH d AS (SELECT doc_id, source, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, source, t, {WORDS} AS w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d),
x AS (SELECT doc_id, unnest(range(1, len(w) - 6)) AS i, w FROM w WHERE len(w) > 8),
s AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, array_to_string(w[i:i + 7], ' ')) AS n FROM x),
r AS (SELECT doc_id, least(8, coalesce(lead(i) OVER (PARTITION BY doc_id ORDER BY i) - i, 8)) AS k FROM s WHERE n > 1),
rep AS (SELECT doc_id, sum(k) AS n_repeat_words FROM r GROUP BY 1),
c AS (SELECT doc_id, coalesce(source, chr(0)) AS host, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars, CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
 CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words FROM w LEFT JOIN rep USING (doc_id)),
f AS (SELECT *, unnest(['short', 'long_words', 'short_words', 'symbols', 'dup_lines', 'repeats']) AS rule,
 unnest([n_words < 40, word_chars > 14 * n_words, 2 * word_chars < 5 * n_words, 5 * n_symbols > n_words, 10 * n_dup_lines > n_words, 5 * n_repeat_words > n_words]) AS fails FROM c),
h AS (SELECT host, rule, count(*) AS n, count(*) FILTER (fails) AS k FROM f GROUP BY ALL),
m AS (SELECT rule, avg(k / n) AS m, var_samp(k / n) AS v FROM h GROUP BY 1),
q AS (SELECT rule, m, greatest(coalesce(CASE WHEN v > 0 THEN m * (1 - m) / v - 1 END, 1.0), 1.0) AS a FROM m),
v AS (SELECT host, rule, (k + m * a) / (n + a) AS rate FROM h JOIN q USING (rule)),
b AS (SELECT doc_id, bool_or(fails AND rate > 0.5) AS host_failed FROM f JOIN v USING (host, rule) GROUP BY 1)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AS base_failed, host_failed,
 NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND NOT host_failed AS kept FROM c JOIN b USING (doc_id)"""

OP2 = r"""WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS pos FROM documents),
k AS (SELECT *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
f AS (SELECT key FROM k WHERE key <> '' GROUP BY 1 HAVING count(DISTINCT doc_id) >= 10)
SELECT doc_id, count(*) AS n_lines, count(f.key) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (f.key IS NULL), '')) AS kept_sha256 FROM k LEFT JOIN f ON k.key = f.key GROUP BY 1"""


def _secrets_sql() -> str:
    parts = []
    for kind, (pattern, group) in (STRONG | WEAK).items():
        n = KINDS.index(kind)
        p = pattern.replace("'", "''")
        p = f"(^|[^A-Za-z0-9]){p}" if kind in BOUNDED else p  # no look-behind here: the character before is part of the match
        least = {"assign": 6, "access": 20}.get(kind, 1)
        value = 2 if kind == "assign" else 0
        before = f"regexp_extract_all(t, '{p}', 1)" if kind in BOUNDED else "list_transform(m, lambda x: '')"
        parts.append(
            f"SELECT doc_id, {n} AS ord, '{kind}' AS kind, '{group}' AS class, s + length(b[i]) AS s, s + length(m[i]) AS e FROM (SELECT *, CAST(list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS BIGINT) AS s FROM ("
            f"SELECT doc_id, m, g, v, b, unnest(range(1, len(m) + 1)) AS i FROM (SELECT *, {before} AS b FROM (SELECT doc_id, t, regexp_extract_all(t, '{p}') AS m, regexp_extract_all(t, '{p}', {value}) AS v, string_split_regex(t, '{p}') AS g FROM d)))) WHERE length(v[i]) >= {least}"
        )
    strong = ", ".join(f"'{k}'" for k in STRONG)
    text = "string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, ord)"
    counts = ", ".join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k in STRONG)
    near = f"greatest(o.s, a.s) - least(o.e, a.e) BETWEEN 0 AND {SCOPE}"
    return f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), a AS ({" UNION ALL ".join(parts)}),
r AS (SELECT * FROM a WHERE kind IN ({strong}) OR EXISTS (SELECT 1 FROM a o WHERE o.doc_id = a.doc_id AND o.class <> a.class AND {near}))
SELECT doc_id, {counts}, sha256(coalesce({text} FILTER (kind IN ({strong})), '')) AS base_sha256, coalesce({text}, '') AS spans FROM d LEFT JOIN r USING (doc_id) GROUP BY doc_id"""


#: A prefix is the list of its turns; crc32 bit by bit.
OP11 = r"""WITH t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS p, {'role': coalesce(role, ''), 'text': coalesce(text, '')} AS x FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT DISTINCT conv_id, xor(list_reduce(list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda s: CAST(ascii(s) AS BIGINT)), lambda a, b: list_reduce(range(8), lambda k, i: xor(k >> 1, (k & 1) * 3988292384), xor(a, b)), 4294967295), 4294967295) % 6 AS h FROM t),
o AS (SELECT c.conv_id, list(x ORDER BY p) FILTER (p > h) AS own FROM c JOIN t USING (conv_id) GROUP BY 1),
b AS (SELECT c.conv_id, list(x ORDER BY p) FILTER (p <= h) AS taken FROM c JOIN t ON t.conv_id = c.conv_id - c.conv_id % 100 GROUP BY 1),
r AS (SELECT conv_id, list_concat(coalesce(taken, []), coalesce(own, [])) AS seq FROM c LEFT JOIN o USING (conv_id) LEFT JOIN b USING (conv_id)),
q AS (SELECT conv_id, len(seq) AS n, d, seq[1:d] AS node FROM (SELECT conv_id, seq, unnest(range(0, len(seq) + 1)) AS d FROM r)),
n AS (SELECT node, d, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * CASE WHEN d = 0 THEN 0 ELSE length(node[d].text) END AS saved, coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (n = d), '') AS ends FROM q GROUP BY node, d),
k AS (SELECT node[1:d - 1] AS node, d - 1 AS d, count(*) AS n_children FROM n WHERE d > 0 GROUP BY 1, 2),
a AS (SELECT node, saved, unnest(range(0, d + 1)) AS up FROM n), l AS (SELECT n.node, n.d FROM n LEFT JOIN k ON n.node = k.node AND n.d = k.d WHERE k.d IS NULL),
u AS (SELECT node[1:up] AS node, up AS d, sum(saved) AS saved_tokens FROM a GROUP BY 1, 2), v AS (SELECT node[1:up] AS node, up AS d, count(*) AS n_leaves FROM (SELECT node, unnest(range(0, d + 1)) AS up FROM l) GROUP BY 1, 2)
SELECT n.conv_id, n.d AS depth, m.conv_id AS parent_conv_id, n.n_convs, coalesce(k.n_children, 0) AS n_children, v.n_leaves, CAST(u.saved_tokens AS BIGINT) AS saved_tokens, sha256(n.ends) AS ends_sha256
FROM n JOIN u ON n.node = u.node AND n.d = u.d JOIN v ON n.node = v.node AND n.d = v.d LEFT JOIN k ON n.node = k.node AND n.d = k.d LEFT JOIN n m ON m.node = n.node[1:n.d - 1] AND m.d = n.d - 1"""

OP12 = r"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') AS t FROM documents),
s AS (SELECT count(*) AS docs, CAST(sum(len(t)) AS BIGINT) AS words FROM d WHERE len(t) > 0),
i AS (SELECT row_number() OVER () AS q, item_id, unnest(list_distinct(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+'))) AS term FROM benchmark),
p AS (SELECT r, doc_id, n, term, count(*) AS tf FROM (SELECT r, doc_id, len(t) AS n, unnest(t) AS term FROM d) WHERE term IN (SELECT term FROM i) GROUP BY ALL),
w AS (SELECT term, CAST(floor(1000 * ln((2 * docs + 2) / (2 * df + 1))) AS BIGINT) AS w FROM (SELECT term, count(*) AS df FROM p GROUP BY 1), s),
z AS (SELECT q, item_id, r, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * docs) // words)))) AS BIGINT) AS score FROM i JOIN w USING (term) JOIN p USING (term), s GROUP BY ALL)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id) AS rank FROM z WHERE score > 0) WHERE rank <= 10"""

ORACLE_SQL = {"op1_quality_rules": OP1, "op2_line_dedup": OP2, "op4_secret_scan": _secrets_sql(), "op11_conversation_trie": OP11, "op12_lexical_search": OP12}

"""The queries of the training-data operators, and the SQL that checks them where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .decontamination import op6_benchmark_decontamination
from .jaccard_join import op2_ngram_jaccard_join
from .lexical_search import op13_lexical_search
from .license_scan import op5_license_scan
from .lm_scoring import op10_lm_scoring
from .packing import op1_best_fit_packing
from .personal_data import op12_personal_data
from .quality_model import op9_quality_classifier
from .quality_rules import op8_quality_rules
from .secret_scan import BASE, RULES, op3_secret_scan
from .shared import Scratch
from .source_divergence import op11_source_divergence
from .substring_dedup import op7_substring_dedup
from .token_files import op4_token_files

Query = Callable[[SparkSession, str], DataFrame]


def tidy(f: Query) -> Query:
    """The query with its result written, and every table that it wrote on the way deleted."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        with Scratch(spark) as scratch:
            return scratch.hand_out(f(spark, sf_dir), f.__name__)

    return run


QUERIES: dict[str, Query] = {
    f.__name__: tidy(f)
    for f in (
        op1_best_fit_packing,
        op2_ngram_jaccard_join,
        op3_secret_scan,
        op4_token_files,
        op5_license_scan,
        op6_benchmark_decontamination,
        op7_substring_dedup,
        op8_quality_rules,
        op9_quality_classifier,
        op10_lm_scoring,
        op11_source_divergence,
        op12_personal_data,
        op13_lexical_search,
    )
}


def _secret_sql() -> str:
    """The rules' spans by split lengths: what lies before the i-th match is its place."""
    parts = []
    for rank, rule in enumerate(RULES):
        pattern = rule.pattern.replace("'", "''")
        parts.append(
            f"SELECT rid, {rank} AS rank, '{rule.kind}' AS kind, unnest(range(1, len(m) + 1)) AS i, m, p, g FROM (SELECT rid, regexp_extract_all(t, '{pattern}', 0) AS m, "
            f"string_split_regex(t, '{pattern}') AS p, regexp_extract_all(t, '{pattern}', {rule.group}) AS g FROM d)"
        )
        parts[-1] = f"SELECT rid, rank, kind, list_sum(list_transform(p[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS a, length(m[i]) AS n FROM ({parts[-1]}) WHERE length(g[i]) >= {rule.least}"
    listed = "string_agg(concat(kind, ':', CAST(a AS BIGINT), ':', CAST(a + n AS BIGINT)), ',' ORDER BY a, rank)"
    counts = ", ".join(f"count(*) FILTER (WHERE kind = '{r.kind}') AS n_{r.kind}" for r in BASE)
    return (
        "WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents), s AS (" + " UNION ALL ".join(parts) + ") "
        f"SELECT doc_id, {counts}, sha256(coalesce({listed} FILTER (WHERE rank < {len(BASE)}), '')) AS base_sha256, coalesce({listed} FILTER (WHERE rank IS NOT NULL), '') AS spans FROM d LEFT JOIN s USING (rid) GROUP BY rid, doc_id"
    )


_JACCARD_SQL = r"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
l AS (SELECT doc_id, CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS l FROM w),
s AS (SELECT DISTINCT doc_id, unnest(l) AS sh FROM l), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY ALL),
k AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
e AS (SELECT a, b FROM k UNION SELECT b, a FROM k), r AS (SELECT doc_id AS id, doc_id AS r FROM documents UNION SELECT r.id, e.b FROM r JOIN e ON r.r = e.a)
SELECT l.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id FROM l LEFT JOIN n USING (doc_id) JOIN (SELECT id, min(r) AS component_id FROM r GROUP BY id) c ON c.id = l.doc_id"""

_SUBSTRING_SQL = r"""WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT doc_id, p, md5(substr(h, 2 * p + 1, 200)) AS k FROM (SELECT doc_id, h, unnest(range(0, length(h) // 2 - 99)) AS p FROM d)),
f AS (SELECT doc_id, p, row_number() OVER (PARTITION BY k ORDER BY doc_id, p) > 1 AS again FROM w),
r AS (SELECT doc_id, p, p - row_number() OVER (PARTITION BY doc_id ORDER BY p) AS run FROM f WHERE again),
u AS (SELECT doc_id, min(p) AS a, max(p) + 100 AS b FROM r GROUP BY doc_id, run),
i AS (SELECT doc_id, a, b, sum(CAST(coalesce(a > reach, true) AS INT)) OVER (PARTITION BY doc_id ORDER BY a) AS island FROM (SELECT *, max(b) OVER (PARTITION BY doc_id ORDER BY a ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM u)),
s AS (SELECT doc_id, min(a) AS a, max(b) AS b FROM i GROUP BY doc_id, island),
g AS (SELECT doc_id, b AS a, lead(a) OVER (PARTITION BY doc_id ORDER BY a) AS b FROM (SELECT doc_id, a, b FROM s UNION ALL SELECT doc_id, -1, 0 FROM d)),
t AS (SELECT doc_id, count(*) AS n, sum(b - a) AS gone FROM s GROUP BY doc_id)
SELECT d.doc_id, any_value(length(h) // 2) AS n_bytes, any_value(CAST(coalesce(gone, 0) AS BIGINT)) AS n_removed, any_value(coalesce(n, 0)) AS n_spans,
sha256(unhex(coalesce(string_agg(substr(h, 2 * a + 1, 2 * (coalesce(b, length(h) // 2) - a)), '' ORDER BY a), ''))) AS kept_sha256
FROM d LEFT JOIN t USING (doc_id) JOIN g USING (doc_id) GROUP BY d.doc_id"""

_SEARCH_SQL = r"""WITH t AS (SELECT 0 AS side, doc_id AS id, row_number() OVER () AS rid, text FROM documents UNION ALL SELECT 1, item_id, rid, text FROM (SELECT item_id, text, row_number() OVER () AS rid FROM (SELECT DISTINCT item_id, text FROM benchmark))),
w AS (SELECT side, id, rid, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM t),
c AS (SELECT side, id, rid, term, count(*) AS tf FROM w GROUP BY ALL), n AS (SELECT rid, sum(tf) AS n FROM c WHERE side = 0 GROUP BY rid), z AS (SELECT count(*) AS docs, sum(n) AS terms FROM n),
d AS (SELECT term, CAST(floor(1000 * ln((2 * any_value(docs) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM c, z WHERE side = 0 GROUP BY term),
m AS (SELECT rid, 50 + (50 * n * docs) // terms AS m FROM n, z),
s AS (SELECT q.rid AS item, any_value(q.id) AS item_id, c.rid, any_value(c.id) AS doc_id, CAST(sum(d.w * ((1000000000 * c.tf) // (1000 * c.tf + 20 * m.m))) AS BIGINT) AS score FROM c q JOIN c ON q.side = 1 AND c.side = 0 AND q.term = c.term JOIN d ON d.term = q.term JOIN m ON m.rid = c.rid GROUP BY q.rid, c.rid)
SELECT item_id, CAST(rank AS INT) AS rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0) WHERE rank <= 50"""

_DIVERGENCE_SQL = r"""WITH d AS (SELECT row_number() OVER () AS rid, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
w AS (SELECT rid, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
c AS (SELECT lang, source, term, count(*) AS n, count(DISTINCT rid) AS docs FROM w GROUP BY ALL),
k AS (SELECT lang, term, sum(n) AS total FROM c GROUP BY lang, term HAVING sum(docs) >= 10),
v AS (SELECT lang, count(*) AS v, sum(total) AS n FROM k GROUP BY lang), g AS (SELECT DISTINCT lang, source FROM d),
h AS (SELECT g.lang, g.source, v.v, v.n AS n_lang, coalesce(s.n, 0) AS n FROM g JOIN v USING (lang) LEFT JOIN (SELECT lang, source, sum(n) AS n FROM c SEMI JOIN k USING (lang, term) GROUP BY ALL) s USING (lang, source)),
p AS (SELECT h.lang, h.source, k.term, coalesce(c.n, 0) AS n, 1 + (1000000000 * (coalesce(c.n, 0) + 2)) // (h.n + 2 * h.v) AS p, 1 + (1000000000 * (k.total + 2)) // (h.n_lang + 2 * h.v) AS q FROM h JOIN k USING (lang) LEFT JOIN c USING (lang, source, term)),
f AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
r AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
UNION ALL SELECT lang, source, 'term', term, (p - q) * (p - q) // (p + q) FROM p WHERE n > 0 AND p > q)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM r) WHERE part = 'pair' OR rank <= 10"""

ORACLES: dict[str, str] = {"op11_source_divergence": _DIVERGENCE_SQL, "op13_lexical_search": _SEARCH_SQL, "op7_substring_dedup": _SUBSTRING_SQL, "op2_ngram_jaccard_join": _JACCARD_SQL, "op3_secret_scan": _secret_sql()}

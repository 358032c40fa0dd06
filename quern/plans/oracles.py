"""DuckDB SQL for the registered queries; every text begins with the shared definitions."""

from __future__ import annotations

from .queries import LEVEL_SUP, MIN_CONF, MIN_SUP, PARTITIONS, SPARSE_PARTITIONS, STOP

_TILE = "(ntile(10) OVER (ORDER BY {0}, doc_id) - 1)"


def _sets(of: str, kind: str = "VARCHAR") -> str:
    """Subsets of one to three items of the rows of ``of`` (part, doc_idx, label, item); '' or 0 stands for no item."""
    join = lambda a, b: f"{b}.part = {a}.part AND {b}.doc_idx = {a}.doc_idx AND {b}.item > {a}.item"
    none = "''" if kind == "VARCHAR" else "0"
    return f"""
  SELECT part, doc_idx, label, 1 AS size, item AS a, {none} AS b, {none} AS c FROM {of}
  UNION ALL SELECT x.part, x.doc_idx, x.label, 2, x.item, y.item, {none} FROM {of} x JOIN {of} y ON {join('x', 'y')}
  UNION ALL SELECT x.part, x.doc_idx, x.label, 3, x.item, y.item, z.item FROM {of} x JOIN {of} y ON {join('x', 'y')} JOIN {of} z ON {join('y', 'z')}"""


def _rules(of: str, min_conf: float = MIN_CONF, min_sup: int = MIN_SUP) -> str:
    passing = lambda c: f"((n_c{c} / n)::FLOAT >= {min_conf}::FLOAT)::INT"
    return f"SELECT part, size, a, b, c, {passing(0)} + {passing(1)} AS k FROM {of} WHERE size = 1 OR n >= {min_sup}"


_SUPPORT = "SELECT part, size, a, b, c, count(*) AS n, count(*) FILTER (label = 0) AS n_c0, count(*) FILTER (label = 1) AS n_c1 FROM {0} GROUP BY ALL"
_MATCH = "r.part = s.part AND r.size = s.size AND r.a = s.a AND r.b = s.b AND r.c = s.c"


def _count(rules: str, where: str = "true") -> str:
    return f"""
  SELECT p.part, p.doc_idx, coalesce(m.rules, 0)::BIGINT AS rules FROM (SELECT DISTINCT part, doc_idx FROM parted) p
  LEFT JOIN (SELECT s.part, s.doc_idx, sum(k) AS rules FROM every s JOIN {rules} r ON {_MATCH} WHERE {where} GROUP BY ALL) m USING (part, doc_idx)"""


_BASE = f"""
WITH RECURSIVE docs AS (SELECT (row_number() OVER (ORDER BY vec_id) - 1) AS doc_idx, vec_id, label % 2 AS label, embedding FROM embeddings),
vals AS (SELECT doc_idx, vec_id, label, generate_subscripts(embedding, 1) AS pos, unnest(embedding) AS v FROM docs),
tx AS (SELECT doc_idx, label, pos, 'f' || pos || '=' || (ntile(10) OVER (PARTITION BY pos ORDER BY v, vec_id) - 1) AS item FROM vals),
wide AS (SELECT doc_idx, label, count(*) AS n_items, string_agg(item, ' ' ORDER BY pos) AS items_text, first(item ORDER BY pos) AS first_item FROM tx GROUP BY ALL),
forder AS (SELECT row_number() OVER (ORDER BY (pos * 37) % 65) - 1 AS rank, pos FROM (SELECT unnest(range(1, 65)) AS pos)),
parted AS (SELECT rank % {PARTITIONS} AS part, doc_idx, label, pos, item FROM tx JOIN forder USING (pos)),
df AS (SELECT item, count(*) AS df FROM tx GROUP BY item),
sums AS (SELECT part, doc_idx, sum(df)::BIGINT AS df_sum FROM parted JOIN df USING (item) GROUP BY ALL),
every AS ({_sets("parted")}),
support AS ({_SUPPORT.format("every")}),
rules AS ({_rules("support")}),
orders_docs AS (
  SELECT (row_number() OVER (ORDER BY o_orderkey) - 1) AS doc_idx, (o_orderstatus = 'F')::INT AS label,
    ['prio=' || o_orderpriority, 'month=' || month(o_orderdate), 'seg=' || c_mktsegment, 'nation=' || n_name] AS items
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
),
orders_tx AS (SELECT doc_idx, label, unnest(items) AS item FROM orders_docs),
document_rows AS (
  SELECT doc_id, quality AS label, lang, source, n_chars, length(text) - length(replace(text, ' ', '')) AS spaces, length(text) - length(replace(text, chr(10), '')) AS ends
  FROM documents JOIN labels USING (doc_id)
),
document_docs AS (
  SELECT (row_number() OVER (ORDER BY doc_id) - 1) AS doc_idx, label,
    ['lang=' || lang, 'source=' || source, 'nchars=' || {_TILE.format("n_chars")}, 'words=' || {_TILE.format("spaces")}, 'lines=' || least(9, ends)] AS items
  FROM document_rows
),
sparse_docs AS (
  SELECT doc_idx, label, list_filter(items, lambda x: x NOT IN ('lang=en', 'lines=0') AND NOT regexp_matches(x, '^(nchars|words)=[0-4]$')) AS items FROM document_docs
),
-- lazy classification over all positions; items by number, which is all that the joins need
numbers AS (SELECT item, row_number() OVER (ORDER BY item)::INT AS id FROM df),
lazy_docs AS (SELECT 0 AS part, doc_idx, label, id AS item FROM tx JOIN numbers USING (item)),
lazy_sets AS ({_sets("lazy_docs", "INT")}),
lazy_support AS (
  SELECT size, a, b, c, count(*) AS n, count(*) FILTER (label = 0) AS n_c0, count(*) FILTER (label = 1) AS n_c1 FROM lazy_sets WHERE doc_idx % 5 != 0 GROUP BY ALL
),
lazy_found AS (
  SELECT s.doc_idx // 5 AS test_idx, l.label, n, CASE l.label WHEN 0 THEN n_c0 ELSE n_c1 END AS n_c
  FROM lazy_sets s JOIN lazy_support r USING (size, a, b, c) CROSS JOIN (SELECT unnest([0, 1]) AS label) l WHERE s.doc_idx % 5 = 0
),
tests AS (SELECT DISTINCT doc_idx // 5 AS test_idx, label FROM lazy_docs WHERE doc_idx % 5 = 0),
lazy AS (
  SELECT g.test_idx, l.label, count(f.n) AS n_rules, coalesce(sum(f.n_c / f.n), 0.0) AS sum_conf
  FROM tests g CROSS JOIN (SELECT unnest([0, 1]) AS label) l
  LEFT JOIN lazy_found f ON f.test_idx = g.test_idx AND f.label = l.label AND (f.n_c / f.n)::FLOAT >= {MIN_CONF}::FLOAT GROUP BY ALL
),
means AS (SELECT test_idx, label, CASE WHEN n_rules > 0 THEN sum_conf / n_rules END AS m FROM lazy),
scores AS (
  SELECT test_idx, label, CASE WHEN count(m) OVER w = 2 AND sum(m) OVER w > 0 THEN m / sum(m) OVER w ELSE m END AS score
  FROM means WINDOW w AS (PARTITION BY test_idx)
),
top AS (SELECT test_idx, coalesce(arg_min(label, (-score, label)) FILTER (score IS NOT NULL), 0) AS prediction FROM scores GROUP BY test_idx),
predicted AS (SELECT t.test_idx, t.label, prediction, r.rules FROM tests t JOIN top USING (test_idx) JOIN (SELECT test_idx, sum(n_rules)::BIGINT AS rules FROM lazy GROUP BY 1) r USING (test_idx)),
ranking AS (SELECT test_idx, CASE WHEN count(score) = 2 THEN sum(label * score) END AS value FROM scores GROUP BY 1),
entropy AS (SELECT test_idx, CASE WHEN count(*) FILTER (score > 0) = 2 THEN -sum(CASE WHEN score > 0 THEN score * log2(score) END) END AS value FROM scores GROUP BY 1),
counts AS (
  SELECT l.label, count(*) FILTER (prediction = l.label) AS predicted, count(*) FILTER (prediction = l.label AND p.label = l.label) AS correct, count(*) FILTER (p.label = l.label) AS truth
  FROM predicted p CROSS JOIN (SELECT unnest([0, 1]) AS label) l GROUP BY 1
),
ratios AS (SELECT label, correct, truth, CASE WHEN predicted > 0 THEN correct / predicted END AS p, CASE WHEN truth > 0 THEN correct / truth END AS r FROM counts),
per_class AS (SELECT *, CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) END AS f1 FROM ratios)
"""


def _running() -> str:
    total = lambda cond: f"count(*) FILTER ({cond}) OVER w"
    ratio = lambda a, b: f"CASE WHEN {b} > 0 THEN {a} / {b} END"
    cols = ", ".join(f"{total(f'prediction = {c}')} AS p{c}, {total(f'prediction = {c} AND label = {c}')} AS k{c}, {total(f'label = {c}')} AS t{c}" for c in (0, 1))
    ratios = ", ".join(f"{ratio(f'k{c}', f'p{c}')} AS a{c}, {ratio(f'k{c}', f't{c}')} AS b{c}" for c in (0, 1))
    f1 = lambda c: f"CASE WHEN a{c} + b{c} > 0 THEN 2 * a{c} * b{c} / (a{c} + b{c}) END"
    return f""", run AS (SELECT row_number() OVER w AS seq, {cols} FROM predicted WINDOW w AS (ORDER BY test_idx ROWS UNBOUNDED PRECEDING)),
rates AS (SELECT *, {ratios} FROM run)
SELECT seq, round((k0 + k1) / seq, 6) AS acc, round(list_avg(list_filter([{f1(0)}, {f1(1)}], lambda x: x IS NOT NULL)), 6) AS macro_f1 FROM rates"""


def _rounds() -> str:
    """The seed and two rounds of sampling, one definition after the other."""
    pick = lambda counts: f"SELECT part, arg_min((doc_idx, rules), (rules, df_sum, -doc_idx)) AS x FROM {counts} JOIN sums USING (part, doc_idx) GROUP BY part"

    def counted(k: int, of: str) -> str:
        match = _MATCH
        return f"""
of{k} AS ({_sets(of)}), support{k} AS ({_SUPPORT.format(f"of{k}")}), rules{k} AS ({_rules(f"support{k}")}),
counts{k} AS (
  SELECT p.part, p.doc_idx, coalesce(m.rules, 0)::BIGINT AS rules FROM (SELECT DISTINCT part, doc_idx FROM parted) p
  LEFT JOIN (SELECT s.part, s.doc_idx, sum(k) AS rules FROM every s JOIN rules{k} r ON {match} GROUP BY ALL) m USING (part, doc_idx)
),
pick{k} AS (SELECT part, x[1] AS doc_idx, x[2] AS rules FROM ({pick(f"counts{k}")}))"""

    return f""", seed AS (SELECT part, arg_max(doc_idx, (df_sum, doc_idx)) AS doc_idx FROM sums GROUP BY part),
set1 AS (SELECT p.* FROM parted p JOIN seed USING (part, doc_idx)), {counted(1, "set1")},
-- a seed that is picked again counts twice: the second copy gets a number of its own
set2 AS (SELECT * FROM set1 UNION ALL SELECT p.part, p.doc_idx + 1000000000, p.label, p.pos, p.item FROM parted p JOIN pick1 USING (part, doc_idx)), {counted(2, "set2")}
SELECT part, 0 AS step, doc_idx, 0::BIGINT AS rules FROM seed
UNION ALL SELECT part, 1, doc_idx, rules FROM pick1
UNION ALL SELECT a.part, 2, a.doc_idx, a.rules FROM pick2 a JOIN pick1 b USING (part) WHERE a.doc_idx != b.doc_idx"""


def _sparse(partitions: int = SPARSE_PARTITIONS) -> str:
    """The sparse documents by partition, as parts of a WITH."""
    return f""", sparse_tx AS (SELECT doc_idx, label, generate_subscripts(items, 1) AS pos, unnest(items) AS item FROM sparse_docs),
sparse_part AS (SELECT ((pos - 1) % {partitions})::INT AS part, doc_idx, label, item FROM sparse_tx),
sparse_every AS (SELECT part::INT AS part, doc_idx, label FROM sparse_docs CROSS JOIN (SELECT unnest(range({partitions})) AS part)),
sparse_df AS (SELECT item, count(*) AS df FROM sparse_tx GROUP BY item),
sparse_sums AS (SELECT e.part, e.doc_idx, coalesce(sum(df), 0)::BIGINT AS df_sum FROM sparse_every e LEFT JOIN sparse_part p ON p.part = e.part AND p.doc_idx = e.doc_idx LEFT JOIN sparse_df d ON d.item = p.item GROUP BY ALL),
sparse_seed AS (SELECT part, arg_max(doc_idx, (df_sum, doc_idx)) AS doc_idx FROM sparse_sums GROUP BY part),
sparse_current AS (SELECT DISTINCT part, item FROM sparse_part SEMI JOIN sparse_seed USING (part, doc_idx))"""


def _run(of: str, sums: str) -> str:
    """The whole sampling over ``of`` (part, doc_idx, label, item) with the sums ``sums``: run, one row for each round."""
    passing = lambda c: f"((n_c{c} / n)::FLOAT >= {MIN_CONF}::FLOAT)::INT"
    return f""", of_run AS ({_sets(of)}),
run(part, step, doc_idx, rules, repeated) USING KEY (part, step) AS (
  SELECT part, 0, arg_max(doc_idx, (df_sum, doc_idx)), 0::BIGINT, false FROM {sums} GROUP BY part
  UNION ALL (
    WITH latest AS (SELECT part, step FROM run WHERE NOT repeated),
    taken AS (SELECT r.part, r.step, r.doc_idx FROM recurring.run r JOIN latest USING (part)),
    found AS (
      SELECT s.part, s.size, s.a, s.b, s.c, count(*) AS n, count(*) FILTER (label = 0) AS n_c0, count(*) FILTER (label = 1) AS n_c1
      FROM taken t JOIN of_run s ON s.part = t.part AND s.doc_idx = t.doc_idx GROUP BY ALL
    ),
    valid AS (SELECT part, size, a, b, c, {passing(0)} + {passing(1)} AS k FROM found WHERE size = 1 OR n >= {MIN_SUP}),
    counts AS (SELECT s.part, s.doc_idx, sum(k)::BIGINT AS rules FROM of_run s JOIN valid r ON {_MATCH} GROUP BY ALL),
    pick AS (
      SELECT e.part, arg_min((e.doc_idx, coalesce(c.rules, 0)), (coalesce(c.rules, 0), df_sum, -e.doc_idx)) AS x
      FROM {sums} e JOIN latest ON latest.part = e.part LEFT JOIN counts c ON c.part = e.part AND c.doc_idx = e.doc_idx GROUP BY e.part
    ),
    before AS (SELECT DISTINCT part, doc_idx FROM taken WHERE step > 0)
    SELECT p.part, l.step + 1, p.x[1], p.x[2], b.part IS NOT NULL
    FROM pick p JOIN latest l ON l.part = p.part LEFT JOIN before b ON b.part = p.part AND b.doc_idx = p.x[1]
  )
)"""


_SPARSE_RUN = _sparse() + _run("sparse_part", "sparse_sums")
_REDUCED = _SPARSE_RUN + ", reduced AS (SELECT * FROM sparse_docs SEMI JOIN (SELECT doc_idx FROM run WHERE NOT repeated) USING (doc_idx))\n"

_CHI = """, own AS (SELECT pos, item, count(*) AS n, count(*) FILTER (label = 0) AS n0, count(*) FILTER (label = 1) AS n1 FROM tx GROUP BY ALL),
total AS (SELECT pos, count(*) AS n, count(*) FILTER (label = 0) AS n0, count(*) FILTER (label = 1) AS n1 FROM tx GROUP BY pos),
terms AS (SELECT o.pos, o.n * t.n0 / t.n AS e0, o.n * t.n1 / t.n AS e1, o.n0, o.n1 FROM own o JOIN total t USING (pos)),
chi AS (SELECT pos, round(sum(CASE WHEN e0 > 0 THEN (n0 - e0) * (n0 - e0) / e0 ELSE 0 END + CASE WHEN e1 > 0 THEN (n1 - e1) * (n1 - e1) / e1 ELSE 0 END), 9) AS chi2 FROM terms GROUP BY pos),
chi_order AS (SELECT row_number() OVER (ORDER BY chi2 DESC, pos) - 1 AS rank, pos::INT AS pos, chi2 FROM chi)
"""
_ORDER_SETS = f""", order_tx AS (SELECT 0 AS part, doc_idx, label, unnest(items) AS item FROM orders_docs), order_sets AS ({_sets("order_tx")})"""

_NUMBER = "CASE WHEN {0} IS NULL THEN 'nan' ELSE printf('%.6f', {0}) END"

_QUERIES = {
    "scan_transactions": "SELECT doc_idx, label, n_items, items_text FROM wide",
    "scan_transactions_documents": "SELECT doc_idx, label, 5 AS n_items, array_to_string(items, ' ') AS items_text FROM document_docs",
    "scan_transactions_orders": "SELECT doc_idx, label, 4 AS n_items, array_to_string(items, ' ') AS items_text FROM orders_docs",
    "tokenize": """, found AS (SELECT doc_idx, string_split(concat_ws(' ', doc_idx + 1, 'CLASS=' || label, items_text, first_item), ' ') AS t FROM wide)
SELECT doc_idx, doc_idx + 1 AS qid, generate_subscripts(t, 1) - 1 AS pos, unnest(t) AS token FROM found""",
    "class_extract": "SELECT doc_idx, label FROM docs",
    "dedup_items": "SELECT doc_idx, n_items + 1 AS n_before, n_items AS n_after FROM wide",
    "item_dictionary": "SELECT item, row_number() OVER (ORDER BY f) + 1 AS item_id FROM (SELECT item, min((doc_idx, pos)) AS f FROM tx GROUP BY item)",
    "encode_decode": "SELECT doc_idx, label, pos, item FROM tx",
    "extended_dictionary": """, o AS (SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS doc_idx, ['cust=' || o_custkey, 'day=' || strftime(o_orderdate, '%Y-%m-%d')] AS items FROM orders),
t AS (SELECT doc_idx, CASE WHEN doc_idx % 5 != 0 THEN 0 WHEN doc_idx % 10 = 0 THEN 1 ELSE 2 END AS turn, generate_subscripts(items, 1) AS pos, unnest(items) AS item FROM o),
f AS (SELECT item, min((turn, doc_idx, pos)) AS first, count(*) FILTER (turn = 0) AS n FROM t GROUP BY item)
SELECT item, row_number() OVER (ORDER BY first) + 1 AS item_id, n FROM f""",
    "inverted_lists": "SELECT item, doc_idx // 65536 AS block, count(*) AS n, min(doc_idx) + 1 AS first_doc, max(doc_idx) + 1 AS last_doc, string_agg((doc_idx + 1)::VARCHAR, ',' ORDER BY doc_idx) AS doc_list FROM tx GROUP BY ALL",
    "class_counts": "SELECT label, count(*) AS n FROM docs GROUP BY label",
    "class_counts_orders": "SELECT label, count(*) AS n FROM orders_docs GROUP BY label",
    "class_counts_sparse": "SELECT label, count(*) AS n FROM sparse_docs GROUP BY label",
    "class_token_counts": "SELECT label, sum(CASE WHEN doc_idx % 7 = 0 THEN 2 ELSE 1 END)::BIGINT AS n FROM docs GROUP BY label",
    "scan_test": "SELECT doc_idx // 5 AS test_idx, label, string_agg(item, ' ' ORDER BY item) AS items_text FROM tx WHERE doc_idx % 5 = 0 GROUP BY ALL",
    "scan_test_stop": f"SELECT doc_idx // 5 AS test_idx, label, string_agg(item, ' ' ORDER BY item) AS items_text FROM tx WHERE doc_idx % 5 = 0 AND doc_idx < {STOP} GROUP BY ALL",
    "text_round_trip": "SELECT doc_idx, doc_idx + 1 AS qid, label, n_items, items_text FROM wide",
    "text_ranges_round_trip": "SELECT doc_idx, doc_idx + 1 AS qid, label, n_items, items_text FROM wide",
    "line_count": "SELECT count(*) AS n FROM docs",
    "validate_bounds": """SELECT 'lines' AS "check", count(*) <= 1200 AS ok FROM docs UNION ALL SELECT 'features', max(n_items) <= 65 FROM wide UNION ALL SELECT 'items', count(*) <= 651 FROM df""",
    "feature_order": "SELECT rank, pos FROM forder",
    "feature_order_file": _CHI + "SELECT rank, pos FROM chi_order",
    "chi_square_order": _CHI + "SELECT rank, pos, round(chi2, 6) AS chi2 FROM chi_order",
    "ranked_subsets": """, o AS (SELECT doc_idx, unnest(items) AS item FROM orders_docs), num AS (SELECT item, row_number() OVER (ORDER BY item) AS id FROM (SELECT DISTINCT item FROM o)),
m AS (SELECT doc_idx, id FROM o JOIN num USING (item)),
two AS (SELECT a.doc_idx, a.id AS a, b.id AS b FROM m a JOIN m b ON b.doc_idx = a.doc_idx AND b.id > a.id),
three AS (SELECT t.*, c.id AS c FROM two t JOIN m c ON c.doc_idx = t.doc_idx AND c.id > t.b),
four AS (SELECT t.*, d.id AS d FROM three t JOIN m d ON d.doc_idx = t.doc_idx AND d.id > t.c),
s AS (SELECT doc_idx, 1 AS size, [id] AS m FROM m UNION ALL SELECT doc_idx, 2, [a, b] FROM two UNION ALL SELECT doc_idx, 3, [a, b, c] FROM three UNION ALL SELECT doc_idx, 4, [a, b, c, d] FROM four)
SELECT doc_idx, size, row_number() OVER (PARTITION BY doc_idx, size ORDER BY m) - 1 AS rank, array_to_string(m, ',') AS members FROM s""",
    "feature_partitions": "SELECT part, doc_idx, count(*) AS n_items, string_agg(item, ' ' ORDER BY item) AS items_text FROM parted GROUP BY ALL",
    "item_df": "SELECT item, df FROM df",
    "item_df_orders": "SELECT item, count(*) AS df FROM orders_tx GROUP BY item",
    "doc_df_sum": "SELECT part, doc_idx, df_sum FROM sums",
    "doc_df_sum_sparse": _sparse() + " SELECT part, doc_idx, df_sum FROM sparse_sums",
    "most_representative": "SELECT part, x[1] AS doc_idx, x[2] AS df_sum FROM (SELECT part, arg_max((doc_idx, df_sum), (df_sum, doc_idx)) AS x FROM sums GROUP BY part)",
    "most_representative_orders": """, f AS (SELECT item, count(*) AS df FROM orders_tx GROUP BY item), s AS (SELECT doc_idx, sum(df)::BIGINT AS df_sum FROM orders_tx JOIN f USING (item) GROUP BY doc_idx)
SELECT 0 AS part, x[1] AS doc_idx, x[2] AS df_sum FROM (SELECT arg_max((doc_idx, df_sum), (df_sum, doc_idx)) AS x FROM s)""",
    "current_items": "SELECT DISTINCT part, item FROM parted",
    "current_items_sparse": _sparse() + " SELECT part, item FROM sparse_current",
    "project_on_current": "SELECT part, doc_idx, count(*) AS n_projected FROM parted GROUP BY ALL",
    "project_on_current_sparse": _sparse()
    + " SELECT e.part, e.doc_idx, count(c.item) AS n_projected FROM sparse_every e LEFT JOIN sparse_part p ON p.part = e.part AND p.doc_idx = e.doc_idx LEFT JOIN sparse_current c ON c.part = p.part AND c.item = p.item GROUP BY ALL",
    "itemsets2_support": "SELECT part, a, b, n, n_c0, n_c1 FROM support WHERE size = 2",
    "itemsets3_support": "SELECT part, a, b, c, n, n_c0, n_c1 FROM support WHERE size = 3",
    "rules_size2": "SELECT part, a AS item, 0 AS label, n, n_c0 AS n_c, round(n_c0 / n, 6) AS conf FROM support WHERE size = 1 UNION ALL SELECT part, a, 1, n, n_c1, round(n_c1 / n, 6) FROM support WHERE size = 1",
    "rule_count_size2": _count("rules", "s.size = 1"),
    "rule_count_size3": _count("rules", "s.size = 2"),
    "rule_count_size4": _count("rules", "s.size = 3"),
    "rule_counts": _count("rules"),
    "rules_min_conf": f", strict AS ({_rules('support', min_conf=0.5)}) {_count('strict')}",
    "rules_min_sup": f", strict AS ({_rules('support', min_sup=3)}) {_count('strict')}",
    "rules_min_sup_8": f", strict AS ({_rules('support', min_sup=8)}) {_count('strict')}",
    "itemset_levels": f""", single AS (SELECT part, a, n FROM support WHERE size = 1),
pair AS (SELECT p.part, p.a, p.b, p.n FROM support p JOIN single x ON x.part = p.part AND x.a = p.a AND x.n >= {LEVEL_SUP} JOIN single y ON y.part = p.part AND y.a = p.b AND y.n >= {LEVEL_SUP} WHERE p.size = 2),
good AS (SELECT * FROM pair WHERE n >= {LEVEL_SUP}),
triple AS (SELECT x.part, x.a, x.b, y.b AS c FROM good x JOIN good y ON y.part = x.part AND y.a = x.a AND y.b > x.b SEMI JOIN good z ON z.part = x.part AND z.a = x.b AND z.b = y.b)
SELECT part::INT AS part, 1 AS size, count(*) AS candidates, count(*) FILTER (n >= {LEVEL_SUP}) AS frequent FROM single GROUP BY part
UNION ALL SELECT part, 2, count(*), count(*) FILTER (n >= {LEVEL_SUP}) FROM pair GROUP BY part
UNION ALL SELECT t.part, 3, count(*), count(*) FILTER (s.n >= {LEVEL_SUP}) FROM triple t LEFT JOIN support s ON s.size = 3 AND s.part = t.part AND s.a = t.a AND s.b = t.b AND s.c = t.c GROUP BY t.part""",
    "least_representative": f", found AS ({_count('rules')}) SELECT part, x[1] AS doc_idx, x[2] AS rules, x[3] AS df_sum FROM (SELECT part, arg_min((doc_idx, rules, df_sum), (rules, df_sum, -doc_idx)) AS x FROM found JOIN sums USING (part, doc_idx) GROUP BY part)",
    "bitmap_support": "SELECT part, a, b, n FROM support WHERE size = 2",
    "sampling_step_k": _rounds(),
    "selective_sampling_sparse": _SPARSE_RUN + " SELECT part, step, doc_idx, rules, repeated FROM run",
    "selective_sampling_p1": _sparse(1) + _run("sparse_part", "sparse_sums") + " SELECT part, step, doc_idx, rules, repeated FROM run",
    "partition_summaries": _SPARSE_RUN + " SELECT part, count(*) FILTER (NOT repeated) AS iterations, max(doc_idx) FILTER (repeated) AS repeated_idx FROM run GROUP BY part",
    "run_diagnostics": _SPARSE_RUN
    + """ SELECT 'documents' AS metric, part, count(*) AS value FROM sparse_every GROUP BY part
UNION ALL SELECT 'items', e.part, count(p.item) FROM (SELECT DISTINCT part FROM sparse_every) e LEFT JOIN sparse_part p ON p.part = e.part GROUP BY e.part
UNION ALL SELECT 'rounds', part, max(step)::BIGINT FROM run GROUP BY part
UNION ALL SELECT 'taken', part, count(DISTINCT doc_idx) FROM run WHERE NOT repeated GROUP BY part
UNION ALL SELECT 'documents', -1, count(*) FROM sparse_docs
UNION ALL SELECT 'reduced', -1, count(DISTINCT doc_idx) FROM run WHERE NOT repeated
UNION ALL SELECT 'rows_read', -1, count(*) FROM sparse_every
UNION ALL SELECT 'items_read', -1, count(*) FROM sparse_part
UNION ALL SELECT 'rounds', -1, max(step)::BIGINT FROM run""",
    "reduced_documents": _REDUCED + "SELECT doc_idx, label FROM reduced",
    "reduced_set_lines": _REDUCED + "SELECT doc_idx, (doc_idx + 1) || ' CLASS=' || label || ' ' || array_to_string(list_transform(items, lambda x: x || ' '), '') AS line FROM reduced ORDER BY doc_idx",
    "lazy_rules": "SELECT test_idx, label, n_rules, round(sum_conf, 6) AS sum_conf FROM lazy",
    "rule_cache_batches": _ORDER_SETS
    + """, known AS (SELECT DISTINCT item FROM order_tx WHERE doc_idx % 5 != 0),
asks AS (SELECT DISTINCT a, b, c, doc_idx % 10 = 0 AS early FROM order_sets s WHERE doc_idx % 5 = 0 AND a IN (FROM known) AND (b = '' OR b IN (FROM known)) AND (c = '' OR c IN (FROM known))),
first AS (SELECT DISTINCT a, b, c FROM asks WHERE early), both_ AS (SELECT DISTINCT a, b, c FROM asks)
SELECT 1::BIGINT AS batch, count(*) AS asked, 0::BIGINT AS there, count(*) AS counted, count(*) AS kept FROM first
UNION ALL SELECT 2, (SELECT count(*) FROM both_), (SELECT count(*) FROM first), (SELECT count(*) FROM both_) - (SELECT count(*) FROM first), (SELECT count(*) FROM both_)""",
    "cached_lazy_rules": _ORDER_SETS
    + f""", s AS (SELECT size, a, b, c, count(*) AS n, count(*) FILTER (label = 0) AS n_c0, count(*) FILTER (label = 1) AS n_c1 FROM order_sets WHERE doc_idx % 5 != 0 GROUP BY ALL),
f AS (SELECT o.doc_idx // 5 AS test_idx, l.label, n, CASE l.label WHEN 0 THEN n_c0 ELSE n_c1 END AS n_c FROM order_sets o JOIN s USING (size, a, b, c) CROSS JOIN (SELECT unnest([0, 1]) AS label) l WHERE o.doc_idx % 5 = 0)
SELECT g.doc_idx // 5 AS test_idx, l.label, count(f.n) AS n_rules, round(coalesce(sum(f.n_c / f.n), 0.0), 6) AS sum_conf
FROM orders_docs g CROSS JOIN (SELECT unnest([0, 1]) AS label) l LEFT JOIN f ON f.test_idx = g.doc_idx // 5 AND f.label = l.label AND (f.n_c / f.n)::FLOAT >= {MIN_CONF}::FLOAT WHERE g.doc_idx % 5 = 0 GROUP BY ALL""",
    "class_scores": "SELECT test_idx, label, round(score, 6) AS score FROM scores",
    "ordered_labels": """, o AS (SELECT test_idx, label, row_number() OVER (PARTITION BY test_idx ORDER BY score DESC NULLS LAST, label) - 1 AS rank, score FROM scores)
SELECT test_idx, rank, CASE WHEN score IS NULL THEN rank ELSE label END AS label FROM o""",
    "lazy_predictions": "SELECT test_idx, label, prediction, rules FROM predicted",
    "ranking_score": "SELECT test_idx, round(value, 6) AS value FROM ranking",
    "prediction_entropy": "SELECT test_idx, round(value, 6) AS value FROM entropy",
    "prediction_lines": f"""SELECT p.test_idx, 'id= ' || (p.test_idx + 1) || ' label= ' || label || ' prediction= ' || prediction || ' ranking= ' || {_NUMBER.format('r.value')} || ' entropy= ' || {_NUMBER.format('e.value')} || ' rules= ' || rules AS line
FROM predicted p JOIN ranking r USING (test_idx) JOIN entropy e USING (test_idx)""",
    "eval_counts": "SELECT label, predicted, correct, truth FROM counts",
    "eval_per_class": "SELECT label, round(p, 6) AS p, round(r, 6) AS r, round(f1, 6) AS f1 FROM per_class",
    "eval_summary": "SELECT round(sum(correct) / sum(truth), 6) AS acc, round(avg(f1), 6) AS macro_f1 FROM per_class",
    "eval_running": _running(),
    "eval_running_stream": _running(),
}

ORACLES = {name: _BASE.rstrip() + (text if text.startswith(",") else "\n" + text) for name, text in _QUERIES.items()} | {
    "combinations_k": """WITH n AS (SELECT unnest(range(20))::INT AS x)
SELECT row_number() OVER (ORDER BY i.x, j.x, k.x) - 1 AS r, i.x AS i, j.x AS j, k.x AS k FROM n i JOIN n j ON j.x > i.x JOIN n k ON k.x > j.x""",
    "binomial_table": """WITH t AS (SELECT n, k FROM (SELECT unnest(range(1, 65)) AS n), (SELECT unnest(range(1, 5)) AS k))
SELECT n::INT AS n, k::INT AS k, CASE k WHEN 1 THEN n WHEN 2 THEN n * (n - 1) // 2 WHEN 3 THEN n * (n - 1) * (n - 2) // 6 ELSE n * (n - 1) * (n - 2) * (n - 3) // 24 END::BIGINT AS c FROM t""",
    "prime_numbers": """WITH n AS (SELECT unnest(range(2, 99960)) AS p), small AS (SELECT p AS d FROM n WHERE p < 317)
SELECT p::INT AS p FROM n WHERE NOT EXISTS (SELECT 1 FROM small WHERE d < p AND p % d = 0)""",
}
